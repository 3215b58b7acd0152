import itertools
import random

import numpy as np
import pytest

from sparkquill.functions import bits, coder, containers, huffman, pmatic


def test_bits():
    for values in ([], [1], [0] * 8, [1, 0, 1, 1, 0, 0, 1, 0, 1]):
        data, pad = bits.pack(values)
        assert len(data) * 8 - pad == len(values) and bits.unpack(data, len(values)).tolist() == values
    with pytest.raises(ValueError):
        bits.pack([2])
    with pytest.raises(ValueError):
        bits.unpack(b"\x01", 3)  # padding that is not zero
    ids = [0, 151642, 17, 999, 42]
    assert containers.id_width(151643) == 18
    assert bits.unpack_fixed(bits.pack_fixed(ids, 18), 18, 5).tolist() == ids
    with pytest.raises(ValueError):
        bits.pack_fixed([8], 3)
    with pytest.raises(ValueError):
        bits.unpack_fixed(bits.pack_fixed(ids, 18)[:-1], 18, 5)


def _tables(draw, n, size):
    for _ in range(n):
        f = [draw.randint(1, 400) for _ in range(size)]
        yield list(itertools.accumulate(f, initial=0))


@pytest.mark.parametrize("size,n", [(100, 1000), (2, 3000), (1, 50), (7, 0)])
def test_arithmetic_round_trip(size, n):
    draw = random.Random(42)
    tables = list(_tables(draw, n, size))
    symbols = [draw.randrange(size) for _ in tables]
    enc = coder.Encoder()
    for s, t in zip(symbols, tables, strict=True):
        enc.put(t[s], t[s + 1], t[-1])
    assert enc.finished_length() == len(enc.finished())
    dec, out = coder.Decoder(enc.finished()), []
    for t in tables:
        slot = dec.slot(t[-1])
        s = next(k for k in range(size) if t[k] <= slot < t[k + 1])
        dec.take(t[s], t[s + 1], t[-1])
        out.append(s)
    assert out == symbols
    ideal = sum(np.log2(t[-1] / (t[s + 1] - t[s])) for s, t in zip(symbols, tables, strict=True))
    assert abs(len(enc.finished()) - ideal) < 40


def test_skewed_symbols_and_impossible_intervals():
    enc = coder.Encoder()
    for _ in range(20_000):
        enc.put(0, (1 << 30) - 1, 1 << 30)
    enc.put((1 << 30) - 1, 1 << 30, 1 << 30)
    dec = coder.Decoder(enc.finished())
    for _ in range(20_000):
        assert dec.slot(1 << 30) < (1 << 30) - 1
        dec.take(0, (1 << 30) - 1, 1 << 30)
    assert dec.slot(1 << 30) == (1 << 30) - 1
    for bad in ((3, 3, 9), (0, 10, 9), (-1, 2, 9), (0, 1, 1 << 31)):
        with pytest.raises(ValueError):
            enc.put(*bad)


def test_huffman():
    draw = random.Random(3)
    for symbols in ([], [5], [5] * 9, [draw.choice((1, 1, 1, 1, 2, 2, 3, 4)) for _ in range(500)]):
        codes = huffman.codebook(symbols)
        text = huffman.encode(symbols, codes)
        assert huffman.decode(text, codes) == symbols
    assert huffman.codebook([5]) == {5: "0"} and huffman.codebook([]) == {}
    weights = [1, 1, 2, 3, 5, 8]
    symbols = [s for s, n in enumerate(weights) for _ in range(n)]
    pool, total = sorted(weights), 0
    while len(pool) > 1:
        total += pool[0] + pool[1]
        pool = sorted([pool[0] + pool[1], *pool[2:]])
    assert len(huffman.encode(symbols, huffman.codebook(symbols))) == total
    with pytest.raises(ValueError):
        huffman.decode("1", {1: "10", 2: "11"})


def test_pmatic():
    assert pmatic.radius(1e-3) == pytest.approx(0.0020242914979757085) and pmatic.radius(0.01) == 1 / 48 and pmatic.radius(0.24) == 0.5
    with pytest.raises(ValueError):
        pmatic.radius(0.3)
    draw = np.random.default_rng(0)
    p = draw.random((200, 50)) ** 3
    p /= p.sum(1, keepdims=True)
    tokens = [int(draw.choice(50, p=x)) for x in p]
    for delta in (0.01, 0.001):
        code, share = pmatic.encode(tokens, p, delta)
        q = [pmatic.nearby(x, delta * 0.9, i) for i, x in enumerate(p)]
        assert max(pmatic.greatest_difference(a, b) for a, b in zip(p, q, strict=True)) <= delta
        assert pmatic.decode(code, p, delta) == tokens == pmatic.decode(code, q, delta)
        assert 0 <= share < 1


def test_conditional_bits_against_sums():
    p = pmatic.padded(np.array([0.1, 0.2, 0.0, 0.0, 0.7]))
    levels = pmatic.conditional_ones(p)
    assert levels[0].tolist() == [pytest.approx(0.7)] and levels[1].tolist() == [0.0, 0.0] and levels[2][1] == 0.5


def test_containers():
    code, size = bits.pack([1, 0, 1, 1, 0])[0], 5
    data = containers.write_stream(code, size, b"abcd", "m", [785], 4, [9, 3, 9], context_length=100, retain_tokens=100)
    meta, *back = containers.read_stream(data)
    assert back == [code, size] and meta["candidate_token_ids"] == [3, 9] and containers.verify(meta, b"abcd") and not containers.verify(meta, b"abce")
    assert (meta["model_name"], meta["use_kv_cache"]) == ("m", False)
    for bad in (b"", b"XACS" + data[4:], data[:-1], data[:-1] + bytes([data[-1] | 1]), data + b"\0"):
        with pytest.raises(ValueError):
            containers.read_stream(bad)
    for wrong in ({"model_name": ""}, {"seeds": []}, {"token_count": 1}, {"decoded": b""}, {"retain_tokens": 101}, {"retain_tokens": 0}, {"statesize": 0}, {"payload": b"\xff"}):
        given = {"payload": code, "payload_bits": size, "decoded": b"abcd", "model_name": "m", "seeds": [785], "token_count": 4, "context_length": 100, "retain_tokens": 10} | wrong
        with pytest.raises(ValueError):
            containers.write_stream(**given)
    late = data.replace(b'"token_count":4', b'"token_count":1')
    with pytest.raises(ValueError):
        containers.read_stream(late)
    ids = [0, 151642, 17, 999, 42]
    assert containers.read_ids(containers.write_ids(ids, 151643, 37)) == (ids, 37)
    short = containers.read_predictive(containers.write_predictive(*(bits.pack([1, 0, 1, 1, 0, 0, 1])[0], 7), 785, 2, 8, 37))
    assert short == {"model": 2, "seed": 785, "count": 8, "raw_size": 37, "payload": bits.pack([1, 0, 1, 1, 0, 0, 1])[0], "payload_bits": 7}
    given = ({"encoding": "AC"}, [0, 2], bits.pack([1, 1, 0])[0], 3, b"mask")
    assert containers.read_global(containers.write_global(*given)) == given
    with pytest.raises(ValueError):
        containers.read_global(containers.write_global(*given)[:-1])
    assert containers.experiment_key("data/text8", "m", 5, 2, 10, True, 1, False, "hf", "AC", None) == "text8:m|ctx=5|ret=2|n=10|kv=True|batch=1|reduce=False|engine=hf|enc=AC|lora=None"


def test_lanes_send_the_same_bits():
    from sparkquill.functions import lanes

    draw = np.random.default_rng(1)
    for total, sizes in ((1 << 18, [0, 1, 2, 50, 300, 7, 7, 7] + [20] * 40), (7, [100] * 30), (1 << 30, [60] * 30 + [500]), (5, [0]), (5, [])):
        cuts = np.array([0, 1, total // 3, total // 2, total - 1, total] if total > 7 else range(total + 1))
        symbols = [draw.integers(0, len(cuts) - 1, n) if draw.random() < 0.7 else np.full(n, draw.integers(0, len(cuts) - 1)) for n in sizes]
        got = lanes.encode([cuts[s] for s in symbols], [cuts[s + 1] for s in symbols], total)
        for s, (data, n) in zip(symbols, got, strict=True):
            c = coder.Encoder()
            for lo, hi in zip(cuts[s].tolist(), cuts[s + 1].tolist(), strict=True):
                c.put(lo, hi, total)
            want = c.finished()
            assert n == len(want) and data == bits.pack(want)[0]

        def find(_, slot, cuts=cuts):
            s = np.searchsorted(cuts, slot, "right") - 1
            return s, cuts[s], cuts[s + 1]

        one = (lambda c, slot, find=find: tuple(int(x) for x in find(c, slot)), lambda c, s: c)
        for single in (None, one):
            back = lanes.decode(got, sizes, total, find, lambda c, s: c, single=single)
            assert all(a.tolist() == b.tolist() for a, b in zip(back, symbols, strict=True))
    with pytest.raises(ValueError):
        lanes.encode([np.array([3])], [np.array([3])], 10)
    # The middle third postpones a bit for each symbol.
    long = [(np.full(500, 1), np.full(500, 2))] * 30
    got = lanes.encode([a for a, _ in long], [b for _, b in long], 3)
    c = coder.Encoder()
    for _ in range(500):
        c.put(1, 2, 3)
    assert all(x == (bits.pack(c.finished())[0], len(c.finished())) for x in got)
