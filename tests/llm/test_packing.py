import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from sparkquill.llm import packing, tokens


def _check(counts, runs, capacity):
    got = Counter()
    for content, number, _ in runs:
        assert number > 0 and 0 < sum(content) <= capacity
        for n in content:
            got[n] += number
    assert got == Counter({n: c for n, c in counts.items() if c})
    return sum(k for _, k, _ in runs)


def test_plans_hold_all_pieces_and_are_near_the_bound():
    draw = random.Random(3)
    for _ in range(30):
        counts = Counter(draw.randint(1, 1024) for _ in range(draw.choice((1, 5, 60, 3000))))
        used = _check(counts, packing.plan(dict(counts)), 1024)
        bound = -(-sum(n * c for n, c in counts.items()) // 1024)
        over_half = sum(c for n, c in counts.items() if n > 512)
        assert used <= max(bound, over_half) * 1.03 + 2
    for counts in ({}, {1024: 5}, {1: 3000}, {513: 7}, {512: 9}, {1023: 2, 1: 2}, {341: 10, 342: 3}):
        used = _check(counts, packing.plan(dict(counts)), 1024)
        assert used >= -(-sum(n * c for n, c in counts.items()) // 1024)
    assert _check({600: 10, 400: 10}, packing.plan({600: 10, 400: 10}), 1024) == 10


def test_pack_against_brute_force(spark):
    draw = random.Random(5)
    words = ["the", "tion", "é", "where", "12", "\n"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.choice((0, 1, 30, 300, 5000)))), "x") for i in range(60)]
    rows += [(3, None, "y"), (None, "a b", "z"), (5, "same", "z"), (5, "same", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    got = packing.pack(docs, "byte_bpe_50k.json").collect()
    enc = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _ in rows:
        ids = np.array(enc.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        n = len(ids) // 4
        starts = [0, *range(n % 1024 or 1024, n, 1024)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
            want[(i, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    lanes = {}
    for r in got:
        lanes.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for lane in lanes.values():
        at = 0
        for offset, length in sorted(lane):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0), "byte_bpe_50k.json").count() == 0


def test_configurations_make_the_sequences_and_need_no_more_than_best_fit():
    draw = random.Random(8)
    makes = ((lambda: min(1024, int(draw.lognormvariate(5.5, 1))), 1.001), (lambda: draw.randint(1, 1024), 1.01), (lambda: draw.choice((300, 340, 400, 512, 600, 700)), 1))
    for make, most in makes:
        counts = Counter(max(1, make()) for _ in range(20_000))
        runs = packing.plan(dict(counts))
        used = _check(counts, runs, 1024)
        plain = packing._Runs(1024)
        for n in sorted(counts, reverse=True):
            plain.best_fit(n, counts[n])
        assert used <= most * sum(k for there in plain.by_room.values() for _, k, _ in there)
        open_, configured = sum(k for c, k, _ in runs if c[0] < 1024), sum(k for _, k, by in runs if by)
        assert configured >= 0.6 * open_
