import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkquill.llm import token_files, tokens

TOKENIZERS = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = ["", " ", "\n\n", "a", "Don't  stop\n\n\nnow !? 12345", " x y z \n\nq", "é́ÀΣΣς İ ﬁ", "<|endoftext|> a <|endoftext|>", "tab\there \r\n x", "a\x1cb \x85 c", "x" * 3000, "a  b   c    ", "日本語 テキスト　です", "it's 's 'S can't"]


def _plain(name):
    """The library alone."""
    tokenizer = Tokenizer.from_file(tokens.vocabulary(name))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _encoded(enc, texts):
    out = []
    for _, ids, ends in enc.encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


@pytest.mark.parametrize("name", TOKENIZERS)
def test_chunks_give_whole_texts_ids(name, monkeypatch):
    draw = random.Random(1)
    signs = "\u00d7\u00f7\u00e8\u00c0ab'sZ\u00e9\u0301 1!\n\t \u3000&(_-\u03a3\u0130.<|\u0661,;"
    texts = ODD + ["".join(draw.choice(signs) for _ in range(draw.randrange(80))) for _ in range(6000)]
    texts += ["".join(draw.choice(("word", "Caf\u00e9", " ", "  ", "\n\n", "12", "3", "'s", "'re", "\u00e9l", "\u03b1\u03a3", "(", "...", "x" * 70)) for _ in range(40)) for _ in range(2000)]
    enc, want = tokens.Encoder(tokens.vocabulary(name)), _plain(name)
    want = [want(x) for x in texts]
    assert _encoded(enc, texts) == want
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 3000)
    monkeypatch.setattr(tokens, "CACHE_CHUNK", 5)
    enc._clear()
    assert _encoded(enc, texts) == want
    plain = _plain(name)
    long = ["".join(draw.choice(("word", "Caf\u00e9", " ", "  ", "\n", "\n\n", "12", "'s", "\u00e9l", "(", "...", "\t")) for _ in range(9000)) for _ in range(4)] + ["y" * 20_000, " " * 20_000, "ab " * 9000]
    assert _encoded(enc, long) == [plain(x) for x in long]
    assert _encoded(enc, [None, "", None]) == [[], [], []] and _encoded(enc, []) == []


def test_unknown_builds_encode_whole(tmp_path):
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    enc = tokens.Encoder(str(tmp_path / "other.json"))
    assert enc.build is None
    assert _encoded(enc, ODD) == [other.encode(x, add_special_tokens=False).ids for x in ODD]


@pytest.mark.parametrize("name", TOKENIZERS)
def test_added_tokens_are_those_of_plain_encode(name):
    texts = ["end <|endoftext|> of text", "<|endoftext|>", "a<|startoftext|>B.<|endoftext|><|endoftext|>\n\nc, d", "<|ENDOFTEXT|> <|endoftext", "", "<|endoftext|>" + " Words, here." * 9000]
    plain = _plain(name)
    want = [plain(x) for x in texts]
    assert len(want[0]) == {"word_bpe_49k.json": 4, "byte_bpe_50k.json": 5}[name]
    enc = tokens.Encoder(tokens.vocabulary(name))
    assert _encoded(enc, texts) == want and _encoded(enc, texts[::-1]) == want[::-1]


def test_image_round_trip_and_select():
    draw = np.random.default_rng(0)
    for sizes in ([], [0], [0, 0, 5], [1] * 1000, draw.integers(0, 3000, 700).tolist(), [100_000, 1, 1]):
        docs = [draw.integers(0, 49408, n).astype("<u2").tobytes() for n in sizes]
        names = [None if i == 0 else x for i, x in enumerate(sorted(draw.integers(-(1 << 40), 1 << 40, len(docs)).tolist()))]
        data = token_files.write_image(names, docs)
        image = token_files.Image(data)
        assert [image.doc_id(k) for k in range(image.n)] == names
        assert [image.start(k) for k in range(len(docs) + 1)] == np.cumsum([0, *sizes]).tolist()
        assert all(image.document(k).tobytes() == docs[k] for k in range(len(docs)))
        bounds = image.bounds
        assert len(bounds.words) * 64 + 8 * len(bounds.low_bits) <= (len(docs) + 1) * (3 + max(1, sum(sizes) // (len(docs) + 1)).bit_length()) + 64
    dense = token_files.write_image(list(range(5000)), [b"\1\0" * 300] * 5000)
    assert len(dense) - 2 * 300 * 5000 < 5000 * 2  # under two bytes a document beside its ids
    extremes = [None, -(1 << 63), 0, (1 << 63) - 1]
    image = token_files.Image(token_files.write_image(extremes, [b""] * 4))
    assert [image.doc_id(k) for k in range(4)] == extremes


def test_files_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 40)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, None, "y"), (3, "b", "y"), (None, "lost", "z"), (None, "found again", "z"), (7, "again", "z"), (7, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    files = token_files.write_files(docs, "word_bpe_49k.json")
    got = token_files.read_files(files).collect()
    plain = _plain("word_bpe_49k.json")
    named = [(i, np.array([*plain(t or ""), 2], "<u2")) for i, t, _ in rows]
    want, start = [], 0
    for i, ids in sorted(named, key=lambda r: (r[0] is not None, r[0] or 0, r[1].tobytes())):
        want.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_files(token_files.write_files(docs, "word_bpe_49k.json")).count() == 0
