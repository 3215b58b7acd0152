import hashlib
import random
import zlib

import numpy as np
import pytest

from sparkquill.llm import media


def test_png_round_trip_and_damage():
    draw = random.Random(1)
    for n in (64, 128, 64 * 33):
        payload = bytes(draw.randrange(256) for _ in range(n))
        png = media.write_png(payload)
        assert media.read_png(png).tobytes() == payload
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])
    assert len(media.feature_of(np.zeros((1, 64), np.uint8))) > 10


def test_interleaving_keeps_positions_and_captions():
    html = "<p>one<img src='media:aa' alt='a &amp; b'>two<p>three<figure><img src=media:bb><img src='media:cc' alt=x><figcaption>both</figcaption></figure><figure><figcaption>lost</figcaption></figure><img src='http://x/y.png'>four<img src=\"media:aa\">"
    got = [(x["pos"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in media.interleaved(html)]
    assert got == [(0, "text", "one", None), (1, "media", "aa", "a & b"), (2, "text", "two", None), (3, "text", "three", None), (4, "media", "bb", "both"), (5, "media", "cc", "both"), (6, "text", "lost", None), (7, "text", "four", None), (8, "media", "aa", "")]
    assert media.interleaved("<figure><figcaption>first</figcaption><img src='media:dd'></figure>")[0]["caption"] == "first"
    assert media.interleaved(None) == media.interleaved("") == []


def test_resolution_of_references(spark):
    pages = spark.createDataFrame([(1, "<p>t<img src='media:d1'>"), (2, "<img src='media:none'><img src='media:d1' alt='again'>"), (3, None)], "page_id long, html string")
    stored = spark.createDataFrame([("d1", media.write_png(b"x" * 64)), ("d1", media.write_png(b"x" * 64))], "digest string, media binary")
    got = media.resolve(media.sequences(pages, "page_id"), media.measured(stored), "page_id").collect()
    assert sorted((r.page_id, r.pos, r.caption, r.digest, r.payload_bytes) for r in got) == [(1, 1, "", "d1", 64), (2, 0, "", "none", None), (2, 1, "again", "d1", 64)]


def test_documents_against_brute_force(spark, monkeypatch):
    texts = ["", None, "a", "é" * 32, "x" * 64, "y" * 65, "long " * 30_000, "a", "\0 z", "one\n\n two  <b>&amp; &lt;\nthree 'q' \"", "\n\nlate", "a", "a", "<script>x</script>\n</article><img src='media:q'>"]
    docs = spark.createDataFrame([(None if i == 5 else i // 2 * 2, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string").repartition(3)
    want = []
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        png = media.write_png(payload)
        name = None if i == 5 else i // 2 * 2
        lines = [" ".join(x.replace("\0", "\ufffd").split()) for x in (t or "").split("\n")]
        pos = int(bool(lines[0]))
        lines = [x for x in lines if x]
        caption = f"Text of document {'without id' if name is None else name}"
        want.append((name, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), media.feature_of(media.read_png(png)), pos, caption, len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    from sparkquill.llm import tables

    for hot in (tables.HOT_ROWS, 2):
        monkeypatch.setattr(tables, "HOT_ROWS", hot)
        got = media.document_media(docs).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert media.document_media(docs.limit(0)).count() == 0
