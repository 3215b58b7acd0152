"""Media columns: documents as ordered text and media references, payloads resolved by digest.

HTML is read into a sequence of structs (position, kind, text, digest, caption): text between media in
page order, and one struct for each ``img`` whose source is ``media:<digest>``. A caption is the
``figcaption`` of the same figure, else the ``alt`` text. Payloads are kept once for each task and
digest as lossless 8-bit greyscale PNG, 64 samples wide; they are read back, checked and measured where
they lie, and only digests and measurements meet the references in a join, at the same position and
with the same caption.

Defined results: a null text is empty; an empty text has a payload of 64 zero bytes. Equal texts have
equal media. A reference without stored media keeps its position with null measurements. Pages without
media or text give an empty sequence. Repeated rows each have their sequence. Further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.dom import blocks
from sparkquill.llm.tables import join_hot
from sparkquill.session import stored

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SOURCE = re.compile(r"""(?:^|\s)src\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_ALT = re.compile(r"""(?:^|\s)alt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def payload_of(text: str | None) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, level: int = 4) -> bytes:
    """A greyscale image of 8-bit samples whose rows are the payload's 64-byte pieces."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row's first byte: no filter
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(media: bytes) -> np.ndarray:
    """The samples (height, 64) of an image that ``write_png`` made; checksums are verified."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, height = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if width != WIDTH or form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale of 64 samples a row")
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Size, mean and deviation of the samples, their 16-bin histogram, and an 8 x 8 average hash."""
    bins = np.bincount(samples.ravel() >> 4, minlength=16)
    total, squares = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
    height = samples.shape[0]
    edges = np.arange(9) * height // 8
    tiles = np.stack([samples[a : max(b, a + 1)].reshape(-1, 8, 8).mean((0, 2)) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    bits = int("".join("1" if x else "0" for x in (tiles > tiles.mean()).ravel()), 2)
    mean = total / samples.size
    return f"{WIDTH}x{height} mean={mean:.4f} sd={max(0.0, squares / samples.size - mean * mean) ** 0.5:.4f} hist={'.'.join(map(str, bins.tolist()))} ahash={bits:016x}"


def interleaved(html: str | None) -> list[dict]:
    """The page's structs: pos, kind ``text`` or ``media``, text, digest, caption."""
    media: list[tuple[str, str]] = []

    def mark(tag: str, raw: str) -> str | None:
        if tag == "img" and (m := _SOURCE.search(raw)):
            source = unescape(m[1] or m[2] or m[3] or "")
            if source.startswith("media:"):
                alt = _ALT.search(raw)
                media.append((source[6:], unescape((alt[1] or alt[2] or alt[3] or "") if alt else "")))
                return f"\0{len(media) - 1}\0"
        return None

    out: list[dict] = []
    captions: dict[int, list[str]] = {}
    for b in blocks((html or "").replace("\0", "\ufffd"), mark):
        figure = next((e for e in reversed(b.parents) if e.tag == "figure"), None)
        caption = figure is not None and any(e.tag == "figcaption" for e in b.parents)
        for k, piece in enumerate(b.text.split("\0")):
            if k % 2:
                digest, alt = media[int(piece)]
                out.append({"kind": "media", "text": None, "digest": digest, "caption": alt, "figure": figure})
                if figure is not None:
                    captions.setdefault(id(figure), [])
            elif piece.strip():
                out.append({"kind": "caption" if caption else "text", "text": piece.strip(), "digest": None, "caption": None, "figure": figure})
    # A figure's captions belong to its media, wherever they stand in it; without media they are text.
    for x in out:
        if x["kind"] == "caption":
            if id(x["figure"]) in captions:
                captions[id(x["figure"])].append(x["text"])
            else:
                x["kind"] = "text"
    for x in out:
        if x["kind"] == "media" and x["figure"] is not None and captions[id(x["figure"])]:
            x["caption"] = " ".join(captions[id(x["figure"])])
    out = [x for x in out if x["kind"] != "caption"]
    return [{"pos": k, **{c: x[c] for c in ("kind", "text", "digest", "caption")}} for k, x in enumerate(out)]


SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, sequence) of each page row."""

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([interleaved(x) for x in batch.column(1).to_pylist()], _ARROW)], [key, "sequence"])

    return pages.select(key, html).mapInArrow(read, f"`{key}` {pages.schema[key].dataType.simpleString()}, sequence {SEQUENCE}")


_MEASURED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measured(media: DataFrame) -> DataFrame:
    """Stored media (digest, media) read back: one row of measurements for each digest."""

    def read(batches):
        for batch in batches:
            rows = []
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples = read_png(data)
                payload = samples.tobytes()
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples)))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "media").mapInArrow(read, _MEASURED).dropDuplicates(["digest"])


def resolve(sequenced: DataFrame, measurements: DataFrame, key: str) -> DataFrame:
    """Each media reference with its position, caption and the measurements of its payload."""
    refs = sequenced.select(key, F.explode(F.filter("sequence", lambda x: x["kind"] == "media")).alias("ref"))
    return refs.select(key, "ref.pos", "ref.caption", "ref.digest").join(measurements, "digest", "left")


def _illustrated(doc_id: int | None, text: str | None, digest: str) -> str:
    """A document as a page: its lines as paragraphs, its own payload as a figure after the first."""
    name = escape("without id" if doc_id is None else str(doc_id))
    figure = f'<figure><img src="media:{digest}" alt="payload"><figcaption>Text of document {name}</figcaption></figure>'
    lines = [f"<p>{escape(x)}</p>" for x in (text or "").split("\n")]
    return "".join(("<article>", lines[0], figure, *lines[1:], "</article>"))


_REFERENCES = "array<struct<pos:int,digest:string,caption:string>>"


def document_sequences(documents: DataFrame) -> DataFrame:
    """Documents as pages that show their text beside it as a medium, read into sequences.

    (doc_id, n_bytes, digest, media, refs, n_texts, texts_sha256): the references of each sequence with their
    positions and captions, and how many texts it has with the digest of these, joined by line ends. ``media`` is
    null where the task has stored the same digest before.
    """

    def make(batches):
        seen: set[bytes] = set()
        refs_type = pa.list_(pa.struct([("pos", pa.int32()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload)
                new = digest.digest() not in seen
                seen.add(digest.digest())
                sequence = interleaved(_illustrated(doc_id, text, digest.hexdigest()))
                texts = [x["text"] for x in sequence if x["kind"] == "text"]
                refs = [{k: x[k] for k in ("pos", "digest", "caption")} for x in sequence if x["kind"] == "media"]
                sha = hashlib.sha256("\n".join(texts).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((doc_id, len((text or "").encode("utf-8", "surrogatepass")), digest.hexdigest(), write_png(payload) if new else None, refs, len(texts), sha))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), refs_type, pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "digest", "media", "refs", "n_texts", "texts_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, f"doc_id long, n_bytes long, digest string, media binary, refs {_REFERENCES}, n_texts long, texts_sha256 string")


def document_media(documents: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_bytes, the measurements of its stored payload, and where it stands among its texts."""
    pages = stored(document_sequences(documents), "media")
    facts = measured(pages.where(F.col("media").isNotNull()).select("digest", "media"))
    uses = pages.select(F.explode("refs.digest").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("uses"))
    facts = stored(facts.join(uses, "digest"), "media-measured")
    refs = pages.select("doc_id", "n_bytes", "n_texts", "texts_sha256", F.explode("refs").alias("ref")).select("doc_id", "n_bytes", "n_texts", "texts_sha256", "ref.pos", "ref.caption", "ref.digest")
    found = join_hot(refs, facts, "digest", "uses")  # every digest here is stored
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_texts", "texts_sha256")
