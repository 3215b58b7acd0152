"""Personal data: exact base patterns, and a character-level BiLSTM-CRF for what they miss.

The base patterns find emails, IP addresses, card and phone numbers in linear time. The tagger (see
``char_tagger``; trained in numpy from labelled spans) reads windows that overlap by half. Scores of a
character are averaged over its windows, weighted towards their middles, and each run of touching
windows is decoded as one sequence, so no span is cut at a window's edge (a run over ``RUN`` characters in
pieces that overlap by far more than a span). A span must hold an ``@``, a spelled-out ``(at)`` or
``LEAST_DIGITS`` digits. Windows near none of these signs are not run: a run holds the windows of a sign and
of their neighbours, so that what is around a sign is scored by all its windows, and the spans are those
that running all windows gives.

Base spans stay; the tagger adds spans that touch none of them and whose mean probability is high.
Positions are code points, ends exclusive.

Defined results: null and empty texts have no spans. Repeated rows each have theirs. An empty table
gives no rows. Further columns are ignored (``mask`` keeps them).
"""

from __future__ import annotations

import hashlib
import inspect
import re

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm import char_tagger
from sparkquill.llm.char_tagger import KINDS, TAGS, WINDOW, Tagger, codes, invented_tagger, luhn
from sparkquill.llm.tables import map_columns
from sparkquill.session import scratch_root

LEAST_DIGITS = 7
#: Least mean probability of an added span.
CONFIDENCE = 0.8
#: Windows whose scores are held together, but for one piece more.
AT_ONCE = 8192
#: Runs of windows are decoded in pieces of so many characters, with so many more around them. A span belongs to the
#: piece in which it begins.
RUN, MARGIN = 1 << 15, 512

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]|[\[(]at[\])]", re.IGNORECASE)
_SPELLED = re.compile(r"@|[\[(]at[\])]", re.IGNORECASE)


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of local part, @ and dotted domain; each @ is looked at once."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of the base patterns, by kind and start."""
    if not _SIGN.search(text):
        return []
    found = [("email", *x) for x in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def _windows(text: str) -> list[tuple[int, int]]:
    """Runs of touching windows that hold a sign, as (start, end) multiples of half a window."""
    half, runs = WINDOW // 2, []
    for m in _SIGN.finditer(text):
        a = max(0, m.start() // half - 2) * half
        b = (m.start() // half + 3) * half
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], b))
        else:
            runs.append((a, b))
    return runs


def _pieces(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, from, to): stretches of runs to decode, and where the spans that count begin."""
    out = []
    for a, b in _windows(text):
        for first in range(a, b, RUN):
            last = min(first + RUN, b)
            out.append((max(a, first - MARGIN), min(b, last + MARGIN), first, last))
    return out


def _tagged(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The tagger's own spans of each text."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    half, held, number = WINDOW // 2, [], 0
    for k, text in enumerate(texts):
        for piece in _pieces(text):
            held.append((k, *piece))
            number += (piece[1] - piece[0]) // half - 1
            if number >= AT_ONCE:
                _decode(model, texts, held, found)
                held, number = [], 0
    _decode(model, texts, held, found)
    return [sorted(x, key=lambda s: s[1]) for x in found]


def _decode(model: Tagger, texts: list[str], held: list[tuple[int, int, int, int, int]], found: list[list]) -> None:
    """Add the spans of pieces (text, start, end, from, to) to those of their texts."""
    if not held:
        return
    half = WINDOW // 2
    weight = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)
    windows, regions = [], []
    for k, a, b, first, last in held:
        c = codes(texts[k][a:b])
        c = np.pad(c, (0, b - a - len(c)))
        n = (b - a) // half - 1
        regions.append((k, a, min(b, len(texts[k])), first, last, len(windows), n))
        windows.extend(c[w * half : w * half + WINDOW] for w in range(n))
    scores = np.concatenate([model.emissions(np.stack(windows[i : i + 512])) for i in range(0, len(windows), 512)])
    regions.sort(key=lambda r: r[6])
    at_once = 0
    while at_once < len(regions):
        # Regions of about one length are decoded together.
        part = [r for r in regions[at_once : at_once + 64] if r[6] <= 2 * regions[at_once][6] + 8]
        at_once += len(part)
        steps = (part[-1][6] + 1) * half
        e, total = np.zeros((len(part), steps, TAGS), np.float32), np.zeros((len(part), steps, 1), np.float32)
        for row, (*_, begin, n) in enumerate(part):
            for w in range(n):
                e[row, w * half : w * half + WINDOW] += scores[begin + w] * weight[:, None]
                total[row, w * half : w * half + WINDOW] += weight[:, None]
        e /= np.maximum(total, 1e-6)
        lengths = np.array([b - a for _, a, b, *_ in part])
        tags, p = model.viterbi(e, lengths), model.marginals(e, lengths)
        for row, (k, a, b, first, last, _, _) in enumerate(part):
            t = tags[row]
            for at in np.flatnonzero(t[: b - a] % 2).tolist():
                if not first <= a + at < last:
                    continue
                end = at + 1
                while end < b - a and t[end] == t[at] + 1:
                    end += 1
                piece = texts[k][a + at : a + end]
                own = p[row, np.arange(at, end), t[at:end]].mean()
                if own >= CONFIDENCE and (_SPELLED.search(piece) or sum(x.isdigit() for x in piece) >= LEAST_DIGITS):
                    found[k].append((KINDS[(t[at] - 1) // 2], a + at, a + end))


def find(texts: list[str | None], model: Tagger) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, both by kind and start."""
    texts = [x or "" for x in texts]
    out = []
    for text, tagged in zip(texts, _tagged(model, texts), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        added = [s for s in tagged if all(s[2] <= a or s[1] >= b for a, b in taken)] if taken else tagged
        out.append((base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def tagger(spark: SparkSession) -> Tagger:
    """The shipped tagger: its parameters are stored in the shared folder, and trained where they are not there yet."""
    code = inspect.getsource(char_tagger)
    path = f"{scratch_root(spark)}/tagger-{hashlib.sha256(code.encode()).hexdigest()[:16]}"
    try:
        rows = spark.read.parquet(path).collect()  # one row for each array of the model
    except AnalysisException:
        rows = []
    if rows:
        return Tagger({r["name"]: np.frombuffer(r["data"], "<f4").reshape(r["shape"]) for r in rows})
    model = invented_tagger()
    table = [(k, list(v.shape), bytearray(v.astype("<f4").tobytes())) for k, v in model.p.items()]
    spark.createDataFrame(table, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)
    return model


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(documents: DataFrame, model: Tagger | None = None) -> DataFrame:
    """Per document row: doc_id, counts of base spans by kind, base_sha256 and all spans."""
    model = model or tagger(documents.sparkSession)

    def spans(batches):
        for batch in batches:
            got = find(batch.column("text").to_pylist(), model)
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in got], pa.int64()) for kind in KINDS]
            sha = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, pa.array([_joined(x) for _, x in got], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(spans, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each run of overlapping spans replaced by the kind of its first, as ``[EMAIL]``."""
    out, free = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= free:
            out += [text[free:a], f"[{kind.upper()}]"]
        free = max(free, b)
    return "".join(out) + text[free:] if out else text


def mask(documents: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The documents with personal data replaced by its kind; ``n_chars``, if there, is counted anew."""
    model = model or tagger(documents.sparkSession)
    at = documents.columns.index("text")

    def masks(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [masked(x, spans) for x, (_, spans) in zip(texts, find(texts, model), strict=True)]
            yield batch.set_column(at, f"c{at}", pa.array(new, batch.schema.field(at).type))

    out = map_columns(documents, masks, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
