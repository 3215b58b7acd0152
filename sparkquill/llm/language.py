"""Language of web pages by fusing evidence.

The posterior of a page's language multiplies four kinds of evidence:

* text: naive Bayes over hashed character trigrams of the page's own text, learned from labelled
  documents. Trigrams of one text are no independent evidence, so n of them weigh as
  ``TEXT_SCALE * log(1 + n / TEXT_SCALE)`` of their mean;
* the language that the markup declares, and the one that the address names (path segment or country
  suffix): likelihoods from confusion counts of all pages against their text posteriors;
* the host: a prior from grouped sums of text posteriors, smoothed towards that of the host's domain,
  which is smoothed towards that of the whole corpus.

All counts are grouped sums over every page, so a hot host is summed before it is shuffled; priors of hosts
with many pages are broadcast, others meet their pages in a shuffle.

The text model is fitted on the documents of at most ``TRAIN_ROWS`` pairs of id and language, those with the
smallest hash of the id. Only these pairs are sorted; texts are counted where they lie. Every language among
them is told apart, so the model's size is bounded by ``TRAIN_ROWS`` languages.

Defined results: null and empty pages are judged by the other evidence; a page without any has the
corpus prior. Without labelled documents the language is null. A null url is the host ``""``. Repeated
rows each have a result. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.dom import blocks
from sparkquill.llm.site_style import _host, kept
from sparkquill.llm.tables import join_hot
from sparkquill.session import stored

TRAIN_ROWS, BUCKETS, GRAM = 4_000, 1 << 15, 3
TEXT_SCALE, SMOOTH_HOST, SMOOTH_DOMAIN, SMOOTH_LIKELIHOOD = 40.0, 5.0, 20.0, 2.0
_HTML_LANG = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]+)", re.IGNORECASE)
_META_LANG = re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([a-zA-Z]+)", re.IGNORECASE)


def trigrams(text: str) -> np.ndarray:
    """Buckets of all character trigrams of the lower-cased words, each between spaces."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(data) < GRAM:
        return np.empty(0, np.int64)
    h = sum(data[i : len(data) - GRAM + 1 + i] * np.uint64(m) for i, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


def fit(documents: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, the most frequent first, and their log-probabilities by bucket."""
    labelled = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = labelled.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).orderBy(F.xxhash64("_id"), "_id", "_lang").limit(rows)
    chosen = stored(chosen.distinct(), "language-sample")
    found = labelled.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")))  # `rows` small rows at most

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                got = np.append(np.bincount(trigrams(text), minlength=BUCKETS), 1)  # the last one counts documents
                total[lang] = total[lang] + got if lang in total else got
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    counts = found.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # the sample's languages x BUCKETS numbers at most
    table: dict[str, np.ndarray] = {}
    for lang, bucket, n in zip(*(counts.column(i).to_pylist() for i in range(3)), strict=True):
        table.setdefault(lang, np.zeros(BUCKETS + 1))[bucket] = n
    names = sorted(table, key=lambda x: (-table[x][BUCKETS], x))
    logs = [np.log((table[x][:BUCKETS] + 0.5) / (table[x][:BUCKETS].sum() + 0.5 * BUCKETS)).astype(np.float32) for x in names]
    return names, np.array(logs, np.float32).reshape(len(names), BUCKETS)


def weight(n: int) -> float:
    """What n trigrams of one text weigh."""
    return TEXT_SCALE * float(np.log1p(n / TEXT_SCALE))


def _log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(1e-12)))


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Per page row: page_id, url, declared, address, text_lang, lang and its probability."""
    names, table = fit(documents)
    if not names:
        nothing = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", nothing.alias("declared"), nothing.alias("address"), nothing.alias("text_lang"), nothing.alias("lang"), F.lit(None).cast("double").alias("probability"))
    size = len(names)
    flat = np.zeros(size)

    def read(batches):
        known = set(names)
        for batch in batches:
            scores, declared = [], []
            for html in batch.column("html").to_pylist():
                html = html or ""
                m = _HTML_LANG.search(html) or _META_LANG.search(html)
                said = m[1].lower() if m else None
                declared.append(said if said in known else "other" if said else None)
                at = trigrams(" ".join(kept(blocks(html), frozenset())))
                scores.append((table[:, at].mean(1, dtype=np.float64) * weight(len(at)) if len(at) else flat).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(declared, pa.string()), pa.array(scores, pa.list_(pa.float64()))], ["page_id", "url", "host", "declared", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _host(F.col("url")).alias("host"), "html").mapInArrow(read, "page_id long, url string, host string, declared string, text array<double>")
    listed = "|".join(re.escape(x.lower()) for x in names)
    address = F.coalesce(
        F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), rf"(?i)//[^/]*/(?:[^?#]*/)?({listed})(?:[/?#]|$)", 1)), F.lit("")),
        F.nullif(F.regexp_extract("host", rf"\.({listed})$", 1), F.lit("")),
    )
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    top = F.array_max("text")
    posterior = F.transform("text", lambda x: F.exp(x - top))
    rows = rows.withColumn("address", address).withColumn("domain", F.when(domain == "", F.col("host")).otherwise(domain)).withColumn("_p", posterior)
    rows = stored(rows.withColumn("_p", F.transform("_p", lambda x: x / F.aggregate("_p", F.lit(0.0), lambda a, b: a + b))), "language")

    def sums(*keys: str) -> DataFrame:
        total = F.array(*(F.sum(F.get("_p", F.lit(i))) for i in range(size)))
        return rows.groupBy(*keys).agg(total.alias("n"), F.count(F.lit(1)).alias("rows"))

    everything = rows.agg(*(F.sum(F.get("_p", F.lit(i))).alias(f"n{i}") for i in range(size)), F.count(F.lit(1)).alias("rows")).first()
    world = [((everything[i] or 0.0) + 1.0) / (everything["rows"] + size) for i in range(size)]
    world = F.array(*(F.lit(float(x)) for x in world))

    def smooth(n: Column, rows_: Column, base: Column, k: float) -> Column:
        return F.transform(n, lambda x, i: (x + k * F.get(base, i)) / (rows_ + k))

    domains = sums("domain").select("domain", smooth(F.col("n"), F.col("rows"), world, SMOOTH_DOMAIN).alias("_domain"))
    hosts = sums("host", "domain").join(domains, "domain").select("host", "rows", smooth(F.col("n"), F.col("rows"), F.col("_domain"), SMOOTH_HOST).alias("prior"))

    def likelihood(key: str) -> Column:
        """log P(value | language) for the row's value, by confusion with the text's posterior."""
        got = sums(key).where(F.col(key).isNotNull()).collect()  # a value for each language and "other"
        total = [sum(r["n"][i] for r in got) + SMOOTH_LIKELIHOOD * (size + 1) for i in range(size)]
        out = F.when(F.col(key).isNull(), F.array(*(F.lit(0.0) for _ in range(size))))
        return reduce(lambda c, r: c.when(F.col(key) == r[key], F.array(*(F.lit(float(np.log((r["n"][i] + SMOOTH_LIKELIHOOD) / total[i]))) for i in range(size)))), got, out)

    judged = join_hot(rows.withColumn("_declared", likelihood("declared")).withColumn("_address", likelihood("address")), stored(hosts, "language-hosts"), "host", "rows")
    score = F.transform("text", lambda x, i: x + F.get("_declared", i) + F.get("_address", i) + _log(F.get("prior", i)))
    judged = judged.withColumn("_s", score)
    best = F.array_max("_s")
    named = F.array(*(F.lit(x) for x in names))
    of = lambda scores, most: F.get(named, (F.array_position(scores, most) - 1).cast("int"))
    probability = 1 / F.aggregate(F.transform("_s", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, b: a + b)
    text_lang = F.when(F.array_max("text") < 0, of(F.col("text"), F.array_max("text")))
    return judged.select("page_id", "url", "declared", "address", text_lang.alias("text_lang"), of(F.col("_s"), best).alias("lang"), probability.alias("probability"))
