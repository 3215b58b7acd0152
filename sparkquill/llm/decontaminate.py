"""Benchmark decontamination with DataFrame operations only.

The benchmark's windows (``window`` consecutive normalised words; an item of fewer words is one
window) become a set of distinct n-grams, hashed by their longest word. The hash relation is
broadcast in slices, each below a checked size, so the documents are scanned in place: each word
is probed as the anchor of a window, and the window around it is verified word for word inside the
join. Only hits and one marker row for each document are shuffled.

Defined results: a null or wordless text has no words, hits or items. A benchmark row without words
has no windows; one with a null id still marks words as hit but is neither counted nor named.
Repeated benchmark rows count once. Repeated ``doc_id``s give a row for each document row. Further
columns of either table are ignored, or kept by ``remove_documents`` and ``remove_spans`` under any name. An
empty benchmark contaminates nothing; empty documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.session import small, stored, unused

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Estimated bytes of window table that one broadcast may hold; a larger table is broadcast in slices.
BROADCAST_BYTES = 64 << 20
#: What a row of the window table costs in a hash relation, beside its words.
ROW_BYTES = 300


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of the benchmark: (gram, n, items, anchor, back).

    ``anchor`` is the window's longest word (the likeliest to be rare; ties by hash) and ``back`` the
    number of words before it. The choice decides only how many candidates are verified.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    grams = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("gram"))
    grams = grams.groupBy("gram").agg(F.collect_set("item_id").alias("items"))
    longest = F.array_max(F.transform("gram", lambda x, i: F.struct(F.octet_length(x), F.xxhash64(x), i.alias("at"))))["at"]
    grams = grams.select("gram", F.size("gram").alias("n"), "items", longest.alias("back"))
    return grams.withColumn("anchor", F.get("gram", F.col("back")))


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, row: str | None = None) -> DataFrame:
    """Each document's words and hits: (_row, doc_id, n_words, spans, items), spans as sorted (start, length).

    ``row`` names a column of stored row keys, which ``_row`` then holds.
    """
    table = stored(windows(benchmark, window), "decontaminate-windows")
    size = table.agg(F.sum(F.lit(ROW_BYTES) + F.octet_length(F.array_join("gram", " ")) + 16 * F.size("items")).alias("bytes")).first()
    slices = -(-(size["bytes"] or 1) // broadcast_bytes)
    rows = documents.select((F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("_row"), "doc_id", words(F.col("text")).alias("w"))
    if slices > 1:
        rows = stored(rows, "decontaminate-words")  # split and numbered once for all slices
    seen = rows.select("_row", "doc_id", "w", F.posexplode_outer("w").alias("_at", "_word"))
    start = F.col("_at") - F.col("_back") + 1
    found = None
    for k in range(slices):
        part = table if slices == 1 else table.where(F.pmod(F.xxhash64("anchor"), F.lit(slices)) == k)
        part = F.broadcast(part.select(*(F.col(c).alias(f"_{c}") for c in part.columns)))
        hit = seen.join(part, (F.col("_word") == F.col("_anchor")) & (start >= 1) & (F.slice("w", F.greatest(start, F.lit(1)), F.col("_n")) == F.col("_gram")), "left")
        hit = hit.where(F.col("_anchor").isNotNull() | F.col("_at").isNull() | (F.col("_at") == 0))
        span = F.when(F.col("_anchor").isNotNull(), F.struct(start.alias("s"), F.col("_n").alias("n")))
        hit = hit.select("_row", "doc_id", F.size("w").cast("long").alias("n_words"), span.alias("_span"), "_items")
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("_row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("_span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("items"))


def covered(spans: Column) -> Column:
    """How many words sorted (start, length) spans cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, x: Column) -> Column:
        end = x["s"] + x["n"]
        new = F.greatest(F.lit(0), end - F.greatest(state["end"], x["s"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + new).alias("n"))

    return F.aggregate(spans, zero, step, lambda state: state["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and whether it is contaminated."""
    found = scan(documents, benchmark, window, broadcast_bytes)
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = covered(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The document rows that hold no window of the benchmark, with all their columns.

    Each row is judged by its own text: rows are told apart by a stored key, not by ``doc_id``.
    """
    row = unused(documents, "_decontaminate_row")
    keyed = stored(documents.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    bad = scan(keyed, benchmark, window, broadcast_bytes, row).where(F.size("spans") > 0).select(F.col("_row").alias(row))
    return keyed.join(small(bad, "decontaminate-bad"), row, "left_anti").drop(row)


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with every hit word, and the separators before it, cut out of the text.

    Texts without a hit stay as they are. Each row is cut by its own hits.
    """
    row, hits = unused(documents, "_decontaminate_row"), unused(documents, "_decontaminate_hits")
    keyed = stored(documents.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    spans = scan(keyed, benchmark, window, broadcast_bytes, row).where(F.size("spans") > 0).select(F.col("_row").alias(row), F.col("spans").alias(hits))
    out = keyed.join(small(spans, "decontaminate-spans"), row, "left")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?:[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|$)"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(hits, lambda x: (i + 1 >= x["s"]) & (i + 1 < x["s"] + x["n"])))
    text = F.when(F.col(hits).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return out.withColumn("text", text).select(*(F.col(f"`{c}`") for c in documents.columns))
