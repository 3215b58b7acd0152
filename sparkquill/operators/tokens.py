"""Token relations: text to tokens, layout in lanes, vocabularies, and back to text.

A token relation is long: (key, pos, token). Tokens of one document come from one array expression, so
nothing is shuffled to number them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.session import small, stored

#: Tokens of a block.
BLOCK = 4096


def characters(text: Column) -> Column:
    """The characters of a text, in order."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def word_array(text: Column) -> Column:
    """The words between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def byte_array(text: Column) -> Column:
    """UTF-8 bytes as numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("..") , F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def tokens(docs: DataFrame, array: Column, *keys: str) -> DataFrame:
    """(keys, pos, token) of an array of tokens."""
    return docs.select(*keys, F.posexplode(array).alias("pos", "token"))


def character_blocks(docs: DataFrame, text: Column, *keys: str, size: int = BLOCK) -> DataFrame:
    """(keys, block, tokens): the characters of a text in order, ``size`` to a row, for work that needs no row a token."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return docs.select(*keys, F.posexplode(cut).alias("block", "_piece")).select(*keys, "block", characters(F.col("_piece")).alias("tokens"))


def with_context(docs: DataFrame, array: Column, *keys: str, order: int = 1) -> DataFrame:
    """(keys, pos, ctx, token): the ``order`` tokens before each, joined; positions before the first give ''."""
    rows = docs.select(*keys, array.alias("_all")).select(*keys, "_all", F.posexplode("_all").alias("pos", "token"))
    before = [F.when(F.col("pos") >= k, F.get("_all", F.col("pos") - k)).otherwise("") for k in range(order, 0, -1)]
    return rows.select(*keys, "pos", F.concat(*before).alias("ctx"), "token")


def pair_key() -> Column:
    """One number for a character ``token`` and the character before it, ``ctx`` (or none): no two pairs share it.

    A join by a number probes an array of longs instead of rows of strings.
    """
    before = F.when(F.col("ctx") == "", F.lit(0)).otherwise(F.ascii("ctx") + 1)
    return before.cast("long") * (1 << 21) + F.ascii("token")


def scored(rows: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """Rows with (ctx, token) of single characters and the facts of their pair, which are broadcast if they are small."""
    there = facts.select(pair_key().alias("_pair"), *(c for c in facts.columns if c not in ("ctx", "token")))
    return rows.withColumn("_pair", pair_key()).join(small(there, name), "_pair").drop("_pair")


def limited(rows: DataFrame, n: int) -> DataFrame:
    """The first n tokens of each stream."""
    return rows.where(F.col("pos") < n)


def lanes(pos: Column, total: Column, number: int) -> tuple[Column, Column]:
    """Lane and position in it: contiguous lanes, the first ``total % number`` hold one token more."""
    q, r = F.floor(total / number), total % number
    cut = r * (q + 1)
    late = F.floor(F.try_divide(pos - cut, q))
    lane = F.when(pos < cut, F.floor(pos / (q + 1))).otherwise(r + late)
    at = F.when(pos < cut, pos % (q + 1)).otherwise(pos - cut - late * q)
    return lane.cast("int"), at.cast("bigint")


def lane_length(lane: Column, total: Column, number: int) -> Column:
    """How many tokens a lane holds, from the totals alone."""
    return (F.floor(total / number) + (lane < total % number).cast("bigint")).cast("bigint")


def numbered(rows: DataFrame, *order: str | Column, name: str = "id") -> DataFrame:
    """Rows with their place in a total order, from 0, without bringing them together.

    They are dealt into ranges and numbered there; each range then starts after those before it.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(small(before, "numbered-ranges"), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def vocabulary(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, dense_id): the distinct tokens in order, numbered from 0."""
    ids = numbered(rows.select(*keys, "token").distinct(), *keys, "token")
    if keys:
        ids = ids.join(ids.groupBy(*keys).agg(F.min("id").alias("_first")), list(keys)).withColumn("id", F.col("id") - F.col("_first"))
    return ids.select(*keys, "token", F.col("id").cast("int").alias("dense_id"))


def by_frequency(rows: DataFrame) -> DataFrame:
    """(token, n, id): numbered from the most frequent, ties by first occurrence."""
    # Numbers alone are summed by hash; the pair that tells the first occurrence is made of few rows.
    each = rows.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    counted = each.groupBy("token").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return numbered(counted, F.desc("n"), F.col("first")).select("token", "n", F.col("id").cast("int").alias("id"))


def bitmap(ids: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, bitmap): a fixed-width bitmap of the ids in each bucket of 32,768."""
    rows = ids.select(*keys, F.bitmap_bucket_number(F.col("id").cast("bigint")).alias("bucket"), F.bitmap_bit_position(F.col("id").cast("bigint")).alias("bit"))
    return rows.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def bitmap_ids(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """The ids of bitmaps, undoing ``bitmap``."""
    spots = bitmaps.select(*keys, "bucket", F.posexplode(F.regexp_extract_all(F.hex("bitmap"), F.lit(".."), F.lit(0))).alias("byte", "value")).where(F.col("value") != "00")
    bits = spots.select(*keys, "bucket", "byte", F.conv("value", 16, 10).cast("int").alias("value"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    bits = bits.where(F.getbit("value", F.col("bit")) == 1)
    return bits.select(*keys, F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + F.col("byte") * 8 + F.col("bit") + 1).otherwise(0).cast("bigint").alias("id"))


def normalised_candidates(ids: Column, size: int) -> Column:
    """Sorted, distinct, all in 0..size-1, not empty; anything else is an error."""
    clean = F.array_sort(F.array_distinct(ids))
    ok = (F.size(clean) > 0) & (F.get(clean, F.lit(0)) >= 0) & (F.element_at(clean, -1) < size)
    return F.when(ok, clean).otherwise(F.raise_error(F.lit("candidates must be some ids of the vocabulary")))


def padded(ids: Column, width: Column, pad: int = 0) -> tuple[Column, Column]:
    """Ids padded on the left to a width, and the attention mask."""
    gap = F.greatest(width - F.size(ids), F.lit(0))
    return F.concat(F.array_repeat(F.lit(pad), gap), ids), F.concat(F.array_repeat(F.lit(0), gap), F.array_repeat(F.lit(1), F.size(ids)))


def decoded(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): the tokens joined in order."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["token"]), "").alias("text"))


def decoded_blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): the tokens of blocks joined where they lie, then the blocks in order: what is shuffled is text."""
    joined = rows.select(*keys, "block", F.array_join("tokens", "").alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("block", "text")))
    return joined.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("text"))


def matched_prefix(rows: DataFrame, budget: int, *keys: str, least: float = 0.9) -> DataFrame:
    """(keys, n_tokens, n_bytes): the longest prefix of at most ``budget`` bytes, if it fills ``least`` of it."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("_bytes", F.sum(F.octet_length("token")).over(w)).where(F.col("_bytes") <= budget)
    out = sums.groupBy(*keys).agg((F.max("pos") + 1).cast("bigint").alias("n_tokens"), F.max("_bytes").cast("bigint").alias("n_bytes"))
    return out.where(F.col("n_bytes") >= least * budget)
