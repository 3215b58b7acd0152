"""Mining of experiment results: flattening, keys, best runs, grids, completeness, audits, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.session import small


def lifted(runs: DataFrame) -> DataFrame:
    """The fields of ``compression`` and its ``args`` beside the key; args win where both have a name."""
    outer, args = runs.schema["compression"].dataType, runs.schema["compression"].dataType["args"].dataType
    own = [F.col(f"compression.{n}").alias(n) for n in outer.names if n != "args" and n not in args.names]
    return runs.select("run_key", *own, *(F.col(f"compression.args.{n}").alias(n) for n in args.names))


def dataset_of(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"([^:/]+):", 1), F.lit(""))


def adapter_rank(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"/r(\d+)_", 1), F.lit("")).try_cast("int")


def adapter_kind(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("vera"), "vera").when(low.contains("lora"), "lora")


def best(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the least ``by`` of each key; ties to the smallest run key."""
    order = F.struct(F.col(by), F.col("run_key"))
    kept = rows.where(F.col(by).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return kept.select("r.*")


def short_model(name: Column) -> Column:
    return F.replace(F.replace(F.regexp_extract(name, r"([^/]*)$", 1), F.lit("-hf"), F.lit("")), F.lit("-instruct"), F.lit(""))


def family(key: Column, models: list[str]) -> Column:
    """The first listed model of the family that the key names."""
    low = F.lower(key)
    first = lambda part: F.lit(next((m for m in models if part in m.lower()), "Unknown"))
    return F.when(low.contains("qwen2.5"), first("qwen2.5")).when(low.contains("qwen3"), first("qwen3")).when(low.contains("gpt2"), "gpt2").when(low.contains("t5"), "t5").when(low.contains("mamba"), first("mamba")).otherwise("Unknown")


def where_equal(rows: DataFrame, **values) -> DataFrame:
    """Rows with the given values; names that are no column are ignored."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]) if kv[0] in df.columns else df, values.items(), rows)


def scaled(rows: DataFrame, x: str, low: float, high: float, name: str) -> DataFrame:
    """The rows with ``x`` scaled from its least and greatest value to a range, as ``name``."""
    ends = rows.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))  # one row
    place = low + (F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9) * (high - low)
    return rows.crossJoin(F.broadcast(ends)).withColumn(name, place).drop("_lo", "_hi")


def expected(rows: DataFrame, number: int) -> DataFrame:
    """The rows, if there are as many as expected."""
    n = rows.count()
    if n != number:
        raise ValueError(f"{n} rows where {number} are expected")
    return rows


def grid(rows: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).agg(F.avg(measure))


def missing_cells(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of occurring values that do not occur together."""
    every = rows.select(a).distinct().crossJoin(small(rows.select(b).distinct(), "columns"))
    return every.join(rows.select(a, b).distinct(), [a, b], "left_anti")


def audit(rows: DataFrame, datasets: list[str]) -> DataFrame:
    """What is wrong with measured rows: (dataset, codec, fault)."""
    faults = F.array_compact(F.array(
        F.when(~F.col("status").isin("measured", "preliminary", "missing"), F.lit("status")),
        F.when((F.col("status") == "measured") & ~F.coalesce("round_trip", F.lit(False)), F.lit("round trip")),
        F.when(~F.col("dataset").isin(datasets), F.lit("dataset")),
        F.when(F.col("copies") > 1, F.lit("repeated")),
    ))
    counted = rows.groupBy("dataset", "codec", "status", "round_trip").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("copies", F.sum("n").over(Window.partitionBy("dataset", "codec")))
    return counted.select("dataset", "codec", F.explode(faults).alias("fault")).distinct()


def spread_of(rows: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Count, mean and sample deviation (0 for one row) by key."""
    return rows.groupBy(*keys).agg(F.count(measure).alias("n"), F.avg(measure).alias("mean"), F.coalesce(F.stddev_samp(measure), F.lit(0.0)).alias("sd"))


def in_order(name: Column, order: list[str]) -> Column:
    """Place in a listed order, unlisted names last."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), name)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def interval_counts(rows: DataFrame, key: str, x: str, intervals: list[tuple[float, float]]) -> DataFrame:
    """(key, place, n, share): values by the first interval [lo, hi) that holds them."""
    place = reduce(lambda c, i: c.when((F.col(x) >= intervals[i][0]) & (F.col(x) < intervals[i][1]), i), range(1, len(intervals)), F.when((F.col(x) >= intervals[0][0]) & (F.col(x) < intervals[0][1]), 0))
    counted = rows.select(key, place.alias("place")).where("place is not null").groupBy(key, "place").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy(key))))


def equal_bins(rows: DataFrame, x: str, bins: int) -> DataFrame:
    """(bin, n): equal widths from the least to the greatest value, which belongs to the last."""
    ends = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return rows.join(F.broadcast(ends)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def label(x: Column, base: int, units: list[str]) -> Column:
    """Three digits or so and a unit; ties are rounded to even."""
    step = reduce(lambda c, k: c.when(x < float(base) ** (k + 1), k), range(1, len(units) - 1), F.when(x < base, 0)).otherwise(len(units) - 1)
    small = x / F.pow(F.lit(float(base)), step)
    rounded = F.when(small < 10, F.bround(small, 2)).when(small < 100, F.bround(small, 1)).otherwise(F.bround(small, 0))
    return F.concat(F.regexp_replace(F.format_string("%.2f", rounded), r"\.?0+$", ""), F.element_at(F.array(*(F.lit(u) for u in units)), step + 1))


def per_parameter(rows: DataFrame, factor: str, params: str) -> DataFrame:
    """The rows with their factor by model parameter."""
    return rows.withColumn("per_parameter", F.col(factor) / (F.col(params) + 1e-9))


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))


def five_numbers(x: str) -> Column:
    """The 5, 25, 50, 75 and 95 per cent points."""
    return F.percentile(x, F.array(*(F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95))))


def rejected(docs: DataFrame, patterns: list[str], most_bytes: int) -> DataFrame:
    """(n_rejected, n_bytes, allowed): a packaging gate by patterns and total size."""
    bad = reduce(lambda a, b: a | b, (F.col("text").rlike(p) for p in patterns))
    out = docs.agg(F.sum(bad.cast("bigint")).alias("n_rejected"), F.sum(F.octet_length("text")).alias("n_bytes"))
    return out.withColumn("allowed", (F.col("n_rejected") == 0) & (F.col("n_bytes") < most_bytes))
