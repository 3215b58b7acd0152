"""Count models of the next token, integer frequency tables, and scores.

A model is a relation (ctx, token, n). Frequencies are integers made from counts alone, so every engine
and both ends of a codec agree bit for bit: with K tokens and total T,
``f = 1 + (T - K) * n div n(ctx)``, and the remainder goes one each to the most frequent tokens.
Only tokens that were seen are kept; an unseen one has frequency 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.session import small

TOTAL = 1 << 18


def counts(rows: DataFrame) -> DataFrame:
    """(ctx, token, n) from (ctx, token) occurrences; summed before the shuffle."""
    return rows.groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("n"))


def probabilities(model: DataFrame) -> DataFrame:
    """The model with ``p``, the share of the context's count."""
    return model.withColumn("p", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("ctx"))))


def masked(model: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Probabilities over the tokens of a vocabulary only, renormalised."""
    return probabilities(model.join(small(vocabulary.select("token"), "mask"), "token", "left_semi"))


def softmax(score: Column, *keys: str) -> Column:
    """exp(score) over its sum in each group, from the greatest score down."""
    w = Window.partitionBy(*keys)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def log_softmax(score: Column, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    top = F.max(score).over(w)
    return score - top - F.ln(F.sum(F.exp(score - top)).over(w))


def anti(model: DataFrame) -> DataFrame:
    """The model with ``q``: the distribution whose scores are the negated log-probabilities."""
    p = probabilities(model)
    inverse = 1 / F.col("p")
    return p.withColumn("q", inverse / F.sum(inverse).over(Window.partitionBy("ctx")))


def most_likely(model: DataFrame) -> DataFrame:
    """(ctx, token, n) of each context's most frequent token, ties to the first in order."""
    return model.groupBy("ctx").agg(F.min_by("token", F.struct((-F.col("n")).alias("n"), F.col("token"))).alias("token"), F.max("n").alias("n"))


def least_likely(model: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(ctx, token, n) of the least frequent token among the candidates, ties to the first in order."""
    rows = model if candidates is None else model.join(small(candidates.select("token"), "candidates"), "token", "left_semi")
    return rows.groupBy("ctx").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.min("n").alias("n"))


def ranks(model: DataFrame) -> DataFrame:
    """The model with ``rank`` (tokens that are more frequent) and ``order`` (ties by token)."""
    by = Window.partitionBy("ctx").orderBy(F.desc("n"))
    return model.withColumn("rank", F.rank().over(by) - 1).withColumn("order", F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("n"), "token")) - 1)


def context_length(seen: Column, most: int, kept: int) -> Column:
    """How many tokens the model sees after ``seen``: at ``most`` the last ``kept`` stay, then it grows again."""
    return F.when(seen < most, seen).otherwise(kept + (seen - most) % (most - kept))


def frequencies(model: DataFrame, size: int, total: int = TOTAL) -> DataFrame:
    """(ctx, token, n, freq) with all frequencies at least 1 and, with unseen tokens, of sum ``total``."""
    if not 0 < size <= total:
        raise ValueError("a frequency table needs at least as many units as tokens")
    ctx = Window.partitionBy("ctx")
    base = model.withColumn("base", F.expr(f"1 + ({total - size}L * n) div sum(n) over (partition by ctx)"))
    left = F.lit(total) - (F.sum("base").over(ctx) + size - F.count(F.lit(1)).over(ctx))
    order = F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("n"), "token"))
    ranked = base.withColumn("_left", left).withColumn("_order", order)
    return ranked.select("ctx", "token", "n", (F.col("base") + (F.col("_order") <= F.col("_left")).cast("bigint")).alias("freq"))


def frequencies_checked(model: DataFrame, size: int, total: int = TOTAL) -> DataFrame:
    """``frequencies``, where what rounding left over in each context is asserted to be from 0 to less than ``size``."""
    freqs = frequencies(model, size, total)
    ctx = Window.partitionBy("ctx")
    base = F.expr(f"1 + ({total - size}L * n) div sum(n) over (partition by ctx)")
    checked = freqs.withColumn("_base", base)
    checked = checked.withColumn("_left", F.lit(total) - (F.sum("_base").over(ctx) + size - F.count(F.lit(1)).over(ctx)))
    fine = (F.col("_left") >= 0) & (F.col("_left") < size) & (F.col("freq") >= 1)
    return checked.select("ctx", "token", "n", F.when(fine, F.col("freq")).otherwise(F.raise_error(F.lit("frequencies that do not sum to their total")).cast("bigint")).alias("freq"))


def intervals(freqs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Frequencies with (dense_id, cum_lo, cum_hi): unseen tokens before one take a unit each."""
    ids = freqs.join(small(vocabulary.select("token", "dense_id"), "vocabulary"), "token")
    w = Window.partitionBy("ctx").orderBy("dense_id").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.col("dense_id") + F.coalesce(F.sum(F.col("freq") - 1).over(w), F.lit(0))
    return ids.withColumn("cum_lo", lo.cast("bigint")).withColumn("cum_hi", F.col("cum_lo") + F.col("freq"))


def ideal_bits(freq: Column, total: int = TOTAL) -> Column:
    """The code length of one token."""
    return F.log2(F.lit(float(total))) - F.log2(freq.cast("double"))


def binary_frequencies(p1: Column, total: int = TOTAL) -> tuple[Column, Column]:
    """Frequencies of bits 0 and 1, both at least 1."""
    p = F.least(F.greatest(p1, F.lit(1e-12)), F.lit(1 - 1e-12))
    ones = F.least(F.greatest(F.floor(p * total), F.lit(1)), F.lit(total - 1)).cast("bigint")
    return F.lit(total).cast("bigint") - ones, ones
