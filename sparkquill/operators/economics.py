"""What compression costs and saves. Prices are parameters; times are seconds, sizes bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORAGE = 12 * 20 / 1e12  # dollars a byte and year
GPU_HOUR, CPU_HOUR = 0.6, 0.1 / 14
RAW = 100_000_000


def run_cost(seconds: Column, price_per_hour: Column) -> Column:
    return seconds / 3600 * price_per_hour


def compression_cost(speed: Column, gpu: Column, raw: float = RAW) -> Column:
    """Dollars to compress ``raw`` bytes at a speed; none at speed 0."""
    return F.when(speed > 0, F.try_divide(F.lit(float(raw)), speed) / 3600 * F.when(gpu, GPU_HOUR).otherwise(CPU_HOUR)).otherwise(0.0)


def payoff_days(size: Column, speed: Column, gpu: Column, raw: float = RAW) -> Column:
    """Days until the storage saved has paid for the compression."""
    return F.when(speed > 0, F.try_divide(compression_cost(speed, gpu, raw), STORAGE * (raw - size)) * 365).otherwise(0.0)


def cost_over_time(days: Column, size: Column, speed: Column, gpu: Column, raw: float = RAW) -> Column:
    return compression_cost(speed, gpu, raw) + STORAGE * size * days / 365


def break_even_rate(days: Column, price_per_hour: float, ratio: float) -> Column:
    """Bytes a second that decompression must reach to cost no more than the storage saved."""
    saved = STORAGE * days / 365 * (1 - ratio)
    return 1 / (saved / price_per_hour * 3600)


def service_cost(tokens: float, price_in: Column, price_out: Column, chunk: int = 1000) -> Column:
    """Dollars to read and predict every token of chunks, each prediction seeing its whole chunk so far."""
    chunks, out = tokens / chunk, chunk - 1
    return chunks * (out * chunk / 2) / 1e6 * price_in + chunks * out / 1e6 * price_out


def duration(days: Column) -> Column:
    return F.when(days >= 365, F.format_string("%.2f years", days / 365)).otherwise(F.format_string("%.2f days", days))
