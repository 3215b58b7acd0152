"""Tables that a Python worker keeps between tasks (one operator's at a time), and joins by keys that may be hot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sparkquill.session import small

_CLEAR: dict[str, Callable[[], None]] = {}


def keep_only(name: str, clear: Callable[[], None]) -> None:
    """Called when an operator's task begins: the tables of all other operators are dropped."""
    _CLEAR[name] = clear
    for other, drop in list(_CLEAR.items()):
        if other != name:
            drop()
            del _CLEAR[other]


def map_columns(df: DataFrame, function: Callable, schema: StructType) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names: in the batches they are ``c0``, ``c1``, ...

    ``function`` yields batches of the columns of ``schema``, numbered likewise.
    """
    plain = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema.fields)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(function, plain).toDF(*schema.names)


#: A key with more rows than this is hot.
HOT_ROWS = 1000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the facts of their key, where ``facts`` has one row for each key and its number of rows.

    Facts of hot keys, at most one for each ``HOT_ROWS`` rows, are broadcast if they are measured to be small, so
    that no key's rows come together in one task; those of all other keys are joined by a shuffle. Both tables
    are read twice: they should be stored ones.
    """
    hot = small(facts.where(F.col(count) > HOT_ROWS).drop(count), "hot-facts")
    cold = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col(count) <= HOT_ROWS).drop(count), key)
    return cold.unionByName(rows.join(hot, key))
