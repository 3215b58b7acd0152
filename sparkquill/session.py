"""Session helpers: configuration, shared scratch tables, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_PASSING: set[str] = set()
#: Bytes of a table that a join may broadcast.
BROADCAST_BYTES = 32 << 20


def session(app: str = "sparkquill", **conf: str) -> SparkSession:
    """A session with the settings that every operator here assumes; callers' settings win."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; the directory may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that ``spark.checkpoint.dir`` names. Only a local master may do without that
    setting (its driver and executors are one process); a cluster without it is an error, since
    machine-local folders would lose rows there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file:///tmp/checkpoints/sparkquill"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table in the application's own part of the shared folder, which goes when its driver ends."""
    root = f"{scratch_root(spark)}/sparkquill-{spark.sparkContext.applicationId}"
    if root not in _PASSING:
        _PASSING.add(root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, name: str = "small", limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table for a join's lesser side: stored, and broadcast if what it holds is measured to be below ``limit`` bytes.

    A larger one is joined as Spark plans it, by a shuffle.
    """
    kept = stored(df, name)
    width = reduce(add, (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in kept.columns), F.lit(64 + 8 * len(kept.columns)))
    size = kept.agg(F.sum(width).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(kept) if size <= limit else kept


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for work that costs far more than moving them, where the input has fewer splits.

    The number of splits is estimated from the size that the plan's statistics give, without planning the query.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if size >= cores * split else df.repartition(cores)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers (once for each application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sparkquill-"), "sparkquill.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("sparkquill", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
    return spark
