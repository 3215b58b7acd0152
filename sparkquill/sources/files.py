"""Files as tables: exact text, archives, byte regions, token ids, results and reference sheets."""

from __future__ import annotations

import io
import tarfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_FIELDS = "model string, encoding string, batch_size int, context_length int, retain_tokens int, first_n_tokens bigint, lora_path string"
RESULT = f"struct<compression: struct<args: struct<{RUN_FIELDS.replace(' string', ': string').replace(' int', ': int').replace(' bigint', ': bigint')}>, original_size_bytes: bigint, final_size_bytes: double, compression_factor: double, entropy: double, total_compression_time: double>, decompression: struct<decompression_time_sec: double>>"
COMPETITORS = "Dataset string, Dataset_Size bigint, Technique string, Compression_Duration double, Compressed_Size bigint, Decompression_Duration double, Note string"
ENGINES = "Dataset string, Dataset_Size bigint, Size_in_Tokens bigint, Model string, Compression_Duration double, Compressed_Size bigint, Decompression_Duration double, Cost_per_Run double, Engine string, Hardware string"
COSTS = "compressor string, size bigint, time double, comment string"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as strict UTF-8; every line end stays as it is."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def inline(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """Text that is given, or a file; exactly one of both."""
    if (text is None) == (path is None):
        raise ValueError("give either a text or a path")
    return texts(spark, path) if path is not None else spark.createDataFrame([("inline", text)], "path string, text string")


def tar_texts(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """(path, text): the archive's files joined by line ends, or the first; an archive without files is an error."""
    return tar_members(spark.read.format("binaryFile").load(path).select("path", "content"), first_only)


def tar_bytes(rows: DataFrame, key: str, members: str) -> DataFrame:
    """(path, content): an archive for each row, of an array of texts as its files."""

    def run(batches):
        for batch in batches:
            out = []
            for texts in batch.column(1).to_pylist():
                data = io.BytesIO()
                with tarfile.open(fileobj=data, mode="w") as tar:
                    for k, text in enumerate(texts or []):
                        info = tarfile.TarInfo(f"{k:06d}")
                        info.size = len(text.encode())
                        tar.addfile(info, io.BytesIO(text.encode()))
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return rows.select(F.col(key).cast("string").alias("path"), members).mapInArrow(run, "path string, content binary")


def tar_members(archives: DataFrame, first_only: bool = False) -> DataFrame:
    """(path, text) of archives (path, content), as ``tar_texts`` reads them."""

    def members(batches):
        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    parts = [tar.extractfile(m).read().decode() for m in tar if m.isfile()]
                if not parts:
                    raise ValueError("an archive without files")
                out.append(parts[0] if first_only else "\n".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "text"])

    return archives.select("path", "content").mapInArrow(members, "path string, text string")


def region(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """(path, text, sha256) of a byte region; one that is short or not ASCII is an error."""
    part = F.substring("content", offset + 1, length)
    whole = (F.octet_length(part) == length) & (F.length(F.decode(part, "UTF-8")) == F.octet_length(part))
    return spark.read.format("binaryFile").load(path).select("path", F.when(whole, F.decode(part, "UTF-8")).otherwise(F.raise_error(F.lit("the region is short or not ASCII"))).alias("text"), F.sha2(part, 256).alias("sha256"))


def region_chunks(spark: SparkSession, path: str, offset: int, length: int, chunk: int) -> DataFrame:
    """(path, at, text): a region in pieces of at most ``chunk`` bytes."""
    rows = region(spark, path, offset, length).select("path", "text")
    rows = rows.select("path", "text", F.explode(F.sequence(F.lit(0), F.lit(length - 1), F.lit(chunk))).alias("at"))
    return rows.select("path", "at", F.expr(f"substring(text, at + 1, {chunk})").alias("text"))


def token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(token_id) of a file with an id on each line; empty lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").select(F.col("v").cast("int").alias("token_id"))


def model_list(spark: SparkSession, path: str) -> DataFrame:
    """(model) of a JSON list of names; an empty list is an error."""
    names = F.from_json("value", "array<string>")
    rows = spark.read.text(path, wholetext=True).select(F.when(F.size(names) > 0, names).otherwise(F.raise_error(F.lit("no models"))).alias("names"))
    return rows.select(F.explode("names").alias("model"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """(run_key, result) of a JSON map of experiment results; no rows if there is no file."""
    target, files = _files(spark, path)
    if not files.exists(target):
        return spark.createDataFrame([], f"run_key string, result {RESULT}")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {RESULT}>")).alias("run_key", "result"))


def run(spark: SparkSession, path: str, schema) -> DataFrame:
    """(run, columns) of a run directory's ``results.json`` beside the directory's name; no rows if it is not there."""
    target, files = _files(spark, f"{path}/results.json")
    if not files.exists(target):
        return spark.createDataFrame([], schema).select(F.lit(None).cast("string").alias("run"), "*")
    return spark.read.schema(schema).json(f"{path}/results.json").select(F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("run"), "*")


def sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference sheet; ragged rows keep what they have, the rest is null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def exactly_one(df: DataFrame, condition) -> DataFrame:
    """The one row that meets a condition; none or several are an error."""
    found = df.where(condition)
    n = found.limit(2).count()
    if n != 1:
        raise ValueError("no row meets the condition" if n == 0 else "several rows meet the condition")
    return found


def write_ids16(df: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, data): arrays of ids as little-endian 16-bit numbers; a larger id is an error."""

    def run(batches):
        for batch in batches:
            column = batch.column(1).fill_null(pa.scalar([], batch.column(1).type))
            flat, ends = column.flatten().to_numpy(False), np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(False)))).astype(np.int64)
            if flat.size and (flat.min() < 0 or flat.max() >= 1 << 16):
                raise ValueError("an id does not fit in 16 bits")
            data = flat.astype("<u2").tobytes()
            out = [data[2 * a : 2 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "data"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, data binary")


def upsert(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write rows partitioned by key: partitions that the rows name are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, form: str = "parquet", **options: str) -> None:
    """Write a table beside its place and then rename it there: readers meet the old one or the new one, whole."""
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).save(fresh)
    new, files = _files(df.sparkSession, fresh)
    target, _ = _files(df.sparkSession, path)
    old, _ = _files(df.sparkSession, f"{fresh}.old")
    if files.exists(target):
        files.rename(target, old)
    files.rename(new, target)
    files.delete(old, True)


def upsert_rows(df: DataFrame, path: str, keys: list[str]) -> None:
    """Put rows into a stored table: rows with their keys are replaced, all others stay; a table that is not there is made."""
    target, files = _files(df.sparkSession, path)
    if files.exists(target):
        before = df.sparkSession.read.parquet(path)
        df = before.join(df.select(*keys).distinct(), keys, "left_anti").unionByName(df)
    replace(df, path)


def export(df: DataFrame, path: str, form: str) -> None:
    """A table as CSV with a header, or as JSON lines."""
    if form not in ("csv", "json"):
        raise ValueError("a table is exported as csv or json")
    replace(df, path, form, **({"header": "true", "escape": '"'} if form == "csv" else {"ignoreNullFields": "false"}))


def run_directory(root: Column, at: Column) -> Column:
    """Where a run that began at a time is kept."""
    return F.concat(root, F.lit("/run_"), F.date_format(at, "yyyy-MM-dd-HH-mm-ss"))


def params_json(*columns: str) -> Column:
    """A run's parameters as one JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def missing(wanted: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """What is still to do: wanted rows whose key is not done, or all."""
    return wanted if force else wanted.join(done.select(*keys).distinct(), keys, "left_anti")
