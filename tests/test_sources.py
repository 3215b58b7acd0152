import io
import json
import tarfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkquill.sources import files


def test_exact_text_regions_and_ids(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\rb\r\nc\n")
    assert files.texts(spark, str(tmp_path / "a.txt")).first()["text"] == "a\rb\r\nc\n"
    assert files.inline(spark, text="x").first()["text"] == "x"
    with pytest.raises(ValueError):
        files.inline(spark)
    (tmp_path / "r.bin").write_bytes(b"abcdefghij")
    path = str(tmp_path / "r.bin")
    assert files.region(spark, path, 3, 4).first()["text"] == "defg"
    assert [r.text for r in files.region_chunks(spark, path, 2, 7, 3).orderBy("at").collect()] == ["cde", "fgh", "i"]
    with pytest.raises(PySparkException):
        files.region(spark, path, 8, 5).collect()
    (tmp_path / "u.txt").write_bytes("café".encode())
    with pytest.raises(PySparkException):
        files.region(spark, str(tmp_path / "u.txt"), 0, 5).collect()
    (tmp_path / "ids.txt").write_text("3\n\n 14 \n15\n")
    assert [r.token_id for r in files.token_ids(spark, str(tmp_path / "ids.txt")).collect()] == [3, 14, 15]


def test_tar_models_results_and_sheets(spark, tmp_path):
    with tarfile.open(tmp_path / "c.tar", "w") as tar:
        for name, text in (("one", b"first"), ("two", b"second\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    assert files.tar_texts(spark, str(tmp_path / "c.tar")).first()["text"] == "first\nsecond\n"
    assert files.tar_texts(spark, str(tmp_path / "c.tar"), first_only=True).first()["text"] == "first"
    with tarfile.open(tmp_path / "e.tar", "w"):
        pass
    with pytest.raises(PySparkException):
        files.tar_texts(spark, str(tmp_path / "e.tar")).collect()
    (tmp_path / "m.json").write_text('["a", "b"]')
    assert [r.model for r in files.model_list(spark, str(tmp_path / "m.json")).collect()] == ["a", "b"]
    (tmp_path / "n.json").write_text("[]")
    with pytest.raises(PySparkException):
        files.model_list(spark, str(tmp_path / "n.json")).collect()
    (tmp_path / "res.json").write_text(json.dumps({"text8:m/r8_x": {"compression": {"args": {"model": "m", "batch_size": 4}, "compression_factor": 2.5}, "decompression": {"decompression_time_sec": 1.5}}, "k2": {"compression": {}}}))
    got = {r.run_key: r.result for r in files.results(spark, str(tmp_path / "res.json")).collect()}
    assert got["text8:m/r8_x"].compression.args.batch_size == 4 and got["k2"].decompression is None
    assert files.results(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "e.csv").write_text("Dataset,Size,Tokens,Model,CD,CS,DD,Cost,Engine,Hardware\na,1,2,m,1.0,3,2.0,0.5,e,h\nb,1,2,m,0312,3,2.0\n")
    rows = files.sheet(spark, str(tmp_path / "e.csv"), files.ENGINES).collect()
    assert len(rows) == 2 and rows[1].Hardware is None and rows[1].Dataset == "b"


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "runs")
    frame = lambda rows: spark.createDataFrame(rows, "dataset string, v int")
    files.upsert(frame([("a", 1), ("b", 2)]), out, ["dataset"])
    files.upsert(frame([("b", 3)]), out, ["dataset"])
    assert sorted((r.dataset, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3)]
    wanted = frame([("a", 0), ("c", 0)])
    assert [r.dataset for r in files.missing(wanted, spark.read.parquet(out), ["dataset"]).collect()] == ["c"]
    assert files.missing(wanted, spark.read.parquet(out), ["dataset"], force=True).count() == 2
    assert files.exactly_one(wanted, F.col("dataset") == "a").count() == 1
    with pytest.raises(ValueError):
        files.exactly_one(wanted, F.col("v") == 0)
    ids = spark.createDataFrame([(1, [1, 65535])], "k int, ids array<int>")
    assert bytes(files.write_ids16(ids, "k", "ids").first()["data"]) == b"\x01\x00\xff\xff"
    with pytest.raises(PySparkException):
        files.write_ids16(spark.createDataFrame([(1, [65536])], "k int, ids array<int>"), "k", "ids").collect()


def test_rows_are_put_and_tables_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    files.upsert_rows(frame([("a", 1), ("b", 2)]), path, ["k"])
    files.upsert_rows(frame([("b", 3), ("c", 4)]), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [x.name for x in tmp_path.iterdir()] == ["table"]
    odd = frame([('quote " and, comma\nline', 1), (None, None)])
    for form in ("csv", "json"):
        files.export(odd, str(tmp_path / form), form)
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(odd.schema).csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)
    assert sorted(map(tuple, spark.read.schema(odd.schema).json(str(tmp_path / "json")).collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)
    with pytest.raises(ValueError):
        files.export(odd, path, "xml")
    empty = files.tar_bytes(spark.createDataFrame([(1, [])], "k int, m array<string>"), "k", "m")
    with pytest.raises(PySparkException):
        files.tar_members(empty).collect()
    none = files.write_ids16(spark.createDataFrame([(1, None), (2, []), (3, [258])], "k int, ids array<int>"), "k", "ids").collect()
    assert [bytes(r.data) for r in none] == [b"", b"", b"\x02\x01"]


def test_scratch_and_measured_broadcasts(spark):
    from sparkquill import session

    rows = spark.range(100).withColumn("t", F.lit("x" * 100))
    assert "ResolvedHint" in session.small(rows)._jdf.queryExecution().analyzed().toString() or "hint" in session.small(rows)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in session.small(rows, limit=1000)._jdf.queryExecution().logical().toString().lower()
    kept = session.stored(rows, "kept")
    assert kept.count() == 100
    session.discard(kept)
    with pytest.raises(PySparkException):
        spark.read.parquet(kept._stored_at)
    assert session.unused(spark.range(1).toDF("A"), "a") == "a_"
