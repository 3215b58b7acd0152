"""Sources, sinks, files and containers over the test tables: written to the shared folder and read again."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sparkquill.functions import containers
from sparkquill.operators import bpe, codecs
from sparkquill.operators import model as md
from sparkquill.operators import results as rs
from sparkquill.operators import tokens as tk
from sparkquill.plans import model_queries as mq
from sparkquill.plans import result_queries as rq
from sparkquill.session import scratch_path, small, stored, table
from sparkquill.sources import files

BLOCK = 256
SHEET = [("text8", 100000000, None, "zip", 5.421, 33182212, 0.7844, "one, core"), ("yelp", 5, 7, "gz", 0.5, 3, None, None)]
INLINE = "One text,\nas given: é \U0001f600"


def _docs(spark, d):
    return table(spark, d, "documents")


def s2_tar_texts(spark, d):
    """Texts as archives of their lines, read back joined by line ends, and the first line alone."""
    archives = stored(files.tar_bytes(_docs(spark, d).select("doc_id", F.split("text", "\n").alias("lines")), "doc_id", "lines"), "archives")
    whole, first = files.tar_members(archives), files.tar_members(archives, first_only=True).withColumnRenamed("text", "first")
    both = whole.join(first, "path")
    return both.select(F.col("path").cast("long").alias("doc_id"), F.sha2("text", 256).alias("sha256"), F.sha2("first", 256).alias("first_sha256"))


def s3_inline_text(spark, d):
    return files.inline(spark, text=INLINE).select("path", "text", F.octet_length("text").cast("bigint").alias("n_bytes"))


def s7_training_rows(spark, d):
    """Blocks of 256 words; what is left at the end, a whole block too, is no block."""
    words = _docs(spark, d).select("doc_id", tk.word_array(F.col("text")).alias("w")).where(F.size("w") > BLOCK)
    rows = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - BLOCK - 1, F.lit(BLOCK))).alias("start"))
    block = F.slice("w", F.col("start") + 1, BLOCK)
    return rows.select("doc_id", F.col("start").cast("bigint").alias("start"), F.size(block).cast("bigint").alias("n"), F.sha2(F.array_join(block, " "), 256).alias("sha256"))


def _results_file(spark):
    """All runs as one JSON map, as result files are."""
    path = scratch_path(spark, "results")
    text = {key: {"compression": {"args": {"model": model, "encoding": enc, "batch_size": batch, "context_length": ctx, "lora_path": lora}, "original_size_bytes": raw, "final_size_bytes": final, "compression_factor": factor, "total_compression_time": t}} for key, raw, final, factor, t, model, enc, batch, ctx, lora in rq.RUNS}
    spark.createDataFrame([(json.dumps(text),)], "value string").coalesce(1).write.text(path)
    return path


def s8_results_file(spark, d):
    out = files.results(spark, _results_file(spark))
    none = files.results(spark, scratch_path(spark, "no-results"))
    r = F.col("result.compression")
    return out.unionByName(none).select("run_key", r["args"]["model"].alias("model"), r["args"]["batch_size"].alias("batch_size"), r["original_size_bytes"].alias("raw"), r["final_size_bytes"].alias("final"), r["total_compression_time"].alias("seconds"))


def s9_one_run(spark, d):
    """One run's compression results beside the name of its directory; a run that is not there gives no rows."""
    root = scratch_path(spark, "run-s9")
    rq._nested(spark).where(F.col("run_key") == rq.RUNS[7][0]).select("compression").coalesce(1).write.json(f"{root}/run_a/results.json")
    schema = rq._nested(spark).select("compression").schema
    found = [files.run(spark, f"{root}/{name}", schema) for name in ("run_a", "run_b")]
    rows = found[0].unionByName(found[1])
    return rows.select("run", F.col("compression.original_size_bytes").alias("raw"), F.col("compression.args.model").alias("model"))


def s10_reference_sheet(spark, d):
    path = scratch_path(spark, "sheet")
    lines = [("Dataset,Size,Tokens,Technique,CD,CS,DD,Note",), ('text8,100000000,,zip,5.421,33182212,0.7844,"one, core"',), ("yelp,5,7,gz,0.5,3",)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    return files.sheet(spark, path, "dataset string, size bigint, tokens bigint, technique string, seconds double, compressed bigint, back double, note string")


def s11_model_list(spark, d):
    path = scratch_path(spark, "models")
    spark.createDataFrame([(json.dumps(rq.MODELS),)], "value string").coalesce(1).write.text(path)
    return files.model_list(spark, path)


def s12_token_id_file(spark, d):
    """The lengths of all words, an id on each line with empty lines between, read back and counted."""
    path = scratch_path(spark, "ids")
    lengths = _docs(spark, d).select(F.explode(tk.word_array(F.col("text"))).alias("w")).select(F.length("w").alias("n"))
    lengths.select(F.explode(F.array(F.concat(F.lit(" "), F.col("n").cast("string")), F.lit(""))).alias("value")).write.text(path)
    return files.token_ids(spark, path).groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))


def s13_one_condition(spark, d):
    return files.exactly_one(rq._flat(spark), F.col("run_key") == rq.RUNS[5][0]).select("run_key", "model", "batch_size")


def k1_global_files(spark, d):
    """Every text as a file of header, seeds, code of four lanes and bitmap; read back from its bytes."""
    docs = _docs(spark, d)
    model = codecs.fit(docs)
    kept = stored(codecs.global_files(docs, model), "global")
    return codecs.global_texts(kept, model).select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("bigint").alias("n_tokens"), "n_used")


def k2_upsert_rows(spark, d):
    """Counts by language and source; those of one source are put anew, and a new key is added."""
    path = scratch_path(spark, "upsert")
    rows = _docs(spark, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    files.upsert_rows(rows, path, ["lang", "source"])
    newer = rows.where("lang = 'de'").withColumn("n", -F.col("n")).unionByName(spark.createDataFrame([("xx", "new", 1)], "lang string, source string, n bigint"))
    files.upsert_rows(newer, path, ["lang", "source"])
    return spark.read.parquet(path)


def k4_atomic_replace(spark, d):
    """A table that is written twice at one place holds the second, whole."""
    path = scratch_path(spark, "replace")
    docs = _docs(spark, d)
    files.replace(docs.select("doc_id"), path)
    files.replace(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.parquet(path)


def k5_exports(spark, d):
    """Counts by language, exported as CSV and as JSON, read back."""
    rows = _docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("least"))
    out = None
    for form in ("csv", "json"):
        path = scratch_path(spark, f"export-{form}")
        files.export(rows, path, form)
        back = (spark.read.option("multiLine", "true").option("header", "true").option("escape", '"') if form == "csv" else spark.read).format(form).schema(rows.schema).load(path)
        out = back.withColumn("form", F.lit(form)) if out is None else out.unionByName(back.withColumn("form", F.lit(form)))
    return out


def k6_sidecars(spark, d):
    """Decoded text and token ids beside each other, written and read as one table."""
    docs = table(spark, d, "benchmark").select("item_id", "text", F.array_join(F.transform(tk.characters(F.col("text")), lambda x: F.ascii(x)), " ").alias("token_ids"))
    return stored(docs, "sidecars").select("item_id", F.sha2("text", 256).alias("text_sha256"), F.sha2("token_ids", 256).alias("ids_sha256"))


def k7_ids16(spark, d):
    """Word lengths of each document as little-endian 16-bit numbers."""
    rows = _docs(spark, d).select("doc_id", F.transform(tk.word_array(F.col("text")), lambda x: F.length(x)).alias("ids"))
    return files.write_ids16(rows, "doc_id", "ids").select("doc_id", F.sha2(F.lower(F.hex("data")), 256).alias("hex_sha256"), F.octet_length("data").cast("bigint").alias("n_bytes"))


def k8_run_directories(spark, d):
    rows = rq._flat(spark).withColumn("at", F.expr("timestamp_ntz'2024-03-01 07:05:09' + make_interval(0, 0, 0, 0, 0, 0, batch_size)"))
    return rows.select("run_key", files.run_directory(F.lit("results"), F.col("at")).alias("directory"), files.params_json("model", "batch_size", "lora_path").alias("params"))


def c9_experiment_keys(spark, d):
    rows = [(containers.experiment_key(f"data/{r[0].split(':')[0]}", r[5], r[8], 100, 1000, False, r[7], True, "hf", r[6], r[9]), r[0]) for r in rq.RUNS]
    return spark.createDataFrame(rows, "key string, run_key string")


def r12_factor_by_parameter(spark, d):
    sizes = spark.createDataFrame([(m, (i + 1) * 100_000_000) for i, m in enumerate(rq.MODELS)], "model string, params bigint")
    rows = rq._flat(spark).where((F.col("batch_size") == 16) & (F.col("encoding") == "AC") & F.col("lora_path").isNull())
    return rs.per_parameter(rows.join(F.broadcast(sizes), "model"), "compression_factor", "params").select("run_key", F.round(F.col("per_parameter") * 1e9, 6).alias("per_billion"))


def e2_presorted_frequencies(spark, d):
    """Frequencies whose remainder was checked to be from 0 to less than the vocabulary in every context."""
    model = mq._model(spark, d)
    size = max(1, model.select("token").distinct().count())
    return md.frequencies_checked(model, size).groupBy("ctx").agg(F.count(F.lit(1)).alias("n_seen"), (F.sum("freq") + size - F.count(F.lit(1))).cast("bigint").alias("total"), F.min("freq").alias("least"))


def b2_file_benchmark(spark, d):
    """Each language's texts as one kind of file: sizes by codec, whether all are exact, and whether a speed was measured."""
    docs = _docs(spark, d)
    rows = codecs.byte_codecs(docs).join(docs.select("doc_id", "lang"), "doc_id").where(F.col("codec").isin("gzip-9", "zip", "zstd-3"))
    out = codecs.speeds(rows, "lang", "codec")
    return out.select("lang", "codec", "raw", "exact", (F.col("ratio") < 1.5).alias("has_ratio"), (F.col("kb_s") > 0).alias("has_speed"))


def v21_finalised_streams(spark, d):
    docs = _docs(spark, d)
    return codecs.containers_of(docs, codecs.fit(docs)).select("doc_id", "sha256", "n_tokens", "verified")


def p2_ragged_prompts(spark, d):
    """The greedy next character of whole texts as prompts, of unequal lengths and without padding."""
    prompts = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    best = small(md.most_likely(mq._model(spark, d)).select("ctx", "token"), "best")
    return prompts.join(best, F.expr("right(prompt, 1) = ctx"), "left").select("item_id", F.length("prompt").cast("bigint").alias("n_seen"), F.col("token").alias("following"))


def p6_resumed_scores(spark, d):
    """Each text scored in two parts, the second resumed from the context where the first stopped."""
    docs = _docs(spark, d).where(F.length("text") > 0)
    half = F.floor(F.length("text") / 2).cast("int")
    bits = small(mq._freqs(spark, d).select("ctx", "token", md.ideal_bits(F.col("freq")).alias("bits")), "bits")
    parts = docs.select("doc_id", F.explode(F.array(F.struct(F.expr("left(text, 0)").alias("seen"), F.expr("substring(text, 1, int(length(text) / 2))").alias("own")), F.struct(F.when(half > 0, F.expr("substring(text, int(length(text) / 2), 1)")).otherwise("").alias("seen"), F.expr("substring(text, int(length(text) / 2) + 1)").alias("own")))).alias("p")).select("doc_id", "p.seen", "p.own")
    rows = tk.with_context(parts, tk.characters(F.concat("seen", "own")), "doc_id", "seen").where(F.col("pos") >= F.length("seen"))
    return rows.join(bits, ["ctx", "token"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum("bits"), 4).alias("bits"))


def t18_local_round_trip(spark, d):
    """Pieces of the benchmark checked word by word, against the check of whole texts; a changed piece fails both."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    return bpe.round_trips(items, "item_id", bpe.learn(_docs(spark, d), 2_000))


_T = mq.T
SQL = {
    "s2_tar_texts": "SELECT doc_id, sha256(text) AS sha256, sha256(string_split(text, chr(10))[1]) AS first_sha256 FROM documents",
    "s3_inline_text": "SELECT 'inline' AS path, 'One text,' || chr(10) || 'as given: é \U0001f600' AS text, 27::BIGINT AS n_bytes",
    "s7_training_rows": r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 256, 0), 256)) AS start FROM w) SELECT doc_id, start::BIGINT AS start, 256::BIGINT AS n, sha256(array_to_string(w[start + 1 : start + 256], ' ')) AS sha256 FROM b",
    "s8_results_file": f"SELECT run_key, model, batch_size, original_size_bytes AS raw, final_size_bytes AS final, total_compression_time AS seconds FROM {rq.values(rq.RUNS, rq.RUN_NAMES)}",
    "s9_one_run": f"SELECT 'run_a' AS run, original_size_bytes AS raw, model FROM {rq.values(rq.RUNS[7:8], rq.RUN_NAMES)}",
    "s10_reference_sheet": "SELECT * FROM " + rq.values([("text8", 100000000, None, "zip", 5.421, 33182212, 0.7844, "one, core"), ("yelp", 5, 7, "gz", 0.5, 3, None, None)], ["dataset", "size", "tokens", "technique", "seconds", "compressed", "back", "note"]),
    "s11_model_list": "SELECT * FROM " + rq.values([(m,) for m in rq.MODELS], ["model"]),
    "s12_token_id_file": r"SELECT length(w)::INTEGER AS token_id, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1",
    "s13_one_condition": f"SELECT run_key, model, batch_size FROM {rq.values(rq.RUNS[5:6], rq.RUN_NAMES)}",
    "k1_global_files": "SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS n_tokens, len(list_distinct(string_split(text, '')))::BIGINT AS n_used FROM documents",
    "k2_upsert_rows": "SELECT lang, source, (CASE WHEN lang = 'de' THEN -n ELSE n END)::BIGINT AS n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) UNION ALL SELECT 'xx', 'new', 1",
    "k4_atomic_replace": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "k5_exports": "SELECT lang, count(*) AS n, min(source) AS least, form FROM documents, (VALUES ('csv'), ('json')) f(form) GROUP BY lang, form",
    "k6_sidecars": "SELECT item_id, sha256(text) AS text_sha256, sha256(array_to_string(list_transform(string_split(text, ''), lambda x: ord(x)), ' ')) AS ids_sha256 FROM benchmark",
    "k7_ids16": r"SELECT doc_id, sha256(array_to_string(list_transform(x, lambda n: printf('%02x%02x', n % 256, n // 256)), '')) AS hex_sha256, (2 * len(x))::BIGINT AS n_bytes FROM (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), lambda x: length(x)) AS x FROM documents)",
    "k8_run_directories": f"""SELECT run_key, 'results/run_' || strftime(TIMESTAMP '2024-03-01 07:05:09' + to_seconds(batch_size), '%Y-%m-%d-%H-%M-%S') AS directory, '{{"model":"' || model || '","batch_size":' || batch_size || ',"lora_path":' || coalesce('"' || lora_path || '"', 'null') || '}}' AS params FROM {rq.values(rq.RUNS, rq.RUN_NAMES)}""",
    "c9_experiment_keys": f"SELECT regexp_extract(split_part(run_key, ':', 1), '[^/]*$') || ':' || model || '|ctx=' || context_length || '|ret=100|n=1000|kv=False|batch=' || batch_size || '|reduce=True|engine=hf|enc=' || encoding || '|lora=' || coalesce(lora_path, 'None') AS key, run_key FROM {rq.values(rq.RUNS, rq.RUN_NAMES)}",
    "r12_factor_by_parameter": f"SELECT run_key, round(compression_factor / (params + 1e-9) * 1e9, 6) AS per_billion FROM {rq.values(rq.RUNS, rq.RUN_NAMES)} JOIN (SELECT * FROM {rq.values([(m, (i + 1) * 100_000_000) for i, m in enumerate(rq.MODELS)], ['model', 'params'])}) s USING (model) WHERE batch_size = 16 AND encoding = 'AC' AND lora_path IS NULL",
    "e2_presorted_frequencies": f"WITH {mq.M1}, {mq.FREQ.format(t=_T)} SELECT ctx, count(*) AS n_seen, {_T}::BIGINT AS total, min(freq) AS least FROM f GROUP BY ctx",
    "b2_file_benchmark": "SELECT lang, codec, sum(strlen(text))::BIGINT AS raw, true AS exact, true AS has_ratio, true AS has_speed FROM documents, (VALUES ('gzip-9'), ('zip'), ('zstd-3')) c(codec) GROUP BY ALL",
    "v21_finalised_streams": "SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS n_tokens, true AS verified FROM documents WHERE length(text) > 1",
    "p2_ragged_prompts": f"WITH {mq.M1}, g AS (SELECT ctx, token FROM m QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) = 1) SELECT item_id, length(text)::BIGINT AS n_seen, g.token AS following FROM benchmark LEFT JOIN g ON g.ctx = right(text, 1)",
    "p6_resumed_scores": mq.SQL["e7_cross_entropy"],
}

QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "skcrebvpt" and n[1:2].isdigit()}
