"""Result mining and economics over rows that are given as literals, and over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkquill.operators import economics as ec
from sparkquill.operators import results as rs
from sparkquill.operators import tokens as tk
from sparkquill.session import table

MODELS = ["Qwen/Qwen2.5-0.5B", "Qwen/Qwen3-0.6B", "distilgpt2", "google/t5-small", "state-spaces/mamba-130m-hf"]


def _runs() -> list[tuple]:
    """Runs made by rule: key, dataset sizes, sizes, times and arguments, with gaps."""
    out = []
    for i in range(96):
        dataset, model = ("text8", "yelp", "code")[i % 3], MODELS[i % 5]
        rank = (None, 8, 16)[i % 7 % 3]
        path = None if rank is None else f"adapters/{('LoRA', 'vera')[i % 2]}/r{rank}_x"
        raw, final = 1000 * (1 + i % 11), 200.0 + 37 * (i % 13)
        key = f"data/{dataset}:{model}/{'' if rank is None else f'r{rank}_'}n{i}"
        out.append((key, raw, final, round(raw / final, 6), None if i % 17 == 0 else 1.5 + (i * 7 % 23), model, ("AC", "bitpacked", "huffman", "PMATIC")[i % 4], (1, 16, 32)[i % 3], (256, 512, 1000)[i // 3 % 3], path))
    return out


RUNS = _runs()
RUN_NAMES = ["run_key", "original_size_bytes", "final_size_bytes", "compression_factor", "total_compression_time", "model", "encoding", "batch_size", "context_length", "lora_path"]
#: Published sizes (bytes) and times (seconds) on 100,000,000 bytes of text.
COMPETITORS = [("zip", 33182212, 5.421, 0.7844), ("gzip-default", 33182062, 5.345, 0.6132), ("gzip-9", 33048244, 7.795, 0.6154), ("zstd-3", 32693862, 0.6546, 0.1624), ("zstd-1", 35054779, 0.4053, 0.1313), ("zstd-19", 24545481, 62.34, 0.1841), ("xz-9e", 23221180, 80.36, 1.135), ("cmix", 16230986, 95860.0, None), ("qwen2.5 0.5B", 14063799, 833.4, None)]
#: Cost sheet rows (compressor, bytes, seconds) and the price of an hour.
COSTS = [("uncompressed", 100000000, 0.0, 0.019), ("fsst", 48111129, 0.34, 0.019), ("lz4", 54591360, 0.24, 0.019), ("zstd", 32693862, 0.51, 0.019), ("xz", 24453576, 79.49, 0.019), ("qwen2.5 0.5B", 14063799, 1830.39, 0.804), ("distilgpt2", 17889602, 926.96, 0.804)]
#: Dollars for a million tokens in and out.
SERVICES = [("gemini-2.5-pro", 1.25, 10.0), ("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6)]
AUDIT = [("text8", "AC", 100, 14, True, "measured"), ("text8", "zstd", 100, 30, True, "measured"), ("random", "AC", 100, 95, False, "measured"), ("random", "zstd", 100, 83, None, "preliminary"), ("text8", "AC", 100, 15, True, "measured"), ("other", "ids", 100, 41, True, "odd"), ("one", "zstd", 50, 40, True, "measured")]
AUDIT_NAMES = ["dataset", "codec", "raw", "serialized", "round_trip", "status"]


def _sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], names: list[str]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") v({', '.join(names)})"


def _flat(spark):
    return spark.createDataFrame(RUNS, "run_key string, original_size_bytes bigint, final_size_bytes double, compression_factor double, total_compression_time double, model string, encoding string, batch_size int, context_length int, lora_path string")


def _nested(spark):
    args = ["model", "encoding", "batch_size", "context_length", "lora_path"]
    return _flat(spark).select("run_key", F.struct(F.struct(*args).alias("args"), *[n for n in RUN_NAMES[1:] if n not in args]).alias("compression"))


def _audit(spark):
    return spark.createDataFrame(AUDIT, "dataset string, codec string, raw bigint, serialized bigint, round_trip boolean, status string")


def _competitors(spark):
    return spark.createDataFrame(COMPETITORS, "technique string, size bigint, seconds double, back double")


def _costs(spark):
    return spark.createDataFrame(COSTS, "compressor string, size bigint, seconds double, price double")


def r1_lifted_arguments(spark, d):
    # Through JSON, as result files hold it.
    nested = _nested(spark)
    parsed = nested.select("run_key", F.from_json(F.to_json("compression"), nested.schema["compression"].dataType).alias("compression"))
    return rs.lifted(parsed)


def r2_keys(spark, d):
    k = F.col("run_key")
    return _flat(spark).select("run_key", rs.dataset_of(k).alias("dataset"), rs.adapter_rank(k).alias("rank"), rs.adapter_kind(F.col("lora_path")).alias("kind"))


def r5_fastest_runs(spark, d):
    rows = _flat(spark).withColumn("dataset", rs.dataset_of(F.col("run_key")))
    return rs.best(rows, ["dataset", "model"], "total_compression_time").select("dataset", "model", "run_key", "total_compression_time")


def r6_clean_results(spark, d):
    rows = _flat(spark).fillna(0, ["total_compression_time"]).withColumn("encoding", F.when(F.col("encoding") == "huffman", "HC").when(F.col("encoding") == "bitpacked", "BP").otherwise(F.col("encoding")))
    return rows.select("run_key", "encoding", "total_compression_time", (F.col("compression_factor") * 1048576).cast("bigint").alias("size_bytes"))


def r7_model_names(spark, d):
    return _flat(spark).select("run_key", rs.short_model(F.col("model")).alias("short"), rs.family(F.col("run_key"), MODELS).alias("family"))


def r8_factors(spark, d):
    return _flat(spark).select("run_key", F.round(F.try_divide("original_size_bytes", "final_size_bytes"), 6).alias("compression_factor"), F.round(F.try_divide("final_size_bytes", "original_size_bytes"), 6).alias("size_ratio"))


def r9_filter(spark, d):
    return rs.where_equal(_flat(spark), encoding="AC", batch_size=16, no_such_column=3).select("run_key")


def r10_scaled(spark, d):
    return rs.scaled(_flat(spark), "final_size_bytes", 25.0, 200.0, "marker").select("run_key", F.round("marker", 6).alias("marker"))


def r11_base_models(spark, d):
    rows = _flat(spark).where(F.col("lora_path").isNull() & F.col("model").contains("Qwen") & F.col("total_compression_time").isNotNull())
    w = Window.partitionBy("model", "encoding").orderBy("batch_size", "run_key")
    return rows.select("model", "encoding", "batch_size", "run_key", F.row_number().over(w).alias("place"))


def r13_expected_runs(spark, d):
    return rs.expected(rs.where_equal(_flat(spark), encoding="AC", batch_size=1), 8).select("run_key")


def r14_grid(spark, d):
    out = rs.grid(_flat(spark), "context_length", "batch_size", [1, 16, 32], "compression_factor")
    return out.select("context_length", *(F.round(F.col(str(b)), 6).alias(f"b{b}") for b in (1, 16, 32)))


def r16_competitors(spark, d):
    names = spark.createDataFrame([("zip", "Zip"), ("gzip-default", "Gzip"), ("zstd-3", "Zstd"), ("xz-9e", "LZMA"), ("cmix", "CMIX"), ("qwen2.5 0.5B", "LLM")], "technique string, shown string")
    rows = _competitors(spark).join(F.broadcast(names), "technique")
    factor = F.try_divide(F.lit(1e8), F.col("size"))
    return rows.select("shown", F.round(factor, 6).alias("factor"), F.round(F.try_divide(F.lit(1e8), F.col("seconds")), 3).alias("speed"), F.row_number().over(Window.orderBy(factor.desc())).alias("place"))


def r17_costs(spark, d):
    rows = _costs(spark).where("compressor <> 'uncompressed'")
    return rows.select("compressor", F.round(ec.run_cost(F.col("seconds"), F.col("price")), 9).alias("cost"), F.round(F.try_divide(F.lit(1e8), F.col("size")), 6).alias("factor"))


def r18_service_costs(spark, d):
    rows = spark.createDataFrame(SERVICES, "model string, price_in double, price_out double")
    rows = rows.select("model", F.round(ec.service_cost(25_000_000, F.col("price_in"), F.col("price_out")), 6).alias("cost"))
    own = spark.range(1).select(F.lit("self-hosted").alias("model"), F.round(ec.run_cost(F.lit(25_000 * 18.7516143293), F.lit(1.861)), 6).alias("cost"))
    return rows.unionByName(own)


def r19_payoff(spark, d):
    rows = _costs(spark).withColumn("speed", F.coalesce(F.try_divide(F.lit(1e8), F.col("seconds")), F.lit(0.0)))
    days = ec.payoff_days(F.col("size"), F.col("speed"), F.col("price") > 0.1)
    return rows.select("compressor", F.round(days, 6).alias("days"), ec.duration(F.round(days, 6)).alias("shown"))


def r20_cost_over_time(spark, d):
    rows = _costs(spark).withColumn("speed", F.coalesce(F.try_divide(F.lit(1e8), F.col("seconds")), F.lit(0.0)))
    grid = spark.createDataFrame([(1.0,), (30.0,), (365.0,), (3650.0,)], "days double")
    cost = ec.cost_over_time(F.col("days"), F.col("size"), F.col("speed"), F.col("price") > 0.1)
    return rows.crossJoin(F.broadcast(grid)).select("compressor", "days", F.round(cost, 9).alias("cost"), F.round(ec.STORAGE * 1e8 * F.col("days") / 365 - cost, 9).alias("saving"))


def r22_day_grid(spark, d):
    """Ten points, evenly on a log scale, from each tick to the next."""
    ticks = [1 / 24 / 60, 1 / 24, 1.0, 30.0, 365.0, 3650.0, 36500.0, 365000.0, 3650000.0]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(ticks, ticks[1:], strict=False))], "part int, lo double, hi double")
    rows = rows.select("part", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    return rows.select("part", "k", F.round(F.pow(F.lit(10.0), F.log10("lo") + (F.log10("hi") - F.log10("lo")) * F.col("k") / 9), 6).alias("days"))


def r23_break_even(spark, d):
    rows = spark.createDataFrame([(1.0,), (30.0,), (365.0,)], "days double")
    return rows.select("days", F.round(ec.break_even_rate(F.col("days"), 0.6, 0.1), 3).alias("gpu"), F.round(ec.break_even_rate(F.col("days"), 0.1, 1 / 1.65), 3).alias("cpu"))


def r24_fastest_engine(spark, d):
    rows = _competitors(spark).withColumn("speed", F.try_divide(F.lit(1e8), F.col("seconds"))).dropna(subset=["speed", "back"])
    return rows.agg(F.max_by("technique", "speed").alias("fastest"), F.count(F.lit(1)).alias("n"))


def r26_listing(spark, d):
    return _flat(spark).select(rs.dataset_of(F.col("run_key")).alias("dataset"), "model").distinct()


def r27_audit(spark, d):
    return rs.audit(_audit(spark), ["text8", "random", "one"])


def r28_best_codec(spark, d):
    rows = _audit(spark).withColumn("percent", F.try_divide(F.col("serialized") * 100.0, "raw"))
    return rows.groupBy("dataset").agg(F.min_by("codec", F.struct("percent", "codec")).alias("codec"), F.round(F.min("percent"), 6).alias("percent"))


def r29_by_model(spark, d):
    out = rs.spread_of(_flat(spark), ["model"], "compression_factor")
    return out.select("model", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def r30_missing_cells(spark, d):
    return rs.missing_cells(_audit(spark), "dataset", "codec")


def r31_sweep_summary(spark, d):
    out = rs.spread_of(_audit(spark).withColumn("percent", F.try_divide(F.col("serialized") * 100.0, "raw")), ["dataset", "codec"], "percent")
    return out.select("dataset", "codec", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), rs.in_order(F.col("codec"), ["zstd", "AC"]).cast("int").alias("place"))


def r32_relative(spark, d):
    rows = _competitors(spark)
    base = rows.where("technique = 'gzip-9'").select(F.col("size").alias("base"))
    return rows.crossJoin(F.broadcast(base)).select("technique", F.round(F.try_divide("size", "base"), 6).alias("relative"))


def r33_interval_histogram(spark, d):
    docs = table(spark, d, "documents").select("lang", F.length("text").alias("n_chars"))
    return rs.interval_counts(docs, "lang", "n_chars", [(0, 100), (100, 1000), (1000, 5000), (5000, 1e9)]).select("lang", "place", "n", F.round("share", 6).alias("share"))


def r34_equal_bins(spark, d):
    return rs.equal_bins(table(spark, d, "documents").select(F.length("text").alias("x")), "x", 20)


def r35_labels(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", rs.label(F.octet_length("text").cast("double"), 1024, ["B", "KB", "MB", "GB", "TB"]).alias("label"))


def r36_slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", rs.slug(F.concat_ws(" / ", "p_brand", "p_type")).alias("slug"))


def r38_experiment_grid(spark, d):
    a = spark.createDataFrame([("AC",), ("huffman",), ("bitpacked",)], "encoding string")
    b = spark.createDataFrame([(1,), (16,), (32,)], "batch int")
    return a.crossJoin(b).select("encoding", "batch", F.format_string("%s_b%d", "encoding", "batch").alias("job"))


def r40_geometric_means(spark, d):
    return table(spark, d, "documents").where("text <> ''").groupBy("lang").agg(F.round(rs.geometric_mean(F.length("text")), 6).alias("mean"))


def r41_box_numbers(spark, d):
    rows = table(spark, d, "documents").select("lang", F.length("text").alias("x")).groupBy("lang").agg(rs.five_numbers("x").alias("q"))
    return rows.select("lang", *(F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))))


def r42_stacked(spark, d):
    rows = table(spark, d, "documents").groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("n"))
    w = Window.partitionBy("lang").orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("lang", "source", F.sum("n").over(w).alias("top"))


def r43_packaging_gate(spark, d):
    return rs.rejected(table(spark, d, "documents"), [r"[A-Za-z0-9._]+@[A-Za-z0-9]+", "(?i)secret"], 100 << 20)


def k3_work_list(spark, d):
    docs, done = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(done.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")


def v15_compatible_checkpoints(spark, d):
    """Pairs of runs by place whose settings are the same, nulls counting as values."""
    rows = _flat(spark).select("run_key", "model", "encoding", "batch_size", "lora_path", F.regexp_extract("run_key", r"n(\d+)$", 1).cast("int").alias("i"))
    other = rows.select((F.col("i") - 60).alias("i"), F.col("model").alias("m2"), F.col("encoding").alias("e2"), F.col("batch_size").alias("b2"), F.col("lora_path").alias("l2"))
    same = F.col("model").eqNullSafe(F.col("m2")) & F.col("encoding").eqNullSafe(F.col("e2")) & F.col("batch_size").eqNullSafe(F.col("b2")) & F.col("lora_path").eqNullSafe(F.col("l2"))
    return rows.join(other, "i").select("run_key", same.alias("compatible"))


def v16_complete_conditions(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("seen"))
    return turns.select("conv_id", (F.col("seen") == F.sequence(F.lit(0), F.size("seen") - 1).cast("array<bigint>")).alias("complete"))


def c11_seed_costs(spark, d):
    width = F.length(F.bin(tk_size(spark, d) - 1))
    return table(spark, d, "documents").select("doc_id", (width * F.least(F.length("text"), F.lit(4))).cast("bigint").alias("seed_bits"))


def tk_size(spark, d):
    """The number of distinct characters, as a literal."""
    return F.lit(tk.tokens(table(spark, d, "documents"), tk.characters(F.col("text"))).select("token").distinct().count()).cast("bigint")


_R = values(RUNS, RUN_NAMES)
_A = values(AUDIT, AUDIT_NAMES)
_C = values(COMPETITORS, ["technique", "size", "seconds", "back"])
_K = values(COSTS, ["compressor", "size", "seconds", "price"])
_DATASET = "nullif(regexp_extract(run_key, '([^:/]+):', 1), '')"
_SPEED = "coalesce(1e8::DOUBLE / nullif(seconds, 0), 0)"
_COST = f"(CASE WHEN {_SPEED} > 0 THEN 1e8::DOUBLE / {_SPEED} / 3600 * CASE WHEN price > 0.1 THEN 0.6::DOUBLE ELSE 0.1::DOUBLE / 14 END ELSE 0 END)"
_DAYS = f"round(CASE WHEN {_SPEED} > 0 THEN {_COST} / nullif(2.4e-10::DOUBLE * (1e8::DOUBLE - size), 0) * 365 ELSE 0 END, 6)"

SQL = {
    "r1_lifted_arguments": f"SELECT run_key, original_size_bytes::BIGINT AS original_size_bytes, final_size_bytes, compression_factor, total_compression_time, model, encoding, batch_size, context_length, lora_path FROM {_R}",
    "r2_keys": f"SELECT run_key, {_DATASET} AS dataset, try_cast(nullif(regexp_extract(run_key, '/r(\\d+)_', 1), '') AS INTEGER) AS rank, CASE WHEN lower(lora_path) LIKE '%vera%' THEN 'vera' WHEN lower(lora_path) LIKE '%lora%' THEN 'lora' END AS kind FROM {_R}",
    "r5_fastest_runs": f"SELECT {_DATASET} AS dataset, model, run_key, total_compression_time FROM {_R} WHERE total_compression_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_DATASET}, model ORDER BY total_compression_time, run_key) = 1",
    "r6_clean_results": f"SELECT run_key, CASE encoding WHEN 'huffman' THEN 'HC' WHEN 'bitpacked' THEN 'BP' ELSE encoding END AS encoding, coalesce(total_compression_time, 0) AS total_compression_time, trunc(compression_factor * 1048576)::BIGINT AS size_bytes FROM {_R}",
    "r7_model_names": f"SELECT run_key, replace(replace(string_split(model, '/')[-1], '-hf', ''), '-instruct', '') AS short, CASE WHEN lower(run_key) LIKE '%qwen2.5%' THEN 'Qwen/Qwen2.5-0.5B' WHEN lower(run_key) LIKE '%qwen3%' THEN 'Qwen/Qwen3-0.6B' WHEN lower(run_key) LIKE '%gpt2%' THEN 'gpt2' WHEN lower(run_key) LIKE '%t5%' THEN 't5' WHEN lower(run_key) LIKE '%mamba%' THEN 'state-spaces/mamba-130m-hf' ELSE 'Unknown' END AS family FROM {_R}",
    "r8_factors": f"SELECT run_key, round(original_size_bytes / nullif(final_size_bytes, 0), 6) AS compression_factor, round(final_size_bytes / nullif(original_size_bytes, 0), 6) AS size_ratio FROM {_R}",
    "r9_filter": f"SELECT run_key FROM {_R} WHERE encoding = 'AC' AND batch_size = 16",
    "r10_scaled": f"SELECT run_key, round(25 + (final_size_bytes - min(final_size_bytes) OVER ()) / (max(final_size_bytes) OVER () - min(final_size_bytes) OVER () + 1e-9) * 175, 6) AS marker FROM {_R}",
    "r11_base_models": f"SELECT model, encoding, batch_size, run_key, (row_number() OVER (PARTITION BY model, encoding ORDER BY batch_size, run_key))::INTEGER AS place FROM {_R} WHERE lora_path IS NULL AND model LIKE '%Qwen%' AND total_compression_time IS NOT NULL",
    "r13_expected_runs": f"SELECT run_key FROM {_R} WHERE encoding = 'AC' AND batch_size = 1",
    "r14_grid": f"SELECT context_length, " + ", ".join(f"round(avg(compression_factor) FILTER (batch_size = {b}), 6) AS b{b}" for b in (1, 16, 32)) + f" FROM {_R} GROUP BY context_length",
    "r16_competitors": f"WITH n AS (SELECT * FROM (VALUES ('zip', 'Zip'), ('gzip-default', 'Gzip'), ('zstd-3', 'Zstd'), ('xz-9e', 'LZMA'), ('cmix', 'CMIX'), ('qwen2.5 0.5B', 'LLM')) x(technique, shown)) SELECT shown, round(1e8::DOUBLE / size, 6) AS factor, round(1e8::DOUBLE / seconds, 3) AS speed, (row_number() OVER (ORDER BY 1e8::DOUBLE / size DESC))::INTEGER AS place FROM {_C} JOIN n USING (technique)",
    "r17_costs": f"SELECT compressor, round(seconds / 3600 * price, 9) AS cost, round(1e8::DOUBLE / size, 6) AS factor FROM {_K} WHERE compressor <> 'uncompressed'",
    "r18_service_costs": "SELECT * FROM (VALUES ('gemini-2.5-pro', 15859.125::DOUBLE), ('gpt-4o', 31468.5), ('gpt-4o-mini', 1888.11), ('self-hosted', round(242.33857129741182::DOUBLE, 6))) v(model, cost)",
    "r19_payoff": f"SELECT compressor, {_DAYS} AS days, CASE WHEN {_DAYS} >= 365 THEN printf('%.2f years', {_DAYS} / 365) ELSE printf('%.2f days', {_DAYS}) END AS shown FROM {_K}",
    "r20_cost_over_time": f"SELECT compressor, days::DOUBLE AS days, round({_COST} + 2.4e-10::DOUBLE * size * days / 365, 9) AS cost, round(2.4e-10::DOUBLE * 1e8 * days / 365 - ({_COST} + 2.4e-10::DOUBLE * size * days / 365), 9) AS saving FROM {_K}, (VALUES (1.0::DOUBLE), (30.0), (365.0), (3650.0)) g(days)",
    "r22_day_grid": "WITH t AS (SELECT (row_number() OVER (ORDER BY a) - 1)::INTEGER AS part, a AS lo, lead(a) OVER (ORDER BY a) AS hi FROM (VALUES (1.0::DOUBLE / 24 / 60), (1.0::DOUBLE / 24), (1), (30), (365), (3650), (36500), (365000), (3650000)) x(a)) SELECT part, k::INTEGER AS k, round(pow(10.0::DOUBLE, log10(lo) + (log10(hi) - log10(lo)) * k / 9), 6) AS days FROM t, range(10) r(k) WHERE hi IS NOT NULL",
    "r23_break_even": "SELECT days, round(1 / (2.4e-10::DOUBLE * days / 365 * (1 - 0.1::DOUBLE) / 0.6::DOUBLE * 3600), 3) AS gpu, round(1 / (2.4e-10::DOUBLE * days / 365 * (1 - 1 / 1.65::DOUBLE) / 0.1::DOUBLE * 3600), 3) AS cpu FROM (VALUES (1.0::DOUBLE), (30.0), (365.0)) v(days)",
    "r24_fastest_engine": f"SELECT arg_max(technique, 1e8::DOUBLE / seconds) AS fastest, count(*) AS n FROM {_C} WHERE back IS NOT NULL AND seconds > 0",
    "r26_listing": f"SELECT DISTINCT {_DATASET} AS dataset, model FROM {_R}",
    "r27_audit": f"WITH a AS (SELECT *, count(*) OVER (PARTITION BY dataset, codec) AS copies FROM {_A}) SELECT DISTINCT dataset, codec, fault FROM (SELECT dataset, codec, 'status' AS fault FROM a WHERE status NOT IN ('measured', 'preliminary', 'missing') UNION ALL SELECT dataset, codec, 'round trip' FROM a WHERE status = 'measured' AND NOT coalesce(round_trip, false) UNION ALL SELECT dataset, codec, 'dataset' FROM a WHERE dataset NOT IN ('text8', 'random', 'one') UNION ALL SELECT dataset, codec, 'repeated' FROM a WHERE copies > 1)",
    "r28_best_codec": f"SELECT dataset, arg_min(codec, (serialized * 100.0::DOUBLE / raw, codec)) AS codec, round(min(serialized * 100.0::DOUBLE / raw), 6) AS percent FROM {_A} GROUP BY dataset",
    "r29_by_model": f"SELECT model, count(*) AS n, round(avg(compression_factor), 6) AS mean, round(coalesce(stddev_samp(compression_factor), 0), 6) AS sd FROM {_R} GROUP BY model",
    "r30_missing_cells": f"WITH a AS (SELECT * FROM {_A}) SELECT d.dataset, c.codec FROM (SELECT DISTINCT dataset FROM a) d, (SELECT DISTINCT codec FROM a) c EXCEPT SELECT dataset, codec FROM a",
    "r31_sweep_summary": f"SELECT dataset, codec, count(*) AS n, round(avg(serialized * 100.0::DOUBLE / raw), 6) AS mean, round(coalesce(stddev_samp(serialized * 100.0::DOUBLE / raw), 0), 6) AS sd, CASE codec WHEN 'zstd' THEN 1 WHEN 'AC' THEN 2 ELSE 3 END AS place FROM {_A} GROUP BY dataset, codec",
    "r32_relative": f"WITH c AS (SELECT * FROM {_C}) SELECT technique, round(size / (SELECT size FROM c WHERE technique = 'gzip-9'), 6) AS relative FROM c",
    "r33_interval_histogram": "WITH h AS (SELECT lang, CASE WHEN length(text) < 100 THEN 0 WHEN length(text) < 1000 THEN 1 WHEN length(text) < 5000 THEN 2 ELSE 3 END AS place, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, place, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM h",
    "r34_equal_bins": "WITH x AS (SELECT length(text) AS x FROM documents), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT least(floor((x - lo)::DOUBLE / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS n FROM x, e GROUP BY 1",
    "r35_labels": r"WITH x AS (SELECT doc_id, strlen(text)::DOUBLE AS b FROM documents), y AS (SELECT doc_id, b, CASE WHEN b < 1024 THEN 0 WHEN b < 1024.0 ** 2 THEN 1 WHEN b < 1024.0 ** 3 THEN 2 WHEN b < 1024.0 ** 4 THEN 3 ELSE 4 END AS k FROM x), z AS (SELECT doc_id, k, b / 1024.0::DOUBLE ** k AS v FROM y) SELECT doc_id, regexp_replace(printf('%.2f', CASE WHEN v < 10 THEN round_even(v, 2) WHEN v < 100 THEN round_even(v, 1) ELSE round_even(v, 0) END), '\.?0+$', '') || (['B', 'KB', 'MB', 'GB', 'TB'])[k + 1] AS label FROM z",
    "r36_slugs": "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part",
    "r38_experiment_grid": "SELECT encoding, batch, encoding || '_b' || batch AS job FROM (VALUES ('AC'), ('huffman'), ('bitpacked')) a(encoding), (VALUES (1), (16), (32)) b(batch)",
    "r40_geometric_means": "SELECT lang, round(exp(avg(ln(length(text)))), 6) AS mean FROM documents WHERE text <> '' GROUP BY lang",
    "r41_box_numbers": "SELECT lang, " + ", ".join(f"round(quantile_cont(length(text), {q}), 6) AS {n}" for q, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"))) + " FROM documents GROUP BY lang",
    "r42_stacked": "SELECT lang, source, (sum(n) OVER (PARTITION BY lang ORDER BY source ROWS UNBOUNDED PRECEDING))::BIGINT AS top FROM (SELECT lang, source, sum(strlen(text)) AS n FROM documents GROUP BY ALL)",
    "r43_packaging_gate": "SELECT count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+') OR regexp_matches(text, '(?i)secret')) AS n_rejected, sum(strlen(text))::BIGINT AS n_bytes, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+') OR regexp_matches(text, '(?i)secret')) = 0 AND sum(strlen(text)) < 104857600 AS allowed FROM documents",
    "k3_work_list": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "v15_compatible_checkpoints": f"WITH r AS (SELECT *, regexp_extract(run_key, 'n(\\d+)$', 1)::INTEGER AS i FROM {_R}) SELECT a.run_key, a.model IS NOT DISTINCT FROM b.model AND a.encoding IS NOT DISTINCT FROM b.encoding AND a.batch_size IS NOT DISTINCT FROM b.batch_size AND a.lora_path IS NOT DISTINCT FROM b.lora_path AS compatible FROM r a JOIN r b ON b.i = a.i + 60",
    "v16_complete_conditions": "SELECT conv_id, list_sort(list_distinct(list(turn))) = range(count(DISTINCT turn)) AS complete FROM conversations GROUP BY conv_id",
    "c11_seed_costs": "WITH k AS (SELECT count(DISTINCT t) AS k FROM (SELECT unnest(string_split(text, '')) AS t FROM documents)) SELECT doc_id, (length(bin(k - 1)) * least(length(text), 4))::BIGINT AS seed_bits FROM documents, k",
}

QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "rkvc" and n[1:2].isdigit()}
