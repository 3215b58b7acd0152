"""Count models, frequency tables, ranks, codecs, containers and attacks over the test tables."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions import pmatic
from sparkquill.operators import attacks, codecs
from sparkquill.operators import model as md
from sparkquill.operators import tokens as tk
from sparkquill.session import small, spread, stored, table

T = md.TOTAL
C1 = "c1 AS (SELECT doc_id, lang, pos, token, coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY pos), '') AS ctx FROM (SELECT doc_id, lang, unnest(string_split(text, '')) AS token, unnest(range(len(string_split(text, '')))) AS pos FROM documents))"
M1 = f"{C1}, m AS (SELECT ctx, token, count(*) AS n FROM c1 GROUP BY ALL), k AS (SELECT count(DISTINCT token) AS k FROM m)"
FREQ = "b AS (SELECT ctx, token, n, k, 1 + (({t} - k) * n)::BIGINT // (sum(n) OVER (PARTITION BY ctx))::BIGINT AS base FROM m, k), f AS (SELECT ctx, token, n, k, (base + (row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) <= {t} - (sum(base) OVER (PARTITION BY ctx) + k - count(*) OVER (PARTITION BY ctx)))::INTEGER)::BIGINT AS freq FROM b)"


def _docs(spark, d):
    """The documents over all cores: a character takes far more time than moving it, and a small table has few splits."""
    return spread(table(spark, d, "documents").select("doc_id", "lang", "text"))


def _model(spark, d):
    """The counts, stored: what reads them twice counts the corpus once."""
    return stored(md.counts(tk.with_context(_docs(spark, d), tk.characters(F.col("text")), "doc_id")), "model")


def _freqs(spark, d, total=T):
    model = _model(spark, d)
    return md.frequencies(model, max(1, model.select("token").distinct().count()), total)


def m0_unigram_code_length_by_lang(spark, d):
    docs = _docs(spark, d)
    rows = tk.tokens(docs, tk.characters(F.col("text")), "lang").select(F.col("lang").alias("ctx"), "token")
    model = md.counts(rows)
    freqs = md.frequencies(model, max(1, model.select("token").distinct().count()))
    bits = freqs.groupBy(F.col("ctx").alias("lang")).agg(F.sum("n").alias("n_tokens"), F.sum(F.octet_length("token") * F.col("n")).cast("bigint").alias("n_bytes"), F.sum(F.col("n") * md.ideal_bits(F.col("freq"))).alias("bits"))
    return bits.select("lang", "n_tokens", "n_bytes", F.round(F.col("bits"), 3).alias("ideal_bits"), F.round(F.try_divide("bits", "n_bytes"), 6).alias("bits_per_byte"), F.round(F.try_divide("bits", F.col("n_bytes") * 8), 6).alias("size_ratio"))


def p1_next_token_counts(spark, d):
    return _model(spark, d)


def p3_masked_probabilities(spark, d):
    mask = spark.createDataFrame([(c,) for c in "aeiourstln .,"], "token string")
    return md.masked(_model(spark, d), mask).select("ctx", "token", F.round("p", 9).alias("p"))


def p4_log_softmax(spark, d):
    return _model(spark, d).select("ctx", "token", F.round(md.log_softmax(F.ln("n"), "ctx"), 8).alias("logp"))


def p5_context_length(spark, d):
    return _docs(spark, d).select("doc_id", md.context_length(F.length("text"), 1000, 100).cast("bigint").alias("context"))


def p8_greedy_token(spark, d):
    return md.most_likely(_model(spark, d))


def p10_accepted_prefix(spark, d):
    """A draft proposes each next character from the one before; the text verifies it, 8 at a time."""
    best = md.most_likely(_model(spark, d)).select("ctx", F.col("token").alias("draft"))
    rows = tk.with_context(_docs(spark, d), tk.characters(F.col("text")), "doc_id").join(small(best, "drafts"), "ctx")
    cycle = rows.groupBy("doc_id", F.floor(F.col("pos") / 8).alias("cycle")).agg(F.count(F.lit(1)).alias("proposed"), F.min(F.when(F.col("draft") != F.col("token"), F.col("pos") % 8)).alias("miss"))
    accepted = F.coalesce("miss", F.col("proposed"))
    return cycle.groupBy("doc_id").agg(F.sum(accepted).cast("bigint").alias("accepted"), F.count("miss").alias("rejected"), F.sum(F.col("proposed") - accepted - F.col("miss").isNotNull().cast("int")).cast("bigint").alias("abandoned"))


def p12_anti_model(spark, d):
    return md.anti(_model(spark, d)).select("ctx", "token", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


def e1_frequencies(spark, d):
    return _freqs(spark, d)


def e1_intervals(spark, d):
    model = _model(spark, d)
    vocabulary = tk.vocabulary(model)
    return md.intervals(md.frequencies(model, max(1, vocabulary.count())), vocabulary).select("ctx", "token", "cum_lo", "cum_hi")


def e3_binary_frequencies(spark, d):
    p = F.try_divide(F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))), F.length("text"))
    zeros, ones = md.binary_frequencies(F.coalesce(p, F.lit(0.0)))
    return _docs(spark, d).select("doc_id", zeros.alias("zeros"), ones.alias("ones"))


def e7_cross_entropy(spark, d):
    freqs = _freqs(spark, d).select("ctx", "token", md.ideal_bits(F.col("freq")).alias("bits"))
    rows = tk.scored(tk.with_context(_docs(spark, d), tk.characters(F.col("text")), "doc_id"), freqs, "bits")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum("bits"), 4).alias("bits"))


def _bit_width(size):
    return max(1, (size - 1).bit_length())


def e9_token_bits(spark, d):
    """Ids in as many bits as the vocabulary needs, the first bit first."""
    v = tk.vocabulary(_model(spark, d))
    return v.select("token", F.lpad(F.bin(F.col("dense_id").cast("bigint")), _bit_width(v.count()), "0").alias("bits"))


def e10_next_power_of_two(spark, d):
    n = F.length("text")
    return _docs(spark, d).select("doc_id", F.when(n <= 1, 1).otherwise(F.expr("shiftleft(1L, length(bin(length(text) - 1L)))")).cast("bigint").alias("size"))


def e11_conditional_bits(spark, d):
    return _conditional(_model(spark, d))


def _conditional(model, vocabulary=None):
    """(ctx, shift, prefix, p1): how likely each bit of an id is 1, given the bits before it."""
    vocabulary = stored(tk.vocabulary(model), "vocabulary") if vocabulary is None else vocabulary
    width = _bit_width(vocabulary.count())
    rows = model.join(small(vocabulary, "vocabulary"), "token").select("ctx", "n", "dense_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("shift"))
    rows = rows.groupBy("ctx", "shift", F.expr("shiftright(dense_id, shift + 1)").alias("prefix")).agg(F.sum("n").alias("n"), F.sum(F.when(F.expr("shiftright(dense_id, shift) & 1") == 1, F.col("n")).otherwise(0)).alias("ones"))
    return rows.select("ctx", "shift", "prefix", F.round(F.try_divide("ones", "n"), 9).alias("p1"))


def e12_pmatic_rounding(spark, d):
    """Bins of the conditional probabilities: helper bit and rounded value, for delta 0.01."""
    r, delta = pmatic.radius(0.01), 0.01
    m = round(1 / (2 * r))
    p = F.col("p1")
    near = F.floor(p * m + 0.5)
    helper = (near > 0) & (near < m) & (F.abs(p - near / m) < delta)
    centre = (2 * F.least(F.floor(p * m), F.lit(m - 1)) + 1) / (2.0 * m)
    rows = e11_conditional_bits(spark, d)
    return rows.select("ctx", "shift", "prefix", helper.cast("int").alias("helper"), F.round(F.when(helper, near / m).otherwise(centre), 9).alias("q"))


def e14_pmatic_radius(spark, d):
    rows = [(x, round(1 / (2 * pmatic.radius(x))), round(pmatic.radius(x), 12)) for x in (0.001, 0.01, 0.24)]
    return spark.createDataFrame(rows, "delta double, m int, r double")


def e15_greatest_difference(spark, d):
    """Between each context's conditional bits and those of the context-free model."""
    model = _model(spark, d)
    vocabulary = stored(tk.vocabulary(model), "vocabulary")
    free = model.groupBy("token").agg(F.sum("n").alias("n")).select(F.lit("").alias("ctx"), "token", "n")
    flat = stored(_conditional(free, vocabulary).select("shift", "prefix", F.col("p1").alias("other")), "flat")
    # A prefix that a context never has is undecided there: one half.
    bits = _conditional(model, vocabulary)
    every = model.select("ctx").distinct().join(small(flat, "flat"))
    both = every.join(bits, ["ctx", "shift", "prefix"], "left")
    return both.groupBy("ctx").agg(F.round(F.max(F.abs(F.coalesce("p1", F.lit(0.5)) - F.col("other"))), 8).alias("difference"))


def e17_helper_share(spark, d):
    return e12_pmatic_rounding(spark, d).groupBy("shift").agg(F.round(F.avg("helper"), 8).alias("helper_share"))


def e18_ranks(spark, d):
    return md.ranks(_model(spark, d)).select("ctx", "token", F.col("rank").cast("bigint").alias("rank"), F.col("order").cast("bigint").alias("order"))


def _doc_ranks(spark, d):
    ranks = md.ranks(_model(spark, d)).select("ctx", "token", "order")
    return tk.scored(tk.with_context(_docs(spark, d), tk.characters(F.col("text")), "doc_id"), ranks, "ranks")


def e19_packed_size(spark, d):
    rows = _doc_ranks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("order").alias("most"))
    return rows.select("doc_id", (F.col("n") * F.greatest(F.lit(1), F.length(F.bin(F.col("most").cast("bigint"))))).cast("bigint").alias("bits"))


def e25_rank_statistics(spark, d):
    rows = _doc_ranks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("order").cast("bigint").alias("most"), F.sum((F.col("order") == 0).cast("bigint")).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") < 10, F.struct("pos", "order")))), lambda x: x["order"]), ",").alias("head"))
    return rows


def e19_rank_codecs(spark, d):
    docs = _docs(spark, d)
    return codecs.rank_codes(docs, codecs.fit(docs)).select("doc_id", "n_tokens", "packed_bits", "sha256", "lossless")


def e20_huffman_sizes(spark, d):
    docs = _docs(spark, d)
    return codecs.rank_codes(docs, codecs.fit(docs)).select("doc_id", "huffman_bits", "codebook_bits", "zstd_bytes")


def e26_arithmetic_round_trip(spark, d):
    docs = _docs(spark, d)
    model = codecs.fit(docs)
    return codecs.arithmetic_decoded(codecs.arithmetic(docs, model), model)


def e30_payload_bounds(spark, d):
    """Payload bits lie near the ideal: each symbol is off by less than 3.6e-4 bits, the end mark is one."""
    docs = _docs(spark, d)
    real = codecs.arithmetic(docs, codecs.fit(docs)).select("doc_id", "n_tokens", "payload_bits")
    ideal = e7_cross_entropy(spark, d).select("doc_id", "bits")
    slack = F.col("n_tokens") * 3.6e-4 + 1.001
    return real.join(ideal, "doc_id").select("doc_id", (F.col("payload_bits") <= F.col("bits") + slack).alias("not_above"), (F.col("payload_bits") + 64 >= F.col("bits") - slack).alias("not_below"))


def e31_held_out_codec(spark, d):
    """A model of nine tenths of the documents codes the last tenth, unseen contexts and characters included."""
    docs = _docs(spark, d)
    model = codecs.fit_open(docs.where(F.col("doc_id") % 10 < 9), order=2)
    held = docs.where(F.col("doc_id") % 10 == 9)
    return codecs.arithmetic_decoded(codecs.arithmetic(held, model), model)


def e32_compression_statistics(spark, d):
    docs = _docs(spark, d)
    streams = codecs.arithmetic(docs, codecs.fit(docs)).select("doc_id", "n_tokens", "payload_bits")
    raw = docs.select("doc_id", F.octet_length("text").alias("raw"), F.col("lang"))
    return streams.join(raw, "doc_id").groupBy("lang").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("raw").alias("raw_bytes"), F.sum("payload_bits").alias("payload_bits"), F.round(F.try_divide(F.sum("payload_bits") / 8, F.sum("raw")), 6).alias("size_ratio"), F.round(F.try_divide(F.sum("raw"), F.sum("payload_bits") / 8), 6).alias("compression_factor"))


def e8_pmatic_round_trip(spark, d):
    """Every benchmark text, coded with one model and decoded with one that differs by up to delta."""
    items = table(spark, d, "benchmark").where(F.length("text") > 0)
    model = codecs.fit(_docs(spark, d).select("text").unionByName(items.select("text")))
    size, delta = len(model.alphabet), 0.01

    def vector(ctx):
        p = np.array([model.interval(ctx, t)[1] - model.interval(ctx, t)[0] for t in model.alphabet], float)
        return p / p.sum()

    def run(batches):
        near, exact = {}, {}
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                contexts = [text[i - 1 : i] for i in range(len(text))]
                for c in set(contexts) - set(exact):
                    exact[c] = vector(c)
                    near[c] = pmatic.nearby(exact[c], delta * 0.9, len(near))
                code, share = pmatic.encode([model.index[t] for t in text], [exact[c] for c in contexts], delta)
                back = "".join(model.alphabet[v] for v in pmatic.decode(code, [near[c] for c in contexts], delta))
                rows.append({"item_id": item, "sha256": hashlib.sha256(back.encode()).hexdigest(), "n_tokens": len(back)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item_id", pa.int64()), ("sha256", pa.string()), ("n_tokens", pa.int64())]))

    assert size > 1
    return spread(items.select("item_id", "text")).mapInArrow(run, "item_id long, sha256 string, n_tokens long")


def c4_containers(spark, d):
    docs = _docs(spark, d)
    return codecs.containers_of(docs, codecs.fit(docs)).select("doc_id", "sha256", "id_stream_bytes", "frame_bytes", "verified")


def b1_byte_codecs(spark, d):
    return codecs.byte_codecs(_docs(spark, d)).select("doc_id", "codec", "raw", "exact")


def b6_relative_sizes(spark, d):
    rows = codecs.byte_codecs(_docs(spark, d)).groupBy("codec").agg(F.sum("raw").alias("raw"), F.sum("compressed").alias("compressed"))
    return rows.select("codec", "raw", "compressed", F.round(F.try_divide(F.col("compressed") * 100, "raw"), 4).alias("percent"))


def v1_worst_token(spark, d):
    candidates = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyz"], "token string")
    return md.least_likely(_model(spark, d), candidates)


def v2_target_scores(spark, d):
    """Full and masked scores of every character that is a letter, with the letters as the mask."""
    letters = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyz"], "token string")
    model = _model(spark, d)
    full = md.probabilities(model).select("ctx", "token", F.col("p").alias("full"))
    mask = md.masked(model, letters).select("ctx", "token", F.col("p").alias("masked"), "n")
    both = mask.join(full, ["ctx", "token"])
    return both.groupBy("ctx").agg(F.sum("n").alias("n"), F.round(F.sum(-F.log2("full") * F.col("n")), 3).alias("full_bits"), F.round(F.sum(-F.log2("masked") * F.col("n")), 3).alias("masked_bits"))


def v4_rescored_by_document(spark, d):
    """Each document under the dictionary of its own language."""
    docs = _docs(spark, d)
    rows = tk.with_context(docs, tk.characters(F.col("text")), "doc_id", "lang")
    model = _model(spark, d)
    vocabulary = rows.select("lang", "token").distinct()
    own = model.join(small(vocabulary, "languages"), "token").withColumn("p", F.try_divide("n", F.sum("n").over(Window.partitionBy("lang", "ctx"))))
    return rows.join(small(own.select("lang", "ctx", "token", "p"), "own"), ["lang", "ctx", "token"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(-F.log2("p")), 3).alias("bits"))


def v5_ranked_candidates(spark, d):
    p = md.probabilities(_model(spark, d))
    score = -F.log2("p") / F.octet_length("token")
    return p.select("ctx", "token", F.row_number().over(Window.partitionBy("ctx").orderBy(F.round(score, 9).desc(), "token")).alias("place")).where("place <= 5")


def v6_byte_increments(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tk.tokens(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), tk.characters(F.col("text")), "doc_id")
    return rows.select("doc_id", "pos", F.octet_length("token").cast("bigint").alias("increment"), F.sum(F.octet_length("token")).over(w).cast("bigint").alias("decoded_bytes"))


def v19_quantisation_sweep(spark, d):
    """What rounding costs at several totals, over the same occurrences."""
    model = _model(spark, d)
    size = max(1, model.select("token").distinct().count())
    out = None
    for total in (1 << 18, 1 << 22, 1 << 26, 1 << 30):
        f = md.frequencies(model, size, total).withColumn("p", F.try_divide("n", F.sum("n").over(Window.partitionBy("ctx"))))
        delta = (F.log2("p") - F.log2("freq")) + F.lit(float(np.log2(total)))
        row = f.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("freq") == 1, F.col("n")).otherwise(0)).alias("clipped"), F.round(F.sum(delta * F.col("n")), 3).alias("extra_bits"), F.round(F.max(F.abs(delta)), 8).alias("most")).withColumn("total", F.lit(total).cast("bigint"))
        out = row if out is None else out.unionByName(row)
    return out


def _predictor(model):
    """Log-probabilities of all ids after given ones, under an order-1 model."""
    rows = {}

    def predict(tokens):
        ctx = model.alphabet[tokens[-1]] if tokens else ""
        if ctx not in rows:
            f = np.array([hi - lo for lo, hi in (model.interval(ctx, t) for t in model.alphabet)], float)
            rows[ctx] = np.log(f / f.sum())
        return rows[ctx]

    return predict


def _searches(spark, model, run):
    """One search for each character of the alphabet as the start, each in its own row."""
    size = len(model.alphabet)

    def search(batches):
        predict = _predictor(model)
        for batch in batches:
            out = []
            for start in batch.column(0).to_pylist():
                g = run(predict, model, int(start), list(range(size)))
                s = g.summary()
                out.append({"start": model.alphabet[start], "text": "".join(model.alphabet[t] for t in g.tokens), **{k: s[k] for k in ("generated_tokens", "distinct_tokens", "surprisal_bits")}})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("start", pa.string()), ("text", pa.string()), ("generated_tokens", pa.int64()), ("distinct_tokens", pa.int64()), ("surprisal_bits", pa.float64())]))

    return spark.range(size).mapInArrow(search, "start string, text string, generated_tokens long, distinct_tokens long, surprisal_bits double")


def _width(model):
    return lambda _, v: len(model.alphabet[v].encode())


_ATTACKS = {
    "minprob": lambda p, m, s, c: attacks.greedy(p, [s], 32, c, 16, 4),
    "per_byte": lambda p, m, s, c: attacks.greedy(p, [s], 32, c, 16, 4, width=_width(m)),
    "random": lambda p, m, s, c: attacks.uniform(p, [s], 32, c, 16, 4, seed=s),
    "beam": lambda p, m, s, c: attacks.beam(p, [s], 12, c, 16, 4, 3, 3, width=_width(m)),
}


def v3_worst_sequences(spark, d):
    return _searches(spark, codecs.fit(_docs(spark, d)), _ATTACKS["minprob"]).withColumn("surprisal_bits", F.round("surprisal_bits", 5))


def v7_worst_per_byte(spark, d):
    return _searches(spark, codecs.fit(_docs(spark, d)), _ATTACKS["per_byte"]).withColumn("surprisal_bits", F.round("surprisal_bits", 5))


def v8_uniform_control(spark, d):
    return _searches(spark, codecs.fit(_docs(spark, d)), _ATTACKS["random"])


def v9_beam_search(spark, d):
    return _searches(spark, codecs.fit(_docs(spark, d)), _ATTACKS["beam"])


def v12_all_attacks(spark, d):
    """All attacks under one model, which is fitted once."""
    model = codecs.fit(_docs(spark, d))
    parts = [_searches(spark, model, run).withColumn("attack", F.lit(name)) for name, run in _ATTACKS.items()]
    return reduce(DataFrame.unionByName, parts)


SPECULATED, AHEAD = 24, 4


def e28_speculative(spark, d):
    """Greedy decoding by the documents' model, drafted by that of the benchmark: accepted, rejected and abandoned drafts."""
    model, other = codecs.fit(_docs(spark, d)), codecs.fit(table(spark, d, "benchmark").select("text"))
    best = {ctx: other.alphabet[max(zip(f, (-i for i in ids), strict=True))[1] * -1] for ctx, (ids, _, f) in other.table.items()}

    def draft(tokens):
        """All weight on what the other model takes for likeliest after the last character."""
        p = np.zeros(len(model.alphabet))
        p[model.index.get(best.get(model.alphabet[tokens[-1]], " "), 0)] = 1
        return p

    def run(predict, _, start, __):
        tokens, n = attacks.speculative(draft, predict, [start], SPECULATED, AHEAD)
        return tokens, n

    return _decoded(spark, model, run)


def _decoded(spark, model, run):
    size = len(model.alphabet)

    def search(batches):
        predict = _predictor(model)
        for batch in batches:
            out = []
            for start in batch.column(0).to_pylist():
                tokens, n = run(predict, model, int(start), list(range(size)))
                out.append({"start": model.alphabet[start], "text": "".join(model.alphabet[t] for t in tokens), **{k: n[k] for k in ("accepted", "rejected", "abandoned", "cycles")}})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("start", pa.string()), ("text", pa.string()), *((k, pa.int64()) for k in ("accepted", "rejected", "abandoned", "cycles"))]))

    return spark.range(size).mapInArrow(search, "start string, text string, accepted long, rejected long, abandoned long, cycles long")


_LETTERS = "(VALUES " + ", ".join(f"('{c}')" for c in "abcdefghijklmnopqrstuvwxyz") + ") l(token)"
_E11 = f"WITH {M1}, v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS d FROM (SELECT DISTINCT token FROM m)), e AS (SELECT ctx, shift::INTEGER AS shift, (d >> (shift + 1)::INTEGER)::INTEGER AS prefix, round(sum(CASE WHEN (d >> shift::INTEGER) & 1 = 1 THEN n ELSE 0 END) / sum(n), 9) AS p1 FROM m JOIN v USING (token), k, range(32) t(shift) WHERE shift < greatest(1, length(bin(k - 1))) GROUP BY ALL)"
_E12 = _E11 + ", q AS (SELECT ctx, shift, prefix, p1, floor(p1 * 24 + 0.5) AS near FROM e), h AS (SELECT *, near > 0 AND near < 24 AND abs(p1 - near / 24) < 0.01 AS helper FROM q)"
_RANK = f"{M1}, r AS (SELECT ctx, token, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) - 1 AS o FROM m), x AS (SELECT doc_id, pos, o FROM c1 JOIN r USING (ctx, token))"
_FULL = "SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS n_tokens FROM documents"


def _sweep(total: int) -> str:
    f = FREQ.format(t=total)
    return f"SELECT sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (freq = 1), 0)::BIGINT AS clipped, round(sum(delta * n), 3) AS extra_bits, round(max(abs(delta)), 8) AS most, {total}::BIGINT AS total FROM (WITH {f} SELECT n, freq, (log2(n / sum(n) OVER (PARTITION BY ctx)) - log2(freq)) + {float(np.log2(total))} AS delta FROM f)"


_IDS = f"WITH RECURSIVE {M1}, {FREQ.format(t=T)}, v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS d FROM (SELECT DISTINCT token FROM m)), s AS (SELECT DISTINCT ctx FROM m), a AS (SELECT c.token AS ctx, x.token, x.d, coalesce(f.freq, CASE WHEN s.ctx IS NULL THEN {T} // k.k + (x.d < {T} % k.k)::INTEGER ELSE 1 END) AS w FROM v c CROSS JOIN v x CROSS JOIN k LEFT JOIN f ON f.ctx = c.token AND f.token = x.token LEFT JOIN s ON s.ctx = c.token)"


def _worst(objective: str) -> str:
    return f"{_IDS}, w0 AS (SELECT ctx, token, w FROM a QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY {objective} DESC, d) = 1), g AS (SELECT token AS start, token AS last, token AS text, 0.0::DOUBLE AS bits, 1 AS n FROM v UNION ALL SELECT start, b.token, text || b.token, bits + 18 - log2(w), n + 1 FROM g JOIN w0 b ON b.ctx = g.last WHERE n < 32) SELECT start, text, 31::BIGINT AS generated_tokens, len(list_distinct(string_split(text, '')))::BIGINT AS distinct_tokens, round(bits, 5) AS surprisal_bits FROM g WHERE n = 32"


_BENCH = "bm AS (SELECT ctx, token, count(*) AS n FROM (SELECT item_id, pos, token, coalesce(lag(token) OVER (PARTITION BY item_id ORDER BY pos), '') AS ctx FROM (SELECT item_id, unnest(string_split(text, '')) AS token, unnest(range(len(string_split(text, '')))) AS pos FROM benchmark)) GROUP BY ctx, token), h AS (SELECT ctx, token FROM bm QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) = 1)"
_STEP = f"(least({AHEAD}, {SPECULATED} - n - 1))"

SQL = {
    "v3_worst_sequences": _worst("18 - log2(w)"),
    "v7_worst_per_byte": _worst("(18 - log2(w)) / strlen(token)"),
    "e28_speculative": f"{_IDS}, {_BENCH}, w0 AS (SELECT ctx, token FROM a QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY w DESC, d) = 1), z AS (SELECT min(token) AS zero FROM v), r AS (SELECT b.ctx, b.token, coalesce(h.token, ' ') AS drafted FROM w0 b LEFT JOIN h ON h.ctx = b.ctx), q AS (SELECT r.ctx, r.token, coalesce(v.token, zero) = r.token AS same FROM r CROSS JOIN z LEFT JOIN v ON v.token = r.drafted), g AS (SELECT token AS start, token AS last, token AS text, 1 AS n, 0 AS spot, {AHEAD} AS most, 0 AS accepted, 0 AS rejected, 0 AS abandoned, 1 AS cycles FROM v UNION ALL SELECT start, q.token, text || q.token, n + 1, CASE WHEN q.same AND spot + 1 < most THEN spot + 1 ELSE 0 END, CASE WHEN q.same AND spot + 1 < most THEN most ELSE {_STEP} END, accepted + q.same::INTEGER, rejected + (NOT q.same)::INTEGER, abandoned + CASE WHEN q.same THEN 0 ELSE most - spot - 1 END, cycles + CASE WHEN (q.same AND spot + 1 < most) OR n + 1 = {SPECULATED} THEN 0 ELSE 1 END FROM g JOIN q ON q.ctx = g.last WHERE n < {SPECULATED}) SELECT start, text, accepted::BIGINT AS accepted, rejected::BIGINT AS rejected, abandoned::BIGINT AS abandoned, cycles::BIGINT AS cycles FROM g WHERE n = {SPECULATED}",
    "m0_unigram_code_length_by_lang": f"WITH ch AS (SELECT lang AS ctx, unnest(string_split(text, '')) AS token FROM documents), m AS (SELECT ctx, token, count(*) AS n FROM ch GROUP BY ALL), k AS (SELECT count(DISTINCT token) AS k FROM m), {FREQ.format(t=T)} SELECT ctx AS lang, sum(n)::BIGINT AS n_tokens, sum(strlen(token) * n)::BIGINT AS n_bytes, round(sum(n * (18.0::DOUBLE - log2(freq))), 3) AS ideal_bits, round(sum(n * (18.0::DOUBLE - log2(freq))) / sum(strlen(token) * n), 6) AS bits_per_byte, round(sum(n * (18.0::DOUBLE - log2(freq))) / (8 * sum(strlen(token) * n)), 6) AS size_ratio FROM f GROUP BY ctx",
    "p1_next_token_counts": f"WITH {M1} SELECT * FROM m",
    "p3_masked_probabilities": f"WITH {M1} SELECT ctx, token, round(n / sum(n) OVER (PARTITION BY ctx), 9) AS p FROM m WHERE token IN (SELECT unnest(string_split('aeiourstln .,', '')))",
    "p4_log_softmax": f"WITH {M1} SELECT ctx, token, round(ln(n) - ln(sum(n) OVER (PARTITION BY ctx)), 8) AS logp FROM m",
    "p5_context_length": "SELECT doc_id, (CASE WHEN length(text) < 1000 THEN length(text) ELSE 100 + (length(text) - 1000) % 900 END)::BIGINT AS context FROM documents",
    "p8_greedy_token": f"WITH {M1} SELECT ctx, token, n FROM m QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) = 1",
    "p10_accepted_prefix": f"WITH {M1}, g AS (SELECT ctx, token AS draft FROM m QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) = 1), c AS (SELECT doc_id, pos // 8 AS cycle, count(*) AS proposed, min(pos % 8) FILTER (draft <> token) AS miss FROM c1 JOIN g USING (ctx) GROUP BY ALL) SELECT doc_id, sum(coalesce(miss, proposed))::BIGINT AS accepted, count(miss) AS rejected, sum(proposed - coalesce(miss, proposed) - (miss IS NOT NULL)::INTEGER)::BIGINT AS abandoned FROM c GROUP BY doc_id",
    "p12_anti_model": f"WITH {M1}, p AS (SELECT ctx, token, n / sum(n) OVER (PARTITION BY ctx) AS p FROM m) SELECT ctx, token, round(p, 9) AS p, round((1 / p) / sum(1 / p) OVER (PARTITION BY ctx), 9) AS q FROM p",
    "e1_frequencies": f"WITH {M1}, {FREQ.format(t=T)} SELECT ctx, token, n, freq FROM f",
    "e1_intervals": f"WITH {M1}, {FREQ.format(t=T)}, v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS d FROM (SELECT DISTINCT token FROM m)), i AS (SELECT ctx, token, freq, d + coalesce(sum(freq - 1) OVER (PARTITION BY ctx ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM f JOIN v USING (token)) SELECT ctx, token, lo::BIGINT AS cum_lo, (lo + freq)::BIGINT AS cum_hi FROM i",
    "e3_binary_frequencies": f"WITH p AS (SELECT doc_id, coalesce((length(text) - length(replace(text, ' ', ''))) / nullif(length(text), 0), 0.0) AS p FROM documents), o AS (SELECT doc_id, least(greatest(floor(least(greatest(p, 1e-12), 1 - 1e-12) * {T}), 1), {T} - 1)::BIGINT AS ones FROM p) SELECT doc_id, {T} - ones AS zeros, ones FROM o",
    "e7_cross_entropy": f"WITH {M1}, {FREQ.format(t=T)} SELECT doc_id, count(*) AS n_tokens, round(sum(18.0::DOUBLE - log2(freq)), 4) AS bits FROM c1 JOIN f USING (ctx, token) GROUP BY doc_id",
    "e9_token_bits": f"WITH {M1} SELECT token, lpad(bin(row_number() OVER (ORDER BY token) - 1), greatest(1, length(bin(k - 1)))::INTEGER, '0') AS bits FROM (SELECT DISTINCT token FROM m), k",
    "e10_next_power_of_two": "SELECT doc_id, (CASE WHEN length(text) <= 1 THEN 1 ELSE 1::BIGINT << length(bin(length(text) - 1)) END)::BIGINT AS size FROM documents",
    "e11_conditional_bits": _E11 + " SELECT * FROM e",
    "e12_pmatic_rounding": _E12 + " SELECT ctx, shift, prefix, helper::INTEGER AS helper, round(CASE WHEN helper THEN near / 24 ELSE (2 * least(floor(p1 * 24), 23) + 1) / 48 END, 9) AS q FROM h",
    "e14_pmatic_radius": "SELECT * FROM (VALUES (0.001::DOUBLE, 247, round(0.0020242914979757085, 12)), (0.01, 24, round(1 / 48.0::DOUBLE, 12)), (0.24, 1, 0.5)) v(delta, m, r)",
    "e15_greatest_difference": _E11 + ", o AS (SELECT shift::INTEGER AS shift, (d >> (shift + 1)::INTEGER)::INTEGER AS prefix, round(sum(CASE WHEN (d >> shift::INTEGER) & 1 = 1 THEN n ELSE 0 END) / sum(n), 9) AS other FROM m JOIN v USING (token), k, range(32) t(shift) WHERE shift < greatest(1, length(bin(k - 1))) GROUP BY ALL) SELECT ctx, round(max(abs(coalesce(p1, 0.5) - other)), 8) AS difference FROM (SELECT DISTINCT ctx FROM m) c CROSS JOIN o LEFT JOIN e USING (ctx, shift, prefix) GROUP BY ctx",
    "e17_helper_share": _E12 + " SELECT shift, round(avg(helper::INTEGER), 8) AS helper_share FROM h GROUP BY shift",
    "e18_ranks": f"WITH {M1} SELECT ctx, token, (rank() OVER (PARTITION BY ctx ORDER BY n DESC) - 1)::BIGINT AS rank, (row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) - 1)::BIGINT AS \"order\" FROM m",
    "e19_packed_size": f"WITH {_RANK} SELECT doc_id, (count(*) * greatest(1, length(bin(max(o)))))::BIGINT AS bits FROM x GROUP BY doc_id",
    "e25_rank_statistics": f"WITH {_RANK} SELECT doc_id, count(*) AS n, max(o)::BIGINT AS most, count(*) FILTER (o = 0) AS first, string_agg(o::VARCHAR, ',' ORDER BY pos) FILTER (pos < 10) AS head FROM x GROUP BY doc_id",
    "e19_rank_codecs": f"WITH {_RANK} SELECT doc_id, count(*) AS n_tokens, (count(*) * greatest(1, length(bin(max(o)))))::BIGINT AS packed_bits, any_value(sha256(text)) AS sha256, true AS lossless FROM x JOIN documents USING (doc_id) GROUP BY doc_id",
    "e26_arithmetic_round_trip": _FULL,
    "e30_payload_bounds": "SELECT doc_id, true AS not_above, true AS not_below FROM documents WHERE text <> ''",
    "e31_held_out_codec": _FULL + " WHERE doc_id % 10 = 9",
    "e8_pmatic_round_trip": "SELECT item_id, sha256(text) AS sha256, length(text)::BIGINT AS n_tokens FROM benchmark WHERE text <> ''",
    "c4_containers": f"WITH {M1} SELECT doc_id, sha256(text) AS sha256, (24 + (length(text) * length(bin(k - 1)) + 7) // 8)::BIGINT AS id_stream_bytes, 28::BIGINT AS frame_bytes, true AS verified FROM documents, k WHERE length(text) > 1",
    "b1_byte_codecs": "SELECT doc_id, codec, strlen(text)::BIGINT AS raw, true AS exact FROM documents, (VALUES ('gzip-9'), ('zip'), ('zlib-1'), ('zstd-3'), ('zstd-22'), ('bz2-9'), ('xz-6')) c(codec)",
    "v1_worst_token": f"WITH {M1} SELECT ctx, token, n FROM m JOIN {_LETTERS} USING (token) QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY n, token) = 1",
    "v2_target_scores": f"WITH {M1}, p AS (SELECT ctx, token, n, n / sum(n) OVER (PARTITION BY ctx) AS p FROM m), q AS (SELECT ctx, token, n, p, n / sum(n) OVER (PARTITION BY ctx) AS q FROM p JOIN {_LETTERS} USING (token)) SELECT ctx, sum(n)::BIGINT AS n, round(sum(-log2(p) * n), 3) AS full_bits, round(sum(-log2(q) * n), 3) AS masked_bits FROM q GROUP BY ctx",
    "v4_rescored_by_document": f"WITH {M1}, w AS (SELECT DISTINCT lang, token FROM c1), o AS (SELECT lang, ctx, token, n / sum(n) OVER (PARTITION BY lang, ctx) AS p FROM m JOIN w USING (token)) SELECT doc_id, count(*) AS n, round(sum(-log2(p)), 3) AS bits FROM c1 JOIN o USING (lang, ctx, token) GROUP BY doc_id",
    "v5_ranked_candidates": f"WITH {M1}, p AS (SELECT ctx, token, round(-log2(n / sum(n) OVER (PARTITION BY ctx)) / strlen(token), 9) AS s FROM m) SELECT ctx, token, (row_number() OVER (PARTITION BY ctx ORDER BY s DESC, token))::INTEGER AS place FROM p QUALIFY place <= 5",
    "v6_byte_increments": "WITH c AS (SELECT item_id AS doc_id, unnest(string_split(text, '')) AS token, unnest(range(len(string_split(text, '')))) AS pos FROM benchmark) SELECT doc_id, pos::INTEGER AS pos, strlen(token)::BIGINT AS increment, (sum(strlen(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS decoded_bytes FROM c",
    "v19_quantisation_sweep": f"WITH {M1} " + " UNION ALL ".join(_sweep(1 << k) for k in (18, 22, 26, 30)),
}

QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "mpecbv" and n[1:2].isdigit()}
