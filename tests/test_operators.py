import hashlib
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquill import streaming
from sparkquill.functions import bits, merges
from sparkquill.functions.merges import Learner
from sparkquill.operators import bpe, codecs
from sparkquill.operators import model as md
from sparkquill.operators import tokens as tk
from sparkquill.plans import source_queries, token_queries


def test_lanes_against_a_plain_split(spark):
    for n in (0, 1, 5, 8, 9, 23):
        rows = spark.range(n).select(F.col("id"), *(c.alias(a) for c, a in zip(tk.lanes(F.col("id"), F.lit(n).cast("bigint"), 8), ("lane", "at"), strict=True))).collect()
        want, at = [], 0
        for lane in range(8):
            size = n // 8 + (lane < n % 8)
            want += [(at + k, lane, k) for k in range(size)]
            at += size
        assert sorted(map(tuple, rows)) == want


def test_context_length_follows_the_loop(spark):
    rows = spark.range(1, 60).select("id", md.context_length(F.col("id"), 10, 3).alias("n")).collect()
    held, want = 0, {}
    for seen in range(1, 60):
        held = held + 1 if held + 1 < 10 else 3
        want[seen] = held
    assert {r.id: r.n for r in rows} == want


def test_frequencies_fill_the_total_and_guard_the_alphabet(spark):
    model = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("a", "z", 1), ("b", "x", 1)], "ctx string, token string, n bigint")
    rows = md.frequencies(model, 10, 64).collect()
    for ctx, seen in (("a", 3), ("b", 1)):
        assert sum(r.freq for r in rows if r.ctx == ctx) + 10 - seen == 64
    assert min(r.freq for r in rows) >= 1
    with pytest.raises(ValueError):
        md.frequencies(model, 100, 64)


def test_bitmap_round_trip(spark):
    ids = spark.createDataFrame([(1, x) for x in (0, 1, 7, 8, 32767, 32768, 32769, 151642)] + [(2, 5)], "k int, id bigint")
    assert sorted(map(tuple, tk.bitmap_ids(tk.bitmap(ids, "k"), "k").collect())) == sorted(map(tuple, ids.collect()))


def test_pair_keys_are_exact(spark):
    signs = ["", "\0", "a", "\U0010ffff", "\ue000", "é"]
    pairs = spark.createDataFrame([(a, b) for a in signs for b in signs[1:]], "ctx string, token string")
    assert pairs.select(tk.pair_key()).distinct().count() == pairs.count() == 30
    facts = pairs.withColumn("fact", F.concat("ctx", F.lit("|"), "token"))
    assert all(r.fact == f"{r.ctx}|{r.token}" for r in tk.scored(pairs, facts, "facts").collect())


def test_decoded_blocks_shuffle_text_and_keep_rows_of_one_id(spark, tmp_path):
    rows = [(1, "ab\nc\U0001f600é"), (1, "xyz"), (2, ""), (3, None), (None, "\r\n q"), (4, "é\U0001f600" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 2, 3, 4096):
        blocks = tk.character_blocks(docs.withColumn("row", F.monotonically_increasing_id()), F.col("text"), "doc_id", "row", size=size)
        back = tk.decoded_blocks(blocks, "doc_id", "row")
        assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((k or 0, x) for k, x in rows if x)
    assert max(len(r.tokens) for r in blocks.collect()) == 4096
    docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = token_queries.t6_decode_round_trip(spark, str(tmp_path))
    assert sorted(r.sha256 for r in got.collect()) == sorted(hashlib.sha256(x.encode()).hexdigest() for _, x in rows if x)


def test_bpe_against_a_plain_trainer(spark):
    draw = random.Random(2)
    docs = [" ".join("".join(draw.choice("abcé") for _ in range(draw.randint(1, 6))) for _ in range(30)) for _ in range(20)] + ["aaaa aaaaa", "", "\x02\x03 \x02\x03"]
    table = spark.createDataFrame([(x,) for x in docs], "text string")
    words = {}
    for x in docs:
        for i, w in enumerate(x.split()):
            key = tuple(bpe.lettered(" " * (i > 0) + w))
            words[key] = words.get(key, 0) + 1
    merges = []
    for _ in range(30):
        pairs = {}
        for w, n in words.items():
            for p in zip(w, w[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + n
        best = min((p for p in pairs if pairs[p] >= 2), key=lambda p: (-pairs[p], p), default=None)
        if best is None:
            break
        merges.append(best)
        new = {}
        for w, n in words.items():
            out, i = [], 0
            while i < len(w):
                if w[i : i + 2] == best:
                    out.append(w[i] + w[i + 1])
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            new[tuple(out)] = new.get(tuple(out), 0) + n
        words = new
    size = 257 + 30
    assert bpe.learn(table, size) == merges
    assert bpe.learn(table, 257 + 10, words=5, keep_every=3) == merges[:10]  # over the bound, by aggregation
    with pytest.raises(ValueError):
        bpe.learn(table, 200)
    ranks = {p: i for i, p in enumerate(merges)}
    for w in words:
        text = bpe.unlettered(list(w))
        assert tuple(bpe.encode_word(text, ranks)) == w and bpe.unlettered(bpe.encode_word(text, ranks)) == text
    assert bpe.encode_word("", ranks) == [] and len(bpe.encode_word("ab" * 50_000, ranks)) < 100_000


@pytest.fixture(scope="module")
def many_words(spark, tmp_path_factory):
    """Tables whose documents hold 2,100,000 distinct words, more than the driver once took."""
    at = str(tmp_path_factory.mktemp("many"))
    numbers = F.transform(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999), lambda x: x.cast("string"))
    spark.range(2100).select(F.col("id").alias("doc_id"), F.array_join(numbers, " ").alias("text")).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "12 99 \u00e9t\u00e9"), (2, ""), (3, "  20999 1 ")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def _no_job_a_merge(*_):
    raise AssertionError("a job for each merge")


def test_bpe_learns_from_millions_of_words_without_a_job_a_merge(spark, many_words, monkeypatch):
    monkeypatch.setattr(bpe, "_learn_apart", _no_job_a_merge)
    pairs = {}
    for x in range(2_100_000):
        w = " " * (x % 1000 > 0) + str(x)
        for p in zip(w, w[1:], strict=False):
            pairs[p] = pairs.get(p, 0) + 1
    a, b = min(pairs, key=lambda p: (-pairs[p], bpe.lettered(p[0]), p[1]))
    merges = bpe.learn(spark.read.parquet(f"{many_words}/documents.parquet"), 257 + 5)
    assert len(merges) == 5 and merges[0] == (bpe.lettered(a), b)


def test_fertility_counts_the_corpus_once(spark, tmp_path, monkeypatch):
    texts = ["low lower lowest", "", None, "\u00e9t\u00e9 low \U0001f600", "low low  lower"]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts, calls = bpe.word_counts, []
    monkeypatch.setattr(bpe, "word_counts", lambda *a: calls.append(a) or counts(*a))
    row = token_queries.t5_bpe_fertility(spark, str(tmp_path)).first()
    assert len(calls) == 1
    ranks = {p: i for i, p in enumerate(bpe.learn(spark.createDataFrame([(x,) for x in texts], "text string")))}
    words = [" " * (i > 0) + w for x in texts if x for i, w in enumerate(x.split())]
    assert row.asDict() == {"n_words": len(words), "n_pieces": sum(len(bpe.encode_word(w, ranks)) for w in words), "n_chars": sum(map(len, words)), "n_bytes": sum(len(w.encode()) for w in words), "round_trip": True}


def test_local_round_trip_over_millions_of_words(spark, many_words, monkeypatch):
    monkeypatch.setattr(bpe, "_learn_apart", _no_job_a_merge)
    monkeypatch.setattr(source_queries.bpe, "learn", lambda docs, size, learn=bpe.learn: learn(docs, size - 1700))  # 43 merges are enough here
    got = source_queries.t18_local_round_trip(spark, many_words).collect()
    assert sorted(r.item_id for r in got) == [1, 2, 3]
    assert all(r.whole and r.local and r.changed_local == r.changed_whole for r in got)


def test_words_are_counted_before_they_are_dealt_out(spark, monkeypatch):
    odd = ["", None, "  ", " a", "a a  a ", "x\u00a0y \u0085w"] + [f"{chr(i)}k\u00e9{chr(i)}{chr(i)}k k{chr(i)} " for i in range(300)]
    docs = spark.createDataFrame([(x,) for x in odd], "text string").coalesce(2)
    counted = bpe.word_counts(docs)
    assert "Generate" not in counted._jdf.queryExecution().toString()  # no row for each place of a word
    words = F.transform(tk.word_array(F.col("text")), lambda w, i: F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w))
    want = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))
    texts = pa.array(odd * 3)
    for most in (1, 7, 100, 1 << 20):  # slices keep every text, and their bytes to the bound
        parts = list(bpe._slices(texts.slice(5), most))
        assert pa.concat_arrays(parts).equals(texts.slice(5))
        assert all(len(p) == 1 or sum(len((x or "").encode()) for x in p.to_pylist()) <= most for p in parts)


def test_learner_counts_pairs_in_a_table(monkeypatch):
    words = {"".join(x): 1 + i % 7 for i, x in enumerate(itertools.product("abc", repeat=6))}
    blobs = [(w.encode() + b"\n", [n], [len(w) + 1]) for w, n in words.items()]
    slots = sum(x[2][0] for x in blobs)
    make = lambda **how: Learner(slots, blobs, bpe.LETTERS, 10, 256 + 60, 64, 50, 2, **how)
    assert make().learn(60, 2) == make(table=0).learn(60, 2) == make(table=70_000).learn(60, 2)
    learner = make()
    monkeypatch.setattr(merges, "_groups", None)  # nothing is sorted to count all pairs
    assert learner._phase(2)


def test_round_trip_check_encodes_a_word_once_and_takes_long_words(spark, tmp_path, monkeypatch):
    ranks, calls, encode = {("a", "b"): 0}, [], bpe.encode_word
    monkeypatch.setattr(bpe, "encode_word", lambda w, r: calls.append(w) or encode(w, r))
    known, text = {}, " ".join(["ab", "b", "ab"] * 50)
    pieces = bpe.encode_text(text, ranks, known)
    assert bpe.canonical_words(text, pieces, ranks, known) and sorted(calls) == [" ab", " b", "ab"]
    assert bpe.canonical_words(text, ["a", "b", *pieces[1:]], ranks, known) is False
    assert bpe.canonical_words(text, pieces[:-1], ranks, known) is None and bpe.canonical_words(text, [*pieces, "a"], ranks, known) is False
    assert bpe.canonical_words("ab b", ["ab" + bpe.lettered(" b")], ranks, known) is None
    monkeypatch.setattr(bpe, "KNOWN", 2)
    assert bpe.encode_text(text, ranks, known := {}) == pieces and len(known) <= 2
    long = "ab" * 100_000  # some hundred times as long before, when each piece summed up those before it
    assert bpe.canonical_words(long, ["a", "b"] * 100_000, {}, {}) and bpe.canonical_words(long, ["a", "b"] * 100_000, ranks, {}) is False
    spark.createDataFrame([(i, text) for i in range(40)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/items")
    got = bpe.round_trips(spark.read.parquet(f"{tmp_path}/items"), "item_id", [("a", "b")])
    assert got.select(F.spark_partition_id()).distinct().count() > 1 and all(r[1:] == (len(pieces), True, True, False, False) for r in got.collect())


def test_learner_keeps_exact_counts_in_many_phases():
    draw = random.Random(5)
    for step, places, part in ((5, 1, 1), (64, 50, 3), (1 << 20, 1 << 20, 16)):
        words = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 9))): draw.randint(1, 4) for _ in range(60)}
        blobs = [(w.encode() + b"\n", [n], [len(w) + 1]) for w, n in words.items()]
        learner = Learner(sum(x[2][0] for x in blobs), blobs, bpe.LETTERS, 10, 256 + 40, step, places, part)
        learner.most = places
        split, want = {w: list(w) for w in words}, []
        for k in range(40):
            pairs = {}
            for w, n in words.items():
                for p in zip(split[w], split[w][1:], strict=False):
                    pairs[p] = pairs.get(p, 0) + n
            if k == 4:  # what a pass finds again changes nothing
                fresh = Learner(learner.slots.size - 1, blobs, bpe.LETTERS, 10, 256 + 40, step, 1 << 20, 10**9)
                assert fresh.learn(4, 2) == want
                before = dict(fresh.n)
                fresh._again(fresh.ids["".join(want[-1])])
                own = lambda n: {(fresh.names[k >> 32], fresh.names[k & 0xFFFFFFFF]): x for k, x in n.items() if x >= 2}
                assert own(fresh.n) == own(before) == {p: n for p, n in pairs.items() if n >= 2}
            best = min((p for p in pairs if pairs[p] >= 2), key=lambda p: (-pairs[p], p), default=None)
            if best is None:
                break
            want.append(best)
            for w, x in split.items():
                i, out = 0, []
                while i < len(x):
                    both = tuple(x[i : i + 2]) == best
                    out.append("".join(x[i : i + 1 + both]))
                    i += 1 + both
                split[w] = out
        assert learner.learn(40, 2) == want


def test_codec_over_seen_and_unseen(spark):
    docs = spark.createDataFrame([(1, "abracadabra"), (2, ""), (3, "banana band"), (4, "a")], "doc_id long, text string")
    for order in (0, 1, 2):
        model = codecs.fit(docs, order, 1 << 12)
        model.alphabet += ["é"]
        model.table = {}
        model.__post_init__()
        assert codecs.decode_text(model, codecs.encode_text(model, "éab"), 3) == "éab"
        model = codecs.fit(docs, order, 1 << 12)
        for text in ("abracadabra", "", "dcba nnr", "banana"):
            assert codecs.decode_text(model, codecs.encode_text(model, text), len(text)) == text
            assert codecs.unranked(model, codecs.rank_stream(model, text)) == text
    # A table that would be too large has a lower order; no text is lost by that.
    low = codecs.fit(docs, 2, 1 << 12, rows=12)
    assert low.order == 0 and codecs.decode_text(low, codecs.encode_text(low, "banana"), 6) == "banana"


def test_interval_arrays_are_the_model(spark):
    draw = random.Random(3)
    texts = ["abracadabra", "", "banana bänd", "a", "日本 b"] + ["".join(draw.choice("ab cän日") for _ in range(draw.randrange(60))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts[:20])) + [(None, None)], "doc_id long, text string")
    for order in (0, 1, 2):
        model = codecs.fit(docs, order, 1 << 12)
        arrays = codecs.intervals_of(model)
        for text in texts:
            symbols = arrays.symbols(text)
            low, high = arrays.interval(arrays.contexts(symbols), symbols)
            assert list(zip(low.tolist(), high.tolist(), strict=True)) == [model.interval(model.context(text, i), c) for i, c in enumerate(text)]
            assert arrays.ranks(arrays.contexts(symbols), symbols).tolist() == [model.ranks(model.context(text, i))[1][model.index[c]] for i, c in enumerate(text)] == codecs.rank_stream(model, text)
            for slot in (low, high - 1):
                found, a, b = arrays.find(arrays.contexts(symbols), slot)
                assert (found == symbols).all() and (a == low).all() and (b == high).all()
        coded = codecs.arithmetic(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
        for r in coded.collect():
            want = codecs.encode_text(model, texts[r.doc_id])
            assert r.payload_bits == len(want) and bits.unpack(r.payload, r.payload_bits).tolist() == want
        assert {r.doc_id: r.text for r in codecs.texts_of(coded, model).collect()} == dict(enumerate(texts))
        with pytest.raises(ValueError):
            arrays.symbols("ß")


def test_rank_code_sizes_against_brute_force(spark):
    import heapq
    from collections import Counter

    draw = random.Random(4)
    texts = ["", "a", "abab", "zzzzzz"] + ["".join(draw.choice("abc dé") for _ in range(draw.randrange(200))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = codecs.fit(docs)
    got = {r.doc_id: r for r in codecs.coded(docs, model, "huffman").collect()}
    for i, text in enumerate(texts):
        ranks = codecs.rank_stream(model, text)
        heap = list(Counter(ranks).values())
        heapq.heapify(heap)
        total = len(ranks) if len(heap) == 1 else 0
        while len(heap) > 1:  # the code's length is the sum of all merged weights
            heapq.heappush(heap, both := heapq.heappop(heap) + heapq.heappop(heap))
            total += both
        r = got[i]
        assert (r.huffman_bits, r.n_tokens, r.sum_rank, r.max_rank, r.lossless) == (total, len(text), sum(ranks), max(ranks, default=0), True)
        assert r.packed_bits == len(ranks) * max(1, max(ranks, default=0).bit_length())
    with pytest.raises(ValueError):
        codecs.coded(docs, model, "morse")
    sizes = codecs.byte_codecs(docs)
    assert {(r.doc_id, r.codec): (r.raw, r.exact) for r in sizes.collect()} == {(i, c): (len(t.encode()), True) for i, t in enumerate(texts) for c in codecs.general_codecs()}
    assert all(r.kb_s > 0 and 0 < r.ratio and r.exact for r in codecs.speeds(sizes, "codec").collect())


def test_open_models_code_any_text(spark, monkeypatch):
    monkeypatch.setattr(codecs, "LANE_SYMBOLS", 40)
    docs = spark.createDataFrame([(1, "abracadabra"), (2, "banana band")], "doc_id long, text string")
    other = {5: "snow \u2603 man", 6: "", 7: "\U0010ffff\0é", 8: "abra " * 30, 9: None}
    held = spark.createDataFrame(list(other.items()), "doc_id long, text string")
    for order in (0, 1, 2):
        model = codecs.fit_open(docs, order)
        coded = codecs.arithmetic(held, model)
        assert {r.doc_id: r.text for r in codecs.texts_of(coded, model).collect()} == {k: v or "" for k, v in other.items()}
    own = {r.doc_id: r.payload_bits / max(1, r.n_tokens) for r in codecs.arithmetic(docs, codecs.fit_open(docs, 2)).collect()}
    assert max(own.values()) < 3
    assert codecs.arithmetic(held.limit(0), model).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)] + [(3, "text number 3")], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    model = codecs.fit(docs)
    for _ in range(2):
        stream = streaming.document_stream(spark, str(tmp_path / "in"), docs.schema, 1)
        streaming.encode_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 20
    back = {r.doc_id: r.sha256 for r in codecs.arithmetic_decoded(done, model).collect()}
    assert back == {r.doc_id: r.s for r in docs.select("doc_id", F.sha2("text", 256).alias("s")).collect()}

    events = spark.createDataFrame([(f"2024-01-01 {h:02d}:{m:02d}:00", "a", "{}", 1.0) for h in range(3) for m in (0, 20, 59)], "t string, event_type string, props string, value double").withColumn("ts", F.to_timestamp_ntz("t")).drop("t")
    events.write.parquet(str(tmp_path / "events"))
    live = streaming.window_bytes(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    live.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, streaming.window_bytes(events).collect()))
