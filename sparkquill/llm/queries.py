"""The operators' queries over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkquill.llm import decontaminate, language, licences, media, near_dup, packing, pii, quality, site_style, token_files
from sparkquill.session import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_files(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return token_files.read_files(files)


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_site_style_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_text(table(spark, sf_dir, "pages"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_token_files": op3_token_files,
    "op4_language_fusion": op4_language_fusion,
    "op5_licence_digests": op5_licence_digests,
    "op6_site_style_extraction": op6_site_style_extraction,
    "op7_personal_data": op7_personal_data,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLES = {
    "op5_licence_digests": licences.sql(),
    "op2_benchmark_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        i AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        g AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
        x AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
        h AS (SELECT x.r, x.n, x.s, g.item_id FROM x JOIN g USING (n, gram)),
        c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
        m AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS named FROM h GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)""",
    "op10_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z),
        c AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
