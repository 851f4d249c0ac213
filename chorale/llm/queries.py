"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm import fingerprint, html_model, language, near_join, packing, pieces, quality, sharding, toxicity, url_filter

URL_RULES = [
    url_filter.parse_rule("block", "com/en/"),
    url_filter.parse_rule("allow", "example.com/en/7"),
    url_filter.parse_rule("allow", "net/de/"),
    url_filter.parse_rule("block", "example.net/de/8"),
    url_filter.parse_rule("block", "org/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_model.extract(table(spark, sf_dir, "pages"))


def _remainder(divisor: int):
    """A null id has the remainder -1: it is neither held out nor learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor)), F.lit(-1))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(table(spark, sf_dir, "documents"), n=5, similarity=0.8)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_remainder(5) != 0))
    return toxicity.score(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(_remainder(4) != 2))
    return language.predict(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_best_fit_packing, op3_pieces, op4_sharding, op5_fingerprints, op6_html_extraction, op7_ngram_jaccard_join, op8_toxicity, op9_quality_rules, op10_language_id)
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": r"""
        WITH rules(verdict, rule_host, rule_path) AS (VALUES
            ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
            ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM (SELECT page_id, coalesce(rest, '') AS rest FROM rest)),
        hosts AS (SELECT DISTINCT host, path FROM parts),
        best AS (
            SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM hosts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY host, path)
        SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path""",
    "op7_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r\x1c- \x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM documents),
        g AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS grams FROM w),
        sets AS (SELECT md5(array_to_string(grams, chr(10))) AS s, any_value(grams) AS grams, min(doc_id) AS copy_id, count(*) AS copies FROM g GROUP BY ALL),
        flat AS (SELECT s, unnest(grams) AS gram, len(grams) AS n FROM sets),
        c AS (SELECT x.s AS a, y.s AS b, count(*) AS common, any_value(x.n) AS na, any_value(y.n) AS nb FROM flat x JOIN flat y ON x.gram = y.gram AND x.s <> y.s GROUP BY ALL),
        e AS (SELECT a, b FROM c WHERE common >= 0.8 * (na + nb - common)),
        r(s, low) AS (SELECT s, copy_id FROM sets UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.s),
        k AS (SELECT s, min(low) AS class_id FROM r GROUP BY s),
        n AS (SELECT a AS s, sum(copies) AS links FROM e JOIN sets ON sets.s = e.b GROUP BY a)
        SELECT doc_id, class_id, copy_id, CAST(coalesce(links, 0) + copies - 1 AS BIGINT) AS n_links
        FROM g JOIN sets ON md5(array_to_string(g.grams, chr(10))) = sets.s JOIN k ON k.s = sets.s LEFT JOIN n ON n.s = sets.s""",
}
