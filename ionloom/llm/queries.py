"""The queries of the training-data operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .urls import PATTERN_RULES


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    out = judge_urls(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii, score_text, span_text

    df, spans = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col(spans)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = span_text(F.filter(s, lambda x: x["base"]))
    return df.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(base, 256).alias("base_sha256"), span_text(s).alias("spans"), score_text(s).alias("scores"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out, names = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", *[F.col(v).alias(k) for k, v in names.items()])


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import words_of
    from .periodic import digests, find_runs, planted

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(find_runs(docs, planted(docs, words_of(F.col("text")))))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "terms")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def vocabulary_path() -> str:
    """The public byte-level vocabulary of the machine, as the production parameter of the BPE queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_quality": op2_quality,
    "op3_urls": op3_urls,
    "op4_topk": op4_topk,
    "op5_near_dedup": op5_near_dedup,
    "op6_language": op6_language,
    "op7_bpe": op7_bpe,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_periodic": op11_periodic,
    "op12_toxicity": op12_toxicity,
    "op13_importance": op13_importance,
}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_urls": r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(lower(u), '@BLOCKED@') THEN 'block'
  ELSE 'allow' END AS verdict FROM ruled""".replace("@BLOCKED@", "|".join(r.pattern for r in PATTERN_RULES if r.verdict == "block")),
    "op4_topk": """
WITH v AS (
  SELECT vec_id, len(embedding) AS d, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
