"""The registered queries of this package and, where SQL can say it, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, near_dedup, neighbours, packing, pii, quality, topk, toxicity, urls
from .common import prepare

#: Rules of op1: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's URL."""
    return urls.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document's quality."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 ids."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return neighbours.neighbours(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0, k=5)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds personal data in every document."""
    found = pii.find(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    own = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("pii", lambda s: s.base)
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(own(base).cast("binary"), 256).alias("base_sha256"), own(F.col("pii")).alias("spans"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest inner products of every twentieth vector."""
    return topk.top_k(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document's toxicity."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts every page's article."""
    pages = html.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near copies, and whether it stays."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.classes(docs).select("doc_id", "class_id", "keep")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_quality, op3_packing, op4_neighbours, op5_pii, op6_topk, op7_toxicity, op8_html, op9_bpe, op10_near_dedup)
}

ORACLE: dict[str, str] = {
    "op1_url_filter": """
WITH rules(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
urls AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts)
SELECT u.page_id, any_value(u.host) AS host, any_value(u.path) AS path,
  arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
  coalesce(arg_max(r.verdict, length(r.rule_host || r.rule_path)), 'allow') AS verdict
FROM urls u LEFT JOIN rules r
  ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
GROUP BY u.page_id
""",
    "op4_neighbours": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 9) AS score
FROM scored QUALIFY rank <= 5
""",
    "op6_topk": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
""",
}
#: The search of op4 is approximate, so its SQL measures recall in the tests only.
APPROXIMATE = {"op4_neighbours": ORACLE.pop("op4_neighbours")}
