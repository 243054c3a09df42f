"""The queries of the operators in this folder, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import hpy_lm, language_id, mixing, near_dedup, packing, secret_scan, syncmers, topk_search, url_filter, warc
from lodestone.llm.shared import checksum, cut, spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from three quarters of the labelled ones."""
    docs = _documents(spark, sf_dir)
    held_out = checksum("doc_id", 4) == 2
    model = language_id.fit(docs, ~held_out, "text", "lang", "doc_id")
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by pattern and by randomness."""
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return syncmers.compare_edits(_table(spark, sf_dir, "documents"))


_OP8_SQL = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * c.c[i])) AS BIGINT) AS score
  FROM codes q JOIN codes c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth one."""
    return topk_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is in a mixture of its sources that repeats none more than twice."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).cast("long").alias("n_tokens"))
    return mixing.mix(cut(docs), "source", F.col("n_tokens"), "doc_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 4096 tokens, packed into sequences of 4096."""
    docs = _documents(spark, sf_dir)
    return packing.pack(packing.pieces(docs, packing.tokenizer_path()), docs.count())


#: The rules of op4, as host, path and verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM named
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


_OP5_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), digested AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS INT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest FROM sized
), least AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM digested
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM least
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document under the model of nine tenths of them."""
    scored = hpy_lm.score(_documents(spark, sf_dir), checksum("doc_id", 10) != 0)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates of every document: five words, likeness of at least 0.85."""
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


_QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_syncmers": op3_syncmers,
    "op4_url_filter": op4_url_filter,
    "op5_warc": op5_warc,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_hyperminhash": op7_hyperminhash,
    "op8_topk_search": op8_topk_search,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_temperature_mixing": op10_temperature_mixing,
}
_SQL: dict[str, str] = {"op4_url_filter": _OP4_SQL, "op5_warc": _OP5_SQL, "op8_topk_search": _OP8_SQL}


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return _QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return _SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
