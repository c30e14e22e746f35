"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, langid, line_dedup, mixing, order_minhash, packing, quality, topk, toxicity, warc
from .common import table

#: The tokenizer file that queries use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "taken")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_language_id": op1_language_id, "op2_topk": op2_topk, "op3_toxicity": op3_toxicity, "op10_quality": op10_quality, "op4_order_minhash": op4_order_minhash, "op5_mixing": op5_mixing, "op6_embedding_dedup": op6_embedding_dedup, "op7_packing": op7_packing, "op8_warc": op8_warc, "op9_line_dedup": op9_line_dedup}

WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op2_topk": """
WITH rows_ AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows_ q JOIN rows_ c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""",
    "op6_embedding_dedup": """
WITH RECURSIVE valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS r FROM valid),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM normed a JOIN normed b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.r * b.r) >= 0.9),
reach(id, to_id) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.to_id = links.a),
least AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = id LEFT JOIN counted ON a = vec_id
""",
    "op8_warc": """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (
  SELECT hex, min(page_id) AS of_page FROM hashed GROUP BY hex),
coded AS (
  SELECT page_id, payload, hex, list_transform(range(8), lambda k: ('0x' || substr(hex, k * 5 + 1, 5))::BIGINT) AS parts FROM hashed)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN of_page IS NULL OR page_id = of_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = of_page THEN NULL ELSE of_page END AS refers_to
FROM coded JOIN firsts USING (hex)
""",
    "op9_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {WHITE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
found AS (
  SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.doc_id, line, pos, coalesce(keyed.doc_id <> largest, false) AS gone FROM keyed LEFT JOIN found USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
