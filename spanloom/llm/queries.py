"""One query per operator, and the same answers in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversations import repaired_damage
from .embedding_dedup import near_vectors
from .exact_dedup import exact_groups
from .fingerprints import fingerprint_edits
from .language_model import language_scores
from .line_dedup import dedup_lines
from .near_dedup import near_classes
from .packing import pack
from .pieces import encoding_digests
from .suffix_dedup import suffix_dedup
from .toxicity import held_out, toxicity
from .url_filters import url_verdicts
from .whitening import whitened_components


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY t ORDER BY n_chars DESC, doc_id)
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).drop("text_hash")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(substr(url, instr(url, '://') + 3), '') AS rest, coalesce(instr(url, '://'), 0) > 0 AS ok FROM pages
), h AS (
  SELECT page_id,
         CASE WHEN ok THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM p
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT h.page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?(casino|casino-win|cheap-pills|free-bets|ads-track|bets|pills|poker|ads|track)[.-]') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best ON h.page_id = best.page_id
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"))
    sha = F.sha2(F.encode(F.coalesce("kept_text", F.lit("")), "UTF-8"), 256)
    return done.select("doc_id", "n_lines", "n_removed", F.size("removed").cast("bigint").alias("n_runs"), sha.alias("kept_sha256"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op9_pieces(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), vocabulary or tokenizer_path("piece_bpe_32k.model"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), able AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a
), components AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts ON vec_id = a
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_damage(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_model": op7_language_model,
    "op8_packing": op8_packing,
    "op9_pieces": op9_pieces,
    "op10_fingerprints": op10_fingerprints,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op5_url_filters": OP5_SQL, "op11_embedding_dedup": OP11_SQL}
