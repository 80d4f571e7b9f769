"""The registered queries of this subpackage: opN_<name>, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadra.llm import embedding_dedup, hamming_search, packing, pii, pitman_yor, sentencepiece_codec, simhash, substring_dedup, token_orc, toxicity
from quadra.runtime import scratch_path, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file, at the same place on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end=0)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every row whose vec_id is divisible by 50, among all rows."""
    codes = hamming_search.codes(table(spark, sf_dir, "embeddings"))
    return hamming_search.top_k(codes, codes.where("id % 50 = 0"), k=10)


def op6_pitman_yor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.digest(table(spark, sf_dir, "documents"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-orc")
    token_orc.write(table(spark, sf_dir, "documents"), tokenizer_path(), out, end=2)
    return token_orc.digest(spark, out)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(docs, toxicity.fit(docs, toxicity.learning(table(spark, sf_dir, "labels"))))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"), size=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_pii_bootstrap": op2_pii_bootstrap,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_hamming_top_k": op5_hamming_top_k,
    "op6_pitman_yor_score": op6_pitman_yor_score,
    "op7_token_orc": op7_token_orc,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_hamming_top_k": r"""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x, 0) > 0) AS bits FROM embeddings WHERE len(embedding) > 0),
pairs AS (
  SELECT q.vec_id, r.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(coalesce(q.bits[i], false) <> coalesce(r.bits[i], false) AS INT))) AS BIGINT) AS distance
  FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT vec_id, rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM pairs) WHERE rank <= 10
""",
    "op8_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON v.vec_id = least.a LEFT JOIN n ON v.vec_id = n.a
""",
    "op10_substring_dedup": r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS s FROM docs WHERE len(words) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS p FROM later),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS p FROM docs),
kept AS (
  SELECT e.doc_id, count(g.p) AS n_removed, string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS t
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
}
