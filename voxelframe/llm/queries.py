"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelframe.llm import chat, decontam, exponion, jaccard, lattice, lexical, license, piece, shard, streamdedup, toxicity, vptree, wordpiece
from voxelframe.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_bytes(name: str = PIECE_MODEL) -> bytes:
    """A public vocabulary file; the driver reads it and ships it to the executors."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), tokenizer_bytes())


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode(table(spark, sf_dir, "documents"), tokenizer_bytes(), ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(turns.unionByName(more))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(table(spark, sf_dir, "documents"), shards=24)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), tokenizer_bytes())


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64, seed=2)


def op12_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamdedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_lattice_score": op3_lattice_score,
    "op4_nearest": op4_nearest,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_chat_format": op7_chat_format,
    "op8_license_scan": op8_license_scan,
    "op9_sharding": op9_sharding,
    "op10_token_counts": op10_token_counts,
    "op11_exponion": op11_exponion,
    "op12_stream_dedup": op12_stream_dedup,
    "op13_lexical_search": op13_lexical_search,
}
#: All pairs that share a shingle, then the smallest document reached from each by links.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda k: array_to_string(words[k:k + 2], ' '))
                                    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS shingles FROM w
), n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s
), x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s
), link AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM x a JOIN x b USING (shingle) GROUP BY 1, 2) p
  JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE u <> v AND 100 * c >= 90 * (a.n + b.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, link.v FROM reach JOIN link ON reach.r = link.u
)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY 1, 2"""

#: Each turn's formatted length is its constants and its escaped role and text.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(s>|/s>|ROLE\]|TEXT\]|INST\]|/INST\])', '\1\\\2', 'g'))
          + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(s>|/s>|ROLE\]|TEXT\]|INST\]|/INST\])', '\1\\\2', 'g'))
          + 19 + CASE WHEN role = 'user' THEN 7 ELSE 0 END AS size FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": JACCARD_SQL,
    "op7_chat_format": CHAT_SQL,
    "op8_license_scan": license.oracle_sql(),
    "op11_exponion": exponion.oracle_sql(),
    "op12_stream_dedup": streamdedup.ORACLE_SQL,
    "op13_lexical_search": lexical.ORACLE_SQL,
}
