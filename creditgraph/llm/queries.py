"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, chat, codes, dedup, langid, lines, mixing, secret_scan, setjoin, sharding, token_counts
from .common import staged, table

SHARDS = 24


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, entropy_gain=0.5, max_repeats=4).drop("text")


def op2_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.Index(table(spark, sf_dir, "embeddings"))
    return index.search(index.own_queries(F.col("vec_id") % 100 == 0))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join_sets(table(spark, sf_dir, "documents"), 90, 100, 3)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest is fitted on findings planted in about 20,000 documents at most; it scores every candidate of all documents."""
    docs = table(spark, sf_dir, "documents")
    found = staged(secret_scan.candidates(docs), "candidates")
    scanner = secret_scan.Scanner(secret_scan.learn_language(docs), secret_scan.planted(docs))
    return scanner.score(found).drop("before", "after")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op_digests(table(spark, sf_dir, "documents"), *bpe.public_vocabulary())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    content = token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return token_counts.count_sections(table(spark, sf_dir, "documents"), content, public_tokenizers.PATTERN)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = dedup.DigestIndex.open(spark)
    index.add(docs)
    return index.annotate(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(rows))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_docs=3, least_chars=20)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *alignment.public_tokenizers())


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_shard_by_bytes, op3_nn_descent, op4_jaccard_join, op5_language_id, op6_secret_scan, op7_byte_bpe, op8_token_counts, op9_exact_dedup, op10_chat_format, op11_line_dedup, op12_vector_codes, op13_token_alignment)}

ORACLE_SQL = {
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS g FROM w
), s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, c.component_id
FROM g JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON g.doc_id = c.a
""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op11_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l
), c AS (SELECT k, max(doc_id) AS keep_id FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keep_id <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep_id IS NULL OR keep_id = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN c USING (k) GROUP BY doc_id
""",
    "op10_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 18 ELSE 12 + length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
}
