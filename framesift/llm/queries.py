"""The registered queries of this package, and the SQL they are held against where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import bpe, chat, count, mix, neardup, ordinal, rules, search, token_files, warc

#: Two rows that carry control strings, which every template must give back as they are.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_table(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.simhash_groups(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id bigint, turn bigint, role string, text string")
    return chat.conversation_digests(rows.unionByName(planted))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count.count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), split_pattern())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"))


def op8_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_bm25": op8_bm25,
    "op9_token_files": op9_token_files,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS h, coalesce('+' || source, '-') AS k
  FROM documents),
s AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
      FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, coalesce(least(cap, weight * max(CASE WHEN weight * level < cap THEN level END) OVER ()), cap) AS target FROM l),
q AS (SELECT d.doc_id, d.k, d.h, d.size, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) AS done
      FROM d JOIN t USING (k)),
c AS (SELECT q.*, copy, (copy * source_size + done)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(copy) WHERE target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, k, copy, h, size ROWS UNBOUNDED PRECEDING) AS spent FROM c),
g AS (SELECT doc_id, h, count(*) AS copies FROM r WHERE spent <= (SELECT 1.5::DOUBLE * sum(size) FROM d) GROUP BY doc_id, h)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(g.copies, 0) * q.size)::BIGINT AS taken
FROM q LEFT JOIN g USING (doc_id, h)""",
    "op4_chat": r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body, role = 'assistant' AS learn,
         regexp_replace(coalesce(text, ''), '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2\3', 'g') AS escaped,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM c),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || body || chr(10), '' ORDER BY n) AS turns,
         coalesce(string_agg(body, '' ORDER BY n) FILTER (WHERE learn), '') AS learnt,
         sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM g""",
    "op5_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
}
