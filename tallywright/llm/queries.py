"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import brown, chat, exact, langid, mixing, near, packing, quality, sharding, toxicity
from tallywright.llm.common import part_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(r"SELECT -1L AS conv_id, turn, role, r'</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat.format_chats(rows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat.masked(F.col("formatted"), F.col("loss_mask")), "")
    return chats.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(_table(spark, sf_dir, "documents"), part_of(F.col("doc_id"), 10) == 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), part_of(F.col("doc_id"), 5) == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = toxicity.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), part_of(F.col("doc_id"), 5) == 0)
    return rated.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_brown_lm": op5_brown_lm,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL = {
    # Conflicts are escaped, so the rendered length is that of marks and escaped texts; where nothing conflicts, escaping changes nothing.
    "op1_chat_formatting": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
            SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '\[(/?(?:SYS|INST|TURN|SEP)\])', '[\\\1', 'g'), '<(/?s>)', '<\\\1', 'g') AS safe,
                   regexp_replace(regexp_replace(replace(role, '\', '\\'), '\[(/?(?:SYS|INST|TURN|SEP)\])', '[\\\1', 'g'), '<(/?s>)', '<\\\1', 'g') AS safe_role
            FROM said)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(safe) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 18 + length(safe_role) END)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
