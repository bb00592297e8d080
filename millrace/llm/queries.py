"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_windows, read_back
from .common import table
from .decontaminate import find_items
from .exact_dedup import exact_dedup
from .language_id import identify
from .mixing import mix
from .near_dedup import near_dedup
from .quality import quality
from .secret_scan import BASE_RULES, scan
from .sharding import shard
from .toxicity import toxicity


def label_rows() -> Column:
    """The rows whose labels may be learned."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_rows())
    return scored.select(
        "doc_id", (~label_rows()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["term"], h["start"].cast("string"), h["end"].cast("string"))), ",").alias("hits"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents").withColumn("crc", F.crc32(F.coalesce("text", F.lit("")))))
    return rows.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, segments = mix(table(spark, sf_dir, "documents"))
    taken = segments.groupBy("rid").agg(F.sum("words").alias("words"), F.countDistinct("slot").alias("slots"))
    return rows.join(taken, "rid", "left").select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
        F.coalesce("words", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.lit(0)).alias("slots"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(of(base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_rows())
    return scored.select("doc_id", (~label_rows()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    found = identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(chat_windows(told.unionByName(extra)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=4)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_mixing, op4_secret_scan, op5_decontamination, op6_quality, op7_language_id, op8_chat, op9_near_dedup, op10_exact_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": r"""
            WITH d AS (
                SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS cp
                FROM documents
            ), g AS (
                SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                    row_number() OVER w = 1 AS kept
                FROM d WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id NULLS LAST)
            )
            SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM g""",
    }
