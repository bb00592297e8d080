"""Exact deduplication by content sort.

Normalised texts are range-partitioned by sampled splitters, sorted externally so that equals are adjacent, and told apart by
comparing neighbouring texts in full. The sort key begins with a short stretch of the text and its hash, so splitters stay small
and comparisons rarely reach the text itself; the text is the last part of the key, so the hash decides nothing alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pressed, stored


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lead: int = 48, hot_rows: int = 1000, hot_keys: int = 10_000) -> DataFrame:
    """One row a row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Two texts are equal when they are identical after all blanks (space, U+0009 to U+000D) are removed. Of a group the row with the
    longest original text stays, then the one with the smallest id; a null id comes last. Null text counts as empty, and empty texts
    are a group like any other. Of rows that repeat in full exactly one stays. An empty table gives no rows. Other columns aren't read.

    A group of more than max(``hot_rows``, rows / ``hot_keys``) copies is dealt over several partitions by its ids; the leaders of the
    parts are then compared in full. At most ``hot_keys`` groups can be that large, which bounds what is broadcast.
    """
    keyed = docs.select(
        F.col(id_col).alias("id"),
        pressed(F.col(text_col)).alias("norm"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("cp"),
    ).select("id", "norm", "cp", F.xxhash64("norm").alias("hash"))
    least = max(hot_rows, docs.count() // hot_keys)
    hot = keyed.groupBy("hash").count().filter(F.col("count") > least).select(F.col("hash").alias("hot_hash"), F.ceil(F.col("count") / least).cast("int").alias("parts"))
    dealt = (
        keyed.join(F.broadcast(hot), F.col("hash") == F.col("hot_hash"), "left")
        .select("id", "norm", "cp", "hash", F.coalesce("parts", F.lit(1)).alias("parts"))
        .select("*", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.substring("norm", 1, lead).alias("lead"))
        .repartitionByRange("lead", "hash", "part")
    )
    best = Window.partitionBy("lead", "hash", "part", "norm").orderBy(F.col("cp").desc(), F.col("id").asc_nulls_last())
    group = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = dealt.select(
        "id", F.sha2("norm", 256).alias("sha"), "part", "parts", "norm",
        F.row_number().over(best).alias("nth"),
        F.first("id").over(group).alias("lead_id"),
        F.first("cp").over(group).alias("lead_cp"),
        F.count(F.lit(1)).over(group).alias("n"),
    )
    # the text goes no further, but for the leaders of parts of hot groups
    table = stored(ranked.withColumn("norm", F.when((F.col("parts") > 1) & (F.col("nth") == 1), F.col("norm"))), "exact")
    leaders = table.filter((F.col("parts") > 1) & (F.col("nth") == 1))
    order = Window.partitionBy("sha", "norm").orderBy(F.col("lead_cp").desc(), F.col("lead_id").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = leaders.select(
        F.col("sha").alias("m_sha"), F.col("part").alias("m_part"), F.col("lead_cp").alias("m_cp"), F.col("lead_id").alias("m_id"),
        F.row_number().over(order).alias("m_nth"), F.first("lead_id").over(whole).alias("m_keep"), F.sum("n").over(whole).alias("m_n"),
    )
    hit = (F.col("parts") > 1) & (F.col("sha") == F.col("m_sha")) & (F.col("part") == F.col("m_part")) & (F.col("lead_cp") == F.col("m_cp")) & F.col("lead_id").eqNullSafe(F.col("m_id"))
    split = F.col("m_nth").isNotNull()
    return table.join(F.broadcast(merged), hit, "left").select(
        F.col("id").alias(id_col),
        F.when(split, F.col("m_keep")).otherwise(F.col("lead_id")).alias("keep_id"),
        F.when(split, F.col("m_n")).otherwise(F.col("n")).cast("long").alias("group_size"),
        ((F.col("nth") == 1) & F.coalesce(F.col("m_nth") == 1, F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
