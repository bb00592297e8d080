"""Shared helpers: table access, the shared work folder and distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The blanks that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until ``df`` has no such column, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pressed(text: Column) -> Column:
    """Text without blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c))
    return out


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def prefix_sums(df: DataFrame, keys: list[str], chunk: str, order: list[Column], sums: dict[str, str], rank: str) -> DataFrame:
    """Running totals per key in ``order``, exact at any skew.

    ``chunk`` is a column that never falls along ``order`` within a key. Rows are sorted only within (key, chunk); the totals of
    whole chunks are added from a table of one row a chunk. ``sums`` maps a new column to the column summed over all earlier
    rows; ``rank`` numbers the rows of a key from 0.
    """
    whole = Window.partitionBy(*keys).orderBy(F.col(chunk).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    at = (
        df.groupBy(*keys, chunk)
        .agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s_{k}") for k, c in sums.items()])
        .select(
            *[F.col(k).alias(f"__k_{k}") for k in [*keys, chunk]],
            F.coalesce(F.sum("__n").over(whole), F.lit(0)).alias("__at"),
            *[F.coalesce(F.sum(f"__s_{k}").over(whole), F.lit(0)).alias(f"__at_{k}") for k in sums],
        )
    )
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    near = df.select("*", (F.row_number().over(inner) - 1).alias("__r"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b_{k}") for k, c in sums.items()])
    cond = F.lit(True)
    for k in [*keys, chunk]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return near.join(at, cond).select(
        *df.columns,
        (F.col("__at") + F.col("__r")).cast("long").alias(rank),
        *[(F.col(f"__at_{k}") + F.col(f"__b_{k}")).alias(k) for k in sums],
    )
