"""Sessions and ledgers: tables by name, read from and written to Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ledger import latest
from millrace.schemas import TABLES, empty, migrated


def session(name: str = "millrace", **conf: str) -> SparkSession:
    """A session with the settings that results depend on."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites of Column expressions cost seconds in long plans
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def log_of(path: str, name: str) -> str:
    """The folder that a stream appends a table's batches to, below stream=.../batch=..."""
    return f"{path.rstrip('/')}/{name}.log"


def stored_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its log over it: of a session's runs the last batch stands, within a batch the latest. Empty where nothing is stored."""
    at, log = f"{path.rstrip('/')}/{name}", log_of(path, name)
    table = migrated(spark.read.parquet(at), name) if exists(spark, at) else empty(spark, name)
    if name != "runs" or not exists(spark, log):
        return table
    late = spark.read.schema(f"{table.schema.toDDL()}, stream string, batch long").parquet(log)
    both = table.withColumn("batch", F.lit(-1).cast("long")).unionByName(late.drop("stream"))
    return latest(both, ["session_id"], [F.col("batch").desc(), F.col("ts").desc(), F.col("id").desc()]).drop("batch")


def open_ledger(spark: SparkSession, path: str, register: bool = True) -> dict[str, DataFrame]:
    """The ledger's tables, empty ones where none is stored, registered as views."""
    out = {}
    for name in TABLES:
        out[name] = stored_table(spark, path, name)
        if register:
            out[name].createOrReplaceTempView(name)
    return out


def fold_log(spark: SparkSession, path: str, name: str = "runs") -> None:
    """Moves a table's log into the table. Run it between runs of the streams.

    Batches go oldest first, so what an interrupted call leaves are the newest, which give the same table again.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    log = jvm.Path(log_of(path, name))
    fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(log):
        return
    save_table(stored_table(spark, path, name), path, name)
    batches = [b.getPath() for s in fs.listStatus(log) for b in fs.listStatus(s.getPath()) if b.isDirectory()]
    for b in sorted(batches, key=lambda b: int(b.getName().split("=")[1])):
        fs.delete(b, True)


def save_table(df: DataFrame, path: str, name: str) -> None:
    """Writes a table next to the old one, then swaps folders by renaming. A reader that comes between the two renames finds no table; none sees half of one."""
    spark = df.sparkSession
    at, new, old = (f"{path.rstrip('/')}/{name}{x}" for x in ("", ".new", ".old"))
    migrated(df, name).write.mode("overwrite").parquet(new)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm.Path(old), True)
    if fs.exists(jvm.Path(at)):
        fs.rename(jvm.Path(at), jvm.Path(old))
    fs.rename(jvm.Path(new), jvm.Path(at))
    fs.delete(jvm.Path(old), True)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or in local mode without one a temporary folder. On a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def settled(df: DataFrame, name: str = "state") -> DataFrame:
    """``df`` written to the shared folder and read again, where several branches of a plan need it: its lineage and the plans that build on it end there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
