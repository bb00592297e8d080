"""Rolling triggers and sequence operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import array_median, environment_failure, nearest_rank, total_tokens
from millrace.functions.text import valid_agent_name
from millrace.schemas import real_work


def priors(runs: DataFrame, span: int = 50) -> DataFrame:
    """Real work of each agent in order, with the totals of up to ``span`` runs before each."""
    w = Window.partitionBy("agent").orderBy("ts", "id").rowsBetween(-span, -1)
    work = runs.filter(real_work() & F.col("completed")).select("id", "agent", "ts", total_tokens().alias("total"))
    return work.withColumn("prior", F.collect_list("total").over(w))


def distill_triggers(runs: DataFrame, span: int = 50, least: int = 5) -> DataFrame:
    """Whether a run costs more than the 75th percentile (nearest rank) of the runs before it."""
    p = nearest_rank(F.col("prior"), 0.75)
    return priors(runs, span).select("id", "agent", "total", p.alias("p75"), F.coalesce((F.size("prior") >= least) & (F.col("total") > p), F.lit(False)).alias("triggered"))


def anomalies(runs: DataFrame, span: int = 50, least: int = 5, multiple: float = 2.0) -> DataFrame:
    """Whether a run costs ``multiple`` times the median of the runs before it."""
    m = array_median(F.col("prior"))
    x = F.when((F.size("prior") >= least) & (m > 0), F.col("total") / F.when(m > 0, m))
    return priors(runs, span).select("id", "agent", "total", m.alias("median"), x.alias("multiple"), F.coalesce(x >= multiple, F.lit(False)).alias("anomalous"))


def failure_streaks(runs: DataFrame, limit: int = 4) -> DataFrame:
    """Longest streak of environment failures by suite (comparison_id, side), and where it first reached ``limit``."""
    order = Window.partitionBy("comparison_id", "side").orderBy("run_no")
    env = environment_failure("completed", "tokens")
    islands = runs.withColumn("env", env).withColumn("island", F.sum((~F.col("env")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = Window.partitionBy("comparison_id", "side", "island").orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    streak = islands.withColumn("streak", F.sum(F.col("env").cast("int")).over(at))
    return streak.groupBy("comparison_id", "side").agg(F.max("streak").alias("longest"), F.min(F.when(F.col("streak") >= limit, F.col("run_no"))).alias("aborted_at"))


def two_strikes(audits: DataFrame, keys: list[str], order: str, seed: str | None = None) -> DataFrame:
    """Verdict of each audit in order: a second weak audit in a row, or a regression, evicts.

    ``audits``: keys, order, sub (saving too small), regression, env (failed environment). Failed environments leave the state as it is. A strike
    lives until the next audit, so the state is the audit before; ``seed`` names the column with the stored strike. Audits after an eviction
    are left out.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    seen = audits.filter(~F.col("env"))
    before = F.coalesce(F.lag("sub").over(w), F.col(seed) if seed else F.lit(False))
    ruled = seen.withColumn("evict", F.col("regression") | (F.col("sub") & before))
    gone = F.coalesce(F.max(F.col("evict").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outcome = F.when(F.col("evict"), "evicted").when(F.col("sub"), "strike").otherwise("cleared")
    return ruled.withColumn("gone", gone).filter("gone = 0").select(*keys, order, outcome.alias("outcome"))


def auto_select(pending: DataFrame, last: DataFrame, now: Column, enabled: bool = True, hours: int = 24) -> DataFrame:
    """Which agents may be measured: pending rules, and no measurement of any agent within ``hours``; ``last`` is the one row of ``last_measurement``."""
    joined = pending.withColumn("last_ts", last.select("last_ts").scalar())
    cool = F.col("last_ts").isNotNull() & (F.col("last_ts") > now - F.make_interval(hours=F.lit(hours)))
    reason = F.when(F.lit(not enabled), "disabled").when(F.col("pending") == 0, "nothing pending").when(cool, "cooling down").otherwise("due")
    return joined.select("agent", "pending", reason.alias("reason"), (reason == "due").alias("due"))


def resolve_agent(name: str, known: list[str]) -> Column:
    return F.when(F.col(name).isin(*known), F.col(name)).otherwise("main")


def known_agents(bundled: DataFrame, files: DataFrame) -> DataFrame:
    """name, pos: the bundled agents (name, pos) in their order, then valid names of definition files (file: base name) in order; a bundled name wins."""
    own = files.filter(F.col("file").endswith(".md")).select(F.expr("left(file, length(file) - 3)").alias("name")).distinct()
    own = own.filter(valid_agent_name("name")).join(bundled.select("name"), "name", "left_anti")
    after = bundled.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("m"))
    # a registry: as many rows as there are definition files
    return bundled.select("name", F.col("pos").cast("long").alias("pos")).unionByName(own.select("name", (after.scalar() + F.row_number().over(Window.orderBy("name"))).cast("long").alias("pos")))
