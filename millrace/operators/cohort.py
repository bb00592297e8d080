"""Before and after cohorts, power, variance ranking and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import effective_rent, normal_cdf

#: Fixed: normal quantiles at 80 and 90 percent power.
POWER_Z = {80: 0.8416, 90: 1.2816}


def cohort_stats(totals: DataFrame) -> DataFrame:
    """agent, version: n, mean, sd (0 for one value), se (null for one value)."""
    n = F.count(F.lit(1))
    return totals.groupBy("agent", "ruleset_version").agg(
        n.alias("n"), F.avg("total").alias("mean"), F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("sd"), F.when(n >= 2, F.stddev_samp("total") / F.sqrt(n)).alias("se")
    )


def assess_cohorts(totals: DataFrame, least: int = 5) -> DataFrame:
    """The earliest version against the latest, per agent; a saving is positive. Confident beyond two pooled standard errors."""
    row = F.struct("ruleset_version", "n", "mean", "se")
    c = cohort_stats(totals).groupBy("agent").agg(F.min_by(row, "ruleset_version").alias("a"), F.max_by(row, "ruleset_version").alias("b"), F.count(F.lit(1)).alias("versions"))
    delta, pooled = F.col("a.mean") - F.col("b.mean"), F.sqrt(F.col("a.se") * F.col("a.se") + F.col("b.se") * F.col("b.se"))
    enough = (F.col("versions") >= 2) & (F.col("a.n") >= least) & (F.col("b.n") >= least)
    confident = enough & (F.abs(delta) > 2 * pooled)
    v = F.when(~enough, "insufficient-data").when(~F.coalesce(confident, F.lit(False)), "no-change").when(delta > 0, "improved").otherwise("regressed")
    return c.select(
        "agent", F.col("a.ruleset_version").alias("first"), F.col("b.ruleset_version").alias("last"), F.when(enough, delta).alias("delta"), F.when(enough, pooled).alias("pooled"),
        F.when(enough & (F.col("a.mean") > 0), delta / F.when(F.col("a.mean") > 0, F.col("a.mean")) * 100).alias("pct"), v.alias("verdict"),
    )


def governance(verdict: str | Column = "verdict") -> Column:
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    return F.when(v == "regressed", "re-audit").when(v == "improved", "corroborated").when(v == "no-change", "no-signal").otherwise("insufficient-data")


def confirm(fixture: DataFrame, cohorts: DataFrame) -> DataFrame:
    """What fixtures promise per agent against the verdict in production.

    Without active rules, or without a saving among them, there is nothing to confirm, whatever production says. Else an improvement corroborates, a regression
    contradicts, and anything else, too few sessions included, leaves it unconfirmed.
    """
    f = fixture.select("agent", "active_rules", "saving", "regressed")
    outcome = (
        F.when((F.coalesce("active_rules", F.lit(0)) == 0) | (F.coalesce("saving", F.lit(0)) <= 0), "nothing-to-confirm")
        .when(F.col("verdict") == "improved", "corroborated").when(F.col("verdict") == "regressed", "contradicted").otherwise("unconfirmed")
    )
    return cohorts.join(f, "agent", "left").withColumn("active_rules", F.coalesce("active_rules", F.lit(0))).withColumn("outcome", outcome)


def fixture_side(receipts: DataFrame, rules: DataFrame, order: str = "decided_no") -> DataFrame:
    """Per agent of active rules: how many there are, the sum of positive savings of their last receipts, and the regressed ones."""
    last = receipts.groupBy("rule_id").agg(F.max_by(F.struct("delta", "regression"), order).alias("r"))
    active = rules.filter("status = 'active'").select("agent", F.col("id").alias("rule_id"))
    return active.join(last, "rule_id", "left").groupBy("agent").agg(
        F.count(F.lit(1)).alias("active_rules"), F.sum(F.greatest(F.lit(0), F.coalesce("r.delta", F.lit(0)))).alias("saving"),
        F.sort_array(F.collect_list(F.when(F.col("r.regression"), F.col("rule_id")))).alias("regressed"),
    )


def rank_variance(totals: DataFrame, least: int = 3, window: int = 10) -> DataFrame:
    """Coefficient of variation of the newest ``window`` runs of each task, noisiest first."""
    newest = totals.withColumn("__n", F.row_number().over(Window.partitionBy("agent", "task").orderBy(F.desc("ts"), F.desc("id")))).filter(F.col("__n") <= window)
    s = newest.groupBy("agent", "task").agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"))
    return s.filter((F.col("n") >= least) & (F.col("mean") > 0)).withColumn("cv", F.col("sd") / F.col("mean")).orderBy(F.desc("cv"), "agent", "task")


def stale_rules(rules: DataFrame, now_s: int, days: int = 30) -> DataFrame:
    """Unprotected active rules not decided for ``days``, the oldest first."""
    age = (F.lit(now_s) - F.coalesce("decided_s", "created_s")) / 86400.0
    return rules.filter("status = 'active' AND NOT protected").withColumn("age_days", age).filter(F.col("age_days") >= days).orderBy(F.desc("age_days"), "id")


def task_noise(replicates: DataFrame) -> DataFrame:
    """Variance per task from the best-filled group of (task, version, model); of equal sizes the larger variance."""
    g = replicates.groupBy("agent", "task", "version", "model").agg(F.count(F.lit(1)).alias("n"), F.var_samp("total").alias("variance")).filter("n >= 2")
    return g.groupBy("agent", "task").agg(F.max(F.struct("n", "variance")).alias("best")).select("agent", "task", "best.n", "best.variance")


def group_replicates(replicates: DataFrame, least: int = 2) -> DataFrame:
    """The largest group of each task, the first by key among equals, with its totals."""
    g = replicates.groupBy("agent", "task", "version", "model").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("total")).alias("totals")).filter(F.col("n") >= least)
    return g.withColumn("__n", F.row_number().over(Window.partitionBy("agent", "task").orderBy(F.desc("n"), "version", "model"))).filter("__n = 1").drop("__n")


def power_table(noise: DataFrame, rent: float = 25.0, z: float = 2.0, sessions: float = 20.0, runs: tuple[int, ...] = (2, 3, 5, 10, 20)) -> DataFrame:
    """Standard error, smallest detectable savings and power at 1000 tokens, by agent and runs a side."""
    bar = 2 * effective_rent(F.lit(rent), sessions)
    k = noise.groupBy("agent").agg(F.sum("variance").alias("v"), F.count(F.lit(1)).alias("k"))
    t = k.withColumn("runs", F.explode(F.array(*[F.lit(n) for n in runs]))).withColumn("se", F.sqrt(2 * F.col("v") / F.col("runs")) / F.col("k"))
    return t.select("agent", "runs", "se", *[(bar + (z + q) * F.col("se")).alias(f"mds{p}") for p, q in POWER_Z.items()], power_at(F.lit(1000.0), bar, F.col("se"), z).alias("power1000"))


def power_at(delta: Column, bar: Column, se: Column, z: float) -> Column:
    return F.when(se > 0, normal_cdf((delta - bar) / F.when(se > 0, se) - z)).otherwise(F.when(delta > bar, 1.0).otherwise(0.0))


def required_runs(noise: DataFrame, target: float, rent: float = 25.0, z: float = 2.0, power: int = 80, sessions: float = 20.0, most: int = 500) -> DataFrame:
    """Fewest runs a side from 2 to ``most`` that detect ``target``; null where none does."""
    bar = 2 * rent * (1 + 1.25 / sessions)
    k = noise.groupBy("agent").agg(F.sum("variance").alias("v"), F.count(F.lit(1)).alias("k"))
    if target <= bar + 1e-9:
        return k.select("agent", F.lit(None).cast("int").alias("runs"))
    enough = F.filter(F.sequence(F.lit(2), F.lit(most)), lambda n: F.lit(target) >= bar + (z + POWER_Z[power]) * F.sqrt(2 * F.col("v") / n) / F.col("k"))
    return k.select("agent", F.array_min(enough).alias("runs"))
