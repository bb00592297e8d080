"""Resampling: permutation, bootstrap and Monte-Carlo trials from hashed uniforms, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import effective_rent, wilson
from millrace.operators.inference import C, T, assess, marginals, per_task, summarize_tasks
from millrace.sources.registry import settled


def uniform(*keys: Column | int) -> Column:
    """In [0, 1), by a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), 11) / float(1 << 53)


def normal(*keys: Column | int) -> Column:
    """Standard normal by Box and Muller."""
    u, v = uniform(*keys, F.lit(1)), uniform(*keys, F.lit(2))
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * 3.141592653589793 * v)


def kept(assessed: DataFrame, sessions: float = 20.0) -> DataFrame:
    """The gate: certain, no regression, and twice the rent saved."""
    return assessed.withColumn("kept", ~F.col("regression") & ~F.col("uncertain") & F.coalesce(F.col("delta") >= 2 * effective_rent("cost", sessions), F.lit(False)))


def permutation_trials(pool: DataFrame, trials: int, runs: int = 2, seed: int = 1, cost: int = 25) -> DataFrame:
    """Pools (task_id, row, tokens) shuffled in each trial and dealt to both sides: what is kept is kept by chance."""
    d = dealt(pool, trials, 2 * runs, seed).select("trial", "task_id", F.posexplode("picks").alias("run_no", "i")).withColumn("run_no", F.col("run_no") + 1)
    return trial_runs(d.join(numbered(pool).select("task_id", "i", "tokens"), ["task_id", "i"]), F.when(F.col("run_no") <= runs, "without").otherwise("with"), cost)


def dealt(pool: DataFrame, trials: int, most: int, seed: int) -> DataFrame:
    """trial, task_id, size, picks: the places (from 0, by row) of the first ``most`` runs of each trial's shuffle of the pool, in order.

    A shuffle's first places are draws without replacement: the n-th is uniform over the places that those before it left. So a trial costs its draws, however large the pool.
    """
    sizes = pool.groupBy("task_id").agg(F.count(F.lit(1)).cast("int").alias("size")).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    draw = lambda picks, n: F.concat(picks, F.array(unpicked(F.floor(uniform(F.col("trial"), F.col("task_id"), n, seed) * (F.col("size") - n + 1)).cast("int"), picks)))
    picks = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(most), F.col("size"))), F.array().cast("array<int>"), draw)
    return sizes.select("trial", "task_id", "size", picks.alias("picks"))


def unpicked(i: Column, picks: Column) -> Column:
    """The place of the i-th (from 0) that isn't among ``picks``."""
    return F.aggregate(F.sort_array(picks), i, lambda at, p: F.when(at >= p, at + 1).otherwise(at))


def permutation_extra(pool: DataFrame, trials: int, runs: int = 2, seed: int = 1, cost: int = 25) -> DataFrame:
    """A second pass of the side with for each trial: ``runs`` draws a task, with replacement, from what the first pass left over, or from the whole pool where that is fewer than two."""
    spare = F.col("size") - F.size("picks")
    left = dealt(pool, trials, 2 * runs, seed).withColumns({"picks": F.when(spare >= 2, F.col("picks")).otherwise(F.array().cast("array<int>")), "left": F.when(spare >= 2, spare).otherwise(F.col("size"))})
    draws = left.withColumn("run_no", F.explode(F.sequence(F.lit(2 * runs + 1), F.lit(3 * runs))))
    draws = draws.withColumn("i", unpicked(F.floor(uniform(F.col("trial"), F.col("task_id"), F.col("run_no"), seed) * F.col("left")).cast("int"), F.col("picks")))
    return trial_runs(draws.select("trial", "task_id", "run_no", "i").join(numbered(pool).select("task_id", "i", "tokens"), ["task_id", "i"]), F.lit("with"), cost)


def numbered(pool: DataFrame) -> DataFrame:
    return pool.withColumn("i", F.row_number().over(Window.partitionBy("task_id").orderBy("row")) - 1)


def drawn(pool: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """``wanted`` (trial, task_id, run_no) with the tokens of a draw each."""
    sized = numbered(pool)
    sizes = sized.groupBy("task_id").agg(F.count(F.lit(1)).alias("size"))
    draws = wanted.join(sizes, "task_id").withColumn("i", F.floor(uniform(F.col("trial"), F.col("task_id"), F.col("run_no"), seed) * F.col("size")))
    return draws.join(sized.select("task_id", "i", "tokens"), ["task_id", "i"])


def bootstrap_trials(pool: DataFrame, trials: int, runs: int = 2, saving: float = 0.0, seed: int = 2, cost: int = 25) -> DataFrame:
    """Draws with replacement for both sides, with ``saving`` tokens taken off one (not below 0)."""
    tasks = pool.select("task_id").distinct()
    wanted = tasks.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("run_no", F.explode(F.sequence(F.lit(1), F.lit(2 * runs))))
    with_side = F.col("run_no") > runs
    r = drawn(pool, wanted, seed).withColumn("tokens", F.when(with_side, F.greatest(F.lit(0.0), F.col("tokens") - saving)).otherwise(F.col("tokens")))
    return trial_runs(r, F.when(with_side, "with").otherwise("without"), cost)


def bootstrap_extra(pool: DataFrame, first: DataFrame, runs: int = 2, saving: float = 0.0, seed: int = 2, cost: int = 25) -> DataFrame:
    """A second pass of the side with for each trial: as many runs as it had, placed where they cut the variance most, or ``runs`` a task where no variance is known."""
    budget = first.filter("side = 'with'").groupBy(C).agg(F.count(F.lit(1)).alias("size"))
    most = first.filter("side = 'with'").select(T).distinct().count() * runs
    tasks = per_task(summarize_tasks(first)).filter("used")
    placed = marginals(tasks, "xw", max(most, 1)).join(budget, C).filter(F.col("r") <= F.col("size")).groupBy(C, T).agg(F.count(F.lit(1)).cast("int").alias("add"))
    every = first.select(C, T).distinct().join(placed.select(C).distinct(), C, "left_anti").withColumn("add", F.lit(runs))
    wanted = placed.unionByName(every).select(F.col(C).alias("trial"), F.col(T).alias("task_id"), F.explode(F.sequence(F.lit(2 * runs + 1), F.lit(2 * runs) + F.col("add"))).alias("run_no"))
    r = drawn(pool, wanted, seed).withColumn("tokens", F.greatest(F.lit(0.0), F.col("tokens") - saving))
    return trial_runs(r, F.lit("with"), cost)


def topped_up_rate(first: DataFrame, extra: DataFrame, z: float = 2.0) -> DataFrame:
    """kept, trials, rate and its interval, where a trial that the first pass leaves uncertain is judged again with its second pass. What regressed, or failed by its environment, isn't kept."""
    once = settled(kept(assess(first, z)).select(C, "kept", "uncertain", "regression", "environment_failure"), "trials")
    open_ = once.filter("uncertain AND NOT regression AND NOT environment_failure").select(C)
    again = kept(assess(first.unionByName(extra).join(open_, C, "left_semi"), z)).select(C, F.col("kept").alias("second"), F.col("environment_failure").alias("failed"))
    j = once.join(again, C, "left").select(F.coalesce(F.col("second") & ~F.col("failed"), F.col("kept") & ~F.col("environment_failure")).alias("kept"), F.col("second").isNotNull().alias("topped_up"))
    g = j.agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("trials"), F.count_if("topped_up").alias("topped_up"))
    return g.withColumn("w", wilson("kept", "trials")).select("kept", "trials", "topped_up", (F.col("kept") / F.col("trials")).alias("rate"), "w.low", "w.high")


def harness_report(pool: DataFrame, trials: int, savings: tuple[float, ...] = (0.0,), runs: int = 2, cost: int = 25, z: float = 2.0) -> DataFrame:
    """method, saving, kept, trials, rate, low, high: how often a rule is kept that saves nothing (permutation, bootstrap) or a known amount (bootstrap)."""
    first = permutation_trials(pool, trials, runs, cost=cost)
    out = topped_up_rate(first, permutation_extra(pool, trials, runs, cost=cost), z).select(F.lit("permutation").alias("method"), F.lit(0.0).alias("saving"), "*")
    for s in savings:
        first = settled(bootstrap_trials(pool, trials, runs, s, cost=cost), "trials")
        out = out.unionByName(topped_up_rate(first, bootstrap_extra(pool, first, runs, s, cost=cost), z).select(F.lit("bootstrap").alias("method"), F.lit(float(s)).alias("saving"), "*"))
    return out


def trial_runs(r: DataFrame, side: Column, cost: int) -> DataFrame:
    return r.select(F.col("trial").alias("comparison_id"), side.alias("side"), "task_id", "run_no", F.col("tokens").cast("double").alias("tokens"), F.lit(True).alias("completed"), F.lit(1.0).alias("weight"), F.lit(cost).alias("context_cost"))


def synthetic_trials(spark: SparkSession, trials: int, runs: int, weights: tuple[float, ...] = (1.0,) * 5, mean: float = 60_000.0, sd: float = 9_000.0, saving: float = 0.0, seed: int = 3, cost: int = 25) -> DataFrame:
    """Normal run totals for tasks of the given weights."""
    tasks = F.array(*[F.struct(F.lit(f"t{i}").alias("task_id"), F.lit(w).alias("weight")) for i, w in enumerate(weights)])
    r = spark.range(trials).select(F.col("id").alias("comparison_id"), F.explode(tasks).alias("t")).select("comparison_id", "t.*").withColumn("run_no", F.explode(F.sequence(F.lit(1), F.lit(2 * runs))))
    off = F.when(F.col("run_no") > runs, saving).otherwise(0.0)
    x = F.greatest(F.lit(0.0), mean - off + sd * normal(F.col("comparison_id"), F.col("task_id"), F.col("run_no"), seed))
    return r.select("comparison_id", F.when(F.col("run_no") > runs, "with").otherwise("without").alias("side"), "task_id", "run_no", x.alias("tokens"), F.lit(True).alias("completed"), "weight", F.lit(cost).alias("context_cost"))


def keep_rate(trial_runs: DataFrame, z: float = 2.0) -> DataFrame:
    return kept(assess(trial_runs, z)).agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("trials"), (F.count_if("kept") / F.count(F.lit(1))).alias("rate"))


def lifetimes(p: Column) -> Column:
    """Expected audits until eviction when an audit is weak with chance p: by one strike, and by two in a row."""
    q = F.when(p > 0, p)
    return F.struct((1 / q).alias("one"), ((1 + q) / (q * q)).alias("two"))


def boundary(t: Column, se: Column, alpha: float = 0.05, rho: float = 1.0) -> Column:
    """Half-width after t audits of the anytime-valid normal-mixture confidence sequence (Howard et al., 2021)."""
    n, r = t * (rho * rho) + 1, rho * rho
    return se * F.sqrt(n / (t * t * r) * F.log(n / (alpha * alpha)))


def retention_trials(spark: SparkSession, trials: int, cycles: int, saving: float, sd: float, bar: float, seed: int = 4) -> DataFrame:
    """Audits of a rule with a true saving under noise, judged by two strikes in a row: the share of rules evicted within ``cycles``."""
    from millrace.operators.windows import two_strikes

    r = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.sequence(F.lit(1), F.lit(cycles))).alias("cycle"))
    audits = r.withColumns({"sub": saving + sd * normal(F.col("trial"), F.col("cycle"), seed) < bar, "regression": F.lit(False), "env": F.lit(False)})
    out = two_strikes(audits, ["trial"], "cycle").groupBy("trial").agg(F.bool_or(F.col("outcome") == "evicted").alias("evicted"))
    return out.agg((F.count_if("evicted") / F.count(F.lit(1))).alias("rate"))
