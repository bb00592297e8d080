"""Paired A/B inference over runs (comparison_id, side, task_id, run_no, tokens, completed, weight).

All comparisons go through one job: everything is grouped by comparison, nothing loops on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import effective_rent, environment_failure, half_up, percent_change, percent_of, processing_tokens

C, T = "comparison_id", "task_id"


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def array_mean(values: Column) -> Column:
    n = F.size(values)
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n)


def variance(values: Column) -> Column:
    """Two-pass sample variance of an array; null under two values."""
    n = F.size(values)
    return let(array_mean(values), lambda mean: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))) / F.when(n >= 2, n - 1)


def median_of(values: Column) -> Column:
    n = F.size(values)
    return let(F.sort_array(values), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def without_outliers(values: Column) -> Column:
    """Values within max(3 MAD, half the median) of the median; all of them where there are fewer than three."""
    far = lambda med: F.greatest(3 * median_of(F.transform(values, lambda x: F.abs(x - med))), 0.5 * F.abs(med))
    kept = let(median_of(values), lambda med: let(far(med), lambda most: F.filter(values, lambda x: F.abs(x - med) <= most)))
    return F.when(F.size(values) < 3, values).otherwise(kept)


def summarize_tasks(runs: DataFrame, spread: float = 0.25, cost: str = "context_cost") -> DataFrame:
    """A row a side and task: its completed totals in run order, their rounded mean, counts, weight, cost (null where runs have none), and whether they spread widely."""
    done = F.col("completed")
    x = F.transform(F.sort_array(F.collect_list(F.when(done, F.struct("run_no", F.col("tokens").cast("double").alias("v"))))), lambda r: r["v"])
    mean = F.avg(F.when(done, F.col("tokens")))
    wide = (F.max(F.when(done, F.col("tokens"))) - F.min(F.when(done, F.col("tokens")))) / F.when(mean > 0, mean) > spread
    return runs.groupBy(C, "side", T).agg(
        x.alias("x"), F.coalesce(half_up(mean), F.lit(0)).alias("mean_tokens"), F.count(F.lit(1)).alias("runs"), F.max("weight").alias("weight"),
        F.bool_and(environment_failure("completed", "tokens")).alias("env"), F.coalesce(wide, F.lit(False)).alias("high_variance"),
        F.max(F.col(cost) if cost in runs.columns else F.lit(None).cast("int")).alias("cost"),
    )


def pass_guard(runs: DataFrame) -> DataFrame:
    """Passes that the environment spoiled: three failures at least, and more than half of all."""
    env = F.count_if(environment_failure("completed", "tokens"))
    return runs.groupBy(C, "side").agg(env.alias("env"), F.count(F.lit(1)).alias("total"), ((env >= 3) & (2 * env > F.count(F.lit(1)))).alias("tripped"))


def pooled(first: DataFrame, more: DataFrame) -> DataFrame:
    """Runs of both, for the tasks that the first has."""
    keys = first.select(C, "side", T).distinct()
    return first.unionByName(more.join(keys, [C, "side", T], "left_semi"))


def per_task(summaries: DataFrame) -> DataFrame:
    """Each task of the side without: both sides' totals, its saving, and what keeps it out."""
    side = lambda s: F.max_by(F.struct("x", "mean_tokens", "runs", "weight", "env"), F.when(F.col("side") == s, F.lit(1)))
    j = summaries.groupBy(C, T).agg(side("without").alias("o"), side("with").alias("w"), F.max("cost").alias("cost")).filter("o IS NOT NULL")
    j = j.select(C, T, "cost", F.col("o.weight").alias("weight"), *[F.col(f"{s}.{c}").alias(n + s) for s in "ow" for c, n in (("x", "x"), ("mean_tokens", "m"), ("runs", "n"), ("env", "e"))])
    got_o, got_w = F.size("xo") > 0, F.coalesce(F.size("xw") > 0, F.lit(False))
    return j.select(
        C, T, "cost", "weight", "xo", "xw", (got_o & got_w).alias("used"), F.when(got_o & got_w, F.col("mo") - F.col("mw")).alias("saving"),
        F.when(~got_o, F.col("eo")).when(~got_w, F.coalesce("ew", F.lit(True))).otherwise(False).alias("env"),
        F.when(got_o & ~got_w, ~F.coalesce("ew", F.lit(True))).otherwise(False).alias("regression"),
        F.when(got_o & got_w, F.size("xw") / F.col("nw") < F.size("xo") / F.col("no")).otherwise(False).alias("drop"),
    )


def t_inflation(df: Column, z: Column | float) -> Column:
    return F.when(df > 0, 1 + (F.lit(z) * F.lit(z) + 1) / (4 * F.when(df > 0, df))).otherwise(1.0)


def folded(tasks: DataFrame, sides: dict[str, tuple[str, str]], *more: Column) -> DataFrame:
    """A row a comparison: the used tasks as an array ``ts`` (weight, saving and, for each name in ``sides``, variances, sizes and means of its two columns), pooled variances, and ``more``.

    A comparison has the tasks of one suite, so what comes together is small, and all of its statistics follow without a join.
    """
    cols, fields = {}, []
    for p, (o, w) in sides.items():
        for s, c in (("o", o), ("w", w)):
            cols |= {f"{p}v{s}": variance(F.col(c)), f"{p}n{s}": F.size(c), f"{p}m{s}": array_mean(F.col(c))}
            fields += [f"{p}v{s}", f"{p}n{s}", f"{p}m{s}"]
    used = F.col("used")
    pool = lambda c, n: F.sum(F.when(used, F.col(c) * (F.col(n) - 1))) / F.sum(F.when(used & (F.col(n) >= 2), F.col(n) - 1))
    return tasks.withColumns(cols).groupBy(C).agg(
        F.sort_array(F.collect_list(F.when(used, F.struct(T, F.col("weight").cast("double").alias("weight"), F.col("saving").cast("double").alias("saving"), *fields)))).alias("ts"),
        *[pool(f"{p}v{s}", f"{p}n{s}").alias(f"{p}p{s}") for p in sides for s in "ow"], *more,
    )


def total(f) -> Column:
    """The sum of f(task) over the tasks of a comparison."""
    return F.aggregate("ts", F.lit(0.0), lambda a, x: a + f(x))


def summed(f: DataFrame, *names: str) -> DataFrame:
    """Rows of ``folded`` with sw, sw2, even and mean, and for each of ``names`` the sums of its tasks' variances, weighed (a, aa) and not (u, uu)."""
    weights = F.transform("ts", lambda x: x["weight"])
    f = f.withColumns({"k": F.size("ts"), "sw": total(lambda x: x["weight"]), "sw2": total(lambda x: x["weight"] * x["weight"]), "even": F.array_min(weights) == F.array_max(weights), "sws": total(lambda x: x["weight"] * x["saving"])})
    term = lambda p: lambda x: F.struct(
        x["weight"].alias("w"), (F.coalesce(x[f"{p}vo"], F.col(f"{p}po")) / x[f"{p}no"] + F.coalesce(x[f"{p}vw"], F.col(f"{p}pw")) / x[f"{p}nw"]).alias("u"),
        F.greatest(F.lit(1), x[f"{p}no"] - 1 + x[f"{p}nw"] - 1).alias("d"),
    )
    f = f.withColumns({"mean": F.when(F.col("k") > 0, F.col("sws") / F.when(F.col("k") > 0, F.col("sw")))} | {f"{p}terms": F.transform("ts", term(p)) for p in names})
    sums = lambda p: F.aggregate(
        f"{p}terms", F.struct(*[F.lit(0.0).alias(n) for n in ("a", "aa", "u", "uu")], F.lit(False).alias("flat")),
        lambda s, x: F.struct(
            (s["a"] + x["w"] * x["w"] * x["u"]).alias("a"), (s["aa"] + F.pow(x["w"], F.lit(4)) * x["u"] * x["u"] / x["d"]).alias("aa"), (s["u"] + x["u"]).alias("u"), (s["uu"] + x["u"] * x["u"] / x["d"]).alias("uu"),
            (s["flat"] | F.coalesce(x["u"] <= 0, F.lit(True))).alias("flat"),
        ),
    )
    return f.withColumns({f"{p}sum": sums(p) for p in names})


def within(p: str = "", z: float = 2.0) -> tuple[Column, Column]:
    """(standard error from the spread within tasks, null unless each side has a task with two values; the inflation that uneven weights ask for), over rows of ``summed``."""
    known, s = F.col(f"{p}po").isNotNull() & F.col(f"{p}pw").isNotNull(), F.col(f"{p}sum")
    df = lambda n, d: F.when(s[d] > 0, s[n] * s[n] / F.when(s[d] > 0, s[d]))
    ratio = F.greatest(F.lit(1.0), t_inflation(df("a", "aa"), z) / t_inflation(df("u", "uu"), z))
    return F.when(known, F.sqrt(s["a"]) / F.col("sw")), F.when(~known | F.col("even") | s["flat"], 1.0).otherwise(ratio)


def between(z: float = 2.0) -> tuple[Column, Column]:
    """(standard error from the spread of savings between tasks, null under two tasks; its inflation), over rows of ``summed``."""
    k, sw, sw2 = F.col("k"), F.col("sw"), F.col("sw2")
    several = k >= 2
    var = total(lambda x: x["weight"] * (x["saving"] - F.col("mean")) * (x["saving"] - F.col("mean"))) / F.when(several, sw - sw2 / F.when(several, sw))
    eff = F.greatest(F.lit(1.0), sw * sw / F.when(several, sw2) - 1)
    inflation = F.when(~several | F.col("even"), 1.0).otherwise(F.greatest(F.lit(1.0), t_inflation(eff, z) / t_inflation((k - 1).cast("double"), z)))
    return F.when(several, F.sqrt(var * sw2) / F.when(several, sw)), inflation


def between_error(tasks: DataFrame, z: float = 2.0) -> DataFrame:
    """Weighted mean saving, number of tasks, and the standard error from its spread between tasks with its inflation."""
    se, inflation = between(z)
    return summed(folded(tasks, {"": ("xo", "xw")})).select(C, "mean", "k", se.alias("se_between"), inflation.alias("inflation_between"))


def assess(runs: DataFrame, z: float = 2.0, sessions: float = 20.0, cost: str = "context_cost") -> DataFrame:
    """One row a comparison: delta, flags, standard error and its basis, confidence multiple, uncertain, robust delta, tail risk."""
    tasks = per_task(summarize_tasks(runs, cost=cost)).withColumns({"ro": without_outliers(F.col("xo")), "rw": without_outliers(F.col("xw"))})
    flags = [F.bool_or(c).alias(n) for c, n in (("regression", "regression"), ("env", "environment_failure"), ("drop", "completion_drop"))]
    f = folded(tasks, {"": ("xo", "xw"), "r": ("ro", "rw")}, *flags, F.max("cost").alias("cost"))
    se_out, inflation_out = between(z)
    (se_in, inflation_in), (robust_se, _) = within("", z), within("r", z)
    some = F.col("k") > 0
    robust = F.when(some, total(lambda x: x["weight"] * (x["rmo"] - x["rmw"])) / F.when(some, F.col("sw")))
    f = summed(f, "", "r").withColumns({"se_in": se_in, "in_in": inflation_in, "se_out": se_out, "in_out": inflation_out, "robust_mean": robust, "robust_se": robust_se})
    se = F.coalesce("se_in", "se_out")
    multiple = F.lit(z) * F.when(F.col("se_in").isNotNull(), F.col("in_in")).when(F.col("se_out").isNotNull(), F.col("in_out")).otherwise(1.0)
    basis = F.when(F.col("se_in").isNotNull(), "within-task").when(F.col("se_out").isNotNull(), "between-task")
    unsure = ~F.col("regression") & se.isNotNull() & (F.abs(F.col("mean") - 2 * effective_rent("cost", sessions)) < multiple * se)
    tail = F.col("se_in").isNotNull() & F.col("robust_se").isNotNull() & (F.abs(F.col("mean") - F.col("robust_mean")) > F.col("robust_se"))
    return f.select(
        C, half_up("mean").alias("delta"), "regression", se.alias("standard_error"), basis.alias("basis"), multiple.alias("multiple"), F.coalesce(unsure, F.lit(False)).alias("uncertain"),
        F.when(F.col("robust_se").isNotNull(), half_up("robust_mean")).alias("robust_delta"), F.coalesce(tail, F.lit(False)).alias("tail_risk"), "completion_drop", "environment_failure",
        "cost", F.col("k").alias("tasks"),
    )


def pooled_of(c: str) -> Column:
    """Over tasks: the pooled variance of the arrays in ``c`` with two values at least; null where there are none."""
    return F.sum(variance(F.col(c)) * (F.size(c) - 1)) / F.sum(F.when(F.size(c) >= 2, F.size(c) - 1))


def marginals(tasks: DataFrame, side: str, most: int) -> DataFrame:
    """By task, what each of up to ``most`` further runs on ``side`` would cut from the variance: w²s²/(n(n+1)); a task with one run borrows the pooled variance."""
    p = tasks.groupBy(C).agg(pooled_of(side).alias("pooled")).withColumnRenamed(C, "__c")
    v = F.col("weight") * F.col("weight") * F.coalesce(variance(F.col(side)), F.col("pooled"))
    steps = tasks.filter(F.size(side) > 0).join(p.filter("pooled IS NOT NULL"), F.col(C) == F.col("__c")).withColumn("v", v).filter("v > 0")
    steps = steps.select(C, T, "v", F.size(side).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("j"))
    gain = steps.withColumn("gain", F.col("v") / ((F.col("n") + F.col("j")) * (F.col("n") + F.col("j") + 1)))
    return gain.withColumn("r", F.row_number().over(Window.partitionBy(C).orderBy(F.desc("gain"), T, "j")))


def top_up(tasks: DataFrame, budget: int, side: str = "xw") -> DataFrame:
    """Runs to add by task: each goes where it cuts most, so they are the ``budget`` largest of the tasks' falling marginals. None where no variance is known."""
    return marginals(tasks, side, budget).filter(F.col("r") <= budget).groupBy(C, T).agg(F.count(F.lit(1)).alias("add"))


def retention_rounds(assessed: DataFrame, banked: str = "delta", sessions: float = 20.0, most: int = 2) -> DataFrame:
    """Per comparison the extra rounds of ``rounds_of``."""
    return assessed.select(C, rounds_of(banked, sessions, most).alias("rounds"))


def rounds_of(banked: str = "delta", sessions: float = 20.0, most: int = 2) -> Column:
    """Extra rounds before a weak audit may count as a strike, by how far noise could reach into the margin; over rows of ``assess``."""
    margin = F.col(banked) - 2 * effective_rent("cost", sessions)
    need = F.ceil(F.col("multiple") * F.col("standard_error") / F.when(margin > 0, margin)) - 1
    ok = ~F.col("regression") & F.col(banked).isNotNull() & F.col("standard_error").isNotNull() & (margin > 0)
    return F.when(ok, F.least(F.greatest(need, F.lit(0)), F.lit(most))).otherwise(0).cast("int")


def comparison_tasks(runs: DataFrame) -> DataFrame:
    """A row a task of both sides: means of processing, total and cache-read tokens over completed runs (0 without), completions, change in percent, mean durations, and whether the side `with` failed by its environment.

    runs: as for ``assess``, with cache_read and duration_ms; tokens are processing tokens.
    """
    done = F.col("completed")
    mean = lambda x: F.coalesce(F.avg(F.when(done, x)), F.lit(0.0))
    g = runs.groupBy(C, "side", T).agg(
        mean(F.col("tokens")).alias("processing"), mean(F.col("tokens") + F.col("cache_read")).alias("total"), mean(F.col("cache_read")).alias("cache_read"), F.count_if(done).alias("completed"),
        F.count(F.lit(1)).alias("runs"), half_up(F.avg(F.when(done, F.col("duration_ms")))).alias("duration"), F.bool_and(environment_failure("completed", "tokens")).alias("env"),
    )
    names = ("processing", "total", "cache_read", "completed", "duration", "env")
    side = lambda s, p: g.filter(F.col("side") == s).select(C, T, *[F.col(n).alias(p + n) for n in names], *([F.col("runs")] if p else []))
    j = side("without", "base_").join(side("with", ""), [C, T])
    both = (F.col("base_completed") > 0) & (F.col("completed") > 0)
    return j.select(
        C, T, "runs", *[x + n for n in names[:5] for x in ("base_", "")], percent_change("processing", "base_processing").alias("change"), both.alias("comparable"),
        ((F.col("base_completed") > 0) & (F.col("completed") == 0) & ~F.col("env")).alias("regressed"), ((F.col("base_completed") > 0) & (F.col("completed") == 0) & F.col("env")).alias("env_failed"),
    )


def compare_configs(runs: DataFrame, z: float = 2.0) -> DataFrame:
    """Two configurations without rent: assess at cost 0; percent change of the mean over the tasks that both sides completed; mean durations over all tasks that have one."""
    both = F.col("comparable")
    over = lambda c: F.avg(F.when(both, F.col(c)))
    t = comparison_tasks(runs).groupBy(C).agg(
        over("base_processing").alias("base_mean"), over("processing").alias("mean"), F.sum("base_completed").alias("base_completed"), F.sum("completed").alias("completed"),
        half_up(F.avg("base_duration")).alias("base_duration"), half_up(F.avg("duration")).alias("duration"),
        F.sort_array(F.collect_list(F.when(F.col("regressed"), F.col(T)))).alias("regressed"), F.sort_array(F.collect_list(F.when(F.col("env_failed"), F.col(T)))).alias("env_failed"),
    )
    a = assess(runs.withColumn("context_cost", F.lit(0)), z)
    change = percent_change(F.coalesce("mean", F.lit(0.0)), F.coalesce("base_mean", F.lit(0.0)))
    return a.join(t, C, "left").withColumn("change", change).withColumn("verdict", verdict_line())


def category_regressions(compared: DataFrame) -> DataFrame:
    """Of each category (a comparison): regressed, no verdict (its environment failed) or none, with the tasks concerned, and whether the change is safe in all of them.

    A regression anywhere makes the change unsafe; without one, an environment failure leaves safety unproven.
    """
    dead = F.col("environment_failure") | (F.size("env_failed") > 0)
    told = compared.select(
        C, F.when((F.size("regressed") > 0) | F.col("regression"), "regressed").when(dead, "no verdict").otherwise("none").alias("status"),
        F.when(F.size("regressed") > 0, F.col("regressed")).otherwise(F.col("env_failed")).alias("tasks"), "regression", dead.alias("dead"),
    )
    whole = told.agg(F.when(F.bool_or("regression"), "unsafe").when(F.bool_or("dead"), "unproven").otherwise("safe").alias("safety"))
    return told.select(C, "status", "tasks").withColumn("safety", whole.scalar())


def run_comparison(first: DataFrame, more: DataFrame, top_up: bool = True, z: float = 2.0) -> DataFrame:
    """Comparisons of the first pass; where noise leaves one open, both sides are pooled with a second pass ``more``, once, for the tasks that the first has.

    tokens_spent counts all tokens of the runs that were used, topped_up whether the second pass was.
    """
    once = compare_configs(first, z)
    open_ = once.filter("uncertain").select(C)
    runs = pooled(first, more.join(open_, C, "left_semi")) if top_up else first
    spent = runs.groupBy(C).agg(F.sum(F.col("tokens") + F.col("cache_read")).alias("tokens_spent"))
    again = compare_configs(runs, z) if top_up else once
    return again.join(spent, C).join(open_.withColumn("topped_up", F.lit(top_up)), C, "left").withColumn("topped_up", F.coalesce("topped_up", F.lit(False)))


def model_sides(runs: DataFrame, candidate: str, baselines: DataFrame) -> DataFrame:
    """Runs (agent, task_hash, model, ...) of a sweep as two sides: the ``candidate`` model with, each agent's own (agent, model) without.

    An agent whose own model is the candidate has nothing to compare and is left out, as are runs under other models.
    """
    own = baselines.filter(F.col("model") != candidate).select("agent", F.col("model").alias("own"))
    side = F.when(F.col("model") == candidate, "with").when(F.col("model") == F.col("own"), "without")
    return runs.filter("task_hash IS NOT NULL").join(own, "agent").withColumn("side", side).filter("side IS NOT NULL").select(
        F.col("agent").alias(C), "side", F.col("task_hash").alias(T), F.col("id").alias("run_no"), processing_tokens().alias("tokens"), "completed", F.lit(1.0).alias("weight"), F.lit(0).alias("context_cost"), "cache_read", "duration_ms"
    )


def bench_report(passes: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per agent and task of a benchmark pass (agent, task_id, tokens, completed): its mean over completed runs beside the frozen first run and the best, and all tokens spent."""
    mean = F.coalesce(half_up(F.avg(F.when(F.col("completed"), F.col("tokens")))), F.lit(0))
    g = passes.groupBy("agent", T).agg(mean.alias("mean_tokens"), F.sum("tokens").alias("spent"))
    b = baselines.select("agent", F.col("task_hash").alias(T), "run1_tokens", "best_tokens")
    note = F.when(F.col("run1_tokens").isNull(), "no baseline (no completed run yet)").otherwise(percent_of("mean_tokens", "run1_tokens"))
    return g.join(b, ["agent", T], "left").withColumn("change", note)


def verdict_line() -> Column:
    """Only a saving above 0 is cheaper; no difference, or none known, counts as dearer."""
    return (
        F.when(F.col("regression"), "regression").when(F.col("environment_failure"), "environment failure").when(F.col("tasks") < 2, "too few tasks")
        .when(F.col("uncertain"), "uncertain").when(F.coalesce("delta", F.lit(0)) > 0, "cheaper").otherwise("dearer")
    )


def failed_tasks(runs: DataFrame) -> DataFrame:
    """Tasks that one side completed and the other didn't: regressed ones, and ones that the environment failed."""
    t = per_task(summarize_tasks(runs)).filter("regression OR env")
    return t.groupBy(C).agg(F.sort_array(F.collect_list(F.when(F.col("regression"), F.col(T)))).alias("regressed"), F.sort_array(F.collect_list(F.when(F.col("env"), F.col(T)))).alias("environment"))


def side_totals(runs: DataFrame) -> DataFrame:
    """What a receipt keeps of each side: mean tokens of completed runs, tasks, tasks passed."""
    return runs.groupBy(C, "side").agg(
        half_up(F.avg(F.when(F.col("completed"), F.col("tokens")))).alias("tokens"), F.countDistinct(T).alias("tasks"), F.countDistinct(F.when(F.col("completed"), F.col(T))).alias("passed")
    )


def pooled_variance(replicates: DataFrame) -> DataFrame:
    """Sum of squares over degrees of freedom of all groups with two values."""
    g = replicates.groupBy("agent", "task", "version", "model").agg(F.count(F.lit(1)).alias("n"), F.var_samp("total").alias("v")).filter("n >= 2")
    return g.groupBy("agent").agg((F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("pooled"), F.count(F.lit(1)).alias("groups"))
