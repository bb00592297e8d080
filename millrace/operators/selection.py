"""Decisions about rules from recorded runs: what is measured against what, topping up, verdicts, receipts.

Runs are rows (comparison_id, side, task_id, run_no, tokens, completed, weight, context_cost). Runs beyond the first pass wait in a reserve with a
`round` column; topping up moves them over, as measuring again would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import DEFAULT_SESSIONS, half_up, verdict, verdict_reason
from millrace.operators.inference import C, T, assess, marginals, pass_guard, per_task, retention_rounds, side_totals, summarize_tasks, top_up
from millrace.sources.registry import settled

AUDIT, CANDIDATE = "re-audit", "candidate"


def comparison_plans(rules: DataFrame, candidates: int = 3) -> DataFrame:
    """What to measure for each agent: up to ``candidates`` pending rules, oldest first, and the active unprotected rule decided longest ago.

    rules: id, agent, status, replaces, protected, created_at, decided_at. with_rules and without_rules are the sets compared: a candidate joins the
    active rules; one that replaces an active rule joins them without it; an audited rule is taken out.
    """
    active = rules.filter("status = 'active'").groupBy("agent").agg(F.sort_array(F.collect_list("id")).alias("active"))
    w = Window.partitionBy("agent")
    new = rules.filter("status = 'candidate'").withColumn("n", F.row_number().over(w.orderBy("created_at", "id"))).filter(F.col("n") <= candidates)
    old = rules.filter("status = 'active' AND NOT protected").withColumn("n", F.row_number().over(w.orderBy(F.col("decided_at").asc_nulls_first(), "id"))).filter("n = 1")
    both = new.withColumn("kind", F.lit(CANDIDATE)).unionByName(old.withColumn("kind", F.lit(AUDIT))).join(active, "agent", "left")
    now = F.coalesce("active", F.array().cast("array<long>"))
    swap = (F.col("kind") == CANDIDATE) & F.coalesce(F.array_contains(now, F.col("replaces")), F.lit(False))
    without = F.when(F.col("kind") == AUDIT, F.array_remove(now, F.col("id"))).when(swap, F.array_remove(now, F.coalesce("replaces", F.lit(-1)))).otherwise(now)
    prefix = F.when(F.col("kind") == AUDIT, "re-audit: ").when(swap, F.concat(F.lit("swap for rule "), F.col("replaces").cast("string"), F.lit(": "))).otherwise("")
    return both.select(
        "agent", F.col("id").alias("rule_id"), "kind", "n", F.when(F.col("kind") == AUDIT, now).otherwise(F.concat(without, F.array("id"))).alias("with_rules"), without.alias("without_rules"),
        F.when(F.col("kind") == AUDIT, "without").otherwise("with").alias("measured_side"), prefix.alias("prefix"),
    )


def run_config(label: str | Column, baseline: bool = False) -> Column:
    """The ledger's config of a run by its label; a run that records baselines is of the active set."""
    x = F.col(label) if isinstance(label, str) else label
    return F.lit("active") if baseline else F.when(x.startswith("audit-"), "audit").otherwise("candidate")


def spoiled(runs: DataFrame) -> DataFrame:
    """Comparisons that can't be judged, since the environment spoiled a pass of theirs."""
    return pass_guard(runs).filter("tripped").select(C).distinct()


def measured(runs: DataFrame, reserve: DataFrame, kinds: DataFrame, z: float = 2.0, sessions: float = DEFAULT_SESSIONS, most_rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(assessments with rounds, runs) after topping up from ``reserve`` (runs with `round`, from 1) while a comparison is uncertain.

    kinds: comparison_id, kind, banked, measured_side. The first round adds as many runs as the measured side has, where they cut the variance most, or all of the
    round where no variance is known. Audits whose noise reaches into the banked margin may take ``most_rounds`` further rounds on both sides.
    """
    # each round builds on what the one before measured, so its plan ends there
    runs, kinds = runs.transform(settled), kinds.transform(settled)
    state = assess(runs, z, sessions).transform(settled)
    more = state.join(kinds, C, "left")
    extra = retention_rounds(more, "banked", sessions, most_rounds).withColumnRenamed("rounds", "extra")
    budget = state.select(C).join(kinds, C, "left").join(extra, C).select(C, "measured_side", (F.lit(1) + F.when(F.col("kind") == AUDIT, F.col("extra")).otherwise(0)).alias("budget")).transform(settled)
    taken = state.select(C, F.lit(0).alias("rounds"))
    for k in range(1, most_rounds + 2):
        todo = state.filter("uncertain").select(C).join(budget.filter(F.col("budget") >= k), C)
        mine = reserve.filter(F.col("round") == k).join(todo, C)
        if k == 1:
            mine = mine.filter(F.col("side") == F.col("measured_side"))
            tasks = per_task(summarize_tasks(runs)).filter("used")
            sizes = runs.join(budget, C).filter(F.col("side") == F.col("measured_side")).groupBy(C).agg(F.count(F.lit(1)).alias("size"))
            # marginals are ranked once for the largest budget; each comparison takes as many as it has runs
            most = runs.groupBy(C, "side").count().agg(F.max("count")).first()[0] or 1
            side = tasks.join(budget, C).withColumn("x", F.when(F.col("measured_side") == "with", F.col("xw")).otherwise(F.col("xo")))
            wants = allocated(side, sizes, most)
            mine = mine.withColumn("nth", F.row_number().over(Window.partitionBy(C, T).orderBy("run_no"))).join(wants, [C, T], "left").join(wants.select(C).distinct().withColumn("known", F.lit(True)), C, "left")
            mine = mine.filter(F.col("known").isNull() | (F.col("nth") <= F.coalesce("add", F.lit(0))))
        if todo.isEmpty():
            break
        runs = runs.unionByName(mine.select(*runs.columns)).transform(settled)
        taken = taken.unionByName(todo.select(C, F.lit(k).alias("rounds"))).transform(settled)
        state = assess(runs, z, sessions).transform(settled)
    rounds = taken.groupBy(C).agg(F.max("rounds").alias("rounds"))
    return state.join(rounds, C), runs


def allocated(tasks: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Runs to add by task, as many in all as ``sizes`` says for the comparison."""
    return marginals(tasks, "x", most).join(sizes, C).filter(F.col("r") <= F.col("size")).groupBy(C, T).agg(F.count(F.lit(1)).alias("add"))


def decide(assessed: DataFrame, kinds: DataFrame, sessions: float = DEFAULT_SESSIONS) -> DataFrame:
    """comparison_id, status, reason: a candidate must be sure to earn its rent; an audited rule stays while it is in doubt.

    assessed: rows of ``measured`` (with rounds) or of ``assess``.
    """
    a = assessed if "rounds" in assessed.columns else assessed.withColumn("rounds", F.lit(0))
    a = a.join(kinds.select(C, "kind"), C)
    base = F.when(F.col("regression"), "evicted").otherwise(verdict("delta", "cost", sessions))
    doubt = F.col("uncertain") & (F.col("kind") == CANDIDATE) & (base == "active")
    notes = F.array_compact(F.array(F.when(F.col("rounds") > 0, "after variance top-up"), F.when(F.col("uncertain"), "low confidence: within one SE of flipping")))
    reason = verdict_reason("delta", "cost", "regression", sessions)
    reason = F.when(doubt, F.concat(F.lit("uncertain"), F.when(F.col("rounds") > 0, " after top-up").otherwise(""), F.lit(": measured savings ("), F.col("delta").cast("string"), F.lit(") within one standard error of the 2× rent threshold — not confidently earning"))).when(
        F.size(notes) > 0, F.concat(reason, F.lit(" ("), F.array_join(notes, "; "), F.lit(")"))
    ).otherwise(reason)
    return a.select(C, F.when(doubt, "evicted").otherwise(base).alias("status"), reason.alias("reason"))


def receipts(runs: DataFrame, assessed: DataFrame, decided: DataFrame, decided_at: Column) -> DataFrame:
    """One receipt a comparison: verdict, evidence, and what either side cost and passed. One table, so a decision is stored as a whole or not at all."""
    sides = side_totals(runs)
    side = lambda s: sides.filter(F.col("side") == s).select(C, F.col("tokens").alias(f"{s}_tokens"), F.col("tasks").alias(f"{s}_tasks"), F.col("passed").alias(f"tasks_passed_{s}"))
    most = runs.groupBy(C, "side", T).count().groupBy(C).agg(F.max("count").alias("runs"))
    out = assessed.join(decided, C).join(side("with"), C, "left").join(side("without"), C, "left").join(most, C)
    return out.select(
        C, decided_at.alias("decided_at"), "status", "reason", "runs", "delta", F.col("cost").alias("context_cost"), half_up("standard_error").alias("standard_error"), "regression",
        "with_tokens", "without_tokens", F.col("without_tasks").alias("tasks_total"), "tasks_passed_with", "tasks_passed_without",
    )


def decision_flags() -> Column:
    """Names of what a reader should know about an assessment."""
    names = ("regression", "environment_failure", "completion_drop", "tail_risk", "uncertain")
    return F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))


def duration_means(runs: DataFrame) -> DataFrame:
    """By comparison and side the mean of the tasks' mean durations over completed runs that have one; null where none has."""
    task = runs.filter(F.col("completed") & F.col("duration_ms").isNotNull()).groupBy(C, "side", T).agg(half_up(F.avg("duration_ms")).alias("d"))
    return runs.select(C, "side").distinct().join(task, [C, "side"], "left").groupBy(C, "side").agg(half_up(F.avg("d")).alias("duration_ms"))


__all__ = ["allocated", "comparison_plans", "decide", "decision_flags", "duration_means", "measured", "receipts", "run_config", "spoiled", "top_up"]
