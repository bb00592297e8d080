"""Ledger queries: curves, mixes, top-k, latest per key, conditional counts, and writes as re-derived state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import footprint, percent_change, total_tokens, truncated_mean
from millrace.schemas import golden, real_work, replicates

UNKNOWN = "(unknown)"


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def where(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; None means no filter."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


# reads


def curve_by_agent(runs: DataFrame) -> DataFrame:
    return runs.filter(real_work() & F.col("completed")).groupBy("agent", "ruleset_version").agg(F.count(F.lit(1)).alias("runs"), truncated_mean(total_tokens()).alias("avg_tokens"))


def projects_by_usage(runs: DataFrame, limit: int) -> DataFrame:
    """Count and sum of real work by project, the largest first; a missing project is a project of its own."""
    named = runs.filter(real_work()).select(F.coalesce("project", F.lit(UNKNOWN)).alias("project"), total_tokens().alias("total"))
    return named.groupBy("project").agg(F.count(F.lit(1)).alias("runs"), F.sum("total").alias("total_tokens")).orderBy(F.desc("total_tokens"), "project").limit(limit)


def curve_by_project(runs: DataFrame, limit: int = 5) -> DataFrame:
    """The curve of the projects with most tokens; work without a subagent ('main') is left out."""
    work = runs.filter(real_work() & F.col("completed") & (F.col("agent") != "main")).withColumn("project", F.coalesce("project", F.lit(UNKNOWN)))
    top = work.groupBy("project").agg(F.sum(total_tokens()).alias("s")).orderBy(F.desc("s"), "project").limit(limit)
    return work.join(F.broadcast(top.select("project")), "project", "left_semi").groupBy("project", "ruleset_version").agg(F.count(F.lit(1)).alias("runs"), truncated_mean(total_tokens()).alias("avg_tokens"))


def curve_lists(curve: DataFrame) -> DataFrame:
    """Per project its versions in order, and the change of the last against the first."""
    points = F.sort_array(F.collect_list(F.struct("ruleset_version", "runs", "avg_tokens")))
    out = curve.groupBy("project").agg(points.alias("points"))
    first, last = F.col("points")[0]["avg_tokens"], F.element_at("points", -1)["avg_tokens"]
    return out.withColumn("change", percent_change(last, first))


COUNTERS = ("input_tokens", "output_tokens", "cache_creation", "cache_read")


def token_mix(runs: DataFrame, agent: str | None = None) -> DataFrame:
    """Sums of the four counters over an agent's completed runs of any kind."""
    return where(runs.filter("completed"), agent=agent).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def tool_cost_rollup(tool_costs: DataFrame, runs: DataFrame, agent: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Calls and characters by tool over real work, the largest footprint first."""
    work = where(runs.filter(real_work()), agent=agent).select(F.col("id").alias("run_id"))
    sums = [F.sum(c).alias(c) for c in ("calls", "input_chars", "result_chars")]
    # a row a run and class first: the join's shuffle by run serves it, and distinct runs are then mere rows
    each = where(tool_costs, kind=kind).join(work, "run_id", "left_semi").groupBy("run_id", "kind", "grp", "label").agg(*sums)
    out = each.groupBy("kind", "grp", "label").agg(F.count(F.lit(1)).alias("sessions"), *sums).withColumn("footprint", footprint())
    return out.orderBy(F.desc("footprint"), "label", "kind", "grp").limit(limit) if limit else out


def kind_rollup(tool_costs: DataFrame) -> DataFrame:
    """By kind and in all (kind null)."""
    return tool_costs.rollup("kind").agg(F.sum("calls").alias("calls"), F.sum(footprint()).alias("footprint"))


def candidate_counts(rules: DataFrame) -> DataFrame:
    return rules.filter("status = 'candidate'").groupBy("agent").agg(F.count(F.lit(1)).alias("pending"))


def nudge(counts: DataFrame, least: int = 1) -> DataFrame:
    """One line that names the agents with pending rules, the most first."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("pending")).alias("n"), "agent"))), lambda x: F.concat(x["agent"], F.lit(": "), (-x["n"]).cast("string"))), ", ")
    return counts.agg(F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"), listed.alias("agents"), F.max_by("agent", F.struct("pending", "agent")).alias("top")).filter(F.col("pending") >= least)


def question_counts(questions: DataFrame) -> DataFrame:
    return questions.agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("approved") == 1).alias("approved"))


def run_counts(runs: DataFrame, by_agent: bool = False) -> DataFrame:
    return (runs.groupBy("agent") if by_agent else runs).agg(F.count_if(real_work()).alias("real"), F.count_if(golden()).alias("golden"))


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("agent").pivot("status", ["candidate", "active", "evicted"]).agg(F.count(F.lit(1))).na.fill(0)


def learning_curve(runs: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return runs.filter(replicates()).groupBy("agent", day).agg(F.count(F.lit(1)).alias("runs"), truncated_mean(total_tokens()).alias("avg_tokens"))


def last_measurement(runs: DataFrame) -> DataFrame:
    """One row: when anything was last measured, for whichever agent."""
    return runs.filter(F.col("config").isin("active", "candidate", "audit")).agg(F.max("ts").alias("last_ts"))


def recent_tokens(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return runs.filter(real_work() & (F.col("ts") >= now - F.make_interval(days=F.lit(days)))).agg(F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("tokens"))


def totals_by_version(runs: DataFrame, agent: str | None = None, project: str | None = None) -> DataFrame:
    return where(runs.filter(real_work() & F.col("completed")), agent=agent, project=project).select("agent", "ruleset_version", total_tokens().alias("total"))


def golden_totals(runs: DataFrame) -> DataFrame:
    """Totals of the active set's completed golden runs; passes with other rules would look like noise."""
    return runs.filter(replicates()).select("agent", F.col("task_hash").alias("task"), total_tokens().alias("total"), "ts", "id")


def golden_replicates(runs: DataFrame) -> DataFrame:
    return runs.filter(replicates()).select("agent", F.col("task_hash").alias("task"), F.col("ruleset_version").alias("version"), F.coalesce("model", F.lit("")).alias("model"), total_tokens().alias("total"))


def already_distilled(runs: DataFrame, rules: DataFrame) -> DataFrame:
    return runs.join(rules.filter("source_run IS NOT NULL").select(F.col("source_run").alias("id")), "id", "left_semi")


def latest_receipts(receipts: DataFrame, rules: DataFrame, order: str = "decided_no") -> DataFrame:
    """Each rule's last receipt with the rule's body; unmeasured ones last, then the largest saving first."""
    last = latest(receipts, ["rule_id"], [F.col(order).desc()])
    bodies = rules.select(F.col("id").alias("rule_id"), "body")
    return last.join(bodies, "rule_id").orderBy(F.col("delta").desc_nulls_last(), "rule_id")


def baselines(runs: DataFrame) -> DataFrame:
    """The first run's total, frozen, and the best since, per agent and task; runs of the active set alone count."""
    done = runs.filter(replicates()).withColumn("total", total_tokens())
    return done.groupBy("agent", "task_hash").agg(F.min_by("total", F.struct("ts", "id")).alias("run1_tokens"), F.min("total").alias("best_tokens"), F.max("ts").alias("updated_at"))


def suite_comparison(runs: DataFrame) -> DataFrame:
    """Each baseline against the latest completed golden run of its task, or against itself where there is none."""
    done = runs.filter(replicates())
    now = latest(done, ["agent", "task_hash"], [F.col("ts").desc(), F.col("id").desc()]).select("agent", "task_hash", total_tokens().alias("now"))
    joined = baselines(runs).join(now, ["agent", "task_hash"], "left").withColumn("latest_tokens", F.coalesce("now", "run1_tokens"))
    sums = [F.sum(c).alias(n) for c, n in (("run1_tokens", "baseline_tokens"), ("latest_tokens", "latest_tokens"), ("best_tokens", "best_tokens"))]
    return joined.groupBy("agent").agg(*sums, F.count(F.lit(1)).alias("tasks")).withColumn("change", percent_change("latest_tokens", "baseline_tokens"))


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.filter("status = 'active'").orderBy("agent", F.col("measured_delta").desc_nulls_last(), "id")


def oldest_candidates(rules: DataFrame, n: int = 3, order: str = "created_s") -> DataFrame:
    return latest(rules.filter("status = 'candidate'"), ["agent"], [F.col(order).asc(), F.col("id").asc()], n)


def last_evictions(rules: DataFrame, n: int = 5, order: str = "decided_s") -> DataFrame:
    return latest(rules.filter("status = 'evicted'"), ["agent"], [F.col(order).desc_nulls_last(), F.col("id").desc()], n)


def next_audit(rules: DataFrame, order: str = "decided_s") -> DataFrame:
    """The active unprotected rule that was decided longest ago, never decided ones first."""
    return latest(rules.filter("status = 'active' AND NOT protected"), ["agent"], [F.col(order).asc_nulls_first(), F.col("id").asc()])


def rules_of_agent(rules: DataFrame, agent: str) -> DataFrame:
    return where(rules, agent=agent).orderBy("id")


def recent_questions(questions: DataFrame, sender: str, n: int = 10) -> DataFrame:
    return where(questions, from_agent=sender).orderBy(F.desc("id")).limit(n)


def default_rent(rules: DataFrame, default: float = 25.0) -> DataFrame:
    return rules.filter("status = 'active'").agg(F.coalesce(F.median("context_cost"), F.lit(default)).alias("rent"))


# writes: tables are re-derived, never changed in place


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows replace old ones by key as a whole, nulls included; within a batch the last in ``order`` wins."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col("__new").desc(), *(order or [])]).drop("__new")


def upsert_runs(old: DataFrame, new: DataFrame, seq: str = "ts") -> DataFrame:
    """Totals of a session are cumulative, so its last row stands."""
    return upsert(old, new, ["session_id"], [F.col(seq).desc(), F.col("id").desc()])


def replace_tool_costs(old: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """All rows of a run are replaced by its new ones; of a repeated tool the last stands."""
    kept = old.join(new.select("run_id").distinct(), "run_id", "left_anti")
    return kept.unionByName(latest(new, ["run_id", "kind", "grp", "label"], [F.col(seq).desc()]).drop(seq))


def record_receipts(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["rule_id", "decided_at"])


def ruleset_versions(compiles: DataFrame) -> DataFrame:
    """Compile events (agent, ts) counted."""
    return compiles.groupBy("agent").agg(F.count(F.lit(1)).cast("int").alias("version"), F.max("ts").alias("updated_at"))


def version_of(versions: DataFrame, agents: DataFrame) -> DataFrame:
    """agent, version for the agents asked for; 0 where nothing was compiled yet."""
    return agents.select("agent").distinct().join(versions.select("agent", "version"), "agent", "left").select("agent", F.coalesce("version", F.lit(0)).alias("version"))


#: Fixed: what is stored on a rule that a person vouches for.
AUTHORED = "authored: protected behavioral rule (not token-gated)"


def inserted_rules(rules: DataFrame, new: DataFrame, authored: bool = False) -> DataFrame:
    """``rules`` and, after them, rows for ``new`` (agent, body, context_cost, created_at; source_run, born_digest, replaces, scope where known).

    Ids go on from the largest, in the order of created_at, then agent, then body. A proposed rule is a candidate. An authored one is active, protected and decided
    when it was made, and names no source; it is exempt from the token gate.
    """
    names = rules.columns
    last = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    w = Window.orderBy("created_at", "agent", "body")
    # the rows of one insertion are few: proposals of a session or a file
    rows = new.withColumn("id", (last.scalar() + F.row_number().over(w)).cast("long")).withColumn("status", F.lit("active" if authored else "candidate"))
    if authored:
        rows = rows.drop("source_run", "born_digest", "replaces").withColumns({"decided_at": F.col("created_at"), "decided_reason": F.lit(AUTHORED)})
    rows = rows.withColumns({"protected": F.lit(authored), "probation": F.lit(False)})
    return rules.unionByName(rows.select(*[c for c in names if c in rows.columns]), allowMissingColumns=True)


def rule_states(events: DataFrame) -> DataFrame:
    """State of each rule after its transitions (rule_id, seq, action, value): decide, scope, probation, protect, unprotect.

    Protecting and unprotecting both make a rule active.
    """
    last = lambda *actions: F.max_by(F.when(F.col("action").isin(*actions), F.col("value")), F.when(F.col("action").isin(*actions), F.col("seq")))
    status = F.when(F.col("action") == "decide", F.col("value")).when(F.col("action").isin("protect", "unprotect"), F.lit("active"))
    return events.groupBy("rule_id").agg(
        F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("status"),
        last("scope").alias("scope"),
        F.coalesce(last("probation") == "1", F.lit(False)).alias("probation"),
        F.coalesce(F.max_by(F.col("action") == "protect", F.when(F.col("action").isin("protect", "unprotect"), F.col("seq"))), F.lit(False)).alias("protected"),
    )


def approve_questions(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """Of the pending questions with an answered (from_agent, to_agent, body) the most recent is approved."""
    key = ["from_agent", "to_agent", "body"]
    ids = questions.filter("approved IS NULL").join(answered.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.max("id").alias("id")).select("id", F.lit(1).alias("now"))
    return questions.join(ids, "id", "left").withColumn("approved", F.coalesce("now", "approved")).drop("now")


def joined_runs(listed: DataFrame, runs: DataFrame) -> DataFrame:
    """Listed sessions with their ledger rows; a session without one failed and cost nothing."""
    known = runs.select("session_id", total_tokens().alias("t"), F.col("completed").alias("c"))
    return listed.join(known, "session_id", "left").select(*listed.columns, F.coalesce("t", F.lit(0)).alias("tokens"), F.coalesce("c", F.lit(False)).alias("completed"))
