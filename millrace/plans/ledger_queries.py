"""Queries of the ledger families: reads, writes, windows, cohorts, costs, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import cohort, cost, inference, ledger, windows
from millrace.plans.catalog import query, rounded

TOTAL = "(input_tokens + output_tokens + cache_creation + cache_read)"
GOLDEN = "task_hash IS NOT NULL AND config IN ('active', 'candidate', 'audit')"
PLAIN = "task_hash IS NOT NULL AND completed AND config = 'active'"
NOW = "2024-01-31 00:00:00"
NOW_S = 1_720_000_000


@query(
    "runs",
    sql=f"""WITH work AS (SELECT coalesce(project, '(unknown)') AS project, ruleset_version, {TOTAL} AS t FROM runs WHERE task_hash IS NULL AND completed AND agent <> 'main')
    SELECT project, ruleset_version, count(*) AS runs, CAST(trunc(avg(t)) AS BIGINT) AS avg_tokens FROM work
    WHERE project IN (SELECT project FROM work GROUP BY project ORDER BY sum(t) DESC, project LIMIT 5) GROUP BY project, ruleset_version""",
)
def real_work_by_project(t):
    return ledger.curve_by_project(t["runs"])


@query("runs", sql=f"SELECT agent, ruleset_version, count(*) AS runs, CAST(trunc(avg({TOTAL})) AS BIGINT) AS avg_tokens FROM runs WHERE task_hash IS NULL AND completed GROUP BY ALL")
def real_work_by_agent(t):
    return ledger.curve_by_agent(t["runs"])


@query(
    "runs",
    sql=f"""WITH c AS (SELECT coalesce(project, '(unknown)') AS project, ruleset_version AS v, trunc(avg({TOTAL})) AS a FROM runs
      WHERE task_hash IS NULL AND completed AND agent <> 'main' GROUP BY ALL), e AS (SELECT project, arg_min(a, v) AS f, arg_max(a, v) AS l, count(*) AS versions FROM c GROUP BY project)
    SELECT project, versions, CASE WHEN f = 0 THEN 'n/a' ELSE (CASE WHEN l > f THEN '+' ELSE '' END) || printf('%.1f%%', (l - f) * 100.0 / f) END AS change FROM e""",
)
def project_trends(t):
    return ledger.curve_lists(ledger.curve_by_project(t["runs"], 1_000_000)).select("project", F.size("points").cast("long").alias("versions"), "change")


@query("runs", sql="SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_creation) AS BIGINT) AS cache_creation, CAST(sum(cache_read) AS BIGINT) AS cache_read FROM runs WHERE agent = 'view' AND completed")
def token_mix(t):
    return ledger.token_mix(t["runs"], "view")


@query("runs", sql=f"SELECT coalesce(project, '(unknown)') AS project, count(*) AS runs, CAST(sum({TOTAL}) AS BIGINT) AS total_tokens FROM runs WHERE task_hash IS NULL GROUP BY 1 ORDER BY total_tokens DESC, project LIMIT 8")
def project_usage(t):
    return ledger.projects_by_usage(t["runs"], 8)


@query(
    "runs", "tool_costs",
    sql="""SELECT kind, grp, label, count(DISTINCT run_id) AS sessions, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(input_chars) AS BIGINT) AS input_chars,
    CAST(sum(result_chars) AS BIGINT) AS result_chars, CAST(sum(input_chars + result_chars) AS BIGINT) AS footprint FROM tool_costs JOIN runs ON runs.id = run_id WHERE task_hash IS NULL GROUP BY kind, grp, label""",
)
def tool_cost_rollup(t):
    return ledger.tool_cost_rollup(t["tool_costs"], t["runs"])


@query(
    "runs", "tool_costs",
    sql="""SELECT kind, grp, label, count(DISTINCT run_id) AS sessions, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(input_chars) AS BIGINT) AS input_chars, CAST(sum(result_chars) AS BIGINT) AS result_chars,
    CAST(sum(input_chars + result_chars) AS BIGINT) AS footprint FROM tool_costs, runs WHERE runs.id = run_id AND task_hash IS NULL AND agent = 'click' AND kind = 'mcp' GROUP BY kind, grp, label ORDER BY footprint DESC, label, kind, grp LIMIT 5""",
)
def top_tools_of_agent(t):
    return ledger.tool_cost_rollup(t["tool_costs"], t["runs"], "click", "mcp", 5)


@query("tool_costs", sql="SELECT kind, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(input_chars + result_chars) AS BIGINT) AS footprint FROM tool_costs GROUP BY ROLLUP (kind)")
def tool_kind_rollup(t):
    return ledger.kind_rollup(t["tool_costs"])


@query("rules", sql="SELECT agent, count(*) FILTER (status = 'candidate') AS candidate, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'evicted') AS evicted FROM rules GROUP BY agent")
def rule_counts(t):
    return ledger.rule_counts(t["rules"])


@query("rules", sql="WITH c AS (SELECT agent, count(*) AS n FROM rules WHERE status = 'candidate' GROUP BY agent) SELECT CAST(sum(n) AS BIGINT) AS pending, string_agg(agent || ': ' || n, ', ' ORDER BY n DESC, agent) AS agents, arg_max(agent, (n, agent)) AS top FROM c")
def pending_nudge(t):
    return ledger.nudge(ledger.candidate_counts(t["rules"]))


@query("runs", sql=f"SELECT agent, count(*) FILTER (task_hash IS NULL) AS real, count(*) FILTER ({GOLDEN}) AS golden FROM runs GROUP BY agent")
def run_counts(t):
    return ledger.run_counts(t["runs"], by_agent=True)


@query("runs", sql=f"SELECT agent, strftime(ts, '%Y-%m-%d') AS day, count(*) AS runs, CAST(trunc(avg({TOTAL})) AS BIGINT) AS avg_tokens FROM runs WHERE {PLAIN} GROUP BY ALL")
def learning_curve(t):
    return ledger.learning_curve(t["runs"])


@query("runs", sql="SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM runs WHERE config IN ('active', 'candidate', 'audit')")
def last_measurement(t):
    return ledger.last_measurement(t["runs"]).select(F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query("runs", sql=f"SELECT CAST(coalesce(sum({TOTAL}), 0) AS BIGINT) AS tokens FROM runs WHERE task_hash IS NULL AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def recent_tokens(t):
    return ledger.recent_tokens(t["runs"], F.to_timestamp(F.lit(NOW)))


@query(
    "receipts", "rules",
    sql="""SELECT r.rule_id, r.agent, r.status, r.delta, r.context_cost, u.body FROM receipts r JOIN rules u ON u.id = r.rule_id
    WHERE r.decided_no = (SELECT max(decided_no) FROM receipts x WHERE x.rule_id = r.rule_id)""",
)
def latest_receipts(t):
    return ledger.latest_receipts(t["receipts"], t["rules"]).select("rule_id", "agent", "status", "delta", "context_cost", "body")


@query("runs", sql=f"SELECT agent, task_hash, arg_min({TOTAL}, (ts, id)) AS run1_tokens, min({TOTAL}) AS best_tokens FROM runs WHERE {PLAIN} GROUP BY agent, task_hash")
def baselines(t):
    return ledger.baselines(t["runs"]).drop("updated_at")


@query(
    "runs",
    sql=f"""WITH g AS (SELECT agent, task_hash, ts, id, {TOTAL} AS t FROM runs WHERE {PLAIN}), b AS (SELECT agent, task_hash, arg_min(t, (ts, id)) AS one, min(t) AS best FROM g GROUP BY ALL),
    l AS (SELECT agent, task_hash, t AS now FROM g QUALIFY row_number() OVER (PARTITION BY agent, task_hash ORDER BY ts DESC, id DESC) = 1),
    s AS (SELECT b.agent, sum(one) AS baseline_tokens, sum(now) AS latest_tokens, sum(best) AS best_tokens, count(*) AS tasks FROM b JOIN l USING (agent, task_hash) GROUP BY b.agent)
    SELECT agent, CAST(baseline_tokens AS BIGINT) AS baseline_tokens, CAST(latest_tokens AS BIGINT) AS latest_tokens, CAST(best_tokens AS BIGINT) AS best_tokens, tasks,
      (CASE WHEN latest_tokens > baseline_tokens THEN '+' ELSE '' END) || printf('%.1f%%', CAST((latest_tokens - baseline_tokens) AS DOUBLE) * 100 / baseline_tokens) AS change FROM s""",
)
def suite_comparison(t):
    return ledger.suite_comparison(t["runs"])


@query("rules", sql="SELECT id, agent, body, measured_delta, row_number() OVER (PARTITION BY agent ORDER BY measured_delta DESC NULLS LAST, id) AS pos FROM rules WHERE status = 'active'")
def active_rules(t):
    from pyspark.sql import Window

    w = Window.partitionBy("agent").orderBy(F.col("measured_delta").desc_nulls_last(), "id")
    return ledger.active_rules(t["rules"]).select("id", "agent", "body", "measured_delta", F.row_number().over(w).cast("long").alias("pos"))


@query("rules", sql="SELECT agent, id FROM rules WHERE status = 'candidate' QUALIFY row_number() OVER (PARTITION BY agent ORDER BY created_s, id) <= 3")
def oldest_candidates(t):
    return ledger.oldest_candidates(t["rules"]).select("agent", "id")


@query("rules", sql="SELECT agent, id, body FROM rules WHERE status = 'evicted' QUALIFY row_number() OVER (PARTITION BY agent ORDER BY decided_s DESC NULLS LAST, id DESC) <= 5")
def last_evictions(t):
    return ledger.last_evictions(t["rules"]).select("agent", "id", "body")


@query("rules", sql="SELECT agent, id FROM rules WHERE status = 'active' AND NOT protected QUALIFY row_number() OVER (PARTITION BY agent ORDER BY decided_s NULLS FIRST, id) = 1")
def next_audit(t):
    return ledger.next_audit(t["rules"]).select("agent", "id")


@query("rules", sql="SELECT coalesce(median(context_cost), 25.0) AS rent FROM rules WHERE status = 'active'")
def default_rent(t):
    return ledger.default_rent(t["rules"])


@query("runs", "rules", sql="SELECT id, agent FROM runs WHERE EXISTS (SELECT 1 FROM rules WHERE source_run = runs.id)")
def already_distilled(t):
    return ledger.already_distilled(t["runs"], t["rules"]).select("id", "agent")


@query(
    "runs",
    sql=f"SELECT 'u' || CAST(input_tokens % 1000 AS VARCHAR) AS session_id, arg_max(id, (ts, id)) AS id, arg_max({TOTAL}, (ts, id)) AS total, count(*) > 1 AS resent FROM runs GROUP BY 1",
)
def upsert_runs(t):
    """Rows of a session arrive in two batches, some in both."""
    runs = t["runs"].withColumn("session_id", F.concat(F.lit("u"), (F.col("input_tokens") % 1000).cast("string")))
    old, new = runs.filter("ts < '2024-01-16'"), runs.filter("ts >= '2024-01-16'")
    state = ledger.upsert_runs(ledger.upsert_runs(old.limit(0), old), new)
    seen = runs.groupBy("session_id").agg((F.count(F.lit(1)) > 1).alias("resent"))
    return state.join(seen, "session_id").select("session_id", "id", S.total_tokens().alias("total"), "resent")


@query(
    "tool_costs",
    sql="""WITH n AS (SELECT run_id, kind, grp, label, calls FROM tool_costs WHERE label IN ('tool1', 'tool2') QUALIFY row_number() OVER (PARTITION BY run_id, kind, grp, label ORDER BY input_chars * 1000 + calls DESC) = 1)
    SELECT run_id, kind, grp, label, calls FROM tool_costs WHERE label NOT IN ('tool1', 'tool2') AND run_id NOT IN (SELECT run_id FROM n) UNION ALL SELECT * FROM n""",
)
def replace_tool_costs(t):
    costs, late = t["tool_costs"], F.col("label").isin("tool1", "tool2")
    new = costs.filter(late).withColumn("seq", F.col("input_chars") * 1000 + F.col("calls"))
    return ledger.replace_tool_costs(costs.filter(~late), new, "seq").select("run_id", "kind", "grp", "label", "calls")


def asked(t):
    """Runs as questions between agents: the answered ones are those of cheap runs."""
    return t["runs"].select("id", F.col("agent").alias("from_agent"), F.concat(F.lit("to"), F.col("file_rereads")).alias("to_agent"), F.coalesce("project", F.lit("?")).alias("body"), F.when(F.col("id") % 5 == 0, 1).alias("approved"), "completed")


QUESTIONS = "q AS (SELECT id, agent AS from_agent, 'to' || CAST(file_rereads AS VARCHAR) AS to_agent, coalesce(project, '?') AS body, CASE WHEN id % 5 = 0 THEN 1 END AS approved, completed FROM runs)"


@query(
    "runs",
    sql=f"""WITH {QUESTIONS}, a AS (SELECT max(id) AS id FROM q WHERE approved IS NULL AND (from_agent, to_agent, body) IN (SELECT from_agent, to_agent, body FROM q WHERE NOT completed) GROUP BY from_agent, to_agent, body)
    SELECT id, CASE WHEN id IN (SELECT id FROM a) THEN 1 ELSE approved END AS approved FROM q""",
)
def approve_questions(t):
    q = asked(t)
    return ledger.approve_questions(q, q.filter("NOT completed")).select("id", "approved")


@query("runs", sql=f"WITH {QUESTIONS} SELECT count(*) AS asked, count(*) FILTER (approved = 1) AS approved FROM q")
def question_counts(t):
    return ledger.question_counts(asked(t))


@query("runs", "orders", sql=f"SELECT 's' || CAST(o_orderkey AS VARCHAR) AS session_id, coalesce({TOTAL}, 0) AS tokens, coalesce(completed, false) AS completed FROM orders LEFT JOIN runs ON session_id = 's' || CAST(o_orderkey AS VARCHAR)")
def gathered_runs(t):
    return ledger.joined_runs(t["orders"].select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("session_id")), t["runs"])


@query(
    "receipts",
    sql="""WITH e AS (SELECT rule_id, decided_no, decided_no % 4 AS a, status FROM receipts), s AS (SELECT *, CASE a WHEN 0 THEN status WHEN 2 THEN 'active' WHEN 3 THEN 'active' END AS st FROM e)
    SELECT rule_id, arg_max(st, decided_no) FILTER (st IS NOT NULL) AS status, coalesce(arg_max(a = 2, decided_no) FILTER (a IN (2, 3)), false) AS protected FROM s GROUP BY rule_id""",
)
def rule_states(t):
    action = F.element_at(F.array(F.lit("decide"), F.lit("scope"), F.lit("protect"), F.lit("unprotect")), (F.col("decided_no") % 4 + 1).cast("int"))
    events = t["receipts"].select("rule_id", F.col("decided_no").alias("seq"), action.alias("action"), F.col("status").alias("value"))
    return ledger.rule_states(events).select("rule_id", "status", "protected")


# windows


W = "OVER (PARTITION BY agent ORDER BY ts, id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
PRIOR = f"p AS (SELECT id, agent, {TOTAL} AS total, quantile_disc({TOTAL}, 0.75) {W} AS p75, median({TOTAL}) {W} AS med, count(*) {W} AS n FROM runs WHERE task_hash IS NULL AND completed)"


@query("runs", sql=f"WITH {PRIOR} SELECT id, agent, total, p75, coalesce(n >= 5 AND total > p75, false) AS triggered FROM p")
def distill_triggers(t):
    return windows.distill_triggers(t["runs"])


@query("runs", sql=f"WITH {PRIOR} SELECT id, agent, total, med AS median, CASE WHEN n >= 5 AND med > 0 THEN round(total / med, 6) END AS multiple, coalesce(n >= 5 AND med > 0 AND total / med >= 2, false) AS anomalous FROM p")
def anomalies(t):
    return rounded(windows.anomalies(t["runs"]), "multiple")


@query(
    "measures",
    sql="""WITH e AS (SELECT *, NOT completed AND tokens < 20000 AS env FROM measures), i AS (SELECT *, sum(CASE WHEN env THEN 0 ELSE 1 END) OVER (PARTITION BY comparison_id, side ORDER BY run_no) AS island FROM e),
    s AS (SELECT comparison_id, side, run_no, count(*) FILTER (env) OVER (PARTITION BY comparison_id, side, island ORDER BY run_no) AS streak FROM i)
    SELECT comparison_id, side, max(streak) AS longest, min(run_no) FILTER (streak >= 2) AS aborted_at FROM s GROUP BY ALL""",
)
def failure_streaks(t):
    # cheap enough to be the environment's: under 1000 tokens after scaling
    return windows.failure_streaks(t["measures"].withColumn("tokens", F.col("tokens") / 20), 2)


AUDITS = "a AS (SELECT rule_id, decided_no, coalesce(delta < 0, true) AS sub, regression, decided_no % 7 = 0 AS env FROM receipts)"


@query(
    "receipts",
    sql=f"""WITH {AUDITS}, k AS (SELECT *, lag(sub, 1, false) OVER (PARTITION BY rule_id ORDER BY decided_no) AS before FROM a WHERE NOT env), e AS (SELECT *, regression OR (sub AND before) AS evict FROM k),
    f AS (SELECT rule_id, min(decided_no) AS gone FROM e WHERE evict GROUP BY rule_id)
    SELECT e.rule_id, decided_no, CASE WHEN evict THEN 'evicted' WHEN sub THEN 'strike' ELSE 'cleared' END AS outcome FROM e LEFT JOIN f USING (rule_id) WHERE gone IS NULL OR decided_no <= gone""",
)
def two_strikes(t):
    audits = t["receipts"].select("rule_id", "decided_no", F.coalesce(F.col("delta") < 0, F.lit(True)).alias("sub"), "regression", (F.col("decided_no") % 7 == 0).alias("env"))
    return windows.two_strikes(audits, ["rule_id"], "decided_no")


@query(
    "runs", "rules",
    sql=f"""WITH l AS (SELECT max(ts) AS last_ts FROM runs WHERE config IN ('active', 'candidate', 'audit')), c AS (SELECT agent, count(*) AS pending FROM rules WHERE status = 'candidate' GROUP BY agent)
    SELECT agent, pending, CASE WHEN last_ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR THEN 'cooling down' ELSE 'due' END AS reason, last_ts <= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AS due FROM c, l""",
)
def auto_select(t):
    return windows.auto_select(ledger.candidate_counts(t["rules"]), ledger.last_measurement(t["runs"]), F.to_timestamp(F.lit(NOW)))


# cohorts, power, health


STATS = f"s AS (SELECT agent, ruleset_version AS v, count(*) AS n, avg({TOTAL}) AS mean, coalesce(stddev_samp({TOTAL}), 0) AS sd, stddev_samp({TOTAL}) / sqrt(count(*)) AS se FROM runs WHERE task_hash IS NULL AND completed GROUP BY ALL)"


@query("runs", sql=f"WITH {STATS} SELECT agent, v AS ruleset_version, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(se, 6) AS se FROM s")
def cohort_stats(t):
    return rounded(cohort.cohort_stats(ledger.totals_by_version(t["runs"])), "mean", "sd", "se")


@query(
    "runs",
    sql=f"""WITH {STATS}, f AS (SELECT * FROM s QUALIFY v = min(v) OVER (PARTITION BY agent)), l AS (SELECT * FROM s QUALIFY v = max(v) OVER (PARTITION BY agent)),
    d AS (SELECT f.agent, f.v AS first, l.v AS last, f.mean - l.mean AS delta, sqrt(f.se ** 2 + l.se ** 2) AS pooled, f.mean AS base, f.v <> l.v AND f.n >= 5 AND l.n >= 5 AS enough FROM f JOIN l USING (agent))
    SELECT agent, first, last, CASE WHEN enough THEN round(delta, 6) END AS delta, CASE WHEN enough THEN round(pooled, 6) END AS pooled, CASE WHEN enough AND base > 0 THEN round(delta / base * 100, 6) END AS pct,
      CASE WHEN NOT enough THEN 'insufficient-data' WHEN abs(delta) <= 2 * pooled THEN 'no-change' WHEN delta > 0 THEN 'improved' ELSE 'regressed' END AS verdict,
      CASE WHEN NOT enough THEN 'insufficient-data' WHEN abs(delta) <= 2 * pooled THEN 'no-signal' WHEN delta > 0 THEN 'corroborated' ELSE 're-audit' END AS action FROM d""",
)
def assess_cohorts(t):
    return rounded(cohort.assess_cohorts(ledger.totals_by_version(t["runs"])), "delta", "pooled", "pct").withColumn("action", cohort.governance())


@query(
    "runs",
    sql=f"""WITH w AS (SELECT agent, task_hash AS task, {TOTAL} AS t FROM runs WHERE {PLAIN} QUALIFY row_number() OVER (PARTITION BY agent, task_hash ORDER BY ts DESC, id DESC) <= 10)
    SELECT agent, task, count(*) AS n, round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS sd, round(stddev_samp(t) / avg(t), 6) AS cv FROM w GROUP BY agent, task HAVING count(*) >= 3 AND avg(t) > 0""",
)
def rank_variance(t):
    return rounded(cohort.rank_variance(ledger.golden_totals(t["runs"])), "mean", "sd", "cv")


REPLICATES = f"g AS (SELECT agent, task_hash AS task, ruleset_version AS version, coalesce(model, '') AS model, count(*) AS n, var_samp({TOTAL}) AS variance FROM runs WHERE task_hash IS NOT NULL AND completed AND config = 'active' GROUP BY ALL HAVING count(*) >= 2)"
NOISE = f"{REPLICATES}, k AS (SELECT agent, task, n, variance FROM g QUALIFY row_number() OVER (PARTITION BY agent, task ORDER BY n DESC, variance DESC) = 1)"


@query("runs", sql=f"WITH {NOISE} SELECT agent, task, n, round(variance, 4) AS variance FROM k")
def task_noise(t):
    return rounded(cohort.task_noise(ledger.golden_replicates(t["runs"])), "variance", digits=4)


@query("runs", sql=f"WITH {REPLICATES} SELECT agent, task, version, model, n FROM g QUALIFY row_number() OVER (PARTITION BY agent, task ORDER BY n DESC, version, model) = 1")
def group_replicates(t):
    return cohort.group_replicates(ledger.golden_replicates(t["runs"])).drop("totals")


@query("runs", sql=f"WITH {REPLICATES} SELECT agent, round(sum(variance * (n - 1)) / sum(n - 1), 4) AS pooled, count(*) AS groups FROM g GROUP BY agent")
def pooled_variance(t):
    return rounded(inference.pooled_variance(ledger.golden_replicates(t["runs"])), "pooled", digits=4)


@query(
    "runs",
    sql=f"""WITH {NOISE}, s AS (SELECT agent, sum(variance) AS v, count(*) AS k FROM k GROUP BY agent), r AS (SELECT agent, runs, sqrt(2 * v / runs) / k AS se FROM s, (VALUES (2), (3), (5), (10), (20)) x (runs))
    SELECT agent, runs, round(se, 6) AS se, round(50 * 1.0625 + (2 + 0.8416) * se, 6) AS mds80, round(50 * 1.0625 + (2 + 1.2816) * se, 6) AS mds90 FROM r""",
)
def power_table(t):
    return rounded(cohort.power_table(cohort.task_noise(ledger.golden_replicates(t["runs"]))).drop("power1000"), "se", "mds80", "mds90")


@query(
    "runs",
    sql=f"""WITH {NOISE}, s AS (SELECT agent, sum(variance) AS v, count(*) AS k FROM k GROUP BY agent)
    SELECT agent, CAST((SELECT min(n) FROM range(2, 501) x (n) WHERE 5000 >= 53.125 + (2 + 0.8416) * sqrt(2 * v / n) / k) AS INT) AS runs FROM s""",
)
def required_runs(t):
    return cohort.required_runs(cohort.task_noise(ledger.golden_replicates(t["runs"])), 5000.0)


@query("rules", sql=f"SELECT id, agent, ({NOW_S} - coalesce(decided_s, created_s)) // 86400 AS age_days FROM rules WHERE status = 'active' AND NOT protected AND {NOW_S} - coalesce(decided_s, created_s) >= 30 * 86400")
def stale_rules(t):
    return cohort.stale_rules(t["rules"], NOW_S).select("id", "agent", F.floor("age_days").alias("age_days"))


LAST = """l AS (SELECT * FROM receipts QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY decided_no DESC) = 1),
    x AS (SELECT u.agent, count(*) AS active_rules, sum(greatest(0, coalesce(delta, 0))) AS saving, count(*) FILTER (regression) AS regressed FROM rules u LEFT JOIN l ON u.id = l.rule_id WHERE u.status = 'active' GROUP BY u.agent)"""


@query("receipts", "rules", sql=f"WITH {LAST} SELECT agent, active_rules, CAST(saving AS BIGINT) AS saving, regressed FROM x")
def fixture_side(t):
    return cohort.fixture_side(t["receipts"], t["rules"]).withColumn("regressed", F.size("regressed").cast("long"))


@query(
    "receipts", "rules", "staff",
    sql=f"""WITH {STATS.replace("FROM runs", "FROM staff")}, {LAST}, f AS (SELECT * FROM s QUALIFY v = min(v) OVER (PARTITION BY agent)), e AS (SELECT * FROM s QUALIFY v = max(v) OVER (PARTITION BY agent)),
    d AS (SELECT agent, CASE WHEN f.v = e.v OR f.n < 5 OR e.n < 5 THEN 'insufficient-data' WHEN abs(f.mean - e.mean) <= 2 * sqrt(f.se ** 2 + e.se ** 2) THEN 'no-change' WHEN f.mean > e.mean THEN 'improved' ELSE 'regressed' END AS verdict FROM f JOIN e USING (agent))
    SELECT d.agent, verdict, coalesce(active_rules, 0) AS active_rules, CAST(saving AS BIGINT) AS saving, CASE WHEN coalesce(saving, 0) <= 0 THEN 'nothing-to-confirm'
      WHEN verdict = 'improved' THEN 'corroborated' WHEN verdict = 'regressed' THEN 'contradicted' ELSE 'unconfirmed' END AS outcome FROM d LEFT JOIN x ON x.agent = d.agent""",
)
def confirm_agents(t):
    cohorts = cohort.assess_cohorts(ledger.totals_by_version(t["staff"]))
    return cohort.confirm(cohort.fixture_side(t["receipts"], t["rules"]), cohorts.select("agent", "verdict")).drop("regressed")


# costs


DOLLARS = "(input_tokens * pi + output_tokens * po + cache_creation * pi * 1.25 + cache_read * pi * 0.1) / 1e6"
PRICED = f"p AS (SELECT *, CASE model WHEN 'opus' THEN 5.0e0 WHEN 'haiku' THEN 1.0e0 ELSE 3.0e0 END AS pi, CASE model WHEN 'opus' THEN 25.0e0 WHEN 'haiku' THEN 5.0e0 ELSE 15.0e0 END AS po, {TOTAL} AS t FROM runs)"


@query("runs", sql=f"WITH {PRICED} SELECT id, round({DOLLARS}, 9) AS dollars, round(CASE WHEN t > 0 THEN {DOLLARS} / t ELSE pi / 1e6 END, 12) AS rate FROM p")
def run_dollars(t):
    return cost.run_dollars(t["runs"]).select("id", F.round("dollars", 9).alias("dollars"), F.round("rate", 12).alias("rate"))


# the price of a receipt's model, and of an agent's tokens at that model: what its completed runs of any kind hold, weighed by kind
COSTS = """mix AS (SELECT agent, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_creation) AS cc, sum(cache_read) AS cr, avg(input_tokens + output_tokens + cache_creation + cache_read) FILTER (task_hash IS NULL) AS each
      FROM staff WHERE completed GROUP BY agent),
    tier AS (SELECT * FROM (VALUES ('opus', 5e-6, 25e-6), ('haiku', 1e-6, 5e-6), ('sonnet', 3e-6, 15e-6), (NULL, 3e-6, 15e-6)) x (model, pi, po)),
    rate AS (SELECT agent, model, pi, each, (i * pi + o * po + cc * 1.25 * pi + cr * 0.1 * pi) / (i + o + cc + cr) AS rate FROM mix, tier),
    l AS (SELECT r.*, u.agent AS owner FROM receipts r JOIN rules u ON u.id = r.rule_id AND u.status = 'active' QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY decided_no DESC) = 1),
    c AS (SELECT rule_id, owner AS agent, l.model, delta, context_cost * pi AS rent, greatest(coalesce(delta, 0), 0) * rate AS saving, runs * (with_tokens + without_tokens) * rate AS discovery,
      greatest(coalesce(delta, 0), 0) * rate - context_cost * pi AS net FROM l JOIN rate ON rate.agent = owner AND rate.model IS NOT DISTINCT FROM l.model)"""


@query(
    "rules", "receipts", "staff",
    sql=f"""WITH {COSTS} SELECT rule_id, agent, model, round(rent, 10) AS rent, round(saving, 8) AS saving, round(net * 20, 6) AS weekly, round(discovery, 8) AS discovery,
    CASE WHEN net > 0 THEN CAST(ceil(discovery / net) AS BIGINT) END AS break_even, row_number() OVER (PARTITION BY agent ORDER BY net DESC, delta DESC NULLS LAST, rule_id) AS pos FROM c""",
)
def rule_costs(t):
    from pyspark.sql import Window

    c = cost.agent_costs(t["rules"], t["receipts"], t["staff"])
    pos = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("net"), F.col("delta").desc_nulls_last(), "rule_id")).cast("long")
    return c.select(
        "rule_id", "agent", "model", F.round("rent", 10).alias("rent"), F.round("saving", 8).alias("saving"), F.round("weekly", 6).alias("weekly"), F.round("discovery", 8).alias("discovery"), "break_even", pos.alias("pos")
    )


@query(
    "rules", "receipts", "staff",
    sql=f"""WITH {COSTS}, g AS (SELECT agent, count(*) AS rules, sum(net) AS net, sum(saving) AS saving, sum(discovery) AS discovery, arg_max(model, (net, delta, -rule_id)) FILTER (model IS NOT NULL) AS any_model FROM c GROUP BY agent),
    top AS (SELECT agent, model FROM c QUALIFY row_number() OVER (PARTITION BY agent ORDER BY net DESC, delta DESC NULLS LAST, rule_id) = 1),
    b AS (SELECT g.*, 80 * each * rate AS baseline FROM g JOIN top ON top.agent = g.agent JOIN rate ON rate.agent = g.agent AND rate.model IS NOT DISTINCT FROM top.model)
    SELECT agent, rules, round(net, 6) AS net_per_session, round(saving * 80, 4) AS gross_savings, round(discovery, 4) AS operating_cost, round(net * 80 - discovery, 4) AS net_benefit, round(baseline, 4) AS baseline,
      round(baseline - net * 80 + discovery, 4) AS with_rules, round((net * 80 - discovery) / baseline, 6) AS share_saved, CASE WHEN net > 0 AND discovery > 0 THEN CAST(ceil(discovery / net) AS BIGINT) END AS break_even FROM b""",
)
def project_agents(t):
    p = cost.project_agents(cost.agent_costs(t["rules"], t["receipts"], t["staff"]), t["staff"])
    return rounded(rounded(p, "net_per_session", "share_saved"), "gross_savings", "operating_cost", "net_benefit", "baseline", "with_rules", digits=4)


@query(
    "runs",
    sql=f"""WITH s AS (SELECT sum({TOTAL}) FILTER (task_hash IS NOT NULL) AS b, sum({TOTAL}) FILTER (task_hash IS NULL AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS r FROM runs)
    SELECT CAST(b AS BIGINT) AS bench, CAST(r AS BIGINT) AS real, round(CAST(b AS DOUBLE) / r, 9) AS share, b > r * 0.1 AS warn FROM s""",
)
def meta_cost(t):
    return rounded(cost.meta_cost(t["runs"].filter("task_hash IS NOT NULL"), t["runs"], F.to_timestamp(F.lit(NOW))), "share", digits=9)


# scalar functions over whole tables


@query(
    "rules",
    sql="""SELECT id, CASE WHEN measured_delta IS NULL OR measured_delta <= 0 THEN 'evicted' WHEN measured_delta >= 2 * context_cost * 1.0625 THEN 'active' ELSE 'evicted' END AS verdict,
    CASE WHEN probation THEN 'regression: a previously passing golden task failed' WHEN measured_delta IS NULL THEN 'no comparable completed runs' WHEN measured_delta <= 0 THEN 'non-positive delta (' || measured_delta || ')'
      WHEN measured_delta < 2 * context_cost * 1.0625 THEN 'sub-threshold: savings ' || measured_delta || ' < 2× cache-aware rent (' || CAST(ceil(2 * context_cost * 1.0625) AS BIGINT) || ')'
      ELSE 'savings ' || measured_delta || ' ≥ 2× cache-aware rent (' || CAST(ceil(2 * context_cost * 1.0625) AS BIGINT) || ')' END AS reason FROM rules""",
)
def verdicts(t):
    return t["rules"].select("id", S.verdict("measured_delta", "context_cost").alias("verdict"), S.verdict_reason("measured_delta", "context_cost", "probation").alias("reason"))


@query(
    "runs",
    sql="""WITH n AS (SELECT id, CASE id % 4 WHEN 0 THEN 'Skill' WHEN 1 THEN 'mcp__srv' || (id % 3) || '__get__' || agent WHEN 2 THEN 'mcp__' ELSE agent END AS name, model AS skill FROM runs)
    SELECT id, CASE WHEN name = 'Skill' THEN 'skill' WHEN starts_with(name, 'mcp__') THEN 'mcp' ELSE 'builtin' END AS kind,
      CASE WHEN name = 'Skill' THEN '(skills)' WHEN name = 'mcp__' THEN '(unknown)' WHEN starts_with(name, 'mcp__') THEN split_part(name, '__', 2) ELSE '(builtin)' END AS grp,
      CASE WHEN name = 'Skill' THEN coalesce(skill, '(unknown)') WHEN name = 'mcp__' THEN '(unknown)' WHEN starts_with(name, 'mcp__') THEN split_part(name, '__', 3) || '__' || split_part(name, '__', 4) ELSE name END AS label FROM n""",
)
def classify_tools(t):
    i = F.col("id") % 4
    name = F.when(i == 0, "Skill").when(i == 1, F.concat(F.lit("mcp__srv"), F.col("id") % 3, F.lit("__get__"), F.col("agent"))).when(i == 2, "mcp__").otherwise(F.col("agent"))
    return t["runs"].select("id", S.classify_tool(name, "model").alias("c")).select("id", "c.*")


@query(
    "rules",
    sql="""WITH k AS (SELECT agent, count(*) FILTER (status = 'active') AS k, CAST(count(*) AS DOUBLE) AS n FROM rules GROUP BY agent)
    SELECT agent, round(greatest(0, (k / n + 1.96 ** 2 / (2 * n)) / (1 + 1.96 ** 2 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 ** 2 / (4 * n * n)) / (1 + 1.96 ** 2 / n)), 9) AS low,
      round(least(1, (k / n + 1.96 ** 2 / (2 * n)) / (1 + 1.96 ** 2 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 ** 2 / (4 * n * n)) / (1 + 1.96 ** 2 / n)), 9) AS high FROM k""",
)
def active_share(t):
    g = t["rules"].groupBy("agent").agg(F.count_if(F.col("status") == "active").alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(g.withColumn("w", S.wilson("k", "n")).select("agent", "w.low", "w.high"), "low", "high", digits=9)


# inference


MEANS = """m AS (SELECT comparison_id, side, task_id, floor(avg(tokens) FILTER (completed) + 0.5) AS mean, count(*) FILTER (completed) AS n, count(*) AS runs, var_samp(CAST(tokens AS DOUBLE)) FILTER (completed) AS v,
  max(weight) AS weight, bool_and(NOT completed AND tokens < 1000) AS env FROM measures GROUP BY ALL)"""
TASKS = f"""{MEANS}, j AS (SELECT o.comparison_id, o.task_id, o.weight AS w, o.mean - w.mean AS saving, o.n AS no, w.n AS nw, o.v AS vo, w.v AS vw, o.runs AS ro, w.runs AS rw
  FROM m o JOIN m w ON w.comparison_id = o.comparison_id AND w.task_id = o.task_id AND o.side = 'without' AND w.side = 'with' WHERE o.n > 0 AND w.n > 0)"""


@query(
    "measures",
    sql=f"WITH {MEANS} SELECT comparison_id, side, task_id, CAST(coalesce(mean, 0) AS BIGINT) AS mean_tokens, runs, round(v, 4) AS variance, env FROM m",
)
def task_summaries(t):
    s = inference.summarize_tasks(t["measures"])
    return s.select("comparison_id", "side", "task_id", "mean_tokens", "runs", F.round(inference.variance(F.col("x")), 4).alias("variance"), "env")


@query("measures", sql="SELECT comparison_id, side, count(*) FILTER (NOT completed AND tokens < 1000) AS env, count(*) AS total, count(*) FILTER (NOT completed AND tokens < 1000) >= 3 AND 2 * count(*) FILTER (NOT completed AND tokens < 1000) > count(*) AS tripped FROM measures GROUP BY ALL")
def pass_guard(t):
    return inference.pass_guard(t["measures"])


# An assessment as defined: a task with one run on a side borrows that side's pooled variance; without any variance on a side the spread between tasks stands in.
# Uneven weights widen the multiple by effective degrees of freedom (Welch and Satterthwaite within, Kish between), unless a task shows no variance at all.
ASSESSED = f"""{TASKS}, pv AS (SELECT comparison_id, sum(vo * (no - 1)) / sum(no - 1) FILTER (no > 1) AS po, sum(vw * (nw - 1)) / sum(nw - 1) FILTER (nw > 1) AS pw FROM j GROUP BY comparison_id),
    u AS (SELECT j.*, coalesce(vo, po) / no + coalesce(vw, pw) / nw AS u, greatest(1, no - 1 + nw - 1) AS dof, po IS NOT NULL AND pw IS NOT NULL AS known FROM j JOIN pv USING (comparison_id)),
    a AS (SELECT comparison_id, sum(w * saving) / sum(w) AS mean, count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, min(w) = max(w) AS even, min(u) AS least,
      CASE WHEN bool_and(known) THEN sqrt(sum(w * w * u)) / sum(w) END AS sw_in, sum(w * w * u) ** 2 / nullif(sum((w * w * u) ** 2 / dof), 0) AS dfw, sum(u) ** 2 / nullif(sum(u * u / dof), 0) AS dfu FROM u GROUP BY comparison_id),
    b AS (SELECT comparison_id, CASE WHEN any_value(k) > 1 THEN sqrt(sum(w * (saving - mean) ** 2) / (any_value(sw) - any_value(sw2) / any_value(sw)) * any_value(sw2)) / any_value(sw) END AS sw_out FROM j JOIN a USING (comparison_id) GROUP BY comparison_id),
    f AS (SELECT o.comparison_id, bool_or(o.n > 0 AND w.n = 0 AND NOT w.env) AS regression, bool_or(CASE WHEN o.n = 0 THEN o.env WHEN coalesce(w.n, 0) = 0 THEN coalesce(w.env, true) ELSE false END) AS environment_failure,
      bool_or(o.n > 0 AND w.n > 0 AND CAST(w.n AS DOUBLE) / w.runs < CAST(o.n AS DOUBLE) / o.runs) AS completion_drop FROM m o LEFT JOIN m w ON w.comparison_id = o.comparison_id AND w.task_id = o.task_id AND w.side = 'with' WHERE o.side = 'without' GROUP BY o.comparison_id),
    z AS (SELECT f.comparison_id, mean, coalesce(k, 0) AS tasks, coalesce(regression, false) AS regression, environment_failure, coalesce(completion_drop, false) AS completion_drop, coalesce(sw_in, sw_out) AS se,
      CASE WHEN sw_in IS NOT NULL THEN 'within-task' WHEN sw_out IS NOT NULL THEN 'between-task' END AS basis,
      2 * CASE WHEN sw_in IS NOT NULL THEN CASE WHEN even OR least <= 0 THEN 1 ELSE greatest(1, (1 + 5 / (4 * dfw)) / (1 + 5 / (4 * dfu))) END
        WHEN sw_out IS NOT NULL AND NOT even THEN greatest(1, (1 + 5 / (4 * greatest(1, sw * sw / sw2 - 1))) / (1 + 5.0e0 / (4 * (k - 1)))) ELSE 1 END AS multiple
      FROM f LEFT JOIN a USING (comparison_id) LEFT JOIN b USING (comparison_id))"""


@query(
    "measures",
    sql=f"""WITH {ASSESSED} SELECT comparison_id, CAST(floor(mean + 0.5) AS BIGINT) AS delta, round(se, 4) AS standard_error, basis, round(multiple, 6) AS multiple, regression,
      coalesce(NOT regression AND abs(mean - 2 * 25 * 1.0625) < multiple * se, false) AS uncertain, completion_drop, environment_failure, tasks FROM z""",
)
def assess_deltas(t):
    a = inference.assess(t["measures"])
    return a.select("comparison_id", "delta", F.round("standard_error", 4).alias("standard_error"), "basis", F.round("multiple", 6).alias("multiple"), "regression", "uncertain", "completion_drop", "environment_failure", "tasks")


@query(
    "measures",
    sql=f"""WITH {TASKS}, g AS (SELECT comparison_id, sum(w) AS sw, sum(w * w) AS sw2, sum(w * saving) / sum(w) AS mean, count(*) AS k FROM j GROUP BY comparison_id),
    q AS (SELECT comparison_id, sum(w * (saving - mean) ** 2) AS sq FROM j JOIN g USING (comparison_id) GROUP BY comparison_id)
    SELECT comparison_id, round(mean, 6) AS mean, k, round(sqrt(sq / (sw - sw2 / sw) * sw2) / sw, 4) AS se_between, round((1 + 5 / (4 * greatest(1, sw * sw / sw2 - 1))) / (1 + 5.0 / (4 * (k - 1))), 6) AS inflation_between FROM g JOIN q USING (comparison_id)""",
)
def between_task_error(t):
    used = inference.per_task(inference.summarize_tasks(t["measures"])).filter("used")
    return rounded(rounded(inference.between_error(used), "mean", "inflation_between"), "se_between", digits=4)


@query(
    "measures",
    sql=f"""WITH {TASKS}, pw AS (SELECT comparison_id, sum(vw * (nw - 1)) / sum(nw - 1) FILTER (nw > 1) AS pooled FROM j GROUP BY comparison_id),
    g AS (SELECT comparison_id, task_id, w * w * coalesce(vw, pooled) / ((nw + i) * (nw + i + 1)) AS gain, i FROM j JOIN pw USING (comparison_id), range(0, 6) x (i) WHERE coalesce(vw, pooled) > 0),
    r AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY comparison_id ORDER BY gain DESC, task_id, i) <= 6) SELECT comparison_id, task_id, count(*) AS add FROM r GROUP BY ALL""",
)
def top_up_runs(t):
    return inference.top_up(inference.per_task(inference.summarize_tasks(t["measures"])).filter("used"), 6)


BOTH = """s AS (SELECT comparison_id, side, task_id, coalesce(avg(tokens) FILTER (completed), 0) AS p, coalesce(avg(tokens + cache_read) FILTER (completed), 0) AS t, coalesce(avg(cache_read) FILTER (completed), 0) AS c, count(*) FILTER (completed) AS n, count(*) AS runs,
      CAST(floor(avg(duration_ms) FILTER (completed) + 0.5) AS BIGINT) AS d, bool_and(NOT completed AND tokens < 1000) AS env FROM measures GROUP BY ALL),
    x AS (SELECT b.comparison_id, b.task_id, b.runs, b.p AS bp, s.p, b.t AS bt, s.t, b.c AS bc, s.c, b.n AS bn, s.n, b.d AS bd, s.d, s.env FROM s b JOIN s ON s.comparison_id = b.comparison_id AND s.task_id = b.task_id AND b.side = 'without' AND s.side = 'with')"""
PCT = "CASE WHEN {b} = 0 THEN 'n/a' ELSE (CASE WHEN {c} > {b} THEN '+' ELSE '' END) || printf('%.1f%%', ({c} - {b}) * 100.0 / {b}) END"


@query(
    "measures",
    sql=f"""WITH {BOTH} SELECT comparison_id, task_id, runs, round(bp, 6) AS base_processing, round(p, 6) AS processing, round(bt, 6) AS base_total, round(t, 6) AS total, round(bc, 6) AS base_cache_read, round(c, 6) AS cache_read,
    bn AS base_completed, n AS completed, bd AS base_duration, d AS duration, {PCT.format(b='bp', c='p')} AS change, bn > 0 AND n > 0 AS comparable, bn > 0 AND n = 0 AND NOT env AS regressed, bn > 0 AND n = 0 AND env AS env_failed FROM x""",
)
def comparison_tasks(t):
    return rounded(inference.comparison_tasks(t["measures"]), "base_processing", "processing", "base_total", "total", "base_cache_read", "cache_read")


COMPARED = f"""{BOTH}, y AS (SELECT comparison_id, avg(bp) FILTER (bn > 0 AND n > 0) AS bm, avg(p) FILTER (bn > 0 AND n > 0) AS m, sum(bn) AS bn, sum(n) AS n, CAST(floor(avg(bd) + 0.5) AS BIGINT) AS bd, CAST(floor(avg(d) + 0.5) AS BIGINT) AS d,
    bool_or(bn > 0 AND n = 0 AND NOT env) AS reg, bool_or(bn > 0 AND n = 0 AND env) AS dead FROM x GROUP BY comparison_id)"""


@query(
    "measures",
    sql=f"WITH {COMPARED} SELECT comparison_id, {PCT.format(b='coalesce(bm, 0)', c='coalesce(m, 0)')} AS change, CAST(bn AS BIGINT) AS base_completed, CAST(n AS BIGINT) AS completed, bd AS base_duration, d AS duration, reg AS regression FROM y",
)
def compare_configs(t):
    return inference.compare_configs(t["measures"]).select("comparison_id", "change", "base_completed", "completed", "base_duration", "duration", "regression")


@query("measures", sql=f"WITH {COMPARED} SELECT comparison_id, CASE WHEN reg THEN 'regressed' WHEN dead THEN 'no verdict' ELSE 'none' END AS status, CASE WHEN (SELECT bool_or(reg) FROM y) THEN 'unsafe' WHEN (SELECT bool_or(dead) FROM y) THEN 'unproven' ELSE 'safe' END AS safety FROM y")
def category_regressions(t):
    return inference.category_regressions(inference.compare_configs(t["measures"])).drop("tasks")


@query(
    "runs",
    sql=f"""WITH own AS (SELECT agent, CASE WHEN agent < 'f' THEN 'opus' ELSE 'haiku' END AS own FROM runs GROUP BY agent),
    r AS (SELECT r.agent, task_hash, CASE WHEN model = 'haiku' THEN 'with' ELSE 'without' END AS side, input_tokens + output_tokens + cache_creation AS p, completed FROM runs r JOIN own ON own.agent = r.agent AND own <> 'haiku' WHERE task_hash IS NOT NULL AND (model = 'haiku' OR model = own))
    SELECT agent AS comparison_id, side, count(*) AS runs, count(*) FILTER (completed) AS completed, CAST(sum(p) AS BIGINT) AS tokens FROM r GROUP BY agent, side""",
)
def model_sweep(t):
    own = t["runs"].select("agent").distinct().withColumn("model", F.when(F.col("agent") < "f", "opus").otherwise("haiku"))
    return inference.model_sides(t["runs"], "haiku", own).groupBy("comparison_id", "side").agg(F.count(F.lit(1)).alias("runs"), F.count_if("completed").alias("completed"), F.sum("tokens").alias("tokens"))


@query(
    "runs",
    sql=f"""WITH b AS (SELECT agent, task_hash AS task_id, arg_min({TOTAL}, (ts, id)) AS run1_tokens, min({TOTAL}) AS best_tokens FROM runs WHERE {PLAIN} GROUP BY ALL),
    p AS (SELECT agent, task_hash AS task_id, coalesce(CAST(floor(avg({TOTAL}) FILTER (completed) + 0.5) AS BIGINT), 0) AS mean_tokens, CAST(sum({TOTAL}) AS BIGINT) AS spent FROM runs WHERE task_hash IS NOT NULL AND config = 'candidate' GROUP BY ALL)
    SELECT agent, task_id, mean_tokens, spent, run1_tokens, best_tokens, CASE WHEN run1_tokens IS NULL THEN 'no baseline (no completed run yet)' WHEN run1_tokens = 0 OR mean_tokens = 0 THEN 'n/a'
      ELSE CASE WHEN mean_tokens >= run1_tokens THEN '+' ELSE '' END || printf('%.1f%%', (mean_tokens - run1_tokens) * 100.0 / run1_tokens) END AS change FROM p LEFT JOIN b USING (agent, task_id)""",
)
def bench_notes(t):
    passes = t["runs"].filter("task_hash IS NOT NULL AND config = 'candidate'").select("agent", F.col("task_hash").alias("task_id"), S.total_tokens().alias("tokens"), "completed")
    return inference.bench_report(passes, ledger.baselines(t["runs"]))


@query("rules", sql="SELECT id, agent, status, protected, context_cost FROM rules UNION ALL SELECT (SELECT max(id) FROM rules) + row_number() OVER (ORDER BY agent, body), agent, 'candidate', false, 7 FROM (SELECT DISTINCT agent, 'new body of ' || status AS body FROM rules)")
def inserted_rules(t):
    new = t["rules"].select("agent", F.concat(F.lit("new body of "), "status").alias("body")).distinct().withColumns({"context_cost": F.lit(7), "created_at": F.lit("2024-01-01")})
    return ledger.inserted_rules(t["rules"], new).select("id", "agent", "status", "protected", "context_cost")


@query("measures", sql="SELECT comparison_id, side, CAST(floor(avg(tokens) FILTER (completed) + 0.5) AS BIGINT) AS tokens, count(DISTINCT task_id) AS tasks, count(DISTINCT task_id) FILTER (completed) AS passed FROM measures GROUP BY ALL")
def side_totals(t):
    return inference.side_totals(t["measures"])


# values of a side without those further from their median than three median deviations and half the median
def clean(x: str) -> str:
    away = f"list_transform({x}, lambda v: abs(v - list_aggregate({x}, 'median')))"
    return f"CASE WHEN len({x}) < 3 THEN {x} ELSE list_filter({x}, lambda v: abs(v - list_aggregate({x}, 'median')) <= greatest(3 * list_aggregate({away}, 'median'), 0.5 * abs(list_aggregate({x}, 'median')))) END"


@query(
    "measures",
    sql=f"""WITH {ASSESSED}, x AS (SELECT comparison_id, side, task_id, list(CAST(tokens AS DOUBLE)) FILTER (completed) AS x, max(weight) AS w FROM measures GROUP BY ALL), y AS (SELECT comparison_id, side, task_id, w, {clean("x")} AS y FROM x WHERE len(x) > 0),
    p AS (SELECT o.comparison_id, o.w, list_aggregate(o.y, 'avg') AS mo, list_aggregate(i.y, 'avg') AS mi, list_aggregate(o.y, 'var_samp') AS vo, list_aggregate(i.y, 'var_samp') AS vi, len(o.y) AS no, len(i.y) AS ni
      FROM y o JOIN y i ON i.comparison_id = o.comparison_id AND i.task_id = o.task_id AND o.side = 'without' AND i.side = 'with'),
    q AS (SELECT comparison_id, sum(vo * (no - 1)) / sum(no - 1) FILTER (no > 1) AS po, sum(vi * (ni - 1)) / sum(ni - 1) FILTER (ni > 1) AS pi FROM p GROUP BY comparison_id),
    r AS (SELECT comparison_id, sum(w * (mo - mi)) / sum(w) AS robust, sqrt(sum(w * w * (coalesce(vo, po) / no + coalesce(vi, pi) / ni))) / sum(w) AS rse FROM p JOIN q USING (comparison_id) GROUP BY comparison_id),
    e AS (SELECT *, coalesce(NOT regression AND abs(mean - 53.125) < multiple * se, false) AS uncertain, floor(mean + 0.5) - 53.125 AS margin FROM z LEFT JOIN r USING (comparison_id))
    SELECT comparison_id, CAST(floor(mean + 0.5) AS BIGINT) AS delta, CASE WHEN rse IS NOT NULL THEN CAST(floor(robust + 0.5) AS BIGINT) END AS robust_delta,
      coalesce(basis = 'within-task' AND rse IS NOT NULL AND abs(mean - robust) > rse, false) AS tail_risk, CAST(CASE WHEN NOT regression AND se IS NOT NULL AND margin > 0 THEN least(greatest(ceil(multiple * se / margin) - 1, 0), 2) ELSE 0 END AS INT) AS rounds,
      CASE WHEN regression THEN 'regression' WHEN environment_failure THEN 'environment failure' WHEN tasks < 2 THEN 'too few tasks' WHEN uncertain THEN 'uncertain' WHEN mean >= 0.5 THEN 'cheaper' ELSE 'dearer' END AS verdict FROM e""",
)
def assessments(t):
    """Delta without outliers, tail risk, rounds that protect a banked saving, and the verdict."""
    a = inference.assess(t["measures"])
    return a.select("comparison_id", "delta", "robust_delta", "tail_risk", inference.rounds_of().alias("rounds"), inference.verdict_line().alias("verdict"))
