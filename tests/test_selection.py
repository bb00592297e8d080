import random

from pyspark.sql import functions as F

from millrace.operators import selection
from millrace.operators.inference import assess

MEASURES = "comparison_id string, side string, task_id string, run_no int, tokens long, completed boolean, weight double, context_cost int"
RULES = "id long, agent string, status string, replaces long, protected boolean, created_at int, decided_at int"
KINDS = "comparison_id string, kind string, banked long, measured_side string"


def test_plans(spark):
    rows = [(1, "a", "active", None, False, 1, 5), (2, "a", "active", None, False, 2, None), (3, "a", "active", None, True, 0, None), (4, "a", "candidate", None, False, 9, None), (5, "a", "candidate", 1, False, 8, None), (6, "b", "candidate", 99, False, 1, None)]
    rows += [(10 + i, "c", "candidate", None, False, i, None) for i in range(5)]
    got = {r.rule_id: (r.kind, r.with_rules, r.without_rules, r.prefix) for r in selection.comparison_plans(spark.createDataFrame(rows, RULES)).collect()}
    assert got[4] == ("candidate", [1, 2, 3, 4], [1, 2, 3], "") and got[5] == ("candidate", [2, 3, 5], [2, 3], "swap for rule 1: ")
    assert got[2] == ("re-audit", [1, 2, 3], [1, 3], "re-audit: ") and got[6] == ("candidate", [6], [], "")
    assert set(got) == {2, 4, 5, 6, 10, 11, 12}


def rows(rng, c, saving, sd, n, start=0):
    out = []
    for t in range(4):
        for s in ("without", "with"):
            out += [(c, s, f"t{t}", start + k, max(2000, int(rng.gauss(50_000 - saving * (s == "with"), sd))), True, 1.0, 25) for k in range(n)]
    return out


def test_decisions(spark):
    rng = random.Random(1)
    first = rows(rng, "sure", 9000, 100, 3) + rows(rng, "noise", 3000, 9000, 2) + rows(rng, "audit", 2500, 9000, 2) + rows(rng, "loss", -5000, 100, 3)
    df = spark.createDataFrame(first, MEASURES)
    reserve = None
    for k in (1, 2, 3):
        more = spark.createDataFrame([x for c in ("noise", "audit") for x in rows(rng, c, 3000, 9000, 6, 100 * k)], MEASURES).withColumn("round", F.lit(k))
        reserve = more if reserve is None else reserve.unionByName(more)
    kinds = spark.createDataFrame([("sure", "candidate", None, "with"), ("noise", "candidate", None, "with"), ("audit", "re-audit", 2500, "without"), ("loss", "candidate", None, "with")], KINDS)
    before = {r.comparison_id: r.uncertain for r in assess(df).collect()}
    state, after = selection.measured(df, reserve, kinds)
    got = {r.comparison_id: r for r in state.collect()}
    added = {(r.comparison_id, r.side): r.n for r in after.join(df, ["comparison_id", "side", "task_id", "run_no"], "left_anti").groupBy("comparison_id", "side").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got["sure"].rounds == 0 and not before["sure"] and got["loss"].rounds == 0
    assert before["noise"] and got["noise"].rounds == 1 and added["noise", "with"] == 8 and ("noise", "without") not in added
    assert before["audit"] and 1 <= got["audit"].rounds <= 3
    decided = {r.comparison_id: (r.status, r.reason) for r in selection.decide(state, kinds).collect()}
    assert decided["sure"][0] == "active" and decided["loss"][0] == "evicted" and decided["loss"][1].startswith("non-positive delta")
    assert decided["noise"][0] == ("evicted" if got["noise"].uncertain else "active")
    rec = {r.comparison_id: r for r in selection.receipts(after, state, selection.decide(state, kinds), F.lit(7)).collect()}
    assert rec["sure"].tasks_total == 4 and rec["sure"].runs == 3 and rec["sure"].tasks_passed_with == 4 and rec["sure"].status == "active"


def test_spoiled_and_flags(spark):
    bad = [("x", "with", f"t{i}", 0, 10, False, 1.0, 25) for i in range(4)] + [("x", "without", "t0", 0, 9000, True, 1.0, 25), ("y", "with", "t", 0, 9000, True, 1.0, 25)]
    assert [r.comparison_id for r in selection.spoiled(spark.createDataFrame(bad, MEASURES)).collect()] == ["x"]
    df = spark.createDataFrame([(True, False, False, True, None)], "regression boolean, environment_failure boolean, completion_drop boolean, tail_risk boolean, uncertain boolean")
    assert df.select(selection.decision_flags().alias("f")).first().f == ["regression", "tail_risk"]
    d = spark.createDataFrame([("c", "with", "t", True, 10), ("c", "with", "t", True, 21), ("c", "with", "u", True, None), ("c", "without", "t", False, 5)], "comparison_id string, side string, task_id string, completed boolean, duration_ms long")
    assert {r.side: r.duration_ms for r in selection.duration_means(d).collect()} == {"with": 16, "without": None}
    labels = spark.createDataFrame([("audit-3",), ("candidate-1-topup",), ("swap-base-2",)], "l string")
    assert [r.c for r in labels.select(selection.run_config("l").alias("c")).collect()] == ["audit", "candidate", "candidate"]
