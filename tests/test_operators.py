import json
import random
import re
from collections import Counter
from statistics import mean, variance

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import cohort, cost, inference, ledger, resampling, retrieval, similarity, windows
from millrace.plans import text_queries
from millrace.schemas import RUNS, TABLES, empty, migrated
from millrace.sources import corpus, ledger_files, transcripts

MEASURES = "comparison_id string, side string, task_id string, run_no int, tokens long, completed boolean, weight double, context_cost int"


# ledger


def run(i, agent="a", total=100, ts="2024-01-01 00:00:00", **more):
    base = dict(id=i, agent=agent, session_id=f"s{i}", task_hash=None, input_tokens=total, output_tokens=0, cache_creation=0, cache_read=0, tool_calls=0, file_rereads=0, completed=True, ruleset_version=1, ts=ts, config="real", project=None, model=None, duration_ms=None)
    return base | more


def runs(spark, rows):
    names = [c.split()[0] for c in RUNS.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RUNS.replace("ts timestamp", "ts string"))
    return df.withColumn("ts", F.to_timestamp("ts")).select(*names)


def test_triggers(spark):
    rows = [run(i, total=10_000, ts=f"2024-01-0{1 + i % 9} 0{i}:00:00") for i in range(6)]
    high, low = run(90, total=40_000, ts="2024-02-01 00:00:00"), run(91, total=9_000, ts="2024-02-02 00:00:00")
    got = {r.id: r.triggered for r in windows.distill_triggers(runs(spark, [*rows, high, low])).collect()}
    assert got[90] and not got[91] and not any(got[i] for i in range(6))
    odd = {r.id: r.anomalous for r in windows.anomalies(runs(spark, [*rows, high, low])).collect()}
    assert odd[90] and not odd[91]


def test_rolling_percentile_against_loop(spark):
    rng = random.Random(1)
    rows = [run(i, agent=rng.choice("ab"), total=rng.randint(1, 500), ts=f"2024-01-01 00:{rng.randint(0, 5):02d}:00") for i in range(200)]
    got = {r.id: (r.p75, r.triggered) for r in windows.distill_triggers(runs(spark, rows)).collect()}
    for a in "ab":
        prior = []
        for r in sorted((r for r in rows if r["agent"] == a), key=lambda r: (r["ts"], r["id"])):
            last = sorted(prior[-50:])
            p = last[-(-3 * len(last) // 4) - 1] if last else None
            assert got[r["id"]] == (p, len(last) >= 5 and r["input_tokens"] > p)
            prior.append(r["input_tokens"])


def test_upsert_takes_nulls_too(spark):
    old = runs(spark, [run(1, project="p"), run(2)])
    new = runs(spark, [run(3, session_id="s1", total=7) | {"session_id": "s1"}])
    got = {r.session_id: (r.id, r.project, r.input_tokens) for r in ledger.upsert_runs(old, new).collect()}
    assert got == {"s1": (3, None, 7), "s2": (2, None, 100)}


def test_empty_ledger(spark):
    r = empty(spark, "runs")
    assert ledger.token_mix(r).first().input_tokens == 0 and ledger.curve_by_project(r).collect() == [] and ledger.baselines(r).collect() == []
    assert set(TABLES) == {"runs", "rules", "baselines", "ruleset_versions", "questions", "tool_costs", "rule_receipts"}
    assert migrated(spark.createDataFrame([(1, "x", 2)], "id long, agent string, odd int"), "runs").columns == r.columns
    with pytest.raises(ValueError):
        migrated(r, "runs", 99)


def test_filters_reach_the_scan(spark, tmp_path):
    runs(spark, [run(1)]).write.parquet(f"{tmp_path}/r")
    plan = ledger.where(spark.read.parquet(f"{tmp_path}/r"), agent="a").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(agent), EqualTo(agent,a)]" in plan and "project" not in plan.split("ReadSchema")[1]


def test_two_strikes_against_loop(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.random() < 0.5, rng.random() < 0.05, rng.random() < 0.2) for k in range(40) for i in range(12)]
    got = Counter((r.k, r.i, r.outcome) for r in windows.two_strikes(spark.createDataFrame(rows, "k int, i int, sub boolean, regression boolean, env boolean"), ["k"], "i").collect())
    want = Counter()
    for k in range(40):
        strike = False
        for _, i, sub, regression, env in (r for r in rows if r[0] == k):
            if env:
                continue
            if regression or sub and strike:
                want[k, i, "evicted"] += 1
                break
            strike = sub
            want[k, i, "strike" if sub else "cleared"] += 1
    assert got == want


# inference


def measures(spark, rows, cost=25):
    return spark.createDataFrame([(c, s, t, n, x, ok, float(w), cost) for c, s, t, n, x, ok, w in rows], MEASURES)


def closed_form(tasks, weights):
    vo = sum(variance(o) * (len(o) - 1) for o, _ in tasks if len(o) > 1) / sum(len(o) - 1 for o, _ in tasks if len(o) > 1)
    vw = sum(variance(w) * (len(w) - 1) for _, w in tasks if len(w) > 1) / sum(len(w) - 1 for _, w in tasks if len(w) > 1)
    v = lambda x, p: variance(x) if len(x) > 1 else p
    return sum(k * k * (v(o, vo) / len(o) + v(w, vw) / len(w)) for (o, w), k in zip(tasks, weights, strict=True)) ** 0.5 / sum(weights)


@pytest.mark.parametrize("weights", [[1, 1, 1, 1], [4, 1, 1, 2]])
def test_within_error(spark, weights):
    rng = random.Random(3)
    tasks = [([rng.randint(900, 1500) + 10**6 for _ in range(n)], [rng.randint(500, 1400) + 10**6 for _ in range(m)]) for n, m in ((3, 3), (2, 4), (1, 2), (3, 1))]
    rows = [("c", side, f"t{i}", n, x, True, weights[i]) for i, t in enumerate(tasks) for side, xs in zip(("without", "with"), t, strict=True) for n, x in enumerate(xs)]
    a = inference.assess(measures(spark, rows)).first()
    assert a.standard_error == pytest.approx(closed_form(tasks, weights), rel=1e-9) and a.basis == "within-task"
    half_up = lambda x: int((x + 0.5) // 1)
    saving = [half_up(mean(o)) - half_up(mean(w)) for o, w in tasks]
    assert a.delta == int((sum(s * k for s, k in zip(saving, weights, strict=True)) / sum(weights) + 0.5) // 1)
    assert a.multiple == 2.0 if len(set(weights)) == 1 else a.multiple >= 2.0


def test_flags(spark):
    ok = [("c", s, "t1", n, 50_000 - 9000 * (s == "with"), True, 1) for s in ("without", "with") for n in range(2)]
    cases = {
        "regression": [("c", "without", "t2", 0, 9000, True, 1), ("c", "with", "t2", 0, 9000, False, 1)],
        "environment_failure": [("c", "without", "t2", 0, 9000, True, 1), ("c", "with", "t2", 0, 10, False, 1)],
        "completion_drop": [("c", "without", "t2", 0, 9000, True, 1), ("c", "with", "t2", 0, 9000, True, 1), ("c", "with", "t2", 1, 9000, False, 1)],
    }
    for flag, more in cases.items():
        a = inference.assess(measures(spark, ok + more)).first()
        assert [f for f in cases if a[f]] == [flag]
    missing = inference.assess(measures(spark, [*ok, ("c", "without", "t2", 0, 9000, True, 1)])).first()
    assert missing.environment_failure and not missing.regression
    alone = inference.assess(measures(spark, [("c", "without", "t", 0, 5, True, 1), ("c", "with", "t", 0, 3, True, 1)])).first()
    assert alone.standard_error is None and alone.basis is None and not alone.uncertain and alone.delta == 2


def test_between_error_and_uniform_weights(spark):
    rows = [("c", s, f"t{i}", 0, 1000 * (i + 1) - 300 * (s == "with") * i, True, 1) for i in range(4) for s in ("without", "with")]
    a = inference.assess(measures(spark, rows)).first()
    savings = [0, 300, 600, 900]
    assert a.basis == "between-task" and a.multiple == 2.0 and a.standard_error == pytest.approx((variance(savings) / 4) ** 0.5)


def test_outliers(spark):
    df = spark.createDataFrame([([10.0, 11.0, 12.0, 100.0],), ([1.0, 100.0],), ([5.0, 5.0, 5.0, 7.0, 9.0],)], "x array<double>")
    assert [r.y for r in df.select(inference.without_outliers(F.col("x")).alias("y")).collect()] == [[10.0, 11.0, 12.0], [1.0, 100.0], [5.0, 5.0, 5.0, 7.0]]


def test_top_up_is_greedy(spark):
    rng = random.Random(4)
    tasks = {f"t{i}": [rng.randint(0, 1000) for _ in range(rng.randint(2, 4))] for i in range(5)}
    rows = [("c", s, t, n, x, True, 1 + int(t[1]) % 2) for t, xs in tasks.items() for s in ("without", "with") for n, x in enumerate(xs)]
    got = {r.task_id: r.add for r in inference.top_up(inference.per_task(inference.summarize_tasks(measures(spark, rows))), 9).collect()}
    n, want = {t: len(x) for t, x in tasks.items()}, Counter()
    for _ in range(9):
        t = max(sorted(tasks), key=lambda t: (1 + int(t[1]) % 2) ** 2 * variance(tasks[t]) / (n[t] * (n[t] + 1)))
        n[t] += 1
        want[t] += 1
    assert got == dict(want)


def test_cohorts(spark):
    rows = [("a", 1, 100.0 + i) for i in range(6)] + [("a", 2, 50.0 + i) for i in range(6)] + [("b", 1, 5.0)] + [("c", v, 10.0 + i % 2) for v in (1, 2) for i in range(6)]
    got = {r.agent: (r.verdict, r.delta) for r in cohort.assess_cohorts(spark.createDataFrame(rows, "agent string, ruleset_version int, total double")).collect()}
    assert got == {"a": ("improved", 50.0), "b": ("insufficient-data", None), "c": ("no-change", 0.0)}


def test_confirm_and_governance(spark):
    """What production can say about a promise: nothing to confirm without rules or savings, whatever happened there."""
    verdicts = ("improved", "regressed", "no-change", "insufficient-data")
    cohorts = spark.createDataFrame([(f"{v}/{f}", v) for v in verdicts for f in ("none", "zero", "some")], "agent string, verdict string")
    fixture = spark.createDataFrame([(f"{v}/{f}", 2, s, []) for v in verdicts for f, s in (("zero", 0), ("some", 900))], "agent string, active_rules long, saving long, regressed array<long>")
    got = {r.agent: r.outcome for r in cohort.confirm(fixture, cohorts).collect()}
    assert {got[f"{v}/{f}"] for v in verdicts for f in ("none", "zero")} == {"nothing-to-confirm"}
    assert [got[f"{v}/some"] for v in verdicts] == ["corroborated", "contradicted", "unconfirmed", "unconfirmed"]
    assert [r.a for r in spark.createDataFrame([(i, v) for i, v in enumerate(verdicts)], "i int, verdict string").orderBy("i").select(cohort.governance().alias("a")).collect()] == ["corroborated", "re-audit", "no-signal", "insufficient-data"]


RULE = "id long, agent string, body string, status string, measured_delta long, context_cost long"
RECEIPT = "rule_id long, agent string, status string, decided_no long, delta long, context_cost long, runs long, with_tokens long, without_tokens long, model string, regression boolean"


def test_costs_rank_by_the_price_of_a_token(spark):
    """55 tokens at 1e-6 and 11 at 5e-6 differ in their last bit, which decides the rank before the id does."""
    rules = spark.createDataFrame([(1, "a", "x", "active", 0, 0), (2, "a", "y", "active", 0, 0)], RULE)
    receipts = spark.createDataFrame([(k, "a", "active", 1, 0, n, 1, 9, 9, m, False) for k, n, m in ((1, 11, "opus"), (2, 55, "haiku"))], RECEIPT)
    got = cost.agent_costs(rules, receipts, runs(spark, [run(1)])).collect()
    want = {1: 11 * 5e-6, 2: 55 * 1e-6}
    assert want[1] != want[2] and {r.rule_id: r.rent for r in got} == want and [r.rule_id for r in got] == sorted(want, key=want.get)


def test_costs_by_hand(spark):
    """Two active rules of one agent; the mix is a million of each counter, the price of sonnet 3 and 15 dollars."""
    rules = spark.createDataFrame([(1, "a", "x", "active", 0, 0), (2, "a", "y", "active", 0, 0), (3, "a", "z", "evicted", 0, 0)], RULE)
    receipts = spark.createDataFrame([(1, "a", "active", 1, 99, 9, 9, 9, 9, None, False), (1, "a", "active", 2, 1000, 100, 2, 5000, 6000, "sonnet", False), (2, "a", "active", 1, -5, 200, 1, 10, 10, "opus", True), (3, "a", "evicted", 1, 10**6, 1, 1, 1, 1, "opus", False)], RECEIPT)
    work = [run(1) | dict(input_tokens=10**6, output_tokens=10**6, cache_creation=10**6, cache_read=10**6), run(2) | dict(completed=False, input_tokens=10**9)]
    got = {r.rule_id: r for r in cost.agent_costs(rules, receipts, runs(spark, work)).collect()}
    rate = (3 + 15 + 3.75 + 0.3) / 4e6
    assert set(got) == {1, 2} and got[1].rent == pytest.approx(100 * 3e-6) and got[1].saving == pytest.approx(1000 * rate) and got[1].net == pytest.approx(1000 * rate - 3e-4)
    assert got[1].discovery == pytest.approx(2 * 11000 * rate) and got[1].break_even == -(-2 * 11000 * rate // (1000 * rate - 3e-4)) and got[1].weekly == pytest.approx(20 * got[1].net)
    assert got[2].saving == 0 and got[2].rent == pytest.approx(200 * 5e-6) and got[2].break_even is None
    p = cost.project_agents(cost.agent_costs(rules, receipts, runs(spark, work)), runs(spark, work), weeks=2).first()
    net, found = got[1].net + got[2].net, got[1].discovery + got[2].discovery
    assert p.gross_savings == pytest.approx(40 * 1000 * rate) and p.net_benefit == pytest.approx(40 * net - found) and p.baseline == pytest.approx(40 * 4e6 * rate)
    assert p.with_rules == pytest.approx(p.baseline - 40 * net + found) and p.share_saved == pytest.approx(p.net_benefit / p.baseline)
    alone = cost.project_agents(cost.agent_costs(rules.limit(0), receipts, runs(spark, work)), runs(spark, work)).first()
    assert alone.rules == 0 and alone.baseline == pytest.approx(80 * 4e6 * rate) and alone.break_even is None
    fixture = cohort.fixture_side(receipts, rules).first()
    assert (fixture.active_rules, fixture.saving, fixture.regressed) == (2, 1000, [2])


def test_only_the_active_set_counts(spark):
    rows = [run(i, total=t, ts=f"2024-01-0{i} 00:00:00") | dict(task_hash="t", config=c) for i, t, c in ((1, 10, "candidate"), (2, 500, "active"), (3, 20, "audit"), (4, 300, "active"), (5, 400, "active"))]
    df = runs(spark, rows)
    b = ledger.baselines(df).first()
    assert (b.run1_tokens, b.best_tokens) == (500, 300)
    s = ledger.suite_comparison(df).first()
    assert (s.baseline_tokens, s.latest_tokens, s.best_tokens, s.tasks, s.change) == (500, 400, 300, 1, "-20.0%")
    assert ledger.learning_curve(df).agg(F.sum("runs")).first()[0] == 3 and ledger.golden_totals(df).count() == 3 and ledger.run_counts(df).first().golden == 5
    both = df.unionByName(runs(spark, [run(9, agent="b", ts="2024-02-01 00:00:00") | dict(task_hash="t", config="audit")]))
    assert [str(r.last_ts) for r in ledger.last_measurement(both).collect()] == ["2024-02-01 00:00:00"]
    m = cost.meta_cost(both.filter("task_hash IS NOT NULL"), both, F.to_timestamp(F.lit("2024-02-02"))).first()
    assert m.bench == 1330 and m.real == 0 and m.share is None and not m.warn


def test_inserted_rules(spark):
    names = "id long, agent string, body string, status string, context_cost long, created_at string, decided_at string, decided_reason string, protected boolean, probation boolean, source_run long, replaces long"
    old = spark.createDataFrame([(7, "a", "x", "active", 1, "2024", None, None, False, False, None, None)], names)
    new = spark.createDataFrame([("a", "later", 2, "2025-02", 9, 7), ("a", "sooner", 2, "2025-01", 9, None)], "agent string, body string, context_cost long, created_at string, source_run long, replaces long")
    got = {r.id: r for r in ledger.inserted_rules(old, new).collect()}
    assert [got[i].body for i in (7, 8, 9)] == ["x", "sooner", "later"] and got[9].replaces == 7 and got[8].status == "candidate" and not got[8].protected and got[8].decided_at is None
    told = {r.body: r for r in ledger.inserted_rules(old.limit(0), new, authored=True).collect()}
    assert told["sooner"].id == 1 and told["later"].status == "active" and told["later"].protected and told["later"].decided_at == "2025-02" and told["later"].source_run is None and told["later"].replaces is None


def test_known_agents(spark):
    bundled = spark.createDataFrame([("sql", 0), ("api", 1)], "name string, pos int")
    files = spark.createDataFrame([("zeta.md",), ("sql.md",), ("Bad Name.md",), ("beta.md",), ("notes.txt",)], "file string")
    assert [r.name for r in windows.known_agents(bundled, files).orderBy("pos").collect()] == ["sql", "api", "beta", "zeta"]


def test_hops_read_a_chunk_once(spark):
    chunks = spark.createDataFrame([(c, 10 * i) for i, c in enumerate("abcd", 1)], "chunk_id string, tokens long")
    hops = spark.createDataFrame([(1, 1, ["b", "a"]), (1, 2, ["a", "c", "b"]), (1, 3, ["a"]), (2, 1, ["a"])], "question_id int, hop int, chunks array<string>")
    got = {(r.question_id, r.hop): (r.chunks, r.tokens) for r in retrieval.fresh_hops(hops, chunks).collect()}
    assert got == {(1, 1): (["b", "a"], 30), (1, 2): (["c"], 30), (1, 3): ([], 0), (2, 1): (["a"], 10)}


def test_contradictions_against_loop(spark):
    rng = random.Random(8)
    vocabulary = "always never not all none full partial every no run tests files suite read commit the an use cache".split()
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rules = [(i, say(rng.randint(1, 5))) for i in range(40)]
    docs = [(d, "\n".join(rng.choice(["- ", "# ", "> 1. ", ""]) + say(rng.randint(0, 6)) + rng.choice([".", "", "! " + say(3)]) for _ in range(4))) for d in range(25)]
    got = {r.rule_id: (r.doc_id, r.line, r.reason) for r in similarity.contradictions(spark.createDataFrame(rules, "id int, body string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    words = lambda t: [w for w in re.findall(r"[a-z']+", t.lower()) if len(w) > 1]
    topic = lambda t: {w for w in words(t) if w not in X.STOPWORDS and w not in X.NEGATIONS}
    neg = lambda t: any(w in X.NEGATIONS for w in words(t))
    want = {}
    for i, body in rules:
        lines = [(d, x) for d, t in docs for x in (re.sub(r"^[\s>#*\-\d.)]+", "", y).strip() for y in re.split(r"\r?\n|(?<=[.!?])\s+", t)) if x]
        for d, line in lines:
            n = len(topic(body) & topic(line))
            clash = [f'uses "{a}"/"{b}" against a shared-topic directive' for a, b in X.ANTONYMS if a in words(body) and b in words(line) or b in words(body) and a in words(line)]
            why = f"shares {n} key terms with an opposite-polarity directive" if n >= 2 and neg(body) != neg(line) else clash[0] if n and clash else None
            if why:
                want[i] = (d, line, why)
                break
    assert got == want and len(want) > 10


def test_resampling(spark):
    pool = spark.createDataFrame([(f"t{i}", 10 * i + j, 1000 + 17 * j * i) for i in range(3) for j in range(8)], "task_id string, row int, tokens int")
    first = sorted(map(tuple, resampling.permutation_trials(pool, 5).collect()))
    assert first == sorted(map(tuple, resampling.permutation_trials(pool.repartition(7), 5).collect())) and len(first) == 5 * 3 * 4
    null, strong = (resampling.keep_rate(resampling.synthetic_trials(spark, 300, 3, saving=s)).first().rate for s in (0.0, 40_000.0))
    assert null < 0.1 and strong > 0.95
    assert resampling.bootstrap_trials(pool, 4, saving=1e9).filter("side = 'with'").agg(F.max("tokens")).first()[0] == 0


# documents and retrieval


def plain_chunks(text):
    out, size, step = [], 4800, 4480
    if -(-len(text) // 4) <= 1200:
        return [(0, len(text))]
    p = 0
    while p < len(text):
        out.append((p, min(p + size, len(text))))
        if out[-1][1] == len(text):
            break
        p += step
    return out


def test_chunks(spark):
    long = "".join(chr(97 + i % 26) for i in range(20_000))
    md = "intro\n# One\nbody\n## Two\nmore\nITEM LIST\nx\nItem 7. Risk\ny\n# Last"
    docs = spark.createDataFrame([("a", md), ("b", long), ("c", " \n"), ("d", None), ("e", "# Only\nt"), ("f", "plain")], "doc_id string, text string")
    got = {}
    for r in corpus.chunks(docs).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {"a", "b", "e", "f"}
    assert [(r.section_path, r.text.split("\n")[0]) for r in got["a"]] == [([], "intro"), (["One"], "# One"), (["One", "Two"], "## Two"), (["One", "ITEM LIST"], "ITEM LIST"), (["Item 7. Risk"], "Item 7. Risk"), (["Last"], "# Last")]
    assert "".join(r.text for r in got["a"]) == md and [r.chunk_id for r in got["a"]][:2] == ["a#0", "a#1"]
    assert [(r.char_start, r.char_end) for r in got["b"]] == plain_chunks(long)
    assert [r.section_path for r in got["e"]] == [["Only"]]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    for name, text in (("a.md", "﻿# T\r\nx"), ("sub/b.csv", "h,i\n1,2"), ("c.html", "<p>q</p>"), (".git/d.md", "no"), ("e.bin", "no")):
        (tmp_path / name).write_bytes(text.encode())
    got = {r.doc_id: (r.format, r.text) for r in corpus.documents_from(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("md", "# T\nx"), "sub/b.csv": ("csv", "h: 1, i: 2"), "c.html": ("html", "q")}


def test_packing_against_loop(spark):
    rng = random.Random(5)
    chunks = [(f"d{i // 3}#{i % 3}", f"d{i // 3}", i % 3, [f"s{i % 2}"], " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))), i, rng.randint(20, 400)) for i in range(60)]
    df = spark.createDataFrame(chunks, "chunk_id string, doc_id string, ordinal int, section_path array<string>, text string, char_start long, tokens long")
    q = spark.createDataFrame([(1, "a b"), (2, "h"), (3, "zzz")], "question_id int, question string")
    scores = {(r.question_id, r.chunk_id): r.score for r in retrieval.bm25(df, q).collect()}
    got = {(r.question_id, r.strategy, r.budget): (r.chunks, r.tokens, r.dropped) for r in retrieval.retrieve(df, q, (300, 2000)).collect()}
    meta = {c[0]: c for c in chunks}
    for k in (1, 2, 3):
        ranked = sorted((c for j, c in scores if j == k), key=lambda c: (-scores[k, c], c))
        sections, seen = [], set()
        for c in ranked:
            key = (meta[c][1], tuple(meta[c][3]))
            if key not in seen:
                seen.add(key)
                sections += sorted((m for m in meta if (meta[m][1], tuple(meta[m][3])) == key), key=lambda m: meta[m][5])
        for name, order in (("bm25", ranked), ("section", sections)):
            for budget in (300, 2000):
                took, tokens, dropped = [], 0, 0
                for c in order:
                    if tokens + meta[c][6] <= budget:
                        took.append(c)
                        tokens += meta[c][6]
                    else:
                        dropped += 1
                assert got[k, name, budget] == (took, tokens, dropped)
        assert got[k, "full", 300][1] == sum(c[6] for c in chunks)


def test_scoring_and_knee(spark):
    chunks = spark.createDataFrame([("x#0", "x", 0, [], "revenue was 1,204.5 dollars", 0, 7), ("y#0", "y", 0, [], "nothing here", 0, 3)], "chunk_id string, doc_id string, ordinal int, section_path array<string>, text string, char_start long, tokens long")
    q = spark.createDataFrame([(1, "revenue", 1204.5, "x", [], False), (2, "nothing", None, None, [], True), (3, "revenue here", 9.0, None, ["x", "y"], False)], "question_id int, question string, expect_value double, must_cite_doc string, requires_docs array<string>, expect_empty boolean")
    r = retrieval.retrieve(chunks, q, (5, 10))
    got = {(x.question_id, x.strategy, x.budget): (x.answer_bearing, x.distractor_only, x.cited_doc_present) for x in retrieval.score_retrieval(r, chunks, q).collect()}
    assert got[1, "bm25", 10] == (True, False, True) and got[1, "bm25", 5] == (False, False, False)
    assert got[2, "bm25", 10] == (None, True, None) and got[3, "full", 5] == (False, False, True) and got[3, "bm25", 5] == (False, False, False)
    s = retrieval.summarize(retrieval.score_retrieval(r, chunks, q))
    assert {x.strategy: x.budget for x in retrieval.knee(s).collect()}["bm25"] == 10


def test_grounding(spark):
    chunks = spark.createDataFrame([("c1", "Sales were  5.0 up")], "chunk_id string, text string")
    facts = spark.createDataFrame([("a", 5.0, "c1", "sales WERE 5.0"), ("b", 6.0, "c1", "sales were 5.0"), ("c", 5.0, "c1", "profit"), ("d", 5.0, "zz", "x")], "metric string, value double, chunk_id string, quote string")
    v = retrieval.verify_grounding(facts, chunks)
    assert {r.metric: r.reason for r in v.collect()} == {"a": None, "b": "value-not-in-quote", "c": "quote-not-found", "d": "unknown-chunk"}
    assert retrieval.grounding_summary(v).first().rate == 0.25 and retrieval.grounding_summary(v.limit(0)).first().rate == 1.0


# similarity


def grams(t):
    s = "  " + " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()) + " "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(6)
    base = [" ".join(rng.choice(["run", "tests", "before", "commit", "files", "read", "only", "once"]) for _ in range(8)) for _ in range(12)]
    return [(i, base[i % 12][: rng.randint(25, 60)] + rng.choice(["", "!", " now", " x"])) for i in range(80)] + [(100, ""), (101, "")]


def test_similar_pairs(spark, bodies):
    df = spark.createDataFrame(bodies, "id int, body string")
    rep = {i: min(j for j, y in bodies if grams(x) == grams(y)) for i, x in bodies}
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(df, 0.6).collect()}
    want = {(i, j): jaccard(x, y) for i, x in bodies for j, y in bodies if i < j and i == rep[i] and j == rep[j] and jaccard(x, y) > 0.6}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 20
    classes = {r.id: (r.rep, r.links) for r in similarity.similar_classes(df, 0.6).collect()}
    assert classes == {i: (rep[i], sum(rep[i] in p for p in want)) for i, _ in bodies} and any(rep[i] != i for i in rep)


def test_signatures_of_all_widths(spark):
    """Sets of 1 to some thousand trigrams, near copies among them: all pairs by brute force, while few pairs pass the signatures. A long text's trigrams take one pass."""
    rng = random.Random(8)
    texts = {i: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)) for i, n in enumerate((0, 1, 2, 5, 9, 20, 30, 60, 61, 90, 130, 200, 260, 700))}
    texts |= {i + 50: x[: len(x) * 9 // 10] + " tail" for i, x in texts.items()} | {i + 100: x[: len(x) * 7 // 10] for i, x in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "id int, body string")
    want = {(i, j) for i in texts for j in texts if i < j and grams(texts[i]) != grams(texts[j]) and jaccard(texts[i], texts[j]) > 0.6}
    assert {(r.a, r.b) for r in similarity.similar_pairs(df, 0.6).collect()} == want and len(want) > 20
    sets = df.select(F.col("id").alias("k"), X.trigrams("body").alias("g"))
    met = {(min(r), max(r)) for r in similarity.close_signatures(sets, 0.6).collect()}
    assert want <= met and len(met) < len(want) + 20
    long = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    assert set(spark.createDataFrame([(long,)], "t string").select(X.trigrams("t")).first()[0]) == grams(long)


def test_greedy_dedup(spark, bodies):
    got = {r.id: r.kept for r in similarity.greedy_dedup(spark.createDataFrame(bodies, "id int, body string"), 0.6).collect()}
    kept = []
    for i, x in bodies:
        if not any(jaccard(x, y) > 0.6 for _, y in kept):
            kept.append((i, x))
    assert {i for i, k in got.items() if k} == {i for i, _ in kept} and len(got) == len(bodies)


def test_import_and_contradictions(spark):
    rules = "id long, body string"
    active = spark.createDataFrame([(1, "always run the whole suite")], rules)
    new = spark.createDataFrame([(1, "always run the whole suite!"), (2, "read files only once"), (3, "Read files only once."), (4, "another thing")], rules)
    assert {r.id: r.action for r in similarity.plan_import(new, active).collect()} == {1: "duplicate", 2: "add", 3: "duplicate", 4: "add"}
    docs = spark.createDataFrame([(1, "Intro.\n- Never run the suite twice"), (2, "use partial suite runs")], "doc_id long, text string")
    got = {r.rule_id: r.reason for r in similarity.contradictions(active, docs).collect()}
    assert got == {1: "shares 2 key terms with an opposite-polarity directive"}


def test_contradicting_lines_reads_all_documents(spark):
    t = {"rules": spark.createDataFrame([(7, "building rule")], "id long, body string"), "papers": spark.createDataFrame([(1, "Always use BUILDING rule"), (2, "Always use the building rule")], "doc_id long, text string")}
    assert [(r.rule_id, r.doc_id) for r in text_queries.contradicting_lines(t).collect()] == [(7, "1")]


# transcripts and files

LOG = """﻿{"type":"user","sessionId":"s1","message":{"role":"user","content":"Please look at the parser and fix it"}}
{"type":"assistant","requestId":"r0","message":{"id":"m1","usage":{"input_tokens":10,"output_tokens":1},"content":[{"type":"text","text":"hi"},{"type":"tool_use","id":"u1","name":"Read","input":{"file_path":"/a"}}]}}
{"type":"assistant","message":{"id":"m1","usage":{"input_tokens":20,"output_tokens":2,"cache_read_input_tokens":100},"content":[{"type":"tool_use","id":"u1","name":"Read","input":{"file_path":"/b"}},{"type":"tool_use","id":"u2","name":"Read","input":{"file_path":"/a"}}]}}
not json
{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"u1","content":"12345"},{"type":"tool_result","tool_use_id":"u1","content":"longer one"},{"type":"tool_result","tool_use_id":"u2","content":[{"type":"text","text":"abc"},{"type":"text","text":"d"}]}]}}
{"type":"system","message":null}

{"type":"assistant","message":{"usage":{"input_tokens":5},"content":[{"type":"tool_use","name":"Skill","input":{"skill":"pdf"}},{"type":"text","text":"done"}]}}
"""


def test_transcript(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text(LOG.replace("\n", "\r\n"), encoding="utf-8")
    (tmp_path / "two.jsonl").write_text('{"type":"assistant","message":{"content":[{"type":"text","text":"x"}]}}\n{"type":"user","message":{"content":"stop"}}\n')
    lines = transcripts.read_lines(spark, str(tmp_path))
    got = {r.session_key: r for r in transcripts.sessions(lines).collect()}
    a = got["one"]
    assert (a.input_tokens, a.output_tokens, a.cache_creation, a.cache_read, a.tool_calls, a.file_rereads) == (25, 2, 0, 100, 3, 1)
    assert (a.session_id, a.agent, a.entries, a.malformed, a.completed) == ("s1", "main", 5, 1, True)
    assert not got["two"].completed and got["two"].tool_calls == 0
    tools = {r.key: r for r in transcripts.tool_events(transcripts.entries(lines)).collect()}
    assert tools["u1"].result_chars == 5 and tools["u2"].result_chars == 4 and tools["u1"].file_path == "/a" and tools["u1"].input_chars == len('{"file_path":"/a"}')
    costs = {(r.kind, r.label): r.calls for r in transcripts.tool_costs(transcripts.tool_events(transcripts.entries(lines))).collect()}
    assert costs == {("builtin", "Read"): 2, ("skill", "pdf"): 1}
    assert {r.grp for r in transcripts.tool_costs(transcripts.tool_events(transcripts.entries(lines))).collect()} == {"(builtin)", "(skills)"}
    assert {r.session_key: r.prompt for r in transcripts.first_prompts(lines).collect()} == {"one": "Please look at the parser and fix it"}
    d = {r.session_key: r.digest for r in transcripts.digests(lines).collect()}
    assert d["one"].split("\n")[:3] == ["USER: Please look at the parser and fix it", "ASSISTANT: hi", 'TOOL Read {"file_path":"/a"}']


def test_digest_is_bounded(spark):
    import json

    said = [f"line {i} " + "x" * (i % 50) for i in range(300)]
    rows = [("s", i, json.dumps({"type": "user", "message": {"content": t}})) for i, t in enumerate(said)]
    got = transcripts.digests(spark.createDataFrame(rows, "session_key string, line_no int, value string"), 1000).first().digest.split("\n")
    lines, head, n = [f"USER: {t.strip()}" for t in said], [], 0
    tail, m, dropped = [], 0, False
    for x in lines:
        if n + len(x) + 1 <= 400:
            head.append(x)
            n += len(x) + 1
            continue
        tail.append(x)
        m += len(x) + 1
        while m > 550 and len(tail) > 1:
            m -= len(tail.pop(0)) + 1
            dropped = True
    assert dropped and got == [*head, "…[transcript truncated]…", *tail]


def test_shared_files(spark):
    rules = spark.createDataFrame([(1, "a", "read once only", "active", 5, 3, None, "2024-01-01"), (2, "a", "skip \x07 bells", "active", None, 3, 9, "2024-01-02"), (3, "a", "old", "evicted", 1, 1, None, "x")], "id long, agent string, body string, status string, measured_delta long, context_cost long, source_run long, created_at string")
    files = ledger_files.shared_files(rules, "2024").select(F.col("agent").alias("path"), "content")
    assert ledger_files.verified_files(files).first() == ("a", 2, True)
    bad = files.withColumn("content", F.replace("content", F.lit("): read once only"), F.lit("): read")))
    assert not ledger_files.verified_files(bad).first().valid
    assert [r.body for r in ledger_files.imported_rules(files).orderBy("pos").collect()] == ["read once only", "skip \x07 bells"]
    memory = ledger_files.compiled_memory(rules)
    assert memory.first().content == "<!-- GENERATED BY millrace — do not hand-edit -->\n# Efficiency rules\n\n- read once only\n- skip bells\n"
    said = files.first().content
    assert "2 active rule(s)" in said and "- **+5 tokens/run** (rent 3): read once only\n- **n/a tokens/run** (rent 3): skip" in said
    assert "_No active rules yet._" in ledger_files.shared_files(rules.filter("status = 'evicted'"), "2024").first().content
    scoped = ledger_files.compiled_memory(rules.withColumn("scope", F.when(F.col("id") == 1, "in\nsql")))
    assert "- (when in sql) read once only\n- skip bells\n" in scoped.first().content
    assert ledger_files.drifted(rules, memory).collect() == [] and ledger_files.drifted(rules, memory.limit(0)).count() == 1


def test_long_shared_files_are_verified_whole(spark):
    """A file of over a million characters, with a body that ends no line; the limit for files of others stays."""
    body = F.concat(F.lpad(F.col("id").cast("string"), 4000, "x"), F.when(F.col("id") == 5, "\n): tail").otherwise(""))
    rules = spark.range(300).select("id", F.lit("a").alias("agent"), body.alias("body"), F.lit("active").alias("status"), F.lit(1).cast("long").alias("measured_delta"), F.col("id").alias("context_cost"), F.lit(None).cast("long").alias("source_run"), F.lit("x").alias("created_at"))
    files = ledger_files.shared_files(rules, "2024").select(F.col("agent").alias("path"), "content")
    assert ledger_files.verified_files(files, most=None).first() == ("a", 300, True)
    assert ledger_files.verified_files(files).first() == ("a", 0, False)
    bad = files.withColumn("content", F.regexp_replace("content", r"rent 77\): x", "rent 77): y"))
    assert not ledger_files.verified_files(bad, most=None).first().valid


def test_lines_of_split_files(spark, tmp_path):
    """Files read in splits give the lines of files read whole."""
    rng = random.Random(9)
    for f in range(3):
        (tmp_path / f"s{f}.jsonl").write_text("".join(f'{{"n": {i}, "x": "{"y" * rng.randint(0, 90)}"}}\n' for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        split = transcripts.stream_lines(spark, str(tmp_path))
        assert split.rdd.getNumPartitions() > 6
        got = {(r.session_key, r.line_no): r.value for r in split.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(r.session_key, r.line_no): r.value for r in transcripts.read_lines(spark, str(tmp_path)).filter("value <> ''").collect()} and len(got) == 1200


def test_grounded_replies_and_compression(spark):
    chunks = spark.createDataFrame([("c1", "Sales were 5.0 up")], "chunk_id string, text string")
    fact = '{"metric":"m","value":5.0,"chunkId":"c1","quote":"sales were 5.0"}'
    wrap = lambda body: json.dumps({"type": "result", "is_error": False, "result": body})
    replies = [(1, wrap(f"```json\n[{fact}, {{}}]\n```")), (2, wrap("words")), (3, "no envelope"), (4, wrap("[]"))]
    got = sorted((r.reply_id, r.metric or "", r.reason or "", r.malformed) for r in retrieval.grounded_facts(spark.createDataFrame(replies, "reply_id int, stdout string"), chunks).collect())
    assert got == [(1, "m", "", 1), (2, "", "not a list of facts", 0), (3, "", "not an envelope", 0), (4, "", "", 0)]
    rules = spark.createDataFrame([(1, "a", "always read the whole file before any edit", "active", 0, 11, 5), (2, "a", "old rule body here", "evicted", 0, 5, None), (3, "a", "read file, then edit", "active", 0, 5, None)], RULE + ", source_run long")
    body = lambda b: json.dumps({"body": b})
    asked = [("a", 1, body("read before edits")), ("a", 2, body("read before edits")), ("b", 1, body("read before edits")), ("a", 3, "x")]
    new = {(r.agent, r.rule_id): (r.reason, r.body, r.context_cost, r.replaces, r.source_run) for r in similarity.compressed_rules(spark.createDataFrame(asked, "agent string, rule_id long, reply string"), rules).collect()}
    assert new == {("a", 1): (None, "read before edits", 5, 1, 5), ("a", 2): ("rule is evicted",) + (None,) * 4, ("b", 1): ("no such rule",) + (None,) * 4, ("a", 3): ("invalid rewrite",) + (None,) * 4}
    alike = similarity.compressed_rules(spark.createDataFrame([("a", 1, body("read file then edit"))], "agent string, rule_id long, reply string"), rules).first()
    assert alike.reason == "near-duplicate of rule 3"


def test_rewrites_meet_few_rules(spark, monkeypatch):
    """Against all pairs; rewrites that are refused anyway, or whose size resembles no rule's, lead to no comparison."""
    rng = random.Random(4)
    rules = [(i, "a" if i % 2 else "b", " ".join(rng.choice(("read", "edit", "file", "once", "test")) for _ in range(rng.randint(4, 16))), "active" if i % 5 else "evicted", 0, 5, None) for i in range(90)]
    asked = [(a, i, json.dumps({"body": rng.choice(rules)[2][: max(10, len(b) // 2)].strip()})) for i, a, b, *_ in rules]
    df = spark.createDataFrame(rules, RULE + ", source_run long")
    got = {r.rule_id: r.reason for r in similarity.compressed_rules(spark.createDataFrame(asked, "agent string, rule_id long, reply string"), df, 0.5).collect()}
    want = {}
    for (i, a, b, status, *_), (_, _, reply) in zip(rules, asked, strict=True):
        new = json.loads(reply)["body"]
        like = [k for k, o, c, *_ in rules if o == a and len(grams(new) & grams(c)) > 0.5 * len(grams(new) | grams(c))]
        want[i] = "rule is evicted" if status == "evicted" else "too short to compress" if len(b) // 2 < 10 else "invalid rewrite" if len(new) < 10 else "not within half of the original" if len(new) > len(b) // 2 else f"near-duplicate of rule {min(like)}" if like else None
    assert got == want and any(str(x).startswith("near") for x in want.values()) and None in want.values()
    met = []
    monkeypatch.setattr(similarity, "resembling", lambda new, known, threshold, f=similarity.resembling: met.append(new.count()) or f(new, known, threshold))
    full = df.select("agent", F.col("id").alias("rule_id"), F.to_json(F.struct("body")).alias("reply"))
    assert similarity.compressed_rules(full, df).filter("reason IS NULL").count() == 0 and met == [0]


def test_a_shuffle_is_dealt_without_the_whole_pool(spark):
    """Dealt runs are distinct and fair, a second pass draws from the others, and no step makes a row for each trial and run of the pool."""
    pool = spark.createDataFrame([(f"t{i}", j, 1000 * i + j) for i, n in enumerate((3, 5, 8, 400)) for j in range(n)], "task_id string, row int, tokens int")
    first, extra = (f(pool, 300).collect() for f in (resampling.permutation_trials, resampling.permutation_extra))
    dealt, again = ({(c, t): [r.tokens for r in rows if (r.comparison_id, r.task_id) == (c, t)] for c in range(0, 300, 30) for t in ("t0", "t1", "t2", "t3")} for rows in (first, extra))
    for (c, t), got in dealt.items():
        assert len(set(got)) == len(got) == min(4, {"t0": 3, "t1": 5, "t2": 8, "t3": 400}[t]) and len(again[c, t]) == 2
        assert t in ("t0", "t1") or not set(got) & set(again[c, t])
    each = Counter(r.tokens for r in first if r.task_id == "t2")
    assert len(each) == 8 and max(each.values()) < 200 and min(each.values()) > 100
    plan = resampling.permutation_trials(pool, 300)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in x and "trial" in x for x in plan.split("\n"))


def test_comparison_is_topped_up_once(spark):
    rows = [("c", s, f"t{i}", n, 1000 + 700 * ((i + n) % 3) - 30 * (s == "with"), True, 1) for i in range(3) for s in ("without", "with") for n in range(2)] + [("d", s, f"t{i}", n, 9000 - 5000 * (s == "with"), True, 1) for i in range(2) for s in ("without", "with") for n in range(2)]
    df = measures(spark, rows).withColumns({"cache_read": F.lit(10), "duration_ms": F.lit(500)})
    got = {r.comparison_id: (r.topped_up, r.tokens_spent) for r in inference.run_comparison(df, df.withColumn("run_no", F.col("run_no") + 10)).collect()}
    spent = {k: sum(r[4] + 10 for r in rows if r[0] == k) for k in "cd"}
    assert got == {"c": (True, 2 * spent["c"]), "d": (False, spent["d"])}
