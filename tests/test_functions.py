import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions import text as X


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_rounding_is_half_up(spark):
    assert column(spark, [-2.5, -0.5, 0.5, 2.5, 2.4], "double", S.half_up) == [-2, 0, 1, 3, 2]


def test_tokens(spark):
    assert column(spark, ["", "a", "abcd", "abcde", None, "a😀"], "string", S.estimate_tokens) == [0, 1, 1, 2, None, 1]
    assert column(spark, [0, 1, 2, 6, 10], "long", S.chars_to_tokens) == [0, 0, 1, 2, 3]


def test_parameters():
    assert [S.sessions_per_week(x) for x in ("5", "0", "-1", "x", None, "inf")] == [5.0, 20.0, 20.0, 20.0, 20.0, 20.0]
    assert [S.confidence_z(x) for x in ("1", "0.9", "3", None, "nan")] == [1.0, 2.0, 3.0, 2.0, 2.0]


def test_percent_change(spark):
    df = spark.createDataFrame([(110, 100), (90, 100), (100, 100), (1, 0), (None, 5)], "c long, b long")
    assert [r.x for r in df.select(S.percent_change("c", "b").alias("x")).collect()][:4] == ["+10.0%", "-10.0%", "0.0%", "n/a"]


def test_verdict(spark):
    df = spark.createDataFrame([(None, 10), (0, 10), (21, 10), (22, 10)], "d long, c long")
    assert [r.x for r in df.select(S.verdict("d", "c").alias("x")).collect()] == ["evicted", "evicted", "evicted", "active"]


def test_normal_cdf(spark):
    got = column(spark, [-3.0, -1.0, 0.0, 0.5, 2.0], "double", S.normal_cdf)
    assert got == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in (-3.0, -1.0, 0.0, 0.5, 2.0)], abs=2e-7)


def test_wilson(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (0, 0)], "k long, n long").select(S.wilson("k", "n").alias("w")).collect()
    assert df[0].w.low == 0 and df[2].w.high == 1 and df[1].w.low == pytest.approx(0.2366, abs=1e-4) and df[1].w.high == pytest.approx(0.7634, abs=1e-4)
    assert df[3].w.low in (None, 0.0)


def test_nearest_rank_and_median(spark):
    lists = [[1, 2, 3, 4, 5], [7], [], [4, 1, 3, 2]]
    assert column(spark, lists, "array<long>", lambda v: S.nearest_rank(v, 0.75)) == [4, 7, None, 3]
    assert column(spark, lists, "array<long>", S.array_median) == [3.0, 7.0, None, 2.5]


def test_classify_tool(spark):
    df = spark.createDataFrame([("Skill", "pdf"), ("Skill", None), ("mcp__a__b__c", None), ("mcp__a", None), ("Read", None), ("", None)], "n string, s string")
    got = [tuple(r.c) for r in df.select(S.classify_tool("n", "s").alias("c")).collect()]
    assert got == [("skill", "(skills)", "pdf"), ("skill", "(skills)", "(unknown)"), ("mcp", "a", "b__c"), ("mcp", "a", "(unknown)"), ("builtin", "(builtin)", "Read"), ("builtin", "(builtin)", "")]


def test_verdict_reasons(spark):
    df = spark.createDataFrame([(None, 10, False), (0, 10, False), (21, 10, False), (22, 10, False), (99, 10, True)], "d long, c long, r boolean")
    assert [r.x for r in df.select(S.verdict_reason("d", "c", "r").alias("x")).collect()] == [
        "no comparable completed runs", "non-positive delta (0)", "sub-threshold: savings 21 < 2× cache-aware rent (22)", "savings 22 ≥ 2× cache-aware rent (22)", "regression: a previously passing golden task failed"
    ]


def test_report_formats(spark):
    df = spark.createDataFrame([(110, 100), (95, 100), (100, 100), (0, 100), (5, 0)], "c long, b long")
    assert [r.x for r in df.select(S.percent_of("c", "b").alias("x")).collect()] == ["+10.0%", "-5.0%", "+0.0%", "n/a", "n/a"]
    assert column(spark, [12_345, 0], "long", S.duration) == ["12.3s", "0.0s"]


def test_prices(spark):
    df = spark.createDataFrame([("opus", 1_000_000, 0, 0, 0), ("x", 0, 1_000_000, 0, 0), (None, 0, 0, 1_000_000, 1_000_000), ("haiku", 0, 0, 0, 0)], "model string, input_tokens long, output_tokens long, cache_creation long, cache_read long")
    got = df.select(S.dollars_for("model").alias("d"), S.blended_rate("model").alias("r")).collect()
    assert [r.d for r in got] == pytest.approx([5, 15, 3.75 + 0.3, 0]) and got[3].r == pytest.approx(1e-6)


# text


def test_tokenize(spark):
    assert column(spark, ["Net 1,204.5 in 10-K, 2024-Q3.", "$ % -- 5% $9.", "", "ünï"], "string", X.tokenize) == [["net", "1,204.5", "in", "10-k", "2024-q3"], ["5%", "$9"], [], ["n"]]


def test_trigrams(spark):
    assert column(spark, ["ab", ""], "string", X.trigrams) == [["  a", " ab", "ab "], ["   "]]
    df = spark.createDataFrame([("run the tests", "Run the tests!"), ("abc", "xyz"), ("", "")], "a string, b string")
    got = [r.s for r in df.select(X.similarity("a", "b").alias("s")).collect()]
    assert got[0] == 1.0 and got[1] < 0.2 and got[2] == 1.0


def test_html(spark):
    h = "<p>A&amp;B<br/>c</p><script>x<y</script><STYLE a>q</STYLE><div>d  &lt;e</div>\n\n\n\nf"
    assert column(spark, [h, ""], "string", X.html_to_text) == ["A&B\nc\n d <e\n\nf", ""]


def test_csv(spark):
    c = 'name,note\r\na,"x, ""y"""\nb\n'
    assert column(spark, [c, "a,b", ""], "string", X.csv_to_text) == ['name: a, note: x, "y"\nname: b, note: ', "a | b", ""]


def test_display(spark):
    assert column(spark, ["a\x1b[31mb\x07c​d", "x" * 400, "  a \n b "], "string", X.display_text) == ["a b cd", "x" * 299 + "…", "a b"]


def test_redact(spark):
    t = ["key sk-ant-" + "a1" * 10, "ghp_" + "x" * 20 + " /home/jo/x", "mail a.b@c.org now", "DB_PASSWORD=hunter2hunter2 ok", "Bearer " + "z" * 20]
    assert column(spark, t, "string", X.redact) == ["key [REDACTED]", "[REDACTED] ~/x", "mail [EMAIL] now", "[REDACTED] ok", "[REDACTED]"]
    long = "a " * 292 + "token=" + "s" * 40
    assert "sss" not in column(spark, [long], "string", X.draft_prompt)[0]


def test_contradiction_words(spark):
    assert column(spark, ["Never use the Full suite, don't!"], "string", X.content_words) == [["full", "suite"]]
    assert column(spark, ["never run", "run it", None], "string", X.is_negated) == [True, False, None]
    assert column(spark, ["- a one. B two!\n\n2) c\r\n> # -- d", "# 1. "], "string", X.directive_lines) == [["a one.", "B two!", "c", "d"], []]


def test_values(spark):
    cases = [(1204.5, "was $1,204.5 then", True), (20.4, "120.45", False), (-500.0, "(500) loss", True), (-500.0, "500 loss", False), (500.0, "(500)", True), (1.2, "1.20 up", True), (1_500_000.0, "1.5 million", True), (0.0, "is 0 now", True), (0.0, "10", False), (7.0, None, False), (5.0, "5.03", True), (1204.5, "1.20 bn in 1.205", True), (1204.5, "v1.204.5", True), (1204.5, "0.1204.5", False), (0.25, "0.25", True), (0.25, ".25", False), (2.5, "3", True),
             (2500.0, "2.500", True), (-1.5, "-1.5 and", True), (-1.5, "1.5 - 1.50", True), (1e6, "1000000", True), (1e6, "1,000,000.0", True), (3.0, "v3.", True)]
    df = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(cases)], "i int, v double, t string")
    assert [r.x for r in df.select("i", X.value_appears_in("v", "t").alias("x")).orderBy("i").collect()] == [c[2] for c in cases]


def test_failures_and_fences(spark):
    df = spark.createDataFrame([(1, "HTTP 429"), (1, ""), (0, ""), (1, "syntax error"), (1, None)], "s int, e string")
    assert [r.x for r in df.select(X.classify_failure("s", "e").alias("x")).collect()] == [True, True, False, False, True]
    assert column(spark, ["```json\n{}\n```", "{}"], "string", X.strip_fence) == ["{}", "{}"]
    assert column(spark, ["a good rule body", "short", "bad\x07rule body", "x" * 201], "string", X.valid_rule_body) == [True, False, False, False]


def test_replies(spark):
    good, two = '{"body": "a good rule body"}', '[{"body":"a good rule body"},{"body":"another good one"}]'
    assert column(spark, [two, f"```json\n{two}\n```", '[{"body":"short"}]', "x", "[]"], "string", X.parsed_rules) == [["a good rule body", "another good one"]] * 2 + [None, None, []]
    assert column(spark, [good, "{}", "nope"], "string", X.parsed_rewrite) == ["a good rule body", None, None]
    assert [tuple(r) for r in column(spark, ['{"done":true}', '{"search":" q "}', '{"search":" "}', "x"], "string", X.parsed_plan)] == [("answer", None), ("search", " q "), ("invalid", None), ("invalid", None)]
    assert column(spark, ["ok", "-p", "a\nb", "x" * 8001], "string", X.safe_prompt) == [True, False, False, False]
    assert column(spark, ["x" * 19, "x" * 20], "string", X.too_short_to_compress) == [True, False]
    df = spark.createDataFrame([("a", 3, "mail x@y.org", "s1")], "a string, i int, p string, s string")
    assert 'id: "a-draft-03"' in (t := df.select(X.draft_file("a", "i", "p", "s").alias("t")).first().t) and "[EMAIL]" in t
