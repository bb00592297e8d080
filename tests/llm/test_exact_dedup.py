import hashlib
import random

from millrace.llm.exact_dedup import exact_dedup

BLANKS = " \t\n\x0b\x0c\r"


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in BLANKS), []).append((-len(t or ""), i is None, i or 0, i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[3]
        out[norm] = (keep, len(members), hashlib.sha256(norm.encode()).hexdigest())
    return out


def check(df, rows, **how):
    got = exact_dedup(df, **how).collect()
    want = expected(rows)
    by_hash = {h: (k, n) for k, n, h in want.values()}
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1} and len(kept) == len(want)


def test_cases(documents):
    rows = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, "  "), (7, "x" * 100_000), (8, "x" * 99_999 + " x"), (9, "é b"), (9, "é b"), (None, "a  b"), (10, "\x85ab")]
    check(documents(rows), rows)


def test_random_against_plain(documents):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 6)))) for i in range(400)]
    check(documents(rows).repartition(7), rows)


def test_hot_group_is_split(documents):
    rows = [(i, "same  text" if i % 2 else "same text") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(100)]
    check(documents(rows).repartition(5), rows, hot_rows=20)


def test_empty_and_clashing_columns(spark, documents):
    assert exact_dedup(documents([])).collect() == []
    df = documents([(1, "a"), (2, "a")]).selectExpr("*", "1 AS sha", "2 AS norm", "3 AS part", "4 AS kept")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup(df).collect()) == [(1, 1, True), (2, 1, False)]
