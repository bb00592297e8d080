import random
import re

import numpy as np

from millrace.llm.near_dedup import components, first_of_groups, least_matches, near_dedup, rest, signatures, sketches
from millrace.llm.shingles import mixed, shingle_sets, slices, word_hashes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def plain(rows, width, percent=80):
    sets = [(i, plain_set(t, width)) for i, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            n = len(x & y)
            if x and y and 100 * n >= percent * (len(x) + len(y) - n):
                up[root(a)] = root(b)
    groups = {}
    for a in range(len(sets)):
        groups.setdefault(root(a), []).append(a)
    return {a: (len(sets[a][1]), min(sets[m][0] for m in g)) for g in groups.values() for a in g}


def check(documents, rows, width=4):
    want = sorted((rows[a][0], *v) for a, v in plain(rows, width).items())
    got = near_dedup(documents(rows), width=width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def text(rng, n):
    return [f"w{rng.randint(0, 3000)}" for _ in range(n)]


def test_against_all_pairs(documents):
    rng = random.Random(7)
    rows = [(i, " ".join(text(rng, rng.randint(1, 60)))) for i in range(60)]
    for g in range(6):
        base = text(rng, 120)
        for k in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 99)}"
            rows.append((100 + 20 * g + k, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "one"), (906, "a b c d"), (907, "a b c d"), (100, rows[60][1]), (950, "é É é É é"), (951, "É É é É é")]
    rng.shuffle(rows)
    check(documents, rows)


def test_group_around_the_threshold(documents):
    # copies whose similarities lie on both sides of 0.8, so that few links hold the group
    rng = random.Random(8)
    base = text(rng, 150)
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(5):
            w[rng.randrange(len(w))] = f"y{rng.randint(0, 9999)}"
        rows.append((k, " ".join(w)))
    check(documents, rows)


def test_block_over_several_batches(spark, documents):
    # one bucket of pairs of near copies, of which no link is known; each row comes in a batch of its own
    rng = random.Random(12)
    rows = []
    for k in range(30):
        w = text(rng, 60)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, "more"]))]
    docs = documents(rows)
    nodes = sketches(docs, "doc_id", "text", 4, 128, 4).localCheckpoint()
    ids = {r.row: r.id for r in nodes.collect()}
    members = nodes.selectExpr("CAST(0 AS long) AS key", "row")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(batch)
    spark.conf.set(batch, "1")
    try:
        found = rest(members, spark.createDataFrame([], "node long, root long"), nodes, docs, least_matches(0.8, 1e-6, 128), 4, "doc_id", "text", 4, 80).collect()
    finally:
        spark.conf.set(batch, old)
    assert sorted(sorted((ids[r.hub], ids[r.row])) for r in found) == [[2 * k, 2 * k + 1] for k in range(30)]


def test_empty_nulls_and_clashes(documents):
    assert near_dedup(documents([])).collect() == []
    got = near_dedup(documents([(None, "a b c d e f"), (3, "a b c d e f"), (None, "lonely")]).selectExpr("*", "1 AS row", "2 AS sig", "3 AS n"), width=4).collect()
    assert sorted((r.component_id or 0) for r in got) == [0, 3, 3]
    kept = first_of_groups(documents([(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (1, "a b c d e f")])).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]


def test_first_of_groups_by_row(documents):
    rng = random.Random(14)
    one, two, three, four, five = (" ".join(text(rng, 40)) for _ in range(5))
    rows = [(None, one), (None, two), (None, two + " more"), (7, three), (7, four), (7, four), (8, four + " more"), (None, three), (9, five), (9, five + " more"), (None, ""), (None, ""), (5, ""), (5, "")]
    kept = [(r.doc_id, plain_set(r.text, 5) & plain_set(" ".join((one, two, three, four, five)), 5)) for r in first_of_groups(documents(rows)).collect()]
    want = [(None, one), (None, two), (7, three), (7, four), (9, five), (None, ""), (None, ""), (5, "")]
    assert sorted(map(str, ((i, sorted(s)) for i, s in kept))) == sorted(map(str, ((i, sorted(plain_set(t, 5))) for i, t in want)))


def test_words_and_long_texts():
    rng = random.Random(9)
    texts = ["", "a", " a  B\x0bc\x1fd é ", "x" * 3_000_000 + " end", " ".join(text(rng, 500))]
    for t in texts:
        (_, bodies), *more = slices([t])
        assert not more
        h, of = word_hashes(bodies)
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        assert len(h) == len(w) and len(set(h.tolist())) == len(set(w)) and not of.any()
        assert len(shingle_sets(bodies, 4)[0]) == len(plain_set(t, 4))


def test_signatures_estimate():
    a, b = mixed(np.arange(1000, dtype=np.uint64)), mixed(np.arange(200, 1200, dtype=np.uint64))
    x, y = signatures([a, b], 512)
    assert abs((x == y).mean() - 800 / 1200) < 0.08
    bounds = least_matches(0.8, 1e-6, 128)
    assert list(bounds) == [32, 64, 96, 128] and bounds[32] < 0.8 * 32 and bounds[128] < 0.8 * 128


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got.get(n, n) == min(seen)


def test_text_ids_and_clashing_columns(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [("b", long), ("a", long), ("c", "something else entirely is written here today"), (None, long), ("d", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS row", "2 AS n", "3 AS __row", "4 AS each", "5 AS key")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup(df).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), None: ("a", False), "c": ("c", True), "d": ("d", True)}
    kept = first_of_groups(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == ["a", "c", "d"]
