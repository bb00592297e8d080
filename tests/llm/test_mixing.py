import bisect
import itertools
import math
import random
import re

import pytest

from millrace.llm.mixing import fair_targets, mix, mixed_documents, schedule


def plain_targets(sizes, weights):
    share, fixed = 1.5 * sum(sizes), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        if not open_:
            return [fixed[i] for i in range(len(sizes))]
        unit = (share - sum(fixed.values())) / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > 2 * sizes[i]]
        if not over:
            return [fixed.get(i, weights[i] * unit) for i in range(len(sizes))]
        fixed |= {i: 2 * sizes[i] for i in over}


def test_targets():
    for sizes in ([10, 10, 10], [1, 100, 50, 3], [0, 5], [7]):
        w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        assert fair_targets(sizes, w) == pytest.approx(plain_targets(sizes, w))


def corpus():
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["b", "a", "c", None, "é"])) for i in range(600)]
    return rows + [(700, None, "en", "a"), (701, "", "en", "a"), (702, "x " * 4000, "en", "b"), (1, "again", "en", "a"), (1, "again", "en", "a")]


def test_taken_words(documents):
    rows = corpus()
    r, segments = mix(documents(rows), block_words=64)
    r, segments = r.collect(), segments.collect()
    assert len(r) == len(rows)
    by_source = {}
    for _, t, _, s in rows:
        by_source[s] = by_source.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, plain_targets([by_source[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    taken, size = {}, {x.rid: x.size for x in r}
    per_source = dict.fromkeys(order, 0)
    for x in segments:
        taken[x.rid] = taken.get(x.rid, 0) + x.words
        per_source[x.source] += x.words
        assert 0 <= x.from_word and x.from_word + x.words <= size[x.rid] and x.words > 0
    for x in r:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == by_source[x.source]
        assert taken.get(x.rid, 0) <= 2 * x.size
    for s in order:
        assert abs(per_source[s] - want[s]) <= 1
    # every slot takes one source and at most a block
    slots = {}
    for x in segments:
        slots.setdefault(x.slot, []).append(x)
    assert all(len({y.source for y in v}) == 1 and sum(y.words for y in v) <= 64 for v in slots.values())


def test_reruns_agree_and_partitions_do_not_matter(documents):
    rows = corpus()
    key = lambda df: sorted((str(x.id), x.slot, x.epoch, x.from_word, x.words) for x in df.collect())
    assert key(mix(documents(rows), block_words=64)[1]) == key(mix(documents(rows).repartition(9), block_words=64)[1])


def test_schedule_ranks(spark):
    got = schedule(spark, [30.0, 10.0, 20.0], [30, 10, 20], chunk=7).collect()
    assert sorted((x.sid, x.rank) for x in got) == [(s, r) for s, n in ((0, 30), (1, 10), (2, 20)) for r in range(n)]
    first = [x.sid for x in sorted(got, key=lambda x: x.slot)][:12]
    assert 5 <= first.count(0) <= 7 and 1 <= first.count(1) <= 3


def test_schedule_of_many_sources(spark):
    """Many sources, most of them tiny, get the slots that a plain search finds."""
    rng = random.Random(5)
    targets = [rng.choice([0.0, 0.01, 1.0, 40.0]) for _ in range(700)]
    need = [math.ceil(t) for t in targets]
    got = {(x.sid, x.rank): x.slot for x in schedule(spark, targets, need, chunk=50).collect()}
    edges = list(itertools.accumulate(targets[:-1]))
    of = [bisect.bisect_right([e / sum(targets) for e in edges], (i + 0.5) * 0.6180339887498949 % 1.0) for i in range(sum(need))]
    want, seen = {}, [0] * len(need)
    for slot, s in enumerate(of):
        if seen[s] < need[s]:
            want[s, seen[s]] = slot
            seen[s] += 1
    assert {k: v for k, v in got.items() if v < len(of)} == want
    late = sorted(v for v in got.values() if v >= len(of))
    assert late == list(range(len(of), len(of) + sum(need) - len(want))) and set(got) == {(s, r) for s, n in enumerate(need) for r in range(n)}


def test_clashing_columns_and_very_long_texts(documents):
    rows = [(1, "w " * 400_000, "en", "a"), (2, "x", "en", "a"), (3, None, "en", None)]
    df = documents(rows).selectExpr("*", "1 AS __times", "2 AS times", "3 AS K1", "4 AS __k1", "5 AS rank", "6 AS sid")
    got = mixed_documents(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} >= {1}
    r, segments = mix(df)
    assert r.count() == 3 and segments.agg({"words": "sum"}).first()[0] == 600_002


def test_whole_documents(documents):
    rows = corpus()
    got = mixed_documents(documents(rows), block_words=64).collect()
    times = {}
    for x in got:
        times[x.doc_id, x.text] = times.get((x.doc_id, x.text), 0) + 1
    assert set(times) <= {(r[0], r[1]) for r in rows}
    assert all(n <= (4 if k == (1, "again") else 2) for k, n in times.items())


def test_empty(documents):
    r, s = mix(documents([]))
    assert r.collect() == [] and s.collect() == [] and mixed_documents(documents([])).collect() == []
    r, s = mix(documents([(1, None), (2, "")]))
    assert len(r.collect()) == 2 and s.collect() == []
