import random

from millrace.llm.sharding import shard, splitters


def test_balance_slots_and_groups(documents):
    rng = random.Random(1)
    rows = [(i, "w" * rng.randint(0, 300)) for i in range(2000)] + [(5000 + i, "hot text " * 20) for i in range(1000)] + [(None, None), (9000, "")]
    got = shard(documents(rows), shards=8, part_bytes=20_000).collect()
    assert len(got) == len(rows)
    sizes, slots, homes = [0] * 8, {}, {}
    for r in got:
        assert r.size == len((r.text or "").encode()) + 8
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(r.text, set()).add(r.shard)
    mean = sum(sizes) / 8
    assert max(sizes) - min(sizes) <= 0.002 * mean + 2 * 310
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # texts stay together unless a boundary runs through them
    assert sum(len(h) > 1 for t, h in homes.items() if t and len(t) > 3) <= 7


def test_splitters_count_exactly(spark):
    rng = random.Random(2)
    rows = [(rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(1, 9)) for _ in range(3000)]
    total = sum(s for _, s in rows)
    targets = [total * j / 5 for j in range(1, 5)]
    cuts = splitters(spark.createDataFrame(rows, "key long, size long"), targets, [0.0] * 4, probes=4, first=8)
    for c, t in zip(cuts, targets, strict=True):
        assert abs(sum(s for k, s in rows if k < c) - t) <= 9


def test_repeats_empty_and_clashes(documents):
    assert shard(documents([])).collect() == []
    df = documents([(1, "a")] * 5 + [(2, "b")]).selectExpr("*", "7 AS slot", "'x' AS shard", "1 AS key", "2 AS __key", "3 AS part", "4 AS __p", "5 AS first", "6 AS row")
    got = shard(df, shards=3).collect()
    assert len(got) == 6 and all(r.key == 1 for r in got)
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_a_very_long_text(documents):
    got = {r.doc_id: r.size for r in shard(documents([(1, "é" * 1_500_000), (2, "b"), (3, None)]), shards=2).collect()}
    assert got == {1: 3_000_008, 2: 9, 3: 8}
