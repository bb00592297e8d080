"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points, mapped through the cumulative targets, name the source of each slot. Slots are ranked per source, and rank r of a
source takes the r-th block of the source's shuffled words, which repeat when the target exceeds the source. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums, stored, unused, word_count

GOLDEN = 0.6180339887498949


def fair_targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, repeat: float = 2.0) -> list[float]:
    """``share`` times all sizes dealt by weight; what exceeds ``repeat`` times a source goes to the others by weight, until none is above."""
    left, full, out = share * sum(sizes), set(), [0.0] * len(sizes)
    while len(full) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in full]
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > repeat * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(repeat * sizes[i])
            left -= out[i]
            full.add(i)
    return out


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeat: int = 2, block_words: int = 4096, most_slots: int = 4_000_000,
    whole: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, most_sources: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """(rows, segments) of the mix.

    rows: a row a row of ``docs``: rid, id, source, size (words; null text has 0), source_size, target, start (words before it in
    its source's shuffled order). segments: rid, id, source, slot, epoch, from_word, words: what each slot takes, in blocks of equal words
    (``block_words``, more where that would take over ``most_slots`` slots); the last block of a source ends at its target.
    With ``whole`` a document isn't cut: a slot takes the documents that start in its block.

    Sources are weighed in order of code point, null last, ``weights`` repeating. The order within a source is a hash of the id, so
    reruns agree; ties of the hash go by id and text hash, and rows that repeat in full are interchangeable. An empty table, or
    one without words, gives targets of 0. Only the totals of sources reach the driver, at most ``most_sources`` of them (more raise).
    """
    spark = docs.sparkSession
    base = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"),
            F.xxhash64(id_col, source_col, text_col).alias("k1"), F.xxhash64(F.lit(seed), F.col(text_col), F.col(source_col), F.col(id_col)).alias("k2"),
        ),
        "mix-sizes",
    )
    totals = base.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in totals]
    targets = fair_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, repeat)
    goal = sum(targets)
    block = max(block_words, int(goal // most_slots) + 1)
    need = [-(-round(t) // block) for t in targets]
    plan = [(i, r["source"], r["words"], t, n, 1 + min(r["rows"] // 1000, 8191)) for i, (r, t, n) in enumerate(zip(totals, targets, need, strict=True))]
    sources = F.broadcast(spark.createDataFrame(plan, "sid int, s_source string, source_size long, target double, need long, parts int"))
    part = F.floor(F.shiftrightunsigned("h", 40) * F.col("parts") / (1 << 24)).cast("int")
    lined = (
        base.join(sources, F.col("source").eqNullSafe(F.col("s_source")))
        .withColumn("part", part)
        .select("sid", "part", F.shiftrightunsigned("h", 1).alias("h"), "id", "k1", "k2", "size", "source", "source_size", "target")
    )
    order = [F.col("part"), F.col("h"), F.col("id").asc_nulls_first(), F.col("k1"), F.col("k2")]
    rows = prefix_sums(lined, ["sid"], "part", order, {"start": "size"}, "nth").select(
        F.struct("sid", "nth").alias("rid"), "id", "source", "size", "source_size", "target", "start", "k1", "k2"
    )
    rows = stored(rows, "mix-rows")

    goal_words = F.round("target").cast("long")
    turns = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("epoch")).select("*", (F.col("start") + F.col("epoch") * F.col("source_size")).alias("a")).filter(F.col("a") < goal_words)
    if whole:
        cut = turns.select("*", F.floor(F.col("a") / block).alias("rank"), F.lit(0).cast("long").alias("from_word"), F.col("size").alias("words"))
    else:
        end = F.least(F.col("a") + F.col("size"), goal_words)
        cut = turns.filter(F.col("size") > 0).select("*", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((end - 1) / block))).alias("rank"))
        lo, hi = F.greatest(F.col("a"), F.col("rank") * block), F.least(end, (F.col("rank") + 1) * block)
        cut = cut.select("*", (lo - F.col("a")).alias("from_word"), (hi - lo).alias("words"))
    slots = schedule(spark, targets, need)
    segments = cut.select("rid", F.col("rid.sid").alias("sid"), "rank", "id", "source", "epoch", "from_word", "words", "k1", "k2").join(slots, ["sid", "rank"]).drop("sid", "rank")
    return rows, segments


def schedule(spark, targets: Sequence[float], need: Sequence[int], chunk: int = 50_000) -> DataFrame:
    """slot, sid, rank: slot i goes to the source under the i-th golden-ratio point.

    Slots that a source has beyond ``need`` are left out, and the few that it lacks come after all others, so every rank under need has
    exactly one slot. Slots are ranked in chunks of their numbers, so no task ranks all slots of a large source.
    """
    total, goal, n, cuts = 0.0, sum(targets), sum(need), []
    for t in targets[:-1]:
        total += t
        cuts.append(total / goal if goal else 0.0)
    # as many stretches of [0, 1) as sources: each knows the edges before it and those inside, one on average, so a slot looks at few
    n_bins = 1 << max(len(targets) - 1, 1).bit_length()
    inner: list[list[float]] = [[] for _ in range(n_bins)]
    for c in cuts:
        inner[min(int(c * n_bins), n_bins - 1)].append(c)
    bins, seen = [], 0
    for k, own in enumerate(inner):
        bins.append((k, seen, own))
        seen += len(own)
    edges = F.broadcast(spark.createDataFrame(bins, "bin int, under int, edges array<double>"))
    point = (F.col("slot") + 0.5) * GOLDEN % 1.0
    named = spark.range(n).select(F.col("id").alias("slot"), point.alias("point")).withColumn("b", F.floor(F.col("point") * n_bins).cast("int")).join(edges, F.col("b") == F.col("bin"))
    named = named.select("slot", (F.col("under") + F.size(F.filter("edges", lambda c: c <= F.col("point")))).alias("sid"), F.floor(F.col("slot") / chunk).alias("chunk"))
    wants = spark.createDataFrame([(i, x) for i, x in enumerate(need)], "w_sid int, need long")
    ranked = prefix_sums(named, ["sid"], "chunk", [F.col("slot")], {}, "rank").join(F.broadcast(wants), F.col("sid") == F.col("w_sid")).filter(F.col("rank") < F.col("need")).select("slot", "sid", "rank")
    # a row a source, like the totals
    had = {r["sid"]: r["had"] for r in named.groupBy("sid").agg(F.count(F.lit(1)).alias("had")).collect()}
    late, at = [], n
    for i, x in enumerate(need):
        if had.get(i, 0) < x:
            late.append((i, had.get(i, 0), x, at))
            at += x - had.get(i, 0)
    lacking = spark.createDataFrame(late, "sid int, had long, need long, at long").select("sid", "had", "at", F.explode(F.sequence("had", F.col("need") - 1)).alias("rank"))
    return ranked.unionByName(lacking.select((F.col("at") + F.col("rank") - F.col("had")).alias("slot"), "sid", "rank"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole, as often as it takes them; columns as in ``docs``, whatever their names.

    A document starts in the block that takes it, so one without words, null or empty, is taken like its neighbours in the shuffled order, and a very long one is never
    cut. A null source is a source of its own, a null id an id like others. Rows that repeat in full share out what the mix takes of them; rows alike but for
    other columns count as such. An empty table gives no rows.
    """
    k1, k2, t1, t2, taken, same_, often = unused(docs, "k1", "k2", "t1", "t2", "takes", "alike", "times")
    names = [how.get(k, d) for k, d in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))]
    seed = how.get("seed", 17)
    rows, segments = mix(docs, whole=True, **how)
    takes = segments.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias(taken))
    alike = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias(same_))
    of = takes.join(alike, ["k1", "k2"]).withColumnsRenamed({"k1": t1, "k2": t2})
    keyed = docs.select("*", F.xxhash64(*names).alias(k1), F.xxhash64(F.lit(seed), F.col(names[2]), F.col(names[1]), F.col(names[0])).alias(k2))
    joined = keyed.join(of, (F.col(k1) == F.col(t1)) & (F.col(k2) == F.col(t2)))
    nth = F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.lit(0)))
    times = F.floor(F.col(taken) / F.col(same_)) + F.when(nth <= F.col(taken) % F.col(same_), 1).otherwise(0)
    copies = joined.select(*docs.columns, times.cast("int").alias(often)).filter(F.col(often) > 0)
    return copies.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(often))).alias(k1)).select(*docs.columns)
