"""Sharding by histogram sort.

Exact bytes below candidate key boundaries are counted across partitions, the candidates around each target are refined until every
splitter meets its tolerance, and the rows are exchanged once.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def below(bounds: list[int]):
    """Column function: how many of the sorted ``bounds`` are at most the key."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    return place


def splitters(keys: DataFrame, targets: list[float], within: list[float], probes: int = 32, first: int = 4096, rounds: int = 40) -> list[int]:
    """Keys k so that the bytes of rows with a key under k are near each target.

    ``keys``: rows (key long, size long). Each round counts the bytes between probes exactly, in one pass that brings a row a bin to
    the driver; there are at most max(``first``, ``probes`` * targets) bins. A splitter whose bytes are within its tolerance is done, as is
    one with no key left to try.
    """
    spots = {j: (LOW, HIGH, 0.0, None) for j in range(len(targets))}
    found: dict[int, int] = {}
    tries = sorted({LOW + (i + 1) * ((1 << 64) // first) for i in range(first - 1)})
    for _ in range(rounds):
        if len(found) == len(targets):
            break
        counts = keys.groupBy(below(tries)("key").alias("bin")).agg(F.sum("size").alias("b")).toArrow()
        sums = np.zeros(len(tries) + 1, dtype=np.int64)
        sums[counts["bin"].to_numpy()] = counts["b"].to_numpy()
        under = np.concatenate([[0], np.cumsum(sums)])  # under[i + 1]: bytes below tries[i]
        asked: set[int] = set()
        for j, target in enumerate(targets):
            if j in found:
                continue
            lo, hi, at_lo, at_hi = spots[j]
            i, end = bisect.bisect_right(tries, lo), bisect.bisect_left(tries, hi)
            near = [(lo, at_lo)] + [(tries[x], float(under[x + 1])) for x in range(i, end)] + ([(hi, at_hi)] if at_hi is not None else [(HIGH, float(under[-1]))])
            k = max(x for x, (_, b) in enumerate(near) if b <= target or x == 0)
            k = min(k, len(near) - 2)
            (lo, at_lo), (hi, at_hi) = near[k], near[k + 1]
            key, err = min(((lo, abs(at_lo - target)), (hi, abs(at_hi - target))), key=lambda x: x[1])
            if err <= within[j] or hi - lo <= 1:
                found[j] = key
                continue
            spots[j] = (lo, hi, at_lo, at_hi)
            step = max(1, (hi - lo) // (probes + 1))
            asked |= set(range(lo + step, hi, step))
        tries = sorted(asked)
    return [found.get(j, spots[j][0]) for j in range(len(targets))]


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 64 << 20, most_parts: int = 4096) -> DataFrame:
    """The columns of ``docs``, then size, shard and slot: shards of nearly equal bytes.

    Law: bytes. A row counts the UTF-8 bytes of its text (null: none) plus 8. The key is 40 bits of the text's hash over 24 bits of the
    id's hash, so equal texts lie side by side and share a shard unless a boundary must run through their group, and even one text that
    all rows share can be split. Each shard's bytes are within ``tolerance`` of the mean at either end, or as near as whole rows allow.
    slot numbers a shard's rows from 0 without gaps, in key order. Rows that repeat in full get slots of their own. Null ids and texts
    are hashed like other values. An empty table gives no rows. Existing columns called size, shard or slot are replaced.

    The rows of a shard are sorted in parts of about ``part_bytes``, at most ``most_parts`` a shard.
    """
    at = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 24), 24).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 40))
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")
    keys = stored(docs.select(at.alias("key"), size.alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = max(1, min(most_parts, -(-total // (shards * part_bytes))))
    n = shards * per
    cuts = splitters(keys, [total * j / n for j in range(1, n)], [total / shards * tolerance if j % per == 0 else total / n / 4 for j in range(1, n)]) if total else [HIGH] * (n - 1)
    cuts = np.maximum.accumulate(np.array(cuts, dtype=np.int64)).tolist()
    rows = dict.fromkeys(range(n), 0)
    rows |= {r["part"]: r["n"] for r in keys.groupBy(below(cuts)("key").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [(p, sum(rows[q] for q in range(p - p % per, p))) for p in range(n)]
    key, part, p, first, row = unused(docs, "key", "part", "p", "first", "row")
    firsts = F.broadcast(docs.sparkSession.createDataFrame(starts, f"`{p}` int, `{first}` long"))
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    placed = docs.select(*kept, size.alias("size"), at.alias(key)).withColumn(part, below(cuts)(key))
    order = Window.partitionBy(part).orderBy(key, F.col(id_col).asc_nulls_first(), F.xxhash64(F.col(text_col)))
    return (
        placed.withColumn(row, F.row_number().over(order) - 1)
        .join(firsts, F.col(part) == F.col(p))
        .select(*kept, "size", F.floor(F.col(part) / per).cast("int").alias("shard"), (F.col(first) + F.col(row)).cast("long").alias("slot"))
    )
