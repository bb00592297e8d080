"""Near-duplicate detection: banded MinHash, sequential Bayesian pruning, exact verification.

Documents with the same shingle set are one node. Nodes that share a band of their signatures are candidates. Signatures of a candidate
pair are compared batch by batch; the pair is dropped once the posterior probability that it reaches the threshold, from a uniform
prior and the matches so far, is below the chosen miss probability. Survivors are verified on the full shingle sets.

No group is paired with itself in full. First each member of a bucket meets the bucket's hub. What the links found so far join needs no
further pair, so second, in buckets that still hold several components, members outside the largest one meet all members of other
components, in blocks that stay in arrays until the bounds have spoken.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, unused
from .shingles import mixed, shingle_sets, slices

BATCH = 32
BLOCK = 256


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    return mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1), mixed(np.arange(1 << 20, (1 << 20) + n, dtype=np.uint64))


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """A row of ``hashes`` minima for each set, 16 bits of each; an empty set has the largest value throughout."""
    out = np.full((len(sets), hashes), 0xFFFF, dtype=np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        all_, starts = np.concatenate([sets[i] for i in full]), np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
        work = np.empty_like(all_)
        for k, (a, b) in enumerate(zip(*coefficients(hashes), strict=True)):
            np.multiply(all_, a, out=work)
            work += b
            out[full, k] = (np.minimum.reduceat(work, starts) >> np.uint64(32)).astype(np.uint16)
    return out


def least_matches(similarity: float, miss: float, hashes: int) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches at which P(similarity reached | matches) is at least ``miss``.

    With a uniform prior that posterior is the chance of at most m successes in n + 1 trials.
    """
    out = {}
    for n in range(BATCH, hashes + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out[n] = m
    return out


def survivors(a: np.ndarray, b: np.ndarray, bounds: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures (row by row), the numbers of those that no bound drops, and their matches.

    Signatures hold 16 bits a hash. Those of different minima may agree by chance, which can only spare a pair.
    """
    left, got = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for n, least in bounds.items():
        got = got + (a[left, n - BATCH : n] == b[left, n - BATCH : n]).sum(axis=1)
        stay = got >= least
        left, got = left[stay], got[stay]
    return left, got


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of each signature; its lowest byte numbers the band."""
    n, hashes = sig.shape
    bands = hashes // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for c in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, c : bands * rows : rows].astype(np.uint64))
    return (key & ~np.uint64(255)) | np.arange(bands, dtype=np.uint64)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, hashes: int, rows: int) -> DataFrame:
    """id, row (key of id and text), n, d1, d2 (digest of the set), sig (16 bits a hash), keys (one a band)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column("text"), 0
            while at < len(texts):
                # a part of the batch at a time, so that Python holds few texts
                part = texts.slice(at, 256).to_pylist()
                for first, bodies in slices(part):
                    sets = shingle_sets(bodies, width)
                    sig = signatures(sets, hashes)
                    keys = band_keys(sig, rows).view(np.int64)
                    here = slice(at + first, at + first + len(bodies))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id")[here],
                            batch.column("row")[here],
                            pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([int(np.sum(s, dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                            pa.array([int(np.sum(mixed(s), dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                            pa.array([x.tobytes() for x in sig], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel())),
                        ],
                        names=["id", "row", "n", "d1", "d2", "sig", "keys"],
                    )
                at += len(part)

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return source.mapInArrow(work, f"id {source.schema['id'].dataType.simpleString()}, row long, n long, d1 long, d2 long, sig binary, keys array<long>")


def sigs_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype=np.uint16).reshape(len(batch), -1)


def pruned(pairs: DataFrame, nodes: DataFrame, bounds: dict[int, int]) -> DataFrame:
    """The pairs (hub, row) that the bounds on their signatures leave, and their matches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                left, got = survivors(sigs_of(batch, "sig_a"), sigs_of(batch, "sig_b"), bounds)
                kept = batch.select(["hub", "row"]).take(pa.array(left))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(got, pa.int64())], names=["hub", "row", "got"])

    sigs = nodes.select("row", "sig")
    both = pairs.join(sigs.withColumnRenamed("sig", "sig_b"), "row").join(sigs.select(F.col("row").alias("hub"), F.col("sig").alias("sig_a")), "hub")
    return both.select("hub", "row", "sig_a", "sig_b").mapInArrow(work, "hub long, row long, got long")


def texts_of(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, most_bits: int = 1 << 26) -> DataFrame:
    """row, text for the rows named (row).

    A bitmap of the hashes asked for (8 bits for each, at most ``most_bits`` in all, 8 MB) drops most other texts where they are read; the
    semi-join that follows is exact, so beyond that size only more texts move.
    """
    rows = rows.distinct()
    n = rows.count()
    bits = min(most_bits, max(1 << 10, 1 << (8 * n).bit_length()))
    slot = F.pmod("row", F.lit(bits))
    words = rows.select(F.shiftright(slot, 5).alias("w"), F.pow(F.lit(2.0), slot % 32).cast("long").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap = np.zeros(bits // 32, dtype=np.uint32)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf(T.BooleanType())
    def asked(row: pd.Series) -> pd.Series:
        at = row.to_numpy() % bits
        return pd.Series((held.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    texts = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text")).filter(asked("row"))
    return texts.join(rows, "row", "left_semi").dropDuplicates(["row"])


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs (hub, row) whose full shingle sets reach the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub_set = None, None
        for batch in batches:
            hubs, found = batch.column("hub").to_pylist(), []
            for at in range(0, len(batch), 64):
                sets = [s for _, bodies in slices(batch.column("text").slice(at, 64).to_pylist()) for s in shingle_sets(bodies, width)]
                for i, own in enumerate(sets, at):
                    if hubs[i] != last:  # rows come sorted by hub
                        last, hub_set = hubs[i], shingle_sets([(batch.column("hub_text")[i].as_py() or "").encode("utf-8", "surrogatepass")], width)[0]
                    if reaches(hub_set, own, percent):
                        found.append(i)
            yield batch.select(["hub", "row"]).take(pa.array(found, pa.int64()))

    pairs = pairs.select("hub", "row")
    texts = stored(texts_of(docs, pairs.select("row").union(pairs.select(F.col("hub").alias("row"))), id_col, text_col), "near-texts")
    both = pairs.join(texts, "row").join(texts.select(F.col("row").alias("hub"), F.col("text").alias("hub_text")), "hub")
    return both.select("hub", "row", "text", "hub_text").mapInArrow(work, "hub long, row long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (smallest node reachable) for the nodes of ``links`` (a, b): alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-edges")
    seen = None
    for _ in range(rounds):
        sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select("u", F.col("m").alias("v")).union(near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = stored(small, "near-edges")
        mark = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rest(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, bounds: dict[int, int], rows: int, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Links (hub, row) across components within buckets.

    Members outside a bucket's largest component are dealt into blocks of about BLOCK; each block meets all members of the bucket. Pairs that the bounds leave are verified on full sets where they meet, the nearest by
    signature first, and are passed over once links have joined their components. A task holds one block and, piece by piece,
    those it meets, so no pair is ever a row and no bucket has to fit a task.
    """
    told = members.join(labels, F.col("row") == F.col("node"), "left").select("key", "row", F.coalesce("root", "row").alias("root"))
    told = stored(told, "near-told")
    parts = told.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    buckets = (
        parts.groupBy("key")
        .agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("several"))
        .filter("several > 1 AND all > 2")
        .select("key", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("blocks"))
    )
    in_open = told.join(buckets, "key")
    own = F.when(F.col("root") != F.col("top"), F.pmod(F.xxhash64("row", "key"), F.col("blocks")).cast("int"))
    dealt = in_open.select("key", "row", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(nodes.select("row", "sig"), "row")
    dealt = stored(dealt.select("key", "block", "row", "root", F.coalesce(F.col("own") == F.col("block"), F.lit(False)).alias("here"), "own", "sig"), "near-dealt")

    def near_pairs(batch: pa.RecordBatch, state: dict) -> Iterator[tuple[np.ndarray, list]]:
        """(pairs: matches, number held, number in the batch, nearest first; what is held) for each stretch of one block.

        Rows come by bucket and block, those of the block first and by key; only these are held. So of two in the block the larger
        comes in the same batch or a later one, and meets the smaller there.
        """
        sig = sigs_of(batch, "sig")
        key, block, row, root = (batch.column(c).to_numpy() for c in ("key", "block", "row", "root"))
        here, own = batch.column("here").to_numpy(zero_copy_only=False), batch.column("own").fill_null(-1).to_numpy()
        turn = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        for s, e in zip([0, *turn], [*turn, len(batch)], strict=True):
            if state.get("now") != (key[s], block[s]):
                state["now"], state["held"] = (key[s], block[s]), []
            held = state["held"]
            held += [{"row": row[i], "root": int(root[i]), "sig": sig[i], "batch": batch, "at": int(i)} for i in np.flatnonzero(here[s:e]) + s]
            lead, near = int(key[s] & 255) * rows, []
            for h, x in enumerate(held):
                # a pair within the block, or between two blocks, is met once
                at = s + np.flatnonzero((root[s:e] != x["root"]) & ((own[s:e] < 0) | (own[s:e] > block[s]) | (here[s:e] & (row[s:e] > x["row"]))))
                if lead and len(at):
                    # nor again after the first band that the two share
                    at = at[~(sig[at, :lead] == x["sig"][:lead]).reshape(len(at), -1, rows).all(axis=2).any(axis=1)]
                if len(at):
                    left, got = survivors(np.broadcast_to(x["sig"], (len(at), sig.shape[1])), sig[at], bounds)
                    near.append(np.stack([got, np.full(len(left), h), at[left]]))
            if near:
                pairs = np.concatenate(near, axis=1)
                yield pairs[:, np.argsort(-pairs[0], kind="stable")], held

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            if len(batch):
                row, met = batch.column("row").to_numpy(), []
                for pairs, held in near_pairs(batch, state):
                    name = state["now"]
                    met += [(*name, row[i]) for i in np.unique(pairs[2])] + [(*name, held[h]["row"]) for h in np.unique(pairs[1])]
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in met], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["key", "block", "row"])

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition("key", "block").sortWithinPartitions("key", "block", F.col("here").desc(), "row")

    # texts move for rows only that some pair still needs
    met = by_block(dealt).mapInArrow(mark, "key long, block int, row long").distinct()
    dealt = stored(dealt.join(met, ["key", "block", "row"], "left_semi"), "near-dealt")
    full = dealt.join(texts_of(docs, dealt.select("row"), id_col, text_col), "row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        joined: dict[int, int] = {}

        def root_of(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        def sets_of(texts: list[str | None]) -> list[np.ndarray]:
            return [x for _, bodies in slices(texts) for x in shingle_sets(bodies, width)]

        for batch in batches:
            if not len(batch):
                continue
            row, root, text, found = batch.column("row").to_numpy(), batch.column("root").to_numpy(), batch.column("text"), []
            for pairs, held in near_pairs(batch, state):
                met = np.unique(pairs[2])
                sets = dict(zip(met.tolist(), sets_of(text.take(pa.array(met)).to_pylist()), strict=True))
                for h, i in pairs[1:].T.tolist():
                    x = held[h]
                    a, b = root_of(x["root"]), root_of(int(root[i]))
                    if a == b:
                        continue
                    if "set" not in x:
                        x["set"] = sets_of([x["batch"].column("text")[x["at"]].as_py()])[0]
                    if reaches(x["set"], sets[i], percent):
                        joined[max(a, b)] = min(a, b)
                        found.append((x["row"], row[i]))
            for x in state.get("held", []):
                # the text's set stands for the batch that it came in
                if x["batch"] is not None:
                    if "set" not in x:
                        x["set"] = sets_of([x["batch"].column("text")[x["at"]].as_py()])[0]
                    x["batch"] = None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["hub", "row"])

    return by_block(full.select("key", "block", "row", "root", "here", "own", "sig", "text")).mapInArrow(work, "hub long, row long")


def classes_of(docs: DataFrame, width: int, percent: int, hashes: int, rows: int, miss: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows; classes of equal sets: n, d1, d2, row, least, copies, root), where ``root`` is the same throughout a group."""
    bounds = least_matches(percent / 100, miss, hashes)
    marks = stored(sketches(docs, id_col, text_col, width, hashes, rows), "near-marks")
    # of a class the row with the smallest id; row keys are hashes, so among equal ids their order is as good as any
    classes = marks.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("row"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "near-classes")
    lead = classes.select(F.col("row").alias("c_row")).distinct()
    nodes = stored(marks.filter("n > 0").select("row", "sig", "keys").join(lead, F.col("row") == F.col("c_row"), "left_semi").dropDuplicates(["row"]), "near-nodes")
    keys = nodes.select("row", F.explode("keys").alias("key"))
    # rows are hashes, so the smallest is a random hub, the same in most buckets of a group
    hubs = keys.groupBy("key").agg(F.min("row").alias("hub"), F.max("row").alias("last")).filter("hub <> last").select("key", "hub")
    members = stored(keys.join(hubs, "key"), "near-members")
    close = stored(pruned(members.filter("row <> hub").select("hub", "row").distinct(), nodes, bounds), "near-close")
    # the nearest hub of a row first; its others only where that left them apart
    first = close.groupBy("row").agg(F.max_by("hub", F.struct("got", "hub")).alias("hub"))
    how = (docs, id_col, text_col, width, percent)
    links = stored(verified(first, *how).select(F.col("hub").alias("a"), F.col("row").alias("b")), "near-links")
    labels = components(links)
    root = lambda c: labels.select(F.col("node").alias(f"n_{c}"), F.col("root").alias(f"r_{c}"))
    open_ = close.join(root("hub"), F.col("hub") == F.col("n_hub"), "left").join(root("row"), F.col("row") == F.col("n_row"), "left")
    open_ = open_.filter(F.coalesce("r_hub", "hub") != F.coalesce("r_row", "row")).select("hub", "row").join(first, ["hub", "row"], "left_anti")
    open_ = stored(open_, "near-open")
    if not open_.isEmpty():
        links = links.union(stored(verified(open_, *how).select(F.col("hub").alias("a"), F.col("row").alias("b")), "near-links"))
        labels = components(links)
    more = stored(rest(members.select("key", "row"), labels, nodes, docs, bounds, rows, id_col, text_col, width, percent).select(F.col("hub").alias("a"), F.col("row").alias("b")), "near-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    return marks, classes.join(labels, F.col("row") == F.col("node"), "left").select("n", "d1", "d2", "row", "least", "copies", F.coalesce("root", "row").alias("root"))


def near_dedup(
    docs: DataFrame, width: int = 5, percent: int = 80, hashes: int = 128, rows: int = 4, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a row of ``docs``: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered. The set of a text: its distinct shingles of ``width`` words; all words as one where there are
    fewer; empty without words or text, and then linked with nothing. Linked: 100 * intersection >= ``percent`` * union. Rows that
    repeat are linked. Rows with a null id join groups but never name one unless all ids of the group are null. An empty table
    gives no rows; other columns aren't read. Ids may be of any type that has an order.

    Sets are of 64-bit hashes of words and shingles, and equal sets are told by their size and two sums over them. Texts made to collide in these hashes would pass
    for alike; others do so with a chance of some 2**-64 a pair.

    ``hashes`` / ``rows`` bands: at a similarity of 0.8, 32 bands of 4 miss a pair with probability 5e-8. ``miss`` bounds the
    posterior at which a pair is dropped.
    """
    marks, named = classes_of(docs, width, percent, hashes, rows, miss, id_col, text_col)
    names = named.groupBy("root").agg(F.min("least").alias("name"), F.sum("copies").alias("size"))
    # only classes in a group of several rows need its name
    grouped = named.join(names.filter("size > 1"), "root").select(F.col("n").alias("g_n"), F.col("d1").alias("g_1"), F.col("d2").alias("g_2"), "name")
    return (
        marks.select("id", "n", "d1", "d2")
        .join(grouped, (F.col("n") == F.col("g_n")) & (F.col("d1") == F.col("g_1")) & (F.col("d2") == F.col("g_2")), "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.when(F.col("g_n").isNotNull(), F.col("name")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def first_of_groups(
    docs: DataFrame, width: int = 5, percent: int = 80, hashes: int = 128, rows: int = 4, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each group of ``near_dedup``, that with the smallest id (null last); columns as in ``docs``, whatever their names.

    Groups are told by their links, not by their ids, so ids that are null or repeat over unlike texts lose no row. Rows without words are
    linked with nothing and stay, but of those that repeat with their id one.
    """
    row, each, nth = unused(docs, "row", "each", "nth")
    marks, named = classes_of(docs, width, percent, hashes, rows, miss, id_col, text_col)
    leads = named.groupBy("root").agg(F.min_by("row", F.struct(F.col("least").isNull(), "least", "row")).alias(row)).select(row, F.lit(False).alias(each))
    blank = marks.filter("n = 0").select(F.col("row").alias(row), F.col("id").isNull().alias(each)).distinct()
    kept = docs.withColumn(row, F.xxhash64(id_col, text_col)).join(leads.unionByName(blank), row)
    return kept.withColumn(nth, F.when(F.col(each), F.monotonically_increasing_id())).dropDuplicates([row, nth]).select(*docs.columns)
