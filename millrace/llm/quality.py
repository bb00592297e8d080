"""Quality classifier: random Fourier features of document statistics, ridge scores from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused
from .shingles import mixed, slices, word_hashes

NAMES = [
    "log_bytes", "log_words", "word_bytes", "word_spread", "upper", "digit", "stop", "mark", "symbol", "other", "blank", "line", "distinct_words", "top_word",
    "same_as_before", "distinct_pairs", "top_pair", "entropy", "long_words", "short_words", "capital_words", "lone_marks", "distinct_lines", "line_bytes",
]
_CLASS = np.full(256, 7, dtype=np.uint8)  # bytes beyond ASCII
_CLASS[:128] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[46, 33, 63]] = 3
_CLASS[[44, 59, 58, 39, 34, 45, 40, 41]] = 4
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 6, 8


def runs(keys: np.ndarray) -> np.ndarray:
    """Lengths of the groups of equal keys."""
    keys = np.sort(keys)
    return np.diff(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]))


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each text; an empty one has zeros."""
    n = len(texts)
    size = np.array([len(t) for t in texts])
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    firsts = np.cumsum([0, *(size[:-1] + 1)])
    of = np.repeat(np.arange(n), size + 1)
    kinds = _CLASS[raw]
    by = np.bincount(of * 9 + kinds, minlength=9 * n).reshape(n, 9).astype(np.float64)
    by[:, 6] -= 1  # the blank that parts it from the next
    part = by / np.maximum(size, 1)[:, None]
    bytes_ = np.bincount(of.astype(np.int64) * 256 + raw, minlength=256 * n).reshape(n, 256).astype(np.float64)
    bytes_[:, 32] -= 1
    p = bytes_ / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)

    blank = (kinds == 6) | (kinds == 8)
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    h, doc = word_hashes(texts)
    length = (ends - starts).astype(np.float64)
    words = np.bincount(doc, minlength=n)
    per = np.maximum(words, 1)
    mean = np.bincount(doc, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / per - mean**2, 0))
    first, last = kinds[starts], kinds[np.maximum(ends - 1, 0)]
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.zeros(0, dtype=bool)
    pair = mixed(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
    out = np.zeros((n, len(NAMES)))
    cut = np.cumsum(np.r_[0, words])
    newline = np.flatnonzero(kinds == 8)
    for i in range(n):
        s, e = cut[i], cut[i + 1]
        if e > s:
            c = runs(h[s:e])
            out[i, 12], out[i, 13] = len(c) / (e - s), c.max() / (e - s)
            if e - s > 1:
                c = runs(pair[s : e - 1])
                out[i, 15], out[i, 16] = len(c) / (e - s - 1), c.max() / (e - s - 1)
        if by[i, 8]:
            lines = [x for x in texts[i].split(b"\n") if x]
            out[i, 22] = len(set(lines)) / max(len(lines), 1)
        else:
            out[i, 22] = 1.0
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread)
    out[:, 4:12] = part[:, [1, 2, 3, 4, 5, 7, 6, 8]]
    out[:, 14] = np.bincount(doc, same, n) / per
    out[:, 17] = entropy
    out[:, 18] = np.bincount(doc, length > 16, n) / per
    out[:, 19] = np.bincount(doc, length <= 2, n) / per
    out[:, 20] = np.bincount(doc, first == 1, n) / per
    out[:, 21] = np.bincount(doc, (last == 5) | (first == 5), n) / per
    out[:, 23] = np.log1p(size / (by[:, 8] + 1))
    out[size == 0] = 0
    return out


def measured(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``rows`` but for the text, then x: its statistics."""
    kept = [f for f in rows.schema.fields if f.name != text_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            for at in range(0, len(batch), 512):
                for first, bodies in slices(texts.slice(at, 512).to_pylist()):
                    x = statistics(bodies)
                    own = batch.slice(at + first, len(bodies))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*[own.column(f.name) for f in kept], lists], names=[*[f.name for f in kept], "x"])

    return rows.mapInArrow(work, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "x array<double>"]))


class Kernel:
    """Cosines of random projections, which approximate a Gaussian kernel, beside the standardised statistics and a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, width: float, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z / 10, np.ones((len(x), 1))])


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(len(batch), -1)


def normal_sums(rows: DataFrame, kernel: Kernel, groups: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over rows (x, y): summed per partition, then in ``groups`` tasks, then on the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                z, y = kernel(matrix(batch)), batch.column("y").to_numpy()
                one = np.hstack([z.T @ z, (z.T @ y)[:, None]])
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in batch.column("s"):
                one = np.frombuffer(s.as_py())
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    sums = rows.select("x", "y").mapInArrow(first, "s binary").repartition(groups).mapInArrow(then, "s binary").collect()
    total = sum(np.frombuffer(r["s"]) for r in sorted(sums, key=lambda r: bytes(r["s"])))
    k = kernel.w.shape[1] + kernel.w.shape[0] + 1
    total = total.reshape(k, k + 1)
    return total[:, :k], total[:, k]


def isotonic(score: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by score: (mean scores of blocks, their rates of good, a row added to each for and against)."""
    blocks: list[list[float]] = []
    for s, g, c in zip(score, good, n, strict=True):
        blocks.append([s * c, g, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s_, g_, c_ = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s_, blocks[-1][1] + g_, blocks[-1][2] + c_]
    at = np.array([b[0] / b[2] for b in blocks])
    rate = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
    return at, np.maximum.accumulate(rate)


def quality(
    docs: DataFrame, labels: DataFrame, trained: Column, features: int = 256, width: float = 3.5, ridge: float = 1e-3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row a row of ``docs``: id and score, the calibrated chance that its label is 1.

    Learns from the labels (id, label) of rows for which ``trained`` (of the id column) holds; only the text is an input. All such rows are used, four fifths
    for the fit, one fifth (by a hash of the id) for the calibration. Of several labels of an id the smallest counts. Null labels aren't learned; null text is empty text; an empty
    text is scored like any other; rows that repeat get equal scores; a null id is scored; an empty table gives no rows. Where labels of
    a kind are missing, all scores are the smoothed share of label 1. Other columns aren't read. Sums are floating-point, so scores agree to about
    1e-9 between partitionings.
    """
    return scored(docs, labels, trained, features, width, ridge, seed, id_col, text_col, label_col).select(F.col("id").alias(id_col), "score")


def scored(docs: DataFrame, labels: DataFrame, trained: Column, features: int = 256, width: float = 3.5, ridge: float = 1e-3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, row (a hash of id and text) and score of each row, as ``quality`` says."""
    spark = docs.sparkSession
    rows = stored(measured(docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))), "quality-x")
    known = labels.filter(trained & F.col(label_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("double").alias("y")).groupBy("l_id").agg(F.min("y").alias("y"))
    learn = stored(rows.join(known, F.col("id") == F.col("l_id")).select("id", "x", "y", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(5)) == 0).alias("held")), "quality-learn")
    dims = range(len(NAMES))
    told = learn.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in dims for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, y = told["n"], told["y"] or 0.0
    if not 0 < y < n:
        return rows.select("id", "row", F.lit((y + 0.5) / (n + 1)).alias("score"))
    kernel = Kernel(np.array([told[f"m{i}"] for i in dims]), np.array([told[f"s{i}"] for i in dims]), width, features, seed)
    fitted, left = learn.filter("NOT held"), learn.filter("held")
    if left.isEmpty() or fitted.isEmpty():
        fitted = left = learn
    a, b = normal_sums(fitted, kernel)
    beta = np.linalg.solve(a + ridge * np.trace(a) / len(a) * np.eye(len(a)), b)
    held = spark.sparkContext.broadcast((kernel, beta))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, beta = held.value
        for batch in batches:
            raw = pa.array(kernel(matrix(batch)) @ beta) if len(batch) else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([*[c for c, f in zip(batch.columns, batch.schema.names, strict=True) if f != "x"], raw], names=[f for f in batch.schema.names if f != "x"] + ["raw"])

    # a row a bin, at most 1201 bins, whatever the number of labels
    bins = left.select("x", "y").mapInArrow(score, "y double, raw double").groupBy(F.round(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * 400).alias("bin"))
    bins = sorted(bins.agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["bin"])
    at, rate = isotonic(np.array([r["bin"] / 400 for r in bins]), np.array([r["good"] for r in bins]), np.array([float(r["n"]) for r in bins]))
    curve = spark.sparkContext.broadcast((at, rate))

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rate = curve.value
        for batch in score(batches):
            raw = batch.column("raw").to_numpy()
            # a trace of the raw score keeps the order within a block
            s = 0.998 * np.interp(raw, at, rate) + 0.002 / (1 + np.exp(-4 * (raw - 0.5)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(s)], names=["id", "row", "score"])

    return rows.select("id", "row", "x").mapInArrow(calibrated, f"id {rows.schema['id'].dataType.simpleString()}, row long, score double")


def good_documents(docs: DataFrame, labels: DataFrame, trained: Column, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``; columns as in ``docs``, whatever their names.

    Each row is judged by its own text, so unlike texts under one id, or under none, are judged apart; rows that repeat stay or go together. Null and empty texts are
    scored like others. An empty table gives no rows.
    """
    row, good = unused(docs, "row", "good")
    kept = scored(docs, labels, trained, id_col=id_col, text_col=text_col, **how).filter(F.col("score") >= least).select(F.col("row").alias(good)).distinct()
    return docs.withColumn(row, F.xxhash64(id_col, text_col)).join(kept, F.col(row) == F.col(good), "left_semi").select(*docs.columns)
