"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces: wherever it occurs with at most k edits, one piece occurs exactly. One pass
of an automaton over each text finds all piece hits; Myers' bit-parallel distance verifies the stretch around each, from the pair of pieces that
holds the hit up to the item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .secret_scan import lots


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, rate: float, piece: int) -> int:
    """Edits allowed: ``rate`` of the length; none in an item under ``piece`` characters, whose own pieces would be too short to lead anywhere."""
    return min(int(rate * length), length - 1) if length >= piece else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) for k + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def runs(item: str, k: int, q: int) -> list[tuple[int, int, int, list[str]]]:
    """(start, end, edits, parts) of the runs that hold piece ``q`` of k + 1 when the pieces are halved again and again, shortest first; neither piece nor item.

    Of two halves of a and b pieces with at most a + b - 1 edits, one has fewer edits than pieces. So an occurrence has a piece without edits all of
    whose runs have fewer edits than pieces. That piece is at an end of its shortest run, so the edits of that are in the rest: one of its ``parts`` has none.
    """
    out, a, b = [], 0, k + 1
    at = lambda x: len(item) * x // (k + 1)
    while b - a > 2:
        mid = (a + b) // 2
        a, b = (a, mid) if q < mid else (mid, b)
        if b - a > 1:
            rest = item[at(a) : at(q)] + item[at(q + 1) : at(b)]
            out.append((at(a), at(b), b - a - 1, [x for _, x in pieces(rest, b - a - 1)]))
    return out[::-1]


class Pattern:
    """Myers' bit-parallel edit distance of one item against stretches of text."""

    def __init__(self, item: str):
        self.m, self.top, self.all = len(item), 1 << (len(item) - 1), (1 << len(item)) - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the nearest stretch of ``text``, the first of equals; None beyond ``most`` edits."""
        pv, mv, score, full, top, at = self.all, 0, self.m, self.all, self.top, self.at
        least, end = most + 1, -1
        for j, c in enumerate(text):
            eq = at.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score < least:
                least, end = score, j + 1
        return (least, end) if least <= most else None


class Finder:
    """Finds items, known by their place in the lot: ids may repeat or be null."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, piece: int):
        self.ids, self.items = [i for i, _ in items], {}
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, raw) in enumerate(items):
            text = normalised(raw)
            if not text:
                continue
            k = budget(len(text), rate, piece)
            self.items[i] = text, k, Pattern(text), Pattern(text[::-1])
            for q, (_, s) in enumerate(pieces(text, k)):
                where.setdefault(s, []).append((i, q))
        self.machine = ahocorasick.Automaton()
        for s, hits in where.items():
            self.machine.add_word(s, (len(s), hits))
        if where:
            self.machine.make_automaton()
        self.check = lru_cache(maxsize=20_000)(self._check)
        self.part, self.runs = lru_cache(maxsize=20_000)(Pattern), lru_cache(maxsize=20_000)(runs)

    def _check(self, i: int, stretch: str) -> tuple[int, int, int] | None:
        text, k, forward, backward = self.items[i]
        at = stretch.find(text)
        if at >= 0:
            return 0, at, at + len(text)
        got = forward.best(stretch, k)
        if got is None:
            return None
        distance, end = got
        back = backward.best(stretch[:end][::-1][: len(text) + k], distance)
        return distance, end - back[1], end

    def _runs_fit(self, whole: str, k: int, q: int, start: int, text: str) -> bool:
        """Whether all runs of pieces around piece ``q`` have fewer edits than pieces where the item would begin at ``start``."""
        for nth, (lo, hi, most, parts) in enumerate(self.runs(whole, k, q)):
            stretch = text[max(0, start + lo - most) : max(0, start + hi + most)]
            if nth == 0 and not any(x in stretch for x in parts):
                return False
            if self.part(whole[lo:hi]).best(stretch, most) is None:
                return False
        return True

    def find(self, text: str, first_only: bool = False) -> dict[int, tuple[int, int, int]]:
        """place of an item: (distance, start, end) of its nearest occurrence in the normalised text."""
        out: dict[int, tuple[int, int, int]] = {}
        if not self.items:
            return out
        done: dict[int, tuple[int, int]] = {}
        text = normalised(text)
        for last, (size, hits) in self.machine.iter(text):
            for i, q in hits:
                if i in out and out[i][0] == 0:
                    continue
                whole, k, _, _ = self.items[i]
                start = last + 1 - size - len(whole) * q // (k + 1)
                # the hits of one occurrence place it within k of one another, so the first stretch serves them all
                lo, hi = max(0, start - 2 * k), start + len(whole) + 2 * k
                seen = done.get(i)
                if seen and seen[0] <= max(0, start - k) and start + len(whole) + k <= seen[1]:
                    continue
                if not self._runs_fit(whole, k, q, start, text):
                    continue
                done[i] = lo, hi
                got = self.check(i, text[lo:hi])
                if got and (i not in out or got[0] < out[i][0]):
                    out[i] = got[0], got[1] + lo, got[2] + lo
                    if first_only:
                        return out
        return out


def item_lots(benchmark: DataFrame, item_col: str, text_col: str, most_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items, in lots of about ``most_chars`` characters, one lot on the driver at a time."""
    own = benchmark.select(F.col(item_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    total = own.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // most_chars)
    for k in range(n):
        yield [(r["i"], r["t"]) for r in own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def find_items(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, piece: int = 12, most_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """A row for each row of ``docs`` and row of ``benchmark`` in it: id, item_id, distance, budget, start, end (in the normalised text).

    Normalised: lower case, blanks run together. An item may differ by ``rate`` of its length in edits; one under ``piece`` characters has to occur
    as it is. The nearest occurrence counts, of equals the first found. Null and empty texts hold nothing, null and empty items are in nothing; rows
    of either table that repeat, in id or text, are found each; null ids are kept; empty tables give no rows. Items reach the executors in lots of ``most_chars`` characters,
    with a pass over ``docs`` for each lot, so no broadcast outgrows that.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    of_item = benchmark.schema[item_col].dataType
    item_type = to_arrow_type(of_item)
    schema = f"id {kind}, item_id {of_item.simpleString()}, distance int, budget int, start int, end int"
    out = docs.sparkSession.createDataFrame([], schema)
    for lot in item_lots(benchmark, item_col, item_text_col, most_chars):
        held = docs.sparkSession.sparkContext.broadcast(lot)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            finder = Finder(held.value, rate, piece)
            for batch in batches:
                for first, texts in lots(batch.column("text")):
                    got = [(first + i, finder.ids[n], finder.items[n][1], *hit) for i, t in enumerate(texts) for n, hit in sorted(finder.find(t).items())]
                    if got:
                        at, item, k, distance, start, end = zip(*got, strict=True)
                        ints = [pa.array(x, pa.int32()) for x in (distance, k, start, end)]
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(item, item_type), *ints], names=["id", "item_id", "distance", "budget", "start", "end"])

        out = out.unionByName(rows.mapInArrow(work, schema))
    return out.withColumnRenamed("id", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, piece: int = 12, most_chars: int = 2_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, as ``find_items`` tells; columns as in ``docs``, whatever their names.

    Rows are dropped where they are, so nothing is joined or moved, and rows that repeat stay or go together. Null and empty texts hold nothing and stay; texts are searched
    whole, however long; an empty table, or one of items, changes nothing.
    """
    for lot in item_lots(benchmark, item_col, item_text_col, most_chars):
        held = docs.sparkSession.sparkContext.broadcast(lot)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            finder = Finder(held.value, rate, piece)
            for batch in batches:
                clean = [first + i for first, texts in lots(batch.column(text_col)) for i, t in enumerate(texts) if not finder.find(t, first_only=True)]
                yield batch.take(pa.array(clean, pa.int64()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
