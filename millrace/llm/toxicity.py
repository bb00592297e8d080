"""Toxicity: Levenshtein automata over a lexicon trie, and scores that weigh a term by its context.

The lexicon (words, and stems that words begin with) is learned from labelled rows. Its trie is intersected with Levenshtein automata, and
the product is made deterministic state by state as words ask for it. Each hit counts by how often such hits were toxic: by term,
by edits, and by whether its context window quotes the term or uses it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .quality import isotonic
from .secret_scan import lots

WORD = re.compile(r"[^\W\d_]+")
#: Letters with digits or signs between or before them, as in a word spelled with other characters.
SIGNED = re.compile(r"[\d_@$!*|+][^\W\d_]")
MASKED = re.compile(r"(?<![\w@$!*|+])[^\W\d_]*+(?:[\d_@$!*|+]++[^\W\d_]++)++")
STEMS = (4, 5, 6, 7, 8)
OPEN, CLOSE = "\"“«„‘(", "\"”»“’)"
#: Fixed: words that report speech, in the languages of the labels.
REPORTING = frozenset("said says quote quoted called wrote dit disait écrit dijo dice escribió sagte sagt schrieb".split())


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool

    def edits(self) -> int:
        return 0 if len(self.text) < 5 else 1 if len(self.text) < 9 or self.stem else 2


class Lexicon:
    """The trie of the terms times Levenshtein automata, determinised on demand."""

    def __init__(self, terms: list[Term], most_states: int = 100_000):
        self.terms, self.most_states = terms, most_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # a word that ends here
        self.stems: list[int] = [-1]  # a stem that ends here
        self.allowed = [0]  # edits that some term below allows
        for k, t in enumerate(terms):
            at = 0
            for c in t.text:
                self.allowed[at] = max(self.allowed[at], t.edits())
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.stems.append(-1)
                    self.allowed.append(0)
                at = self.children[at][c]
            self.allowed[at] = max(self.allowed[at], t.edits())
            (self.stems if t.stem else self.ends)[at] = k
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.content: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[tuple[int, int], ...]] = []  # stems that a state completes: (term, edits)
        self.start = self.state({0: 0})

    def state(self, at: dict[int, int]) -> int:
        """The number of the state with these trie nodes and fewest edits so far, with nodes reached by leaving characters out."""
        todo = list(at)
        while todo:
            node = todo.pop()
            e = at[node] + 1
            for child in self.children[node].values():
                if e <= self.allowed[child] and e < at.get(child, 99):
                    at[child] = e
                    todo.append(child)
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.content)
            self.content.append(key)
            self.moves.append({})
            self.found.append(tuple((self.stems[n], e) for n, e in key if self.stems[n] >= 0 and e <= self.terms[self.stems[n]].edits()))
        return self.states[key]

    def step(self, s: int, c: str) -> int:
        at: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < at.get(node, 99):
                at[node] = e

        for node, e in self.content[s]:
            if node:  # a character too many; none before the first
                put(node, e + 1)
            for d, child in self.children[node].items():
                put(child, e if d == c else e + 1)
        out = self.state(at) if at else -1
        self.moves[s][c] = out
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) with the fewest edits, words before stems, then the longer term; None if there is none."""
        if len(self.content) > self.most_states:
            self.reset()
        s, best, got = self.start, None, None

        def better(k: int, e: int, stem: bool) -> None:
            nonlocal best, got
            rank = (e, stem, -len(self.terms[k].text), k)
            if best is None or rank < best:
                best, got = rank, (k, e)

        for c in word:
            to = self.moves[s].get(c)
            s = self.step(s, c) if to is None else to
            if s < 0:
                return got
            for k, e in self.found[s]:
                better(k, e, True)
        for node, e in self.content[s]:
            k = self.ends[node]
            if k >= 0 and e <= self.terms[k].edits():
                better(k, e, False)
        return got


def masked_words(low: str) -> Iterator[re.Match]:
    """Matches of MASKED, looked for around the places where a letter follows a digit or sign."""
    at = 0
    while sign := SIGNED.search(low, at):
        start = sign.start()
        while start > at and (low[start - 1].isalnum() or low[start - 1] in "_@$!*|+"):
            start -= 1
        word = MASKED.match(low, start)
        yield word
        at = word.end()


class Scanner:
    def __init__(self, terms: list[Term], window: int = 40, most_words: int = 300_000):
        self.lexicon, self.window, self.most_words = Lexicon(terms), window, most_words
        self.known: dict[str, tuple[int, int] | None] = {}

    def quoted(self, text: str, start: int, end: int) -> bool:
        """Whether the window around the hit opens a quotation before and closes one after it, or reports speech before it."""
        before, after = text[max(0, start - self.window) : start], text[end : end + self.window]
        opened = max((before.rfind(c) for c in OPEN), default=-1)
        if opened >= 0 and before[opened] in "\"" and before.count('"') % 2 == 0:
            opened = -1
        if opened >= 0 and any(c in after for c in CLOSE) and "\n" not in before[opened:]:
            return True
        return any(w in REPORTING for w in WORD.findall(before)[-4:])

    def hits(self, text: str) -> tuple[int, list[tuple[str, int, int, int, int, bool]]]:
        """(number of words, [(word, start, end, term, edits, quoted)] in order), words lowered.

        Letters joined by digits or signs are matched as one word too, each such character an edit, unless a run of letters in them is a hit.
        """
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lowered
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        known, all_ = self.known, WORD.findall(low)
        masked = list(masked_words(low))
        if len(known) > self.most_words:
            known.clear()
        wanted = {}
        for w in {*all_, *(m[0] for m in masked)}:
            if w not in known:
                known[w] = self.lexicon.match(w)
            if known[w]:
                wanted[w] = known[w]
        if not wanted:
            return len(all_), []
        spans = [m for m in WORD.finditer(low) if m[0] in wanted]
        spans += [m for m in masked if m[0] in wanted and not any(w in wanted for w in WORD.findall(m[0]))]
        spans.sort(key=lambda m: m.start())
        return len(all_), [(m[0], m.start(), m.end(), *wanted[m[0]], self.quoted(low, *m.span())) for m in spans]


def apart(rows: DataFrame) -> DataFrame:
    """One of the rows (id, text, y) that share their smallest shingle of three words, as near copies do, and a fold of 0 or 1.

    Which one is settled by a hash of the row, so neither the order of rows nor their partitions decide.
    """
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    keyed = rows.withColumn("w", words).withColumn("key", F.array_min(shingles))
    one = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "text").alias("h"), "y", "id", "text")).alias("r"))
    return one.select("r.id", "r.text", "r.y", F.pmod("key", F.lit(2)).cast("int").alias("fold"))


def learned_terms(rows: DataFrame, least: int, surprise: float, most_terms: int) -> list[Term]:
    """Words and stems (4 to 8 letters that several words begin with) that mark toxic texts in one fold and again in the other.

    In the first, a term occurs in ``least`` toxic texts at least, and its log likelihood ratio against the share of toxic texts is ``surprise`` or
    more; in the other fold most texts with it are toxic too.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [2 * f + y for f, y in zip(batch.column("fold").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            for first, lot in lots(batch.column("text")):
                counts = [Counter() for _ in range(4)]
                for i, t in enumerate(lot, first):
                    words = {w for w in WORD.findall(t.lower()) if len(w) >= 4}
                    counts[kinds[i]].update({(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if len(w) > k})
                terms = list(set().union(*counts))
                sums = [pa.array([c[k] for k in terms], pa.int64()) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()), *sums], names=["w", "stem", "g0", "b0", "g1", "b1"])

    shares = {r["fold"]: r["y"] for r in rows.groupBy("fold").agg(F.avg("y").alias("y")).collect()}
    counted = rows.select("y", "text", "fold").mapInArrow(work, "w string, stem boolean, g0 long, b0 long, g1 long, b1 long").groupBy("w", "stem").agg(*[F.sum(c).alias(c) for c in ("g0", "b0", "g1", "b1")])

    def marks(f: int) -> Column:
        b, g, base, again, not_again = F.col(f"b{f}"), F.col(f"g{f}"), min(max(shares.get(f, 0.0), 1e-3), 0.999), F.col(f"b{1 - f}"), F.col(f"g{1 - f}")
        ratio = b * F.log(b / (b + g) / base) + g * F.log(F.greatest(g, F.lit(0.5)) / (b + g) / (1 - base))
        return (b >= least) & (b > (b + g) * base) & (ratio >= surprise) & (again >= 1) & (again > not_again)

    found = counted.filter((F.col("b0") + F.col("b1") > 0) & (marks(0) | marks(1))).withColumn("bad", F.col("b0") + F.col("b1")).orderBy(F.col("bad").desc(), "w", "stem").limit(most_terms).collect()
    share = min(max(sum(shares.values()) / max(len(shares), 1), 1e-3), 0.999)

    def ratio(r) -> float:
        b, g = r["bad"], r["g0"] + r["g1"]
        return b * math.log(b / (b + g) / share) + g * math.log(max(g, 0.5) / (b + g) / (1 - share))

    words = {r["w"]: ratio(r) for r in found if not r["stem"]}
    stems = {r["w"]: ratio(r) for r in found if r["stem"]}
    # of stems that begin with one another the most telling is kept; a stem must tell more than any one word with it
    kept: list[str] = []
    for s in sorted(stems, key=lambda s: (-stems[s], s)):
        alone = max((n for w, n in words.items() if w.startswith(s)), default=0)
        if stems[s] >= 1.5 * alone and not any(s.startswith(k) or k.startswith(s) for k in kept):
            kept.append(s)
    return [Term(w, False) for w in sorted(words) if not any(w.startswith(s) for s in kept)] + [Term(s, True) for s in sorted(kept)]


HIT = "struct<word:string,start:int,end:int,term:int,edits:int,quoted:boolean>"


def found(rows: DataFrame, held, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of ``rows``, words (their number) and hits. held: broadcast terms."""
    fields = [f for f in rows.schema.fields if f.name in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held.value)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        for batch in batches:
            for first, lot in lots(batch.column("text")):
                counts, flat, ends = [], [], [0]
                for t in lot:
                    n, hits = scanner.hits(t)
                    counts.append(n)
                    flat += hits
                    ends.append(len(flat))
                hits = pa.StructArray.from_arrays([pa.array([h[j] for h in flat], k) for j, k in enumerate(kinds)], names=["word", "start", "end", "term", "edits", "quoted"])
                own = batch.slice(first, len(lot))
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(f.name) for f in fields], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)],
                    names=[*[f.name for f in fields], "words", "hits"],
                )

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "words long", f"hits array<{HIT}>"])
    return rows.select(*[f.name for f in fields], "text").mapInArrow(work, schema)


LISTED = pa.list_(pa.struct([("word", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("weight", pa.float64())]))


@dataclass
class Weights:
    """How much each kind of hit tells: by term, edits and whether it is quoted.

    In a clean text of n words a kind is expected n * natural times, in a toxic one added times more; a hit tells log(1 + added / (n * natural)).
    Rare kinds lean on all terms' hits of as many edits.
    """

    added: dict[tuple[int, int, bool], float]
    natural: dict[tuple[int, int, bool], float]

    @classmethod
    def learned(cls, counts: list, terms: int, toxic: int, toxic_words: int, clean_words: int) -> Weights:
        own = {(r["term"], r["edits"], r["quoted"]): (r["bad"], r["good"]) for r in counts}
        added, natural = {}, {}
        for e in (0, 1, 2):
            for q in (False, True):
                kinds = [v for k, v in own.items() if k[1:] == (e, q)]
                bad, good = ((sum(v[i] for v in kinds) + 0.5) / max(terms, 1) for i in (0, 1))
                for k in range(terms):
                    b, g = own.get((k, e, q), (0, 0))
                    rate = (g + 1) / (clean_words + max(clean_words, 1) / good)
                    hits = (b + 1) / (1 + 1 / (bad * (0.3 if q else 1.0)))
                    natural[k, e, q] = rate
                    added[k, e, q] = max(0.0, hits - toxic_words * rate) / max(toxic, 1)
        return cls(added, natural)

    def tell(self, key: tuple[int, int, bool], words: int) -> float:
        return math.log1p(self.added[key] / (max(words, 1) * self.natural[key]))

    def total(self, hits: list[dict], words: int) -> float:
        """Over the distinct words of a text, each by its most telling hit."""
        best: dict[str, float] = {}
        for h in hits:
            best[h["word"]] = max(best.get(h["word"], 0.0), self.tell((h["term"], h["edits"], h["quoted"]), words))
        return sum(best.values())


def toxicity(
    docs: DataFrame, labels: DataFrame, trained: Column, sample: int = 30_000, least: int = 4, surprise: float = 8.0, most_terms: int = 5_000,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """One row a row of ``docs``: id, score (0 to 1), hits (word, term, start, end in code points, edits, quoted, weight).

    Lexicon and weights are learned from about ``sample`` labelled rows for which ``trained`` (of the id column) holds, chosen by a hash of the id; only
    texts are inputs. At most ``most_terms`` terms are kept. What the distinct words of the whole text tell is added up, and the sum is
    calibrated by isotonic regression on the same rows. An id with several labels counts as toxic if one of them says so. Null labels aren't learned; null, empty and clean texts get the score of a sum of 0; rows
    that repeat get equal results; a null id is scored; an empty table gives no rows; without labels of both kinds there is no
    lexicon and all score alike.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.filter(trained & F.col(label_col).isNotNull()).select(F.col(id_col).alias("l_id"), (F.col(label_col) > 0).cast("int").alias("y")).groupBy("l_id").agg(F.max("y").alias("y"))
    n = known.count()
    known = known.filter(F.pmod(F.xxhash64("l_id", F.lit(9)), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(n, 1)))
    learn = stored(apart(rows.join(F.broadcast(known), F.col("id") == F.col("l_id")).select("id", "text", "y")), "toxic-learn")  # the sample bounds what is broadcast
    terms = learned_terms(learn, least, surprise, most_terms)
    held = spark.sparkContext.broadcast(terms)
    seen = stored(found(learn, held, ["y"]), "toxic-seen")
    size = {r["y"]: r for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).collect()}
    toxic, toxic_words, clean_words = (size[y][c] if y in size else 0 for y, c in ((1, "n"), (1, "words"), (0, "words")))
    kinds = F.array_distinct(F.transform("hits", lambda h: F.struct(h["word"], h["term"], h["edits"], h["quoted"])))
    counts = seen.select("y", F.explode(kinds).alias("h")).groupBy("h.term", "h.edits", "h.quoted").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).collect()
    weights = spark.sparkContext.broadcast((terms, Weights.learned(counts, len(terms), toxic, toxic_words, clean_words)))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, by = weights.value
        for batch in batches:
            raw = [by.total(h, n) for h, n in zip(batch.column("hits").to_pylist(), batch.column("words").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(raw, pa.float64())], names=["y", "raw"])

    bins = seen.mapInArrow(told, "y int, raw double").groupBy(F.ceil(F.least("raw", F.lit(60.0)) * 5).alias("bin")).agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    bins = sorted(bins, key=lambda r: r["bin"])
    at, rate = isotonic(np.array([r["bin"] / 5 for r in bins]), np.array([float(r["bad"]) for r in bins]), np.array([float(r["n"]) for r in bins])) if bins else (np.zeros(1), np.zeros(1))
    curve = spark.sparkContext.broadcast((at, rate))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, by = weights.value
        at, rate = curve.value
        for batch in batches:
            raw, out = [], []
            for hits, n in zip(batch.column("hits").to_pylist(), batch.column("words").to_pylist(), strict=True):
                raw.append(by.total(hits, n))
                out.append([h | {"term": terms[h["term"]].text + "*" * terms[h["term"]].stem, "weight": by.tell((h["term"], h["edits"], h["quoted"]), n)} for h in hits])
            raw = np.array(raw)
            # a trace of the sum keeps the order within a block
            s = 0.998 * np.interp(raw, at, rate) + 0.002 * (1 - np.exp(-raw / 10))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64()), pa.array(out, LISTED)], names=["id", "score", "hits"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double, hits array<struct<word:string,term:string,start:int,end:int,edits:int,quoted:boolean,weight:double>>"
    return found(rows, held, ["id"]).mapInArrow(score, schema).withColumnRenamed("id", id_col)
