"""Language identification by interpolated Kneser-Ney character models.

A model per language over the characters of words (a word's characters see at most the ones before them in the word). Probabilities of all
character groups that any language has seen are interpolated beforehand and kept in arrays sorted by hash, a column a language;
a lookup that finds nothing backs off. The lowest cross-entropy per character wins. Scores are calibrated on rows that no model counted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shingles import mixed

ORDER = 4
_LINK = mixed(np.arange(5000, 5000 + 2 * (ORDER + 1) * ORDER, dtype=np.uint64)).reshape(2, ORDER + 1, ORDER) | np.uint64(1)


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: the lowered letter or mark, else 0; whether it is a letter."""
    code, is_letter = np.zeros(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            code[i], is_letter[i] = ord(low) if len(low) == 1 else i, True
        elif unicodedata.category(c)[0] == "M":
            code[i] = i
    return code, is_letter


def characters(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """([character, the one before it, ...], number of its text, whether each text has a letter).

    The end of a word counts as character 0; before a word all characters are 0.
    """
    raw = np.frombuffer(("\n" + "\n".join(t.replace("\n", " ") for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code, is_letter = letters()
    c = code[raw]
    lines = np.cumsum([0] + [len(t) + 1 for t in texts])
    seen = np.add.reduceat(is_letter[raw], lines[:-1], dtype=np.int64) > 0 if texts else np.empty(0, dtype=bool)
    at = np.flatnonzero((c[1:] != 0) | (c[:-1] != 0)) + 1
    past = [c[at]]
    for k in range(1, ORDER):
        p = c[np.maximum(at - k, 0)]
        past.append(p if k == 1 else np.where(past[-1] == 0, np.uint32(0), p))
    # the end of a text's last word is the line break after it
    return past, np.searchsorted(lines, at - 1, side="right") - 1, seen


def hashed(past: list[np.ndarray], kind: int) -> np.ndarray:
    """kind 0: a character with those before it; kind 1: those before it only."""
    n = len(past)
    total = np.zeros(len(past[0]), dtype=np.uint64) if n else np.zeros(0, dtype=np.uint64)
    for k, p in enumerate(past):
        total += (p.astype(np.uint64) + np.uint64(1)) * _LINK[kind, n, k]
    return mixed(total)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``keys``, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def discount(ones: int, twos: int) -> float:
    """What is taken off each count, by the numbers of groups seen once and twice."""
    return float(min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95))


class Model:
    """log probabilities by order: grams (keys, table) and weights of unseen continuations (keys, table), a column a language."""

    def __init__(self, langs: list[str], counts: list[tuple[list[np.ndarray], np.ndarray]], cuts: list[float] | None = None):
        """counts: for each language, distinct groups ([character, before, ...]) and their counts. cuts: discounts of the longest groups where some are left out."""
        self.langs = langs
        size = len(np.unique(np.concatenate([g[0] for g, _ in counts]))) + 1
        levels = []  # by order from 1: a language's (keys, probability, context keys, weight)
        for groups, n in counts:
            rows = {ORDER: (groups, n.astype(np.float64))}
            for k in range(ORDER - 1, 0, -1):
                g, _ = rows[k + 1]
                _, first, back = np.unique(hashed(g[:k], 0), return_index=True, return_inverse=True)
                rows[k] = [x[first] for x in g[:k]], np.bincount(back).astype(np.float64)
            levels.append(rows)
        self.grams, self.weights = {}, {}
        base = np.empty(len(langs))
        lower_keys, lower = np.empty(0, dtype=np.uint64), np.empty((0, len(langs)))
        for k in range(1, ORDER + 1):
            every = [np.concatenate([rows[k][0][x] for rows in levels]) for x in range(k)]
            keys, first = np.unique(hashed(every, 0), return_index=True)
            every = [x[first] for x in every]
            contexts = hashed(every[1:], 1) if k > 1 else np.zeros(len(keys), dtype=np.uint64)
            known = np.unique(contexts)
            weight, own = np.ones((len(known), len(langs))), np.zeros((len(keys), len(langs)))
            of = np.searchsorted(known, contexts)
            for j, rows in enumerate(levels):
                g, n = rows[k]
                cut = cuts[j] if cuts and k == ORDER else discount((n == 1).sum(), (n == 2).sum())
                at = np.searchsorted(keys, hashed(g, 0))
                total, kinds = np.bincount(of[at], n, len(known)), np.bincount(of[at], minlength=len(known))
                has = total > 0
                weight[has, j] = cut * kinds[has] / total[has]
                own[at, j] = np.maximum(n - cut, 0) / total[of[at]]
            if k == 1:
                base = weight[0] / size
                prob = own + base
            else:
                at, _ = find(lower_keys, hashed(every[: k - 1], 0))
                prob = own + weight[of] * lower[at]
            lower_keys, lower = keys, prob
            self.grams[k] = keys, np.log(prob).astype(np.float32)
            if k > 1:
                self.weights[k] = known, np.log(weight).astype(np.float32)
        self.base = np.log(base).astype(np.float32)

    def logs(self, past: list[np.ndarray], order: int = ORDER) -> np.ndarray:
        keys, table = self.grams[order]
        at, hit = find(keys, hashed(past[:order], 0))
        out = table[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            if order == 1:
                out[miss] = self.base
            else:
                less = [p[miss] for p in past[:order]]
                known, weight = self.weights[order]
                at, hit = find(known, hashed(less[1:], 1))
                out[miss] = np.where(hit[:, None], weight[at], np.float32(0)) + self.logs(less, order - 1)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character by text and language, characters, whether there is a letter)."""
        past, of, seen = characters(texts)
        n = np.bincount(of, minlength=len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        if len(of):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total[of[starts]] = np.add.reduceat(self.logs(past), starts, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n, seen


def parts(texts: pa.Array, most: int = 1 << 18, longest: int = 1 << 20) -> Iterator[tuple[int, list[str], list[int]]]:
    """(first row, pieces of texts, the row of each piece after the first), in lots of about ``most`` characters. A long text comes in pieces cut between words."""
    lot: list[str] = []
    rows: list[int] = []
    size = first = 0
    for at in range(0, len(texts), 64):
        for i, t in enumerate(texts.slice(at, 64).to_pylist(), at):
            t = t or ""
            if lot and size + len(t) > most:
                yield first, lot, rows
                lot, rows, size, first = [], [], 0, i
            if len(t) <= longest:
                lot.append(t)
                rows.append(i - first)
            else:
                x = 0
                while x < len(t):
                    end = x + longest
                    if end < len(t):
                        # after a blank, so that no word is cut; only one of over 4096 characters may be
                        blank = next((k for k in range(end, max(x, end - 4096), -1) if t[k - 1].isspace()), end)
                        end = blank
                    lot.append(t[x:end])
                    rows.append(i - first)
                    x = end
            size += len(t)
    if lot:
        yield first, lot, rows


def gram_counts(rows: DataFrame, key: str) -> DataFrame:
    """key, g (array of ORDER code points, last first), n: how often each character group occurs, counted per task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("key").to_pylist()
            for first, lot, of in parts(batch.column("text")):
                past, at, _ = characters(lot)
                by = np.array([names[first + x] for x in of], dtype=object)
                kinds, of_kind = np.unique(by.astype(str), return_inverse=True)
                for j, kind in enumerate(kinds.tolist()):
                    sel = [p[of_kind[at] == j] for p in past]
                    _, one, n = np.unique(hashed(sel, 0), return_index=True, return_counts=True)
                    g = np.stack([p[one] for p in sel], axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(n), pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(0, g.size + 1, ORDER, dtype=np.int32)), pa.array(g.ravel())), pa.array(n.astype(np.int64))],
                        names=["key", "g", "n"],
                    )

    return rows.select(F.col(key).alias("key"), "text").mapInArrow(work, "key string, g array<int>, n long").groupBy("key", "g").agg(F.sum("n").alias("n"))


def entropies(rows: DataFrame, held, ids: list[str]) -> DataFrame:
    """The ids of ``rows``, ce (array by language), chars, letter. held: a broadcast Model."""
    fields = [f for f in rows.select(*ids).schema.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for first, lot, of in parts(batch.column("text")):
                ce, n, seen = model.entropies(lot)
                k = of[-1] + 1
                chars = np.bincount(of, n, k)
                all_ = np.stack([np.bincount(of, ce[:, j] * n, k) for j in range(ce.shape[1])], axis=1) / np.maximum(chars, 1)[:, None]
                own = batch.slice(first, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[own.column(f.name) for f in fields],
                        pa.ListArray.from_arrays(pa.array(np.arange(0, all_.size + 1, all_.shape[1], dtype=np.int32)), pa.array(all_.ravel())),
                        pa.array(chars.astype(np.int64)),
                        pa.array(np.bincount(of, seen, k) > 0),
                    ],
                    names=[*[f.name for f in fields], "ce", "chars", "letter"],
                )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.select(*ids, F.col("text")).mapInArrow(work, f"{types}{', ' if types else ''}ce array<double>, chars long, letter boolean")


def fit(train: DataFrame, sample: int = 2000, most_cells: int = 20_000_000, most_langs: int = 500) -> tuple[Model, float, dict[str, float]] | None:
    """(model, temperature, cross-entropy by language beyond which a text is rejected) from rows (id, text, lang); None where there is nothing to learn.

    Counts come from about ``sample`` rows a language, chosen by a hash of the id; every tenth of these calibrates only. Tables hold groups times
    languages, ``most_cells`` at most: where a language has more groups than its share of that, its most frequent ones are kept, and its discount is still that of all.
    A language none of whose chosen rows has a letter isn't learned; of more than ``most_langs`` languages the most frequent are.
    """
    spark = train.sparkSession
    known = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not sizes:
        return None
    part = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))])
    share = F.try_element_at(part, F.col("lang"))
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)).withColumn("turn", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(10)))
    # from 20 rows on; below that there is nothing to spare
    few = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(r["count"] < 20))])
    counts = stored(gram_counts(chosen.filter((F.col("turn") > 0) | few[F.col("lang")]), "lang"), "lang-grams")
    # how many groups of a language occur how often: few rows, as frequencies repeat
    told: dict[str, list[tuple[int, int]]] = {}
    for r in counts.groupBy("key", F.least("n", F.lit(10_000)).alias("n")).count().collect():
        told.setdefault(r["key"], []).append((r["n"], r["count"]))
    langs = sorted(told)
    if not langs:
        return None
    quota, least, cuts = max(1000, most_cells // len(langs) ** 2), {}, []
    for lang in langs:
        own, least[lang] = 0, 1
        for n, kinds in sorted(told[lang], reverse=True):
            own += kinds
            if own > quota and own > kinds:
                least[lang] = n + 1
                break
        ones, twos = (dict(told[lang]).get(n, 0) for n in (1, 2))
        cuts.append(discount(ones, twos))
    floor = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(least[lang]))])
    table = counts.filter(F.col("n") >= F.try_element_at(floor, F.col("key"))).select("key", *[F.col("g")[k].alias(f"g{k}") for k in range(ORDER)], "n").orderBy("key", *[f"g{k}" for k in range(ORDER)]).toArrow()
    names, by = table.column("key").to_numpy(), []
    for lang in langs:
        lo, hi = np.searchsorted(names, lang, "left"), np.searchsorted(names, lang, "right")
        own = table.slice(lo, hi - lo)
        by.append(([own.column(f"g{k}").to_numpy().astype(np.uint32) for k in range(ORDER)], own.column("n").to_numpy()))
    model = Model(langs, by, cuts)
    held = spark.sparkContext.broadcast(model)
    seen = entropies(chosen.filter((F.col("turn") == 0) | few[F.col("lang")]).select("id", "lang", "text"), held, ["lang"]).filter("letter").toPandas()
    seen = seen[seen["lang"].isin(langs)]
    heat, far = 1.0, dict.fromkeys(langs, float("inf"))
    if len(seen):
        ce, n, y = np.stack(seen["ce"].to_numpy()), seen["chars"].to_numpy(), seen["lang"].map(langs.index).to_numpy()

        def loss(t: float) -> float:
            p = chances(ce, n, t)[np.arange(len(y)), y]
            return float(-np.log(np.maximum(p, 1e-12)).mean())

        heat = min((0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0), key=loss)
        for j, lang in enumerate(langs):
            if (y == j).sum() >= 20:
                far[lang] = float(np.quantile(ce[y == j, j], 0.99) + 1.0)
    return model, heat, far


def chances(ce: np.ndarray, chars: np.ndarray, heat: float) -> np.ndarray:
    s = -ce * np.minimum(chars, 1000)[:, None] * heat
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """One row a row of ``docs``: id, lang_pred, score, cross_entropy, rejected. Rows for which ``trained`` holds are learned from.

    score is the calibrated probability of lang_pred. Text that is null or has no letter is `und` with score 0. A text whose best cross-entropy
    lies well beyond that of nearly all calibration rows of its language is marked rejected, and keeps its nearest language. Of equal
    cross-entropies the language first by code point wins. Rows that repeat get equal results; a null lang isn't learned;
    an empty table gives no rows; where no row can be learned from, all texts are `und` with score 0. Very long texts are read whole. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    learned = fit(docs.filter(trained).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), **how)
    if learned is None:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected"))
    model, heat, far = learned
    ce = entropies(rows, docs.sparkSession.sparkContext.broadcast(model), ["id"])
    names, limits = F.array(*[F.lit(x) for x in model.langs]), F.array(*[F.lit(far[x]) for x in model.langs])
    best = F.array_min("ce")
    pull = F.least("chars", F.lit(1000)) * heat
    score = 1 / F.aggregate("ce", F.lit(0.0), lambda a, x: a + F.exp((F.col("best") - x) * pull))
    at = F.array_position("ce", F.col("best")).cast("int")
    return (
        ce.withColumn("best", best)
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("letter"), F.element_at(names, at)).otherwise("und").alias("lang_pred"),
            F.when(F.col("letter"), score).otherwise(0.0).alias("score"),
            F.when(F.col("letter"), F.col("best")).alias("cross_entropy"),
            (F.col("letter") & (F.col("best") > F.element_at(limits, at))).alias("rejected"),
        )
    )
