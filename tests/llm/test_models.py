import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm.language_id import Model, characters, gram_counts, identify, parts
from millrace.llm.quality import NAMES, good_documents, isotonic, normal_sums, quality, statistics
from millrace.llm.toxicity import Lexicon, Scanner, Term, toxicity

def odd():
    return F.pmod(F.col("doc_id"), F.lit(2)) == 1


LABELS = "doc_id long, quality int, toxic int"


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


# language


def speak(rng, sounds, n):
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(n))


SOUNDS = {"aa": ["ka", "lo", "mi", "te"], "bb": ["schu", "ern", "gel", "te"], "cc": ["ção", "mi", "nha", "ue"]}


def test_identify_held_out(documents):
    rng = random.Random(21)
    rows = [(i, speak(rng, SOUNDS[lang], rng.randint(5, 60)), lang) for i in range(300) for lang in [list(SOUNDS)[i % 3]]]
    rows += [(1001, None, "aa"), (1000, None, "aa"), (1002, " 12 !", "bb"), (1004, "", None), (1006, speak(rng, SOUNDS["bb"], 90_000).upper(), None), (None, speak(rng, SOUNDS["cc"], 9), None)]
    got = {r.doc_id: r for r in identify(documents(rows), F.coalesce(F.pmod("doc_id", F.lit(4)) != 1, F.lit(False))).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:300]:
        assert got[i].lang_pred == lang and 0 < got[i].score <= 1 and not got[i].rejected
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002, 1004))
    assert got[1006].lang_pred == "bb" and got[None].lang_pred == "cc"


def test_rejection(documents):
    rng = random.Random(22)
    rows = [(i, speak(rng, SOUNDS["aa" if i % 2 else "bb"], 40), "aa" if i % 2 else "bb") for i in range(800)] + [(9000, "qqq zzz xxx vvv " * 20, None)]
    got = {r.doc_id: r for r in identify(documents(rows), F.col("doc_id") < 9000).collect()}
    assert got[9000].rejected and sum(r.rejected for r in got.values()) <= 20


def test_empty_tables(documents):
    assert identify(documents([]), odd()).collect() == []
    for rows in ([(2, "x")], [(1, "x", None), (2, None)], [(1, "12 3"), (2, "z")]):
        got = identify(documents(rows), odd()).collect()
        assert [(r.lang_pred, r.score, r.rejected) for r in got] == [("und", 0.0, False)] * len(rows)


class Plain:
    """Interpolated Kneser-Ney over dictionaries: a group is (character, the one before, ...) within its word."""

    def __init__(self, texts):
        top = Counter()
        for t in texts:
            for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
                for i, c in enumerate(w + "\0"):
                    top[(c, *(w[i - k] if i >= k else "\0" for k in (1, 2, 3)))] += 1
        self.n = {4: top}
        for k in (3, 2, 1):
            self.n[k] = Counter(g[:k] for g in self.n[k + 1])
        self.size = len({g[0] for g in top}) + 1
        self.cut = {k: min(max((ones := sum(v == 1 for v in n.values())) / max(ones + 2 * sum(v == 2 for v in n.values()), 1), 0.1), 0.95) for k, n in self.n.items()}

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / self.size
        same = [v for x, v in self.n[k].items() if x[1:] == g[1:]]
        if not same:
            return self.p(g[:-1])
        return max(self.n[k][g] - self.cut[k], 0) / sum(same) + self.cut[k] * len(same) / sum(same) * self.p(g[:-1])


def test_kneser_ney_against_dictionaries(documents):
    rng = random.Random(27)
    texts = {lang: [speak(rng, SOUNDS[lang], 25) for _ in range(3)] for lang in ("aa", "cc")}
    rows = documents([(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in texts for t in texts[lang])])
    counted = gram_counts(rows.select("lang", "text"), "lang").toPandas()
    by = []
    for lang in texts:
        own = counted[counted["key"] == lang]
        g = np.stack([np.asarray(x) for x in own["g"]]).astype(np.uint32)
        by.append(([g[:, k] for k in range(4)], own["n"].to_numpy()))
    model, plain = Model(list(texts), by), {lang: Plain(t) for lang, t in texts.items()}
    size = len({x for p in plain.values() for g in p.n[1] for x in g}) + 1
    for p in plain.values():
        p.size = size
    for t in ("kalomi tesch", "Zug! mi", "\u00e7\u00e3o kaq"):
        ce, n, _ = model.entropies([t])
        for j, lang in enumerate(texts):
            logs = []
            for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
                for i, c in enumerate(w + "\0"):
                    logs.append(math.log(plain[lang].p((c, *(w[i - k] if i >= k else "\0" for k in (1, 2, 3))))))
            assert n[0] == len(logs) and ce[0, j] == pytest.approx(-sum(logs) / len(logs), rel=1e-4), (t, lang)


def test_long_texts_are_cut_between_words():
    rng = random.Random(28)
    t = speak(rng, SOUNDS["aa"], 3000)
    pieces = [x for _, lot, _ in parts(pa.array([t, "x" * 9000]), most=500, longest=1000) for x in lot]
    n = next(i for i, x in enumerate(pieces) if x.startswith("x"))
    assert "".join(pieces[:n]) == t and all(x[-1].isspace() for x in pieces[: n - 1]) and "".join(pieces[n:]) == "x" * 9000
    whole, cut = characters([t])[0], characters(pieces[:n])[0]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_probabilities_sum_to_one(spark, documents):
    rng = random.Random(23)
    counted = gram_counts(documents([(1, speak(rng, SOUNDS["aa"], 200)), (2, speak(rng, SOUNDS["aa"], 200))]).select(F.lit("aa").alias("lang"), "text"), "lang").toPandas()
    g = np.stack([np.asarray(x) for x in counted["g"]]).astype(np.uint32)
    model = Model(["aa"], [([g[:, k] for k in range(4)], counted["n"].to_numpy())])
    alphabet = np.unique(g[:, 0])
    for past in (("k", "a", "l"), ("a", "\0", "\0"), ("\0", "\0", "\0"), ("z", "z", "z")):
        rows = [alphabet] + [np.full(len(alphabet), ord(c), dtype=np.uint32) for c in past]
        total = np.exp(model.logs(rows)[:, 0].astype(np.float64)).sum()
        # all characters and the one that stands for unseen ones
        assert total + np.exp(model.logs([np.array([1], dtype=np.uint32)] + [x[:1] for x in rows[1:]])[0, 0]) == pytest.approx(1.0, abs=1e-4)


def test_characters_belong_to_their_text():
    past, of, seen = characters(["ab c", "", "1", "d"])
    assert of.tolist() == [0, 0, 0, 0, 0, 3, 3] and seen.tolist() == [True, False, False, True]
    assert [chr(x) for x in past[0]] == ["a", "b", "\0", "c", "\0", "d", "\0"]
    assert [chr(x) for x in past[1]] == ["\0", "a", "b", "\0", "c", "\0", "d"]


# quality


def prose(rng, good):
    words = [rng.choice(["the", "of", "river", "stone", "walks", "bright", "morning", "and"]) for _ in range(rng.randint(5, 120))]
    if good:
        return " ".join(words).capitalize() + "."
    return rng.choice([lambda w: "!! ".join(w).upper(), lambda w: " ".join([w[0]] * 60), lambda w: " ".join(x + "$$%" for x in w)])(words)


def test_quality_held_out(spark, documents):
    rng = random.Random(24)
    rows = [(i, prose(rng, i % 5 < 3)) for i in range(600)] + [(2000, None), (2001, ""), (None, "A fine line."), (0, prose(rng, True))]
    labels = spark.createDataFrame([(i, int(i % 5 < 3), 0) for i in range(600)] + [(5, None, None)], LABELS)
    got = [(r.doc_id, r.score) for r in quality(documents(rows), labels, odd()).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    held = [(s, i % 5 < 3) for i, s in got if i is not None and i < 600 and i % 2 == 0]
    assert auc(held) > 0.97
    kept = good_documents(documents(rows), labels, odd(), least=0.5)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(i % 5 < 3 for i in [r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 600]) > 300


def test_quality_without_labels(spark, documents):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality(documents([(1, "a"), (2, None)]), none, odd()).collect()} == {0.5}
    assert quality(documents([]), none, odd()).collect() == []


def test_statistics():
    x = statistics([b"", b"a", "One two two.\nOne two two.\n\xc3\xa9".encode(), b"   ", b"A" * 2_000_000])
    assert x.shape == (5, len(NAMES)) and np.isfinite(x).all() and not x[0].any()
    at = dict(zip(NAMES, x[2], strict=True))
    assert at["log_words"] == pytest.approx(np.log1p(7)) and at["same_as_before"] == 0 and at["distinct_lines"] == pytest.approx(2 / 3)


def test_normal_sums_and_isotonic(spark):
    from millrace.llm.quality import Kernel

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, len(NAMES))), rng.integers(0, 2, 50).astype(float)
    kernel = Kernel(np.zeros(len(NAMES)), np.ones(len(NAMES)), 2.0, 16, 1)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    a, b = normal_sums(rows, kernel, 2)
    z = kernel(x)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)
    at, rate = isotonic(np.arange(6.0), np.array([0.0, 3, 1, 5, 4, 10]), np.full(6, 10.0))
    assert (np.diff(rate) >= 0).all() and len(at) == 4


# toxicity


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(25)
    terms = [Term("".join(rng.choice("abc") for _ in range(n)), stem) for n in (3, 4, 5, 6, 7, 9, 10) for stem in (False, True) for _ in range(2)]
    lexicon = Lexicon(terms, most_states=200)
    for _ in range(2000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        ok = []
        for k, t in enumerate(terms):
            d = min(levenshtein(w[:n], t.text) for n in range(len(w) + 1)) if t.stem else levenshtein(w, t.text)
            if d <= t.edits():
                ok.append((d, k))
        got = lexicon.match(w)
        assert (got is None) == (not ok) or (got is None and all(terms[k].stem and d for d, k in ok))
        if got and ok:
            assert got[1] >= min(ok)[0] and (got[1], got[0]) in ok or terms[got[0]].stem


def test_scanner_positions_and_quotes():
    s = Scanner([Term("idiot", False), Term("scum", False), Term("lowei", True)])
    text = 'İ you IDIOT, idiott. He said "what an idiot" and left. loweischaft Scum'
    n, hits = s.hits(text)
    assert n == 13
    assert [(text[h[1] : h[2]], h[4], h[5]) for h in hits] == [("IDIOT", 0, False), ("idiott", 1, False), ("idiot", 0, True), ("loweischaft", 0, False), ("Scum", 0, False)]


def test_scanner_reads_words_spelled_with_digits_and_signs():
    s = Scanner([Term("stupid", False), Term("blarghead", False), Term("scum", False)])
    text = "st4pid you $tupid bl4rgh3ad, *stupid* scum_bag a_b st44pid _ 4 $$ x" + "*" * 50_000 + "y" * 50_000
    n, hits = s.hits(text)
    assert [(text[h[1] : h[2]], h[3], h[4]) for h in hits] == [("st4pid", 0, 1), ("tupid", 0, 1), ("bl4rgh3ad", 1, 2), ("stupid", 0, 0), ("scum", 2, 0)]


def insults(rng, toxic):
    words = [rng.choice(["river", "stone", "walks", "bright", "morning", "window", "yellow"]) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(5, 80))]
    for _ in range(toxic * rng.randint(1, 3)):
        words.insert(rng.randrange(len(words)), rng.choice(["blarghead", "snotface", "grumpkin" + rng.choice(["s", "ly", "ish", "dom", "er"])]))
    return " ".join(words)


def test_toxicity_held_out(spark, documents):
    rng = random.Random(26)
    rows = [(i, insults(rng, i % 6 == 0)) for i in range(900)] + [(3000, None), (3001, ""), (3002, "you blargheed grumpkindom"), (None, "stone"), (0, "stone")]
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(900)] + [(7, None, None)], LABELS)
    got = [(r.doc_id, r.score, r.hits) for r in toxicity(documents(rows), labels, odd() | (F.col("doc_id") % 12 == 0)).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s, _ in got)
    held = [(s, i % 6 == 0) for i, s, _ in got if i is not None and 0 < i < 900 and i % 2 == 0 and i % 12]
    assert auc(held) > 0.98
    special = {i: (s, h) for i, s, h in got if i is None or i >= 3000}
    assert special[3002][0] > 0.3 and [h.edits for h in special[3002][1]] == [1, 0]
    assert special[3000][0] == special[3001][0] == special[None][0] < 0.3


def test_scores_do_not_depend_on_order(spark, documents):
    """Copies of rows, several labels of an id, other columns: reordered and dealt anew, everything scores as before.

    Toxicity counts, so its scores are equal; quality adds floating-point numbers in the order of partitions, so its scores agree to 1e-9.
    """
    rng = random.Random(29)
    rows = [(i, insults(rng, i % 6 == 0)) for i in range(300)]
    rows += [(400 + i, rows[i][1]) for i in range(60)] + [(400 + i, rows[i][1]) for i in range(20)]
    marks = [(i, 1, int(i % 6 == 0)) for i in range(300)] + [(i, int(i % 2 == 0), i % 3 == 0) for i in range(60)] + [(400 + i, 1, int(i % 5 == 0)) for i in range(60)]
    marks = [(i, int(q), int(t)) for i, q, t in marks]
    out = []
    for n in (1, 7):
        rng.shuffle(rows)
        rng.shuffle(marks)
        df = documents(rows).repartition(n).selectExpr("*", "1 AS y", "2 AS key", "3 AS score", "'z' AS l_id", "4 AS id")
        labels = spark.createDataFrame(marks, LABELS).repartition(n)
        out.append([sorted((r.doc_id, r.score) for r in f(df, labels, odd() | (F.col("doc_id") % 4 == 0)).collect()) for f in (toxicity, quality)])
    (toxic, good), (toxic_again, good_again) = out
    assert toxic == toxic_again
    assert [i for i, _ in good] == [i for i, _ in good_again]
    assert max(abs(a - b) for (_, a), (_, b) in zip(good, good_again, strict=True)) < 1e-9


def test_unlike_texts_of_one_id_are_judged_apart(spark, documents):
    rng = random.Random(30)
    rows = [(i, prose(rng, i % 5 < 3)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 < 3), 0) for i in range(400)], LABELS)
    rows += [(None, prose(rng, True)), (None, "$$%% !! " * 40), (900, prose(rng, True)), (900, "ZZ!! " * 60)]
    df = documents(rows).selectExpr("*", "1 AS row", "2 AS good", "3 AS __good")
    kept = good_documents(df, labels, F.col("doc_id") < 400, least=0.5)
    assert kept.columns == df.columns
    assert sorted(r.text[:1].isalpha() and not r.text.startswith("ZZ") for r in kept.filter("doc_id IS NULL OR doc_id = 900").collect()) == [True, True]
    assert good_documents(df.limit(0), labels, odd()).collect() == []


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], LABELS)
    assert len({r.score for r in toxicity(documents([(1, "a"), (2, None)]), none, odd()).collect()}) == 1
    assert toxicity(documents([]), none, odd()).collect() == []
