import random

from millrace.llm.decontaminate import Pattern, budget, decontaminated, find_items, normalised, pieces

ITEMS = "item_id long, text string"


def distance(item, text):
    """Edits between the item and its nearest stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_against_table():
    rng = random.Random(5)
    for _ in range(200):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (12, 40))
        got = Pattern(item).best(text, len(item))
        assert got[0] == min(distance(item, text), len(item))


def mangled(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        if (op := rng.choice("sid")) == "s":
            s[i] = rng.choice("xyz")
        elif op == "i":
            s.insert(i, "q")
        else:
            del s[i]
    return "".join(s)


def test_finds_all_within_budget(spark, documents):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(8)] + [(90, None), (91, "")]
    rows = []
    for i in range(60):
        item = items[i % 8][1]
        k = budget(len(normalised(item)), 0.1, 12)
        filler = [" ".join(word() for _ in range(30)) for _ in range(2)]
        rows.append((i, f"{filler[0]}\n {mangled(rng, item.upper() if i % 3 else item, i % (k + 4))} {filler[1]}"))
    rows += [(100, None), (101, ""), (102, " ".join(word() for _ in range(20_000)) + items[0][1]), (1, rows[1][1])]
    got = find_items(documents(rows), spark.createDataFrame(items, ITEMS), most_chars=300).collect()
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.item_id), r)
    for i, t in rows[:-2]:
        for j, x in items[:8]:
            d, k = distance(normalised(x), normalised(t or "")) if i < 102 else 999, budget(len(normalised(x)), 0.1, 12)
            if i < 102:
                assert ((i, j) in found) == (d <= k), (i, j, d, k)
                if d <= k:
                    r = found[i, j]
                    assert r.distance == d and distance(normalised(x), normalised(t)[r.start : r.end]) == d
    assert (102, 0) in found
    clean = decontaminated(documents(rows), spark.createDataFrame(items, ITEMS)).collect()
    dirty = {i for i, _ in found}
    assert sorted(r.doc_id for r in clean) == sorted(i for i, _ in rows if i not in dirty)


def test_the_whole_rate_is_allowed(spark, documents):
    rng = random.Random(13)
    items = [(n, "".join(rng.choice("abcdefghij") for _ in range(n))) for n in (12, 20, 35, 81, 120, 233)]
    rows, want = [], set()
    for n, t in items:
        for more in (0, 1):
            k = n // 10 + more
            cut = [n * (2 * i + 1) // (2 * k) for i in range(k)]
            rows.append((len(rows), "".join("#" if i in cut else c for i, c in enumerate(t))))
            if not more:
                want.add((len(rows) - 1, n))
    got = find_items(documents(rows), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.distance == r.budget for r in got)
    assert {r.doc_id for r in decontaminated(documents(rows), spark.createDataFrame(items, ITEMS)).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_item_ids_that_repeat_or_are_null(spark, documents):
    rng = random.Random(15)
    texts = ["".join(rng.choice("abcdefghijklm") for _ in range(60)) for _ in range(5)]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (2, texts[4])], ITEMS)
    docs = documents([(i, f"before {t} after") for i, t in enumerate(texts)] + [(9, "clean"), (10, " ".join(texts))])
    got = find_items(docs, items).collect()
    each = [1, 1, None, None, 2, 2]
    assert sorted(map(str, ((r.doc_id, r.item_id) for r in got))) == sorted(map(str, [(min(i, 4), x) for i, x in enumerate(each)] + [(10, x) for x in each]))
    assert all(r.distance == 0 for r in got)
    assert [r.doc_id for r in decontaminated(docs, items).collect()] == [9]


def test_pieces_cover():
    assert "".join(p for _, p in pieces("abcdefghij", 3)) == "abcdefghij" and len(pieces("abcdefghij", 3)) == 4


def test_empty(spark, documents):
    none = spark.createDataFrame([], ITEMS)
    assert find_items(documents([(1, "a")]), none).collect() == [] and find_items(documents([]), none).collect() == []
    assert len(decontaminated(documents([(1, "a"), (2, None)]), none).collect()) == 2


def test_items_of_any_id_and_clashing_columns(spark, documents):
    item = "the quick brown fox jumps over the lazy dog by the old river bank"
    bench = spark.createDataFrame([("q-1", item), (None, "short one two"), ("q-2", None)], "item_id string, text string")
    df = documents([(1, f"so {item}!"), (2, None), (3, "a short one two"), (4, "x " * 300_000 + item)]).selectExpr("*", "1 AS item_id", "2 AS id", "3 AS distance")
    assert sorted((r.doc_id, r.item_id or "") for r in find_items(df, bench).collect()) == [(1, "q-1"), (3, ""), (4, "q-1")]
    kept = decontaminated(df, bench)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [2]
    assert decontaminated(df.limit(0), bench).collect() == [] and decontaminated(df, bench.limit(0)).count() == 4
