import hashlib
import random

from millrace.llm.chat import chat_windows, escaped, read_back, unescaped

TURNS = "conv_id long, turn long, role string, text string"
CONTROLS = ["<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\\\<s>", "<\\s>"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        learned = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), digest("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(learned), digest(learned))
    return out


def make(rng):
    rows = []
    for c in range(25):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " * rng.randint(0, 10)))
        for t in range(1, rng.randint(2, 30)):
            words = [rng.choice([*CONTROLS, "word", "é", "\n", " "]) for _ in range(rng.choice([0, 5, 40, 700]))]
            rows.append((c, t, "user" if t % 2 else "assistant", "".join(words)))
    return rows + [(77, 0, "assistant", None), (77, 0, None, "x"), (77, 0, None, "x"), (77, None, "user", "first"), (None, 1, "assistant", "a"), (78, 5, "tool\n<s>", "r")]


def test_round_trip(spark):
    rows = make(random.Random(11))
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS win", "2 AS nth", "3 AS tokens")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(chat_windows(df, budget=256, history=48, stretch=4, long_rows=7)).collect()}
    assert got == plain(rows)


def cost(text):
    return -(-len(text) // 4) + 4


def plain_windows(rows, budget, history, cut=None):
    """(conv, number of the first turn, texts repeated, texts of the span, tokens) by a loop; ``cut`` says whether a stretch ends before a turn."""
    convs, out = {}, []
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in convs.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        system, low = turns[0][0] == "system", 0
        while low < len(turns):
            rules = [turns[0][1]] if system and low else []
            room = budget if low == 0 else max(budget - sum(map(cost, rules)), budget // 4)
            first, k = cost(turns[low][1]), low
            limit = history if first > room else min(history, room - first)
            while k > (1 if system else 0) and sum(cost(x) for _, x in turns[k - 1 : low]) <= limit:
                k -= 1
            old = [x for _, x in turns[k:low]]
            used, high = sum(map(cost, old)) + first, low + 1
            while high < len(turns) and used + cost(turns[high][1]) <= room and not (cut and cut(c, high)):
                used += cost(turns[high][1])
                high += 1
            out.append((c, low, rules + old, [x for _, x in turns[low:high]], used + sum(map(cost, rules))))
            low = high
    return out


def as_plain(windows):
    out = []
    for w in windows:
        bodies = [p.split("<|text|>", 1)[1] for p in w.text.split("<|end|>")[:-1]]
        out.append((w.conv_id, w.win, bodies[: w.repeated], bodies[w.repeated :], w.tokens))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def simple(rng):
    """Conversations without control strings, with long turns, too long ones among them."""
    rows = []
    for c in range(30):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " * rng.randint(0, 40)))
        for t in range(1, rng.randint(2, 40)):
            rows.append((c, t, "user" if t % 2 else "assistant", "word " * rng.choice([0, 3, 10, 60, 150, 400])))
    return rows + [(None, 1, "user", "a"), (None, None, "assistant", "b"), (5, 3, "user", "again"), (5, 3, "user", "again")]


def test_windows_against_loop(spark):
    rows = simple(random.Random(12))
    windows = chat_windows(spark.createDataFrame(rows, TURNS), budget=256, history=48).collect()
    want = plain_windows(rows, 256, 48)
    assert as_plain(windows) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1])) and any(w.over_budget for w in windows)
    for w in windows:
        assert w.over_budget == (w.tokens > 256)
        for s in w.loss:
            head = w.text[: s.start]
            assert head.endswith("<|turn|>assistant<|text|>") and w.text[s.end :].startswith("<|end|>") and head.count("<|end|>") >= w.repeated


def test_parts_carry_history(spark):
    """Conversations dealt over parts: a window ends with its part, and its history and system turn come from the parts before."""
    rows = [(1, 0, "system", "rules")] + [(1, t, "user" if t % 2 else "assistant", "x" * (t % 9)) for t in range(1, 60)]
    rows += [(None, 10 * t, "user" if t % 2 else "assistant", "y" * (t % 5)) for t in range(25)]
    windows = chat_windows(spark.createDataFrame(rows, TURNS), budget=60, history=30, long_rows=8, stretch=4).collect()
    assert {w.conv_id: w.parts for w in windows} == {1: 8, None: 4}
    starts = {1: {8 * k for k in range(1, 8)}, None: {7, 13, 19}}
    got = as_plain(windows)
    assert [g for g in got if g[0] == 1] == [w for w in plain_windows(rows, 60, 30, lambda c, i: i in starts[c]) if w[0] == 1]
    assert [g for g in got if g[0] is None] == [w for w in plain_windows(rows, 60, 30, lambda c, i: i in starts[c]) if w[0] is None]


def test_very_long_texts_and_other_columns(spark):
    rows = [(1, 1, "user", "é" * 300_000, 5), (1, 2, "assistant", "z" * 300_000, 6), (1, 3, "user", None, 7)]
    df = spark.createDataFrame(rows, TURNS + ", key int").selectExpr("*", "1 AS part", "'x' AS p", "2 AS parts", "3 AS before")
    windows = chat_windows(df).orderBy("win").collect()
    assert [w.repeated for w in windows] == [0, 0, 0] and [w.over_budget for w in windows] == [True, True, False]
    assert read_back(chat_windows(df)).first()[1:] == plain([r[:4] for r in rows])[1] + (sum(len(w.text) for w in windows),)


def test_escape(spark):
    texts = [*CONTROLS, "a<|b", "[INST", "<", "<|", "", "[[INST]]", "\\<|end|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped("t").alias("e")).select("t", "e", unescaped("e").alias("u"))
    for r in df.collect():
        assert r.u == r.t and "<|" not in r.e and "[INST]" not in r.e and "</s>" not in r.e


def test_empty(spark):
    assert chat_windows(spark.createDataFrame([], TURNS)).collect() == []
