"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose spans that begin and end at turns. Each window repeats the system turn and a limited history before
its span; only assistant texts of the span itself are under the loss mask, so a text is learned once. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
# what the templates in use take for control: <|...|>, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escaped(text: str | Column) -> Column:
    """Doubles each backslash and puts one inside each control string, so no control string is left; ``unescaped`` reverts it."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescaped(text: str | Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def slim(x: Column) -> Column:
    return F.struct(x["nth"].alias("nth"), x["before"].alias("before"), x["piece"].alias("piece"))


def stretches(dealt: DataFrame, offset: DataFrame, cost: Column, size: int, history: int) -> DataFrame:
    """A row for each ``size`` turns of a part: its turns in order with their prefix sums, its tail (the last turns of ``history`` tokens), the tail before it, and the system turn where the part holds it."""
    own = Window.partitionBy("key", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "raw")
    placed = dealt.select("key", "conv_id", "part", "turn", "role", "raw", cost.alias("tokens")).repartition("key", "part")
    placed = placed.select("*", (F.row_number().over(own) - 1).alias("r"), F.coalesce(F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    placed = placed.join(F.broadcast(offset), (F.col("key") == F.col("o_key")) & (F.col("part") == F.col("o_part")), "left")
    nth, before = (F.col("r") + F.coalesce("rows", F.lit(0))).alias("nth"), (F.col("b") + F.coalesce("cost", F.lit(0))).alias("before")
    head, body = F.concat(F.lit(TURN), escaped("role"), F.lit(BODY)), escaped("raw")
    rows = placed.select(
        "key", "conv_id", "part", F.coalesce("parts", F.lit(1)).alias("parts"), F.floor(F.col("r") / size).alias("seg"), nth, before, "tokens", (F.col("role") == "assistant").alias("learn"),
        (F.col("role") == "system").alias("rules"), head.alias("head"), body.alias("body"),
    ).select(
        "key", "conv_id", "part", "parts", "seg", "before", "tokens", ((F.col("nth") == 0) & F.col("rules")).alias("system"),
        F.struct("nth", "before", "tokens", "learn", F.length("head").alias("skip"), F.length("body").alias("chars"), F.concat("head", "body", F.lit(END)).alias("piece")).alias("x"),
    )
    segs = rows.groupBy("key", "part", "seg").agg(
        F.max("conv_id").alias("conv_id"), F.max("parts").alias("parts"), F.sort_array(F.collect_list("x")).alias("p"), F.max(F.when(F.col("system"), F.struct("x.tokens", "x.piece"))).alias("system"), F.max(F.col("before") + F.col("tokens")).alias("end")
    )
    first = F.when(F.col("system").isNotNull(), F.element_at("p", 1)["nth"]).otherwise(-1)
    tail = F.transform(F.filter("p", lambda x: (x["before"] >= F.col("end") - history) & (x["nth"] != first)), slim)
    here = Window.partitionBy("key", "part").orderBy("seg")
    segs = segs.withColumn("tail", tail)
    return segs.select(
        "key", "part", "seg", "conv_id", "parts", "p", "tail", F.first("system").over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("system"),
        F.lag("tail").over(here).alias("back"), F.lead("seg").over(here).isNull().alias("last"),
    )


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 192, overhead: int = 4, stretch: int = 512, long_rows: int = 8192, most_long: int = 10_000) -> DataFrame:
    """A row a window: conv_id, win, text, loss (array of start and end, code points, end exclusive), repeated, tokens, over_budget, key, part, parts.

    ``turns``: conv_id, turn, role, text; null role or text counts as empty. Turns go by turn (null first), then role, then text; rows that
    repeat are turns of their own. A turn costs a token a started four code points, plus ``overhead`` (1 at least). Prefix sums of these costs choose the spans: a window begins
    with the first turn that the one before has no room for, and takes the turns that follow while they fit ``budget``. A first turn by role
    system is repeated in every window; of what comes before the span, the last turns of ``history`` tokens at most are repeated too, as far as the first turn of the span leaves
    room for them. Repeated turns have no loss, and ``repeated`` counts them. A turn that doesn't fit the budget has a window of its own, after its history; there, and where
    the system turn leaves less than a quarter of the budget for the rest, over_budget may be true. ``win`` is the number of the first turn of the span in its conversation.
    An empty table gives no rows; other columns aren't read.

    Texts are shuffled once, by conversation, and assembled where they meet, in stretches of ``stretch`` turns; a window ends with its stretch. A conversation of over
    max(``long_rows``, rows / ``most_long``) turns is dealt by turn number over ``parts``, so at most ``most_long`` are that long, which bounds what is broadcast. ``key`` names a conversation, null ones too;
    rows are partitioned by key and part.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    named = turns.select(F.to_json(F.struct("conv_id")).alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("raw"))
    cost = (F.ceil(F.length("raw") / 4) + max(1, overhead)).cast("long")
    least = max(long_rows, turns.count() // most_long)
    hot = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("turn"), F.lit(0)).alias("low"), F.coalesce(F.max("turn"), F.lit(0)).alias("high")).filter(F.col("n") > least)
    hot = hot.select(F.col("key").alias("h_key"), "low", F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / least)).alias("width"))
    at = F.coalesce(F.floor((F.col("turn") - F.col("low")) / F.col("width")), F.lit(0)).cast("int")
    dealt = named.join(F.broadcast(hot), F.col("key") == F.col("h_key"), "left").select("key", "conv_id", "turn", "role", "raw", at.alias("part"), F.col("h_key").isNotNull().alias("long"))
    # what a long conversation holds before each of its parts: one row a part
    inside = dealt.filter("long").groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum(cost).alias("cost"))
    past = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = inside.select(
        F.col("key").alias("o_key"), F.col("part").alias("o_part"), F.coalesce(F.sum("rows").over(past), F.lit(0)).alias("rows"), F.coalesce(F.sum("cost").over(past), F.lit(0)).alias("cost"),
        F.count(F.lit(1)).over(Window.partitionBy("key")).alias("parts"),
    )

    size = max(stretch, history // max(1, overhead) + 1)
    segs = stretches(dealt, offset, cost, size, history)
    # what parts of long conversations take over from the parts before: the system turn, and as much history as any window may repeat
    ends = stretches(dealt.filter("long"), offset, cost, size, history).filter("last").select("key", "part", "tail", "system")
    few = Window.partitionBy("key").orderBy("part").rowsBetween(-size, -1)
    start = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.select(F.col("key").alias("c_key"), F.col("part").alias("c_part"), F.flatten(F.collect_list("tail").over(few)).alias("c_back"), F.first("system").over(start).alias("c_system"))
    # the left side stays where it is: it is partitioned by these keys
    segs = segs.join(carried, (F.col("key") == F.col("c_key")) & (F.col("part") == F.col("c_part")), "left")
    none = F.array().cast("array<struct<nth:bigint,before:bigint,piece:string>>")
    segs = segs.select("key", "part", "parts", "conv_id", "p", F.coalesce("system", "c_system").alias("system"), F.coalesce("back", F.when(F.col("seg") == 0, F.col("c_back")), none).alias("back"))
    segs = segs.withColumn("sys", F.coalesce("system.tokens", F.lit(0))).withColumn("befores", F.concat(F.transform("back", lambda x: x["before"]), F.transform(F.filter("p", lambda x: (x["nth"] > 0) | F.col("system").isNull()), lambda x: x["before"])))

    def room(x: Column) -> Column:
        return F.when(x["nth"] == 0, budget).otherwise(F.greatest(budget - F.col("sys"), F.lit(budget // 4))).cast("long")

    def step(a: Column, x: Column) -> Column:
        most = F.when(x["tokens"] > room(x), history).otherwise(F.least(F.lit(history), room(x) - x["tokens"]))
        since = F.coalesce(F.array_min(F.filter("befores", lambda b: (b >= x["before"] - most) & (b <= x["before"]))), x["before"])
        new = F.struct(a["i"].alias("i"), since.alias("since"))
        return F.when(
            (F.size(a["starts"]) > 0) & (x["tokens"] <= a["left"]), F.struct((a["i"] + 1).alias("i"), (a["left"] - x["tokens"]).alias("left"), a["starts"].alias("starts"))
        ).otherwise(
            F.struct((a["i"] + 1).alias("i"), (room(x) - x["tokens"] - x["before"] + since).alias("left"), F.concat(a["starts"], F.array(new)).alias("starts"))
        )

    zero = F.struct(F.lit(1).alias("i"), F.lit(0).cast("long").alias("left"), F.array().cast("array<struct<i:int,since:bigint>>").alias("starts"))
    segs = segs.withColumn("starts", F.aggregate("p", zero, step, lambda a: a["starts"]))

    def window(s: Column, k: Column) -> Column:
        own_ = F.slice("p", s["i"], F.coalesce(F.get("starts", k + 1)["i"], F.size("p") + 1) - s["i"])
        low = F.element_at(own_, 1)
        again = F.when(F.col("system").isNotNull() & (low["nth"] > 0), F.array(F.col("system.piece"))).otherwise(F.array().cast("array<string>"))
        old = F.concat(F.col("back"), F.transform(F.slice("p", 1, s["i"] - 1), slim))
        old = F.filter(old, lambda x: (x["before"] >= s["since"]) & ((x["nth"] > 0) | F.col("system").isNull()))
        lead = F.concat(again, F.transform(old, lambda x: x["piece"]))
        return F.struct(
            low["nth"].alias("win"), lead.alias("lead"), own_.alias("own"),
            (F.when(F.size(again) > 0, F.col("sys")).otherwise(0) + low["before"] - s["since"] + F.aggregate(own_, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])).alias("tokens"),
        )

    wins = segs.select("key", "part", "parts", "conv_id", F.explode(F.transform("starts", window)).alias("w")).select("key", "part", "parts", "conv_id", "w.*")
    loss = F.aggregate(
        "own",
        F.struct(F.length(F.array_join("lead", "")).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["piece"])).alias("at"),
            F.when(x["learn"], F.concat(a["loss"], F.array(F.struct((a["at"] + x["skip"]).alias("start"), (a["at"] + x["skip"] + x["chars"]).alias("end"))))).otherwise(a["loss"]).alias("loss"),
        ),
        lambda a: a["loss"],
    )
    return wins.select(
        "conv_id", "win", F.concat(F.array_join("lead", ""), F.array_join(F.transform("own", lambda x: x["piece"]), "")).alias("text"), loss.alias("loss"), F.size("lead").alias("repeated"),
        "tokens", (F.col("tokens") > budget).alias("over_budget"), "key", "part", "parts",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say, a row a conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's texts come together for its digests, as they must. Those of one part are digested where they lie; only parts of long conversations are moved.
    """
    pieces = F.split("text", r"<\|end\|>", -1)
    own = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    role = lambda x: unescaped(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), BODY, 1))
    body = lambda x: unescaped(F.substring(x, F.instr(x, BODY) + len(BODY), F.lit(1 << 30)))
    said = windows.select(
        "key", "part", "parts", "conv_id", "win", F.size(own).alias("turns"),
        F.array_join(F.transform(own, lambda x: F.concat(role(x), F.lit("\n"), body(x), F.lit("\n"))), "").alias("said"),
        F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "").alias("learned"),
        F.length("text").alias("chars"),
    )
    joined = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    listed = F.sort_array(F.collect_list(F.struct("win", "said", "learned"))).alias("w")
    of_part = said.groupBy("key", "part").agg(F.max("conv_id").alias("conv_id"), F.max("parts").alias("parts"), listed, F.sum("turns").alias("turns"), F.sum("chars").alias("chars"))
    of_part = of_part.select("key", "part", "conv_id", "parts", "turns", "chars", joined("said").alias("said"), joined("learned").alias("learned"))
    alone = F.col("parts") == 1
    of_part = of_part.select(
        "key", "conv_id", "turns", "chars", F.when(alone, F.sha2("said", 256)).alias("t"), F.when(alone, F.sha2("learned", 256)).alias("l"), F.length("learned").cast("long").alias("n"),
        F.when(~alone, F.struct("part", "said", "learned")).alias("w"),
    )
    whole = of_part.groupBy("key").agg(
        F.max("conv_id").alias("conv_id"), F.sum("turns").alias("n_turns"), F.max("t").alias("t"), F.sum("n").alias("loss_chars"), F.max("l").alias("l"),
        F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("w"),
    )
    return whole.select(
        "conv_id", F.col("n_turns").cast("long"), F.coalesce("t", F.sha2(joined("said"), 256)).alias("turns_sha256"), F.col("loss_chars").cast("long"),
        F.coalesce("l", F.sha2(joined("learned"), 256)).alias("loss_sha256"), F.col("formatted_chars").cast("long"),
    )
