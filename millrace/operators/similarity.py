"""Trigram similarity joins, greedy removal of near duplicates, and the contradiction check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from millrace.functions.scalars import estimate_tokens
from millrace.functions.text import ANTONYMS, compress_budget, content_words, directive_lines, is_negated, parsed_rewrite, too_short_to_compress, trigrams, words
from millrace.sources.registry import settled

#: Fixed: the widest signature, and how many rows a comparison of signatures holds on either side.
MOST_BITS, BLOCK, SPAN = 1 << 17, 128, 1024


def gram_classes(items: DataFrame, key: str = "id", text: str = "body") -> DataFrame:
    """key, rep: the smallest key among the items with the same set of trigrams. Any number of copies costs one row a partition."""
    named = items.select(F.col(key).alias("k"), gram_key(trigrams(text)).alias("c"))
    return named.join(named.groupBy("c").agg(F.min("k").alias("rep")), "c").select(F.col("k").alias(key), "rep")


def gram_key(grams: Column) -> Column:
    # trigrams hold letters, digits and blanks only
    return F.sha2(F.array_join(F.array_sort(grams), "|"), 256)


def similar_pairs(items: DataFrame, threshold: float, key: str = "id", text: str = "body") -> DataFrame:
    """a, b (a < b), similarity of all pairs of representatives (``gram_classes``) whose Jaccard over trigrams exceeds ``threshold``; exact.

    Sets are compared by signatures first: bits that each hold the parity of the grams hashed to them, so two signatures differ in no more bits than their sets differ in
    grams. Every pair of sizes that may resemble is tried, at some nanoseconds each; those that pass are compared in full.
    """
    all_ = items.select(F.col(key).alias("k"), trigrams(text).alias("g"))
    sets = settled(all_.groupBy(gram_key(F.col("g")).alias("c")).agg(F.min("k").alias("k"), F.any_value("g").alias("g")).select("k", "g"), "sets")
    pairs = close_signatures(sets, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).transform(settled)
    met = sets.join(pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct(), "k", "left_semi")
    full = pairs.join(met.select(F.col("k").alias("a"), F.col("g").alias("ga")), "a").join(met.select(F.col("k").alias("b"), F.col("g").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return full.select("a", "b", (both / (F.size("ga") + F.size("gb") - both)).alias("similarity")).filter(F.col("similarity") > threshold)


def close_signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: every pair of sets (k, g) whose Jaccard may exceed ``threshold`` by their signatures, once in either order.

    A signature has a power of two of bits, twice the grams at least; halves of it combined give the narrower one. Signatures and keys, about a quarter byte a gram and 32
    bytes at least a set, go through the driver to all executors.
    """
    spark, kind = sets.sparkSession, sets.schema["k"].dataType
    at = sets.filter("g IS NOT NULL").select("k", F.transform("g", lambda x: F.pmod(F.xxhash64(x), F.lit(MOST_BITS)).cast("int")).alias("p"))
    got = at.mapInArrow(signed, StructType([StructField("k", kind), StructField("n", IntegerType()), StructField("s", BinaryType())])).toArrow()
    n = got["n"].to_numpy().astype(np.int32)
    order = np.argsort(n, kind="stable")
    keys, n, raw = got["k"].take(pa.array(order)).combine_chunks(), n[order], got["s"].take(pa.array(order))
    width = np.fromiter((len(x.as_py()) // 8 for x in raw), np.int32, len(raw))
    # widths grow with sizes, so those of one width lie together
    starts = {int(w): int(np.searchsorted(width, w)) for w in np.unique(width)}
    words = {w: np.frombuffer(b"".join(raw[s : s + int((width == w).sum())].to_pylist()), np.uint64).reshape(-1, w) for w, s in starts.items()}
    blocks = [(w, i) for w in words for i in range(0, len(words[w]), BLOCK)]
    shared = spark.sparkContext.broadcast((n, starts, words, blocks, keys))

    def compare(batches):
        n, starts, words, blocks, keys = shared.value
        for batch in batches:
            for b in batch.column(0).to_pylist():
                w, at = blocks[b]
                for i, j in near_rows(n, starts, words, w, at, threshold):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), keys.take(pa.array(j))], names=["a", "b"])

    tasks = spark.range(0, len(blocks), 1, max(1, min(len(blocks), 512)))
    return tasks.mapInArrow(compare, StructType([StructField("a", kind), StructField("b", kind)]))


def signed(batches):
    """k, n and the signature of each set (k, p: its grams' places)."""
    for batch in batches:
        n, out = [], []
        for p in batch.column(1):
            x = p.values.to_numpy()
            bits = min(MOST_BITS, max(256, 1 << (2 * len(x) - 1).bit_length()))
            out.append(np.packbits((np.bincount(x & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes())
            n.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(out, pa.binary())], names=["k", "n", "s"])


def halved(x: np.ndarray) -> np.ndarray:
    return x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]


def near_rows(n, starts, words, w: int, at: int, threshold: float):
    """Rows (i < j, by size) with i in the block ``at`` of width ``w``, whose signatures differ in as few bits as those of sets beyond ``threshold`` may."""
    share = (1 - threshold) / (1 + threshold)
    own = words[w][at : at + BLOCK]
    base = starts[w] + at
    most = n[base + len(own) - 1] / threshold if threshold > 0 else np.inf
    for v, other in words.items():
        if v < w:
            continue
        begin = max(0, base + 1 - starts[v])
        end = int(np.searchsorted(n[starts[v] : starts[v] + len(other)], most, side="right"))
        for c in range(begin, end, SPAN):
            part = other[c : min(c + SPAN, end)]
            while part.shape[1] > w:
                part = halved(part)
            i, j = base + np.arange(len(own)), starts[v] + c + np.arange(len(part))
            limit = np.floor((n[i][:, None] + n[j][None, :]) * share + 1e-9).astype(np.int32)
            x, y = (halved(own), halved(part)) if w > 4 else (own, part)
            diff = np.zeros(limit.shape, np.int32)
            for k in range(x.shape[1]):
                diff += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
            p, q = np.nonzero((diff <= limit) & (i[:, None] < j[None, :]) & (n[i][:, None] > threshold * n[j][None, :] - 1e-6))
            if w > 4 and len(p):
                fine = np.bitwise_count(own[p] ^ part[q]).sum(axis=1, dtype=np.int32) <= limit[p, q]
                p, q = p[fine], q[fine]
            if len(p):
                yield i[p], j[q]


def similar_classes(items: DataFrame, threshold: float, key: str = "id", text: str = "body") -> DataFrame:
    """key, rep, links: each item's representative, and how many other representatives that one resembles."""
    pairs = similar_pairs(items, threshold, key, text)
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return gram_classes(items, key, text).join(ends, "rep", "left").select(key, "rep", F.coalesce("links", F.lit(0)).alias("links"))


def greedy_dedup(items: DataFrame, threshold: float, key: str = "id", text: str = "body", order: str = "id") -> DataFrame:
    """Items kept in ``order`` when they resemble no item kept before: ids with kept and the kept item that stands for them.

    Items with the same trigrams are folded first. One is settled once all similar ones before it are settled: kept if none of them
    is kept. Rounds go on until all are settled, each from a written table.
    """
    base = settled(items.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("x"), gram_key(trigrams(text)).alias("c")), "base")
    first = base.groupBy("c").agg(F.min_by("k", F.struct("o", "k")).alias("lead"))
    lead = settled(base.select("k", "o", "x", "c").join(first, "c").select("k", "o", "x", "lead"), "leads")
    ones = lead.filter("k = lead")
    pairs = similar_pairs(ones, threshold, "k", "x")
    at = ones.select("k", F.struct("o", "k").alias("p"))
    e = pairs.join(at.select(F.col("k").alias("a"), F.col("p").alias("pa")), "a").join(at.select(F.col("k").alias("b"), F.col("p").alias("pb")), "b")
    first = F.col("pa") < F.col("pb")
    edges = e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")).transform(settled)
    # who resembles nobody is kept; only the others go through rounds
    alone = ones.select("k").join(edges.select(F.col("u").alias("k")).union(edges.select(F.col("v").alias("k"))).distinct(), "k", "left_anti")
    kind = ones.schema["k"].dataType
    tied = ones.select("k").join(alone, "k", "left_anti")
    state = tied.select("k", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast(kind).alias("by")).transform(settled)
    while not state.filter("kept IS NULL").isEmpty():
        seen = edges.join(state.select(F.col("k").alias("u"), F.col("kept").alias("ku")), "u").groupBy("v").agg(
            F.bool_or(F.coalesce("ku", F.lit(False))).alias("hit"), F.bool_and(F.col("ku").isNotNull()).alias("done"), F.min(F.when(F.col("ku"), F.col("u"))).alias("u")
        )
        j = state.join(seen.withColumnRenamed("v", "k"), "k", "left")
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(F.coalesce("done", F.lit(True)), True)
        state = j.select("k", new.alias("kept"), F.coalesce("by", "u").alias("by")).transform(settled)
    state = state.unionByName(alone.select("k", F.lit(True).alias("kept"), F.lit(None).cast(kind).alias("by")))
    told = lead.join(state.withColumnRenamed("k", "s"), F.col("lead") == F.col("s"))
    return told.select(F.col("k").alias(key), (F.col("kept") & (F.col("k") == F.col("lead"))).alias("kept"), F.when(F.col("kept"), F.col("lead")).otherwise(F.col("by")).alias("stands_for"))


def plan_import(incoming: DataFrame, active: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Incoming rules (id, body) with what becomes of them: added, or a copy of an active rule or of one before."""
    both = active.select(F.lit(0).alias("o"), (-F.col("id") - 1).alias("id"), "body").unionByName(incoming.select(F.lit(1).alias("o"), "id", "body"))
    ranked = both.withColumn("rank", F.struct("o", "id"))
    # active rules stand whatever resembles them
    pairs, named = similar_pairs(both, threshold), gram_classes(both)
    like = pairs.filter("a < 0").select("b").union(named.filter("rep < 0").select("rep")).distinct().withColumnRenamed("b", "rep")
    hit = named.filter("id >= 0").join(like, "rep", "left_semi").select("id")
    left = ranked.filter("o = 1").join(hit, "id", "left_anti").drop("o", "rank")
    kept = greedy_dedup(left, threshold).select("id", "kept")
    return incoming.join(hit.withColumn("old", F.lit(True)), "id", "left").join(kept, "id", "left").select(*incoming.columns, F.when(F.col("old"), "duplicate").when(F.col("kept"), "add").otherwise("duplicate").alias("action"))


def contradictions(rules: DataFrame, documents: DataFrame) -> DataFrame:
    """For each rule (id, body) that a line of the documents (doc_id, text) speaks against, the first such line: rule_id, doc_id, line_no, line, reason.

    A line conflicts if it shares two content words at opposite polarity, or one and an antonym. Rules and lines that hold the same words are one; of equal lines the first
    counts. Two that share two words share one besides the rule's most frequent word, so that word leads to no candidates there; it does only for the few lines and rules
    with words that have antonyms. Candidates are compared in full.
    """
    marks = sorted({w for p in ANTONYMS for w in p})
    antonyms = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ANTONYMS])
    parts = lambda t: (F.array_sort(content_words(t)).alias("c"), is_negated(t).alias("n"), F.array_sort(F.array_distinct(F.filter(words(t), lambda w: w.isin(*marks)))).alias("m"))
    key = F.sha2(F.concat_ws("|", F.array_join("c", " "), F.col("n").cast("string"), F.array_join("m", " ")), 256)
    told = rules.select(F.col("id").alias("rule_id"), *parts("body")).withColumn("rule", key)
    r = told.groupBy("rule").agg(*[F.any_value(x).alias(f"r{x}") for x in "cnm"]).filter(F.size("rc") > 0)
    said = documents.select("doc_id", F.posexplode(directive_lines("text")).alias("line_no", "line")).select(F.struct("doc_id", "line_no", "line").alias("at"), *parts("line")).filter(F.size("c") > 0)
    said = said.groupBy(key.alias("text")).agg(F.min("at").alias("at"), *[F.any_value(x).alias(f"l{x}") for x in "cnm"])
    asked = r.select("rule", "rn", F.size("rc").alias("size"), F.size("rm").alias("rm"), F.explode("rc").alias("w"))
    posted = said.select("text", "ln", F.size("lm").alias("lm"), F.explode("lc").alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    freq = posted.groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    ranked = asked.join(freq, "w").withColumn("nth", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("f"), "w")))
    both = ranked.join(posted, "w").filter(((F.col("nth") > 1) & (F.col("rn") != F.col("ln"))) | ((F.col("rm") > 0) & (F.col("lm") > 0))).select("rule", "text").distinct()
    j = both.join(r, "rule").join(said, "text").withColumn("shared", F.size(F.array_intersect("rc", "lc")))
    pair = F.get(F.filter(antonyms, lambda p: (F.array_contains("rm", p[0]) & F.array_contains("lm", p[1])) | (F.array_contains("rm", p[1]) & F.array_contains("lm", p[0]))), 0)
    reason = F.when((F.col("shared") >= 2) & (F.col("rn") != F.col("ln")), F.concat(F.lit("shares "), F.col("shared").cast("string"), F.lit(" key terms with an opposite-polarity directive"))).when(
        pair.isNotNull(), F.concat(F.lit('uses "'), F.array_join(pair, '"/"'), F.lit('" against a shared-topic directive'))
    )
    found = j.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("rule").agg(F.min_by(F.struct("at.*", "reason"), "at").alias("f"))
    return told.join(found, "rule").select("rule_id", "f.*")


def compressed_rules(asked: DataFrame, rules: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Rewrites of rules (agent, rule_id, reply): the candidate row that each would add, or the reason why it is refused.

    Refused, in this order: a rule that the agent doesn't have, one that isn't active, one whose half is shorter than any rule may be, a reply that is no valid rewrite, a
    rewrite of over half the rule's length, and one that resembles a rule of the agent by over ``threshold`` (the smallest id is named). A candidate replaces the rule,
    and its cost is that of its own body.
    """
    of = rules.select("agent", F.col("id").alias("rule_id"), "status", F.col("body").alias("old"), F.col("context_cost").alias("old_cost"), F.col("source_run"))
    j = asked.join(of, ["agent", "rule_id"], "left").withColumn("body", parsed_rewrite("reply"))
    early = (
        F.when(F.col("status").isNull(), "no such rule").when(F.col("status") != "active", F.concat(F.lit("rule is "), F.col("status"))).when(too_short_to_compress("old"), "too short to compress")
        .when(F.col("body").isNull(), "invalid rewrite").when(F.length("body") > compress_budget("old"), "not within half of the original")
    )
    # only rewrites that nothing else refuses meet the rules of their own agent, each distinct one once
    j = j.withColumn("early", early)
    new = settled(j.filter("early IS NULL").select("agent", "rule_id", trigrams("body").alias("g")).withColumn("c", gram_key(F.col("g"))), "rewrites")
    known = rules.filter("body IS NOT NULL").select("agent", "id", trigrams("body").alias("g")).withColumn("c", gram_key(F.col("g"))).groupBy("agent", "c").agg(F.min("id").alias("like_id"), F.any_value("g").alias("g"))
    met = resembling(new.groupBy("agent", "c").agg(F.any_value("g").alias("g")), known.select("agent", "like_id", "g"), threshold)
    alike = new.select("agent", "rule_id", "c").join(met, ["agent", "c"]).select("agent", "rule_id", "like_id")
    reason = F.coalesce("early", F.when(F.col("like_id").isNotNull(), F.concat(F.lit("near-duplicate of rule "), F.col("like_id").cast("string"))))
    return j.join(alike, ["agent", "rule_id"], "left").withColumn("reason", reason).select(
        "agent", "rule_id", "reason", *[F.when(F.col("reason").isNull(), x).alias(n) for n, x in (("body", F.col("body")), ("context_cost", estimate_tokens("body")), ("replaces", F.col("rule_id")), ("source_run", F.col("source_run")))]
    )


def resembling(new: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """agent, c, like_id: for each set of grams (agent, c, g) the smallest id of the agent's known ones (agent, like_id, g) whose Jaccard exceeds ``threshold``, where one does; exact.

    As in ``similar_pairs`` both are listed under their rarest grams, and pairs whose sizes or places rule it out aren't compared. Known sets of a size that resembles none of
    the agent's new ones aren't listed.
    """
    new, known = new.withColumn("n", F.size("g")), known.withColumn("n", F.size("g"))
    sizes = new.groupBy("agent").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    known = known.join(sizes, "agent").filter((F.col("n") >= F.col("low") * threshold - 1e-6) & (F.col("n") * threshold <= F.col("high") + 1e-6)).drop("low", "high").transform(settled)
    freq = known.select("agent", F.explode("g").alias("t")).groupBy("agent", "t").agg(F.count(F.lit(1)).alias("f"))

    def listed(sets: DataFrame, key: str, p: str) -> DataFrame:
        order = Window.partitionBy("agent", key).orderBy(F.coalesce("f", F.lit(0)), "t")
        rows = sets.select("agent", key, "n", F.explode("g").alias("t")).join(freq, ["agent", "t"], "left").withColumn("r", F.row_number().over(order))
        return rows.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("agent", key, "t", F.col("n").alias(f"n{p}"), F.col("r").alias(f"r{p}"))

    left = 1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    near = left * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-6
    pairs = listed(new, "c", "a").join(listed(known, "like_id", "b"), ["agent", "t"]).filter(near).select("agent", "c", "like_id").distinct()
    full = pairs.join(new.select("agent", "c", F.col("g").alias("ga")), ["agent", "c"]).join(known.select("agent", "like_id", F.col("g").alias("gb")), ["agent", "like_id"])
    both = F.size(F.array_intersect("ga", "gb"))
    return full.filter(both / (F.size("ga") + F.size("gb") - both) > threshold).groupBy("agent", "c").agg(F.min("like_id").alias("like_id"))
