"""Session transcripts: JSON lines to one row a session and one a tool call.

Lines are parsed to VARIANT, since message content is a string or a list of blocks. Of usage entries of one message the last
counts; of tool calls and results of one id the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import classify_tool
from millrace.functions.text import squeezed, trimmed, truncate


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """session_key (file name), line_no, value. Each file is read whole, so that line numbers are certain."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.jsonl)?$", 1).alias("session_key"), "value")
    return raw.select("session_key", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """session_key, line_no, value like ``read_lines``, for files of any size: each is read in splits.

    Lines of a split are numbered where they are read, and the splits of a file by the numbers of lines in those before, a row a split.
    """
    raw = spark.read.text(path, recursiveFileLookup=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.jsonl)?$", 1).alias("session_key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("under", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return raw.join(splits, ["file", "block"]).select("session_key", (F.col("under") + F.col("at") - F.col("first")).alias("line_no"), "value")


def entries(lines: DataFrame) -> DataFrame:
    """Lines (session_key, line_no, value) with v (VARIANT; null where malformed) and their fields. Blank lines are left out."""
    text = F.when(F.col("line_no") == 0, F.regexp_replace("value", r"^\x{feff}", "")).otherwise(F.col("value"))
    v = F.try_parse_json("value")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    out = lines.withColumn("value", text).filter(F.trim(trimmed(F.col("value"))) != "").withColumn("v", v)
    out = out.withColumn("type", F.when(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"), get("$.type")))
    return out.select(
        "session_key", "line_no", "v", "type", F.col("type").isNull().alias("malformed"), F.col("type").isin("user", "assistant").alias("talk"),
        get("$.sessionId").alias("session_id"), get("$.agentId").alias("agent_id"), get("$.agentName").alias("agent_name"), get("$.isSidechain", "boolean").alias("sidechain"),
        get("$.isApiErrorMessage", "boolean").alias("api_error"), F.coalesce(get("$.message.id"), get("$.requestId"), get("$.uuid"), F.concat(F.lit("line-"), F.col("line_no") + 1)).alias("message_key"),
        *[F.coalesce(get(f"$.message.usage.{c}", "long"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")],
        get("$.message.usage", "variant").isNotNull().alias("has_usage"), get("$.message.content", "variant").alias("content"),
    ).withColumn("blocks", F.when(F.schema_of_variant("content").startswith("ARRAY"), F.try_variant_get("content", "$", "array<variant>")))


def result_chars(content: Column) -> Column:
    """Length of a string, or of all texts of a list; else 0."""
    kind = F.schema_of_variant(content)
    parts = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(F.length(F.try_variant_get(x, "$.text", "string")), F.lit(0)))
    return F.when(kind == "STRING", F.length(F.try_variant_get(content, "$", "string"))).when(kind.startswith("ARRAY"), texts).otherwise(0).cast("long")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def tool_events(parsed: DataFrame) -> DataFrame:
    """session_key, key, name, skill, file_path, input_chars, result_chars for each distinct tool call."""
    blocks = parsed.filter("talk").select("session_key", "line_no", "type", F.posexplode("blocks").alias("pos", "b"))
    get = lambda p, t="string": F.try_variant_get("b", p, t)
    blocks = blocks.withColumn("kind", get("$.type"))
    uses = blocks.filter("type = 'assistant' AND kind = 'tool_use'").select(
        "session_key", "line_no", "pos", F.nullif(get("$.id"), F.lit("")).alias("id"), F.coalesce(get("$.name"), F.lit("unknown")).alias("name"), get("$.input", "variant").alias("input")
    )
    uses = uses.withColumn("key", F.coalesce("id", F.concat(F.lit("no-id-"), F.col("line_no"), F.lit("-"), F.col("pos"))))
    uses = first_of(uses, ["session_key", "key"], ["line_no", "pos"])
    results = blocks.filter("type = 'user' AND kind = 'tool_result'").select("session_key", "line_no", "pos", get("$.tool_use_id").alias("key"), result_chars(get("$.content", "variant")).alias("result_chars"))
    results = first_of(results.filter("key IS NOT NULL"), ["session_key", "key"], ["line_no", "pos"]).select("session_key", "key", "result_chars")
    inp = lambda p: F.try_variant_get("input", p, "string")
    skill = F.when(F.col("name") == "Skill", F.coalesce(inp("$.skill"), inp("$.command"), inp("$.name")))
    return uses.join(results, ["session_key", "key"], "left").select(
        "session_key", "key", "name", skill.alias("skill"), F.when(F.col("name") == "Read", inp("$.file_path")).alias("file_path"),
        F.coalesce(F.length(F.to_json("input")), F.lit(0)).cast("long").alias("input_chars"), F.coalesce("result_chars", F.lit(0)).cast("long").alias("result_chars"),
    )


def sessions(lines: DataFrame) -> DataFrame:
    """One row a session: totals, tool calls, files read again, completion, counts of entries and malformed lines."""
    e = entries(lines)
    usage = first_of(e.filter("type = 'assistant' AND has_usage").withColumn("o", -F.col("line_no")), ["session_key", "message_key"], ["o"])
    names = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_creation_input_tokens": "cache_creation", "cache_read_input_tokens": "cache_read"}
    totals = usage.groupBy("session_key").agg(*[F.sum(c).alias(n) for c, n in names.items()])
    tools = tool_events(e)
    calls = tools.groupBy("session_key").agg(F.count(F.lit(1)).alias("tool_calls"))
    rereads = tools.filter("file_path IS NOT NULL").groupBy("session_key", "file_path").count().groupBy("session_key").agg(F.count_if(F.col("count") >= 2).alias("file_rereads"))
    text = F.exists(F.coalesce("blocks", F.array().cast("array<variant>")), lambda b: (F.try_variant_get(b, "$.type", "string") == "text") & (F.length(F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))) > 0))
    plain = F.coalesce(F.length(F.when(F.schema_of_variant("content") == "STRING", F.try_variant_get("content", "$", "string"))) > 0, F.lit(False))
    said = (F.col("type") == "assistant") & ~F.coalesce("api_error", F.lit(False)) & (F.coalesce(text, F.lit(False)) | plain)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    base = e.withColumn("said", said).groupBy("session_key").agg(
        first("session_id").alias("session_id"), F.coalesce(first("agent_name"), F.lit("main")).alias("agent"), first("agent_id").alias("agent_id"), F.coalesce(F.bool_or("sidechain"), F.lit(False)).alias("is_sidechain"),
        F.count_if("talk").alias("entries"), F.count_if("malformed").alias("malformed"), F.coalesce(F.max_by("said", F.when(F.col("talk"), F.col("line_no"))), F.lit(False)).alias("completed"),
    )
    out = base
    for part in (totals, calls, rereads):
        out = out.join(part, "session_key", "left")
    return out.na.fill(0, [*names.values(), "tool_calls", "file_rereads"])


def tool_costs(events: DataFrame, by: str = "session_key") -> DataFrame:
    """Calls and characters by class of tool, the largest first within a session."""
    c = events.withColumn("c", classify_tool("name", "skill")).select(by, "c.*", "input_chars", "result_chars")
    return c.groupBy(by, "kind", "grp", "label").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_chars").alias("input_chars"), F.sum("result_chars").alias("result_chars"))


def session_id(is_sidechain: Column, session: Column, agent: Column) -> Column:
    """A side chain is a session of its own."""
    return F.when(is_sidechain & agent.isNotNull(), F.concat(session, F.lit("#"), agent)).otherwise(session)


def first_prompts(lines: DataFrame, least: int = 24) -> DataFrame:
    """The first user text of a session that is long enough and isn't made by a tool."""
    e = entries(lines).filter("type = 'user'")
    part = F.get(F.filter("blocks", lambda b: F.try_variant_get(b, "$.type", "string") == "text"), 0)
    text = squeezed(F.coalesce(F.when(F.schema_of_variant("content") == "STRING", F.try_variant_get("content", "$", "string")), F.try_variant_get(part, "$.text", "string")))
    p = e.withColumn("prompt", text).filter((F.length("prompt") >= least) & ~F.col("prompt").startswith("<") & ~F.col("prompt").startswith("Caveat:"))
    return p.groupBy("session_key").agg(F.min_by("prompt", "line_no").alias("prompt"))


def digests(lines: DataFrame, most: int = 8000) -> DataFrame:
    """A bounded trace of each session: the lines that fit its first 40 percent, then the last that fit 55, with a mark where some are left out."""
    e = entries(lines).filter("talk")
    up = F.upper("type")
    get = lambda b, p: F.try_variant_get(b, p, "string")
    one = lambda b: F.when(
        (get(b, "$.type") == "text") & (F.length(F.coalesce(get(b, "$.text"), F.lit(""))) > 0), F.concat(up, F.lit(": "), truncate(get(b, "$.text"), 200))
    ).when(get(b, "$.type") == "tool_use", F.concat(F.lit("TOOL "), F.coalesce(get(b, "$.name"), F.lit("unknown")), F.lit(" "), truncate(F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("{}")), 160)))
    said = F.when(F.schema_of_variant("content") == "STRING", F.array(F.concat(up, F.lit(": "), truncate(F.try_variant_get("content", "$", "string"), 200)))).otherwise(F.transform("blocks", one))
    rows = e.select("session_key", "line_no", F.posexplode(F.filter(said, lambda x: x.isNotNull())).alias("pos", "t")).withColumn("n", F.length("t") + 1)
    listed = rows.groupBy("session_key").agg(F.sort_array(F.collect_list(F.struct("line_no", "pos", "t", "n"))).alias("r"))
    head_most, tail_most = int(most * 0.4), int(most * 0.55)
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("head"), F.array().cast("array<struct<t:string,n:int>>").alias("tail"))
    step = lambda a, x: F.struct(
        F.when(a["n"] + x["n"] <= head_most, a["n"] + x["n"]).otherwise(a["n"]).alias("n"),
        F.when(a["n"] + x["n"] <= head_most, F.concat(a["head"], F.array(x["t"]))).otherwise(a["head"]).alias("head"),
        F.when(a["n"] + x["n"] <= head_most, a["tail"]).otherwise(F.concat(a["tail"], F.array(F.struct(x["t"].alias("t"), x["n"].alias("n"))))).alias("tail"),
    )
    parts = listed.withColumn("p", F.aggregate("r", zero, step)).select("session_key", "p.head", "p.tail")
    # from the end, as many as fit; always the last
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))
    back = lambda a, x: F.when(
        ~a["full"] & ((a["n"] + x["n"] <= tail_most) | (F.size(a["kept"]) == 0)), F.struct((a["n"] + x["n"]).alias("n"), F.concat(F.array(x["t"]), a["kept"]).alias("kept"), a["full"].alias("full"))
    ).otherwise(F.struct(a["n"].alias("n"), a["kept"].alias("kept"), F.lit(True).alias("full")))
    done = parts.withColumn("q", F.aggregate(F.reverse("tail"), zero, back))
    mark = F.when(F.col("q.full"), F.array(F.lit("…[transcript truncated]…"))).otherwise(F.array().cast("array<string>"))
    return done.select("session_key", F.array_join(F.concat("head", mark, "q.kept"), "\n").alias("digest"))
