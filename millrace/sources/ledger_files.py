"""Shared rule files and the compiled memory file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import display_text

TOOL = "millrace"
MARKER = f"<!-- {TOOL}:ledger — machine-readable; do not hand-edit the block below -->"
SHARED = "agent string, exportedAt string, rules array<struct<body:string,measuredDelta:long,contextCost:long,sourceRun:long,createdAt:string>>"
MOST_CHARS = 1_000_000


def compiled_memory(rules: DataFrame, tool: str = TOOL) -> DataFrame:
    """agent and the file of its active rules, the largest saving first, each on a line, after "(when <scope>)" where it has one.

    Bodies (400 characters at most) and scopes (200) lose control and invisible characters, line breaks included, so none can pass for a rule of its own. An agent without
    active rules has a file without lines.
    """
    scope = F.col("scope") if "scope" in rules.columns else F.lit(None).cast("string")
    line = F.concat(F.lit("- "), F.when(F.coalesce(scope, F.lit("")) != "", F.concat(F.lit("(when "), display_text(scope, 200), F.lit(") "))).otherwise(""), display_text("body", 400))
    rank = F.struct((-F.coalesce("measured_delta", F.lit(-(1 << 62)))).alias("d"), "id", line.alias("line"))
    listed = F.sort_array(F.collect_list(F.when(F.col("status") == "active", rank)))
    body = F.array_join(F.concat(F.transform(listed, lambda r: r["line"]), F.array(F.lit(""))), "\n")
    return rules.groupBy("agent").agg(F.concat(F.lit(f"<!-- GENERATED BY {tool} — do not hand-edit -->\n# Efficiency rules\n\n"), body).alias("content"))


def drifted(rules: DataFrame, stored: DataFrame) -> DataFrame:
    """Agents whose stored text (agent, content) differs from what their rules compile to, with the new text."""
    new = compiled_memory(rules).withColumnRenamed("content", "compiled")
    return new.join(stored, "agent", "left").filter(~F.col("compiled").eqNullSafe(F.col("content"))).select("agent", "compiled")


def shared_files(rules: DataFrame, exported_at: str) -> DataFrame:
    """agent and the text of its shared file: how many active rules there are, a line a rule with what it saves and costs, then a marker and the same as JSON.

    Rules go by their saving, the largest first, unmeasured ones last. An agent without active rules has a file that says so.
    """
    r = F.struct(F.col("body"), F.col("measured_delta").alias("measuredDelta"), F.col("context_cost").alias("contextCost"), F.col("source_run").alias("sourceRun"), F.col("created_at").cast("string").alias("createdAt"))
    rank = F.struct((-F.coalesce("measured_delta", F.lit(-(1 << 62)))).alias("d"), "id", r.alias("r"))
    g = rules.groupBy("agent").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == "active", rank))), lambda x: x["r"]).alias("rules"))
    data = F.to_json(F.struct("agent", F.lit(exported_at).alias("exportedAt"), "rules"), {"ignoreNullFields": "false"})
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    line = lambda x: said("- **", F.coalesce(said("+", x["measuredDelta"]), F.lit("n/a")), " tokens/run** (rent ", x["contextCost"], "): ", x["body"], "\n")
    head = said(f"# {TOOL} rules — ", F.col("agent"), "\n\n", F.size("rules"), f" active rule(s), each kept because it measurably earned at least 2× its context rent on the golden suite. Exported {exported_at}.\n\n")
    prose = F.when(F.size("rules") == 0, "_No active rules yet._\n").otherwise(F.array_join(F.transform("rules", line), ""))
    return g.select("agent", F.concat(head, prose, F.lit(f"\n{MARKER}\n```json\n"), data, F.lit("\n```\n")).alias("content"))


def parsed_file(content: str | Column, most: int | None = MOST_CHARS) -> Column:
    """The data of a shared file, null where it has over ``most`` characters (None: any number), has no marker or doesn't parse."""
    c = F.col(content) if isinstance(content, str) else content
    block = F.regexp_extract(F.substring_index(c, MARKER, -1), r"(?s)```json\s*\n(.*?)\n```", 1)
    data = F.from_json(block, SHARED)
    small = F.lit(True) if most is None else F.length(c) <= most
    return F.when(small & c.contains(MARKER) & data["rules"].isNotNull() & data["agent"].isNotNull(), data)


def verified_files(files: DataFrame, most: int | None = MOST_CHARS) -> DataFrame:
    """Files (path, content) with their number of rules, and whether the data parses and each body stands in the list above it.

    Files that others wrote hold at most ``most`` characters; None takes any. Bodies that end a line of the list are found as a set, only others are looked for one by one.
    """
    d = files.withColumn("d", parsed_file("content", most)).withColumn("prose", F.substring_index("content", MARKER, 1))
    bodies, ends = F.transform("d.rules", lambda r: r["body"]), F.transform(F.split("prose", "\n"), lambda x: F.regexp_replace(x, r"^- \*\*[^*]*\*\* \(rent [^)]*\): ", ""))
    ok = F.col("d").isNotNull() & F.coalesce(F.forall(bodies, lambda b: b.isNotNull()) & F.forall(F.array_except(bodies, ends), lambda b: F.col("prose").contains(b)), F.lit(False))
    return d.select("path", F.coalesce(F.size("d.rules"), F.lit(0)).alias("rules"), ok.alias("valid"))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True, pathGlobFilter="*.rules.md", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def imported_rules(files: DataFrame) -> DataFrame:
    d = files.withColumn("d", parsed_file("content")).filter("d IS NOT NULL").select(F.col("d.agent").alias("agent"), F.posexplode("d.rules").alias("pos", "r"))
    return d.select("agent", "pos", "r.body", F.col("r.measuredDelta").alias("measured_delta"), F.col("r.contextCost").alias("context_cost"))


def frontmatter(content: Column, field: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(content, rf"(?m)^{field}:[ \t]*(.*)$", 1)), F.lit(""))


def check_proposal(original: Column, proposed: Column, fields: tuple[str, ...] = ("name", "description", "tools", "model"), least: int = 40) -> Column:
    """Why a rewritten definition is refused; null where it may stand."""
    body = F.trim(F.regexp_replace(proposed, r"(?s)^---\n.*?\n---\n?", ""))
    out = F.when(proposed.rlike(r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}]"), "control characters")
    for f in fields:
        out = out.when(~frontmatter(original, f).eqNullSafe(frontmatter(proposed, f)), f"{f} changed")
    return out.when(F.length(body) < least, "body too short")


def envelope(text: Column, most: int = 64_000) -> Column:
    """struct(result, reason) of a model's JSON envelope."""
    d = F.from_json(text, "type string, is_error boolean, result string")
    reason = F.when(F.length(text) > most, "too large").when(d["type"].isNull(), "not an envelope").when(d["is_error"], "error").when(d["result"].isNull(), "no result")
    return F.struct(F.when(reason.isNull(), d["result"]).alias("result"), reason.alias("reason"))


def parsed_facts(text: Column) -> Column:
    """struct(facts, malformed): elements are checked one by one."""
    items = F.coalesce(F.from_json(text, "array<struct<metric:string,period:string,value:double,unit:string,currency:string,chunkId:string,quote:string>>"), F.array().cast("array<struct<metric:string,period:string,value:double,unit:string,currency:string,chunkId:string,quote:string>>"))
    good = F.filter(items, lambda x: x["metric"].isNotNull() & x["value"].isNotNull() & x["chunkId"].isNotNull() & x["quote"].isNotNull())
    return F.struct(good.alias("facts"), (F.size(items) - F.size(good)).alias("malformed"))


def first_message(candidates: list[Column]) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])
