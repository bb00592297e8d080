"""Document sources: files to documents, documents to chunks along their headings."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.scalars import estimate_tokens
from millrace.functions.text import csv_to_text, html_to_text, strip_bom, trimmed

#: Fixed: a section of up to 1200 tokens is one chunk; longer ones are cut to windows that overlap by 80.
SECTION_TOKENS, OVERLAP_TOKENS = 1200, 80
#: Characters of chunks that leave a Python worker together.
BATCH_CHARS = 8_000_000
SIZE, STEP = 4 * SECTION_TOKENS, 4 * (SECTION_TOKENS - OVERLAP_TOKENS)
#: Blanks, ends of lines and the end of a text as Java's patterns have them.
BLANKS, ODD_ENDS = " \t\n\x0b\x0c\r", ("\x85", "\u2028", "\u2029")
END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
TRIM, STOPPED, CAPS = re.compile(rf"\A[{BLANKS}]+|[{BLANKS}]+{END}"), re.compile(rf"[.!?]{END}"), re.compile(r"[A-Z]{3}")
ATX = re.compile(rf"(#{{1,6}})[{BLANKS}]+([^\n\r\x85\u2028\u2029]*[^{BLANKS}])[{BLANKS}]*{END}")
ITEM = re.compile(r"(?i)(item|part)\s+[0-9ivx]+", re.ASCII)
FORMATS = ("md", "markdown", "txt", "text", "csv", "html", "htm")
SUITE = (
    "questions array<struct<id:string,type:string,question:string,expect:struct<value:double,unit:string,period:string>,must_cite_doc:string,"
    "requires_docs:array<string>,expect_empty:boolean,expect_conflict:boolean,why:string>>"
)


def documents_from(spark: SparkSession, root: str) -> DataFrame:
    """doc_id (path under root), format, text of the files below ``root``; hidden folders, .git and node_modules left out, unreadable files skipped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(root, wholetext=True)
    path = F.regexp_extract(F.col("_metadata.file_path"), r"^[a-z]+:/*(/.*)$", 1)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^[a-z]+:/*(?=/)", "")
    named = raw.select(F.replace(path, base, F.lit("")).alias("doc_id"), F.col("value").alias("raw"))
    named = named.withColumn("format", F.lower(F.regexp_extract("doc_id", r"\.([A-Za-z0-9]+)$", 1)))
    shown = F.col("format").isin(*FORMATS) & ~F.col("doc_id").rlike(r"(^|/)(\.[^/]+|node_modules)(/|$)")
    return named.filter(shown).select("doc_id", "format", document_text(F.col("format"), F.col("raw")).alias("text"))


def document_text(kind: Column, raw: Column) -> Column:
    plain = F.regexp_replace(strip_bom(raw), "\r\n?", "\n")
    return F.when(kind.isin("html", "htm"), html_to_text(raw)).when(kind == "csv", csv_to_text(raw)).otherwise(plain)


def questions_from(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUITE).option("multiLine", "true").option("mode", "FAILFAST").json(path).select(F.explode("questions").alias("q")).select("q.*")


def golden_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task files with a front matter: id, prompt, check, weight (default 1). A weight that isn't positive or an id that isn't a slug raises."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("v", rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    weight = F.coalesce(F.try_to_number(field("weight"), F.lit("999999.999")).cast("double"), F.when(field("weight").isNull(), 1.0))
    out = raw.select(field("id").alias("id"), field("success_check").alias("success_check"), trimmed(F.regexp_replace("v", r"(?s)^---\n.*?\n---\n?", "")).alias("prompt"), weight.alias("weight"))
    good = F.col("id").rlike(r"^[a-z0-9][a-z0-9-]*$") & (F.col("weight") > 0) & (F.length("prompt") > 0)
    return out.withColumn("id", F.when(good, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("bad task: "), F.coalesce("id", F.lit("?"))))))


def suite_hash(tasks: DataFrame) -> DataFrame:
    """First 12 hex digits of the digest over tasks in order of id."""
    listed = F.sort_array(F.collect_list(F.struct("id", "prompt", F.coalesce("success_check", F.lit("")).alias("c"))))
    return tasks.agg(F.substring(F.sha2(F.array_join(F.transform(listed, lambda t: F.concat_ws("\x00", t["id"], t["prompt"], t["c"])), "\x00"), 256), 1, 12).alias("hash"))


def headings_in(text: str) -> list[tuple[int, int, str]]:
    """(start, depth, title) of a text's headings: ATX headings, then filing items and parts, then lines in capitals."""
    out, start = [], 0
    for line in text.split("\n"):
        t = TRIM.sub("", line) if line[-1:] in ODD_ENDS else line.strip(BLANKS)
        if t:
            atx = ATX.match(t) if t[0] == "#" else None
            if atx:
                out.append((start, len(atx[1]), atx[2]))
            elif t[0] in "IiPp" and ITEM.match(t):
                out.append((start, 1, t))
            elif 4 <= len(t) <= 80 and CAPS.search(t) and t == t.upper() and not STOPPED.search(t):
                out.append((start, 2, t))
        start += len(line) + 1
    return out


def sections_in(text: str) -> list[tuple[int, list[str]]]:
    """(start, path) of a text's sections: the path is the heading after its nearest shallower ones, outermost first; text before the first heading has none."""
    out, above = [], []
    for start, depth, title in headings_in(text):
        above = [*(h for h in above if h[0] < depth), (depth, title)]
        out.append((start, [h[1] for h in above]))
    # a heading at 0 takes the place of the text before it
    return out if out and out[0][0] == 0 else [(0, []), *out]


def pieces_in(text: str) -> list[tuple[list[str], int, int]]:
    """(path, start, end) of a text's chunks in order, blank ones left out."""
    sections, out = sections_in(text), []
    for (start, path), end in zip(sections, [*(x[0] for x in sections[1:]), len(text)], strict=True):
        if end - start <= SIZE:
            cuts = [(start, end)]
        else:
            # a window is kept unless the one before it reached the end
            cuts = [(p, min(p + SIZE, end)) for p in range(start, end, STEP) if p == start or p - STEP + SIZE < end]
        out += [(path, p, q) for p, q in cuts if text[p:q].strip(BLANKS)]
    return out


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, start (offset from 0), depth, title: ATX headings, then filing items and parts, then lines in capitals."""

    def work(batches):
        for b in batches:
            found = [(i, *h) for i, text in enumerate(b.column("text").to_pylist()) for h in headings_in(text or "")]
            at, starts, depths, titles = zip(*found, strict=True) if found else ((), (), (), ())
            cols = [pa.array(starts, pa.int64()), pa.array(depths, pa.int32()), pa.array(titles, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *cols], ["doc_id", "start", "depth", "title"])

    more = StructType.fromDDL("start long, depth int, title string")
    return docs.select("doc_id", "text").mapInArrow(work, StructType([docs.schema["doc_id"], *more]))


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_id, ordinal, section_path, text, char_start, char_end, tokens. Blank documents and pieces give none; doc_id is a key, and rows without one give none.

    Text before the first heading is a section without a path, as is a document without headings. Each text is cut where it lies: offsets are sums over its lines, which
    built-in functions have only by sorting all lines of all texts.
    """

    def work(batches):
        for b in batches:
            at, size, rows = [], 0, []

            def batch():
                cols = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64()), strict=True)]
                return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *cols], ["doc_id", "ordinal", "section_path", "text", "char_start", "char_end"])  # noqa: B023

            for i, text in enumerate(b.column("text")):
                text = text.as_py()
                for k, (path, p, q) in enumerate(pieces_in(text) if text else ()):
                    at.append(i)
                    rows.append((k, path, text[p:q], p, q))
                    size += q - p
                if size > BATCH_CHARS:
                    yield batch()
                    at, size, rows = [], 0, []
            if rows:
                yield batch()

    more = StructType.fromDDL("ordinal int, section_path array<string>, text string, char_start long, char_end long")
    piece = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(work, StructType([docs.schema["doc_id"], *more]))
    return piece.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("ordinal").cast("string")).alias("chunk_id"), "ordinal", "section_path", "text", "char_start", "char_end", estimate_tokens("text").alias("tokens"))
