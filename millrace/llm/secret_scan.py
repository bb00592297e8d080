"""Secret scans over a trigram inverted index.

From the parse tree of each rule a Boolean query over trigrams is derived that every match must satisfy. Each lot of texts is an index segment
of its own: postings of all trigrams that some query names, evaluated by intersection and union, and only candidates are verified.
A rule without mandatory trigrams scans all texts. Segments are built where the rows are, so no text moves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as parser

TRUE = ("all",)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0  # the group that ``least`` counts
    least: int = 0
    #: what to search for where it can't contain other matches of the pattern; same result, faster
    scan: str = ""
    regex: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "regex", re.compile(self.scan or self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0)))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Leftmost non-overlapping matches; those that are too short are dropped, and what they cover stays covered."""
        for m in self.regex.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


#: Fixed: the three kinds that the contract of the query names.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ignore_case=True, group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16, scan=r"[0-9a-f]{16,}"),
)
#: Public token formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("bearer", r"bearer +[A-Za-z0-9._~+/-]{20,}=*", ignore_case=True),
)
RULES = BASE_RULES + MORE_RULES


def both(a, b):
    parts = [x for q in (a, b) if q != TRUE for x in (q[1:] if q[0] == "and" else (q,))]
    parts = list(dict.fromkeys(parts))
    return TRUE if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def either(queries: list):
    if TRUE in queries:
        return TRUE
    parts = list(dict.fromkeys(x for q in queries for x in (q[1:] if q[0] == "or" else (q,))))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def of_strings(strings: set[str]):
    """Some string of the set occurs."""
    if any(len(s) < 3 for s in strings):
        return TRUE
    out = []
    for s in sorted(strings):
        q = TRUE
        for i in range(len(s) - 2):
            q = both(q, ("tri", s[i : i + 3]))
        out.append(q)
    return either(out)


def walk(items, most: int) -> tuple[set[str] | None, tuple]:
    """(all strings it can match, if few; a query that any match satisfies besides)."""
    run: set[str] | None = {""}
    query, whole = TRUE, True
    for op, arg in items:
        exact, need = one(op, arg, most)
        query = both(query, need)
        if exact is not None and len(run) * len(exact) <= most:
            run = {a + b for a in run for b in exact}
            continue
        query, whole = both(query, of_strings(run)), False
        run = exact if exact is not None else {""}
    if whole:
        return run, query
    return None, both(query, of_strings(run))


def one(op, arg, most: int) -> tuple[set[str] | None, tuple]:
    if op is sre.LITERAL:
        c = chr(arg)
        return ({c.lower()}, TRUE) if arg < 128 else (None, TRUE)
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL and x < 128:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] < 128 and x[1] - x[0] < 64:
                chars |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None, TRUE
        return (chars, TRUE) if len(chars) <= 8 else (None, TRUE)
    if op is sre.SUBPATTERN:
        return walk(arg[-1], most)
    if op is sre.BRANCH:
        sides = [walk(x, most) for x in arg[1]]
        if all(e is not None for e, _ in sides) and sum(len(e) for e, _ in sides) <= most:
            return set().union(*[e for e, _ in sides]), TRUE
        return None, either([both(q, of_strings(e)) if e is not None else q for e, q in sides])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, top, body = arg
        exact, need = walk(body, most)
        if exact is not None and (least, top) == (0, 1):
            return exact | {""}, TRUE
        if exact is not None and least == top and len(exact) ** least <= most:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in exact}
            return out, TRUE
        if not least:
            return None, TRUE
        return None, both(need, of_strings(exact)) if exact is not None else need
    if op is sre.AT:
        return {""}, TRUE
    return None, TRUE


def trigram_query(rule: Rule, most: int = 24) -> tuple:
    """What a lower-cased text must contain to match: ("tri", t), ("and", ...), ("or", ...) or TRUE where nothing is mandatory."""
    exact, query = walk(parser.parse(rule.pattern, re.ASCII), most)
    return both(query, of_strings(exact)) if exact is not None else query


def named(query) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*[named(q) for q in query[1:]]) if len(query) > 1 else set()


class Segment:
    """Postings of the asked trigrams over one lot of texts."""

    def __init__(self, texts: list[str], asked: dict[str, int], table: np.ndarray):
        joined = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\0\0\0".join(joined) + b"\0\0\0", dtype=np.uint8)
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
        ids = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(ids)
        ends = np.cumsum([len(b) + 3 for b in joined])
        # a posting for each trigram and text, however often it occurs
        pairs = np.unique(ids[at].astype(np.int64) * (len(texts) + 1) + np.searchsorted(ends, at, side="right"))
        self.n, of = len(texts), pairs // (len(texts) + 1)
        self.postings = {t: pairs[of == i] % (len(texts) + 1) for t, i in asked.items()}

    def candidates(self, query) -> np.ndarray:
        if query == TRUE:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings[query[1]]
        found = [self.candidates(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        out = found[0]
        for x in sorted(found[1:], key=len):
            out = np.intersect1d(out, x, assume_unique=True)
        return out


def lots(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    lot: list[str] = []
    size = first = 0
    for at in range(0, len(texts), 64):
        for i, t in enumerate(texts.slice(at, 64).to_pylist(), at):
            if lot and size + len(t or "") > most:
                yield first, lot
                lot, size, first = [], 0, i
            lot.append(t or "")
            size += len(lot[-1])
    if lot:
        yield first, lot


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id, spans (array of kind, start, end; code points, end exclusive), by start, then kind as listed in ``rules``.

    Matches of a kind are the leftmost non-overlapping ones of its pattern; what is shorter than its least length is dropped afterwards. Kinds
    may overlap one another. Null text counts as empty and has no spans; rows that repeat get equal results; a null id is kept; an empty table
    gives no rows; other columns aren't read. Texts are scanned whole; a task holds one lot of them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r) for r in rules]
        asked = {t: i + 1 for i, t in enumerate(sorted(set().union(*[named(q) for q in queries])))}
        table = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in asked.items():
            a, b, c = t.encode()
            table[(a << 16) | (b << 8) | c] = i
        for batch in batches:
            for first, lot in lots(batch.column("text")):
                segment = Segment(lot, asked, table)
                found: list[list[tuple[int, int, int]]] = [[] for _ in lot]
                for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for i in segment.candidates(query).tolist():
                        found[i] += [(s, k, e) for s, e in rule.spans(lot[i])]
                flat = [(rules[k].kind, s, e) for own in found for s, k, e in sorted(own)]
                starts = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32()))], names=["kind", "start", "end"])
                yield pa.RecordBatch.from_arrays([batch.column("id")[first : first + len(lot)], pa.ListArray.from_arrays(pa.array(starts), spans)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)
