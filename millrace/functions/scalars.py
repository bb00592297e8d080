"""Scalar expressions shared by all operators. Every one takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: a token is taken as four characters; rent of a rule is written to the cache at 1.25 times the rate and read at 0.1 times it.
CHARS_PER_TOKEN = 4
CACHE_WRITE, CACHE_READ = 1.25, 0.1
#: Fixed: coefficients of the error function's polynomial (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Fixed: dollars a million tokens (input, output) by tier.
PRICES = {"opus": (5.0, 25.0), "sonnet": (3.0, 15.0), "haiku": (1.0, 5.0)}
DEFAULT_PRICE = (3.0, 15.0)
DEFAULT_SESSIONS, DEFAULT_Z = 20.0, 2.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total_tokens(prefix: str = "") -> Column:
    """What a run cost: all four counters."""
    return sum((F.col(prefix + c) for c in ("output_tokens", "cache_creation", "cache_read")), F.col(prefix + "input_tokens"))


def processing_tokens(prefix: str = "") -> Column:
    """What a comparison counts: cache reads left out."""
    return F.col(prefix + "input_tokens") + F.col(prefix + "output_tokens") + F.col(prefix + "cache_creation")


def half_up(x: str | Column) -> Column:
    """Rounds half toward plus infinity, unlike SQL's round()."""
    return F.floor(col(x) + 0.5).cast("long")


def truncated_mean(x: str | Column) -> Column:
    return F.avg(col(x)).cast("long")


def ratio(a: Column, b: Column, empty=None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def estimate_tokens(text: str | Column) -> Column:
    return F.ceil(F.length(col(text)) / CHARS_PER_TOKEN).cast("long")


def chars_to_tokens(chars: str | Column) -> Column:
    return half_up(col(chars) / CHARS_PER_TOKEN)


def sessions_per_week(value) -> float:
    """A positive finite number, else the default."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return DEFAULT_SESSIONS
    return x if 0 < x < float("inf") else DEFAULT_SESSIONS


def confidence_z(value) -> float:
    """At least 1, else the default; smaller values aren't clamped but refused."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return DEFAULT_Z
    return x if 1 <= x < float("inf") else DEFAULT_Z


def effective_rent(cost: str | Column, sessions: float = DEFAULT_SESSIONS) -> Column:
    return col(cost) * (1 + CACHE_WRITE / sessions)


def verdict(delta: str | Column, cost: str | Column, sessions: float = DEFAULT_SESSIONS) -> Column:
    d = col(delta)
    return F.when(d.isNull() | (d <= 0), "evicted").when(d >= 2 * effective_rent(cost, sessions), "active").otherwise("evicted")


def verdict_reason(delta: str | Column, cost: str | Column, regression: str | Column, sessions: float = DEFAULT_SESSIONS) -> Column:
    """Why, in the words stored on a rule (fixed): a regression first, then no measurement, no saving, too small a saving, or a pass.

    The bar is shown rounded up, so it never reads as low as a saving that misses it.
    """
    d, bar = col(delta), F.ceil(2 * effective_rent(cost, sessions)).cast("string")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (
        F.when(col(regression), "regression: a previously passing golden task failed")
        .when(d.isNull(), "no comparable completed runs")
        .when(d <= 0, said("non-positive delta (", d, ")"))
        .when(d < 2 * effective_rent(cost, sessions), said("sub-threshold: savings ", d, " < 2× cache-aware rent (", bar, ")"))
        .otherwise(said("savings ", d, " ≥ 2× cache-aware rent (", bar, ")"))
    )


def final_verdict(status: Column, uncertain: Column, audit: Column) -> Column:
    """An uncertain candidate goes; an uncertain rule under audit stays."""
    return F.when(uncertain & audit, "active").when(uncertain, "evicted").otherwise(status)


def percent_change(current: str | Column, base: str | Column) -> Column:
    """Signed, one decimal; n/a at a base of 0, no sign at exactly 0."""
    c, b = col(current), col(base)
    change = ratio((c - b) * 100.0, b, 0.0)
    return F.when(b == 0, "n/a").otherwise(F.concat(F.when(change > 0, "+").otherwise(""), F.format_string("%.1f%%", change)))


def dollars(x: str | Column) -> Column:
    v = col(x)
    return F.when((F.abs(v) < 0.01) & (v != 0), F.format_string("$%.5f", v)).otherwise(F.format_string("$%.2f", v))


def signed(x: str | Column) -> Column:
    v = col(x)
    return F.concat(F.when(v > 0, "+").otherwise(""), F.format_number(v, 0))


def percent_of(current: str | Column, base: str | Column) -> Column:
    """Change against a first run, one decimal with its sign; n/a where either is 0."""
    c, b = col(current), col(base)
    change = (c - b) * 100.0 / F.when(b != 0, b)
    return F.when((b == 0) | (c == 0), "n/a").otherwise(F.concat(F.when(change >= 0, "+").otherwise(""), F.format_string("%.1f%%", change)))


def duration(ms: str | Column) -> Column:
    """Milliseconds as seconds with one decimal."""
    return F.format_string("%.1fs", col(ms) / 1000.0)


def footprint() -> Column:
    return F.col("input_chars") + F.col("result_chars")


def price(model: str | Column, kind: str, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """Dollars a million tokens of ``kind`` (input, output, cache_write, cache_read); unknown models cost the default."""
    pairs = prices or PRICES
    at = 1 if kind == "output" else 0
    times = {"cache_write": CACHE_WRITE, "cache_read": CACHE_READ}.get(kind, 1.0)
    known = F.create_map(*[F.lit(x) for k, v in sorted(pairs.items()) for x in (k, v[at])])
    return F.coalesce(F.try_element_at(known, F.coalesce(col(model), F.lit(""))), F.lit(DEFAULT_PRICE[at])) * times


def dollars_for(model: str | Column, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """Cost in dollars of the four counters of a row."""
    parts = {"input_tokens": "input", "output_tokens": "output", "cache_creation": "cache_write", "cache_read": "cache_read"}
    cost = F.lit(0.0)
    for c, kind in parts.items():
        cost = cost + F.col(c) * price(model, kind, prices)
    return cost / 1_000_000


def blended_rate(model: str | Column, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """Dollars a token at the mix of counters in the row; the input rate where there are none."""
    total = total_tokens()
    return F.when(total > 0, dollars_for(model, prices) / F.when(total > 0, total)).otherwise(price(model, "input", prices) / 1_000_000)


def normal_cdf(x: str | Column) -> Column:
    v = col(x)
    z = F.abs(v) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(v >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def wilson(k: str | Column, n: str | Column, z: float = 1.96) -> Column:
    """(low, high) of the score interval of k in n, null where n is 0."""
    k, n = col(k), F.when(col(n) > 0, col(n)).cast("double")
    p, zz = k / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high"))


def nearest_rank(values: Column, share: float) -> Column:
    """Nearest-rank percentile of an array; null where it is empty."""
    s = F.sort_array(values)
    return F.try_element_at(s, F.greatest(F.ceil(F.size(s) * share).cast("int"), F.lit(1)))


def array_median(values: Column) -> Column:
    s = F.sort_array(values)
    n = F.size(s)
    return (F.try_element_at(s, F.floor((n + 1) / 2).cast("int") + F.when(n == 0, 1).otherwise(0)) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def classify_tool(name: str | Column, skill: str | Column) -> Column:
    """struct(kind, grp, label): skills by their name, mcp__server__tool by server and tool, all else by its own name; the groups of the first and last are fixed."""
    n, s = col(name), col(skill)
    parts = F.split(n, "__")
    server = F.coalesce(F.nullif(F.get(parts, 1), F.lit("")), F.lit("(unknown)"))
    tool = F.coalesce(F.nullif(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "__"), F.lit("")), F.lit("(unknown)"))
    known = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("(unknown)"))
    kind = F.when(n == "Skill", "skill").when(n.startswith("mcp__"), "mcp").otherwise("builtin")
    grp = F.when(kind == "skill", "(skills)").when(kind == "mcp", server).otherwise("(builtin)")
    label = F.when(kind == "skill", known(s)).when(kind == "mcp", tool).otherwise(n)
    return F.struct(kind.alias("kind"), grp.alias("grp"), label.alias("label"))


def environment_failure(completed: str | Column, tokens: str | Column, floor: int = 1000) -> Column:
    return ~col(completed) & (col(tokens) < floor)
