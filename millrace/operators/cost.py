"""What rules cost and save in dollars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import CACHE_READ, CACHE_WRITE, blended_rate, col, dollars_for, half_up, price, total_tokens
from millrace.operators.ledger import COUNTERS, recent_tokens
from millrace.schemas import real_work


def counted(c: str) -> Column:
    """A count of tokens as the prices take it: nothing below 0, nothing missing."""
    return F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def rule_costs(receipts: DataFrame, rate: str | Column, sessions: float = 20.0) -> DataFrame:
    """Rent, savings, net and weekly dollars of each receipt, the cost of finding its rule and the sessions until that is paid back.

    Rent is the context cost at the input price of the receipt's model; savings are the measured delta at ``rate`` dollars a token. Finding a rule
    took its runs on both sides. A rule without a net gain never breaks even.
    """
    out = receipts.withColumns({
        "rent": counted("context_cost") * (price("model", "input") / 1_000_000), "saving": counted("delta") * col(rate),
        "discovery": counted("runs") * (counted("with_tokens") + counted("without_tokens")) * col(rate),
    }).withColumn("net", F.col("saving") - F.col("rent"))
    paid = F.when(F.col("net") > 0, F.ceil(F.col("discovery") / F.when(F.col("net") > 0, F.col("net"))))
    return out.withColumns({"weekly": F.col("net") * sessions, "break_even": paid}).select("rule_id", "agent", "model", "delta", "rent", "saving", "net", "weekly", "discovery", "break_even")


def agent_mix(runs: DataFrame) -> DataFrame:
    """Per agent the sums of the four counters over its completed runs of any kind."""
    return runs.filter("completed").groupBy("agent").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def mixed_rate(model: str | Column) -> Column:
    """Dollars a token of ``model`` at the counters beside it, which may be missing; the input price where there are none.

    Prices are taken a token before they meet counts, and 0.1 of a count before its price: ranks go by the last bit of what follows.
    """
    a_token = lambda kind: price(model, kind) / 1_000_000
    i, o = a_token("input"), a_token("output")
    dollars = F.col("input_tokens") * i + F.col("output_tokens") * o + F.col("cache_creation") * CACHE_WRITE * i + F.col("cache_read") / (1 / CACHE_READ) * i
    total = total_tokens()
    return F.coalesce(dollars / F.when(total > 0, total), i)


def agent_costs(rules: DataFrame, receipts: DataFrame, runs: DataFrame, sessions: float = 20.0, order: str = "decided_no") -> DataFrame:
    """The active rules that have a receipt, priced by the last one at its own model and their agent's mix of tokens; the most dollars a week first."""
    last = receipts.drop("agent", "status").groupBy("rule_id").agg(F.max_by(F.struct("delta", "context_cost", "runs", "with_tokens", "without_tokens", "model"), order).alias("r"))
    active = rules.filter("status = 'active'").select("agent", F.col("id").alias("rule_id"))
    priced = active.join(last, "rule_id").select("rule_id", "agent", "r.*").join(agent_mix(runs), "agent", "left").withColumn("rate", mixed_rate("model"))
    return rule_costs(priced, "rate", sessions).orderBy("agent", F.desc("net"), F.col("delta").desc_nulls_last(), "rule_id")


def project_agents(costs: DataFrame, runs: DataFrame, weeks: float = 4.0, sessions: float = 20.0) -> DataFrame:
    """What the rules of each agent save over ``weeks``, against its work without them.

    ``costs``: rows of ``agent_costs``. The baseline is the agent's mean completed real work at its mix and the model of the rule that earns most a week; it is null
    where no such work is known, and so are the cost with rules and the share saved. An agent without rules has its baseline and nothing else.
    """
    horizon = int(weeks * sessions + 0.5)
    top = F.max_by("model", F.struct("net", F.coalesce("delta", F.lit(-(1 << 62))), -F.col("rule_id")))
    sums = costs.groupBy("agent").agg(*[F.sum(c).alias(c) for c in ("net", "saving", "discovery")], F.count(F.lit(1)).alias("rules"), top.alias("model"))
    work = runs.filter("completed").groupBy("agent").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.avg(F.when(real_work(), total_tokens())).alias("mean_tokens"))
    j = work.join(sums, "agent", "full_outer").na.fill(0.0, ["net", "saving", "discovery"]).na.fill(0, ["rules"])
    out = j.withColumns({
        "gross_savings": F.col("saving") * horizon, "net_benefit": F.col("net") * horizon - F.col("discovery"), "baseline": F.col("mean_tokens") * mixed_rate("model") * horizon,
    })
    gains = (F.col("net") > 0) & (F.col("discovery") > 0)
    return out.select(
        "agent", "rules", F.col("net").alias("net_per_session"), "gross_savings", F.col("discovery").alias("operating_cost"), "net_benefit",
        F.when(gains, F.ceil(F.col("discovery") / F.when(gains, F.col("net")))).alias("break_even"), "baseline",
        (F.col("baseline") - F.col("net") * horizon + F.col("discovery")).alias("with_rules"),
        F.when(F.col("baseline") > 0, F.col("net_benefit") / F.when(F.col("baseline") > 0, F.col("baseline"))).alias("share_saved"),
    )


def run_dollars(runs: DataFrame) -> DataFrame:
    return runs.select("id", dollars_for("model").alias("dollars"), blended_rate("model").alias("rate"))


def meta_cost(bench: DataFrame, runs: DataFrame, now: Column, most: float = 0.1) -> DataFrame:
    """Tokens of the measuring runs ``bench`` against the real work of the last seven days; over ``most`` of it is worth a warning, without real work nothing can be said."""
    spent = bench.agg(F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("bench"))
    g = spent.withColumn("real", recent_tokens(runs, now).scalar())
    r = F.when(F.col("real") > 0, F.col("bench") / F.when(F.col("real") > 0, F.col("real")))
    return g.select("bench", "real", r.alias("share"), F.coalesce(r > most, F.lit(False)).alias("warn"))


def weekly_saving(rules: DataFrame, rate: float, sessions: float = 20.0) -> DataFrame:
    return rules.filter("status = 'active'").agg(half_up(F.coalesce(F.sum(F.greatest("measured_delta", F.lit(0))), F.lit(0)) * F.lit(rate) * sessions).alias("weekly"))
