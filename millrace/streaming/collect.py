"""Streaming collection: transcripts to the ledger, and stateful triggers.

Sessions re-send cumulative totals, so the last row of a session stands. Order is that of arrival; event-time watermarks would change results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.schemas import TABLES
from millrace.sources.registry import log_of


def run_stream(spark: SparkSession, path: str) -> DataFrame:
    """Run rows as JSON lines, as they arrive in files below ``path``."""
    return spark.readStream.schema(TABLES["runs"]).json(path)


def keep_ledger(stream: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to the ledger's log of runs, in a folder of its own; ``open_ledger`` reads the log over the table.

    A batch that is written again replaces its folder, so it gives the same ledger. ``fold_log`` moves the log into the table now and then.
    """
    log = f"{log_of(ledger, 'runs')}/stream={hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def triggers(stream: DataFrame, span: int = 50, least: int = 5, share: float = 0.75) -> DataFrame:
    """For rows (agent, id, total): whether a run costs more than the percentile (nearest rank) of up to ``span`` runs of its agent before it.

    State is the last ``span`` totals of an agent.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prior = list(state.get[0]) if state.exists else []
        for rows in batches:
            out = []
            for r in rows.sort_values("id").itertuples():
                rank = -int(-len(prior) * share // 1)
                p = sorted(prior)[max(rank, 1) - 1] if prior else None
                out.append((key[0], r.id, r.total, p, len(prior) >= least and r.total > p))
                prior = [*prior, int(r.total)][-span:]
            yield pd.DataFrame(out, columns=["agent", "id", "total", "p75", "triggered"])
        state.update((prior,))

    return stream.groupBy("agent").applyInPandasWithState(
        step, "agent string, id long, total long, p75 long, triggered boolean", "prior array<long>", "append", GroupStateTimeout.NoTimeout
    )


def cooldown(stream: DataFrame, hours: int = 24) -> DataFrame:
    """For events (agent, ts): the first of an agent, and each that comes ``hours`` after the last one let through."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for rows in batches:
            passed = []
            for ts in rows["ts"].sort_values():
                now = int(ts.timestamp())
                if last is None or now - last >= hours * 3600:
                    passed.append((key[0], ts))
                    last = now
            yield pd.DataFrame(passed, columns=["agent", "ts"])
        state.update((last,))

    return stream.groupBy("agent").applyInPandasWithState(step, "agent string, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_usage(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tokens by agent and window of event time, for rows (agent, ts, total)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "agent").agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("runs"))


def first_results(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tool results (key, ts, ...) without repeats: the first of a key counts."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def approvals(stream: DataFrame) -> DataFrame:
    """For events (from_agent, to_agent, body, seq, id, answered): the question that each answer approves, the latest pending one of its kind.

    An event with an id asks; one that is answered approves. State is the pending ids of a kind; an answer without a pending question approves nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            if not r.answered:
                pending.append(int(r.id))
            elif pending:
                out.append((*key, pending.pop(pending.index(max(pending)))))
        state.update((pending,))
        yield pd.DataFrame(out, columns=["from_agent", "to_agent", "body", "id"])

    schema = "from_agent string, to_agent string, body string, id long"
    return stream.groupBy("from_agent", "to_agent", "body").applyInPandasWithState(step, schema, "pending array<long>", "append", GroupStateTimeout.NoTimeout)
