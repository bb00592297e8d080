"""Ledger tables, their row classes and additive schema versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 16

RUNS = (
    "id long, agent string, session_id string, task_hash string, input_tokens long, output_tokens long, cache_creation long, cache_read long, tool_calls long, "
    "file_rereads long, completed boolean, ruleset_version int, ts timestamp, config string, project string, model string, duration_ms long"
)
RULES = (
    "id long, agent string, body string, status string, measured_delta long, context_cost long, source_run long, decided_at timestamp, created_at timestamp, "
    "decided_reason string, protected boolean, born_digest string, scope string, probation boolean, replaces long"
)
BASELINES = "agent string, task_hash string, run1_tokens long, best_tokens long, updated_at timestamp"
RULESET_VERSIONS = "agent string, version int, updated_at timestamp"
QUESTIONS = "id long, from_agent string, to_agent string, body string, approved int, ts timestamp"
TOOL_COSTS = "run_id long, kind string, grp string, label string, calls long, input_chars long, result_chars long"
RECEIPTS = (
    "rule_id long, decided_at timestamp, agent string, status string, kind string, reason string, model string, fixture_hash string, runs long, delta long, "
    "context_cost long, standard_error long, regression boolean, with_tokens long, without_tokens long, tasks_total long, tasks_passed_with long, tasks_passed_without long"
)
TABLES = {"runs": RUNS, "rules": RULES, "baselines": BASELINES, "ruleset_versions": RULESET_VERSIONS, "questions": QUESTIONS, "tool_costs": TOOL_COSTS, "rule_receipts": RECEIPTS}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def migrated(df: DataFrame, name: str, version: int = VERSION) -> DataFrame:
    """``df`` with the columns of the current schema: missing ones null, surplus ones dropped. A newer schema is refused."""
    if version > VERSION:
        raise ValueError(f"{name} has schema {version}; this library knows {VERSION}")
    return empty(df.sparkSession, name).unionByName(df.select(*[c for c in empty(df.sparkSession, name).columns if c in df.columns]), allowMissingColumns=True)


def real_work() -> Column:
    return F.col("task_hash").isNull()


def golden() -> Column:
    return F.col("task_hash").isNotNull() & F.col("config").isin("active", "candidate", "audit")


def replicates() -> Column:
    return F.col("task_hash").isNotNull() & F.col("completed") & (F.col("config") == "active")
