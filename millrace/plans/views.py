"""The model's tables derived from the driver's tables, as SQL that Spark and DuckDB both run.

Spark gets them as views over Parquet; oracles put the same text in front of their own query. Only the derivation is shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUNS = """
SELECT event_id AS id, event_type AS agent, 's' || CAST(event_id AS VARCHAR(20)) AS session_id,
  CASE WHEN event_id % 3 = 0 THEN 't' || CAST(user_id % 7 AS VARCHAR(20)) END AS task_hash,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, {k} * 10 AS output_tokens, (event_id % 50) * 20 AS cache_creation, user_id * 5 AS cache_read,
  {k} % 12 AS tool_calls, {k} % 3 AS file_rereads, event_id % 11 <> 0 AS completed,
  CAST(floor((extract(day FROM ts) - 1) / 7) AS INT) + 1 AS ruleset_version, ts,
  CASE WHEN event_id % 3 <> 0 THEN 'real' WHEN event_id % 12 = 3 THEN 'candidate' WHEN event_id % 12 = 6 THEN 'audit' ELSE 'active' END AS config,
  CASE WHEN user_id % 10 <> 0 THEN CASE WHEN user_id % 9 = 0 THEN 'main' ELSE 'p' || CAST(user_id % 12 AS VARCHAR(20)) END END AS project,
  CASE user_id % 4 WHEN 1 THEN 'opus' WHEN 2 THEN 'sonnet' WHEN 3 THEN 'haiku' END AS model,
  CASE WHEN event_id % 5 <> 0 THEN {k} * 1000 END AS duration_ms
FROM events
"""
TOOL_COSTS = """
SELECT l_orderkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'builtin' WHEN 'R' THEN 'skill' ELSE 'mcp' END AS kind, l_linestatus AS grp,
  'tool' || CAST(l_linenumber AS VARCHAR(20)) AS label, CAST(l_quantity AS BIGINT) AS calls, CAST(floor(l_extendedprice / 10) AS BIGINT) AS input_chars,
  CAST(floor(l_extendedprice) AS BIGINT) AS result_chars
FROM lineitem
"""
RULES = """
SELECT c_custkey AS id, 'agent' || CAST(c_nationkey % 5 AS VARCHAR(20)) AS agent, c_mktsegment || ' rule ' || c_name AS body,
  CASE c_custkey % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'active' ELSE 'evicted' END AS status,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS measured_delta, c_custkey % 40 + 10 AS context_cost,
  CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 2 END AS source_run,
  CASE WHEN c_custkey % 3 <> 0 THEN 1700000000 + (c_custkey * 7919) % 20000000 END AS decided_s, 1690000000 + (c_custkey * 104729) % 9000000 AS created_s,
  c_custkey % 13 = 0 AS protected, c_custkey % 17 = 0 AS probation, CASE WHEN c_custkey % 6 = 1 THEN 'sql  only' WHEN c_custkey % 6 = 4 THEN '' END AS scope
FROM customer
"""
RECEIPTS = """
SELECT o_custkey AS rule_id, 'agent' || CAST(o_custkey % 5 AS VARCHAR(20)) AS agent, o_orderkey AS decided_no,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'P' THEN 'evicted' ELSE 'active' END AS status,
  CASE WHEN o_orderkey % 9 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) - 150000 END AS delta, o_orderkey % 50 + 10 AS context_cost, o_orderkey % 4 + 1 AS runs,
  o_orderkey % 20 = 0 AS regression, CASE o_orderkey % 4 WHEN 1 THEN 'opus' WHEN 2 THEN 'sonnet' WHEN 3 THEN 'haiku' END AS model, CAST(floor(o_totalprice / 3) AS BIGINT) AS with_tokens, CAST(floor(o_totalprice / 2) AS BIGINT) AS without_tokens
FROM orders
"""
MEASURES = """
SELECT agent AS comparison_id, CASE WHEN id % 2 = 0 THEN 'without' ELSE 'with' END AS side, task_hash AS task_id, id AS run_no, input_tokens + output_tokens + cache_creation AS tokens,
  completed, CASE WHEN task_hash IN ('t1', 't4') THEN 4.0E0 ELSE 1.0E0 END AS weight, 25 AS context_cost, cache_read, duration_ms
FROM runs WHERE task_hash IS NOT NULL
"""
STAFF = """
SELECT id, 'agent' || CAST(id % 5 AS VARCHAR(20)) AS agent, session_id, task_hash, input_tokens, output_tokens, cache_creation, cache_read, completed, ruleset_version, ts, config, project, model
FROM runs
"""
PAPERS = """
SELECT doc_id, CASE WHEN text IS NOT NULL THEN '# Paper ' || CAST(doc_id AS VARCHAR(20)) || chr(10) || text || chr(10) || '## Notes' || chr(10) || '- Always keep the ' ||
  CASE doc_id % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' WHEN 2 THEN 'household' ELSE 'farm' END || ' rule. Use partial files.' || chr(10) ||
  'Item ' || CAST(doc_id % 9 AS VARCHAR(20)) || '. Terms' || chr(10) || 'Total ' || CAST(doc_id AS VARCHAR(20)) || '.5' || chr(10) || 'LAST WORDS' || chr(10) || 'end' END AS text
FROM documents
"""
PROMPTS = """
SELECT CAST(conv_id AS VARCHAR(20)) || '-' || CAST(turn AS VARCHAR(20)) || c AS id, conv_id, turn, CASE c WHEN 'b' THEN text || ' again' WHEN 'd' THEN text || ' !' ELSE text END AS body
FROM conversations, (SELECT 'a' AS c UNION ALL SELECT 'b' AS c UNION ALL SELECT 'd' AS c) k WHERE role = 'user' AND (c = 'a' OR c = 'b' AND turn % 7 = 1 OR c = 'd' AND turn % 5 = 2)
"""
VIEWS = {"runs": RUNS, "staff": STAFF, "tool_costs": TOOL_COSTS, "rules": RULES, "receipts": RECEIPTS, "measures": MEASURES, "papers": PAPERS, "prompts": PROMPTS}
SOURCES = {"runs": "events", "staff": "runs", "measures": "runs", "tool_costs": "lineitem", "rules": "customer", "receipts": "orders", "papers": "documents", "prompts": "conversations"}
SPARK_K, DUCK_K = "CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"
BASE = ("events", "orders", "lineitem", "customer", "documents", "pages", "benchmark", "conversations", "labels")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named driver tables and derived tables. Nothing is read until it is used."""
    out: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in out:
            if name in VIEWS:
                out[name] = spark.sql(VIEWS[name].format(k=SPARK_K).replace(f"FROM {SOURCES[name]}", "FROM {source}"), source=get(SOURCES[name]))
            else:
                out[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return out[name]

    for n in names:
        get(n)
    return out


def oracle(query: str, *names: str) -> str:
    """DuckDB SQL of ``query`` after the derived tables it names; a query that begins with WITH adds its own."""
    wanted = [n for n in VIEWS if n in names or n == "runs" and ("measures" in names or "staff" in names)]
    head = ", ".join(f"{n} AS ({VIEWS[n].format(k=DUCK_K).strip()})" for n in wanted)
    q = query.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if q.startswith(start) and head:
            return f"{start}{head}, {q[len(start):]}"
    return f"WITH {head} {q}" if head else q
