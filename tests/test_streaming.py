import json
import os

from pyspark.sql import functions as F

from millrace.schemas import empty
from millrace.sources.registry import fold_log, open_ledger, save_table
from millrace.streaming import collect


def line(i, session, total, ts):
    return json.dumps({"id": i, "agent": "a", "session_id": session, "input_tokens": total, "output_tokens": 0, "cache_creation": 0, "cache_read": 0, "completed": True, "ts": ts})


def test_ledger_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    ledger, check = str(tmp_path / "ledger"), str(tmp_path / "check")
    (src / "1.json").write_text(line(1, "s1", 5, "2024-01-01T00:00:00Z") + "\n" + line(2, "s2", 7, "2024-01-01T00:01:00Z") + "\n")
    collect.keep_ledger(collect.run_stream(spark, str(src)), ledger, check).awaitTermination(120)
    (src / "2.json").write_text(line(3, "s1", 9, "2024-01-01T01:00:00Z") + "\n")
    collect.keep_ledger(collect.run_stream(spark, str(src)), ledger, check).awaitTermination(120)
    got = {r.session_id: r.input_tokens for r in open_ledger(spark, ledger)["runs"].collect()}
    assert got == {"s1": 9, "s2": 7}
    fold_log(spark, ledger)
    assert {r.session_id: r.input_tokens for r in spark.read.parquet(f"{ledger}/runs").collect()} == got
    (src / "3.json").write_text(line(4, "s2", 8, "2023-01-01T00:00:00Z") + "\n")  # arrival counts, not the time it tells
    collect.keep_ledger(collect.run_stream(spark, str(src)), ledger, check).awaitTermination(120)
    assert {r.session_id: r.input_tokens for r in open_ledger(spark, ledger)["runs"].collect()} == {"s1": 9, "s2": 8}
    fold_log(spark, ledger)
    fold_log(spark, ledger)
    assert {r.session_id: r.input_tokens for r in open_ledger(spark, ledger)["runs"].collect()} == {"s1": 9, "s2": 8}


def test_stateful_triggers(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"agent": "a", "id": i, "total": 10_000} for i in range(6)] + [{"agent": "a", "id": 6, "total": 40_000}, {"agent": "a", "id": 7, "total": 9_000}]
    for k, part in enumerate((rows[:4], rows[4:])):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(src / f"{k}.json", (1_700_000_000 + 100 * k,) * 2)  # files come by age
    stream = spark.readStream.schema("agent string, id long, total long").option("maxFilesPerTrigger", 1).json(str(src))
    q = collect.triggers(stream).writeStream.format("memory").queryName("triggered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.id: r.triggered for r in spark.table("triggered").collect()}
    assert got[6] and not got[7] and len(got) == 8


def test_ledger_tables(spark, tmp_path):
    tables = open_ledger(spark, str(tmp_path))
    assert all(t.isEmpty() for t in tables.values())
    save_table(empty(spark, "questions").union(spark.sql("SELECT 1L, 'a', 'b', 'q', 1, current_timestamp()")), str(tmp_path), "questions")
    assert open_ledger(spark, str(tmp_path))["questions"].count() == 1
    assert spark.table("questions").filter(F.col("approved") == 1).count() == 1


def test_approvals_across_batches(spark, tmp_path):
    """An answer approves the latest pending question of its kind, also one of a batch before; the next answer the one before it."""
    names = "from_agent string, to_agent string, body string, seq long, id long, answered boolean"
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    got = []
    for k, rows in enumerate(([("a", "b", "q", 1, 1, False), ("a", "b", "q", 2, 2, False), ("a", "c", "q", 3, 3, False)], [("a", "b", "q", 4, None, True), ("a", "b", "q", 5, None, True), ("a", "b", "q", 6, None, True), ("x", "y", "z", 7, None, True)])):
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(src)
        q = collect.approvals(spark.readStream.schema(names).parquet(src)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        got.append(sorted(r.id for r in spark.read.schema("from_agent string, to_agent string, body string, id long").parquet(out).collect()))
    assert got == [[], [1, 2]]
