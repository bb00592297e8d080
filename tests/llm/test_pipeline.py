import random
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from millrace.llm.queries import oracle_sql, queries


def write(spark, folder):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "te", "su"]) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    rows = []
    for i in range(240):
        t = " ".join(word() for _ in range(rng.randint(30, 120))).capitalize() + "."
        if i % 8 == 0:
            t = "!! ".join(t.upper().split())
        if i % 30 == 1:
            t += "\n" + items[i % 5][1]
        rows.append((i, t, "en", f"src{i % 4}", len(t)))
    rows += [(1000 + i, rows[2][1] + (" extra" if i % 2 else ""), "en", "src0", 1) for i in range(20)] + [(2000, None, None, None, None), (2001, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = write(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    now, ids = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert now.columns == docs.columns
        ids.append({r.doc_id for r in now.select("doc_id").collect()})
    assert ids[0] <= {i for i in range(240) if i % 8} | set(range(1000, 1020)) | {2000, 2001} and len(ids[0]) > 200
    assert len(ids[1] & ({2} | set(range(1000, 1020)))) == 1 and len(ids[1]) > 190
    assert not any(i % 30 == 1 for i in ids[2] if i < 240) and ids[2] <= ids[1] and len(ids[2]) > len(ids[1]) - 12
    assert ids[4] == ids[3] <= ids[2]
    assert now.agg(F.max("shard")).first()[0] <= 23
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.columns == now.columns and sorted(map(str, run.collect())) == sorted(map(str, now.collect()))


def test_stages_take_what_comes(spark, tmp_path):
    """Nulls, empty and very long texts, rows repeated in full, unlike texts under one id, and columns of clashing names go through all stages; so does an empty table."""
    write(spark, str(tmp_path))
    rng = random.Random(32)
    say = lambda n: " ".join("".join(rng.choice(["ka", "lo", "mi", "te", "su"]) for _ in range(3)) for _ in range(n)).capitalize() + "."
    rows = [(i, say(60), "en", "s", 1) for i in range(40)] + [(7, say(60), None, None, None), (None, say(60), "en", "s", 1), (None, say(60), "en", "s", 1)]
    rows += [(100, say(200_000), "en", "s", 1), (101, None, "en", "s", 0), (102, "", "en", None, 0)] + [(50, say(60), "en", "s", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS row", "2 AS __key", "'x' AS item_id", "3 AS times", "4 AS good")
    for now in (docs, docs.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns
            at = f"{tmp_path}/edge{k}{now is docs}{name[:3]}{rng.random()}"
            out.write.parquet(at)
            now = spark.read.parquet(at)
            if name == "MinHash near-dedup" and now.count():
                assert now.filter("doc_id = 7").count() == 2 and now.filter("doc_id = 50").count() == 1 and now.filter("doc_id IS NULL").count() == 2


def test_queries_on_a_small_table(spark, tmp_path):
    docs = write(spark, str(tmp_path))
    n = docs.count()
    turns = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c}") for c in range(5) for t in range(1, 6)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    asked = {
        "op1": "doc_id held_out score predicted", "op2": "doc_id size text_crc32 law shard slot grown_shard", "op3": "doc_id size source_size target taken", "op4": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op6": "doc_id held_out score predicted", "op7": "doc_id held_out lang_pred score", "op9": "doc_id n_shingles component_id kept", "op10": "doc_id keep_id group_size kept text_sha256",
    }
    for name, build in queries().items():
        if name == "pipeline":
            continue
        rows = build(spark, str(tmp_path)).collect()
        op = name.split("_")[0]
        if op in asked:
            assert set(asked[op].split()) <= set(rows[0].__fields__) and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
        if op in ("op1", "op6"):
            least = 0.3 if op == "op1" else 0.7
            assert all(0 <= r.score <= 1 and r.predicted == (r.score >= least) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
        if op == "op2":
            text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
            assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24 for r in rows)
            for s in range(24):
                own = sorted(r.slot for r in rows if r.shard == s)
                assert own == list(range(len(own)))
        if op == "op7":
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.lang_pred in ("en", "und") for r in rows) and sum(r.lang_pred == "und" for r in rows) == 2
        if op == "op5":
            assert {r.doc_id for r in rows} == {i for i in range(240) if i % 30 == 1}
        if op == "op8":
            assert len(rows) == 6 and n == docs.count() and {r.conv_id: r.loss_chars for r in rows}[-1] == len("</s>[INST] ok [/INST]")


def test_registered():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
