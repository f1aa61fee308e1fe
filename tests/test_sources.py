"""Readers, writers, resumable stages and streaming, on local files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequora.operators.taxonomy import FIVE_DOMAINS
from sequora.plans import io_queries
from sequora.plans.pipeline import event_pipeline
from sequora.sources import readers, writers
from sequora.streaming import incremental


def test_log(spark, tmp_path):
    event = json.dumps([{"Type": "MSN", "Texts": ["a\tb", "u"], "time": "2024-01-01 00:01"}])
    for i in range(2):
        (tmp_path / f"train_chunk_{i}.tsv").write_text(f"uid\tevents\nu{i}\t{event}\nshort line\nv{i}\t[oops\nw{i}\t[]\textra\n")
    rows = readers.log(spark, str(tmp_path)).orderBy("uid").collect()
    assert [(r.uid, r.bad) for r in rows] == [("u0", False), ("u1", False), ("v0", True), ("v1", True), ("w0", rows[4].bad), ("w1", rows[4].bad)]
    assert rows[0].events[0].Texts == ["a\tb", "u"]
    assert {r.chunk for r in readers.chunks(spark, str(tmp_path)).collect()} == {"train_chunk_0.tsv", "train_chunk_1.tsv"}


def test_text_forms(spark, tmp_path):
    (tmp_path / "r.dat").write_bytes("1::Caf\xe9 (1999)::3\n".encode("latin-1"))
    assert readers.delimited(spark, str(tmp_path / "r.dat"), "user_id int, title string, stars double").first()["title"] == "Café (1999)"
    (tmp_path / "c.csv").write_text("userId,x\n1,2\n")
    assert readers.renamed_csv(spark, str(tmp_path / "c.csv"), "userId int, x int", {"userId": "user_id"}).columns == ["user_id", "x"]
    (tmp_path / "ranks.jsonl").write_text('{"user_id":"a","target_type":"MSN","target_rank":3,"top_k":10}\n')
    assert readers.rank_records(spark, str(tmp_path / "ranks.jsonl")).first()["target_rank"] == 3
    (tmp_path / "m.json").write_text('{\n"n": 5\n}')
    assert readers.metadata(spark, str(tmp_path / "m.json")).first()["n"] == 5


def test_arrays_and_existence(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float16).reshape(3, 2))
    np.savez(tmp_path / "b.npz", x=np.ones(2))
    rows = readers.arrays(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.row, r["values"]) for r in rows) == [("", 0, [0, 1]), ("", 1, [2, 3]), ("", 2, [4, 5]), ("x", 0, [1]), ("x", 1, [1])]
    assert not readers.exists(spark, str(tmp_path / "none"))


def test_npy_shards(spark, tmp_path):
    """Half precision, rows at their places, zeros between them and after them, other headers, ranges that end within a file."""
    rng = np.random.default_rng(1)
    rows = [(d, i, [float(x) for x in rng.standard_normal(3)]) for d in (0, 4) for i in range(50) if i % 7]
    df = spark.createDataFrame(rows, "shard long, row long, v array<double>")
    writers.npy_shards(df, f"file://{tmp_path}/s", "shard", "row", "v", 3, rows=60)
    for d in (0, 4):
        got = np.load(tmp_path / "s" / f"shard_{d}.npy")
        want = np.zeros((60, 3), np.float16)
        for s, i, v in rows:
            if s == d:
                want[i] = v
        assert got.dtype == np.float16 and np.array_equal(got, want)
    back = readers.npy_rows(spark, f"file://{tmp_path}/s", rows=25, step=7).collect()
    assert len(back) == 120 and all(np.array_equal(np.load(r.path.removeprefix("file://"))[r.row].astype(float), r["values"]) for r in back)
    np.save(tmp_path / "flat.npy", np.arange(3))
    with pytest.raises(ValueError, match="two-dimensional"):
        readers.npy_rows(spark, f"file://{tmp_path}")


def test_npy_shard_is_written_by_one_task(spark, tmp_path):
    """Also where adaptive execution makes joins on the shard broadcast ones and reads their sides in place."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    past = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 1000, 1, 4).selectExpr("id % 40 as shard", "id div 40 as row", "array(id + 1.0D, -id) as v")
        writers.npy_shards(df, f"file://{tmp_path}/s", "shard", "row", "v", 2, dtype="float32")
    finally:
        for k, v in past.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for d in range(40):
        ids = np.arange(d, 1000, 40)
        assert np.array_equal(np.load(tmp_path / "s" / f"shard_{d}.npy"), np.stack([ids + 1, -ids], 1))


def test_npy_read_back_keeps_the_sign_of_zero(spark):
    rows = spark.createDataFrame([("s/shard_1.npy", 0, [-1e-7, 1e-7 - 1e-5]), ("s/shard_1.npy", 1, [1e-7, 0.0])], "path string, row long, values array<double>")
    assert sorted(map(repr, map(tuple, io_queries._read_back(rows).collect()))) == ["(1, 0, -0.0, -0.0)", "(1, 1, 0.0, 0.0)"]


def test_single_file_and_row_ranges(spark, tmp_path):
    writers.single_file(spark, lambda to: spark.range(3).coalesce(1).selectExpr("cast(id as string) v").write.text(to), f"file://{tmp_path}/one.txt")
    assert (tmp_path / "one.txt").read_text() == "0\n1\n2\n" and not [p for p in tmp_path.iterdir() if p.is_dir()]
    with pytest.raises(ValueError, match="part files"):
        writers.single_file(spark, lambda to: spark.range(4).repartition(2).selectExpr("cast(id as string) v").write.text(to), f"file://{tmp_path}/two.txt")
    writers.row_ranges(spark.range(0, 230, 2), f"file://{tmp_path}/r", "id", 4, width=16)
    got = spark.read.parquet(f"file://{tmp_path}/r").groupBy("part").agg(F.count("*"), F.min("id"), F.max("id")).collect()
    assert sorted(map(tuple, got)) == [(0, 28, 0, 54), (1, 28, 56, 110), (2, 28, 112, 166), (3, 31, 168, 228)]
    assert writers.finished(spark, f"file://{tmp_path}/r") and not writers.finished(spark, f"file://{tmp_path}/none")


def test_writers(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("domain_id"), F.floor(F.col("id") / 5).alias("shard"), F.array(F.col("id").cast("double") / 3).alias("v"))
    writers.parquet(df, str(tmp_path / "p"), files=1)
    assert readers.exists(spark, str(tmp_path / "p")) and len(list((tmp_path / "p").glob("*.parquet"))) == 1
    writers.parquet_files(df.coalesce(1), str(tmp_path / "f"), 4)
    assert len(list((tmp_path / "f").glob("*.parquet"))) == 3
    writers.one_row_tsv(spark.sql("select 1000 as offset"), str(tmp_path / "o"))
    assert next((tmp_path / "o").glob("*.csv")).read_text() == "offset\n1000\n"
    writers.embeddings_tsv(df.where("id = 1").coalesce(1), str(tmp_path / "e"), "id", "v")
    assert "1\t0.333333\n" in [p.read_text() for p in (tmp_path / "e").glob("*.csv")]
    writers.shards(df, str(tmp_path / "s"))
    writers.shards(df.where("domain_id = 0 and shard = 0").withColumn("id", F.col("id") + 100), str(tmp_path / "s"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 3, 5, 6, 7, 8, 9, 100, 102, 104]
    for _ in range(2):
        writers.append_records(spark.sql("select 1 as a"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.report(spark.sql("select 'Ad' as g, 0.5 as ndcg"), str(tmp_path / "r"))
    writers.sequences_csv(df.select("id", "v"), str(tmp_path / "q"), "id", ["v"])
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).count() == 10


def test_synthetic(spark):
    rows = readers.synthetic_sequences(spark, 20).collect()
    assert all(10 <= len(r.encoded_ids) <= 200 and r.encoded_ids[-1] < 10**9 and r.timestamps_unix == sorted(r.timestamps_unix) for r in rows)


def test_event_pipeline_resumes(spark, tmp_path):
    events = [{"time": f"2024-01-0{i}T00:00:00Z", "Type": t, "Texts": [f"t{i}", "u"]} for i, t in enumerate(["NativeClick", "MSN", "UET", "EdgeSearchQuery", "NativeClick"], 1)]
    raw = spark.createDataFrame([(u, json.dumps(events)) for u in range(3)], "user_id long, EventsOnlyWithAd string")
    p = event_pipeline(spark, raw, str(tmp_path), FIVE_DOMAINS)
    done = p.run()
    assert [len(r.encoded_id) for r in done["sequences"].collect()] == [5, 5, 5] and done["split"].count() == 3
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    p.run()
    assert before == {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    df = spark.createDataFrame([(1, 10, i, 100 + i) for i in (1, 3, 2)] + [(2, 5, 9, 109)], "user_id long, t long, event_id long, id long")
    df.write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).parquet(str(source))
    q = incremental.latest_sequences(stream, 2).writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.user_id, r.n, r.ids) for r in spark.table("latest").collect()} == {(1, 2, "102,103"), (2, 1, "109")}
    timed = stream.select("user_id", F.timestamp_seconds("t").alias("time"), F.lit("view").alias("kind"))
    q = incremental.window_counts(timed, "time", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.n, r.users) for r in spark.table("counts").collect()] == [(4, 2)]
