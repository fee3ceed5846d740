"""Live transcripts, progress, and the store of voiceprints."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import segments as S
from tessera.operators import vectors as V
from tessera.sources.prints import SCHEMA, Conflict, Voiceprints
from tessera.streaming.progress import Progress
from tessera.streaming.transcripts import carried_stream, packed_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def ran(query, path, name):
    q = query.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and not q.isActive


MODEL = lambda text, before: f"{before}>{text}" if text else ""
PREFIX = lambda text: text[-3:]
CHUNK = "file_id string, ord long, ts timestamp, text string, start double, end double"


def chunks(spark, drop=()):
    r = random.Random(2)
    rows = [(f"f{f}", k, f"c{k}" if k % 5 else "", float(k), k + r.choice([0.5, 3.0, 9.0])) for f in range(3) for k in range(14) if (f, k) not in drop]
    return spark.createDataFrame(rows, "file_id string, ord long, text string, start double, end double").withColumn("ts", F.timestamp_seconds(F.col("ord") + 1_000_000)).select(*[c.split()[0] for c in CHUNK.split(", ")])


def test_a_stream_that_is_cut_and_restarted_equals_the_batch(rocks, tmp_path):
    spark, d = rocks, chunks(rocks)
    parts = d.withColumn("p", F.pmod(F.hash("file_id", "ord"), F.lit(3)))  # out of order, dealt to three runs
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(CHUNK).parquet(f"{tmp_path}/in")
    for p in range(3):
        parts.where(F.col("p") == p).drop("p").unionByName(d.where("ord = 3")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # and one row comes again and again
        ran(carried_stream(stream, MODEL, PREFIX), tmp_path, "carried")
        ran(packed_stream(stream, 12.0), tmp_path, "packed")
    said = spark.read.parquet(f"{tmp_path}/carried").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    got = {r.file_id: " ".join(t.text for t in r.t) for r in said.collect()}
    assert got == {r.file_id: r.text for r in S.transcribe_carried(d, MODEL, PREFIX).collect()}
    packed = {(r.file_id, r.ord, r.group) for r in spark.read.parquet(f"{tmp_path}/packed").collect()}
    assert packed == {(r.file_id, r.ord, r.group) for r in S.pack_greedy(d, 12.0).collect()}


def test_a_missing_chunk_is_given_up_and_a_late_one_dropped(rocks, tmp_path):
    spark, gone = rocks, (0, 4)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(CHUNK).parquet(f"{tmp_path}/in")
    chunks(spark, [gone]).where("file_id = 'f0'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = carried_stream(stream, MODEL, PREFIX, "1 second", 5.0)
    ran(query, tmp_path, "out")
    assert {r.ord for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1, 2, 3}
    later = spark.createDataFrame([("f9", 0, "x", 0.0, 1.0)], "file_id string, ord long, text string, start double, end double").withColumn("ts", F.timestamp_seconds(F.lit(1_000_900)))
    for _ in range(2):
        later.select(*[c.split()[0] for c in CHUNK.split(", ")]).write.mode("append").parquet(f"{tmp_path}/in")
        ran(query, tmp_path, "out")
    rest = {r.ord: r.text for r in spark.read.parquet(f"{tmp_path}/out").where("file_id = 'f0'").collect()}
    assert set(rest) == {k for k in range(14) if k % 5 and k != 4}
    chunks(spark).where("file_id = 'f0' AND ord = 4").write.mode("append").parquet(f"{tmp_path}/in")
    ran(query, tmp_path, "out")
    assert spark.read.parquet(f"{tmp_path}/out").where("file_id = 'f0'").count() == len(rest)


def test_progress_counts_what_is_written(spark):
    lines = []
    d = spark.range(100).withColumn("error", F.when(F.col("id") % 10 == 0, "bad"))

    def job(p):
        a = p.stage(d, "decode")
        return p.stage(a.where("error IS NULL").drop("error"), "merge")

    out = Progress(lines.append, 2).run(job)
    events = [json.loads(x) for x in lines]
    assert [(e["type"], e["step"], e["completed"], e["rows"]) for e in events] == [("progress", "decode", 1, 100), ("progress", "merge", 2, 90), ("result", "done", 2, 90)]
    assert events[0]["failed"] == 10 and events[1]["failed"] == 0 and out.count() == 90
    from tessera.sources.audio import parse_progress

    read = parse_progress(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.type, r.completed, r.total) for r in read] == [("progress", 1, 2), ("progress", 2, 2), ("result", 2, 2)]


def test_progress_ends_with_one_error(spark):
    lines = []

    def job(p):
        p.stage(spark.range(3), "one")
        return p.stage(spark.range(3).select(F.raise_error(F.lit("no good")).cast("int").alias("x")), "two")

    p = Progress(lines.append, 2)
    assert p.run(job) is None
    p.stage(spark.range(1), "after the end")
    events = [json.loads(x) for x in lines]
    assert [e["type"] for e in events] == ["progress", "error"] and events[1]["completed"] == 1 and events[1]["error"]
    empty = []
    assert Progress(empty.append, 0).run(lambda p: spark.range(0)).count() == 0 and json.loads(empty[0])["rows"] == 0


def sample(spark, *names):
    return spark.createDataFrame([(n, [float(len(n)), 1.0], 120.0, 0.1, 10.0) for n in names], "name string, v array<double>, pitch_hz double, energy_rms double, duration double")


def test_versions_are_snapshots(spark, tmp_path):
    store = Voiceprints(spark, str(tmp_path / "p"))
    assert store.read().count() == 0 and store.versions() == [] and store.read().schema == spark.createDataFrame([], SCHEMA).schema
    assert store.upsert(sample(spark, "ann", "bob")) == 1
    first = store.read()
    assert store.upsert(sample(spark, "bob", "cy")) == 2  # onto the path that it reads
    assert {r.name: r.total_speech_sec for r in store.read().collect()} == {"ann": 10.0, "bob": 20.0, "cy": 10.0}
    assert {r.name for r in first.collect()} == {r.name for r in store.read(1).collect()} == {"ann", "bob"}
    want = V.refined(sample(spark, "bob", "cy"), store.read(1))
    assert sorted(map(str, store.read(2).collect())) == sorted(map(str, want.select(*store.read(2).columns).collect()))
    assert store.upsert(sample(spark, "ann"), skip_existing=True) == 3 and {r.name: r.total_speech_sec for r in store.read().collect()}["ann"] == 10.0
    assert store.vacuum(1) == 2 and store.versions() == [3] and store.read().count() == 3


def test_a_crash_before_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Voiceprints(spark, str(tmp_path / "p"))
    store.upsert(sample(spark, "ann"))

    def crash(self, data, parent):
        raise OSError("gone")

    monkeypatch.setattr(Voiceprints, "_swap", crash)
    with pytest.raises(OSError):
        store.upsert(sample(spark, "bob"))
    monkeypatch.undo()
    assert store.versions() == [1] and [r.name for r in store.read().collect()] == ["ann"] and len(os.listdir(tmp_path / "p" / "data")) == 2
    assert store.vacuum() == 1 and store.read().count() == 1


def test_writers_don_t_lose_one_another_s_names(spark, tmp_path):
    store = Voiceprints(spark, str(tmp_path / "p"))
    store.upsert(sample(spark, "ann"))
    stale = store.read()
    store.upsert(sample(spark, "bob"))
    with pytest.raises(Conflict):
        store.write(stale, 1)
    assert [r.name for r in store.read().orderBy("name").collect()] == ["ann", "bob"]
    threads = [threading.Thread(target=store.upsert, args=(sample(spark, f"w{k}"),)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.name for r in store.read().collect()} == {"ann", "bob", "w0", "w1", "w2", "w3"} and store.versions() == [1, 2, 3, 4, 5, 6]
    assert not [f for f in os.listdir(tmp_path / "p" / "versions") if f.startswith("_")]
