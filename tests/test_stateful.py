"""Streams that start from a snapshot, chained rules and joins of streams, each against the batch rule."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import keyed, stateful


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    stateful.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a state store and a Python worker each
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def source(spark, folder, df, files, *last):
    """``df`` in order of time, in as many files, a file a micro-batch; then one for each of ``last``."""
    rows, known = df.orderBy("ts", "event_id").collect(), set()
    parts = [spark.createDataFrame(rows[i * len(rows) // files : (i + 1) * len(rows) // files], df.schema) for i in range(files)]
    for i, part in enumerate([*parts, *last]):
        part.coalesce(1).write.mode("append").parquet(str(folder))
        new = set(folder.glob("*.parquet")) - known
        for f in new:  # files are taken in order of their times
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
        known |= new
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, tmp_path, stream, mode):
    name = f"t{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name).collect()


def log(spark, n=160):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), 60 + i * 60 + rng.randint(0, 40), rng.choice(["discovering", "in_progress", "segment_ready", "ready", "failed", "voiced"]), rng.choice([None, 5, 7]), rng.choice([None, "x", "y"]), rng.choice([None, 0, 3, 9]), rng.choice([1, 2, 8]), rng.randint(0, 2)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, k string, s long, status string, duration_ms int, audio_key string, total int, done int, part int").withColumn("ts", F.timestamp_seconds("s"))


def folded(df):
    pair = df.withColumn("pair", F.struct("k", "part"))
    both = keyed.current_status(pair, "pair").join(keyed.progress(pair, "pair"), "pair")
    return both.select("pair.k", "pair.part", "status", "duration_ms", "audio_key", "total", "done")


def test_a_fold_goes_on_from_a_snapshot(spark, tmp_path):
    df = log(spark)
    first, second = df.where("event_id < 80"), df.where("event_id >= 80")
    stream = stateful.folded_stream(source(spark, tmp_path / "in", second, 1), "k", "part", folded(first))
    last = {(r.k, r.part): r for r in folded(first).collect()}
    for r in run(spark, tmp_path, stream, "update"):
        last[r.k, r.part] = r
    assert {k: tuple(r)[2:] for k, r in last.items()} == {(r.k, r.part): tuple(r)[2:] for r in folded(df).collect()}


def test_windows_go_on_from_a_snapshot(spark, tmp_path):
    df = log(spark).select("event_id", "k", "ts")
    first, second = df.where("event_id < 80"), df.where("event_id >= 80")
    before = stateful.open_windows(keyed.anchored(first, "k", 1500), "k")
    got = run(spark, tmp_path, stateful.windows_stream(source(spark, tmp_path / "in", second, 2), "k", 1500, before), "append")
    want = {r.event_id: (r.in_window, r.opens) for r in keyed.anchored(df, "k", 1500).collect() if r.event_id >= 80}
    assert {r.event_id: (r.in_window, r.opens) for r in got} == want


def test_forced_events_pass_on_a_stream(spark, tmp_path):
    df, forced = log(spark, 90).select("event_id", "k", "ts"), F.col("event_id") % 10 == 3
    got = run(spark, tmp_path, stateful.windows_stream(source(spark, tmp_path / "in", df, 2), "k", 900, forced=forced), "append")
    assert sorted(r.event_id for r in got if r.opens) == sorted(r.event_id for r in keyed.throttled(df, "k", 900, forced).collect())


def test_counters_are_right_after_every_micro_batch(spark, tmp_path):
    df = log(spark)
    stream = stateful.counters_stream(source(spark, tmp_path / "in", df, 2), "k", "part")
    rows = df.orderBy("ts", "event_id").collect()
    seen = []

    def check(batch, number):
        seen.append({r.k: (r.voiced, r.failed) for r in batch.collect()})

    stream.writeStream.foreachBatch(check).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(240)
    assert len([s for s in seen if s]) == 2
    now = {}
    for i, counts in enumerate([s for s in seen if s], 1):
        now |= counts
        so_far = spark.createDataFrame(rows[: i * len(rows) // 2], df.schema)
        assert now == {r.k: (r.voiced, r.failed) for r in keyed.once_only(so_far, "k", "part").collect()}


def test_repeated_ids_go_once_within_the_delay(spark, tmp_path):
    rows = [(1, "x", 100), (2, "y", 110), (3, "x", 130), (4, "x", 150), (5, "z", 9000), (6, "z", 9010), (7, "q", 9020), (8, "q", 9030), (9, "x", 9040), (10, "z", 9050)]
    df = spark.createDataFrame(rows, "event_id long, job string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = run(spark, tmp_path, stateful.once_within(source(spark, tmp_path / "in", df, 5), "job", "1 minute"), "append")
    assert sorted(r.event_id for r in got) == [1, 2, 5, 7, 9]  # the first x is forgotten in the micro-batch after the one that moved the watermark past it


def test_stuck_books_by_a_join_of_streams(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c", "d", "e", "f"]), i * 700 + rng.randint(0, 600), rng.choice(["discovering", "discovering", "ready"])) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, book_id string, s long, status string").withColumn("ts", F.timestamp_seconds("s"))
    jobs = spark.createDataFrame([(1000 + i, rng.choice(["a", "b", "c"]), i * 900 + 5, rng.choice(["active", "waiting", "failed"])) for i in range(45)], "event_id long, book_id string, s long, state string").withColumn("ts", F.timestamp_seconds("s"))
    late = [spark.createDataFrame([(5000 + i, "zz", s, "ready")], "event_id long, book_id string, s long, status string").withColumn("ts", F.timestamp_seconds("s")) for i, s in enumerate((10**6, 2 * 10**6))]
    late_jobs = [x.withColumnRenamed("status", "state") for x in late]
    want = sorted(r.event_id for r in stateful.stuck_stream(df, jobs, 60).collect())
    assert want == sorted(i for i, b, s, st in rows if st == "discovering" and not any(b2 == b and (s, i) < (s2, i2) and s2 <= s + 3600 for i2, b2, s2, *_ in rows) and not any(r.book_id == b and s <= r.s <= s + 3600 and r.state != "failed" for r in jobs.collect()))
    log_stream, job_stream = source(spark, tmp_path / "log", df, 1, *late), source(spark, tmp_path / "jobs", jobs, 1, *late_jobs)
    got = run(spark, tmp_path, stateful.stuck_stream(log_stream, job_stream, 60), "append")
    assert sorted(r.event_id for r in got) == want and want


def test_orphans_by_a_join(spark):
    segs = spark.createDataFrame([(1, 1, 1, "processing", 0), (2, 1, 2, "annotated", 0), (3, 1, 3, "voiced", 0), (4, 2, 1, "processing", 100)], "event_id long, chapter_id int, segment_index int, status string, s long").withColumn("ts", F.timestamp_seconds("s"))
    jobs = spark.createDataFrame([(9, 1, 1, "active", 60), (10, 1, 2, "failed", 60), (11, 2, 1, "active", 900)], "event_id long, chapter_id int, segment_index int, state string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.event_id for r in stateful.orphan_stream(segs, jobs).collect()) == [2, 4]


def test_subscriptions_take_effect_at_the_next_batch(spark, tmp_path):
    events = lambda *ids: [json.dumps({"event_id": i, "book_id": i % 3, "type": "ready" if i % 2 else "failed"}) for i in ids] + ["not json"]
    subscribe = lambda rows: spark.createDataFrame(rows, "listener string, book_id long, types array<string>").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "subs"))
    (tmp_path / "in").mkdir()

    def batch(n, lines):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        stream = keyed.event_source(spark, str(tmp_path / "in"), "event_id long, book_id long, type string")
        stateful.delivered(stream, str(tmp_path / "subs"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
        return sorted((r.listener, r.event_id) for r in spark.read.parquet(str(tmp_path / "out" / f"batch={n}")).collect())

    subscribe([("ann", 1, ["ready"]), ("bo", 1, None), ("cy", 2, ["ready"])])
    assert batch(0, events(1, 2, 3, 4)) == [("ann", 1), ("bo", 1), ("bo", 4)]
    subscribe([("ann", 1, ["failed"]), ("cy", 0, None)])
    assert batch(1, events(7, 10, 12)) == [("ann", 10), ("cy", 12)]
