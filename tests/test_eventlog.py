"""The event log as a source and sink: limits, restarts, order, repeated commits; lists with push and trim."""

import json

import pytest
from pyspark.sql import functions as F

from lakeloom.sources import eventlog as el
from lakeloom.streaming import jobs, sinks

SF = "/root/testdata/sf0.001"


def fill(spark, path, n=2500, start=0):
    rows = spark.range(start, start + n).select("id", (F.col("id") % 7).alias("item"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("at"))
    el.publish(rows, path, F.col("item"), F.col("at"), 4)
    return rows


def test_keys_keep_their_partition_and_order(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    fill(spark, path)
    fill(spark, path, 500, 2500)
    got = el.read_log(spark, path).collect()
    by = {}
    for r in got:
        by.setdefault(r.key, []).append((r.partition, json.loads(r.value)["id"]))
    assert len(got) == 3000 and len(by) == 7
    assert all(len({p for p, _ in x}) == 1 and [i for _, i in x] == sorted(i for _, i in x) for x in by.values())
    assert el.read_log(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="appended"):
        el.read_log(spark, path).write.format("event_log").mode("overwrite").save(path)


def test_batches_are_bounded_and_a_restart_counts_every_event_once(spark, tmp_path):
    path, seen, sizes = f"file://{tmp_path}/log", [], []
    fill(spark, path)
    follow = lambda: el.follow_log(spark, path, "id long, item long", f"file://{tmp_path}/group", 1000)

    def each(batch, number, fail_at=None):
        ids = [r.id for r in batch.collect()]
        if number == fail_at:
            raise RuntimeError("lost")
        seen.extend(ids)
        sizes.append(len(ids))

    with pytest.raises(Exception, match="lost"):
        sinks.run_until_idle(follow(), f"{tmp_path}/c", lambda b, n: each(b, n, 1), "0 seconds")
    assert sizes == [1000]
    sinks.run_until_idle(follow(), f"{tmp_path}/c", each, "0 seconds")  # the lost batch runs again
    fill(spark, path, 1200, 2500)
    sinks.run_until_idle(follow(), f"{tmp_path}/c", each, "0 seconds")
    sinks.run_until_idle(follow(), f"{tmp_path}/c", each, "0 seconds")
    assert sorted(seen) == list(range(3700)) and max(sizes) == 1000 and len([s for s in sizes if s]) <= 6


def test_a_reader_from_the_latest_events_sees_new_ones_only(spark, tmp_path):
    path, seen = f"file://{tmp_path}/log", []
    fill(spark, path, 50)
    stream = el.follow_log(spark, path, "id long", latest=True)
    running = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, n: seen.extend(r.id for r in b.collect())).start()
    running.processAllAvailable()
    fill(spark, path, 30, 50)
    running.processAllAvailable()
    running.stop()
    assert sorted(seen) == list(range(50, 80))


def test_a_stream_writes_to_a_log_and_a_repeated_commit_adds_nothing(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_events(spark, f"{tmp_path}/in", events.schema)
    spark.dataSource.register(el.EventLog)
    out = stream.select(F.pmod(F.xxhash64(F.col("user_id").cast("string")), F.lit(3)).cast("int").alias("partition"), F.col("user_id").cast("string").alias("key"), F.to_json(F.struct("event_id")).alias("value"), F.col("ts").cast("timestamp").alias("at"))
    running = out.writeStream.format("event_log").option("path", f"file://{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    running.awaitTermination()
    log = el.Segments(f"file://{tmp_path}/log")
    before = log.all()
    assert sum(log.ends().values()) == events.count()
    import pyarrow as pa

    again = log.stage([pa.RecordBatch.from_pydict({"partition": pa.array([0], pa.int32()), "key": ["k"], "value": ["{}"], "at": pa.array([None], pa.timestamp("us"))})])
    log.publish(again, "stream-0")  # batch 0 was committed already
    assert log.all() == before and not log._list("staged")


def test_a_commit_that_was_cut_short_is_finished(tmp_path):
    import pyarrow as pa

    log = el.Segments(f"file://{tmp_path}/log")
    batch = lambda p: pa.RecordBatch.from_pydict({"partition": pa.array([p], pa.int32()), "key": ["k"], "value": ["{}"], "at": pa.array([None], pa.timestamp("us"))})
    staged, moves = log.stage([batch(0), batch(1)]), []

    class Cut:
        def __getattr__(self, name):
            return getattr(log_fs, name)

        def move(self, a, b):
            moves.append(b)
            if len(moves) == 3:
                raise OSError("gone")
            log_fs.move(a, b)

    log_fs, log.fs = log.fs, Cut()
    with pytest.raises(OSError, match="gone"):
        log.publish(staged, "stream-7")
    again = el.Segments(f"file://{tmp_path}/log")
    assert len(again.all()) == 1
    again.publish(again.stage([batch(0), batch(1)]), "stream-7")
    assert again.ends() == {0: 1, 1: 1} and not again._list("staged")


def test_lists_are_trimmed_and_pushing_again_changes_nothing(spark, tmp_path):
    lists = sinks.CappedLists(spark, f"file://{tmp_path}/lists", 3, 4)
    push = lambda rows: lists.push(spark.createDataFrame(rows, "key string, at long, id long"))
    push([("a", t, t) for t in range(5)] + [("b", 1, 1), (None, 1, 1)])
    push([("a", 9, 1), ("a", 3, 7), ("a", 3, 7)])
    push([("a", 9, 1), ("a", 3, 7), ("a", 3, 7)])
    got = sorted((r.key, r.place, r.at, r.id) for r in lists.read().collect())
    assert got == [("a", 1, 9, 1), ("a", 2, 4, 4), ("a", 3, 3, 7), ("b", 1, 1, 1)]


def test_a_lost_batch_is_replayed_and_nothing_is_counted_twice(spark, tmp_path):
    import datetime as dt

    at = lambda hour, minute=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)
    rows = [(at(i // 4, i % 4), "k", float(i)) for i in range(40)]
    raw = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    early = sinks.EarlyWindows(spark, f"file://{tmp_path}/w", "1 hour", "2 hours", ("kind",))
    whole = early.windows(raw, "ts", "value")
    early.upsert(whole.filter("hour(start) not in (3, 4)"))  # lost
    early.upsert(whole.filter("hour(start) = 5").withColumn("n", F.col("n") + 1).withColumn("start", F.col("start") - F.expr("INTERVAL 30 MINUTES")))  # a window that raw events don't have
    state = lambda: sorted((r.start, r.n, r.total) for r in early.read().collect())
    told = early.replay(raw, "ts", "value", at(0), at(7)).first()
    assert (told.raw_events, told.counted_before, told.counted_after, told.changed) == (28, 25, 28, 3)
    assert state() == [(at(h), 4, float(sum(range(4 * h, 4 * h + 4)))) for h in range(10)]
    told = early.replay(raw, "ts", "value", at(0), at(7)).first()
    assert (told.counted_before, told.counted_after, told.changed) == (28, 28, 0)
    with pytest.raises(ValueError, match="open"):
        early.replay(raw, "ts", "value", at(0), at(9))

    merge, calls = early.table.merge, []

    def disturbed(*a, **b):  # the stream commits first
        if not calls:
            calls.append(1)
            stale = early.table._last()
            merge(whole.filter("hour(start) = 9"))
            early.table._last = lambda: stale
            try:
                return merge(*a, **b)
            finally:
                del early.table._last
        return merge(*a, **b)

    early.table.merge = disturbed
    assert early.replay(raw, "ts", "value", at(0), at(7)).first().counted_after == 28 and calls
    assert len(state()) == 10
