"""Batches held beside a table: the table is merged seldom, its readers see every batch, a batch that runs again changes nothing."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F
from test_views import best

from lakeloom.sources import eventlog as el
from lakeloom.streaming import jobs, sinks, views

BATCHES = 9


def test_lists_are_merged_seldom_and_read_whole(spark, tmp_path):
    lists, pushed = sinks.CappedLists(spark, f"file://{tmp_path}/lists", 3, 4), set()
    lists.held.least = 2
    for number in range(BATCHES):
        rows = [(f"k{i % 3}", (number * 7 + i) % 20, i) for i in range(6)] + [(None, 1, 1)]
        frame = spark.createDataFrame(rows, "key string, at long, id long")
        lists.push(frame, number)
        lists.push(frame, number)
        pushed.update(r for r in rows if r[0])
        want = [(k, p, a, i) for k in ("k0", "k1", "k2") for p, (a, i) in enumerate(sorted(((a, i) for q, a, i in pushed if q == k), reverse=True)[:3], 1)]
        assert sorted(map(tuple, lists.read().collect())) == want, number
    assert lists.table.version == 4  # made, then merged at 2, 4 and 8 batches; not once a batch


def test_windows_are_merged_seldom_and_read_whole(spark, tmp_path):
    early = sinks.EarlyWindows(spark, f"file://{tmp_path}/w", "1 hour", "2 hours", ("kind",))
    early.held.least = 2
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    for number in range(BATCHES):  # each batch tells the last window again and a new one
        rows = [(at(h), "k", number - h + 1, float(number), at(h)) for h in (number - 1, number) if h >= 0]
        frame = spark.createDataFrame(rows, "start timestamp, kind string, n long, total double, newest timestamp")
        early.upsert(frame, number)
        early.upsert(frame, number)
        got = sorted((r.start, r.n, r.provisional) for r in early.read().collect())
        assert got == [(at(h), min(2, number - h + 1), h + 1 > number - 2) for h in range(number + 1)], number
    assert early.table.version == 4
    told = early.replay(spark.createDataFrame([(at(h), "k", 1.0) for h in range(5) for _ in range(2)], "ts timestamp, kind string, value double"), "ts", "value", at(0), at(5)).first()
    assert (told.raw_events, told.counted_before, told.counted_after) == (10, 10, 10)


def test_top_items_of_held_batches(spark, tmp_path):
    rnd, counts, root = random.Random(5), Counter(), f"file://{tmp_path}/v"
    for number in range(BATCHES):
        rows = [(rnd.randrange(3), rnd.randrange(12), rnd.choice([1, 1, -1])) for _ in range(30)] + [(None, 1, 1), (1, None, 1)]
        counts.update({(0, 0): 0})
        for g, i, n in rows:
            if g is not None and i is not None:
                counts[g, i] += n
        frame = spark.createDataFrame(rows, "group long, item long, n long")
        view = views.TopView(spark, root, 3, buckets=4)  # as after a restart
        view.held.least = 2
        if number == 3:  # a refresh stops between the two tables; later batches come first
            view.tops.merge = lambda *a, **b: None
        view.hold(frame, number)
        view.hold(frame, number)
    view = views.TopView(spark, root, 3, buckets=4)
    assert view.counts.version == 4
    assert sorted(map(tuple, view.read().collect())) == best(counts, 3)


def test_likes_of_held_batches(spark, tmp_path):
    counts = jobs.LikeCounts(spark, f"file://{tmp_path}/c")
    counts.held.least = 2
    for number in range(BATCHES):
        frame = spark.createDataFrame([(1, "like"), (2, "like" if number % 3 else "unlike"), (3, "unlike")], "item long, action string")
        counts.each(frame, number)
        counts.each(frame, number)
    assert sorted(map(tuple, counts.read().collect())) == [(1, 9), (2, 3), (3, 0)] and len(counts.table.versions()) == 3


def test_members_share_a_log_and_a_full_batch_lists_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    rows = spark.range(2000).select("id", F.timestamp_seconds(F.col("id")).alias("at"))
    el.publish(rows, path, F.col("id"), F.col("at"), 4)
    listings, all_ = [], el.Segments.all
    monkeypatch.setattr(el.Segments, "all", lambda self: listings.append(1) or all_(self))
    got = []
    for member in range(2):
        reader = el.StreamReader({"path": path, "maxEvents": "100", "group": f"file://{tmp_path}/g{member}", "member": str(member), "members": "2"})
        here, batches = reader.initialOffset(), 0
        while (there := reader.latestOffset()) != here:
            ranges = reader.partitions(here, there)
            assert sum(r.end - r.start for r in ranges) <= 100
            got += [v for r in ranges for b in reader.read(r) for v in b.column("value").to_pylist()]
            here, batches = there, batches + 1
        assert batches >= 9
    assert len(got) == len(set(got)) == 2000
    assert len(listings) <= 10  # a few for each member, not for each batch or task


def test_a_drained_stream_leaves_its_rows_in_files(spark, tmp_path):
    spark.range(50).repartition(2).write.parquet(f"{tmp_path}/in")
    got = jobs.drain(jobs.read_events(spark, f"{tmp_path}/in", "id long"), f"file://{tmp_path}/c")
    assert got.count() == 50 and all(f.startswith("file:") for f in got.inputFiles()) and got.inputFiles()  # the memory sink has no files


def test_state_of_early_windows_has_few_parts_whatever_the_session_has(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        spark.range(40).coalesce(1).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("k").alias("kind"), F.col("id").cast("double").alias("value")).write.parquet(f"{tmp_path}/in")
        early = sinks.EarlyWindows(spark, f"file://{tmp_path}/w", "1 hour", "2 hours", ("kind",))
        early.follow(jobs.read_events(spark, f"{tmp_path}/in", "ts timestamp, kind string, value double"), "ts", "value", f"file://{tmp_path}/c")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "23"
        assert early.read().agg(F.sum("n")).first()[0] == 40
        assert len([p for p in (tmp_path / "c" / "state" / "0").iterdir() if p.name.isdigit()]) == early.STATE_PARTS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_small_batch_is_read_by_one_task_and_only_where_it_lies(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/log"
    el.publish(spark.range(9000).select("id", F.timestamp_seconds(F.col("id")).alias("at")), path, F.col("id"), F.col("at"), 4)
    whole = {p: [v for b in el.Segments(path).read(p, 0, 9000) for v in b.column("value").to_pylist()] for p in range(4)}
    assert sum(map(len, whole.values())) == 9000
    groups, read = [], pq.ParquetFile.read_row_groups
    monkeypatch.setattr(pq.ParquetFile, "read_row_groups", lambda self, wanted, *a, **b: groups.append(len(wanted)) or read(self, wanted, *a, **b))
    for a, b in ((0, 1), (0, 1000), (999, 1001), (1000, 2000), (1700, 2100), (2000, 10**6)):
        for p, values in whole.items():
            assert [v for x in el.Segments(path).read(p, a, b) for v in x.column("value").to_pylist()] == values[a:b]
    assert max(groups) == 2  # of three in each segment
    for most in (4000, 8000):
        reader = el.StreamReader({"path": path, "maxEvents": str(most), "group": f"file://{tmp_path}/g{most}"})
        here, there = reader.initialOffset(), reader.latestOffset()
        ranges = reader.partitions(here, there)
        assert len(ranges) == (1 if most == 4000 else 4)
        got = [v for r in ranges for b in reader.read(r) for v in b.column("value").to_pylist()]
        assert got == [v for p in range(4) for v in whole[p][: there[str(p)]]] and len(got) == most


def test_a_small_batch_is_one_file_and_replaces_itself(spark, tmp_path):
    folder = tmp_path / "out"
    for rows in (30, 20):
        sinks.write_file(spark.range(rows).repartition(3), f"file://{folder}/0-1.parquet")
    sinks.write_file(spark.range(0), f"file://{folder}/0-2.parquet")
    assert [p.name for p in folder.iterdir()] == ["0-1.parquet"]
    assert sorted(r.id for r in spark.read.parquet(str(folder)).collect()) == list(range(20))


def test_members_go_on_from_their_checkpoints(spark, tmp_path):
    path, before = f"file://{tmp_path}/log", spark.conf.get(sinks.CHECKPOINTS, None)
    for part in range(2):
        rows = spark.range(300 * part, 300 * part + 300).select("id", F.timestamp_seconds(F.col("id")).alias("at"))
        el.publish(rows, path, F.col("id"), F.col("at"), 4)
        streams = [el.follow_log(spark, path, "id long", f"file://{tmp_path}/g{m}", 50, member=m, members=2) for m in range(2)]
        sinks.run_members(streams, f"file://{tmp_path}/c", lambda batch, member, number: sinks.write_file(batch, f"file://{tmp_path}/out/{member}-{number}.parquet"))
        assert spark.conf.get(sinks.CHECKPOINTS, None) == before
    read = spark.read.parquet(f"{tmp_path}/out").select("id", F.col("_metadata.file_name").alias("batch"))
    assert sorted(r.id for r in read.collect()) == list(range(600))
    assert max(r["count"] for r in read.groupBy("batch").count().collect()) <= 50
