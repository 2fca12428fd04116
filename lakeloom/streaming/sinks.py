"""Sinks of streams in the shared folder: lists by key with push and trim, and runs that end when their source is used up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.aggregates import top_per_group
from lakeloom.sources.versioned import Conflict, VersionedTable
from lakeloom.streaming.held import Held

CHECKPOINTS = "spark.sql.streaming.checkpointFileManagerClass"


class CappedLists:
    """The newest entries of each key, at most so many, in a versioned table with a row a key. A push reads and rewrites the buckets of its keys only;
    pushes with a number are held beside the table and merged together.

    An entry is (at, id); a list holds an entry once, newest first, ties by the larger id. So a batch that is pushed again changes nothing."""

    def __init__(self, spark: SparkSession, root: str, keep: int, buckets: int = 16):
        self.table, self.keep, self.held = VersionedTable(spark, root, ["key"], buckets), keep, Held(spark, f"{root}/held")

    def push(self, entries: DataFrame, number: int | None = None) -> None:
        """entries: key, at, id. The signature of foreachBatch."""
        if number is None:
            return self._merge(entries)
        entries = entries.select("key", "at", "id")
        if not self.table.version:
            self.table.append(self.held.spark.createDataFrame([], f"key {_type(entries, 'key')}, entries array<struct<at: {_type(entries, 'at')}, id: {_type(entries, 'id')}>>"))
        taken = self.table.last_note("batch", -1)
        if number <= taken:
            return
        self.held.put(entries, number)
        if self.held.due(number, taken):
            self._merge(self.held.read(self.held.numbers(taken, number), entries.schema), {"batch": number})

    def _merge(self, entries: DataFrame, note: dict | None = None) -> None:
        first = top_per_group(entries.select("key", "at", "id").filter("key is not null").distinct(), ["key"], [F.col("at").desc(), F.col("id").desc()], self.keep)
        fresh = first.groupBy("key").agg(F.collect_list(F.struct("at", "id")).alias("entries"))  # at most keep entries a key
        if not self.table.version:
            old = fresh.limit(0)
            self.table.append(old)
        known = self.table.read().withColumnRenamed("entries", "known")
        both = fresh.join(known, "key", "left")
        lists = F.array_distinct(F.concat("entries", F.coalesce("known", F.array().cast(fresh.schema["entries"].dataType))))
        self.table.merge(both.select("key", F.slice(F.sort_array(lists, asc=False), 1, self.keep).alias("entries")), note=note)

    def read(self) -> DataFrame:
        """key, place (from 1), at, id."""
        taken = self.table.last_note("batch", -1)
        kept, numbers = self.table.read(), self.held.numbers(taken)
        if numbers:
            known = kept.select("key", F.explode("entries").alias("entry")).select("key", "entry.at", "entry.id")
            fresh = self.held.read(numbers, known.schema).filter("key is not null")
            first = top_per_group(known.unionByName(fresh).distinct(), ["key"], [F.col("at").desc(), F.col("id").desc()], self.keep)
            return first.select("key", F.col("rank").alias("place"), "at", "id")
        rows = kept.select("key", F.posexplode("entries").alias("place", "entry"))
        return rows.select("key", (F.col("place") + 1).alias("place"), "entry.at", "entry.id")


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def run_until_idle(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], every: str = "1 second", mode: str = "append", state_parts: int | None = None) -> None:
    """Runs a stream in batches that begin at most once in the given time, until its source has nothing more.

    state_parts: of the stream's state, where that is small. Every batch reads and commits each part, whatever it brings, so the session's number of
    shuffle partitions would be paid once a batch. A stream keeps the number that it began with."""
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    try:
        if state_parts:
            conf.set(name, state_parts)
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(each).start()  # runs in a copy of the session
    finally:
        conf.set(name, before)
    try:
        running.processAllAvailable()
    finally:
        running.stop()


def write_file(batch: DataFrame, path: str) -> None:
    """Writes a small batch as one Parquet file at a URI. Its task writes it aside and renames it, so it is there whole or not at all, and one that is written again replaces itself.

    Spark's own writer makes, commits and deletes several folders for each write, which takes longer than a thousand rows do. A batch without rows has no file."""

    def put(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        rows = [b for b in batches if b.num_rows]
        if rows:
            files, target = fs.FileSystem.from_uri(path)
            folder, _, name = target.rpartition("/")
            files.create_dir(folder, recursive=True)
            aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(aside) as out:
                pq.write_table(pa.Table.from_batches(rows), out)
            if files.get_file_info(target).is_file:
                files.delete_file(target)
            files.move(aside, target)
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(b.num_rows for b in rows)], pa.int64())})

    batch.coalesce(1).mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def run_members(streams: Sequence[DataFrame], checkpoint: str, each: Callable[[DataFrame, int, int], None]) -> None:
    """Runs the streams that share a log side by side, each with its own checkpoint, until there is nothing more. each: batch, member, number.

    On a local folder Spark's usual writer of checkpoints starts several processes (readlink) for each file, two files a batch; the one taken there checks and renames as well, without them."""
    bound = lambda member: lambda batch, number: each(batch, member, number)
    conf, running = streams[0].sparkSession.conf, []
    before = conf.get(CHECKPOINTS, None)
    try:
        if before is None and checkpoint.startswith("file:"):
            conf.set(CHECKPOINTS, "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
        running += [s.writeStream.option("checkpointLocation", f"{checkpoint}/{m}").trigger(processingTime="0 seconds").foreachBatch(bound(m)).start() for m, s in enumerate(streams)]  # in copies of the session
    finally:
        conf.unset(CHECKPOINTS) if before is None else conf.set(CHECKPOINTS, before)
    try:
        for r in running:
            r.processAllAvailable()
    finally:
        for r in running:
            r.stop()


class EarlyWindows:
    """Windows that are shown while they are open. Each batch of a stream in update mode upserts the windows that it changed, whole, so a batch
    that runs again changes nothing. Batches with a number are held beside the table and merged together. A window is provisional until the watermark, the newest event less the delay, has passed its end."""

    #: Of the stream's state, which has the open windows only, however many events there are.
    STATE_PARTS = 4

    def __init__(self, spark: SparkSession, root: str, width: str, late: str, keys: tuple[str, ...] = ()):
        self.table, self.width, self.late, self.keys = VersionedTable(spark, root, ["start", *keys], 8), width, late, list(keys)
        self.held = Held(spark, f"{root}/held")

    def windows(self, events: DataFrame, at: str, value: str) -> DataFrame:
        """The stream of changed windows: start, the keys, n, total, newest."""
        grouped = events.withWatermark(at, self.late).groupBy(F.window(at, self.width).alias("w"), *self.keys)
        rows = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(at).alias("newest"))
        return rows.select(F.col("w.start").alias("start"), *self.keys, "n", "total", "newest")

    def upsert(self, rows: DataFrame, number: int | None = None) -> None:
        """The signature of foreachBatch; the stream must be in update mode."""
        if not self.table.version:
            self.table.append(self.held.spark.createDataFrame([], rows.schema))
        if number is None:
            self.table.merge(rows, order="n")
            return
        taken = self.table.last_note("batch", -1)
        if number <= taken:
            return
        self.held.put(rows, number)
        if self.held.due(number, taken):
            self.settle()

    def follow(self, events: DataFrame, at: str, value: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
        """Upserts the windows of a stream of events until its source has nothing more. each: instead of upsert."""
        run_until_idle(self.windows(events, at, value), checkpoint, each or self.upsert, "0 seconds", "update", self.STATE_PARTS)

    def settle(self) -> None:
        """Merges what is held into the table. A window only grows, so of its states the one with most events is the last."""
        taken = self.table.last_note("batch", -1)
        if numbers := self.held.numbers(taken):
            self.table.merge(self.held.read(numbers, self.table.read().schema), order="n", note={"batch": numbers[-1]})

    def _last_states(self) -> DataFrame:
        taken = self.table.last_note("batch", -1)
        rows, numbers = self.table.read(), self.held.numbers(taken)
        if not numbers:
            return rows
        both = rows.withColumn("_held", F.lit(0)).unionByName(self.held.read(numbers, rows.schema).withColumn("_held", F.lit(1)))
        return both.groupBy("start", *self.keys).agg(F.max_by(F.struct(*rows.columns), F.struct("_held", "n")).alias("_last")).select("_last.*")

    def read(self) -> DataFrame:
        """The last state of each window, with provisional."""
        rows = self._last_states()
        seen = rows.agg(F.max("newest").alias("seen"))  # one row
        open_ = F.col("start") + F.expr(f"INTERVAL {self.width}") > F.col("seen") - F.expr(f"INTERVAL {self.late}")
        return rows.join(F.broadcast(seen)).select("start", *self.keys, "n", "total", open_.alias("provisional"))

    def replay(self, raw: DataFrame, at: str, value: str, begin, end, tries: int = 5) -> DataFrame:
        """Makes the windows that start from begin up to end anew from raw events, while the stream goes on; running it again changes nothing.

        Only final windows are replayed (ValueError else): an open one would be overwritten from the stream's state. A batch of the
        stream that commits meanwhile makes the merge start over. Returns one row: raw_events, counted_before, counted_after, changed (windows)."""
        inside = lambda c: (F.col(c) >= F.lit(begin)) & (F.col(c) < F.lit(end))
        grouped = raw.groupBy(F.window(at, self.width).alias("w"), *self.keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(at).alias("newest"))
        rows = grouped.select(F.col("w.start").alias("start"), *self.keys, "n", "total", "newest").filter(inside("start"))
        for left in reversed(range(tries)):
            self.settle()
            before = self.table.version
            if not self.read().filter(inside("start") & F.col("provisional")).isEmpty():
                raise ValueError("the range has windows that are open")
            gone = self.table.read(before).filter(inside("start")).join(rows.select("start", *self.keys), ["start", *self.keys], "left_anti")
            try:
                after = self.table.merge(rows.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True))), delete="gone", note={"replayed": [str(begin), str(end)]})
                break
            except Conflict:
                if not left:
                    raise
        counted = lambda v, name: self.table.read(v).filter(inside("start")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
        changed = self.table.changes(after - 1, after).agg(F.count("*").alias("changed"))
        sums = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_events"))
        return sums.join(counted(after - 1, "counted_before")).join(counted(after, "counted_after")).join(changed)  # one row each
