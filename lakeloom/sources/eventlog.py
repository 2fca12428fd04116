"""A partitioned log of events in a shared folder, as a data source: ``format("event_log")`` for reading and writing, in batches and streams.

Columns: partition, key, value (JSON text) and at. Equal keys are in one partition, in the order in which they were written. A partition is a folder of
segments, named by the offset of their first event and their number of events, so an offset is found from names alone.

*Writing.* Tasks write segments aside; the commit gives them offsets and moves them in. What a batch of a stream moves is written down first,
so a batch that runs again finishes that, and no event is added twice. One writer at a time may write to a log.

*Reading.* A stream's offset is the next event of each partition; a batch takes at most ``maxEvents``, shared among the partitions that have
some. What was planned last is kept in the folder ``group``, so a stream that starts anew counts on from there. Each log partition's range is read by one task, a segment at a time (a small batch by one task in all, and of
a segment only the row groups that it needs); only names travel to the driver.
The folder is reached by pyarrow (local paths, HDFS, object stores).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "partition int, key string, value string, at timestamp"
#: Events of a row group of a segment, and of a batch of a stream that one task reads.
GROUP, SMALL = 1000, 5000


def _ends(segments: dict[int, list]) -> dict[int, int]:
    return {p: x[-1][0] + x[-1][1] for p, x in segments.items()}


class Segments:
    """The folder of a log."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def _list(self, folder: str, recursive: bool = False) -> list:
        from pyarrow import fs

        return self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True, recursive=recursive))

    def all(self) -> dict[int, list[tuple[int, int, str]]]:
        """(first offset, events, file) of each partition's segments, in order."""
        found: dict[int, list[tuple[int, int, str]]] = {}
        for info in self._list("log", recursive=True):
            if info.base_name.endswith(".parquet"):
                start, count = info.base_name.removesuffix(".parquet").split("-")
                partition = int(info.path.rsplit("/", 2)[1].removeprefix("p"))
                found.setdefault(partition, []).append((int(start), int(count), info.path))
        return {p: sorted(x) for p, x in found.items()}

    def ends(self) -> dict[int, int]:
        return _ends(self.all())

    def read(self, partition: int, start: int, end: int) -> Iterator:
        """Record batches of the events from start up to end."""
        yield from self.read_segments(self.all().get(partition, ()), partition, start, end)

    def read_segments(self, segments, partition: int, start: int, end: int) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        for first, count, path in segments:
            if first < end and first + count > start:
                a, b = max(start, first) - first, min(end, first + count) - first
                with self.fs.open_input_file(path) as file:
                    whole, at, groups, before = pq.ParquetFile(file), 0, [], 0
                    for g in range(whole.num_row_groups):
                        n = whole.metadata.row_group(g).num_rows
                        if at + n <= a:
                            before += n
                        elif at < b:
                            groups.append(g)
                        at += n
                    events = whole.read_row_groups(groups).slice(a - before, b - a)
                for batch in events.to_batches(max_chunksize=10_000):
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([partition] * n, pa.int32()), *(batch.column(c) for c in ("key", "value", "at"))], ["partition", "key", "value", "at"])

    def stage(self, batches) -> list[tuple[int, int, str]]:
        """Writes batches aside: (partition, events, file) for each segment."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        staged = []
        self.fs.create_dir(f"{self.root}/staged", recursive=True)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for p in pc.unique(table.column("partition")).to_pylist():
                own = table.filter(pc.equal(table.column("partition"), p)).select(["key", "value", "at"])
                path = f"{self.root}/staged/{uuid.uuid4().hex}.parquet"
                with self.fs.open_output_stream(path) as out:
                    pq.write_table(own, out, row_group_size=GROUP)
                staged.append((p, own.num_rows, path))
        return staged

    def write_json(self, name: str, content) -> None:
        scratch = f"{self.root}/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/{name}".rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(scratch) as out:
            out.write(json.dumps(content).encode())
        self.fs.move(scratch, f"{self.root}/{name}")

    def read_json(self, name: str):
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def publish(self, staged: list[tuple[int, int, str]], name: str) -> None:
        """Gives staged segments their offsets and moves them in, under the name of a commit: the first one of a name counts, and is finished if it was cut short."""
        plan = self.read_json(f"commits/{name}")
        if plan is None:
            ends, plan = self.ends(), []
            for p, n, path in staged:
                at = ends.get(p, 0)
                ends[p] = at + n
                plan.append([path, f"{self.root}/log/p{p:05d}", f"{at:020d}-{n}.parquet"])
            self.write_json(f"commits/{name}", plan)
        mine = {path for path, *_ in plan}
        for path, folder, file in plan:
            if self.fs.get_file_info(path).is_file:
                self.fs.create_dir(folder, recursive=True)
                self.fs.move(path, f"{folder}/{file}")
        self.discard([x for x in staged if x[2] not in mine])

    def discard(self, staged: list[tuple[int, int, str]]) -> None:
        for *_, path in staged:
            if self.fs.get_file_info(path).is_file:
                self.fs.delete_file(path)


@dataclass
class Range(InputPartition):
    partition: int
    start: int
    end: int
    segments: list
    more: tuple = ()  # ranges that the same task reads after this one


@dataclass
class Staged(WriterCommitMessage):
    segments: list


class EventLog(DataSource):
    """Options: path; for streams maxEvents (of a batch; 0: no limit), group (where its place is kept), startingOffsets (earliest or latest),
    members and member (a stream of so many that share the partitions, and its number from 0; each has its own group)."""

    @classmethod
    def name(cls):
        return "event_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BatchReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return StreamReader(self.options)

    def writer(self, schema, overwrite):
        return BatchWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return StreamWriter(self.options, overwrite)


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [Range(p, x[0][0], x[-1][0] + x[-1][1], x) for p, x in sorted(Segments(self.path).all().items())] or [Range(0, 0, 0, [])]

    def read(self, partition):
        return Segments(self.path).read_segments(partition.segments, partition.partition, partition.start, partition.end)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.most, self.group = options["path"], int(options.get("maxEvents", 0)), options.get("group")
        self.latest, self.planned, self.listed = options.get("startingOffsets", "earliest") == "latest", None, {}
        self.member, self.members = int(options.get("member", 0)), int(options.get("members", 1))
        if self.most and not self.group:
            raise ValueError("maxEvents needs a group, to know after a restart what was read")

    def _list(self) -> dict[int, list]:
        """The segments of the member's partitions, listed anew."""
        self.listed = {p: x for p, x in Segments(self.path).all().items() if p % self.members == self.member}
        return self.listed

    def initialOffset(self):  # noqa: N802
        return {str(p): n if self.latest else 0 for p, n in _ends(self._list()).items()}

    def _planned(self) -> dict:
        if self.planned is None:
            kept = Segments(self.group).read_json("planned") if self.group else None
            self.planned = kept if kept is not None else self.initialOffset()
        return self.planned

    def latestOffset(self):  # noqa: N802
        if not self.most:
            return {str(p): n for p, n in _ends(self._list()).items()}
        here = self._planned()
        ends = {str(p): n for p, n in _ends(self.listed).items()}
        if sum(max(0, n - here.get(p, 0)) for p, n in ends.items()) < self.most:  # else a batch is full with what is known
            ends = {str(p): n for p, n in _ends(self._list()).items()}
        open_, out, room = sorted(p for p in ends if ends[p] > here.get(p, 0)), dict(here), self.most
        for i, p in enumerate(open_):
            take = min(ends[p] - here.get(p, 0), -(-room // (len(open_) - i)))
            out[p], room = here.get(p, 0) + take, room - take
        return out

    def partitions(self, start, end):
        self.planned = {p: max(n, start.get(p, 0)) for p, n in end.items()}
        if self.group:  # before a batch is run, so that a restart never counts from an earlier place
            Segments(self.group).write_json("planned", self.planned)
        ranges = [(int(p), start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)]
        if any(n > _ends(self.listed).get(p, 0) for p, _, n in ranges):
            self._list()
        found = [Range(p, a, b, [x for x in self.listed.get(p, ()) if x[0] < b and x[0] + x[1] > a]) for p, a, b in ranges]
        if found and sum(r.end - r.start for r in found) <= SMALL:  # a task and its Python worker take longer than that many events
            found[0].more, found = tuple(found[1:]), found[:1]
        return found

    def read(self, partition):
        log = Segments(self.path)
        for r in (partition, *partition.more):
            yield from log.read_segments(r.segments, r.partition, r.start, r.end)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        if overwrite:
            raise ValueError("a log is only appended to")
        self.path = options["path"]

    def write(self, iterator):
        return Staged(Segments(self.path).stage(iterator))

    def commit(self, messages):
        Segments(self.path).publish([x for m in messages if m for x in m.segments], f"batch-{uuid.uuid4().hex}")

    def abort(self, messages):
        Segments(self.path).discard([x for m in messages if m for x in m.segments])


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.name = options["path"], options.get("writer", "stream")

    def write(self, iterator):
        return Staged(Segments(self.path).stage(iterator))

    def commit(self, messages, batchId):  # noqa: N803
        Segments(self.path).publish([x for m in messages if m for x in m.segments], f"{self.name}-{batchId}")

    def abort(self, messages, batchId):  # noqa: N803
        Segments(self.path).discard([x for m in messages if m for x in m.segments])


def to_events(df: DataFrame, key: Column, at: Column, partitions: int) -> DataFrame:
    """Rows as events of a log: JSON values, dealt to partitions by a hash of the key, in order of time."""
    text = key.cast("string")
    events = df.select(F.pmod(F.xxhash64(text), F.lit(partitions)).cast("int").alias("partition"), text.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), at.cast("timestamp").alias("at"))
    return events.repartition(partitions, "partition").sortWithinPartitions("partition", "at")


def publish(df: DataFrame, path: str, key: Column, at: Column, partitions: int = 8) -> None:
    """Appends rows to a log."""
    df.sparkSession.dataSource.register(EventLog)
    to_events(df, key, at, partitions).write.format("event_log").mode("append").save(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All events of a log as a table."""
    spark.dataSource.register(EventLog)
    return spark.read.format("event_log").load(path)


def follow_log(spark: SparkSession, path: str, schema, group: str | None = None, most: int = 0, latest: bool = False, member: int = 0, members: int = 1) -> DataFrame:
    """A log as a stream of its values' fields. most: events of a batch. member of members: which of the streams that share the partitions."""
    spark.dataSource.register(EventLog)
    reader = spark.readStream.format("event_log").option("startingOffsets", "latest" if latest else "earliest").option("maxEvents", most).option("member", member).option("members", members)
    if group:
        reader = reader.option("group", group)
    return reader.load(path).select(F.from_json("value", schema).alias("v")).select("v.*")
