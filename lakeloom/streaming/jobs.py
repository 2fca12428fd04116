"""Streaming jobs. Each is a transform that works on a batch as well, and a runner with a file source.

Batch and stream give the same rows for the same events: the transforms are shared, and a replay
is the batch run of the transform over the raw events.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.streaming.held import Held


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1, format: str = "parquet", **options) -> DataFrame:
    """A stream of files. options go to the source, such as maxOffsetsPerTrigger for a log source."""
    reader = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.options(**options).load(path)


def read_log(spark: SparkSession, servers: str, topic: str, schema, earliest: bool = True) -> DataFrame:
    """A stream of JSON values from a message log; needs that source's connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest" if earliest else "latest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def to_log(df: DataFrame, key: str) -> DataFrame:
    """Rows as key and JSON value for a message log sink; equal keys go to one partition."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def drain(stream: DataFrame, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream until its source is used up. Without `each`, returns what it wrote, from a folder of rows for each batch beside the checkpoint."""
    rows = Held(stream.sparkSession, f"{checkpoint}-rows")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(each or rows.put).start().awaitTermination()
    if each:
        return None
    numbers = rows.numbers(-1)
    return rows.read(numbers[-1:] if mode == "complete" else numbers, stream.schema)


def tumbling(events: DataFrame, at: str, width: str, keys: Sequence[str], late: str | None = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count, total and largest value of each window and key. late: how far the watermark is behind (None for a batch)."""
    x = events.withWatermark(at, late) if late else events
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = x.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("high"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total", "high")


def deduplicated(events: DataFrame, key: str, at: str, late: str | None = "10 minutes") -> DataFrame:
    """Each event id once; state is dropped after the watermark."""
    if late is None:
        return events.dropDuplicates([key])
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


class KeyedTable:
    """A keyed table in versioned folders: every upsert writes a new version, readers keep theirs.

    The folders themselves are the log, so a restarted job goes on from the last one that was written whole. A version
    that a batch wrote has the batch's number in its name.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)

    def versions(self) -> list[tuple[int, int | None, str]]:
        """(version, batch, folder) of the versions that are whole, in order."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = []
        for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")) or []:
            name = status.getPath().getParent().getName()
            version, _, batch = name[1:].partition("-batch")
            out.append((int(version), int(batch) if batch else None, f"{self.path}/{name}"))
        return sorted(out, key=lambda x: x[0])

    @property
    def version(self) -> int:
        return max((v for v, _, _ in self.versions()), default=0)

    def read(self) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(known[-1][2])

    def replace(self, df: DataFrame, batch: int | None = None) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}" + ("" if batch is None else f"-batch{batch}"))


def count_likes(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds the deltas of each batch's like and unlike events to the sums. A batch that runs again, after a
    restart too, is skipped. Sums may be below 0 for a while when batches split a like from its unlike; likes_shown() floors them."""

    def each(batch: DataFrame, number: int) -> None:
        if any(b is not None and b >= number for _, b, _ in table.versions()):
            return
        deltas = batch.select("item", F.when(F.col("action") == "like", 1).otherwise(-1).cast("long").alias("n"))
        table.replace(table.read().unionByName(deltas).groupBy(*table.keys).agg(F.sum("n").alias("n")), number)

    return each


class LikeCounts:
    """Likes less unlikes of each item, kept by a stream: a batch writes its own deltas, held beside the table, which takes many batches at once."""

    def __init__(self, spark: SparkSession, root: str, item: str = "long"):
        self.table, self.held = KeyedTable(spark, f"{root}/counts", f"item {item}, n long", ["item"]), Held(spark, f"{root}/held")

    def _taken(self) -> int:
        return max((b for _, b, _ in self.table.versions() if b is not None), default=-1)

    def _sums(self, numbers: list[int]) -> DataFrame:
        return self.table.read().unionByName(self.held.read(numbers, self.table.schema)).groupBy("item").agg(F.sum("n").alias("n"))

    def each(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: batch has item, action. A batch that runs again changes nothing."""
        taken = self._taken()
        if number <= taken:
            return
        self.held.put(batch.select("item", F.when(F.col("action") == "like", 1).otherwise(-1).cast("long").alias("n")), number)
        if self.held.due(number, taken):
            self.table.replace(self._sums(self.held.numbers(taken, number)), number)

    def read(self) -> DataFrame:
        """The counts, never below 0, whatever the batches were."""
        return self._sums(self.held.numbers(self._taken())).withColumn("n", F.greatest("n", F.lit(0).cast("long")))


def likes_shown(table: KeyedTable) -> DataFrame:
    """The counts, never below 0, whatever the batches were."""
    return table.read().withColumn("n", F.greatest("n", F.lit(0).cast("long")))


def fan_out(posts: DataFrame, follows: DataFrame, celebrity: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(follower, post) rows for feeds, and the posts of celebrities, which are pulled at reading."""
    counts = follows.groupBy("followee").agg(F.count("*").alias("followers"))
    known = posts.join(counts, F.col("author") == F.col("followee"), "left").drop("followee").withColumn("followers", F.coalesce("followers", F.lit(0)))
    pushed = known.filter(F.col("followers") < celebrity).join(follows, F.col("author") == F.col("followee")).select("follower", "post_id", "created_at")
    return pushed, known.filter(F.col("followers") >= celebrity).select("author", "post_id", "created_at")


def capped(lists: DataFrame, key: str, keep: int = 500) -> DataFrame:
    """The newest `keep` posts of each list."""
    w = Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("post_id").desc())
    return lists.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def without_deleted(lists: DataFrame, deleted: DataFrame) -> DataFrame:
    return lists.join(deleted, "post_id", "left_anti")


def limited(events: DataFrame, user: str, at: str, key: str, per_minute: int = 10) -> DataFrame:
    """The first events of each user and minute."""
    w = Window.partitionBy(user, F.date_trunc("minute", at)).orderBy(at, key)
    return events.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_minute).drop("_r")


def last_writers(streams: Sequence[DataFrame], keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Regions merged: the last value by time for each key."""
    rows = streams[0]
    for s in streams[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(at, value)).alias(value), F.max(at).alias(at))
