"""Adaptive time partitions: rows in Parquet files whose time ranges follow the density of the rows.

Time is a tree of years, months, days and hours. A layout is planned bottom-up from the counts of
hours: level by level, a complete set of siblings collapses into its parent where the parent has at
most ``limit`` rows. The siblings that survive (the children of parents above the limit) are packed in
time order: each one within the limit, empty ones too, joins the run of the sibling directly before
it if the run stays within the limit, else it starts a run. Leaves are the runs that have rows, hours
above the limit, and one leaf for all null moments. A leaf's rows, in order, fill parts of ``limit``
rows, one file each.

``lay_out`` writes rows into a folder, or rewrites the folder for new rows: files whose leaf, part
and rows are the same stay as they are, the others are written, and then those which have no place
any more are deleted. Only changed files are written.

All of this is done by aggregations and joins on Spark. Counts are gathered by the hour, so a hot hour is
one row. Rows meet their leaf in a sort-merge join on the hour (adaptive execution splits a hot one);
null moments need no join. Only leaves above the limit need ranks: their rows are sorted by range over many
tasks, with a number of the input row to split equal rows, and a rank is the place in the range plus the counts of
the leaf's ranges before. Groups that one task holds are siblings of the calendar: at most 31, or the
years. One task writes a file, streaming.

Defined results: a null moment goes to the leaf ``null``; null order columns come first; rows alike in
all order columns are ordered by a hash of the row, so reruns agree; repeated rows all stay; an empty table
leaves an empty folder; any further columns are stored and may have any name (maps can't be hashed and are
not supported). Rows are told equal by their number and two sums of 64-bit row hashes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, delete_file, fresh_names

HOUR_US = 3_600_000_000
EPOCH_MONTHS = 1970 * 12
NULL_LEAF = "null"


def hour_of(moment: Column | str) -> Column:
    """Hours since 1970 of a timestamp without a zone."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(moment) if isinstance(moment, str) else moment)
    return ((us - F.pmod(us, F.lit(HOUR_US))) / HOUR_US).cast("long")


def _floor_div(x: Column, by: int) -> Column:
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def _month_of(day: Column) -> Column:
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    return (F.year(date) * 12 + F.month(date) - 1).cast("long")


def _first_day(month: Column) -> Column:
    return F.datediff(F.make_date(_floor_div(month, 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long")


#: for each level from the bottom: the parent of a node, and a parent's first and last child
LEVELS = (
    (lambda hour: _floor_div(hour, 24), lambda day: (day * 24, day * 24 + 23)),
    (_month_of, lambda month: (_first_day(month), _first_day(month + 1) - 1)),
    (lambda month: _floor_div(month, 12), lambda year: (year * 12, year * 12 + 11)),
)


def _names(level: int, node: Column) -> Column:
    """The path of a node: 2024, 2024/03, 2024/03/05 or 2024/03/05/07."""
    if level == 3:
        return F.format_string("%04d", node)
    if level == 2:
        return F.format_string("%04d/%02d", _floor_div(node, 12), F.pmod(node, F.lit(12)) + 1)
    if level == 1:
        return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), node.cast("int")), "yyyy/MM/dd")
    return F.concat(_names(1, _floor_div(node, 24)), F.format_string("/%02d", F.pmod(node, F.lit(24))))


def next_fit(limit: int):
    """For the siblings of one parent: the first and last node of the run that each one is in."""

    def pack(siblings):
        siblings = siblings.sort_values("node")
        first, room = [], -1
        for node, n in zip(siblings["node"].tolist(), siblings["n"].tolist(), strict=True):
            if n <= room:
                room -= n
            else:
                start, room = node, limit - n  # negative above the limit, so that nothing joins
            first.append(start)
        siblings["first"] = first
        runs = siblings.groupby("first")
        siblings["last"], siblings["total"] = runs["node"].transform("max"), runs["n"].transform("sum")
        return siblings[["parent", "node", "first", "last", "total"]]

    return pack


def plan_leaves(hours: DataFrame, limit: int, scratch: Scratch, name: str) -> DataFrame:
    """hour, leaf, big for each row of hours (hour, n); big: an hour with more rows than the limit."""
    nodes, found, at = hours.select(F.col("hour").alias("node"), "n"), [], F.col("hour")
    for level in range(4):
        if level < 3:
            parent_of, children_of = LEVELS[level]
            nodes = nodes.withColumn("parent", parent_of(F.col("node")))
            parents = scratch.save(nodes.groupBy("parent").agg(F.sum("n").alias("n")), f"{name}-{level}")
            first, last = children_of(F.col("parent"))
            whole = parents.filter(F.col("n") > limit).select("parent", F.explode(F.sequence(first, last)).alias("node"))
        else:
            ends = nodes.agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first is not null")
            whole = ends.select(F.lit(0).cast("long").alias("parent"), F.explode(F.sequence("first", "last")).alias("node"))
        siblings = whole.join(nodes.select("node", "n"), "node", "left").select("parent", "node", F.coalesce("n", F.lit(0)).alias("n"))
        runs = siblings.groupBy("parent").applyInPandas(next_fit(limit), "parent long, node long, first long, last long, total long")
        runs = runs.filter((F.col("total") > 0) & ((F.col("total") <= limit) if level else F.lit(True)))
        runs = runs.select(F.col("node").alias("member"), F.concat(_names(level, F.col("first")), F.lit("-"), F.element_at(F.split(_names(level, F.col("last")), "/"), -1)).alias("leaf"), (F.col("total") > limit).alias("big"))
        found.append(hours.select("hour", at.alias("member")).join(runs, "member").select("hour", "leaf", "big"))
        if level < 3:
            nodes, at = parents.select(F.col("parent").alias("node"), "n"), parent_of(at)
    return scratch.save(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]), f"{name}-leaves")


def _digest(columns: list[str]) -> list[Column]:
    named = [F.col(f"`{c}`") for c in columns]
    each = (F.xxhash64(*named), F.xxhash64(F.lit("again"), *named))
    return [F.count("*").alias("n"), *(F.sum(x.cast("decimal(20,0)")).alias(f"digest{i}") for i, x in enumerate(each))]


class TimeLayout:
    """A folder of rows of one schema, laid out by time."""

    def __init__(self, spark: SparkSession, folder: str, schema, moment: Column, order: tuple[str, ...], limit: int):
        """moment: of a row, without a zone; order: columns that order rows of one moment; limit: rows of a file."""
        if limit < 1:
            raise ValueError("limit must be at least 1")
        self.spark, self.folder, self.columns, self.schema, self.order, self.limit, self.moment = spark, folder, schema.names, schema, order, limit, moment
        self.at, self.leaf, self.part, self.tie, self.hour, self.big, self.number = fresh_names(schema.names, "moment", "leaf", "part", "tie", "hour", "big", "number")

    def lay_out(self, rows: DataFrame) -> None:
        """Makes the folder hold these rows. Files that would be the same stay."""
        scratch = Scratch(self.spark)
        before = scratch.save(self.stored_digests(), "before") if self._is_there() else None
        rows = self._leafed(rows, scratch)
        keys = (self.leaf, self.part)
        if before is not None:
            wanted = rows.groupBy(*keys).agg(*_digest(self.columns))
            stay = scratch.save(before.join(wanted, [*keys, "n", "digest0", "digest1"], "left_semi").select(*keys, "path"), "stay")
            rows = rows.join(stay.select(*keys), [*keys], "left_anti")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # a file costs as much as many rows, so tasks are not merged by their bytes
        ordered = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, self.at, *(f"`{c}`" for c in self.order), self.tie)
        ordered.select(*(f"`{c}`" for c in self.columns), *keys).write.mode("append").partitionBy(*keys).parquet(self.folder)
        if before is not None:
            for row in before.join(stay, "path", "left_anti").select("path").toLocalIterator():
                delete_file(self.spark, row["path"])
        scratch.drop_all()

    def _is_there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        """The stored rows with leaf and part of their file; leaves have _ for / in names of folders."""
        from pyspark.sql.types import IntegerType, StringType

        schema = type(self.schema)(list(self.schema.fields)).add(self.leaf, StringType()).add(self.part, IntegerType())
        return self.spark.read.schema(schema).parquet(self.folder)

    def stored_digests(self) -> DataFrame:
        stored = self.read().withColumn("path", F.col("_metadata.file_path"))
        return stored.groupBy(self.leaf, self.part, "path").agg(*_digest(self.columns))

    def _leafed(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """Rows with their moment, tie, leaf and part."""
        own = [f"`{c}`" for c in self.columns]
        rows = rows.select(*own, self.moment.alias(self.at), F.xxhash64(*own).alias(self.tie)).withColumn(self.hour, hour_of(F.col(self.at)))
        hours = scratch.save(rows.filter(F.col(self.hour).isNotNull()).groupBy(F.col(self.hour).alias("hour")).agg(F.count("*").alias("n")), "hours")
        leaves = plan_leaves(hours, self.limit, scratch, "plan").select(F.col("hour").alias(self.hour), F.translate("leaf", "/", "_").alias(self.leaf), F.col("big").alias(self.big))
        timed = rows.filter(F.col(self.hour).isNotNull()).join(leaves, self.hour)
        never = rows.filter(F.col(self.hour).isNull()).withColumn(self.leaf, F.lit(NULL_LEAF)).withColumn(self.big, F.lit(True))
        rows = scratch.save(timed.unionByName(never).drop(self.hour), "rows")
        large = self._parts(rows.filter(self.big).drop(self.big), scratch)
        return rows.filter(f"not {self.big}").drop(self.big).withColumn(self.part, F.lit(1)).unionByName(large)

    def _parts(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """Rows with the part of their leaf, from ranks over ranges that many tasks sort."""
        order = [self.leaf, self.at, *(f"`{c}`" for c in self.order), self.tie]
        numbered = rows.withColumn(self.number, F.monotonically_increasing_id())  # tells equal rows apart, so that ranges can cut between them
        dealt = numbered.repartitionByRange(*order, self.number).sortWithinPartitions(*order).drop(self.number)
        ranked = scratch.save(dealt.withColumn(self.number, F.monotonically_increasing_id()), "ranked")
        piece, place = F.shiftright(F.col(self.number), 33), F.col(self.number).bitwiseAND(F.lit((1 << 33) - 1))
        counts = ranked.groupBy(self.leaf, piece.alias(self.big)).agg(F.count("*").alias("n"), F.min(place).alias("least"))
        before = F.sum("n").over(Window.partitionBy(self.leaf).orderBy(self.big)) - F.col("n") - F.col("least")
        offsets = counts.select(self.leaf, self.big, before.alias(self.hour))
        found = ranked.withColumn(self.big, piece).join(offsets, [self.leaf, self.big])
        return found.withColumn(self.part, (_floor_div(place + F.col(self.hour), self.limit) + 1).cast("int")).drop(self.big, self.hour, self.number)

    def files(self, id_column: str, new: Column) -> DataFrame:
        """path, leaf, part, ids_sha256, n_rows, n_new of each file, read back. ids: decimal, in the file's order, joined by commas (null: empty); new: counts rows."""
        stored = self.read().select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.translate(self.leaf, "_", "/").alias("leaf"), F.col(self.part).alias("part"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"), F.coalesce(new, F.lit(False)).alias("new"))
        ordered = stored.repartition("path").sortWithinPartitions("path", "row")
        return ordered.mapInArrow(_digest_files, "path string, leaf string, part int, ids_sha256 string, n_rows long, n_new long")


def _digest_files(batches):
    """Rows in order of path and place: one row for each path, hashed as the ids stream by."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ("path", "leaf", "part", "ids_sha256", "n_rows", "n_new")
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    done, path, digest, facts = [], None, None, None

    def close():
        if path is not None:
            done.append((path, facts[0], facts[1], digest.hexdigest(), facts[2], facts[3]))

    def out():
        rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
        done.clear()
        return rows

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("path").dictionary_encode()
        at = np.asarray(codes.indices)
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = batch.column("path")[a].as_py()
            if now != path:
                close()
                path, digest, facts = now, hashlib.sha256(), [batch.column("leaf")[a].as_py(), batch.column("part")[a].as_py(), 0, 0]
            elif facts[2]:
                digest.update(b",")
            digest.update(",".join(batch.column("id").slice(a, b - a).to_pylist()).encode())
            facts[2] += b - a
            facts[3] += pc.sum(batch.column("new").slice(a, b - a)).as_py() or 0
        if len(done) > 1000:
            yield out()
    close()
    if done:
        yield out()


def shifted_moment(moment: str, row_id: str) -> Column:
    """Moments spread over decades: by k, the CRC-32 of the decimal id modulo 128, some go back by (k + 6) cubed days, some to their Monday's start."""
    k = F.crc32(F.col(row_id).cast("string")) % 128
    day = _floor_div(hour_of(moment), 24)
    monday = F.timestamp_add("DAY", (day - F.pmod(day + 3, F.lit(7))).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    back = F.timestamp_add("DAY", (-(k + 6) * (k + 6) * (k + 6)).cast("int"), F.col(moment))
    return F.when(k < 16, back).when(k > 111, monday).otherwise(F.col(moment))
