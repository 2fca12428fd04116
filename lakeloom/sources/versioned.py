"""Versioned tables with their log on disk, and the feed of their changes.

A table is a folder: ``_log/<version>.json`` has one commit each, with the schema, the time, what was done and the
snapshot (the folders of rows that are live); ``data`` has the rows, ``changes`` the change rows of each version. Rows are written
first, then the commit is put under its number if nobody has put one there: a rename that does not overwrite. So any number of
sessions may read and write one table: a reader sees whole versions only, and of two writers that start from
the same version one wins. The loser's append is put under the next number, since appends do not depend on each other; its merge or replacement
raises ``Conflict``.

A table with keys deals its rows to buckets by a hash of the keys. A merge reads and rewrites the buckets that its changes touch
and takes the others over into the new snapshot, so its cost follows the changes. Change rows are (op, keys, before, after), op one of
insert, update, delete. The log holds one small file a version with a line for each live folder; rows are never held by the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


class Conflict(Exception):
    """Another writer has committed since this one read the table."""


class LogFolder:
    """Numbered files of JSON, each written once, in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path, spark._jvm
        self.hadoop = self.jvm.org.apache.hadoop
        self.files = self.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        top = self.hadoop.fs.Path(self.path)
        if not self.files.exists(top):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(top)]
        return sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())

    def get(self, number: int) -> dict:
        stream = self.files.open(self._path(f"{number:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def put(self, number: int, entry: dict) -> bool:
        """Whether the entry is the one under this number now; False if another one is there."""
        from py4j.protocol import Py4JJavaError

        scratch, target = self._path(f".{uuid.uuid4().hex}"), self._path(f"{number:020d}.json")
        stream = self.files.create(scratch, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        context = self.hadoop.fs.FileContext.getFileContext(scratch.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.files.makeQualified(scratch), self.files.makeQualified(target), none)
        except (Py4JJavaError, PySparkException) as failed:
            self.files.delete(scratch, False)
            if "FileAlreadyExists" in str(failed):
                return False
            raise
        return True

    def remove(self, number: int) -> None:
        self.files.delete(self._path(f"{number:020d}.json"), False)

    def delete(self, path: str) -> None:
        self.files.delete(self.hadoop.fs.Path(path), True)


class VersionedTable:
    """A table of immutable versions at a folder. keys and buckets count when the table is new; an old one has its own."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = (), buckets: int = 16):
        self.spark, self.root, self.log = spark, root, LogFolder(spark, f"{root}/_log")
        self._keys, self._buckets = list(keys), buckets if keys else 0

    # ---- the log

    def entry(self, version: int | None = None, at: int | None = None) -> dict:
        """The last commit, a numbered one, or the one that was current at a time."""
        numbers = self.log.numbers()
        if version is not None:
            numbers = [n for n in numbers if n == version]
        for n in reversed(numbers):
            entry = self.log.get(n)
            if at is None or entry["at"] <= at:
                return entry
        raise LookupError("there is no such version")

    @property
    def version(self) -> int:
        return max(self.log.numbers(), default=0)

    def last_note(self, key: str, default=None):
        """What the last commit that has a note of this name says."""
        for n in reversed(self.log.numbers()):
            note = self.log.get(n).get("note") or {}
            if key in note:
                return note[key]
        return default

    def history(self) -> list[dict]:
        return [{k: e[k] for k in ("version", "at", "did")} for e in map(self.log.get, self.log.numbers())]

    def _last(self) -> dict:
        if not (numbers := self.log.numbers()):
            return {"version": 0, "at": -1, "schema": None, "keys": self._keys, "buckets": self._buckets, "parts": [], "dropped": False}
        return self.log.get(numbers[-1])

    def _put(self, before: dict, did: str, at: int | None, again: bool = False, **changed) -> int:
        """Commits on top of a version. again: also on top of later ones, by adding this commit's parts to theirs."""
        added = changed["parts"]
        while True:
            at_now = max(int(time.time() * 1000), before["at"]) if at is None else at
            if at_now < before["at"]:
                raise ValueError("a version cannot be older than the one before it")
            entry = before | {"changes": None, "note": None} | changed | {"version": before["version"] + 1, "did": did, "at": at_now}
            if again:
                entry["parts"] = before["parts"] + added
            if self.log.put(entry["version"], entry):
                return entry["version"]
            if not again:
                raise Conflict(f"version {entry['version']} was committed meanwhile")
            before = self._last()

    # ---- reading

    def _rows(self, entry: dict, parts: list[dict] | None = None) -> DataFrame:
        parts = entry["parts"] if parts is None else parts
        schema = StructType.fromJson(json.loads(entry["schema"]))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(p["path"] for p in parts))

    def read(self, version: int | None = None, at: int | None = None) -> DataFrame:
        """The rows of the last version, a numbered one, or the one that was current at a time. Columns that later versions added are null in older rows."""
        if self._last()["dropped"]:
            raise LookupError("the table is dropped")
        return self._rows(self.entry(version, at))

    # ---- writing

    def _write(self, df: DataFrame, keys: list[str], buckets: int) -> list[dict]:
        """Writes rows under a new folder: one part, or one for each bucket that has rows."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        if not keys:
            df.write.parquet(folder)
            return [{"path": folder, "bucket": None}]
        number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        df.withColumn("_bucket", number).repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(folder)
        names = [s.getPath().getName() for s in self.log.files.listStatus(self.log.hadoop.fs.Path(folder))]
        return [{"path": f"{folder}/{n}", "bucket": int(n.removeprefix("_bucket="))} for n in sorted(names) if n.startswith("_bucket=")]

    def _merged_schema(self, before: dict, schema: StructType) -> str:
        old = StructType.fromJson(json.loads(before["schema"])) if before["schema"] else StructType()
        known = {f.name: f for f in old.fields}
        for f in schema.fields:
            if f.name in known and known[f.name].dataType != f.dataType:
                raise ValueError(f"{f.name} has another type in the table")
        fields = old.fields + [StructField(f.name, f.dataType, True) for f in schema.fields if f.name not in known]
        return json.dumps(StructType(fields).jsonValue())

    def append(self, df: DataFrame, at: int | None = None) -> int:
        """Adds rows; columns that the table lacks are added to it. The rows of a table with keys must be new keys."""
        before = self._last()
        parts = self._write(df, before["keys"], before["buckets"])
        return self._put(before, "append", at, True, parts=parts, schema=self._merged_schema(before, df.schema), dropped=False, changes={"added": [p["path"] for p in parts]})

    def commit(self, df: DataFrame, at: int | None = None) -> int:
        """Replaces all rows."""
        before = self._last()
        entry = before | {"schema": json.dumps(df.schema.jsonValue())}
        parts = self._write(df, before["keys"], before["buckets"])
        told = None
        if before["keys"]:
            old = self._rows(before) if before["schema"] else self.spark.createDataFrame([], df.schema)
            told = self._tell(change_rows(old, self._rows(entry, parts), before["keys"]))
        return self._put(before, "replace", at, parts=parts, schema=entry["schema"], dropped=False, changes=told)

    def merge(self, changes: DataFrame, delete: str = "false", order: str | None = None, at: int | None = None, note: dict | None = None) -> int:
        """Upserts rows by the table's keys; deletes the keys of rows that fulfil the condition delete. Of rows with one key, the last one by order counts.
        note: kept in the commit, such as the batch that was merged."""
        before, columns = self._last(), None
        keys, buckets = before["keys"], before["buckets"]
        if not keys:
            raise ValueError("only a table with keys can be merged into")
        if not before["parts"] and not before["schema"]:
            raise LookupError("the table has no version yet")
        columns = StructType.fromJson(json.loads(before["schema"])).names
        rows = changes.select(*columns, F.coalesce(F.expr(delete), F.lit(False)).alias("_gone"), (F.col(order) if order else F.lit(0)).alias("_order"))
        last = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct("_order", "_gone", F.xxhash64(*columns))).alias("_last")).select("_last.*")
        staged = f"{self.root}/changes/{uuid.uuid4().hex}-staged"
        number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        last.withColumn("_bucket", number).write.parquet(staged)
        last = self.spark.read.parquet(staged)
        touched = {r[0] for r in last.select("_bucket").distinct().collect()}  # at most one for each bucket
        old = self._rows(before, [p for p in before["parts"] if p["bucket"] in touched])
        stay = old.join(last.select(*keys), keys, "left_anti")
        new = last.filter("not _gone").select(*columns)
        parts = [p for p in before["parts"] if p["bucket"] not in touched] + self._write(stay.unionByName(new), keys, buckets)
        changed = old.join(last.select(*keys), keys, "left_semi")
        told = self._tell(change_rows(changed, new, keys))
        self.log.delete(staged)
        return self._put(before, "merge", at, parts=parts, changes=told, note=note)

    def _tell(self, rows: DataFrame) -> dict:
        folder = f"{self.root}/changes/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return {"folder": folder}

    # ---- the feed

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """version, op, the keys' columns as in the rows, before, after: the changes of the versions after one, up to one (the last)."""
        upto, out = self.version if upto is None else upto, None
        for n in range(after + 1, upto + 1):
            entry = self.entry(n)
            told, rows = entry["changes"], None
            if told is None:
                if entry["did"] == "replace":
                    raise LookupError("a table without keys does not know what a replacement changed")
                continue
            if "folder" in told:
                rows = self.spark.read.parquet(told["folder"]).select("op", "before", "after")
            elif told["added"]:
                added = self._rows(entry, [{"path": p} for p in told["added"]])
                rows = added.select(F.lit("insert").alias("op"), F.lit(None).cast(added.schema).alias("before"), F.struct(*added.columns).alias("after"))
            if rows is not None:
                rows = rows.select(F.lit(n).cast("long").alias("version"), "op", "before", "after")
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            schema = StructType.fromJson(json.loads(self._last()["schema"]))
            out = self.spark.createDataFrame([], StructType().add("version", "long").add("op", "string").add("before", schema).add("after", schema))
        return out

    # ---- copies and clearing up

    def clone(self, root: str) -> VersionedTable:
        """A table of its own that begins with this one's rows, without a copy of them. Folders that a clone may read are not expired."""
        before, other = self._last(), VersionedTable(self.spark, root)
        clones = LogFolder(self.spark, f"{self.root}/_clones")
        while not clones.put(max(clones.numbers(), default=0) + 1, {"root": root, "version": before["version"], "parts": before["parts"]}):
            pass
        if not other.log.put(1, before | {"version": 1, "did": "clone", "changes": None}):
            raise Conflict("there is a table already")
        return other

    def drop(self) -> None:
        before = self._last()
        self._put(before, "drop", before["at"], parts=before["parts"], dropped=True)

    def undrop(self) -> None:
        before = self._last()
        self._put(before, "undrop", before["at"], parts=before["parts"], dropped=False)

    def expire(self, keep: int) -> int:
        """Forgets all but the last versions, and deletes the folders that only forgotten ones have. Returns how many folders went."""
        numbers = self.log.numbers()
        old, kept = [self.log.get(n) for n in numbers[:-keep]], [self.log.get(n) for n in numbers[-keep:]]
        clones = LogFolder(self.spark, f"{self.root}/_clones")
        live = {p["path"] for e in [*kept, *map(clones.get, clones.numbers())] for p in e["parts"]}
        live |= {x for e in kept for x in (e["changes"] or {}).get("added", [])}
        gone = {p["path"] for e in old for p in e["parts"]} | {e["changes"]["folder"] for e in old if e["changes"] and "folder" in e["changes"]}
        gone = {p for p in gone - live if p.startswith(f"{self.root}/")}
        for e in old:
            self.log.remove(e["version"])
        for p in gone:
            self.log.delete(p)
        return len(gone)


def change_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """op (insert, update, delete), the keys, and the rows before and after, of the keys whose rows differ."""
    a = before.select(*keys, F.struct(*before.columns).alias("before"))
    b = after.select(*keys, F.struct(*after.columns).alias("after"))
    both = a.join(b, list(keys), "full")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(op.alias("op"), *keys, "before", "after")


class ChangeFeed:
    """Reads a table's changes from where it stopped. Its place is kept on disk under a name, so a restarted reader goes on; of
    two readers of one name that read the same changes, one can confirm them."""

    def __init__(self, table: VersionedTable, name: str):
        self.table, self.places = table, LogFolder(table.spark, f"{table.root}/_feeds/{name}")

    def place(self) -> int:
        numbers = self.places.numbers()
        return self.places.get(numbers[-1])["version"] if numbers else 0

    def poll(self, versions: int | None = None) -> tuple[DataFrame, int]:
        """The changes after the place, of at most so many versions, and the version to confirm when they are processed."""
        here = self.place()
        upto = self.table.version if versions is None else min(self.table.version, here + versions)
        return self.table.changes(here, upto), upto

    def confirm(self, version: int) -> None:
        if version <= self.place():
            return
        if not self.places.put(max(self.places.numbers(), default=0) + 1, {"version": version}):
            raise Conflict("another reader has confirmed meanwhile")
