"""Views that are kept by deltas: counts by group and item, and the first items of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.aggregates import top_per_group
from lakeloom.sources.versioned import VersionedTable
from lakeloom.streaming.held import Held


class TopView:
    """The first k items of each group by count (ties: the smaller item), kept in versioned tables as batches of deltas come.

    A refresh adds the deltas to the stored counts of the keys that they name, and ranks a group's listed items and the named ones anew. Items that are neither were behind the last listed
    one and have not moved, so the new list is right as long as its last place is not behind the old one's. Only
    where it is, because a member fell, is the group's list made anew from its stored counts. Raw events are never read again.

    A batch that runs again is told by its number. If it stopped between the two tables, the groups it names are repaired from the counts.
    ``hold`` keeps a batch's deltas for a refresh that takes many batches at once; reading brings the lists up to date first.

    Keys without a count (0) are not stored. Null groups and items are not counted. ``refreshes`` has what each refresh read.
    """

    def __init__(self, spark: SparkSession, root: str, k: int, group: str = "long", item: str = "long", buckets: int = 16):
        self.spark, self.root, self.k, self.held = spark, root, k, Held(spark, f"{root}/held")
        self.counts = VersionedTable(spark, f"{root}/counts", ["group", "item"], buckets)
        self.tops = VersionedTable(spark, f"{root}/tops", ["group"], buckets)
        if not self.counts.version:
            self.counts.append(spark.createDataFrame([], f"group {group}, item {item}, n long"))
        if not self.tops.version:
            self.tops.append(spark.createDataFrame([], f"group {group}, entries array<struct<n: long, item: {item}>>"))

    def _lists(self, rows: DataFrame) -> DataFrame:
        """group, entries from group, item, n: the first k, at most k rows a group."""
        first = top_per_group(rows, ["group"], [F.col("n").desc(), F.col("item")], self.k)
        entries = F.sort_array(F.collect_list(F.struct("rank", F.struct("n", "item").alias("e"))))
        return first.groupBy("group").agg(F.transform(entries, lambda x: x["e"]).alias("entries"))

    def refresh(self, deltas: DataFrame, number: int) -> None:
        """deltas: group, item, n (may be negative). The signature of foreachBatch."""
        if self.tops.last_note("batch", -1) >= number:
            return
        folder = f"{self.root}/deltas/{number}"
        summed = deltas.filter("group is not null and item is not null").groupBy("group", "item").agg(F.sum("n").alias("d"))
        summed.write.mode("overwrite").parquet(folder)
        named = self.spark.read.parquet(folder)
        again = self.counts.last_note("batch", -1) >= number
        if not again:
            known = named.join(self.counts.read().withColumnRenamed("n", "old"), ["group", "item"], "left")
            moved = known.select("group", "item", (F.coalesce("old", F.lit(0)) + F.col("d")).alias("n"))
            self.counts.merge(moved, delete="n = 0", note={"batch": number})
        groups = named.select("group").distinct()
        before = self.tops.read().join(groups, "group", "left_semi")
        if again:
            ranked = groups.select("group", F.lit(None).cast(before.schema["entries"].dataType).alias("entries"), F.lit(True).alias("repair"))
        else:
            listed = before.select("group", F.explode("entries").alias("e")).select("group", "e.item")
            candidates = listed.unionByName(named.select("group", "item")).distinct()
            lists = self._lists(self.counts.read().join(candidates, ["group", "item"], "left_semi"))
            both = groups.join(lists, "group", "left").join(before.withColumnRenamed("entries", "was"), "group", "left")
            full = F.coalesce(F.size("was") >= self.k, F.lit(False))  # else the list had all of the group's items
            last, old = F.element_at("entries", -1), F.element_at("was", -1)
            fell = F.coalesce(F.size("entries") < self.k, F.lit(True)) | (last["n"] < old["n"]) | ((last["n"] == old["n"]) & (last["item"] > old["item"]))
            ranked = both.select("group", "entries", (full & fell).alias("repair"))
        path = f"{self.root}/ranked/{number}"
        ranked.write.mode("overwrite").parquet(path)
        ranked = self.spark.read.parquet(path)
        again_read = self.counts.read().join(ranked.filter("repair").select("group"), "group", "left_semi")
        repaired = ranked.filter("repair").select("group").join(self._lists(again_read), "group", "left")
        new = ranked.filter("not repair").select("group", "entries").unionByName(repaired)
        told = ranked.agg(F.count("*").alias("groups"), F.count_if("repair").alias("repaired")).join(named.agg(F.count("*").alias("named"))).join(again_read.agg(F.count("*").alias("repair_rows")))  # one row each
        told.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.root}/refreshes/{number}")
        self.tops.merge(new, delete="entries is null", note={"batch": number})

    def hold(self, deltas: DataFrame, number: int) -> None:
        """As refresh, with the signature of foreachBatch: the deltas are kept until a refresh is due."""
        taken = self.counts.last_note("batch", -1)
        if number <= taken:
            return
        self.held.put(deltas.select("group", "item", "n"), number)
        if self.held.due(number, taken):
            self.settle()

    def settle(self) -> None:
        """Refreshes by what is held. A refresh that stopped between its tables is finished first, with the same batches."""
        counted, listed = self.counts.last_note("batch", -1), self.tops.last_note("batch", -1)
        schema = self.counts.read().schema
        if listed < counted and (numbers := self.held.numbers(listed, counted)):
            self.refresh(self.held.read(numbers, schema), counted)
        if numbers := self.held.numbers(counted):
            self.refresh(self.held.read(numbers, schema), numbers[-1])

    def read(self) -> DataFrame:
        """group, rank (from 1), item, n."""
        self.settle()
        rows = self.tops.read().select("group", F.posexplode("entries").alias("rank", "e"))
        return rows.select("group", (F.col("rank") + 1).alias("rank"), "e.item", "e.n")

    def refreshes(self) -> DataFrame:
        """batch, groups and keys named, groups repaired, and the stored counts that the repairs read."""
        return self.spark.read.parquet(f"{self.root}/refreshes/*")
