"""Order, pages and cursors."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.formats import work_dir


HEAP_ROWS = 10_000


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the total of all rows beside it; an empty page has no rows, total() still tells.

    A page that ends in the first HEAP_ROWS rows comes from a heap of that size in each task, a deeper one from deep_page().
    """
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit) if offset + limit <= HEAP_ROWS else deep_page(df, order, limit, offset)
    return rows.join(F.broadcast(total))


def deep_page(df: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """The rows of a page at any depth. The order's ranges are written to the shared folder and counted; only those that the
    page reaches into are read again and ranked, so memory does not depend on the offset."""
    spark = df.sparkSession
    path, ranges = work_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    ranged.write.partitionBy("_range").parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)
    counts = sorted(map(tuple, stored.groupBy("_range").agg(F.count("*").alias("n")).collect()))  # a row for each range
    before, wanted = 0, []
    for number, n in counts:
        if before < offset + limit and before + n > offset:
            wanted.append((number, before))
        before += n
    if not wanted:
        return df.limit(0)
    start = F.lit(0)
    for number, rows_before in wanted:
        start = F.when(F.col("_range") == number, F.lit(rows_before)).otherwise(start)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + start
    here = stored.filter(F.col("_range").isin([number for number, _ in wanted])).withColumn("_place", place)
    return here.filter((F.col("_place") > offset) & (F.col("_place") <= offset + limit)).orderBy("_place").select(*df.columns)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def before_cursor(df: DataFrame, at: str, key: str, last_at, last_key) -> DataFrame:
    """Rows before (last_at, last_key) in the order newest first; ties on the time are told apart by the key."""
    t, k = (c if isinstance(c, Column) else F.lit(c) for c in (last_at, last_key))
    return df.filter((F.col(at) < t) | ((F.col(at) == t) & (F.col(key) < k)))


def keyset_page(df: DataFrame, at: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """Rows before the cursor (at, key), newest first, one more than limit: the extra row tells that there are more."""
    if cursor is not None:
        df = before_cursor(df, at, key, *cursor)
    return df.orderBy(F.col(at).desc(), F.col(key).desc()).limit(limit + 1)


def with_more(paged: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    """A keyset page cut to limit, with has_more."""
    w = Window.orderBy(F.col(at).desc(), F.col(key).desc())  # at most limit + 1 rows
    x = paged.withColumn("position", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return x.filter(F.col("position") <= limit)


def write_cursor(at, key) -> str:
    return base64.urlsafe_b64encode(json.dumps([str(at), key]).encode()).decode()


def read_cursor(cursor: str) -> tuple:
    return tuple(json.loads(base64.urlsafe_b64decode(cursor)))


def union_in_order(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Lists one after the other, each key once, at its first place. Parts have key and position."""
    rows = None
    for i, p in enumerate(parts):
        x = p.select(key, F.struct(F.lit(i).alias("part"), F.col("position").alias("at")).alias("at"))
        rows = x if rows is None else rows.unionByName(x)
    return rows.groupBy(key).agg(F.min("at").alias("at")).select(key, "at.part", "at.at")


def max_merge(parts: Sequence[tuple[DataFrame, float]], key: str, score: str) -> DataFrame:
    """Weighted sources merged; each key keeps its highest weighted score."""
    rows = None
    for p, weight in parts:
        x = p.select(key, (F.col(score) * weight).alias(score))
        rows = x if rows is None else rows.unionByName(x)
    return rows.groupBy(key).agg(F.max(score).alias(score))
