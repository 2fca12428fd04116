"""Aggregations: mergeable states, rollups, counters, sketches, statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import epoch


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of value times weight over the sum of weights; never a mean of means."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def rollup_state(df: DataFrame, keys: Sequence, value: str) -> DataFrame:
    """Mergeable state: n, total, low, high."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


def merge_state(state: DataFrame, keys: Sequence) -> DataFrame:
    """Coarser state from finer; grains must nest."""
    return state.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def collapse(df: DataFrame, keys: Sequence[str], sign: str, measures: Sequence[str]) -> DataFrame:
    """Rows of sign +1 and -1: keys with a positive sum of signs, measures summed by sign."""
    return df.groupBy(*keys).agg(F.sum(sign).alias("_s"), *[F.sum(F.col(m) * F.col(sign)).alias(m) for m in measures]).filter("_s > 0").drop("_s")


def net_counts(events: DataFrame, keys: Sequence[str], user: str, at: str, action: str, event_id: str) -> DataFrame:
    """Likes less unlikes per key, never below 0: each event counts once, and each user's last action holds."""
    once = events.dropDuplicates([event_id])
    last = once.groupBy(*keys, user).agg(F.max_by(action, F.struct(at, event_id)).alias("_a"))
    return last.groupBy(*keys).agg(F.greatest(F.lit(0), F.sum(F.when(F.col("_a") == "like", 1).otherwise(0))).alias("n"))


def summed_deltas(events: DataFrame, keys: Sequence[str], action: str, event_id: str) -> DataFrame:
    """Sum of +1 and -1 of each event once, floored at 0."""
    d = F.when(F.col(action) == "like", 1).otherwise(-1)
    return events.dropDuplicates([event_id]).groupBy(*keys).agg(F.greatest(F.lit(0), F.sum(d)).alias("n"))


def salted_count(df: DataFrame, keys: Sequence[str], salt_by: Sequence[str], shards: int = 16) -> DataFrame:
    """A counter in shards: counted per (key, shard), then summed, so that one hot key is spread over tasks."""
    parts = df.withColumn("_shard", F.pmod(F.xxhash64(*salt_by), F.lit(shards))).groupBy(*keys, "_shard").agg(F.count("*").alias("n"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"))


def split_evenly(value: str, shards: int) -> Column:
    """An array of shard values that sum to value; the first shards take the remainder."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.expr(f"{value} div {shards}") + F.when(i < F.col(value) % shards, 1).otherwise(0))


def hot_keys(events: DataFrame, key: str, at: str, seconds: int, least: int) -> DataFrame:
    """(key, start, n) of the fixed windows with at least so many events."""
    start = (F.floor(epoch(at) / seconds) * seconds).alias("start")
    return events.groupBy(key, start).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def drifted(cached: DataFrame, truth: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """Keys whose cached count is off by more than a share of the true one."""
    both = cached.withColumnRenamed("n", "cached").join(truth.withColumnRenamed("n", "truth"), key, "full").fillna(0, ["cached", "truth"])
    return both.filter(F.abs(F.col("cached") - F.col("truth")) > tolerance * F.greatest("truth", F.lit(1)))


def variation_class(mean: Column, deviation: Column) -> Column:
    cov = F.try_divide(deviation, mean)
    return F.when(cov < 0.1, "steady").when(cov > 1, "bursty").otherwise("hybrid")


def pivot_values(df: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Entity-attribute-value rows as one row per entity."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def bloom_parameters(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for n keys at a false positive rate."""
    m = max(1, int(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, int(m / max(1, n) * math.log(2)))


def bloom_positions(key: str, bits: int, hashes: int) -> Column:
    """Places of a key in a Bloom filter, by double hashing of its MD5."""
    h = F.md5(F.col(key).cast("string"))
    one = F.conv(F.substring(h, 1, 15), 16, 10).cast("long")
    two = F.conv(F.substring(h, 16, 15), 16, 10).cast("long")
    return F.array(*[F.pmod(one % bits + F.lit(i) * (two % bits), F.lit(bits)) for i in range(hashes)])


def bloom_build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """The set bits, as distinct places: the filter grows with its size, not with the keys."""
    return keys.select(F.explode(bloom_positions(key, bits, hashes)).alias("bit")).distinct()


def bloom_probe(df: DataFrame, key: str, bits_set: DataFrame, bits: int, hashes: int) -> DataFrame:
    """df with maybe: whether all of a key's bits are set."""
    keys = df.select(key).distinct()
    probes = keys.select(key, F.explode(F.array_distinct(bloom_positions(key, bits, hashes))).alias("bit"))
    found = probes.join(bits_set.withColumn("_set", F.lit(1)), "bit", "left").groupBy(key).agg((F.count("_set") == F.count("*")).alias("maybe"))
    return df.join(found, key, "left")


def _count_min_cells(key: str, width: int, depth: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(width)).alias("cell")) for i in range(depth)])


def count_min_build(df: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    """row, cell, count: a count-min sketch as a table of at most width * depth rows. Sketches merge by adding counts."""
    return df.select(F.explode(_count_min_cells(key, width, depth)).alias("c")).groupBy("c.row", "c.cell").agg(F.count("*").alias("count"))


def count_min_read(df: DataFrame, key: str, sketch: DataFrame, width: int, depth: int) -> DataFrame:
    """df with estimate: never below the key's count, and above it by more than e / width of all rows for few keys."""
    probes = df.select(key).distinct().select(key, F.explode(_count_min_cells(key, width, depth)).alias("c")).select(key, "c.row", "c.cell")
    found = probes.join(sketch, ["row", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))
    return df.join(found, key, "left")


def exact_bitmap_count(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct non-negative integers per key by bitmaps that merge."""
    maps = df.groupBy(*keys, F.expr(f"bitmap_bucket_number({value})").alias("_b")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({value}))").alias("_m"))
    return maps.groupBy(*keys).agg(F.sum(F.expr("bitmap_count(_m)")).alias("n"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank. Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
