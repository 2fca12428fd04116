"""Joins beyond the plain ones: marks, null-aware anti joins, ranges, label matches, as-of, closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.sources.formats import work_dir


def mark_join(left: DataFrame, right: DataFrame, on: Sequence[str], mark: str) -> DataFrame:
    """left with a boolean: whether right has the key. Right keys are made distinct, so left rows stay as many."""
    keys = right.select(*on).distinct().withColumn(mark, F.lit(True))
    return left.join(keys, list(on), "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def not_in(left: DataFrame, column: str, right: DataFrame, values: str) -> DataFrame:
    """SQL's NOT IN: no rows once a value is NULL; a NULL column is out unless the list is empty."""
    state = right.agg(F.count("*").alias("_n"), F.count(F.when(F.col(values).isNull(), 1)).alias("_nulls"))
    anti = left.join(right.select(F.col(values).alias("_v")).distinct(), F.col(column) == F.col("_v"), "left_anti")
    return anti.join(F.broadcast(state)).filter("_nulls = 0").filter((F.col("_n") == 0) | F.col(column).isNotNull()).drop("_n", "_nulls")


def count_fan_outs(base: DataFrame, key: str, sides: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Adds a count of each side's rows per key. Each side is summed before it is joined, so that sides do not multiply."""
    out = base
    for name, (side, side_key) in sides.items():
        counts = side.groupBy(F.col(side_key).alias(f"_{name}")).agg(F.count("*").alias(name))
        out = out.join(counts, F.col(key) == F.col(f"_{name}"), "left").drop(f"_{name}").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def interval_join(points: DataFrame, value: str, ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Points in start <= value < end by bins of a width: an equi join on bins instead of a comparison of all pairs."""
    p = points.withColumn("_bin", F.floor(F.col(value) / width))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(r, "_bin").filter((F.col(value) >= F.col(start)) & (F.col(value) < F.col(end))).drop("_bin")


def overlap_join(a: DataFrame, b: DataFrame, on: Sequence[str], width: int) -> DataFrame:
    """Pairs of a(start, end, ...) and b(start2, end2, ...) with equal keys whose half-open ranges overlap. Each pair comes from the bin of the later start only."""
    x = a.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    y = b.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start2") / width), F.floor((F.col("end2") - 1) / width))))
    both = x.join(y, [*on, "_bin"]).filter("start < end2 and start2 < end")
    return both.filter(F.col("_bin") == F.floor(F.greatest("start", "start2") / width)).drop("_bin")


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows with the columns of the one right row that has their labels. A label that right has twice raises an error when it is used."""
    rest = [c for c in right.columns if c not in on]
    one = right.groupBy(*on).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    checked = one.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("many-to-one match: the right side has a label twice")).cast("long")).otherwise(F.col("_n")))
    return left.join(checked.filter("_n = 1").drop("_n"), list(on))


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the last right row at or before its time, per key. One sort of the union; no comparison of pairs."""
    l = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType))
    r = right.select(*by, at, F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) over child, parent edges, with the least depth. Cycles end by themselves: a pair is extended once only.

    Joins level by level, so its cost is the number of pairs and not of paths. Levels are written to the shared folder, each
    with its own folder; there may be any number of them.
    """
    root = work_dir(spark)
    kind = edges.schema["child"].dataType.simpleString()
    schema = f"node {kind}, ancestor {kind}, depth int"
    edges.select("child", "parent").distinct().write.parquet(f"{root}/edges")
    step = spark.read.parquet(f"{root}/edges")
    step.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).write.parquet(f"{root}/pairs/1")
    depth = 1
    while True:
        known = spark.read.schema(schema).parquet(*[f"{root}/pairs/{d}" for d in range(1, depth + 1)])
        front = spark.read.schema(schema).parquet(f"{root}/pairs/{depth}")
        if front.isEmpty():
            return known
        further = front.join(step, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"), F.lit(depth + 1).alias("depth")).distinct()
        further.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").write.parquet(f"{root}/pairs/{depth + 1}")
        depth += 1


def keep_where(left: DataFrame, guard: DataFrame, condition: Column) -> DataFrame:
    """left as it is if the one row of guard fulfils the condition, else nothing."""
    return left.join(F.broadcast(guard.filter(condition).select(F.lit(1).alias("_ok")).limit(1))).drop("_ok")


def bloom_prefilter(left: DataFrame, key: str, right: DataFrame, right_key: str, bits: int = 1 << 20, hashes: int = 3) -> DataFrame:
    """Left rows whose key may be on the right: a bitmap of a fixed size is built by aggregation and probed. No row of the join is lost."""
    places = F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(right_key)), F.lit(bits)) for i in range(hashes)])
    maps = right.select(F.explode(places).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("_b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("_m"))
    maps = maps.agg(F.map_from_entries(F.collect_list(F.struct("_b", "_m"))).alias("_maps"))  # at most bits / 32768 entries
    out = left.join(F.broadcast(maps))
    for i in range(hashes):
        p = f"pmod(xxhash64({i}, `{key}`), {bits})"
        byte = f"conv(hex(substring(_maps[bitmap_bucket_number({p})], cast(bitmap_bit_position({p}) div 8 as int) + 1, 1)), 16, 10)"
        out = out.filter(f"cast({byte} as int) & shiftleft(1, cast(bitmap_bit_position({p}) % 8 as int)) > 0")
    return out.drop("_maps")
