"""Windows over bins of time against windows over whole series, with a hot series, ties, gaps and null times."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import series


@pytest.fixture(scope="module")
def samples(spark):
    rng, rows, at = random.Random(9), [], 0
    for i in range(3000):
        at += rng.choice([0, 0, 1, 2, 7, 60]) if i % 500 else 5000
        rows.append((i, "hot" if rng.random() < 0.7 else rng.choice([None, "a", "b"]), -20000 + at, float(rng.randrange(50))))
    rows += [(5000, "hot", None, 1.0), (5001, "a", None, 2.0), (5002, "b", 10**6, None)]
    return spark.createDataFrame(rows, "id long, k string, s long, v double").cache()


def same(got, want, *columns):
    plain = lambda df: sorted((r[0], *(None if x is None else round(x, 6) for x in r[1:])) for r in df.select("id", *columns).collect())
    assert plain(got) == plain(want)


def whole(seconds=100):
    return Window.partitionBy("k").orderBy("s").rangeBetween(-(seconds - 1), 0)


def order():
    return Window.partitionBy("k").orderBy("s", "id")


def test_ranges(samples):
    want = samples.select("id", F.count("v").over(whole()).alias("n"), F.sum("v").over(whole()).alias("total"), F.min("v").over(whole()).alias("low"), F.stddev_pop("v").over(whole()).alias("deviation"))
    same(series.over_time(samples, ["k"], 100), want, "n", "total", "low", "deviation")
    same(series.quantile_over_time(samples, ["k"], 100, 0.9), samples.withColumn("quantile", F.expr("percentile(v, 0.9)").over(whole())), "quantile")


def test_counters_and_changes(samples):
    prev = F.lag("v").over(order())
    steps = samples.withColumn("step", F.when(prev.isNull(), 0).when(F.col("v") < prev, F.col("v")).otherwise(F.col("v") - prev))
    same(series.counter_increase(samples, ["k"], 100, tie="id"), steps.withColumn("increase", F.sum("step").over(whole())), "increase")
    steps = samples.withColumn("step", F.when(prev.isNotNull() & ~F.col("v").eqNullSafe(prev), 1).otherwise(0))
    same(series.value_changes(samples, ["k"], 100, tie="id"), steps.withColumn("changes", F.sum("step").over(whole())), "changes")


def test_phi(samples):
    x = samples.withColumn("gap", F.col("s") - F.lag("s").over(order()))
    want = x.select("id", "gap", F.avg("gap").over(order().rowsBetween(-7, -1)).alias("mean"), F.stddev_samp("gap").over(order().rowsBetween(-7, -1)).alias("deviation"))
    same(series.phi_accrual(samples, ["k"], 7, tie="id", width=300), want, "gap", "mean", "deviation")


def test_hot_series_is_many_tasks(samples):
    """The largest group of a window holds a small share of the hot series."""
    hot, width = samples.filter("k = 'hot'"), series.RANGES_IN_BIN * 100
    sizes = hot.groupBy(F.floor(F.col("s") / width)).count()
    assert sizes.agg(F.max("count")).first()[0] < 0.1 * hot.count()
    plan = series.over_time(samples, ["k"], 100)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_bin" in line.split("], [")[1] for line in windows)


def test_empty(samples):
    assert series.counter_increase(samples.limit(0), ["k"], 100, tie="id").count() == 0 and series.phi_accrual(samples.limit(0), ["k"]).count() == 0
