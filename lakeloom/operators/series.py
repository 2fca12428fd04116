"""Time-series algebra on (keys, second s, value v): range functions, counters, alerts, detectors.

A range ``d`` at time t is (t - d, t]: open on the left. Counters that fall were reset: the new
value is the increase. No extrapolation to the range's borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A bin of time is so many ranges wide; a block of ranks is so many windows long.
RANGES_IN_BIN, WINDOWS_IN_BLOCK = 4, 10


def _bin(at: str, width: int, ahead: int = 0) -> Column:
    return F.floor((F.col(at) + ahead) / width)


def over_ranges(df: DataFrame, keys: Sequence[str], seconds: int, at: str, **columns) -> DataFrame:
    """Adds columns, functions of a trailing window, over bins of time: a sample is copied to the next bin if ranges there reach back to it."""
    width = RANGES_IN_BIN * seconds
    x = df.withColumn("_bin", F.explode_outer(F.sequence(_bin(at, width), _bin(at, width, seconds - 1))))
    w = Window.partitionBy(*keys, "_bin").orderBy(at).rangeBetween(-(seconds - 1), 0)
    x = x.select("*", *[f(w).alias(name) for name, f in columns.items()])
    return x.filter(F.col("_bin").eqNullSafe(_bin(at, width))).drop("_bin")


def _with_carried(df: DataFrame, keys: Sequence[str], at: str, tie: str | None, width: int, carry: Column, name: str, running: bool) -> tuple[DataFrame, object]:
    """The samples by bins of time, and before each bin's first one a row whose column `name` is carry (an aggregate of a bin)
    of the bin before, or its running sum over all bins before; and the window of a bin in order. _own tells samples from carried rows."""
    x = df.withColumn("_bin", _bin(at, width)).withColumn("_own", F.lit(True))
    by = Window.partitionBy(*keys).orderBy("_bin")  # a row for each bin of a series
    left = x.groupBy(*keys, "_bin").agg(carry.alias("_left"))
    before = F.sum("_left").over(by.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag("_left").over(by)
    carried = left.select(*keys, "_bin", before.alias(name), F.lit(False).alias("_own"))
    order = ["_own", at, *([tie] if tie else [])]
    return x.unionByName(carried, allowMissingColumns=True), Window.partitionBy(*keys, "_bin").orderBy(*order)


def _previous(df: DataFrame, keys: Sequence[str], value: str, at: str, tie: str | None, width: int, name: str) -> DataFrame:
    """Adds the value of the sample before, from whichever bin."""
    last = F.max_by(value, F.struct(at, *([tie] if tie else [])))
    x, w = _with_carried(df, keys, at, tie, width, last, value, running=False)
    return x.withColumn(name, F.lag(value).over(w)).filter("_own").drop("_own", "_bin")


def _in_order(keys: Sequence[str], at: str = "s", tie: str | None = None):
    return Window.partitionBy(*keys).orderBy(*([at, tie] if tie else [at]))


def over_time(df: DataFrame, keys: Sequence[str], seconds: int, value: str = "v", at: str = "s") -> DataFrame:
    """Adds n, total, mean, low, high and population deviation over the trailing range."""
    each = {"n": F.count, "total": F.sum, "mean": F.avg, "low": F.min, "high": F.max, "deviation": F.stddev_pop}
    return over_ranges(df, keys, seconds, at, **{name: lambda w, f=f: f(value).over(w) for name, f in each.items()})


def quantile_over_time(df: DataFrame, keys: Sequence[str], seconds: int, q: float, value: str = "v", at: str = "s") -> DataFrame:
    return over_ranges(df, keys, seconds, at, quantile=lambda w: F.expr(f"percentile({value}, {q})").over(w))


def counter_increase(df: DataFrame, keys: Sequence[str], seconds: int, value: str = "v", at: str = "s", tie: str | None = None) -> DataFrame:
    """Adds increase over the trailing range and rate per second. The step into a series's first sample is none."""
    x, prev = _previous(df, keys, value, at, tie, RANGES_IN_BIN * seconds, "_prev"), F.col("_prev")
    step = F.when(prev.isNull(), 0).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
    out = over_ranges(x.withColumn("_step", step).drop("_prev"), keys, seconds, at, increase=lambda w: F.sum("_step").over(w))
    return out.withColumn("rate", F.col("increase") / seconds).drop("_step")


def slope(df: DataFrame, keys: Sequence[str], seconds: int, value: str = "v", at: str = "s") -> DataFrame:
    """Adds the least-squares slope per second over the trailing range (null with fewer than two times)."""
    x, y = F.col(at).cast("double") - F.lit(1.7e9), F.col(value)
    sums = {"_n": F.count("*"), "_x": F.sum(x), "_y": F.sum(y), "_xy": F.sum(x * y), "_xx": F.sum(x * x)}
    out = over_ranges(df, keys, seconds, at, **{name: lambda w, c=c: c.over(w) for name, c in sums.items()})
    n, sx, sy, sxy, sxx = map(F.col, sums)
    return out.withColumn("slope", F.try_divide(n * sxy - sx * sy, F.nullif(n * sxx - sx * sx, F.lit(0.0)))).drop(*sums)


def value_changes(df: DataFrame, keys: Sequence[str], seconds: int, value: str = "v", at: str = "s", tie: str | None = None) -> DataFrame:
    """Adds how often the value differed from the one before, over the trailing range."""
    x, prev = _previous(df, keys, value, at, tie, RANGES_IN_BIN * seconds, "_prev"), F.col("_prev")
    step = F.when(prev.isNotNull() & ~F.col(value).eqNullSafe(prev), 1).otherwise(0)
    return over_ranges(x.withColumn("_step", step).drop("_prev"), keys, seconds, at, changes=lambda w: F.sum("_step").over(w)).drop("_step")


def resample(df: DataFrame, keys: Sequence[str], seconds: int, agg: Column, value_name: str = "v", at: str = "s") -> DataFrame:
    return df.groupBy(*keys, (F.floor(F.col(at) / seconds) * seconds).alias(at)).agg(agg.alias(value_name))


def offset(df: DataFrame, keys: Sequence[str], seconds: int, value: str = "v", at: str = "s") -> DataFrame:
    """Adds the value from so many seconds earlier, on a regular grid (null where there is none)."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-seconds, -seconds)
    return df.withColumn("before", F.max(value).over(w))


def held_for(df: DataFrame, keys: Sequence[str], condition: Column, seconds: int, at: str = "s", tie: str | None = None) -> DataFrame:
    """Runs of samples for which a condition held without a break for at least so long: keys, start, end, n."""
    w = _in_order(keys, at, tie)
    bad = F.when(F.coalesce(condition, F.lit(False)), 0).otherwise(1)
    runs = df.withColumn("_bad", bad).withColumn("_run", F.sum("_bad").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("_bad = 0")
    out = runs.groupBy(*keys, "_run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
    return out.filter(F.col("end") - F.col("start") >= seconds).drop("_run")


def absent(expected: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys (and times) without a sample."""
    return expected.join(series.select(*keys).distinct(), list(keys), "left_anti")


def normal_tail(z: Column) -> Column:
    """1 - Phi(z): half of erfc(z / sqrt 2), by the rational approximation 7.1.26 of Abramowitz and Stegun (error under 1.5e-7)."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values of the approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def phi_accrual(df: DataFrame, keys: Sequence[str], window: int = 100, at: str = "s", tie: str | None = None, now: Column | None = None, most: float = 15.0, width: int = 86400) -> DataFrame:
    """Adds the mean and sample deviation of up to `window` earlier intervals, and the suspicion of each interval.

    Ranks within a series come from bins of `width` seconds and carried counts. Blocks of ranks are the tasks' units, each with
    the window + 1 samples before it."""
    x, w = _with_carried(df.withColumn("_n", F.lit(1).cast("long")), keys, at, tie, width, F.count("*"), "_n", running=True)
    x = x.withColumn("_rank", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("_own").drop("_own", "_bin", "_n")
    long = WINDOWS_IN_BLOCK * window
    own = F.floor(F.col("_rank") / long)
    x = x.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col("_rank") + window + 1) / long))))
    w = Window.partitionBy(*keys, "_block").orderBy("_rank")
    past = w.rowsBetween(-window, -1)
    x = x.withColumn("gap", F.col(at) - F.lag(at).over(w))
    x = x.withColumn("mean", F.avg("gap").over(past)).withColumn("deviation", F.stddev_samp("gap").over(past))
    x = x.filter(F.col("_block") == own).drop("_block", "_rank")
    sigma = F.when(F.coalesce("deviation", F.lit(0.0)) > 0, F.col("deviation")).otherwise(F.col("mean") / 4)
    tail = normal_tail((F.col("gap") - F.col("mean")) / F.nullif(sigma, F.lit(0.0)))
    phi = F.when(tail <= 10.0 ** -most, F.lit(most)).otherwise(F.least(F.lit(most), -F.log10(tail)))
    return x.withColumn("phi", phi)


def probe_health(df: DataFrame, keys: Sequence[str], ok: str, degraded: str, at: str = "s", tie: str | None = None, suspect: int = 1, dead: int = 3) -> DataFrame:
    """Adds health by the number of failures in a row: HEALTHY or DEGRADED without one, SUSPECT, DEAD."""
    w = _in_order(keys, at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = df.withColumn("_run", F.sum(F.when(F.col(ok), 1).otherwise(0)).over(w))
    fails = F.sum(F.when(F.col(ok), 0).otherwise(1)).over(Window.partitionBy(*keys, "_run").orderBy(*([at, tie] if tie else [at])).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("fails", fails)
    return x.withColumn("health", F.when(F.col("fails") >= dead, "DEAD").when(F.col("fails") >= suspect, "SUSPECT").when(F.col(degraded), "DEGRADED").otherwise("HEALTHY")).drop("_run")


def gossip_merge(reports: DataFrame, peer: str, status: str, at: str, now, dead_after: int = 5) -> DataFrame:
    """The worst status that any member reports for a peer; a suspect that was not heard of for so long is dead."""
    rank = F.when(F.col(status) == "dead", 2).when(F.col(status) == "suspect", 1).otherwise(0)
    worst = reports.groupBy(peer).agg(F.max(rank).alias("_r"), F.max(at).alias("last"))
    late = (F.col("_r") == 1) & (F.lit(now) - F.col("last") > dead_after)
    return worst.select(peer, "last", F.when((F.col("_r") == 2) | late, "dead").when(F.col("_r") == 1, "suspect").otherwise("alive").alias("status"))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float, le: str = "le", count: str = "cumulative") -> DataFrame:
    """The quantile of cumulative buckets by linear interpolation. The last bucket has le = +Infinity; a quantile in it gives the highest finite bound."""
    w = Window.partitionBy(*keys).orderBy(le)
    x = buckets.withColumn("_low", F.lag(le).over(w)).withColumn("_before", F.coalesce(F.lag(count).over(w), F.lit(0))).withColumn("_total", F.max(count).over(Window.partitionBy(*keys)))
    x = x.filter((F.col("_total") > 0) & (F.col(count) >= q * F.col("_total")))
    first = x.groupBy(*keys).agg(F.min(F.struct(F.col(le).alias("le"), F.col("_low").alias("low"), F.col("_before").alias("before"), F.col(count).alias("cum"), F.col("_total").alias("total"))).alias("b"))
    b = F.col("b")
    low = F.coalesce(b["low"], F.lit(0.0))
    inside = low + (b["le"] - low) * F.try_divide(q * b["total"] - b["before"], (b["cum"] - b["before"]).cast("double"))
    return first.select(*keys, F.when(b["le"] == float("inf"), b["low"]).otherwise(inside).alias("quantile"))


def running_max_before(df: DataFrame, order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Adds the largest value of all rows before, by a whole number that gives the order.

    Rows are dealt to ranges of ``width`` numbers, and ranges to ranges of ranges; each has the largest value of those
    before it carried in, so that no task takes more than a range's rows, and the last one a row for each width ** 2 numbers.
    """
    from pyspark.sql import Window

    def before(by: Sequence[str], at: str):
        return Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)

    x = df.withColumn("_bin", F.floor(F.col(order) / width))
    bins = x.groupBy("_bin").agg(F.max(value).alias("_high")).withColumn("_top", F.floor(F.col("_bin") / width))
    tops = bins.groupBy("_top").agg(F.max("_high").alias("_high"))
    tops = tops.select("_top", F.max("_high").over(before([], "_top")).alias("_above"))
    bins = bins.withColumn("_inside", F.max("_high").over(before(["_top"], "_bin"))).join(tops, "_top").select("_bin", F.greatest("_inside", "_above").alias("_carried"))
    return x.withColumn("_own", F.max(value).over(before(["_bin"], order))).join(bins, "_bin").withColumn(name, F.greatest("_own", "_carried")).drop("_bin", "_own", "_carried")
