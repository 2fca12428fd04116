"""Queries of windows and time-series algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import aggregates as ag
from lakeloom.operators import series as sr
from lakeloom.plans.registry import query
from lakeloom.sources import tables as tb
from lakeloom.sources.tables import ctes, epoch

_S = "x AS (SELECT user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, value AS v, event_type, event_id FROM events)"


def _series(t):
    return t.events.select(F.col("user_id").alias("k"), epoch().alias("s"), F.col("value").alias("v"), "event_type", "event_id")


def _r(c, n=5):
    return F.round(c, n).alias(c)


@query("wn1_total_over_all", "SELECT n_nationkey, count(*) OVER () AS total FROM nation")
def _(t):
    return t.nation.select("n_nationkey").join(F.broadcast(t.nation.agg(F.count("*").alias("total"))))


@query("wn2_latest_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("wn3_rank_of_sorted_list", "SELECT user_id, n, CAST(row_number() OVER (ORDER BY n DESC, user_id) AS INTEGER) AS rank FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY rank LIMIT 50")
def _(t):
    from pyspark.sql import Window

    top = t.events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "user_id")))


@query("wn4_top_n_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def _(t):
    return ag.top_per_group(t.lineitem, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("wn5_over_time", f"WITH {_S} SELECT event_id, count(v) OVER w AS n, round(sum(v) OVER w, 5) AS total, round(avg(v) OVER w, 5) AS mean, min(v) OVER w AS low, max(v) OVER w AS high, round(stddev_pop(v) OVER w, 5) AS deviation FROM x WINDOW w AS (PARTITION BY k ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)")
def _(t):
    return sr.over_time(_series(t), ["k"], 86400).select("event_id", "n", _r("total"), _r("mean"), "low", "high", _r("deviation"))


@query("wn5_quantile_over_time", f"WITH {_S} SELECT event_id, round(quantile_cont(v, 0.9) OVER (PARTITION BY k ORDER BY s RANGE BETWEEN 259199 PRECEDING AND CURRENT ROW), 5) AS quantile FROM x")
def _(t):
    return sr.quantile_over_time(_series(t), ["k"], 259200, 0.9).select("event_id", _r("quantile"))


@query("wn6_increase_and_rate", f"""WITH {_S}, d AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY s, event_id) AS p FROM x), e AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END AS step FROM d)
SELECT event_id, round(sum(step) OVER w, 5) AS increase, round(sum(step) OVER w / 86400, 8) AS rate FROM e WINDOW w AS (PARTITION BY k ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)""")
def _(t):
    return sr.counter_increase(_series(t), ["k"], 86400, tie="event_id").select("event_id", _r("increase"), _r("rate", 8))


@query("wn7_slope", f"WITH {_S}, h AS (SELECT k, s // 3600 AS b, min(s) AS s, avg(v) AS v FROM x GROUP BY 1, 2) SELECT k, s, CASE WHEN count(*) OVER w > 1 THEN round(regr_slope(v, s - 1700000000) OVER w, 5) + 0.0 END AS slope FROM h WINDOW w AS (PARTITION BY k ORDER BY s RANGE BETWEEN 604799 PRECEDING AND CURRENT ROW)")
def _(t):
    h = _series(t).groupBy("k", F.expr("s div 3600").alias("b")).agg(F.min("s").alias("s"), F.avg("v").alias("v"))
    return sr.slope(h, ["k"], 604800).select("k", "s", (F.round("slope", 5) + 0.0).alias("slope"))


@query("wn8_changes", f"WITH {_S}, d AS (SELECT *, lag(event_type) OVER (PARTITION BY k ORDER BY s, event_id) AS p FROM x) SELECT event_id, CAST(sum(CASE WHEN p IS NOT NULL AND p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS BIGINT) AS changes FROM d")
def _(t):
    return sr.value_changes(_series(t), ["k"], 86400, "event_type", tie="event_id").select("event_id", "changes")


_HOUR = "h AS (SELECT k % 16 AS host, s // 3600 * 3600 AS s, max(v) AS v FROM x GROUP BY 1, 2)"


def _hours(t):
    return sr.resample(_series(t).withColumn("host", F.col("k") % 16), ["host"], 3600, F.max("v"))


@query("wn9_offset", f"WITH {_S}, {_HOUR} SELECT a.host, CAST(a.s AS BIGINT) AS s, b.v AS before FROM h a LEFT JOIN h b ON a.host = b.host AND b.s = a.s - 86400")
def _(t):
    return sr.offset(_hours(t), ["host"], 86400).select("host", "s", "before")


@query("wn10_subquery", f"WITH {_S}, {_HOUR} SELECT host, CAST(s AS BIGINT) AS s, max(v) OVER (PARTITION BY host ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS high FROM h")
def _(t):
    return sr.over_time(_hours(t), ["host"], 86400).select("host", "s", "high")


@query("wn11_alert_for", f"""WITH {_S}, {_HOUR}, r AS (SELECT *, sum(CASE WHEN v > 200 THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY s) AS run FROM h)
SELECT host, CAST(min(s) AS BIGINT) AS "start", CAST(max(s) AS BIGINT) AS "end", count(*) AS n FROM r WHERE v > 200 GROUP BY host, run HAVING max(s) - min(s) >= 7200""")
def _(t):
    return sr.held_for(_hours(t), ["host"], F.col("v") > 200, 7200).select("host", "start", "end", "n")


@query("wn12_absent", f"WITH {_S}, {_HOUR}, g AS (SELECT a.host, b.s FROM (SELECT DISTINCT host FROM h) a, (SELECT DISTINCT s FROM h) b) SELECT host, CAST(s AS BIGINT) AS s FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.host = g.host AND h.s = g.s)")
def _(t):
    h = _hours(t)
    grid = h.select("host").distinct().crossJoin(F.broadcast(h.select("s").distinct()))
    return sr.absent(grid, h, ["host", "s"])


_GAPS = "g AS (SELECT k, event_id, s, s - lag(s) OVER (PARTITION BY k ORDER BY s, event_id) AS gap FROM x)"


@query("wn13_phi_accrual", f"""WITH {_S}, {_GAPS}, m AS (SELECT *, avg(gap) OVER w AS mean, stddev_samp(gap) OVER w AS dev FROM g WINDOW w AS (PARTITION BY k ORDER BY s, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (gap - mean) / nullif(CASE WHEN coalesce(dev, 0) > 0 THEN dev ELSE mean / 4 END, 0) AS z FROM m), u AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z),
p AS (SELECT *, 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) AS half FROM u), q AS (SELECT *, CASE WHEN z >= 0 THEN half ELSE 1 - half END AS tail FROM p)
SELECT event_id, round(mean, 4) AS mean, round(CASE WHEN tail <= 1e-15 THEN 15.0 ELSE least(15.0, -log10(CASE WHEN tail <= 1e-15 THEN NULL ELSE tail END)) END, 5) + 0.0 AS phi FROM q""")
def _(t):
    return sr.phi_accrual(_series(t), ["k"], tie="event_id").select("event_id", _r("mean", 4), (F.round("phi", 5) + 0.0).alias("phi"))


@query("wn14_fixed_timeout", f"WITH {_S}, {_GAPS} SELECT event_id, gap > 172800 AS late FROM g WHERE gap IS NOT NULL")
def _(t):
    return sr.phi_accrual(_series(t), ["k"], tie="event_id").filter("gap is not null").select("event_id", (F.col("gap") > 172800).alias("late"))


@query("wn15_probe_health", f"""WITH {_S}, y AS (SELECT *, event_type NOT IN ('error', 'signup') AS ok, sum(CASE WHEN event_type NOT IN ('error', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x),
f AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY k, run ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fails FROM y)
SELECT event_id, fails, CASE WHEN fails >= 3 THEN 'DEAD' WHEN fails >= 1 THEN 'SUSPECT' WHEN v > 400 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM f""")
def _(t):
    x = _series(t).withColumn("ok", ~F.col("event_type").isin("error", "signup")).withColumn("slow", F.col("v") > 400)
    return sr.probe_health(x, ["k"], "ok", "slow", tie="event_id").select("event_id", "fails", "health")


@query("wn16_gossip_merge", f"WITH {_S}, y AS (SELECT k % 50 AS peer, s, CASE WHEN event_type = 'error' AND v > 450 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END AS r FROM x), z AS (SELECT peer, max(r) AS r, max(s) AS last FROM y GROUP BY 1) SELECT peer, last, CASE WHEN r = 2 OR (r = 1 AND 1706655000 - last > 5) THEN 'dead' WHEN r = 1 THEN 'suspect' ELSE 'alive' END AS status FROM z")
def _(t):
    status = F.when((F.col("event_type") == "error") & (F.col("v") > 450), "dead").when(F.col("event_type") == "error", "suspect").otherwise("alive")
    return sr.gossip_merge(_series(t).withColumn("peer", F.col("k") % 50).withColumn("status", status), "peer", "status", "s", 1706655000)


@query("wn17_rolling_percentile_of_peaks", f"WITH {_S}, d AS (SELECT k % 16 AS host, s // 86400 AS d, max(v) AS peak FROM x GROUP BY 1, 2) SELECT host, CAST(d AS BIGINT) AS d, round(quantile_cont(peak, 0.9) OVER (PARTITION BY host ORDER BY d RANGE BETWEEN 29 PRECEDING AND CURRENT ROW), 5) AS quantile FROM d")
def _(t):
    d = _series(t).groupBy((F.col("k") % 16).alias("host"), F.expr("s div 86400").alias("d")).agg(F.max("v").alias("peak"))
    return sr.quantile_over_time(d, ["host"], 30, 0.9, "peak", "d").select("host", "d", _r("quantile"))


@query("wn18_count_over_time", f"WITH {_S} SELECT event_id, count(*) FILTER (v > 250) OVER (PARTITION BY k ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM x")
def _(t):
    return sr.over_ranges(_series(t), ["k"], 86400, "s", n=lambda w: F.count(F.when(F.col("v") > 250, 1)).over(w)).select("event_id", "n")


@query("wn19_age_of_last_event", f"WITH {_S} SELECT k, (SELECT max(s) FROM x) - max(s) AS age FROM x GROUP BY k HAVING (SELECT max(s) FROM x) - max(s) > 3600")
def _(t):
    x = _series(t)
    last = x.groupBy("k").agg(F.max("s").alias("last")).join(F.broadcast(x.agg(F.max("s").alias("now"))))
    return last.select("k", (F.col("now") - F.col("last")).alias("age")).filter("age > 3600")


_BUCKETS = "b AS (SELECT user_id AS k, le, count(*) FILTER (value <= le) AS cumulative FROM events, (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 'Infinity'::DOUBLE]) AS le) GROUP BY 1, 2)"


@query("bq24_histogram_quantile", f"""WITH {_BUCKETS}, w AS (SELECT *, lag(le) OVER (PARTITION BY k ORDER BY le) AS low, coalesce(lag(cumulative) OVER (PARTITION BY k ORDER BY le), 0) AS pre, max(cumulative) OVER (PARTITION BY k) AS total FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY le) AS r FROM w WHERE cumulative >= 0.95 * total AND total > 0)
SELECT k, round(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (0.95 * total - pre) / nullif(cumulative - pre, 0) END, 5) AS quantile FROM f WHERE r = 1""")
def _(t):
    bounds = F.array(*[F.lit(x) for x in (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, float("inf"))])
    b = t.events.select(F.col("user_id").alias("k"), "value", F.explode(bounds).alias("le")).groupBy("k", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("cumulative"))
    return sr.histogram_quantile(b, ["k"], 0.95).select("k", _r("quantile"))


@query("bq26_series_cardinality", f"{ctes('gpu')} SELECT metric, count(DISTINCT (host, device, cluster)) AS series FROM gpu GROUP BY 1 ORDER BY series DESC, metric LIMIT 10")
def _(t):
    return tb.gpu_metrics(t).groupBy("metric").agg(F.count_distinct(F.struct("host", "device", "cluster")).alias("series")).orderBy(F.col("series").desc(), "metric").limit(10)
