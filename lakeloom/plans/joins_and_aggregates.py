"""Queries of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import aggregates as ag
from lakeloom.operators import joins as jn
from lakeloom.plans.registry import query
from lakeloom.sources import tables as tb
from lakeloom.sources.tables import ctes, epoch, text_time


@query("jn1_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("jn2_semi_join", f"{ctes('posts', 'follows')} SELECT post_id FROM posts WHERE author IN (SELECT followee FROM follows WHERE follower = 7)")
def _(t):
    mine = tb.follows(t).filter("follower = 7").select(F.col("followee").alias("author"))
    return tb.posts(t).join(mine, "author", "left_semi").select("post_id")


@query("jn3_mark_join", f"{ctes('posts', 'likes')} SELECT post_id, EXISTS (SELECT 1 FROM likes l WHERE l.post_id = p.post_id AND l.user_id = 5) AS is_liked FROM posts p")
def _(t):
    return jn.mark_join(tb.posts(t).select("post_id"), tb.likes(t).filter("user_id = 5"), ["post_id"], "is_liked")


@query("jn4_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("jn4_not_in_with_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END FROM orders)")
def _(t):
    bad = t.orders.select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("k"))
    return jn.not_in(t.customer.select("c_custkey"), "c_custkey", bad, "k")


@query("jn4_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 250000)")
def _(t):
    return jn.not_in(t.customer.select("c_custkey"), "c_custkey", t.orders.filter("o_totalprice >= 250000"), "o_custkey")


@query("jn5_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("jn6_fan_out_counts", f"{ctes('posts', 'likes', 'follows')} SELECT c_custkey, (SELECT count(*) FROM posts WHERE author = c_custkey) AS posts, (SELECT count(*) FROM follows WHERE followee = c_custkey) AS followers, (SELECT count(*) FROM likes WHERE user_id = c_custkey) AS likes FROM customer")
def _(t):
    return jn.count_fan_outs(t.customer.select("c_custkey"), "c_custkey", {"posts": (tb.posts(t), "author"), "followers": (tb.follows(t), "followee"), "likes": (tb.likes(t), "user_id")})


@query("jn7_shuffle_hash_join", "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(t):
    return t.lineitem.join(t.part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("jn9_sort_merge_join", "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    return t.lineitem.join(t.orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("jn10_theta_join", "SELECT a.n_nationkey AS a, count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey GROUP BY 1")
def _(t):
    a, b = t.nation.selectExpr("n_nationkey a", "n_regionkey ra"), t.nation.selectExpr("n_nationkey b", "n_regionkey rb")
    return a.join(F.broadcast(b), F.expr("a < b and ra <> rb")).groupBy("a").agg(F.count("*").alias("n"))


_BANDS = "bands AS (SELECT i AS band, i * 100000 AS lo, (i + 1) * 100000 - (i % 2) * 20000 AS hi FROM range(6) r(i))"


@query("jn11_range_join", f"WITH {_BANDS} SELECT band, count(*) AS n FROM orders JOIN bands ON CAST(floor(o_totalprice) AS BIGINT) >= lo AND CAST(floor(o_totalprice) AS BIGINT) < hi GROUP BY 1")
def _(t):
    bands = t.spark.range(6).select(F.col("id").alias("band"), (F.col("id") * 100000).alias("lo"), ((F.col("id") + 1) * 100000 - F.col("id") % 2 * 20000).alias("hi"))
    return jn.interval_join(t.orders.select(F.floor("o_totalprice").alias("price")), "price", bands, "lo", "hi", 50000).groupBy("band").agg(F.count("*").alias("n"))


@query("jn12_broadcast_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("jn14_star_join", """SELECT r_name, p_brand, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2) AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size <= 10 GROUP BY 1, 2""")
def _(t):
    where = F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    s = t.supplier.join(where, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    p = t.part.filter("p_size <= 10").select("p_partkey", "p_brand")
    x = t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    exact = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))  # money: the sum must not depend on the order of rows
    return x.groupBy("r_name", "p_brand").agg(F.round(F.sum(exact), 2).cast("double").alias("revenue"))


_COST = "cost AS (SELECT n_regionkey AS cluster, m AS month, 2.0 + n_regionkey * 0.25 + m * 0.01 AS rate FROM (SELECT DISTINCT n_regionkey FROM nation), (SELECT unnest([1, 2, 3]) AS m))"


def _cost(t):
    months = t.spark.range(1, 4).select(F.col("id").cast("int").alias("month"))
    return t.nation.select(F.col("n_regionkey").alias("cluster")).distinct().join(F.broadcast(months)).withColumn("rate", 2.0 + F.col("cluster") * 0.25 + F.col("month") * 0.01)


@query("jn15_point_in_period", f"{ctes('gpu')}, {_COST} SELECT gpu.cluster, CAST(month(ts) AS INTEGER) AS month, count(*) AS n, round(sum(value * rate), 3) AS spent FROM gpu JOIN cost ON gpu.cluster = cost.cluster AND cost.month = month(ts) GROUP BY 1, 2")
def _(t):
    g = tb.gpu_metrics(t).withColumn("month", F.month("ts"))
    return g.join(F.broadcast(_cost(t)), ["cluster", "month"]).groupBy("cluster", "month").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("rate")), 3).alias("spent"))


@query("jn16_correlated_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def _(t):
    mean = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("m"))
    return t.orders.join(mean, F.col("o_custkey") == F.col("k")).filter("o_totalprice > 1.5 * m").select("o_orderkey")


@query("jn17_many_to_one_match", f"{ctes('gpu')}, o AS (SELECT n_nationkey AS host, n_name AS owner FROM nation) SELECT owner, count(*) AS n, round(sum(value), 4) AS total FROM gpu JOIN o USING (host) GROUP BY 1")
def _(t):
    owner = t.nation.select(F.col("n_nationkey").cast("long").alias("host"), F.col("n_name").alias("owner"))
    return jn.many_to_one(tb.gpu_metrics(t), owner, ["host"]).groupBy("owner").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("jn18_and_on", "SELECT DISTINCT a.user_id FROM events a WHERE a.event_type = 'error' AND a.value > 400 AND a.user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 400)")
def _(t):
    a = t.events.filter("event_type = 'error' and value > 400").select("user_id").distinct()
    return a.join(t.events.filter("event_type = 'purchase' and value > 400"), "user_id", "left_semi")


@query("jn19_unless_on", "SELECT DISTINCT a.user_id FROM events a WHERE a.event_type = 'error' AND a.value > 400 AND a.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 400)")
def _(t):
    a = t.events.filter("event_type = 'error' and value > 400").select("user_id").distinct()
    return a.join(t.events.filter("event_type = 'purchase' and value > 400"), "user_id", "left_anti")


@query("jn20_as_of_join", """WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT q.event_id, v.value FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.ts >= v.ts""")
def _(t):
    v = t.events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    q = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return jn.as_of_join(q, v, ["user_id"], "ts", ["value"]).select("event_id", "value")


@query("jn20_offset_self_join", f"{ctes('gpu')}, h AS (SELECT host, s // 3600 AS hour, sum(value) AS v FROM gpu GROUP BY 1, 2) SELECT a.host, a.hour, round(a.v - b.v, 4) AS change FROM h a JOIN h b ON a.host = b.host AND a.hour = b.hour + 1")
def _(t):
    h = tb.gpu_metrics(t).groupBy("host", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 3600").alias("hour")).agg(F.sum("value").alias("v"))
    b = h.select("host", (F.col("hour") + 1).alias("hour"), F.col("v").alias("before"))
    return h.join(b, ["host", "hour"]).select("host", "hour", F.round(F.col("v") - F.col("before"), 4).alias("change"))


@query("jn21_closure_with_cycle", f"WITH RECURSIVE {tb.SQL['roles']}, e AS (SELECT * FROM roles UNION ALL SELECT 'r1', 'n1'), c(node, ancestor) AS (SELECT child, parent FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON c.ancestor = e.child) SELECT node, ancestor FROM c")
def _(t):
    e = tb.roles(t).union(t.spark.createDataFrame([("r1", "n1")], "child string, parent string"))
    return jn.closure(t.spark, e).select("node", "ancestor")


@query("jn22_closure_table", f"WITH {tb.SQL['roles']}, c AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM roles UNION ALL SELECT a.child, b.parent, 2 FROM roles a JOIN roles b ON a.parent = b.child) SELECT ancestor, count(*) AS below, max(depth) AS levels FROM c GROUP BY 1")
def _(t):
    return jn.closure(t.spark, tb.roles(t)).groupBy("ancestor").agg(F.count("*").alias("below"), F.max("depth").alias("levels"))


@query("jn23_unnest", f"{ctes('tweets')} SELECT id, tag FROM (SELECT id, unnest(hashtags) AS tag FROM tweets) WHERE tag LIKE '#t%'")
def _(t):
    return tb.tweets(t).select("id", F.explode("hashtags").alias("tag")).filter(F.col("tag").like("#t%"))


@query("jn26_bloom_prefilter", "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def _(t):
    p = t.part.filter("p_size = 7").select("p_partkey")
    maybe = jn.bloom_prefilter(t.lineitem.select("l_partkey"), "l_partkey", p, "p_partkey")
    return maybe.join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(F.count("*").alias("n"))


@query("jn27_role_permission_grants", "SELECT r_name AS role, p AS permission FROM region CROSS JOIN (SELECT unnest(['post:read', 'post:write', 'user:ban']) AS p) WHERE r_name = 'ASIA' OR p = 'post:read'")
def _(t):
    p = t.spark.createDataFrame([("post:read",), ("post:write",), ("user:ban",)], "permission string")
    return t.region.select(F.col("r_name").alias("role")).crossJoin(F.broadcast(p)).filter((F.col("role") == "ASIA") | (F.col("permission") == "post:read"))


_STAYS = "stays AS (SELECT event_id AS id, user_id AS room, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 1 + CAST(floor(value * 60) AS BIGINT) AS e FROM events)"


@query("jn28_overlap_join", f"WITH {_STAYS} SELECT a.id AS id, b.id AS id2 FROM stays a JOIN stays b ON a.room = b.room AND a.id < b.id AND a.s < b.e AND b.s < a.e")
def _(t):
    x = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("room"), epoch().alias("start"), (epoch() + 1 + F.floor(F.col("value") * 60)).alias("end"))
    y = x.withColumnsRenamed({"id": "id2", "start": "start2", "end": "end2"})
    return jn.overlap_join(x, y, ["room"], 21600).filter("id < id2").select("id", "id2")


# aggregation ---------------------------------------------------------------------------------
@query("ag1_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS mean, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY 1, 2")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_discount").alias("low"), F.max("l_tax").alias("high"))


@query("ag2_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 12")


@query("ag3_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@query("ag4_filtered_aggregates", "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, round(avg(value) FILTER (event_type = 'purchase'), 6) AS spent FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("spent"))


@query("ag5_conditional_sum", "SELECT user_id % 16 AS host, round(sum(CASE WHEN value < 25 THEN 1 ELSE 0 END) / 60.0, 6) AS idle_hours FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy((F.col("user_id") % 16).alias("host")).agg(F.round(F.sum(F.when(F.col("value") < 25, 1).otherwise(0)) / 60.0, 6).alias("idle_hours"))


@query("ag6_ratio_with_nullif", "SELECT user_id, round(count(*) FILTER (event_type = 'purchase') / CAST(nullif(count(*) FILTER (event_type = 'view' AND value > 300), 0) AS DOUBLE), 6) AS r FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.round(ag.ratio(F.count_if(F.col("event_type") == "purchase"), F.count_if((F.col("event_type") == "view") & (F.col("value") > 300))), 6).alias("r"))


_MINUTE = "m AS (SELECT user_id AS device, user_id % 16 AS host, date_trunc('minute', ts) AS bucket, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2, 3)"


def _minutes(t):
    return t.events.groupBy(F.col("user_id").alias("device"), (F.col("user_id") % 16).alias("host"), F.date_trunc("minute", "ts").alias("bucket")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query("ag7_weighted_mean", f"WITH {_MINUTE} SELECT host, round(sum(mean * n) / sum(n), 6) AS mean FROM m GROUP BY 1")
def _(t):
    return _minutes(t).groupBy("host").agg(F.round(ag.weighted_mean("mean", "n"), 6).alias("mean"))


@query("ag8_global_aggregate", "SELECT count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events")
def _(t):
    return t.events.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query("ag9_group_by_expression", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("ag10_group_by_unnested", f"{ctes('tweets')} SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(hashtags) AS tag FROM tweets) GROUP BY 1")
def _(t):
    return tb.tweets(t).select(F.explode(F.transform("hashtags", F.lower)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("ag11_string_agg", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


@query("ag12_pivot", "SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view FROM events GROUP BY 1")
def _(t):
    return ag.pivot_values(t.events, "user_id", "event_type", "value", ["click", "view"])


@query("ag13_cube", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("ag13_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("ag15_two_stage_state", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def _(t):
    parts = ag.rollup_state(t.events, ["event_type", "user_id"], "value")
    return ag.merge_state(parts, ["event_type"]).withColumn("total", F.round("total", 4))


@query("ag16_approx_distinct", "SELECT TRUE AS within_error FROM (SELECT 1)")
def _(t):
    # in one aggregate with the exact count, a sketch would be kept for each key
    sketch = t.lineitem.agg(F.approx_count_distinct("l_orderkey", 0.01).alias("a"))
    x = sketch.join(F.broadcast(t.lineitem.agg(F.countDistinct("l_orderkey").alias("e"))))
    return x.select((F.abs(F.col("a") - F.col("e")) <= 0.05 * F.col("e")).alias("within_error"))


@query("ag17_mergeable_hll", "SELECT TRUE AS within_error FROM (SELECT 1)")
def _(t):
    parts = t.lineitem.groupBy("l_returnflag").agg(F.hll_sketch_agg("l_orderkey", 12).alias("s"))
    merged = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("a"))
    return merged.join(F.broadcast(t.lineitem.agg(F.countDistinct("l_orderkey").alias("e")))).select((F.abs(F.col("a") - F.col("e")) <= 0.05 * F.col("e")).alias("within_error"))


@query("ag18_count_min_sketch", "SELECT user_id, count(*) AS n, TRUE AS not_below, TRUE AS close FROM events GROUP BY 1")
def _(t):
    exact = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    read = ag.count_min_read(exact, "user_id", ag.count_min_build(t.events, "user_id", 2000, 5), 2000, 5)
    total = t.events.agg(F.count("*").alias("total"))
    return read.join(F.broadcast(total)).select("user_id", "n", (F.col("estimate") >= F.col("n")).alias("not_below"), (F.col("estimate") <= F.col("n") + F.greatest(F.lit(1), F.col("total") * F.e() / 2000)).alias("close"))


@query("ag19_approx_quantile", "SELECT event_type, TRUE AS within_error FROM events GROUP BY 1")
def _(t):
    # the estimate is bounded in rank, not in value: its rank is at most n / accuracy from the asked one
    x = t.events.groupBy("event_type").agg(F.percentile_approx("value", 0.95, 10000).alias("a"), F.count("value").alias("n"))
    ranks = t.events.join(x, "event_type").groupBy("event_type", "n").agg(F.count_if(F.col("value") < F.col("a")).alias("below"), F.count_if(F.col("value") <= F.col("a")).alias("upto"))
    asked, slack = 0.95 * F.col("n"), F.col("n") / 10000 + 1
    return ranks.select("event_type", ((F.col("below") <= asked + slack) & (F.col("upto") >= asked - slack)).alias("within_error"))


@query("ag20_theta_sets", "SELECT TRUE AS within_error FROM (SELECT 1)")
def _(t):
    sketch = lambda kind: t.events.filter(f"event_type = '{kind}'").agg(F.expr("theta_sketch_agg(user_id)").alias(kind))
    both = sketch("click").join(F.broadcast(sketch("purchase")))
    a = both.select(F.expr("theta_sketch_estimate(theta_intersection(click, purchase))").alias("a"))
    e = t.events.filter("event_type = 'click'").select("user_id").distinct().join(t.events.filter("event_type = 'purchase'"), "user_id", "left_semi").agg(F.count("*").alias("e"))
    return a.join(F.broadcast(e)).select((F.abs(F.col("a") - F.col("e")) <= 0.05 * F.col("e") + 1).alias("within_error"))


@query("ag21_bloom_membership", "SELECT p_size <= 10 AS member, count(*) AS n, TRUE AS as_promised FROM part GROUP BY 1")
def _(t):
    keys = t.part.filter("p_size <= 10").select("p_partkey")
    bits, hashes = ag.bloom_parameters(max(20000, keys.count()), 0.01)  # for the keys there are: a filter that is too small tells nothing
    out = ag.bloom_probe(t.part.select("p_partkey", (F.col("p_size") <= 10).alias("member")), "p_partkey", ag.bloom_build(keys, "p_partkey", bits, hashes), bits, hashes)
    found = F.count_if("maybe")
    # every member is found; of the others, few are
    return out.groupBy("member").agg(F.count("*").alias("n"), found.alias("f")).select("member", "n", F.when(F.col("member"), F.col("f") == F.col("n")).otherwise(F.col("f") <= 0.03 * F.col("n") + 3).alias("as_promised"))


@query("ag22_summing_merge", "SELECT user_id % 10 AS site, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy((F.col("user_id") % 10).alias("site"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("ag23_replacing_merge", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(t):
    from lakeloom.operators.relational import latest_by_key

    return latest_by_key(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("ag25_collapsing_merge", "WITH x AS (SELECT user_id, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS sign, value FROM events) SELECT user_id, round(sum(value * sign), 4) AS value FROM x GROUP BY 1 HAVING sum(sign) > 0")
def _(t):
    x = t.events.select("user_id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("sign"), "value")
    return ag.collapse(x, ["user_id"], "sign", ["value"]).withColumn("value", F.round("value", 4))


@query("ag26_hourly_rollup", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS high FROM events GROUP BY 1, 2")
def _(t):
    return ag.rollup_state(t.events, [text_time(F.date_trunc("hour", "ts")).alias("hour"), "event_type"], "value").select("hour", "event_type", "n", F.round("total", 4).alias("total"), "high")


@query("ag27_grain_ladder", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 3) AS total, max(value) AS high FROM events GROUP BY 1")
def _(t):
    minute = ag.rollup_state(t.events, [F.date_trunc("minute", "ts").alias("b"), "user_id"], "value")
    hour = ag.merge_state(minute, [F.date_trunc("hour", "b").alias("b")])
    day = ag.merge_state(hour, [F.date_format("b", "yyyy-MM-dd").alias("day")])
    return day.select("day", "n", F.round("total", 3).alias("total"), "high")


@query("ag28_summed_deltas", f"{ctes('like_events')} SELECT item, CAST(greatest(0, sum(CASE WHEN action = 'like' THEN 1 ELSE -1 END)) AS BIGINT) AS n FROM like_events GROUP BY 1")
def _(t):
    x = tb.like_events(t)
    return ag.summed_deltas(x.unionByName(x.filter("event_id % 5 = 0")), ["item"], "action", "event_id")


@query("ag29_last_action_wins", f"{ctes('like_events')}, l AS (SELECT item, user_id, action, row_number() OVER (PARTITION BY item, user_id ORDER BY ts DESC, event_id DESC) AS r FROM like_events) SELECT item, CAST(sum(CASE WHEN action = 'like' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM l WHERE r = 1 GROUP BY 1")
def _(t):
    return ag.net_counts(tb.like_events(t), ["item"], "user_id", "ts", "action", "event_id")


@query("ag30_sharded_counter", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return ag.salted_count(t.lineitem, ["l_returnflag"], ["l_orderkey", "l_linenumber"])


@query("ag30_split_evenly", "SELECT p_partkey, CAST(list_sum(list_transform(range(16), lambda i: p_partkey // 16 + CASE WHEN i < p_partkey % 16 THEN 1 ELSE 0 END)) AS BIGINT) AS total, CAST(p_partkey // 16 + CASE WHEN p_partkey % 16 > 0 THEN 1 ELSE 0 END AS BIGINT) AS first FROM part")
def _(t):
    x = t.part.select("p_partkey", ag.split_evenly("p_partkey", 16).alias("s"))
    return x.select("p_partkey", F.aggregate("s", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.get("s", F.lit(0)).alias("first"))


@query("ag31_hot_items", f"{ctes('gpu')} SELECT host, CAST(s // 600 * 600 AS BIGINT) AS start, count(*) AS n FROM gpu GROUP BY 1, 2 HAVING count(*) >= 3")
def _(t):
    return ag.hot_keys(tb.gpu_metrics(t), "host", "ts", 600, 3)


@query("ag32_counter_drift", "WITH x AS (SELECT l_suppkey AS k, count(*) AS truth, count(*) + l_suppkey % 20 - 5 AS cached FROM lineitem GROUP BY 1) SELECT k, cached, truth FROM x WHERE abs(cached - truth) > 0.01 * greatest(truth, 1)")
def _(t):
    truth = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    return ag.drifted(truth.withColumn("n", F.col("n") + F.col("k") % 20 - 5), truth, "k").select("k", "cached", "truth")


@query("ag33_affinity", "SELECT user_id, round(least(sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 2 ELSE 1 END) / 100.0, 1), 6) AS affinity FROM events GROUP BY 1")
def _(t):
    w = F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "click", 2).otherwise(1)
    return t.events.groupBy("user_id").agg(F.round(F.least(F.sum(w) / 100.0, F.lit(1.0)), 6).alias("affinity"))


@query("ag34_variation_class", "SELECT user_id, CASE WHEN stddev_pop(value) / avg(value) < 0.1 THEN 'steady' WHEN stddev_pop(value) / avg(value) > 1 THEN 'bursty' ELSE 'hybrid' END AS kind FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(ag.variation_class(F.avg("value"), F.stddev_pop("value")).alias("kind"))


@query("ag35_straggler_ratio", f"{ctes('gpu')}, d AS (SELECT cluster, device, avg(value) AS m FROM gpu GROUP BY 1, 2) SELECT cluster, round(max(m) / quantile_cont(m, 0.5), 6) AS ratio, max(m) / quantile_cont(m, 0.5) > 1.10 AS straggling FROM d GROUP BY 1")
def _(t):
    d = tb.gpu_metrics(t).groupBy("cluster", "device").agg(F.avg("value").alias("m"))
    r = F.max("m") / F.expr("percentile(m, 0.5)")
    return d.groupBy("cluster").agg(F.round(r, 6).alias("ratio"), (r > 1.10).alias("straggling"))


@query("ag36_trend", "WITH d AS (SELECT user_id % 16 AS host, CAST(day(ts) AS INTEGER) AS d, max(value) AS peak FROM events GROUP BY 1, 2) SELECT host, round(regr_slope(peak, d), 6) AS slope, round(regr_intercept(peak, d), 5) AS base FROM d GROUP BY 1")
def _(t):
    d = t.events.groupBy((F.col("user_id") % 16).alias("host"), F.dayofmonth("ts").alias("d")).agg(F.max("value").alias("peak"))
    return d.groupBy("host").agg(F.round(F.regr_slope("peak", "d"), 6).alias("slope"), F.round(F.regr_intercept("peak", "d"), 5).alias("base"))


@query("ag37_dedup_samples", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, date_trunc('hour', ts), event_type FROM events)")
def _(t):
    return t.events.select("user_id", F.date_trunc("hour", "ts").alias("h"), "event_type").dropDuplicates(["user_id", "h", "event_type"]).agg(F.count("*").alias("n"))


@query("ag38_bitmap_counts", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def _(t):
    return ag.exact_bitmap_count(t.events, ["event_type"], "user_id")


