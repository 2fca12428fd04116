"""Queries of sources, sinks, versioned tables and the remaining jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import aggregates as ag
from lakeloom.operators import series
from lakeloom.operators import vectors as vs
from lakeloom.plans.registry import query
from lakeloom.sources import formats as ff
from lakeloom.sources import tables as tb
from lakeloom.sources import versioned as vt
from lakeloom.sources.tables import ctes, text_time

_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("sc17_partitioned_parquet", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey IN (3, 4) GROUP BY 1")
def _(t):
    path = ff.work_dir(t.spark)
    ff.write_files(t.customer, path, by=["c_nationkey"], sort=["c_custkey"])
    return ff.read_files(t.spark, path).filter("c_nationkey in (3, 4)").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("sc18_csv_table", _CUSTOMERS)
def _(t):
    path = ff.work_dir(t.spark)
    ff.write_files(t.customer, path, "csv", header="true")
    return ff.read_files(t.spark, path, "csv", t.customer.schema, header="true")


@query("sc19_frame_as_table", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(t):
    ff.from_memory(t.spark, t.nation.toArrow(), "nation_in_memory")
    return t.spark.sql("SELECT n_regionkey, count(*) AS n FROM nation_in_memory GROUP BY n_regionkey")


@query("sc20_orc_table", _CUSTOMERS)
def _(t):
    path = ff.work_dir(t.spark)
    ff.write_files(t.customer, path, "orc")
    return ff.read_files(t.spark, path, "orc")


@query("sc20_json_table", _CUSTOMERS)
def _(t):
    path = ff.work_dir(t.spark)
    ff.write_files(t.customer, path, "json")
    return ff.read_files(t.spark, path, "json", t.customer.schema)


@query("sc20_added_column", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS extra FROM nation")
def _(t):
    path = ff.work_dir(t.spark)
    t.nation.filter("n_nationkey % 2 = 1").select("n_nationkey").write.parquet(f"{path}/a")
    t.nation.filter("n_nationkey % 2 = 0").select("n_nationkey", F.col("n_name").alias("extra")).write.parquet(f"{path}/b")
    return ff.read_files(t.spark, [f"{path}/a", f"{path}/b"], merge=True)


def _versioned(t):
    root = ff.work_dir(t.spark)
    vt.VersionedTable(t.spark, root).commit(t.nation.filter("n_regionkey < 2"), 10)
    vt.VersionedTable(t.spark, root).commit(t.nation.filter("n_regionkey < 4"), 20)
    return vt.VersionedTable(t.spark, root)  # the log is on disk


@query("sc21_snapshot_by_time", "SELECT n_nationkey FROM nation WHERE n_regionkey < 2")
def _(t):
    return _versioned(t).read(at=19).select("n_nationkey")


@query("dm15b_clone_and_undrop", "SELECT (SELECT count(*) FROM nation WHERE n_regionkey < 4) AS original, (SELECT count(*) FROM nation WHERE n_regionkey < 1) AS cloned")
def _(t):
    table = _versioned(t)
    clone = table.clone(ff.work_dir(t.spark))
    clone.commit(t.nation.filter("n_regionkey < 1"), 30)
    table.drop()
    table.undrop()
    return table.read().agg(F.count("*").alias("original")).join(F.broadcast(clone.read().agg(F.count("*").alias("cloned"))))


@query("sc26b_change_rows", "SELECT CASE WHEN n_regionkey = 0 THEN 'delete' WHEN n_regionkey = 1 THEN 'update' ELSE 'insert' END AS op, n_nationkey FROM nation WHERE n_regionkey < 3")
def _(t):
    before = t.nation.filter("n_regionkey in (0, 1, 4)")
    after = t.nation.filter("n_regionkey in (1, 2, 4)").withColumn("n_name", F.when(F.col("n_regionkey") == 1, F.lower("n_name")).otherwise(F.col("n_name")))
    return vt.change_rows(before, after, ["n_nationkey"]).select("op", "n_nationkey")


def _orders_table(t):
    """Orders in three versions: those outside every fourth key; new and changed ones merged; every fifth key deleted."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    root = ff.work_dir(t.spark)
    orders = t.orders.select(*columns)
    vt.VersionedTable(t.spark, root, keys=["o_orderkey"], buckets=8).append(orders.filter("o_orderkey % 4 <> 0"), 10)
    fresh = orders.filter("o_orderkey % 4 < 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 1, "X").otherwise(F.col("o_orderstatus")))
    vt.VersionedTable(t.spark, root).merge(fresh, at=20)
    vt.VersionedTable(t.spark, root).merge(orders.filter("o_orderkey % 5 = 0"), delete="true", at=30)
    return vt.VersionedTable(t.spark, root)


_V = """v AS (SELECT 1 AS version, o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT 2, o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 1 THEN 'X' ELSE o_orderstatus END FROM orders
UNION ALL SELECT 3, o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 1 THEN 'X' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 5 <> 0)"""


@query("sc21_versions_of_orders", f"WITH {_V} SELECT version, o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS customers FROM v GROUP BY 1, 2")
def _(t):
    table = _orders_table(t)
    each = [table.read(n).select(F.lit(n).alias("version"), "o_orderstatus", "o_custkey") for n in (1, 2)] + [table.read(at=99).select(F.lit(3).alias("version"), "o_orderstatus", "o_custkey")]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("version", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))


@query("sc26_change_feed", f"""WITH {_V}, c AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CAST(coalesce(b.version, a.version + 1) AS BIGINT) AS version, a.o_orderstatus AS was, b.o_orderstatus AS later, a.o_orderkey IS NULL AS created, b.o_orderkey IS NULL AS gone
FROM v a FULL JOIN v b ON a.o_orderkey = b.o_orderkey AND b.version = a.version + 1 WHERE coalesce(b.version, a.version + 1) IN (2, 3))
SELECT version, CASE WHEN created THEN 'insert' WHEN gone THEN 'delete' ELSE 'update' END AS op, o_orderkey, was, later FROM c WHERE created OR gone OR was <> later""")
def _(t):
    table = _orders_table(t)
    vt.ChangeFeed(table, "copy").confirm(1)
    rows, _ = vt.ChangeFeed(vt.VersionedTable(t.spark, table.root), "copy").poll()  # another reader goes on after version 1
    return rows.select("version", "op", F.coalesce("after.o_orderkey", "before.o_orderkey").alias("o_orderkey"), F.col("before.o_orderstatus").alias("was"), F.col("after.o_orderstatus").alias("later"))


@query("dm16_audit_log", "SELECT r_regionkey AS id, 'read' AS action FROM region UNION ALL SELECT n_nationkey, 'write' FROM nation")
def _(t):
    from lakeloom.operators.relational import insert_rows

    return insert_rows(t.region.select(F.col("r_regionkey").alias("id"), F.lit("read").alias("action")), t.nation.select(F.col("n_nationkey").alias("id"), F.lit("write").alias("action")))


@query("st4_late_rows_counted", "WITH x AS (SELECT ts, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) SELECT count(*) AS n, count(*) FILTER (ts < seen - INTERVAL 1 DAY) AS late FROM x")
def _(t):
    # arrival order is the event id here
    x = series.running_max_before(t.events.select("event_id", "ts"), "event_id", "ts", "seen")
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("seen") - F.expr("INTERVAL 1 DAY")).alias("late"))


@query("st14b_trending_by_region", f"{ctes('tweets')}, n AS (SELECT language AS region, lower(tag) AS tag, count(*) AS n FROM (SELECT language, unnest(hashtags) AS tag FROM tweets) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, tag) AS rank FROM n) SELECT region, tag, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def _(t):
    n = tb.tweets(t).select(F.col("language").alias("region"), F.explode(F.transform("hashtags", F.lower)).alias("tag")).groupBy("region", "tag").agg(F.count("*").alias("n"))
    return ag.top_per_group(n, ["region"], [F.col("n").desc(), F.col("tag")], 5)


@query("st5_rollups_by_device_and_host", "SELECT user_id AS device, user_id % 16 AS host, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM events GROUP BY GROUPING SETS ((user_id, date_trunc('hour', ts)), (user_id % 16, date_trunc('hour', ts)))")
def _(t):
    x = t.events.select(F.col("user_id").alias("device"), (F.col("user_id") % 16).alias("host"), text_time(F.date_trunc("hour", "ts")).alias("hour"))
    return x.groupingSets([["device", "hour"], ["host", "hour"]], "device", "host", "hour").agg(F.count("*").alias("n"))


@query("vs8_rotated_codes")
def _(t):
    turned = vs.rotate(t.embeddings, vs.principal_rotation(t.embeddings))
    pq = vs.ProductQuantizer(32, 64).fit(turned)
    return pq.search(t.spark, turned.filter("vec_id % 50 = 0"), pq.encode(turned), 50)
