"""Domain tables derived from the fixture tables: tweets, social graph, counters, telemetry, roles.

Everything is integer arithmetic on keys, so that any engine derives the same rows. ``SQL`` has
the same tables as common table expressions for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"


def epoch(ts: str = "ts") -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def text_time(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def tweets(t) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("user_id"), F.col("lang").alias("language"), F.expr(f"timestampadd(MINUTE, cast(doc_id as int), TIMESTAMP_NTZ '{ORIGIN}')").alias("created_at"),
        F.expr("doc_id * 7919 % 1000").alias("likes"), F.expr("doc_id * 104729 % 500").alias("retweets"), F.expr("doc_id * 1299709 % 10000").alias("views"), F.expr("array('#' || upper(lang), '#' || source, '#t' || cast(doc_id % 17 as string))").alias("hashtags"),
    )


def gpu_metrics(t) -> DataFrame:
    return t.events.select("event_id", "ts", F.col("user_id").alias("device"), (F.col("user_id") % 16).alias("host"), (F.col("user_id") % 3).alias("cluster"), F.col("event_type").alias("metric"), "value")


def posts(t) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("created_at"), F.expr("o_orderkey * 7919 % 1000").alias("likes"), F.expr("o_orderkey * 104729 % 300").alias("comments"))


def follows(t) -> DataFrame:
    n = t.customer.agg(F.count("*").alias("n"))
    return t.orders.join(F.broadcast(n)).select(F.col("o_custkey").alias("follower"), (F.col("o_orderkey") % F.col("n") + 1).alias("followee")).filter("follower <> followee").distinct()


def likes(t) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("post_id")).distinct()


def like_events(t) -> DataFrame:
    return t.events.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("item"), F.when(F.col("event_type").isin("click", "view"), "like").otherwise("unlike").alias("action"))


def roles(t) -> DataFrame:
    """child, parent edges of customer, nation and region roles."""
    low = t.customer.selectExpr("'c' || cast(c_custkey as string) as child", "'n' || cast(c_nationkey as string) as parent")
    return low.union(t.nation.selectExpr("'n' || cast(n_nationkey as string)", "'r' || cast(n_regionkey as string)"))


SQL = {
    "tweets": f"""tweets AS (SELECT doc_id AS id, text, source AS user_id, lang AS language, TIMESTAMP '{ORIGIN}' + to_minutes(CAST(doc_id AS INT)) AS created_at, doc_id * 7919 % 1000 AS likes,
        doc_id * 104729 % 500 AS retweets, doc_id * 1299709 % 10000 AS views, ['#' || upper(lang), '#' || source, '#t' || CAST(doc_id % 17 AS VARCHAR)] AS hashtags FROM documents)""",
    "gpu": "gpu AS (SELECT event_id, ts, user_id AS device, user_id % 16 AS host, user_id % 3 AS cluster, event_type AS metric, value, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)",
    "posts": "posts AS (SELECT o_orderkey AS post_id, o_custkey AS author, o_orderdate AS created_at, o_orderkey * 7919 % 1000 AS likes, o_orderkey * 104729 % 300 AS comments FROM orders)",
    "follows": "follows AS (SELECT DISTINCT o_custkey AS follower, o_orderkey % (SELECT count(*) FROM customer) + 1 AS followee FROM orders WHERE o_custkey <> o_orderkey % (SELECT count(*) FROM customer) + 1)",
    "likes": "likes AS (SELECT DISTINCT l_suppkey AS user_id, l_orderkey AS post_id FROM lineitem)",
    "like_events": "like_events AS (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, CASE WHEN event_type IN ('click', 'view') THEN 'like' ELSE 'unlike' END AS action FROM events)",
    "roles": "roles AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
