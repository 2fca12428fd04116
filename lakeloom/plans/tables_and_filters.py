"""Queries of scans, table changes, predicates and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import text as tx
from lakeloom.operators import paging, relational as rel
from lakeloom.plans.registry import query
from lakeloom.sources import tables as tb
from lakeloom.sources.tables import ctes


@query("sc1_sequential_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    return t.customer.select("c_custkey", "c_name", "c_acctbal")


@query("sc2_point_lookup", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey = 7")
def _(t):
    return rel.point_lookup(t.orders, "o_custkey", 7).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("sc6_range_scan", "SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 5 AND 60 ORDER BY p_partkey")
def _(t):
    return rel.range_scan(t.part, "p_partkey", 5, 60).select("p_partkey", "p_name")


_VERSIONS = "v AS (SELECT user_id AS key, event_id AS seq, value, event_type = 'error' AS gone FROM events)"


def _versions(t):
    return t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("gone"))


@query("sc10_latest_version_wins", f"WITH {_VERSIONS} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM v) WHERE r = 1 AND NOT gone")
def _(t):
    return rel.latest_by_key(_versions(t), ["key"], "seq", "gone").select("key", "seq", "value")


@query("sc11_compaction", f"WITH {_VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM v) SELECT count(*) AS runs_rows, (SELECT count(*) FROM r WHERE n = 1 AND NOT gone) AS kept_rows FROM v")
def _(t):
    v = _versions(t)
    kept = rel.latest_by_key(v, ["key"], "seq", "gone").agg(F.count("*").alias("kept_rows"))
    return v.agg(F.count("*").alias("runs_rows")).join(F.broadcast(kept))


@query("sc12_merge_operands", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, max(value) AS high FROM events GROUP BY user_id")
def _(t):
    return rel.merge_operands(t.events, "user_id", clicks=F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)), high=F.max("value"))


@query("sc13_or_of_predicates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49 OR l_discount >= 0.1 AND l_tax < 0.02")
def _(t):
    return t.lineitem.filter((F.col("l_quantity") > 49) | ((F.col("l_discount") >= 0.1) & (F.col("l_tax") < 0.02))).select("l_orderkey", "l_linenumber")


@query("sc14_bernoulli_sample")
def _(t):
    return rel.hash_sample(t.orders, ["o_orderkey"], 10).select("o_orderkey")


@query("sc15_block_sample")
def _(t):
    return rel.block_sample(t.orders, 20, 100, "o_orderkey").select("o_orderkey")


@query("sc16_exact_sample", "SELECT o_orderkey FROM orders ORDER BY md5('0|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def _(t):
    return rel.exact_sample(t.orders, ["o_orderkey"], 100).select("o_orderkey")


@query("sc28_generated_rows", "SELECT i AS id, i * 7919 % 1000 AS likes, 'user' || (i % 5) AS name FROM range(1000) r(i)")
def _(t):
    return t.spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("likes"), F.concat(F.lit("user"), (F.col("id") % 5).cast("string")).alias("name"))


# changes -------------------------------------------------------------------------------------
@query("dm2_insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'NOWHERE'")
def _(t):
    return rel.insert_rows(t.region, t.spark.createDataFrame([(9, "NOWHERE")], "r_regionkey int, r_name string"))


@query("dm3_delete", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 0 AND c_mktsegment = 'BUILDING', FALSE)")
def _(t):
    return rel.delete_where(t.customer, (F.col("c_acctbal") < 0) & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_acctbal")


@query("dm4_update", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'CLOSED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    return rel.update_where(t.customer, F.col("c_nationkey") == 3, c_acctbal=0.0, c_mktsegment="CLOSED").select("c_custkey", "c_acctbal", "c_mktsegment")


_LOG = "log AS (SELECT user_id AS txn_id, CASE WHEN event_type = 'signup' THEN 'BEGIN' WHEN event_type = 'purchase' AND user_id % 3 <> 0 THEN 'COMMIT' ELSE 'INSERT' END AS type FROM events)"


def _log(t):
    kind = F.when(F.col("event_type") == "signup", "BEGIN").when((F.col("event_type") == "purchase") & (F.col("user_id") % 3 != 0), "COMMIT").otherwise("INSERT")
    return t.events.select(F.col("user_id").alias("txn_id"), kind.alias("type"))


@query("dm7_log_recovery", f"WITH {_LOG} SELECT txn_id, CASE WHEN bool_or(type = 'BEGIN') AND bool_or(type = 'COMMIT') THEN 'committed' ELSE 'aborted' END AS status FROM log GROUP BY txn_id")
def _(t):
    return rel.transaction_status(_log(t))


@query("dm6_visible_rows", f"""WITH {_LOG}, st AS (SELECT txn_id, bool_or(type = 'BEGIN') AND bool_or(type = 'COMMIT') AS done FROM log GROUP BY txn_id),
v AS (SELECT o_orderkey AS id, o_orderkey % 150 AS xmin, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 97 END AS xmax FROM orders)
SELECT id FROM v WHERE (coalesce((SELECT done FROM st WHERE txn_id = xmin), FALSE) OR xmin = 42) AND NOT (xmax IS NOT NULL AND (coalesce((SELECT done FROM st WHERE txn_id = xmax), FALSE) OR xmax = 42))""")
def _(t):
    v = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 150).alias("xmin"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 97).alias("xmax"))
    return rel.visible_rows(v, rel.transaction_status(_log(t)), 42).select("id")


@query("dm8_upsert_counts", f"""{ctes("like_events")}, base AS (SELECT p_partkey AS item, p_size AS n FROM part),
d AS (SELECT item, sum(CASE WHEN action = 'like' THEN 1 ELSE -1 END) AS d FROM like_events GROUP BY item)
SELECT coalesce(base.item, d.item) AS item, CAST(greatest(0, coalesce(n, 0) + coalesce(d, 0)) AS BIGINT) AS n FROM base FULL JOIN d ON base.item = d.item""")
def _(t):
    base = t.part.select(F.col("p_partkey").alias("item"), F.col("p_size").cast("long").alias("n"))
    deltas = tb.like_events(t).select("item", F.when(F.col("action") == "like", 1).otherwise(-1).cast("long").alias("n"))
    return rel.upsert_counts(base, deltas, ["item"])


@query("dm9_insert_if_absent", "SELECT c_custkey AS user_id FROM customer UNION SELECT s_suppkey + 1000 FROM supplier")
def _(t):
    return rel.insert_if_absent(t.customer.select(F.col("c_custkey").alias("user_id")), t.supplier.select((F.col("s_suppkey") + 1000).alias("user_id")), ["user_id"])


@query("dm10_floored_decrement", "SELECT p_partkey, CAST(greatest(p_size - 3, 0) AS INTEGER) AS n FROM part")
def _(t):
    return t.part.select("p_partkey", F.greatest(F.col("p_size") - 3, F.lit(0)).alias("n"))


@query("dm11_maintained_counts", f"{ctes('follows')} SELECT followee AS user_id, count(*) AS followers, count(*) >= 10 AS is_celebrity FROM follows GROUP BY followee")
def _(t):
    return tb.follows(t).groupBy(F.col("followee").alias("user_id")).agg(F.count("*").alias("followers")).withColumn("is_celebrity", F.col("followers") >= 10)


@query("dm12_purge_deleted", """WITH x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN ts END AS deleted_at FROM events), m AS (SELECT max(ts) AS now FROM events)
SELECT event_id FROM x, m WHERE NOT coalesce(deleted_at < now - INTERVAL 24 HOUR, FALSE)""")
def _(t):
    x = t.events.select("event_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted_at"))
    x = x.join(F.broadcast(t.events.agg(F.max("ts").alias("now"))))
    return rel.purge_deleted(x, F.col("now"), "deleted_at").select("event_id")


@query("dm13_flush_buffered_views", f"{ctes('tweets')} SELECT id, CAST(views + coalesce((SELECT sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FROM events WHERE user_id = id), 0) AS BIGINT) AS views FROM tweets")
def _(t):
    buffered = t.events.groupBy(F.col("user_id").alias("id")).agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("d"))
    return tb.tweets(t).join(buffered, "id", "left").select("id", (F.col("views") + F.coalesce("d", F.lit(0))).alias("views"))


_HISTORY = "h AS (SELECT user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, value, event_id FROM events)"


def _history(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"), "value")


@query("dm14_current_dimension", f"WITH {_HISTORY} SELECT user_id, value, valid_to IS NULL AS is_current FROM h WHERE valid_to IS NULL")
def _(t):
    return _history(t).withColumn("is_current", F.col("valid_to").isNull()).filter("is_current").select("user_id", "value", "is_current")


@query("dm15_time_travel", f"WITH {_HISTORY} SELECT user_id, event_id, value FROM h WHERE valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15 00:00:00' < valid_to)")
def _(t):
    return rel.as_of(_history(t), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("user_id", "event_id", "value")


# predicates ----------------------------------------------------------------------------------
@query("pf2_comparison_filters", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND o_orderpriority != '1-URGENT'")
def _(t):
    return t.orders.filter((F.col("o_totalprice") >= 100000) & (F.col("o_orderstatus") != "F") & (F.col("o_orderpriority") != "1-URGENT")).select("o_orderkey")


@query("pf4_optional_filter", f"{ctes('tweets')} SELECT id FROM tweets WHERE language = 'fr'")
def _(t):
    return tb.tweets(t).filter(rel.optional("language", "fr") & rel.optional("user_id", None)).select("id")


@query("pf5_time_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
def _(t):
    return t.events.filter("ts between TIMESTAMP_NTZ '2024-01-08 00:00:00' and TIMESTAMP_NTZ '2024-01-15 00:00:00'").select("event_id")


@query("pf6_in_list", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 5, 9, 99)")
def _(t):
    return t.nation.filter(F.col("n_nationkey").isin(1, 5, 9, 99)).select("n_name")


@query("pf7_any_of_array", f"{ctes('tweets')} SELECT id FROM tweets WHERE list_contains(hashtags, '#t3')")
def _(t):
    return tb.tweets(t).filter(F.array_contains("hashtags", "#t3")).select("id")


@query("pf8_batch_lookup", "WITH q AS (SELECT i * 37 AS item FROM range(100) r(i)), c AS (SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1) SELECT q.item, CAST(coalesce(n, 0) AS BIGINT) AS n FROM q LEFT JOIN c USING (item)")
def _(t):
    q = t.spark.range(100).select((F.col("id") * 37).alias("item"))
    return rel.batch_lookup(q, t.lineitem.groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("n")), ["item"], {"n": 0})


@query("pf9_ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE '%steel%' OR p_name ILIKE '%1'")
def _(t):
    return t.part.filter(F.col("p_type").ilike("%steel%") | F.col("p_name").ilike("%1")).select("p_partkey")


_PATHS = "p AS (SELECT c_custkey AS id, '/' || r_regionkey || '/' || n_nationkey || '/' || c_custkey || '/' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT -n_nationkey - 1, '/' || n_regionkey || '/' || n_nationkey || '/' FROM nation)"


def _paths(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat(F.lit("/"), F.concat_ws("/", "r_regionkey", "n_nationkey", "c_custkey"), F.lit("/")).alias("path"))
    return c.unionByName(t.nation.select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.concat(F.lit("/"), F.concat_ws("/", "n_regionkey", "n_nationkey"), F.lit("/")).alias("path")))


@query("pf10_path_descendants", f"WITH {_PATHS} SELECT id, path FROM p WHERE path LIKE '/1/%'")
def _(t):
    return rel.path_descendants(_paths(t), "path", "/1/")


@query("pf10_path_ancestors", f"WITH {_PATHS}, me AS (SELECT path AS of FROM p WHERE id = 10) SELECT p.id FROM p, me WHERE starts_with(of, path)")
def _(t):
    p = _paths(t)
    me = p.filter("id = 10").select(F.col("path").alias("of"))
    return p.join(F.broadcast(me), F.col("of").startswith(F.col("path"))).select("id")


@query("pf11_between_nested_set", "SELECT a.n_nationkey, count(*) AS inside FROM nation a JOIN nation b ON b.n_nationkey BETWEEN a.n_nationkey AND a.n_nationkey + 4 GROUP BY 1")
def _(t):
    a, b = t.nation.select("n_nationkey"), t.nation.select(F.col("n_nationkey").alias("b"))
    return a.join(F.broadcast(b), F.col("b").between(F.col("n_nationkey"), F.col("n_nationkey") + 4)).groupBy("n_nationkey").agg(F.count("*").alias("inside"))


@query("pf12_null_semantics", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s FROM orders) SELECT count(*) AS n, count(s) AS known, count(*) FILTER (s <> 'F') AS differs, count(*) FILTER (s IS DISTINCT FROM 'F') AS is_distinct, count(*) FILTER (s IS NULL) AS nulls FROM x")
def _(t):
    s = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    x = t.orders.select(s.alias("s"))
    return x.agg(F.count("*").alias("n"), F.count("s").alias("known"), F.count_if(F.col("s") != "F").alias("differs"), F.count_if(~F.col("s").eqNullSafe("F")).alias("is_distinct"), F.count_if(F.col("s").isNull()).alias("nulls"))


@query("pf13_case", "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.when(F.col("l_quantity") < 10, "low").when(F.col("l_quantity") < 30, "mid").otherwise("high").alias("band")).agg(F.count("*").alias("n"))


_TERMS = r"ix AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')) AS term FROM documents WHERE text IS NOT NULL)"


@query("pf14_all_terms", f"WITH {_TERMS} SELECT doc_id FROM ix WHERE term IN ('the', 'of', 'and') GROUP BY doc_id HAVING count(*) = 3")
def _(t):
    return tx.match_all(tx.inverted_index(t.documents, "doc_id", {"text": "A"}), "doc_id", ["the", "of", "and"]).select("doc_id")


@query("pf15_any_term", f"WITH {_TERMS} SELECT DISTINCT doc_id FROM ix WHERE term IN ('zu', 'der')")
def _(t):
    return tx.match_any(tx.inverted_index(t.documents, "doc_id", {"text": "A"}), "doc_id", ["zu", "der"])


@query("pf16_must_and_filter", f"WITH {_TERMS} SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 1000 AND doc_id IN (SELECT doc_id FROM ix WHERE term = 'of')")
def _(t):
    hits = tx.match_all(tx.inverted_index(t.documents, "doc_id", {"text": "A"}), "doc_id", ["of"])
    return t.documents.filter("lang = 'en' and n_chars > 1000").join(hits, "doc_id", "left_semi").select("doc_id")


@query("pf17_json_text", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.filter(k > 50).select("event_id", k.alias("k"))


@query("pf18_label_regex", "SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(event_type, '^(c|p).*') GROUP BY 1")
def _(t):
    return t.events.filter(F.col("event_type").rlike("^(c|p).*")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("pf19_bitmask", "SELECT event_id FROM events WHERE (user_id & 64) > 0")
def _(t):
    return t.events.filter(rel.has_bits("user_id", 64)).select("event_id")


@query("pf20_range_overlap", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00' AND ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-02 00:00:00'")
def _(t):
    x = t.events.withColumns({"e": F.expr("ts + INTERVAL 1 HOUR"), "lo": F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'"), "hi": F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'")})
    return x.filter(rel.overlaps("ts", "e", "lo", "hi")).select("event_id")


@query("pf20_geo_radius", """WITH g AS (SELECT c_custkey, (c_custkey * 37 % 180) - 90.0 AS lat, (c_custkey * 91 % 360) - 180.0 AS lon FROM customer)
SELECT c_custkey FROM g WHERE 12742.0 * asin(sqrt(pow(sin(radians(48.9 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.9)) * pow(sin(radians(2.4 - lon) / 2), 2))) < 2500""")
def _(t):
    g = t.customer.select("c_custkey", (F.col("c_custkey") * 37 % 180 - 90.0).alias("lat"), (F.col("c_custkey") * 91 % 360 - 180.0).alias("lon"))
    return g.filter(rel.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.9), F.lit(2.4)) < 2500).select("c_custkey")


@query("pf21_json_containment", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(t):
    return t.events.filter(rel.json_contains("props", {"k": "7"})).select("event_id")


# set operations ------------------------------------------------------------------------------
@query("so1_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("so2_union_all", "SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")))


@query("so3_union_in_order", "WITH a AS (SELECT o_custkey AS id, min(o_orderkey) AS position, 0 AS part FROM orders GROUP BY 1), b AS (SELECT c_custkey, c_custkey, 1 FROM customer), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, part, position AS at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, position) AS r FROM u) WHERE r = 1")
def _(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("position"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("position"))
    return paging.union_in_order([a, b], "id")


@query("so4_all_and_any_of_sets", "WITH h AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(DISTINCT event_type) AS have FROM events GROUP BY 1, 2) SELECT user_id, day, list_has_all(have, ['click', 'view']) AS has_all, list_has_any(have, ['signup', 'error']) AS has_any, list_has_all(have, []::VARCHAR[]) AS has_none FROM h")
def _(t):
    h = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set("event_type").alias("have"))
    every = lambda *w: F.size(F.array_except(F.array(*map(F.lit, w)).cast("array<string>"), "have")) == 0
    return h.select("user_id", "day", every("click", "view").alias("has_all"), F.arrays_overlap("have", F.array(F.lit("signup"), F.lit("error"))).alias("has_any"), every().alias("has_none"))


@query("so5_difference", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'signup' EXCEPT SELECT user_id, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'purchase'")
def _(t):
    days = lambda kind: t.events.filter(F.col("event_type") == kind).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days("signup").subtract(days("purchase"))


@query("so6_max_merge", f"""{ctes("tweets")}, tags AS (SELECT unnest(hashtags) AS tag FROM tweets), a AS (SELECT tag AS term, count(*) AS score FROM tags GROUP BY 1), b AS (SELECT '#' || source AS term, count(*) AS score FROM documents GROUP BY 1)
SELECT term, max(score) AS score FROM (SELECT term, score * 1.0 AS score FROM a UNION ALL SELECT term, score * 0.7 FROM b) GROUP BY term""")
def _(t):
    a = tb.tweets(t).select(F.explode("hashtags").alias("term")).groupBy("term").agg(F.count("*").alias("score"))
    b = t.documents.groupBy(F.concat(F.lit("#"), "source").alias("term")).agg(F.count("*").alias("score"))
    return paging.max_merge([(a, 1.0), (b, 0.7)], "term", "score")


# order and pages -----------------------------------------------------------------------------
@query("sl1_multi_key_order", "SELECT p_brand, p_partkey, p_size FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 40")
def _(t):
    return t.part.select("p_brand", "p_partkey", "p_size").orderBy(F.col("p_size").desc(), "p_brand", "p_partkey").limit(40)


@query("sl2_page_with_total", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return paging.page(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 40).select("o_orderkey", "total")


@query("sl2_page_past_the_end", "SELECT count(*) AS total, 0 AS rows_here FROM orders")
def _(t):
    past = paging.page(t.orders.select("o_orderkey"), [F.col("o_orderkey")], 20, 10**9).agg(F.count("*").cast("int").alias("rows_here"))
    return paging.total(t.orders).join(F.broadcast(past))


@query("sl3_keyset_page", """WITH x AS (SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' OR (ts = TIMESTAMP '2024-01-20 00:00:00' AND event_id < 500)), p AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS position FROM x)
SELECT event_id, CAST(position AS INTEGER) AS position, (SELECT count(*) FROM p) > 25 AS has_more FROM p WHERE position <= 25""")
def _(t):
    p = paging.before_cursor(t.events.select("event_id", "ts"), "ts", "event_id", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), 500)
    return paging.with_more(paging.keyset_page(p, "ts", "event_id", 25), "ts", "event_id", 25).select("event_id", "position", "has_more")


@query("sl4_top_n", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(10)


@query("sl7_topk_series", "SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 5")
def _(t):
    return t.events.groupBy("user_id").agg(F.sum("value").alias("s")).orderBy(F.col("s").desc(), "user_id").limit(5).select("user_id", F.round("s", 4).alias("total"))


@query("fn_string_functions", "SELECT n_nationkey, lower(trim(n_name)) AS low, substr(n_name, 1, 3) AS pre, n_name || '/' || n_regionkey AS joined, md5(n_name) AS digest, to_base64(encode(n_name)) AS b64 FROM nation")
def _(t):
    return t.nation.select("n_nationkey", F.lower(F.trim("n_name")).alias("low"), F.substring("n_name", 1, 3).alias("pre"), F.concat_ws("/", "n_name", "n_regionkey").alias("joined"), F.md5("n_name").alias("digest"), F.base64(F.encode("n_name", "UTF-8")).alias("b64"))


@query("fn_date_functions", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(dayofweek(o_orderdate) AS INTEGER) AS dow, strftime(o_orderdate, '%Y%m%d') AS ymd FROM orders")
def _(t):
    d = F.col("o_orderdate")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.orders.select("o_orderkey", day(F.date_trunc("month", d)).alias("month"), day(F.date_trunc("quarter", d)).alias("quarter"), F.year(d).alias("y"), (F.dayofweek(d) - 1).alias("dow"), F.date_format(d, "yyyyMMdd").alias("ymd"))


@query("fn_math_and_null_functions", "SELECT c_custkey, round(ln(1 + abs(c_acctbal)), 6) AS l, round(sqrt(abs(c_acctbal)), 6) AS r, greatest(c_acctbal, 0) AS g, least(c_acctbal, 100) AS s, CAST(c_custkey % 7 AS BIGINT) AS m, CAST(c_custkey // 7 AS BIGINT) AS q, nullif(c_custkey % 3, 0) AS z, coalesce(nullif(c_custkey % 3, 0), -1) AS c FROM customer")
def _(t):
    x, k = F.col("c_acctbal"), F.col("c_custkey")
    z = F.nullif(k % 3, F.lit(0))
    return t.customer.select("c_custkey", F.round(F.log1p(F.abs(x)), 6).alias("l"), F.round(F.sqrt(F.abs(x)), 6).alias("r"), F.greatest(x, F.lit(0.0)).alias("g"), F.least(x, F.lit(100.0)).alias("s"), (k % 7).alias("m"), F.expr("c_custkey div 7").alias("q"), z.alias("z"), F.coalesce(z, F.lit(-1)).cast("long").alias("c"))


@query("fn_arrays_and_structs", "SELECT o_orderkey, sum(l_quantity * l_extendedprice) IS NOT NULL AS priced, CAST(count(*) AS INTEGER) AS items, round(sum(l_quantity * l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(t):
    nested = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))).alias("items"))
    nested = nested.join(t.orders.select("o_orderkey"), "o_orderkey")
    item = nested.select("o_orderkey", F.size("items").alias("n"), F.explode("items").alias("item"))
    return item.groupBy("o_orderkey").agg(F.max((F.col("item.quantity") * F.col("item.price")).isNotNull()).alias("priced"), F.first("n").alias("items"), F.round(F.sum(F.col("item.quantity") * F.col("item.price")), 2).alias("total"))


@query("fn_map_labels", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS missing FROM nation")
def _(t):
    m = F.map_from_arrays(F.array(F.lit("name"), F.lit("region")), F.array("n_name", F.col("n_regionkey").cast("string")))
    x = t.nation.select("n_nationkey", m.alias("labels"))
    return x.select("n_nationkey", F.element_at("labels", "name").alias("name"), F.element_at("labels", "region").alias("region"), F.try_element_at("labels", F.lit("no")).alias("missing"))

