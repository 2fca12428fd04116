"""The computations that a user calls: search, trends, feeds, counters, permissions, telemetry cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import text as tx
from lakeloom.functions.postings import PostingIndex
from lakeloom.operators import aggregates as ag
from lakeloom.operators import joins as jn
from lakeloom.operators import permissions as pm
from lakeloom.operators import paging
from lakeloom.plans.registry import query
from lakeloom.sources import tables as tb
from lakeloom.sources.formats import work_dir
from lakeloom.sources.tables import ctes, epoch, text_time

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
_MATCH = rf"""ix AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2),
hit AS (SELECT id, sum(ln(1 + tf)) AS rank FROM ix WHERE term IN ('the', 'of') GROUP BY id HAVING count(*) = 2),
q AS (SELECT t.*, h.rank, epoch((SELECT max(created_at) FROM tweets)) - epoch(created_at) AS age FROM tweets t JOIN hit h USING (id) WHERE created_at >= (SELECT max(created_at) FROM tweets) - INTERVAL 7 DAY)"""


def _matches(t, words=("the", "of"), days=7):
    """Tweets that hold every word, of the last days, with rank and age in seconds. Terms are counted in the scan, behind the time filter."""
    docs = tb.tweets(t)
    now = F.broadcast(docs.agg(F.max("created_at").alias("now")))
    x = docs.join(now).filter(F.col("created_at") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    for i, w in enumerate(words):
        x = x.filter(F.lower("text").contains(w)).withColumn(f"_n{i}", tx.count_term("text", w)).filter(F.col(f"_n{i}") > 0)
    rank = sum((F.lit(tx.WEIGHTS["A"]) * F.log1p(f"_n{i}") for i in range(1, len(words))), F.lit(tx.WEIGHTS["A"]) * F.log1p("_n0"))
    return x.withColumn("rank", rank).withColumn("age", epoch("now") - epoch("created_at"))


@query("bq1_ranked_search", f"""{ctes("tweets")}, {_MATCH}, s AS (SELECT id, 0.3 * rank + 0.4 / (1 + age / 21600.0) + 0.3 * (0.012 * ln(1 + likes) + 0.012 * ln(1 + retweets) + 0.006 * ln(1 + views / 1000.0)) AS score FROM q)
SELECT id, round(score, 6) AS score, (SELECT count(*) FROM s) AS total FROM s ORDER BY s.score DESC, id LIMIT 20""")
def _(t):
    s = _matches(t).withColumn("score", tx.search_score(F.col("rank"), F.col("age"))).select("id", "score")
    return paging.page(s, [F.col("score").desc(), F.col("id")], 20).select("id", F.round("score", 6).alias("score"), "total")


def _postings(t, **options):
    return PostingIndex(t.spark, work_dir(t.spark) + "/postings").build(tb.tweets(t), "id", {"text": "A"}, **options)


_PLACES = rf"p AS (SELECT doc_id AS id, unnest(w) AS term, generate_subscripts(w, 1) AS at FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL))"


@query("bq1_phrase_search", f"WITH {_PLACES} SELECT a.id, count(*) AS hits FROM p a JOIN p b ON a.id = b.id AND b.at = a.at + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
def _(t):
    return _postings(t).search(phrases=["of the"]).select(F.col("key").alias("id"), F.col("phrase_hits").alias("hits"))


_STEM = """CASE WHEN term LIKE '%ies' AND term NOT LIKE '%eies' AND term NOT LIKE '%aies' THEN term[:-4] || 'y' WHEN term LIKE '%es' AND term NOT LIKE '%aes' AND term NOT LIKE '%ees' AND term NOT LIKE '%oes' THEN term[:-2]
WHEN term LIKE '%s' AND term NOT LIKE '%us' AND term NOT LIKE '%ss' THEN term[:-2] ELSE term END"""


@query("bq1_stemmed_search", f"""WITH {_PLACES}, l AS (SELECT id, count(*) AS length FROM p GROUP BY 1), m AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(length) FROM l) / (SELECT count(*) FROM documents) AS mean),
f AS (SELECT id, {_STEM} AS term, count(*) AS tf FROM p GROUP BY 1, 2), d AS (SELECT term, count(*) AS d FROM f GROUP BY 1),
r AS (SELECT id, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS rank FROM f JOIN d USING (term) JOIN l USING (id) CROSS JOIN m WHERE term IN ('the', 'one') GROUP BY 1 HAVING count(*) = 2)
SELECT id, round(rank, 5) AS rank FROM r WHERE id NOT IN (SELECT id FROM f WHERE term = 'erin')""")
def _(t):
    found = _postings(t, stems=True).search(all_of="thes ones", none_of="erin")
    return found.select(F.col("key").alias("id"), F.round("rank", 5).alias("rank"))


@query("bq2_search_exponential", f"{ctes('tweets')}, {_MATCH}, s AS (SELECT id, 0.6 * exp(-age / 21600.0) + 0.4 * (0.4 * ln(1 + likes) + 0.4 * ln(1 + retweets) + 0.2 * ln(1 + views / 1000.0)) AS score FROM q) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20")
def _(t):
    s = _matches(t).select("id", tx.search_score_exponential(F.col("age")).alias("s"))
    return s.orderBy(F.col("s").desc(), "id").limit(20).select("id", F.round("s", 6).alias("score"))


@query("bq2b_search_daily", f"{ctes('tweets')}, {_MATCH}, s AS (SELECT id, 0.3 * rank + 0.4 / (1 + age / 21600.0) + 0.3 * (0.02 * ln(1 + likes) + 0.02 * ln(1 + retweets) + 0.01 * ln(1 + views // 1000)) AS score FROM q) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20")
def _(t):
    s = _matches(t).select("id", tx.search_score_daily(F.col("rank"), F.col("age")).alias("s"))
    return s.orderBy(F.col("s").desc(), "id").limit(20).select("id", F.round("s", 6).alias("score"))


@query("bq3_simple_score", f"{ctes('tweets')}, a AS (SELECT *, epoch((SELECT max(created_at) FROM tweets)) - epoch(created_at) AS age FROM tweets) SELECT id, round(0.3 * (length(text) + len(hashtags)) + 0.3 * (ln(1 + likes) + ln(1 + retweets) + ln(1 + views)) + 0.3 * exp(-age / 3600.0), 2) AS score FROM a")
def _(t):
    x = tb.tweets(t)
    x = x.join(F.broadcast(x.agg(F.max("created_at").alias("now"))))
    return x.select("id", tx.simple_score("text", "hashtags", epoch("now") - epoch("created_at")).alias("score"))


@query("bq4_trending_hashtags", f"{ctes('tweets')} SELECT tag, n, CAST(row_number() OVER (ORDER BY n DESC, tag) AS INTEGER) AS rank FROM (SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(hashtags) AS tag FROM tweets WHERE created_at >= (SELECT max(created_at) FROM tweets) - INTERVAL 1 HOUR) GROUP BY 1) ORDER BY rank LIMIT 50")
def _(t):
    from pyspark.sql import Window

    x = tb.tweets(t)
    x = x.join(F.broadcast(x.agg(F.max("created_at").alias("now")))).filter("created_at >= now - INTERVAL 1 HOUR")
    n = x.select(F.explode(F.transform("hashtags", F.lower)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    top = n.orderBy(F.col("n").desc(), "tag").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "tag")))


@query("bq5_trend_velocity", f"{ctes('tweets')} SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM tweets WHERE list_contains(list_transform(hashtags, lambda x: lower(x)), '#t3') GROUP BY 1")
def _(t):
    x = tb.tweets(t).filter(F.array_contains(F.transform("hashtags", F.lower), "#t3"))
    return x.groupBy(text_time(F.date_trunc("hour", "created_at")).alias("hour")).agg(F.count("*").alias("n"))


@query("bq6_autocomplete_index", f"""{ctes("tweets")}, n AS (SELECT lower(tag) AS term, count(*) AS score FROM (SELECT unnest(hashtags) AS tag FROM tweets) GROUP BY 1), p AS (SELECT term, score, unnest(range(1, least(length(term), 15) + 1)) AS i FROM n WHERE length(term) >= 2),
r AS (SELECT substr(term, 1, i) AS prefix, term, score, row_number() OVER (PARTITION BY substr(term, 1, i) ORDER BY score DESC, term) AS rank FROM p) SELECT prefix, term, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def _(t):
    n = tb.tweets(t).select(F.explode(F.transform("hashtags", F.lower)).alias("term")).groupBy("term").agg(F.count("*").alias("score"))
    return tx.autocomplete_index(n).select("prefix", "term", "score", "rank")


@query("bq7_popular_queries", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS q, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, q LIMIT 500")
def _(t):
    x = t.events.join(F.broadcast(t.events.agg(F.max("ts").alias("now")))).filter("ts >= now - INTERVAL 24 HOURS")
    return x.groupBy(F.get_json_object("props", "$.k").cast("long").alias("q")).agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.col("n").desc(), "q").limit(500)


@query("bq8_user_timeline", f"{ctes('tweets')} SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at FROM tweets WHERE user_id = 'src0' ORDER BY created_at DESC, id LIMIT 20 OFFSET 5")
def _(t):
    return tb.tweets(t).filter("user_id = 'src0'").orderBy(F.col("created_at").desc(), "id").offset(5).limit(20).select("id", text_time("created_at").alias("at"))


@query("bq9_pull_feed", f"""{ctes("posts", "follows", "likes")}, f AS (SELECT post_id, author, created_at, EXISTS (SELECT 1 FROM likes l WHERE l.post_id = p.post_id AND l.user_id = 7) AS is_liked FROM posts p WHERE author IN (SELECT followee FROM follows WHERE follower = 7) AND created_at < TIMESTAMP '2000-01-01 00:00:00')
SELECT post_id, c_name AS author_name, is_liked FROM f JOIN customer ON c_custkey = author ORDER BY created_at DESC, post_id DESC LIMIT 21""")
def _(t):
    mine = tb.follows(t).filter("follower = 7").select(F.col("followee").alias("author"))
    p = tb.posts(t).filter("created_at < TIMESTAMP_NTZ '2000-01-01 00:00:00'").join(mine, "author", "left_semi")
    first = paging.keyset_page(p, "created_at", "post_id", 20)
    liked = jn.mark_join(first, tb.likes(t).filter("user_id = 7"), ["post_id"], "is_liked")
    return liked.join(t.customer, F.col("c_custkey") == F.col("author")).select("post_id", F.col("c_name").alias("author_name"), "is_liked")


_FOLLOWERS = "n AS (SELECT followee, count(*) AS followers FROM follows GROUP BY 1)"


@query("bq10_hybrid_feed", f"""{ctes("posts", "follows")}, {_FOLLOWERS}, mine AS (SELECT f.followee AS author, coalesce(followers, 0) >= 14 AS celeb FROM follows f JOIN n ON n.followee = f.followee WHERE follower = 11),
c AS (SELECT p.*, row_number() OVER (PARTITION BY p.author ORDER BY created_at DESC, post_id DESC) AS r FROM posts p JOIN mine USING (author) WHERE celeb), u AS (SELECT post_id, created_at FROM posts JOIN mine USING (author) WHERE NOT celeb UNION SELECT post_id, created_at FROM c WHERE r <= 10)
SELECT post_id FROM u ORDER BY created_at DESC, post_id DESC LIMIT 20""")
def _(t):
    follows = tb.follows(t)
    followers = follows.groupBy("followee").agg(F.count("*").alias("followers"))
    mine = follows.filter("follower = 11").join(followers, "followee").select(F.col("followee").alias("author"), (F.col("followers") >= 14).alias("celeb"))
    p = tb.posts(t).join(mine, "author")
    pulled = ag.top_per_group(p.filter("celeb"), ["author"], [F.col("created_at").desc(), F.col("post_id").desc()], 10)
    both = p.filter("not celeb").select("post_id", "created_at").unionByName(pulled.select("post_id", "created_at")).dropDuplicates(["post_id"])
    return both.orderBy(F.col("created_at").desc(), F.col("post_id").desc()).limit(20).select("post_id")


@query("bq11_followers_page", f"{ctes('follows')} SELECT c_custkey, c_name FROM follows JOIN customer ON c_custkey = follower WHERE followee = 42 ORDER BY c_custkey LIMIT 20")
def _(t):
    return tb.follows(t).filter("followee = 42").join(t.customer, F.col("c_custkey") == F.col("follower")).orderBy("c_custkey").limit(20).select("c_custkey", "c_name")


@query("bq12_feed_score_with_diversity", f"""{ctes("posts")}, m AS (SELECT max(created_at) AS now FROM posts), s AS (SELECT post_id, author, 0.4 * exp(-(epoch(now) - epoch(created_at)) / 21600.0) + 0.6 * (0.5 * ln(1 + likes) + 0.3 * ln(1 + comments) + 0.2 * ln(1 + likes % 50)) / 10 AS score FROM posts, m),
d AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY score DESC, post_id) AS r FROM s) SELECT post_id, author, round(score, 6) AS score FROM d WHERE r <= 3 ORDER BY d.score DESC, post_id LIMIT 20""")
def _(t):
    p = tb.posts(t)
    p = p.join(F.broadcast(p.agg(F.max("created_at").alias("now"))))
    age = epoch("now") - epoch("created_at")
    score = 0.4 * F.exp(-age / 21600.0) + 0.6 * (0.5 * F.log1p("likes") + 0.3 * F.log1p("comments") + 0.2 * F.log1p(F.col("likes") % 50)) / 10
    few = ag.top_per_group(p.withColumn("s", score), ["author"], [F.col("s").desc(), F.col("post_id")], 3)
    return few.orderBy(F.col("s").desc(), "post_id").limit(20).select("post_id", "author", F.round("s", 6).alias("score"))


@query("bq13_batch_like_state", f"{ctes('likes')}, q AS (SELECT i * 13 AS post_id FROM range(80) r(i)) SELECT q.post_id, (SELECT count(*) FROM likes l WHERE l.post_id = q.post_id) AS n, EXISTS (SELECT 1 FROM likes l WHERE l.post_id = q.post_id AND user_id = 3) AS mine FROM q")
def _(t):
    from lakeloom.operators.relational import batch_lookup

    q = t.spark.range(80).select((F.col("id") * 13).alias("post_id"))
    likes = tb.likes(t)
    n = batch_lookup(q, likes.groupBy("post_id").agg(F.count("*").alias("n")), ["post_id"], {"n": 0})
    return jn.mark_join(n, likes.filter("user_id = 3"), ["post_id"], "mine")


_GRANTS = "g AS (SELECT 'n' || n_nationkey AS role, 'post:' || (n_nationkey % 4) AS permission FROM nation UNION ALL SELECT 'r' || r_regionkey, 'admin:' || r_regionkey FROM region)"


@query("bq14_effective_permissions", f"WITH RECURSIVE {tb.SQL['roles']}, {_GRANTS}, c(node, ancestor) AS (SELECT child, parent FROM roles UNION SELECT c.node, r.parent FROM c JOIN roles r ON c.ancestor = r.child) SELECT node, string_agg(DISTINCT permission, ',' ORDER BY permission) AS permissions, bool_or(permission = 'admin:1') AS is_admin FROM c JOIN g ON g.role = c.ancestor WHERE node LIKE 'c%' GROUP BY 1")
def _(t):
    role = t.nation.selectExpr("'n' || cast(n_nationkey as string) as role", "'post:' || cast(n_nationkey % 4 as string) as permission").union(t.region.selectExpr("'r' || cast(r_regionkey as string)", "'admin:' || cast(r_regionkey as string)"))
    have = jn.closure(t.spark, tb.roles(t)).filter(F.col("node").startswith("c")).join(role, F.col("ancestor") == F.col("role"))
    sets = have.groupBy("node").agg(F.array_sort(F.collect_set("permission")).alias("p"))
    return sets.select("node", F.array_join("p", ",").alias("permissions"), F.array_contains("p", "admin:1").alias("is_admin"))


_ACCESS = f"""WITH RECURSIVE {tb.SQL['roles']}, {_GRANTS}, c(node, ancestor) AS (SELECT child, parent FROM roles UNION SELECT c.node, r.parent FROM c JOIN roles r ON c.ancestor = r.child),
u AS (SELECT 'c' || c_custkey AS "user", c_custkey % 50 = 0 AS super FROM customer UNION ALL SELECT 's' || s_suppkey, s_suppkey % 7 = 0 FROM supplier),
x AS (SELECT u."user", u.super, coalesce(list(DISTINCT g.permission) FILTER (g.permission IS NOT NULL), []::VARCHAR[]) AS p FROM u LEFT JOIN c ON c.node = u."user" LEFT JOIN g ON g.role = c.ancestor GROUP BY 1, 2)"""


def _access(t):
    """Customers have the role of their nation, which inherits its region's; suppliers have no role; some of both are super users."""
    users = t.customer.selectExpr("'c' || cast(c_custkey as string) as user", "c_custkey % 50 = 0 as super").union(t.supplier.selectExpr("'s' || cast(s_suppkey as string)", "s_suppkey % 7 = 0"))
    hierarchy = t.nation.selectExpr("'n' || cast(n_nationkey as string) as child", "'r' || cast(n_regionkey as string) as parent")
    granted = t.nation.selectExpr("'n' || cast(n_nationkey as string) as role", "'post:' || cast(n_nationkey % 4 as string) as permission").union(t.region.selectExpr("'r' || cast(r_regionkey as string)", "'admin:' || cast(r_regionkey as string)"))
    user_roles = t.customer.selectExpr("'c' || cast(c_custkey as string) as user", "'n' || cast(c_nationkey as string) as role")
    return pm.AccessTable(t.spark, work_dir(t.spark)).build(users, user_roles, hierarchy, granted).read()


@query("bq14_any_permission", f"{_ACCESS} SELECT \"user\", super OR list_has_any(p, ['post:1', 'admin:3']) AS may, super AS of_none FROM x")
def _(t):
    return _access(t).select("user", pm.has_any(["post:1", "admin:3"]).alias("may"), pm.has_any([]).alias("of_none"))


@query("bq14_all_permissions", f"{_ACCESS} SELECT \"user\", super OR list_has_all(p, ['post:2', 'admin:1']) AS may, TRUE AS all_of_none FROM x")
def _(t):
    return _access(t).select("user", pm.has_all(["post:2", "admin:1"]).alias("may"), pm.has_all([]).alias("all_of_none"))


@query("bq14_superuser_bypass", f"{_ACCESS} SELECT super, super OR list_contains(p, 'admin:0') AS may, count(*) AS users, count(*) FILTER (len(p) = 0) AS without_any FROM x GROUP BY 1, 2")
def _(t):
    x = _access(t).withColumn("may", pm.has_permission("admin:0"))
    return x.groupBy("super", "may").agg(F.count("*").alias("users"), F.count_if(F.size("permissions") == 0).alias("without_any"))


# telemetry -----------------------------------------------------------------------------------
_MIN = "m AS (SELECT host, cluster, device, date_trunc('minute', ts) AS bucket, sum(value) AS total, count(*) AS n, max(value) AS high FROM gpu GROUP BY 1, 2, 3, 4)"


def _minutes(t):
    return ag.rollup_state(tb.gpu_metrics(t), ["host", "cluster", "device", F.date_trunc("minute", "ts").alias("bucket")], "value")


_DIMS = "dims AS (SELECT n_nationkey AS host, n_name AS team, r_name AS family, 1.0 + n_nationkey * 0.1 AS rate FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _dims(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("host"), F.col("n_name").alias("team"), F.col("r_name").alias("family"), (1.0 + F.col("n_nationkey") * 0.1).alias("rate"))


@query("bq15_host_day_utilisation", f"{ctes('gpu')}, {_MIN} SELECT host, strftime(bucket, '%Y-%m-%d') AS day, round(sum(total) / sum(n), 8) AS mean FROM m WHERE bucket >= (SELECT max(bucket) FROM m) - INTERVAL 7 DAY GROUP BY 1, 2")
def _(t):
    m = _minutes(t)
    m = m.join(F.broadcast(m.agg(F.max("bucket").alias("now")))).filter("bucket >= now - INTERVAL 7 DAYS")
    return m.groupBy("host", F.date_format("bucket", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("total") / F.sum("n"), 8).alias("mean"))


@query("bq16_host_day_team", f"{ctes('gpu')}, {_MIN}, {_DIMS} SELECT team, host, strftime(bucket, '%Y-%m-%d') AS day, round(sum(total) / sum(n), 8) AS mean, max(high) AS high FROM m JOIN dims USING (host) GROUP BY 1, 2, 3")
def _(t):
    x = _minutes(t).join(F.broadcast(_dims(t)), "host")
    return x.groupBy("team", "host", F.date_format("bucket", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("total") / F.sum("n"), 8).alias("mean"), F.max("high").alias("high"))


@query("bq17_cost_per_useful_hour", f"{ctes('gpu')}, {_MIN}, {_DIMS}, u AS (SELECT team, count(*) / 60.0 AS hours, sum(CASE WHEN total / n > 200 THEN 1 ELSE 0 END) / 60.0 AS useful, sum(rate) / 60.0 AS spent FROM m JOIN dims USING (host) GROUP BY 1) SELECT team, round(hours, 5) AS hours, round(spent / nullif(useful, 0), 5) AS cost, round(useful / nullif(hours, 0), 5) AS efficiency FROM u")
def _(t):
    x = _minutes(t).join(F.broadcast(_dims(t)), "host").groupBy("team").agg((F.count("*") / 60.0).alias("hours"), (F.sum(F.when(F.col("total") / F.col("n") > 200, 1).otherwise(0)) / 60.0).alias("useful"), (F.sum("rate") / 60.0).alias("spent"))
    return x.select("team", F.round("hours", 5).alias("hours"), F.round(ag.ratio(F.col("spent"), F.col("useful")), 5).alias("cost"), F.round(ag.ratio(F.col("useful"), F.col("hours")), 5).alias("efficiency"))


@query("bq18_expensive_idle_devices", f"{ctes('gpu')}, {_MIN}, {_DIMS} SELECT device, round(sum(CASE WHEN total / n < 100 THEN rate ELSE 0 END) / 60.0, 5) AS wasted, round(avg(total / n), 5) AS mean FROM m JOIN dims USING (host) GROUP BY 1 HAVING avg(total / n) < 260 ORDER BY sum(CASE WHEN total / n < 100 THEN rate ELSE 0 END) / 60.0 DESC, device LIMIT 50")
def _(t):
    util = F.col("total") / F.col("n")
    x = _minutes(t).join(F.broadcast(_dims(t)), "host").groupBy("device").agg((F.sum(F.when(util < 100, F.col("rate")).otherwise(0.0)) / 60.0).alias("w"), F.avg(util).alias("m")).filter("m < 260")
    return x.orderBy(F.col("w").desc(), "device").limit(50).select("device", F.round("w", 5).alias("wasted"), F.round("m", 5).alias("mean"))


@query("bq19_family_efficiency", f"{ctes('gpu')}, {_MIN}, {_DIMS} SELECT family, count(DISTINCT device) AS devices, round(sum(total) / sum(n), 8) AS mean FROM m JOIN dims USING (host) GROUP BY 1")
def _(t):
    return _minutes(t).join(F.broadcast(_dims(t)), "host").groupBy("family").agg(F.countDistinct("device").alias("devices"), F.round(F.sum("total") / F.sum("n"), 8).alias("mean"))


@query("bq20_monthly_fleet", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(o_totalprice) AS mean, count(DISTINCT o_custkey) AS active FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg((F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double") / F.count("o_totalprice")).alias("mean"), F.countDistinct("o_custkey").alias("active"))


@query("bq21_minute_host_rollup", f"{ctes('gpu')} SELECT host, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS bucket, round(avg(value) FILTER (metric = 'view'), 5) AS view_mean, max(value) FILTER (metric = 'error') AS error_high, count(DISTINCT device) AS devices, count(DISTINCT device) < 8 AS dropout, count(*) AS n FROM gpu GROUP BY 1, 2")
def _(t):
    d = F.countDistinct("device")
    return tb.gpu_metrics(t).groupBy("host", text_time(F.date_trunc("minute", "ts")).alias("bucket")).agg(F.round(F.avg(F.when(F.col("metric") == "view", F.col("value"))), 5).alias("view_mean"), F.max(F.when(F.col("metric") == "error", F.col("value"))).alias("error_high"), d.alias("devices"), (d < 8).alias("dropout"), F.count("*").alias("n"))


@query("bq22_efficiency_and_chargeback", f"{ctes('gpu')}, {_DIMS}, p AS (SELECT host, avg(value) / 500 AS util, avg(CASE WHEN metric = 'view' THEN value END) / 500 AS occ, max(CASE WHEN metric = 'click' THEN value END) / 500 AS tensor FROM gpu GROUP BY 1) SELECT team, round(util * occ * CAST(tensor > 0.05 AS INTEGER), 6) AS score, round((1 - util) * rate, 6) AS waste, round(rate - CASE WHEN util > 0.5 THEN 0.2 * rate ELSE 0 END, 6) AS net FROM p JOIN dims USING (host)")
def _(t):
    p = tb.gpu_metrics(t).groupBy("host").agg((F.avg("value") / 500).alias("util"), (F.avg(F.when(F.col("metric") == "view", F.col("value"))) / 500).alias("occ"), (F.max(F.when(F.col("metric") == "click", F.col("value"))) / 500).alias("tensor"))
    x = p.join(F.broadcast(_dims(t)), "host")
    return x.select("team", F.round(F.col("util") * F.col("occ") * (F.col("tensor") > 0.05).cast("int"), 6).alias("score"), F.round((1 - F.col("util")) * F.col("rate"), 6).alias("waste"), F.round(F.col("rate") - F.when(F.col("util") > 0.5, 0.2 * F.col("rate")).otherwise(0.0), 6).alias("net"))


@query("bq23_fragmentation", f"{ctes('gpu')}, h AS (SELECT host, count(DISTINCT device) AS have, count(DISTINCT CASE WHEN value > 480 THEN device END) AS busy, max(value) AS ram FROM gpu GROUP BY 1) SELECT host, have - busy AS free, round((have - busy) / CAST(have AS DOUBLE), 6) AS score FROM h WHERE have - busy > 0 AND ram < 489.9")
def _(t):
    h = tb.gpu_metrics(t).groupBy("host").agg(F.countDistinct("device").alias("have"), F.countDistinct(F.when(F.col("value") > 480, F.col("device"))).alias("busy"), F.max("value").alias("ram"))
    free = F.col("have") - F.col("busy")
    return h.filter((free > 0) & (F.col("ram") < 489.9)).select("host", free.alias("free"), F.round(free / F.col("have"), 6).alias("score"))


@query("bq25_sku_recommendation", f"{ctes('gpu')}, p AS (SELECT device, quantile_cont(value, 0.95) AS p95, coalesce(avg(CASE WHEN metric = 'click' THEN value END), 0) AS tensor FROM gpu GROUP BY 1) SELECT device, CASE WHEN p95 > 480 AND tensor > 250 THEN 'large' WHEN p95 > 460 THEN 'medium' ELSE 'small' END AS sku FROM p")
def _(t):
    p = tb.gpu_metrics(t).groupBy("device").agg(F.expr("percentile(value, 0.95)").alias("p95"), F.coalesce(F.avg(F.when(F.col("metric") == "click", F.col("value"))), F.lit(0.0)).alias("tensor"))
    return p.select("device", F.when((F.col("p95") > 480) & (F.col("tensor") > 250), "large").when(F.col("p95") > 460, "medium").otherwise("small").alias("sku"))


@query("bq27_gated_throughput", f"{ctes('gpu')} SELECT cluster, count(*) AS n FROM gpu WHERE (SELECT quantile_cont(value, 0.99) FROM gpu) < 600 GROUP BY 1")
def _(t):
    g = tb.gpu_metrics(t)
    return jn.keep_where(g.groupBy("cluster").agg(F.count("*").alias("n")), g.agg(F.expr("percentile(value, 0.99)").alias("p99")), F.col("p99") < 600)
