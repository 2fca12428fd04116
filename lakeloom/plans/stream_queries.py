"""Queries of the streaming transforms, as batch runs and as drained streams over the fixture's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.plans.registry import query
from lakeloom.sources import eventlog as el
from lakeloom.sources import tables as tb
from lakeloom.sources.formats import work_dir
from lakeloom.sources.tables import ctes, text_time
from lakeloom.streaming import jobs, sinks, views

_OUT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _source(t):
    """The events as a stream. Watermarks need a timestamp with the session's time zone."""
    return jobs.read_events(t.spark, f"{t.sf_dir}/events.parquet*", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("st1_tumbling_rollup_stream", f"SELECT {_OUT.format('date_trunc(\'hour\', ts)')} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS high FROM events GROUP BY 1, 2")
def _(t):
    out = jobs.drain(jobs.tumbling(_source(t), "ts", "1 hour", ["event_type"]), work_dir(t.spark), "complete")
    return out.select(text_time("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "high")


@query("st1_tumbling_rollup_batch", f"SELECT {_OUT.format('date_trunc(\'hour\', ts)')} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS high FROM events GROUP BY 1, 2")
def _(t):
    return jobs.tumbling(t.events, "ts", "1 hour", ["event_type"], late=None).select(text_time("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "high")


@query("st3_final_windows_only", f"SELECT {_OUT.format('date_trunc(\'hour\', ts)')} AS start, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE")
def _(t):
    out = jobs.drain(jobs.tumbling(_source(t), "ts", "1 hour", [], late="15 minutes"), work_dir(t.spark))
    return out.select(text_time("start").alias("start"), "n")


@query("st5_grouping_sets_rollup", "SELECT user_id % 16 AS host, user_id % 3 AS cluster, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((user_id % 16), (user_id % 3), ())")
def _(t):
    x = t.events.select((F.col("user_id") % 16).alias("host"), (F.col("user_id") % 3).alias("cluster"), "value")
    return x.groupingSets([["host"], ["cluster"], []], "host", "cluster").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("st7_dedup_by_event_id", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(t):
    source = _source(t)
    twice = source.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return jobs.drain(jobs.deduplicated(twice, "event_id", "ts", "40 days"), work_dir(t.spark)).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("st8_counter_upserts", f"{ctes('like_events')} SELECT item, CAST(greatest(0, sum(CASE WHEN action = 'like' THEN 1 ELSE -1 END)) AS BIGINT) AS n FROM like_events GROUP BY 1")
def _(t):
    root = work_dir(t.spark)
    liked = tb.like_events(t)
    el.publish(liked, f"{root}/log", F.col("item"), F.col("ts"))
    counts = jobs.LikeCounts(t.spark, root)
    stream = el.follow_log(t.spark, f"{root}/log", "item long, action string", f"{root}/group", 20_000)
    sinks.run_until_idle(stream, f"{root}/checkpoint", counts.each, "0 seconds")
    return counts.read()


@query("st6_bounded_batches", "SELECT count(*) AS events, count(*) AS different, TRUE AS bounded FROM events")
def _(t):
    root = work_dir(t.spark)
    el.publish(t.events, f"{root}/log", F.col("user_id"), F.col("ts"))
    streams = [el.follow_log(t.spark, f"{root}/log", "event_id long", f"{root}/group{m}", 1000, member=m, members=4) for m in range(4)]

    sinks.run_members(streams, f"{root}/checkpoint", lambda batch, member, number: sinks.write_file(batch, f"{root}/out/{member}-{number}.parquet"))
    read = t.spark.read.schema("event_id long").parquet(f"{root}/out").select("event_id", F.col("_metadata.file_name").alias("batch"))
    most = read.groupBy("batch").agg(F.count("*").alias("n")).agg((F.max("n") <= 1000).alias("bounded"))
    return read.agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("different")).join(F.broadcast(most))


@query("st2_early_results", f"SELECT {_OUT.format('date_trunc(\'hour\', ts)')} AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total, date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT max(ts) FROM events) - INTERVAL 6 DAY AS provisional FROM events GROUP BY 1, 2, date_trunc('hour', ts)")
def _(t):
    root = work_dir(t.spark)
    el.publish(t.events, f"{root}/log", F.col("event_id"), F.col("ts"))
    early = sinks.EarlyWindows(t.spark, f"{root}/windows", "1 hour", "6 days", ("event_type",))
    stream = el.follow_log(t.spark, f"{root}/log", "ts timestamp, event_type string, value decimal(12,2)", f"{root}/group", 25_000)
    early.follow(stream, "ts", "value", f"{root}/checkpoint")
    return early.read().select(text_time("start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"), "provisional")


@query("st13_replayed_windows", f"WITH w AS (SELECT {_OUT.format('date_trunc(\'hour\', ts)')} AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2, date_trunc('hour', ts) HAVING date_trunc('hour', ts) < (SELECT date_trunc('day', max(ts)) FROM events) - INTERVAL 7 DAY) SELECT start, event_type, n, total, sum(n) OVER () = (SELECT count(*) FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) - INTERVAL 7 DAY) AS reconciled FROM w")
def _(t):
    root = work_dir(t.spark)
    el.publish(t.events, f"{root}/log", F.col("event_id"), F.col("ts"))
    schema = "ts timestamp, event_type string, value decimal(12,2)"
    early = sinks.EarlyWindows(t.spark, f"{root}/windows", "1 hour", "6 days", ("event_type",))
    stream = el.follow_log(t.spark, f"{root}/log", schema, f"{root}/group", 25_000)
    # the sink loses every other window that the stream gives it
    early.follow(stream, "ts", "value", f"{root}/checkpoint", lambda rows, n: early.upsert(rows.filter("hour(start) % 2 = 0"), n))
    raw = el.read_log(t.spark, f"{root}/log").select(F.from_json("value", schema).alias("v")).select("v.*")
    first, last = raw.agg(F.date_trunc("day", F.min("ts")), F.date_trunc("day", F.max("ts")) - F.expr("INTERVAL 7 DAY")).first()
    told = early.replay(raw, "ts", "value", first, last).select((F.col("counted_after") == F.col("raw_events")).alias("reconciled"))
    final = early.read().filter(F.col("start") < F.lit(last))
    return final.select(text_time("start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total")).join(F.broadcast(told))


@query("sc25_log_partitions", f"{ctes('gpu')} SELECT cluster, host, count(*) AS n, CAST(1 AS BIGINT) AS partitions, min(event_id) AS least FROM gpu GROUP BY 1, 2")
def _(t):
    root = work_dir(t.spark)
    el.publish(tb.gpu_metrics(t), root, F.concat_ws(":", "cluster", "host"), F.col("ts"))
    events = el.read_log(t.spark, root).select("partition", F.from_json("value", "cluster long, host long, event_id long").alias("v")).select("partition", "v.*")
    return events.groupBy("cluster", "host").agg(F.count("*").alias("n"), F.countDistinct("partition").alias("partitions"), F.min("event_id").alias("least"))


@query("st14_kept_top_items", f"{ctes('like_events')}, c AS (SELECT user_id % 5 AS grp, item, sum(CASE WHEN action = 'like' THEN 1 ELSE -1 END) AS n FROM like_events WHERE item IS NOT NULL GROUP BY 1, 2 HAVING sum(CASE WHEN action = 'like' THEN 1 ELSE -1 END) <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, item) AS rank FROM c) SELECT grp, CAST(rank AS INTEGER) AS rank, item, CAST(n AS BIGINT) AS n FROM r WHERE rank <= 5")
def _(t):
    root = work_dir(t.spark)
    el.publish(tb.like_events(t), f"{root}/log", F.col("event_id"), F.col("ts"))
    view = views.TopView(t.spark, f"{root}/view", 5)
    stream = el.follow_log(t.spark, f"{root}/log", "user_id long, item long, action string", f"{root}/group", 25_000)
    deltas = stream.select((F.col("user_id") % 5).alias("group"), "item", F.when(F.col("action") == "like", 1).otherwise(-1).cast("long").alias("n"))
    sinks.run_until_idle(deltas, f"{root}/checkpoint", view.hold, "0 seconds")
    return view.read().withColumnRenamed("group", "grp")


@query("sc27_newest_posts_lists", f"{ctes('posts')}, r AS (SELECT author, post_id, row_number() OVER (PARTITION BY author ORDER BY created_at DESC, post_id DESC) AS place FROM posts) SELECT author, CAST(place AS INTEGER) AS place, post_id FROM r WHERE place <= 10")
def _(t):
    root = work_dir(t.spark)
    el.publish(tb.posts(t), f"{root}/log", F.col("author"), F.col("created_at"))
    lists = sinks.CappedLists(t.spark, f"{root}/lists", 10)
    stream = el.follow_log(t.spark, f"{root}/log", "author long, post_id long, created_at timestamp_ntz", f"{root}/group", 50_000)
    sinks.run_until_idle(stream.select(F.col("author").alias("key"), F.col("created_at").alias("at"), F.col("post_id").alias("id")), f"{root}/checkpoint", lists.push, "0 seconds")
    return lists.read().select(F.col("key").alias("author"), "place", F.col("id").alias("post_id"))


@query("st9_fan_out_on_write", f"{ctes('posts', 'follows')}, n AS (SELECT followee, count(*) AS followers FROM follows GROUP BY 1), u AS (SELECT f.follower, p.post_id, p.created_at FROM posts p JOIN follows f ON f.followee = p.author JOIN n ON n.followee = p.author WHERE followers < 14), r AS (SELECT *, row_number() OVER (PARTITION BY follower ORDER BY created_at DESC, post_id DESC) AS r FROM u) SELECT follower, post_id FROM r WHERE r <= 50")
def _(t):
    pushed, _celebrities = jobs.fan_out(tb.posts(t), tb.follows(t), 14)
    return jobs.capped(pushed, "follower", 50).select("follower", "post_id")


@query("st9_celebrity_posts", f"{ctes('posts', 'follows')}, n AS (SELECT followee, count(*) AS followers FROM follows GROUP BY 1), r AS (SELECT author, post_id, row_number() OVER (PARTITION BY author ORDER BY created_at DESC, post_id DESC) AS r FROM posts JOIN n ON followee = author WHERE followers >= 14) SELECT author, post_id FROM r WHERE r <= 100")
def _(t):
    _pushed, celebrities = jobs.fan_out(tb.posts(t), tb.follows(t), 14)
    return jobs.capped(celebrities, "author", 100).select("author", "post_id")


@query("st10_delete_event", f"{ctes('posts')} SELECT author, post_id FROM posts WHERE post_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def _(t):
    return jobs.without_deleted(tb.posts(t).select("author", "post_id"), t.events.filter("event_type = 'error'").select(F.col("event_id").alias("post_id"))).select("author", "post_id")


@query("st11_sliding_velocity", f"SELECT {_OUT.format('start')} AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * i AS INT)) FOR i IN range(4)]) AS start FROM events WHERE event_type = 'click') GROUP BY 1")
def _(t):
    x = jobs.tumbling(t.events.filter("event_type = 'click'"), "ts", "1 hour", [], late=None, slide="15 minutes")
    return x.select(text_time("start").alias("start"), "n")


@query("st12_rate_limit", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 4, date_trunc('minute', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 1")
def _(t):
    return jobs.limited(t.events.withColumn("u", F.col("user_id") % 4), "u", "ts", "event_id", 1).select("event_id")


@query("st12_exact_text_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def _(t):
    return t.documents.groupBy(F.md5("text").alias("m")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("st15_last_writer_of_regions", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY 1")
def _(t):
    regions = [t.events.filter(F.col("user_id") % 3 == r) for r in range(3)]
    return jobs.last_writers(regions, ["user_id"], "ts", "value").select("user_id", text_time("ts").alias("at"))
