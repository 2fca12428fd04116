"""Versioned tables: several sessions, lost races, feeds, retention."""

import pytest
from pyspark.sql import functions as F

from lakeloom.sources import versioned as vt


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_two_sessions_share_a_table_and_one_writer_wins(spark, tmp_path):
    root, other = f"file://{tmp_path}/t", spark.newSession()
    mine = vt.VersionedTable(spark, root, keys=["k"], buckets=4)
    table = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k long, v string")
    assert mine.append(table, 10) == 1
    theirs = vt.VersionedTable(other, root)  # knows the keys from the log
    assert rows(theirs.read()) == rows(table)

    # a merge that starts from a version which is no longer the last one is refused
    stale = mine._last()
    theirs.merge(other.createDataFrame([(1, "theirs")], "k long, v string"), at=20)
    mine._last = lambda: stale
    with pytest.raises(vt.Conflict):
        mine.merge(spark.createDataFrame([(1, "mine")], "k long, v string"), at=20)
    del mine._last
    assert mine.version == 2 and dict(rows(mine.read()))[1] == "theirs"

    # an append goes on top of what came meanwhile
    versions = iter([stale])
    real = mine._last
    mine._last = lambda: next(versions, None) or real()
    assert mine.append(spark.createDataFrame([(100, "more")], "k long, v string"), 30) == 3
    del mine._last
    assert rows(theirs.read()) == sorted([(k, "theirs" if k == 1 else v) for k, v in rows(table)] + [(100, "more")], key=repr)
    assert [h["did"] for h in mine.history()] == ["append", "merge", "append"]
    assert rows(mine.read(at=25)) == rows(mine.read(2)) and rows(mine.read(1)) == rows(table)
    with pytest.raises(ValueError, match="older"):
        mine.append(table, 5)
    with pytest.raises(LookupError):
        mine.read(9)


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path):
    table = vt.VersionedTable(spark, f"file://{tmp_path}/t", keys=["k"], buckets=8)
    table.append(spark.range(1000).selectExpr("id as k", "id * 2 as v"))
    before = {p["path"] for p in table.entry()["parts"]}
    changes = spark.createDataFrame([(5, 1, 1, False), (5, 2, 2, False), (5000, 3, 1, False), (5000, None, 2, True)], "k long, v long, seq long, gone boolean")
    table.merge(changes, delete="gone", order="seq")
    after = {p["path"] for p in table.entry()["parts"]}
    assert len(before) == len(after) == 8 and 6 <= len(before & after) < 8
    assert rows(table.read()) == sorted([(i, 2 if i == 5 else 2 * i) for i in range(1000)], key=repr)
    assert [(r["version"], r["op"], r["before"]["v"], r["after"]["v"]) for r in table.changes(1).collect()] == [(2, "update", 10, 2)]  # the key that came and went changed nothing


def test_a_feed_goes_on_after_a_restart_and_tells_every_change_once(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    table = vt.VersionedTable(spark, root, keys=["k"], buckets=2)
    table.append(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    copy, told = {}, []

    def follow(limit=None):
        feed = vt.ChangeFeed(vt.VersionedTable(spark, root), "copy")
        changes, upto = feed.poll(limit)
        for r in sorted(changes.collect(), key=lambda r: r["version"]):
            told.append((r["version"], r["op"]))
            if r["op"] == "delete":
                del copy[r["before"]["k"]]
            else:
                copy[r["after"]["k"]] = r["after"]["v"]
        return feed, upto

    feed, upto = follow()
    lost = vt.ChangeFeed(table, "copy")
    feed.confirm(upto)
    lost.confirm(1)  # confirmed already
    table.merge(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"))
    table.merge(spark.createDataFrame([(1, None)], "k long, v string"), delete="true")
    table.commit(spark.createDataFrame([(3, "d"), (9, "e")], "k long, v string"))
    for _ in range(3):
        feed, upto = follow(1)
        feed.confirm(upto)
    assert copy == dict(rows(table.read())) == {3: "d", 9: "e"}
    assert sorted(told) == [(1, "insert"), (1, "insert"), (2, "insert"), (2, "update"), (3, "delete"), (4, "delete"), (4, "insert")]
    changes, upto = vt.ChangeFeed(table, "copy").poll()
    assert changes.count() == 0 and upto == 4


def test_columns_grow_and_old_versions_expire(spark, tmp_path):
    table = vt.VersionedTable(spark, f"file://{tmp_path}/t")
    table.append(spark.createDataFrame([(1,)], "a long"))
    clone = table.clone(f"file://{tmp_path}/c")
    table.append(spark.createDataFrame([(2, "x")], "a long, b string"))
    assert rows(table.read()) == [(1, None), (2, "x")]
    with pytest.raises(ValueError, match="type"):
        table.append(spark.createDataFrame([("no",)], "a string"))
    table.commit(spark.createDataFrame([(7,)], "a long"))
    assert table.expire(1) == 1  # the clone still needs the first folder
    assert rows(table.read()) == [(7,)] and rows(clone.read()) == [(1,)]
    with pytest.raises(LookupError):
        table.read(1)
    with pytest.raises(LookupError, match="without keys"):
        table.changes(2)
    table.drop()
    with pytest.raises(LookupError, match="dropped"):
        vt.VersionedTable(spark, table.root).read()
    table.undrop()
    assert table.read().filter(F.col("a") == 7).count() == 1
