"""Queries through the SQL session."""

from __future__ import annotations

from lakeloom.plans.minisql import Database
from lakeloom.plans.registry import query

#: Stock of parts, taken from the fixture, and what is done to it in the session.
_STOCK = "SELECT CAST(p_partkey AS INT) AS part, substr(p_brand, 1, 8) AS brand, p_size AS pieces FROM part"


@query("dm5_sql_session", f"WITH s AS ({_STOCK}) SELECT part, CASE WHEN pieces > 40 THEN 'large' ELSE brand END AS brand, CASE WHEN pieces > 40 THEN pieces - 40 ELSE pieces END AS pieces FROM s WHERE pieces >= 5 UNION ALL SELECT -1, 'returned', 7")
def _(t):
    t.part.createOrReplaceTempView("part_of_fixture")
    db = Database(t.spark)
    db.register("stock", t.spark.sql(_STOCK.replace("FROM part", "FROM part_of_fixture")))
    db.execute("CREATE INDEX by_pieces ON stock (pieces)")
    db.execute("BEGIN TRANSACTION")
    db.execute("DELETE FROM stock WHERE pieces >= 5")
    db.execute("ROLLBACK")
    db.execute("BEGIN")
    db.execute("DELETE FROM stock WHERE pieces < 5")
    db.execute("UPDATE stock SET pieces = pieces - 40, brand = 'large' WHERE pieces > 40")
    db.execute("COMMIT")
    db.execute("INSERT INTO stock (part, brand, pieces) VALUES (-1, 'returned', 7)")
    return db.execute("SELECT part, brand, pieces FROM stock")


@query("dm1_sql_over_tables", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 AND (c_nationkey = 1 OR c_nationkey = 2) GROUP BY 1")
def _(t):
    db = Database(t.spark)
    db.register("customer", t.customer)
    return db.execute("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 AND (c_nationkey = 1 OR c_nationkey = 2) GROUP BY c_mktsegment")
