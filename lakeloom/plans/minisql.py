"""A small SQL session with versioned tables: the statements of an embedded row store, on Spark.

CREATE TABLE, CREATE INDEX, INSERT, SELECT, UPDATE, DELETE, BEGIN, COMMIT, ROLLBACK. SELECT is
passed on to Spark SQL as it stands, so its grammar is Spark's: joins, aggregates, order, OR and
parentheses included. Statements that change a table read the snapshot of their transaction,
make a new version of the table and leave other readers theirs. An index is declared and never
changes a result. Trailing tokens, unknown columns and types are errors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type names of the dialect.
TYPES = {"INT": "int", "INTEGER": "int", "SMALLINT": "smallint", "BIGINT": "bigint", "FLOAT": "double", "DOUBLE": "double", "BOOL": "boolean", "BOOLEAN": "boolean", "TEXT": "string", "DATE": "date", "TIMESTAMP": "timestamp"}


class SqlError(ValueError):
    pass


class Database:
    """Tables by name. Each has a current version; a transaction holds the versions it began with and those it made."""

    def __init__(self, spark: SparkSession):
        self.spark, self._id = spark, uuid.uuid4().hex[:8]
        self._tables: dict[str, DataFrame] = {}
        self._limits: dict[str, dict[str, int]] = {}
        self._indexes: dict[str, tuple[str, str]] = {}
        self._open: dict[str, DataFrame] | None = None

    def execute(self, sql: str) -> DataFrame | int | None:
        """Rows for SELECT, a count of rows for changes, None otherwise."""
        text = sql.strip().rstrip(";").strip()
        word = text.split(None, 1)[0].upper() if text else ""
        run = {"CREATE": self._create, "INSERT": self._insert, "SELECT": self._select, "WITH": self._select, "UPDATE": self._update, "DELETE": self._delete, "BEGIN": self._begin, "COMMIT": self._commit, "ROLLBACK": self._rollback}.get(word)
        if run is None:
            raise SqlError(f"not a statement: {sql!r}")
        return run(text)

    def register(self, name: str, table: DataFrame) -> None:
        """Makes an existing frame a table, in the open transaction if there is one."""
        self._now[name.lower()] = table

    # transactions
    def _begin(self, text: str) -> None:
        if not re.fullmatch(r"(?i)BEGIN(\s+TRANSACTION)?", text):
            raise SqlError(f"trailing tokens: {text!r}")
        if self._open is not None:
            raise SqlError("a transaction is open")
        self._open = dict(self._tables)

    def _commit(self, text: str) -> None:
        if self._open is None:
            raise SqlError("no transaction is open")
        self._tables, self._open = self._open, None

    def _rollback(self, text: str) -> None:
        if self._open is None:
            raise SqlError("no transaction is open")
        self._open = None

    @property
    def _now(self) -> dict[str, DataFrame]:
        return self._tables if self._open is None else self._open

    def _table(self, name: str) -> DataFrame:
        if name.lower() not in self._now:
            raise SqlError(f"no table {name}")
        return self._now[name.lower()]

    # statements
    def _create(self, text: str) -> None:
        index = re.fullmatch(r"(?is)CREATE\s+INDEX\s+(\w+)\s+ON\s+(\w+)\s*\(\s*(\w+)\s*\)", text)
        if index:
            name, table, column = index.groups()
            if column not in self._table(table).columns:
                raise SqlError(f"no column {column}")
            self._indexes[name.lower()] = (table.lower(), column)
            return
        table = re.fullmatch(r"(?is)CREATE\s+TABLE\s+(\w+)\s*\((.*)\)", text)
        if not table:
            raise SqlError(f"cannot read {text!r}")
        name, body = table.groups()
        fields, limits = [], {}
        for part in re.split(r",(?![^()]*\))", body):
            m = re.fullmatch(r"(?is)\s*(\w+)\s+(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", part)
            if not m:
                raise SqlError(f"cannot read column {part!r}")
            column, kind, n, scale = m.groups()
            kind = kind.upper()
            if kind == "VARCHAR":
                limits[column] = int(n or 255)
                fields.append(f"`{column}` string")
            elif kind in ("NUMERIC", "DECIMAL"):
                fields.append(f"`{column}` decimal({n or 10},{scale or 0})")
            elif kind in TYPES:
                fields.append(f"`{column}` {TYPES[kind]}")
            else:
                raise SqlError(f"unknown type {kind}")
        self._now[name.lower()] = self.spark.createDataFrame([], ", ".join(fields))
        self._limits[name.lower()] = limits

    def _insert(self, text: str) -> int:
        m = re.fullmatch(r"(?is)INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*VALUES\s*(.*)", text)
        if not m:
            raise SqlError(f"cannot read {text!r}")
        name, listed, values = m.groups()
        table = self._table(name)
        columns = [c.strip() for c in listed.split(",")] if listed else table.columns
        rows = self.spark.sql(f"SELECT * FROM VALUES {values}")
        if len(rows.columns) != len(columns):
            raise SqlError(f"{len(columns)} values are wanted")
        return self._write(name, table, rows.toDF(*columns), rows.count())

    def _write(self, name: str, table: DataFrame, rows: DataFrame, n: int) -> int:
        limits = self._limits.get(name.lower(), {})
        new = rows.select(*[(F.substring(F.col(f.name), 1, limits[f.name]) if f.name in limits else F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema])
        self._put(name, table.unionByName(new))
        return n

    def _put(self, name: str, df: DataFrame) -> None:
        """A new version. Where a shared folder is set, it is written there, which cuts its lineage."""
        root = self.spark.conf.get("spark.checkpoint.dir", None)
        if root:
            path = f"{root}/minisql-{self._id}/{name.lower()}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
        self._now[name.lower()] = df

    def _select(self, text: str) -> DataFrame:
        views = {}
        for name, df in self._now.items():
            views[name] = f"lakeloom_{self._id}_{name}"
            df.createOrReplaceTempView(views[name])
        head = ", ".join(f"{n} AS (SELECT * FROM {v})" for n, v in views.items())
        if re.match(r"(?i)WITH\b", text):
            return self.spark.sql(f"WITH {head}, {text[4:]}" if head else text)
        return self.spark.sql(f"WITH {head} {text}" if head else text)

    def _update(self, text: str) -> int:
        m = re.fullmatch(r"(?is)UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", text)
        if not m:
            raise SqlError(f"cannot read {text!r}")
        name, sets, where = m.groups()
        table = self._table(name)
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        values = {}
        for part in re.split(r",(?=(?:[^']*'[^']*')*[^']*$)(?![^()]*\))", sets):
            column, _, value = part.partition("=")
            if column.strip() not in table.columns:
                raise SqlError(f"no column {column.strip()}")
            values[column.strip()] = F.expr(value)
        n = table.filter(hit).count()
        self._put(name, table.select(*[F.when(hit, values[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in table.schema]))
        return n

    def _delete(self, text: str) -> int:
        m = re.fullmatch(r"(?is)DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", text)
        if not m:
            raise SqlError(f"cannot read {text!r}")
        name, where = m.groups()
        table = self._table(name)
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        n = table.filter(hit).count()
        self._put(name, table.filter(~hit))
        return n

    def tables(self) -> Sequence[str]:
        return sorted(self._now)
