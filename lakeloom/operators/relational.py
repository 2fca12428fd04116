"""Scans, predicates, versioned rows and table changes, as functions on DataFrames.

Tables never change in place: a change is a new DataFrame (or a new version on disk), so readers
keep the snapshot they have. NULL follows SQL throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# scans ---------------------------------------------------------------------------------------
def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """All rows with the key; the equality reaches the file scan."""
    return df.filter(F.col(key) == F.lit(value))


def range_scan(df: DataFrame, key: str, low, high) -> DataFrame:
    """Rows with low <= key <= high, in key order."""
    return df.filter(F.col(key).between(low, high)).orderBy(key)


def hash_sample(df: DataFrame, keys: Sequence[str], percent: float, salt: int = 0) -> DataFrame:
    """A Bernoulli sample that is the same in every run: rows whose key hash is under the rate."""
    return df.filter(F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(1_000_000)) < int(percent * 10_000))


def block_sample(df: DataFrame, percent: float, block_rows: int = 1000, key: str = "id") -> DataFrame:
    """A sample of whole blocks of consecutive keys."""
    block = F.floor(F.col(key) / block_rows)
    return df.filter(F.pmod(F.xxhash64(block), F.lit(1_000_000)) < int(percent * 10_000))


def exact_sample(df: DataFrame, keys: Sequence[str], n: int, salt: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer) in the order of a salted hash."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(salt)), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


def latest_by_key(df: DataFrame, keys: Sequence[str], seq: str, tombstone: str | None = None) -> DataFrame:
    """The newest version of each key; a key whose newest version is a tombstone is gone. One partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_v"))
    out = newest.select(*keys, "_v.*")
    return out.filter(~F.col(tombstone)) if tombstone else out


def merge_operands(df: DataFrame, key: str, **folds: Column) -> DataFrame:
    """Folds the operands of each key, such as sums of counters or unions of sketches."""
    return df.groupBy(key).agg(*[c.alias(n) for n, c in folds.items()])


# predicates ----------------------------------------------------------------------------------
def optional(column: str, value) -> Column:
    """column = value, or true when no value is asked for."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def batch_lookup(requests: DataFrame, table: DataFrame, keys: Sequence[str], values: dict[str, object]) -> DataFrame:
    """Every requested key with its values, or with the given defaults."""
    found = requests.join(table, list(keys), "left")
    return found.select(*keys, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in values.items()])


def path_ancestors(df: DataFrame, path: str, of: str) -> DataFrame:
    return df.filter(F.lit(of).startswith(F.col(path)))


def path_descendants(df: DataFrame, path: str, of: str) -> DataFrame:
    return df.filter(F.col(path).startswith(of))


def overlaps(a_start: str, a_end: str, b_start: str, b_end: str) -> Column:
    """Half-open ranges share a point."""
    return (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end))


def json_contains(column: str, wanted: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.get_json_object(column, f"$.{k}").eqNullSafe(F.lit(str(v)))
    return out


def has_bits(column: str, mask: int) -> Column:
    return F.col(column).bitwiseAND(mask) > 0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


# changes -------------------------------------------------------------------------------------
def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*[F.col(f.name).cast(f.dataType) for f in table.schema]))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; UNKNOWN keeps a row."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def update_where(table: DataFrame, condition: Column, **values) -> DataFrame:
    """All new values are computed from the old row."""
    hit = F.coalesce(condition, F.lit(False))
    return table.select(*[F.when(hit, values[c] if isinstance(values[c], Column) else F.lit(values[c])).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in values else F.col(c) for c in table.columns])


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds rows whose keys are new; of new rows that share keys, one."""
    new = rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(new)


def upsert_counts(table: DataFrame, deltas: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Adds summed deltas to counts, never below 0. Keys without a row get one."""
    sums = deltas.groupBy(*keys).agg(F.sum(count).alias("_d"))
    both = table.join(sums, list(keys), "full")
    return both.select(*keys, F.greatest(F.lit(0), F.coalesce(F.col(count), F.lit(0)) + F.coalesce("_d", F.lit(0))).alias(count))


def as_of(versions: DataFrame, at, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows valid at a time: start <= at < end, an open end being null."""
    t = at if isinstance(at, Column) else F.lit(at)
    return versions.filter((F.col(start) <= t) & (F.col(end).isNull() | (t < F.col(end))))


def scd2(changes: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Validity ranges and is_current from a history of changes."""
    w = Window.partitionBy(*keys).orderBy(at)
    end = F.lead(at).over(w)
    return changes.withColumn("valid_from", F.col(at)).withColumn("valid_to", end).withColumn("is_current", end.isNull())


def transaction_status(log: DataFrame, txn: str = "txn_id", kind: str = "type") -> DataFrame:
    """committed if begun and committed, else aborted: what recovery makes of a log."""
    flags = log.groupBy(txn).agg(F.max(F.col(kind) == "BEGIN").alias("_b"), F.max(F.col(kind) == "COMMIT").alias("_c"))
    return flags.select(txn, F.when(F.col("_b") & F.col("_c"), "committed").otherwise("aborted").alias("status"))


def visible_rows(versions: DataFrame, status: DataFrame, reader) -> DataFrame:
    """Rows that a transaction reads (read committed): made by a committed one or itself, not ended by a committed one or itself."""
    done = status.filter("status = 'committed'").select("txn_id")
    made = versions.join(done.withColumn("_m", F.lit(True)).withColumnRenamed("txn_id", "xmin"), "xmin", "left")
    both = made.join(done.withColumn("_e", F.lit(True)).withColumnRenamed("txn_id", "xmax"), "xmax", "left")
    seen = F.coalesce("_m", F.lit(False)) | (F.col("xmin") == reader)
    ended = F.col("xmax").isNotNull() & (F.coalesce("_e", F.lit(False)) | (F.col("xmax") == reader))
    return both.filter(seen & ~ended).select(*versions.columns)


def purge_deleted(table: DataFrame, at: Column, deleted_at: str, keep_hours: int = 24) -> DataFrame:
    """Hard-deletes rows that were soft-deleted longer ago than keep_hours."""
    return delete_where(table, F.col(deleted_at) < at - F.expr(f"INTERVAL {keep_hours} HOURS"))
