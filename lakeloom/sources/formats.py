"""Files as tables: Parquet, ORC, CSV and JSON, and partitioned folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder under the shared one. Where that is not set, a temporary one, which only a local session can use."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/lakeloom-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="lakeloom-")


def read_files(spark: SparkSession, path: str | Sequence[str], format: str = "parquet", schema=None, merge: bool = False, **options) -> DataFrame:
    """Files or globs of any built-in format. CSV and JSON want a schema: it is not inferred. merge: columns added later are null in older files."""
    if schema is None and format in ("csv", "json"):
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    if merge:
        reader = reader.option("mergeSchema", "true")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_files(df: DataFrame, path: str, format: str = "parquet", by: Sequence[str] = (), sort: Sequence[str] = (), rows_per_file: int = 0, **options) -> None:
    """Writes a folder. by: partition columns, each partition written by few tasks; sort: order inside files, which makes their statistics narrow."""
    if by:
        df = df.repartition(*by)
    if sort:
        df = df.sortWithinPartitions(*by, *sort)
    writer = df.write.format(format).mode("overwrite").options(**options)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*by) if by else writer).save(path)


def from_memory(spark: SparkSession, data, name: str | None = None) -> DataFrame:
    """A pandas frame or Arrow table as a table, with a view of that name if asked for."""
    df = spark.createDataFrame(data)
    if name:
        df.createOrReplaceTempView(name)
    return df


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """Rewrites a folder's small files as so many."""
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(target)
