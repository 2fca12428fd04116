"""Rows of a stream's batches that wait beside a table and are merged into it together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.sources.versioned import LogFolder


class Held:
    """The rows of batches that a table has not taken yet, one folder a batch.

    A batch writes its own rows only. It is named by its number, so one that runs again replaces itself. The table takes what is held when that is
    as many batches as it took before (``least`` at first): its merges double their reach, so all of them together
    read and write a few times the rows, however many batches bring these. Which batches were taken is told by the table."""

    def __init__(self, spark: SparkSession, root: str, least: int = 16):
        self.spark, self.root, self.least, self.folder = spark, root, least, LogFolder(spark, root)

    def put(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{number}")

    def due(self, number: int, taken: int) -> bool:
        return number - taken >= max(self.least, taken + 1)

    def numbers(self, taken: int, upto: int | None = None) -> list[int]:
        """The batches after one, up to one, that are whole."""
        found = self.folder.files.globStatus(self.folder.hadoop.fs.Path(f"{self.root}/*/_SUCCESS")) or []
        numbers = (int(s.getPath().getParent().getName()) for s in found)
        return sorted(n for n in numbers if n > taken and (upto is None or n <= upto))

    def read(self, numbers: list[int], schema) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{n}" for n in numbers))
