"""Shared pieces of the training-data operators: scratch tables and vectorised text scanning.

Texts are scanned straight from Arrow buffers with numpy. A *word* is a maximal run of bytes
other than 0x20 and 0x09-0x0D, which is ``[^\\x20\\x09-\\x0D]+`` on the text, since UTF-8
never uses those bytes inside a longer code point.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 1 << 20
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)
# while a scratch table is written: shuffle files go at the end, and the driver keeps no long descriptions of plans with tables in them
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "16384"}
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables of one run in the shared folder. They cut lineage and survive the loss of executors. writing: what the session is set to, besides, while a table is written."""

    def __init__(self, spark: SparkSession, writing: dict[str, str] | None = None):
        self.spark, self.root, self.writing = spark, f"{shared_dir(spark)}/lakeloom-{uuid.uuid4().hex}", WRITING | (writing or {})
        self.tables: dict[str, str] = {}  # names in the catalog of tables in buckets

    def save(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        """Writes a table, with the options of its format, and reads it again. The shuffle files of the write go when it ends."""
        path = f"{self.root}/{name}"
        self._write(lambda: df.write.options(**{"compression": "zstd"} | (options or {})).mode("overwrite").parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)

    def save_buckets(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """The same in as many buckets by a column as there are shuffle partitions: joins and groups by it don't move the table's rows again."""
        table, n = f"lakeloom_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._write(lambda: df.write.option("compression", "zstd").option("path", f"{self.root}/{name}").format("parquet").bucketBy(n, column).saveAsTable(table))
        self.tables[name] = table
        return self.spark.table(table)

    def _write(self, write) -> None:
        conf = self.spark.conf
        before = {key: conf.get(key, None) for key in self.writing}
        for key, value in self.writing.items():
            conf.set(key, value)
        try:
            write()
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            delete_file(self.spark, f"{self.root}/{name}")

    def drop_all(self) -> None:
        """For operators whose result no longer reads any table of the run."""
        delete_file(self.spark, self.root)


def delete_file(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, given as a URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_names(columns, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, in any case of letters."""
    taken, names = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class _Tables:
    """Powers of an odd base and of its inverse modulo 2**64, made once a process."""

    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None:
            cls.up = _powers(BASE, BLOCK_BYTES)
            cls.down = _powers(np.uint64(pow(int(BASE), -1, 1 << 64)), BLOCK_BYTES)
        return cls.up, cls.down


def text_blocks(column, block_bytes: int = BLOCK_BYTES):
    """Yields (first row, number of rows, buffer, row starts) of an Arrow string column.

    Each row's bytes are followed by one newline, so that no word reaches into the next row;
    row i is buffer[starts[i] : starts[i + 1] - 1]. Null counts as empty. A block has about
    block_bytes bytes, or one longer row.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_bytes, "right")) - 1)
        k, lo, hi = j - i, int(offsets[i]), int(offsets[j])
        starts = offsets[i : j + 1] - lo + np.arange(k + 1)
        if k == 1:
            buffer = np.append(data[lo:hi], np.uint8(10))
        else:
            buffer, raw_bytes = np.full(hi - lo + k, 10, np.uint8), memoryview(data)
            view = memoryview(buffer)
            for at, a, b in zip(starts[:-1].tolist(), offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True):
                view[at : at + b - a] = raw_bytes[a:b]
        yield i, k, buffer, starts
        i = j


def lower_ascii(buffer: np.ndarray) -> np.ndarray:
    return np.where((buffer >= 65) & (buffer <= 90), buffer | 32, buffer)


def find_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends in white space."""
    space = np.empty(len(buffer) + 1, bool)
    space[0] = True
    space[1:] = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def hash_words(buffer: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in pieces of at most BLOCK_BYTES."""
    out = np.empty(len(first), np.uint64)
    up, down = _Tables.get()
    i = 0
    while i < len(first):
        base = int(first[i])
        j = int(np.searchsorted(last, base + BLOCK_BYTES, "right"))
        if j <= i:  # one word longer than a block
            word = buffer[base : int(last[i])].tobytes()
            out[i] = np.uint64(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
            i += 1
            continue
        piece = buffer[base : int(last[j - 1])].astype(np.uint64)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece + np.uint64(1)) * up[: len(piece)], out=total[1:])
        s, e = first[i:j] - base, last[i:j] - base
        out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that start at each word; the last k - 1 entries are missing."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    sizes, level, width = [], words, 1
    levels = {1: words}
    while width * 2 <= k:
        level = level[:-width] * np.uint64(pow(int(M2), width, 1 << 64)) + level[width:]
        width *= 2
        levels[width] = level
    have, done, n = None, 0, len(words) - k + 1
    sizes = [w for w in sorted(levels, reverse=True) if k & w]
    for w in sizes:
        part = levels[w][done : done + n]
        have = part if have is None else have * np.uint64(pow(int(M2), w, 1 << 64)) + part
        done += w
    return mix64(have)


def spans_of(starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For row starts in a buffer, the index of each row's first word; the number of words at the end."""
    return np.searchsorted(first, starts)
