"""Best-fit packing planned on the histogram of lengths.

Pieces have 1 to ``capacity`` tokens, so their histogram has at most ``capacity`` rows, whatever
the corpus. Best-fit decreasing runs over those counts: lengths from long to short, each put into
the open bins with the least room that still holds it, as often as it fits. Bins of one kind are
kept as one run of numbers, and a run is split at most twice for a length, so the plan has at
most three runs a length and each run is used at most log2(capacity) times: a proven bound on
what is planned on the driver and broadcast.

A plan entry gives the ranks (within a length) that it places, its first bin, how many of them
share a bin, and the offset of the first. Documents get their rank within their length from the
counts of the tasks before theirs, and take their slots by joining with the plan on rank.

Tokens are made word by word with a cache of bounded memory, as arrays: the tokenizer never joins what
white space separates, so a text's ids are its words' ids in order. Words are told apart in the
cache by 64-bit hash and length.

Defined results: null text is empty, which is one piece with the end token alone; a text of
exactly ``capacity`` tokens is one piece; repeated rows are packed each.
"""

from __future__ import annotations

import bisect
import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import Scratch, find_words, hash_words, spans_of, text_blocks

CAPACITY, END = 4096, 1
SLOTS, POOL_IDS = 1 << 20, 1 << 22


class WordTokenizer:
    """Ids of whole texts by the tokenizer of a file.

    Words are looked up by their 64-bit hash and length in a table of fixed size: each has two slots, and a new one takes
    the place of another word if both are taken. Their ids stand one after the other in a pool. When it is over POOL_IDS,
    table and pool start anew, so that memory is bounded by that and one block's words, whatever their length. A worker
    process keeps them from task to task.
    """

    of_path: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        if path not in cls.of_path:
            cls.of_path[path] = cls(path)
        return cls.of_path[path]

    def _clear(self) -> None:
        self.hashes, self.sizes = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.starts, self.counts = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def _add(self, ids: np.ndarray) -> int:
        """The place of new ids in the pool."""
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def ids(self, buffer: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of a buffer, and where each word's begin (the total at the end)."""
        if self.used > POOL_IDS:
            self._clear()
        h, size = hash_words(buffer, first, last), last - first
        one, two = (h & np.uint64(SLOTS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)
        in_one = (self.hashes[one] == h) & (self.sizes[one] == size)
        slot = np.where(in_one, one, two)
        known = in_one | ((self.hashes[two] == h) & (self.sizes[two] == size))
        start, count = self.starts[slot], self.counts[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            values, place, which = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[place]
            raw = buffer.tobytes()
            encoded = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)], add_special_tokens=False)
            lists = [e.ids for e in encoded]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            begin = self._add(np.fromiter(itertools.chain.from_iterable(lists), "<u4", int(counts.sum()))) + np.cumsum(counts) - counts
            into = np.where(self.sizes[one[at]] == 0, one[at], two[at])
            self.hashes[into], self.sizes[into], self.starts[into], self.counts[into] = values, size[at], begin, counts
            start[new], count[new] = begin[which], counts[which]
        ends = np.cumsum(count)
        begins = np.concatenate([[0], ends])
        return self.pool[np.arange(begins[-1]) + np.repeat(start - begins[:-1], count)], begins


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    import pyarrow as pa

    def scan(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, tokenizer, rank_of = TaskContext.get().partitionId(), WordTokenizer.get(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for i, k, buffer, starts in text_blocks(batch.column("text")):
                first, last = find_words(buffer)
                ids, begins = tokenizer.ids(buffer, first, last)
                ends = begins[spans_of(starts, first)]
                # each document's ids and its end token
                ids = np.insert(ids, ends[1:], end).astype("<u4")
                ends = ends + np.arange(k + 1)
                total = np.diff(ends)
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(k), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, total[doc] - start)
                raw, lo = memoryview(ids.view(np.uint8)), (ends[doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + length * 4).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                _, at, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(at, many)
                rank += rank_of[length]
                rank_of[length[order][at]] += many
                out = {
                    "doc_id": batch.column("doc_id").take(pa.array(doc + i)), "task": pa.array(np.full(len(doc), task, np.int32)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                    "length": pa.array(length.astype(np.int32)), "ids_crc32": pa.array(crc, pa.int64()), "task_rank": pa.array(rank),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(ends[doc] + start, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return scan


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Entries (length, rank_from, rank_to, first_bin, per_bin, offset) and the number of bins; best-fit decreasing over counts."""
    rooms: list[int] = []  # sorted; runs[room]: runs of bins with that room, as (first bin, bins)
    runs: dict[int, list[tuple[int, int]]] = {}
    plan, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, total = 0, histogram[length]
        while rank < total:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                each = capacity // length
                room, first, n = capacity, bins, -(-(total - rank) // each)
                bins += n
            each = room // length
            used = min(total - rank, n * each)
            full, left = divmod(used, each)
            plan.append((length, rank, rank + used, first, each, capacity - room))
            put(room - each * length, first, full)
            if left:
                put(room - left * length, first + full, 1)
            put(room, first + full + bool(left), n - full - bool(left))
            rank += used
    return plan, bins


PLAN = T.StructType([T.StructField(c, T.LongType() if c != "length" else T.IntegerType(), False) for c in ("length", "rank_from", "rank_to", "first_bin", "per_bin", "at")])


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with_ids, ids: one row for each piece."""
    scratch = Scratch(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, task int, piece int, start long, length int, ids_crc32 long, task_rank long" + ", ids array<int>" * with_ids
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity, end, with_ids), schema), "pieces")
    return place_pieces(spark, pieces, scratch, capacity)


def place_pieces(spark: SparkSession, pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset. pieces: stored rows with length, task and task_rank (the rank among the task's rows of that length)."""
    from pyspark.sql import Window

    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.save(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_bins(histogram, capacity)
    slots = F.broadcast(spark.createDataFrame(plan, PLAN).withColumnRenamed("length", "l"))
    ranked = pieces.join(counts.select("length", "task", "before"), ["length", "task"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("task_rank"))
    placed = ranked.join(slots, (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    step = F.col("rank") - F.col("rank_from")
    sequence = F.col("first_bin") + F.expr("(rank - rank_from) div per_bin")
    offset = F.col("at") + F.pmod(step, F.col("per_bin")) * F.col("length")
    keep = [c for c in pieces.columns if c not in ("task", "task_rank", "length")]
    return placed.select(*keep, F.col("length").cast("long").alias("length"), sequence.alias("sequence_id"), offset.cast("long").alias("offset"))
