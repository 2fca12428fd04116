"""Exact substring de-duplication on bytes, by merging Burrows-Wheeler transforms of shards.

A repeat is a string of ``window`` bytes that also starts at another place of the corpus, in the same document or
another; matches never cross documents. All bytes that a repeat covers go.

1. *Buckets of suffixes.* Each window's anchor is the least hash of its inner ``gram``-byte strings. Equal windows have equal
   anchors, so a window whose anchor has one place in the whole corpus is unique. What is left are the runs (up to
   ``window - gram + 1`` neighbouring windows) of anchors that occur more than once; equal runs are one, with a count. A run
   with a twin is a repeat as it stands; the others go to the transforms, with all distinct runs of their anchors.
2. *Shards.* Anchors are put into buckets by running sums of their bytes, so that no bucket has more than ``BUCKET_BYTES`` and one anchor, and a bucket's runs
   are dealt to shards. Each shard's suffixes are sorted by itself and kept as its transform: the byte before each suffix, in the suffixes' order. Runs end in a byte of their own.
3. *Merging.* A bucket's shards are interleaved by refinement. At depth h every suffix has the number of its block, the suffixes that share its first h bytes. From
   a transform alone follows which suffix comes one byte later (a stable count of its symbols), hence h bytes later by composition. So a suffix has as key its block and the block h bytes later: in each
   shard, keys ascend already, and merging the shards' ascending keys gives the interleave and the blocks of depth 2 h. No suffix is sorted again. A
   block boundary's depth is the common prefix of the suffixes beside it; blocks of depth ``window`` with two suffixes or more are the repeated intervals.

No task holds a passage's copies: equal runs meet in aggregations. An anchor around which the distinct runs exceed ``BLOCK_BYTES`` is
split: its windows are told apart by the place of the anchor in them, in ever narrower ranges, and by the bytes that all windows of a range
share, until what is left fits; at the narrowest range only equal windows remain.

Defined results: null text has no bytes; texts shorter than ``window`` lose nothing; equal texts are places of their own (both lose their
bytes); null ids stay; columns beyond doc_id and text are ignored. A text may have any length; one task holds it whole, with about 40 bytes
for each of its bytes in pieces of 256 KB, and some 20 for the rest. Texts are told equal by two 64-bit hashes, runs by one and their anchor's.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, gram_hashes, text_blocks

WINDOW, GRAM = 200, 48
BUCKET_BYTES, BLOCK_BYTES, SHARDS = 1 << 20, 1 << 20, 4
BATCH_BYTES = 8 << 20
# readers hold a row group at once, and a row of transforms has megabytes
SMALL_GROUPS = {"parquet.block.size": str(BATCH_BYTES), "parquet.page.size.row.check.min": "1"}
PIECE, PLACE_BITS = 1 << 18, 21


# ---- runs of windows around repeated anchors


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, from running minima of pieces."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left, right = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors_of(buffer: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window that starts at each byte, and its place: the first of the least ones by the upper bits of their hashes."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in range(0, max(len(buffer) - window + 1, 0), PIECE):
        grams = gram_hashes(buffer[i : i + PIECE + window - 1].astype(np.uint64) + np.uint64(1), gram)
        place = (_least(grams & ~low | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & low).astype(np.int64)
        found.append(grams[place])
        places.append(place + i)
    return np.concatenate(found), np.concatenate(places)


def runs_of(buffer: np.ndarray, starts: np.ndarray, window: int, gram: int):
    """(text, first window, windows, anchor, whether at one place) of the runs of all texts of a block: neighbouring windows with one anchor, cut at the most that one place of an anchor can have."""
    (anchors, places), most = anchors_of(buffer, window, gram), window - gram + 1
    n = len(anchors)
    edge = np.zeros(n + 1, np.int64)
    begin, end = starts[:-1], starts[1:] - window  # a text's last window begins one before end
    some = begin < end
    np.add.at(edge, begin[some], 1)
    np.add.at(edge, end[some], -1)
    valid = np.cumsum(edge[:n]) > 0
    change = np.ones(n + 1, bool)
    change[1:n] = (anchors[1:] != anchors[:-1]) | (valid[1:] != valid[:-1])
    change[begin[some]] = True
    heads = np.flatnonzero(change)
    sizes, heads = np.diff(heads), heads[:-1]
    heads, sizes = heads[valid[heads]], sizes[valid[heads]]
    parts = -(-sizes // most)
    at = np.repeat(np.arange(len(heads)), parts)
    k = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    first, size = heads[at] + k * most, np.minimum(most, sizes[at] - k * most)
    text = np.searchsorted(starts, first, "right") - 1
    return text, first - starts[text], size, anchors[first], places[first] == places[first + size - 1]


def _scan(window: int, gram: int):
    import pyarrow as pa

    def scan(batches):
        for batch in batches:
            for i, _, buffer, starts in text_blocks(batch.column("text"), PIECE):
                text, first, size, anchor, one = runs_of(buffer, starts, window, gram)
                for a in range(0, len(text), 200_000):
                    cut = slice(a, a + 200_000)
                    at = pa.array(text[cut] + i)
                    yield pa.RecordBatch.from_pydict({
                        "h1": batch.column("h1").take(at), "h2": batch.column("h2").take(at), "anchor": pa.array(anchor[cut].view(np.int64)), "first": pa.array(first[cut].astype(np.int32)), "size": pa.array(size[cut].astype(np.int16)), "places": pa.array(np.where(one[cut], 1, 2).astype(np.int16)),
                    })

    return scan


def _extract(window: int):
    """The bytes of the runs that texts carry."""
    import pyarrow as pa

    def scan(batches):
        for batch in batches:
            runs = batch.column("runs")
            offsets, rows = np.asarray(runs.offsets), runs.flatten()
            offsets = offsets - offsets[0]
            anchor, first, size = (rows.field(c) for c in ("anchor", "first", "size"))
            firsts, sizes = np.asarray(first), np.asarray(size)
            for i, k, buffer, starts in text_blocks(batch.column("text"), PIECE):
                a, b = int(offsets[i]), int(offsets[i + k])
                text = np.repeat(np.arange(i, i + k), np.diff(offsets[i : i + k + 1]))
                at = starts[text - i] + firsts[a:b]
                view = buffer.tobytes()
                for c in range(0, b - a, 50_000):
                    d = min(c + 50_000, b - a)
                    own = pa.array(text[c:d])
                    data = [view[x : x + s + window - 1] for x, s in zip(at[c:d].tolist(), sizes[a + c : a + d].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "h1": batch.column("h1").take(own), "h2": batch.column("h2").take(own), "anchor": anchor.slice(a + c, d - c), "first": first.slice(a + c, d - c), "size": size.slice(a + c, d - c), "data": pa.array(data, pa.binary()),
                    })

    return scan


def _split(window: int, gram: int, width: int):
    """Pieces of runs: windows in which the anchor's first place is in one range of the given width."""
    import pyarrow as pa

    kinds = {"block": pa.int64(), "run": pa.int64(), "at": pa.int32(), "anchor": pa.int64(), "key": pa.int64(), "data": pa.binary()}

    def scan(batches):
        for batch in batches:
            out, held = {c: [] for c in kinds}, 0
            for block, run, anchor, data in zip(*(batch.column(c) for c in ("block", "run", "anchor", "data")), strict=True):
                block, run, anchor, data = block.as_py(), run.as_py(), anchor.as_py(), data.as_py()
                n = len(data) - window + 1
                _, place = anchors_of(np.frombuffer(data, np.uint8), window, gram)
                group = (place - np.arange(n)) // width
                cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (group[1:] != group[:-1])) + 1).tolist(), n]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    c = int(group[a])
                    low = int(place[a]) - c * width  # the bytes from here on are in all windows of the range
                    shared = data[low : low + window - width + 1]
                    key = hashlib.blake2b(b"%d,%d,%d," % (anchor, width, c) + shared, digest_size=8).digest()
                    for name, x in zip(out, (block, run, a, anchor, int.from_bytes(key, "little", signed=True), data[a : b + window - 1]), strict=True):
                        out[name].append(x)
                    held += b - a + window - 1
                if held > PIECE:  # at narrow ranges a run has a piece for each window
                    yield pa.RecordBatch.from_pydict({c: pa.array(out[c], kind) for c, kind in kinds.items()})
                    out, held = {c: [] for c in kinds}, 0
            yield pa.RecordBatch.from_pydict({c: pa.array(out[c], kind) for c, kind in kinds.items()})

    return scan


# ---- transforms


def transform(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform of runs, each ended by a symbol of its own: the symbol before each suffix (0: an end, else byte + 1), the suffixes' places, the runs' starts.

    Suffixes are sorted as rotations of their run, by doubling."""
    sizes = np.asarray([len(r) + 1 for r in runs], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(starts[-1])
    text = np.zeros(n, np.int64)
    for r, at in zip(runs, starts[:-1].tolist(), strict=True):
        text[at : at + len(r)] = np.frombuffer(r, np.uint8)
        text[at : at + len(r)] += 1
    after = np.arange(1, n + 1)
    after[starts[1:] - 1] = starts[:-1]
    two, on = text * 257 + text[after], after[after]
    rank, depth = (two * 257**2 + two[on]) * 257**2 + two[on[on]], 6
    after = on[on[on]]
    longest = int(sizes.max(initial=1))
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else order
        if n == 0 or depth >= 2 * longest or rank[order[-1]] == n - 1:
            break
        rank = rank * n + rank[after]
        after, depth = after[after], depth * 2
    before = np.arange(-1, n - 1)
    before[starts[:-1]] = starts[1:] - 1
    return text[before[order]].astype(np.int16), order.astype(np.int32), starts


def _interleave(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges ascending pieces of keys: the merged order, each key's block number, and whether a block begins at each place of the order."""
    order = np.argsort(keys, kind="stable")  # a natural merge sort: ascending pieces are merged, not sorted
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    del ordered
    number = np.cumsum(fresh, dtype=np.int32)
    number -= 1
    names = np.empty(len(keys), np.int32)
    names[order] = number
    return order.astype(np.int32), names, fresh


def merge(transforms: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleaves transforms by refinement up to the depth of a window.

    The merged order of all suffixes (numbered shard by shard, in each shard's order), each suffix's block at that depth, and for
    each place of the order the greatest depth up to which the blocks were seen to be one with the place before.

    Numbers of suffixes take four bytes, since several workers share an executor; only a step's keys take eight."""
    base, n = 0, sum(map(len, transforms))
    jump, keys, ends = np.empty(n, np.int32), np.empty(n, np.int64), 0
    for t in transforms:
        step = np.argsort(t, kind="stable")  # the suffix that begins one byte later
        jump[base : base + len(t)] = step
        jump[base : base + len(t)] += base
        first = t[step]
        stops = int(np.searchsorted(first, 0, "right"))
        keys[base : base + stops] = np.arange(ends, ends + stops)  # each end is a symbol of its own
        keys[base + stops : base + len(t)] = first[stops:]
        keys[base + stops : base + len(t)] += n
        base, ends = base + len(t), ends + stops
        del step, first
    order, names, fresh = _interleave(keys)
    common = np.where(fresh, 0, window).astype(np.int16 if window < 1 << 15 else np.int64)
    depth, top = 1, 1 << (window.bit_length() - 1)
    rest = {1 << b for b in range(window.bit_length() - 1) if (window - top) >> b & 1}
    known = {}  # what the last steps, from the greatest power of two to the window, need again
    for width in [1 << b for b in range(window.bit_length() - 1)] + sorted(rest, reverse=True):
        if depth in rest and depth < top:
            known[depth] = names, jump
        part, on = (names, jump) if depth < top else known[width]
        np.multiply(names, n, out=keys, dtype=np.int64)
        keys += part[jump]
        del order, names, part
        order, names, fresh = _interleave(keys)
        jump = on[jump]
        common[fresh & (common == window)] = depth
        depth += width
    return order, names, common


def repeated_windows(shards: list[tuple[np.ndarray, np.ndarray]], window: int) -> list[np.ndarray]:
    """For shards (transform, places): whether the window from each place of the shard's text also starts elsewhere in the bucket."""
    _, names, _ = merge([t for t, _ in shards], window)
    twice = np.bincount(names, minlength=1)[names] > 1
    out, base = [], 0
    for t, places in shards:
        marks = np.empty(len(t), bool)
        marks[places] = twice[base : base + len(t)]
        out.append(marks)
        base += len(t)
    return out


def _build(table):
    import pyarrow as pa

    symbols, places, starts = transform(table.column("data").to_pylist())
    lists = [pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("block", "run")]
    return pa.table({
        "bucket": table.column("bucket").slice(0, 1), "block": lists[0], "run": lists[1], "starts": pa.array([starts.astype(np.int32).tobytes()]), "symbols": pa.array([symbols.tobytes()]), "places": pa.array([places.tobytes()]),
    })


def _merge_bucket(window: int):
    import pyarrow as pa

    def merged(table):
        read = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]
        shards = list(zip(read("symbols", np.int16), read("places", np.int32), strict=True))
        blocks, runs, first, last = [], [], [], []
        for marks, starts, block, run in zip(repeated_windows(shards, window), read("starts", np.int32), table.column("block").to_pylist(), table.column("run").to_pylist(), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
            a, b = edges[0::2], edges[1::2] - 1  # never across an end, which is in no repeated window
            own = np.searchsorted(starts, a, "right") - 1
            blocks.append(np.asarray(block, np.int64)[own])
            runs.append(np.asarray(run, np.int64)[own])
            first.append(a - starts[own])
            last.append(b - starts[own])
        return pa.table({"block": np.concatenate(blocks), "run": np.concatenate(runs), "i": np.concatenate(first).astype(np.int32), "j": np.concatenate(last).astype(np.int32)})

    return merged


# ---- the corpus


def _buckets(sizes: DataFrame, total: int, limits: tuple[int, int]) -> DataFrame:
    """block, bytes and the bucket of blocks (block, bytes) of so many bytes at most in all: a bucket has less than both limits together. The bucket is null for blocks that are too large.

    Blocks are dealt to parts of some 4 buckets by hash, and a part's blocks to buckets by the bytes that come before them, large blocks first. Buckets
    by hash alone have no bound: the more of them, the more large blocks meet in one."""
    fits = F.col("bytes") <= limits[1]
    parts = sizes.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(total // (4 * limits[0]) + 1)))
    before = F.sum(F.when(fits, F.col("bytes"))).over(Window.partitionBy("part").orderBy(fits.desc(), F.col("bytes").desc(), "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    return parts.select("block", "bytes", F.when(fits, F.shiftleft("part", 32) + F.floor(before / limits[0])).alias("bucket"))


def _repeats(spark: SparkSession, runs: DataFrame, scratch: Scratch, window: int, gram: int, width: int, limits: tuple[int, int]) -> DataFrame:
    """block, run, i, j: the repeated windows, first to last, of distinct runs (block, run, anchor, copies, data)."""
    twins = runs.filter("copies > 1").select("block", "run", F.lit(0).alias("i"), (F.length("data") - window).alias("j"))
    sizes = runs.groupBy("block").agg(F.sum(F.length("data")).alias("bytes"), F.min("copies").alias("least")).filter("least = 1")
    total = runs.agg(F.sum(F.length("data"))).first()[0] or 0
    several = scratch.save(runs.join(_buckets(sizes.select("block", "bytes"), total, limits), "block"), f"several-{width}")
    dealt = several.filter("bucket is not null").select("bucket", F.pmod(F.xxhash64("run"), F.lit(SHARDS)).cast("int").alias("shard"), "block", "run", "data")
    shards = dealt.groupBy("bucket", "shard").applyInArrow(_build, "bucket long, block array<long>, run array<long>, starts binary, symbols binary, places binary")
    shards = scratch.save(shards, f"transforms-{width}", SMALL_GROUPS)
    found = twins.unionByName(shards.groupBy("bucket").applyInArrow(_merge_bucket(window), "block long, run long, i int, j int"))
    large = several.filter("bucket is null")
    if width > 1 and not large.isEmpty():
        width = -(-width // 2)
        pieces = large.select("block", "run", "anchor", "data").mapInArrow(_split(window, gram, width), "block long, run long, at int, anchor long, key long, data binary")
        pieces = scratch.save(pieces.withColumn("piece", F.xxhash64("data")), f"pieces-{width}")
        distinct = scratch.save(pieces.groupBy(F.col("key").alias("block"), F.col("piece").alias("run"), "anchor").agg(F.count("*").alias("copies"), F.any_value("data").alias("data")), f"distinct-{width}")
        inner = _repeats(spark, distinct, scratch, window, gram, width, limits).withColumnsRenamed({"block": "key", "run": "piece"})
        found = found.unionByName(pieces.join(inner, ["key", "piece"]).select("block", "run", (F.col("at") + F.col("i")).alias("i"), (F.col("at") + F.col("j")).alias("j")))
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def duplicate_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, limits: tuple[int, int] = (BUCKET_BYTES, BLOCK_BYTES)) -> DataFrame:
    """h1, h2 (hashes of a text), spans: first and last of neighbouring windows that are repeats."""
    texts = _keyed(docs).drop("doc_id")
    places = scratch.save(texts.mapInArrow(_scan(window, gram), "h1 long, h2 long, anchor long, first int, size smallint, places smallint"), "places")
    # a table of its own: so a hot anchor's places, on the other side of the join, can be split
    indexed = scratch.save(places.groupBy("anchor").agg(F.sum("places").alias("n")).filter("n > 1").select("anchor"), "index")
    found = scratch.save(places.join(indexed, "anchor", "left_semi").groupBy("h1", "h2").agg(F.collect_set(F.struct("anchor", "first", "size")).alias("runs")), "found")
    scratch.drop("places", "index")
    runs = texts.join(found, ["h1", "h2"]).select("h1", "h2", "text", "runs").mapInArrow(_extract(window), "h1 long, h2 long, anchor long, first int, size smallint, data binary")
    runs = scratch.save(runs.withColumn("run", F.xxhash64("data")), "runs")
    distinct = scratch.save(runs.groupBy("anchor", "run").agg(F.count("*").alias("copies"), F.any_value("data").alias("data")), "distinct")
    scratch.drop("found")
    distinct = distinct.withColumn("block", F.col("anchor"))
    repeats = scratch.save(_repeats(spark, distinct, scratch, window, gram, window - gram + 1, limits), "repeats").withColumnRenamed("block", "anchor")
    spans = runs.select("h1", "h2", "anchor", "run", "first").join(repeats, ["anchor", "run"])
    spans = spans.groupBy("h1", "h2").agg(F.collect_set(F.struct((F.col("first") + F.col("i")).alias("first"), (F.col("first") + F.col("j")).alias("last"))).alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.drop("runs", "distinct", "repeats")
    return spans


def _cut(window: int, keep_bytes: bool):
    """Removes the bytes that the spans cover."""
    import pyarrow as pa

    def scan(batches):
        for batch in batches:
            spans = batch.column("spans")
            sizes = np.asarray(spans.value_lengths().fill_null(0))
            offsets, rows = np.concatenate([[0], np.cumsum(sizes)]), spans.flatten()
            first, last = (np.asarray(rows.field(c)).astype(np.int64) for c in ("first", "last"))
            out, held, at = [], 0, []

            def flush(batch=batch, out=out, at=at):
                columns = {"doc_id": batch.column("doc_id").take(pa.array(at, pa.int64()))}
                for i, c in enumerate(("n_bytes", "n_removed", "n_spans")):
                    columns[c] = pa.array([r[i] for r in out], pa.int64())
                columns["kept_sha256"] = pa.array([r[3] for r in out], pa.string())
                if keep_bytes:
                    columns["kept"] = pa.array([r[4] for r in out], pa.binary())
                out.clear()
                at.clear()
                return pa.RecordBatch.from_pydict(columns)

            for i, k, buffer, starts in text_blocks(batch.column("text"), PIECE):
                edge = np.zeros(len(buffer) + 1, np.int32)
                a, b = int(offsets[i]), int(offsets[i + k])
                begin = np.repeat(starts[:-1], sizes[i : i + k])
                np.add.at(edge, begin + first[a:b], 1)
                np.add.at(edge, begin + last[a:b] + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                opens = np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))])  # no run crosses the byte between texts
                taken = np.concatenate([[0], np.cumsum(gone)])
                for r in range(k):
                    x, y = int(starts[r]), int(starts[r + 1]) - 1
                    kept = buffer[x:y] if taken[y] == taken[x] else buffer[x:y][~gone[x:y]]
                    kept = kept.tobytes()
                    out.append((y - x, int(taken[y] - taken[x]), int(opens[y] - opens[x]), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
                    at.append(i + r)
                    held += len(kept) * keep_bytes
                if held > 1 << 24:
                    held = 0
                    yield flush()
            if out:
                yield flush()

    return scan


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_bytes: bool = True, limits: tuple[int, int] = (BUCKET_BYTES, BLOCK_BYTES)) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (removed stretches), kept_sha256 and, with keep_bytes, the bytes kept (a cut may fall inside a character)."""
    if not 1 < gram < window:
        raise ValueError("gram must be shorter than window")
    scratch = Scratch(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)})  # whole texts go to Python
    spans = duplicate_spans(spark, docs, scratch, window, gram, limits)
    both = _keyed(docs).join(spans, ["h1", "h2"], "left").select("doc_id", "text", "spans")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_cut(window, keep_bytes), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
