"""Substring de-duplication by relative Lempel-Ziv parsing against blocks of an elected-anchor index.

A repeat is a run of ``window`` words that also starts at another place of the corpus.

1. *Index.* Each window elects the rarest-looking of its inner ``gram``-word phrases (the
   smallest hash, leftmost on ties) as its anchor. Equal windows elect equal anchors, so a
   window whose anchor occurs once in the whole corpus is certainly unique. Anchors are
   counted over all documents; what is left are the phrases that the reference is indexed by.
2. *Reference blocks.* The windows around one indexed anchor form a run, of at most ``window - gram + 1``
   windows. All runs of one anchor are its block; equal runs of a block are one reference. The block's
   index has, for each window, the first and the last place (reference, offset) at which it occurs.
3. *Parsing.* Every reference is factored against its whole block, from left to right: at each window the
   places of the index other than its own are followed as long as the next window stands at
   the next place too, and the one that goes on longest becomes a factor. A factor has at least one window, so at
   least ``window`` words; a window without another place is skipped as a literal. The window after a factor's last
   is looked up anew, so words on both sides of a factor's boundary are judged by every window that spans
   it. A run that has a twin is one factor as it stands.
4. The factors of all runs of a document are united; covered words go.

A block may be as large as its passage is frequent, so no task ever holds one: its index is an
aggregation, and what is parsed by itself is one reference with the places of its own few windows. The
text itself is never sent along with anchors: only hashes travel, and the documents are joined
with their spans at the end.

Defined results: null text has no words; texts with fewer than ``window`` words lose nothing;
identical rows are places of their own (both lose their repeats); null ids are kept; columns
beyond doc_id and text are ignored; a text may have any length, and is held whole by one task with about 60 bytes
for each byte. Windows are equal if the 64-bit hashes of both the anchor and the window are.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, find_words, gram_hashes, hash_words, spans_of, text_blocks

WINDOW, GRAM = 35, 8
MAX = np.int64((1 << 63) - 1)


def _elect(grams: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the smallest of width consecutive hashes, leftmost on ties."""
    at, n, span = np.arange(len(grams)), len(grams) - width + 1, 1
    while span * 2 <= width:
        a, b = at[: len(at) - span], at[span:]
        at = np.where(grams[a] <= grams[b], a, b)
        span *= 2
    a, b = at[:n], at[width - span : width - span + n]
    return np.where(grams[a] <= grams[b], a, b)


def runs_of(words: np.ndarray, window: int, gram: int):
    """(anchor hash, first window, last window) of each run of one document's word hashes."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_hashes(words, gram)
    place = _elect(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    return grams[place[first]], first, last


def _documents(batch):
    """(row, word hashes, buffer, word starts, word ends) of each text of an Arrow batch."""
    for i, k, buffer, starts in text_blocks(batch.column("text")):
        first, last = find_words(buffer)
        hashes, at = hash_words(buffer, first, last), spans_of(starts, first)
        for r in range(k):
            a, b = at[r], at[r + 1]
            yield i + r, hashes[a:b], buffer, first[a:b], last[a:b]


def _anchors(window: int, gram: int, places: bool):
    import pyarrow as pa

    def scan(batches):
        for batch in batches:
            rows, anchors, firsts, lasts = [], [], [], []

            def flush(batch=batch, rows=rows, anchors=anchors, firsts=firsts, lasts=lasts):
                columns = {"anchor": pa.array(np.concatenate(anchors).view(np.int64))}
                if places:
                    at = pa.array(np.repeat([r for r, _ in rows], [n for _, n in rows]))
                    columns = {"doc_id": batch.column("doc_id").take(at), "th": batch.column("th").take(at)} | columns
                    columns |= {"first": pa.array(np.concatenate(firsts).astype(np.int32)), "last": pa.array(np.concatenate(lasts).astype(np.int32))}
                for x in (rows, anchors, firsts, lasts):
                    x.clear()
                return pa.RecordBatch.from_pydict(columns)

            held = 0
            for row, words, *_ in _documents(batch):
                anchor, first, last = runs_of(words, window, gram)
                if len(anchor):
                    rows.append((row, len(anchor)))
                    anchors.append(anchor)
                    firsts.append(first)
                    lasts.append(last)
                    held += len(anchor)
                if held > 200_000:
                    held = 0
                    yield flush()
            if held:
                yield flush()

    return scan


def _run_hashes(window: int):
    """For documents with their indexed runs: a row for each run, with the hashes of its windows."""
    import pyarrow as pa

    def scan(batches):
        for batch in batches:
            runs = batch.column("runs")
            rows, heads, firsts, lists = [], [], [], []
            held = 0

            def flush(batch=batch, rows=rows, heads=heads, firsts=firsts, lists=lists):
                at = pa.array(np.asarray(rows, np.int64))
                sizes = np.asarray([len(x) for x in lists], np.int64)
                values = np.concatenate(lists)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                keys = np.asarray([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in lists], np.int64)
                out = pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(at), "th": batch.column("th").take(at), "anchor": pa.array(np.asarray(heads, np.int64)), "run": pa.array(keys), "first": pa.array(np.asarray(firsts, np.int32)),
                    "windows": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64))),
                })
                for x in (rows, heads, firsts, lists):
                    x.clear()
                return out

            for row, words, *_ in _documents(batch):
                hashes = gram_hashes(words, window)
                for run in runs[row].as_py():
                    rows.append(row)
                    heads.append(run["anchor"])
                    firsts.append(run["first"])
                    lists.append(hashes[run["first"] : run["last"] + 1])
                    held += len(lists[-1])
                if held > 200_000:
                    held = 0
                    yield flush()
            if rows:
                yield flush()

    return scan


def _cut(window: int, text: bool):
    """Removes the words that the spans (first and last window) cover."""
    import pyarrow as pa

    def scan(batches):
        for batch in batches:
            spans = batch.column("spans")
            rows, n_words, n_removed, digests, texts, held = [], [], [], [], [], 0

            def flush(batch=batch, rows=rows, n_words=n_words, n_removed=n_removed, digests=digests, texts=texts):
                columns = {"doc_id": batch.column("doc_id").take(pa.array(np.asarray(rows, np.int64))), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
                if text:
                    columns["text"] = pa.array([x.decode() for x in texts], pa.string())
                out = pa.RecordBatch.from_pydict(columns)
                for x in (rows, n_words, n_removed, digests, texts):
                    x.clear()
                return out

            for i, k, buffer, starts in text_blocks(batch.column("text")):
                first, last = find_words(buffer)
                at = spans_of(starts, first)
                drop = np.zeros(len(first) + 1, np.int64)
                for r in range(k):
                    for span in spans[i + r].as_py() or ():
                        drop[at[r] + span["first"]] += 1
                        drop[at[r] + span["last"] + window] -= 1
                keep = np.cumsum(drop[:-1]) == 0
                edge = np.zeros(len(buffer) + 1, np.int8)
                edge[first[keep]] += 1
                edge[last[keep] + 1] -= 1
                take = np.cumsum(edge[:-1]).astype(bool)  # each kept word and the white space after it
                clean = buffer.copy()
                clean[last] = 32
                size = np.concatenate([[0], np.cumsum(take)])[starts]
                clean = clean[take]
                count = np.concatenate([[0], np.cumsum(keep)])[at]
                for r in range(k):
                    kept = clean[size[r] : max(size[r], size[r + 1] - 1)].tobytes()
                    rows.append(i + r)
                    n_words.append(int(at[r + 1] - at[r]))
                    n_removed.append(n_words[-1] - int(count[r + 1] - count[r]))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if text:
                        texts.append(kept)
                        held += len(kept)
                if held > 1 << 24:
                    held = 0
                    yield flush()
            if rows:
                yield flush()

    return scan


def parse(run: np.ndarray, i: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of many runs at once: first row, number of windows, place of the first in the block.

    A row is a window of a run that has other places; rows are in order of run, then of i, the window's number. places: two
    of its other places (-1: none); the next place is the number after.
    """
    n = len(run)
    follows = np.append((run[1:] == run[:-1]) & (i[1:] == i[:-1] + 1), False)
    length = np.ones((n, 2), np.int64)
    todo = np.flatnonzero(follows)
    # how far each place goes on: rows that follow each other by their distance from the end of their stretch
    stretch = np.flatnonzero(~follows)
    away = stretch[np.searchsorted(stretch, np.arange(n))] - np.arange(n)
    for d in range(1, int(away.max(initial=0)) + 1):
        rows = todo[away[todo] == d]
        for c in (0, 1):
            for e in (1, 0):  # the first one of equal places counts
                on = (places[rows, c] >= 0) & (places[rows + 1, e] == places[rows, c] + 1)
                length[rows[on], c] = 1 + length[rows[on] + 1, e]
    length[places < 0] = 0
    best = np.where(length[:, 1] > length[:, 0], 1, 0)
    reach, firsts = length[np.arange(n), best], []
    now = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if n else np.zeros(0, np.int64)
    ends = np.append(now[1:], n)
    while len(now):
        firsts.append(now)
        now = now + np.maximum(reach[now], 1)
        now, ends = now[now < ends], ends[now < ends]
    first = np.sort(np.concatenate(firsts)) if firsts else np.zeros(0, np.int64)
    first = first[reach[first] > 0]
    return first, reach[first], places[first, best[first]]


def _parse_runs(bits: int):
    """One row for each factor of a reference."""
    import pyarrow as pa

    low = np.int64((1 << bits) - 1)

    def scan(batches):
        for batch in batches:
            found = batch.column("found")
            each = np.diff(np.asarray(found.offsets))
            rows = found.flatten()
            owner = np.repeat(np.arange(len(each)), each)
            i, lo, hi = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "lo", "hi"))
            own = ((np.asarray(batch.column("run"))[owner] & ~low) | i) & MAX
            places = np.stack([np.where(lo == own, -1, lo), np.where((hi == own) | (hi == lo), -1, hi)], 1)
            first, many, place = parse(owner, i, places)
            at = pa.array(owner[first])
            yield pa.RecordBatch.from_pydict({
                "anchor": batch.column("anchor").take(at), "run": batch.column("run").take(at), "i": pa.array(i[first].astype(np.int32)), "j": pa.array((i[first] + many - 1).astype(np.int32)),
                "reference": pa.array(place & ~low), "offset": pa.array((place & low).astype(np.int32)),
            })

    return scan


def reference_blocks(spark: SparkSession, docs: DataFrame, scratch: Scratch, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The runs of all documents (doc_id, th, anchor, run, first, size) and the references of the blocks (anchor, run, copies, windows)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))
    places = scratch.save(keyed.mapInArrow(_anchors(window, gram, True), f"doc_id {id_type}, th long, anchor long, first int, last int"), "places")
    # a table of its own: so a hot anchor's places, on the other side of the join, can be split
    indexed = scratch.save(places.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "index")
    found = places.join(indexed, "anchor", "left_semi").groupBy("doc_id", "th").agg(F.collect_set(F.struct("anchor", "first", "last")).alias("runs"))
    found = scratch.save(found, "found")
    scratch.drop("places", "index")
    texts = keyed.join(found.withColumnsRenamed({"doc_id": "d", "th": "h"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("doc_id", "th", "text", "runs")
    runs = scratch.save(texts.mapInArrow(_run_hashes(window), f"doc_id {id_type}, th long, anchor long, run long, first int, windows array<long>"), "runs")
    scratch.drop("found")
    references = scratch.save(runs.groupBy("anchor", "run").agg(F.count("*").alias("copies"), F.any_value("windows").alias("windows")), "references")
    return runs.select("doc_id", "th", "anchor", "run", "first", F.size("windows").alias("size")), references


def factors_of(references: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, run, i, j, reference, offset: the factors (first and last window) of each reference, and where the block has them.

    A place is one number: the upper bits of the reference's hash, and the offset in the lower ones.
    """
    bits = (window - gram + 1).bit_length()
    each = references.select("anchor", "run", F.posexplode("windows").alias("i", "window"))
    place = (F.col("run").bitwiseAND(F.lit(-1 << bits)).bitwiseOR(F.col("i"))).bitwiseAND(F.lit(int(MAX)))
    each = each.withColumn("place", place)
    index = each.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi")).filter("n > 1").drop("n")
    found = each.join(index, ["anchor", "window"]).groupBy("anchor", "run").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("found"))
    return found.mapInArrow(_parse_runs(bits), "anchor long, run long, i int, j int, reference long, offset int")


def duplicate_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, th (hash of the text), spans: the factors, as first and last window."""
    runs, references = reference_blocks(spark, docs, scratch, window, gram)
    own = scratch.save(factors_of(references, window, gram).select("anchor", "run", "i", "j"), "factors")
    twins = references.filter("copies > 1").select("anchor", "run", F.lit(0).alias("i"), (F.size("windows") - 1).alias("j"))
    single = own.join(references.filter("copies = 1").select("anchor", "run"), ["anchor", "run"], "left_semi")
    parsed = scratch.save(single.unionByName(twins).groupBy("anchor", "run").agg(F.collect_list(F.struct("i", "j")).alias("factors")), "parsed")
    spans = runs.join(parsed, ["anchor", "run"]).select("doc_id", "th", F.explode(F.transform("factors", lambda x: F.struct((F.col("first") + x["i"]).alias("first"), (F.col("first") + x["j"]).alias("last")))).alias("span"))
    spans = scratch.save(spans.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans")), "spans")
    scratch.drop("runs", "references", "factors", "parsed")
    return spans


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, the kept words joined by one space."""
    if not 0 < gram < window:
        raise ValueError("gram must be shorter than window")
    docs = docs.select("doc_id", "text")
    scratch = Scratch(spark)
    spans = duplicate_spans(spark, docs, scratch, window, gram).withColumnsRenamed({"doc_id": "d", "th": "h"})
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    both = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left").select("doc_id", "text", "spans")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_cut(window, with_text), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
