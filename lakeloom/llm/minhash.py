"""MinHash near-duplicates: universal-hash minima, banding, verification, star components.

A document is the set of its ``shingle``-word phrases (the whole word sequence as one phrase if
it is shorter; nothing without words), after lower-casing A-Z. Two documents are linked when
100 * |intersection| >= percent * |union|.

Work is done on classes: documents with the same word sequence are one class, whose head is its
smallest doc_id. Heads get ``bands * rows`` universal hash minima; every band of ``rows`` minima
is a bucket key. At the default 32 bands of 4, a pair right at 0.8 shares no bucket with
probability (1 - 0.8**4)**32 < 5e-8.

No bucket is expanded into its pairs. Pairs are tried in rounds: every member of a bucket that is
not in the component of the bucket's centre is verified against it, and components are found
again by alternating large-star and small-star. The first round's centre is the member whose
buckets are the largest (in a family of edited copies that is the original), later ones are
chosen by hash. A bucket whose members are all in one component is done. What is left are pairs
of different components within open buckets, and all of those are compared: buckets of a few
members as pairs, larger ones in blocks of bounded size, whose sets are multiplied as matrices
inside a task so that only links leave it. So the rounds only save work and never lose a link.
Verification compares lengths, then signatures (a pair is set aside only if its agreement is
more than six standard deviations below the threshold), then the full sets.

Defined results: null ids form documents of their own in the same way as other ids, null sorts
last; identical rows are one class; null or empty texts are linked with nothing; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lakeloom.llm.common import WORD_REGEX, Scratch, find_words, fresh_names, gram_hashes, hash_words, lower_ascii, mix64, spans_of, text_blocks

PRIME = np.uint64((1 << 31) - 1)
FEW, BLOCK_ROWS, BLOCK_SHINGLES = 4, 400, 250_000


def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, int(PRIME), n, dtype=np.uint64), r.integers(0, int(PRIME), n, dtype=np.uint64)


def shingle_sets(words: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrase hashes of each document, sorted within it, and their starts. at: word starts of documents."""
    grams = gram_hashes(words, shingle)
    count = np.diff(at)
    short = (count > 0) & (count < shingle)
    docs = np.repeat(np.arange(len(count)), np.maximum(count - shingle + 1, 0))
    if len(docs):
        place = np.arange(len(docs)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(count - shingle + 1, 0))[:-1]]), np.maximum(count - shingle + 1, 0))
        values = grams[at[docs] + place]
    else:
        values = np.zeros(0, np.uint64)
    if short.any():
        extra = np.flatnonzero(short)
        whole = np.asarray([int.from_bytes(hashlib.blake2b(words[at[d] : at[d + 1]].tobytes(), digest_size=8).digest(), "little") for d in extra], np.uint64)
        docs, values = np.concatenate([docs, extra]), np.concatenate([values, whole])
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    if len(docs):
        new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])])
        docs, values = docs[new], values[new]
    return values, np.searchsorted(docs, np.arange(len(count) + 1))


def _sketch(shingle: int, bands: int, rows: int, seed: int):
    import pyarrow as pa

    a, b = _family(bands * rows, seed)

    def scan(batches):
        for batch in batches:
            keys, sizes, sigs, band_keys = [], [], [], []
            for _, k, buffer, starts in text_blocks(batch.column("text")):
                buffer = lower_ascii(buffer)
                first, last = find_words(buffer)
                words, at = hash_words(buffer, first, last), spans_of(starts, first)
                values, begin = shingle_sets(words, at, shingle)
                n = np.diff(begin)
                minima = np.full((k, bands * rows), PRIME, np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    x = (values >> np.uint64(33)) % PRIME
                    for h in range(bands * rows):
                        y = a[h] * x + b[h]
                        y = (y & PRIME) + (y >> np.uint64(31))
                        y = np.where(y >= PRIME, y - PRIME, y)
                        minima[full, h] = np.minimum.reduceat(y, begin[full])
                fold = np.zeros((k, bands), np.uint64)
                for j in range(rows):
                    fold = mix64(fold * np.uint64(31) + minima[:, j::rows] + np.uint64(1))
                for d in range(k):
                    digest = hashlib.blake2b(words[at[d] : at[d + 1]].tobytes(), digest_size=16).digest()
                    keys.append(digest)
                sizes.append(n)
                sigs.extend(r.tobytes() for r in (minima & np.uint64(255)).astype(np.uint8))
                band_keys.append(fold.view(np.int64))
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            folds = np.concatenate(band_keys).ravel() if band_keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "class": pa.array(keys, pa.binary()), "n_shingles": pa.array(size.astype(np.int64)), "signature": pa.array(sigs, pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, len(folds) + 1, bands, dtype=np.int32)), pa.array(folds)),
            })

    return scan


def _sets(column, shingle: int):
    """The sorted phrase hashes of each text."""
    for _, k, buffer, starts in text_blocks(column):
        buffer = lower_ascii(buffer)
        first, last = find_words(buffer)
        values, begin = shingle_sets(hash_words(buffer, first, last), spans_of(starts, first), shingle)
        for d in range(k):
            yield values[begin[d] : begin[d + 1]]


def _classes(column):
    """The class of each text: a digest of its word sequence."""
    for _, k, buffer, starts in text_blocks(column):
        buffer = lower_ascii(buffer)
        first, last = find_words(buffer)
        words, at = hash_words(buffer, first, last), spans_of(starts, first)
        for d in range(k):
            yield hashlib.blake2b(words[at[d] : at[d + 1]].tobytes(), digest_size=16).digest()


def _with_class(name: str):
    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            keys = pa.array(_classes(batch.column("text")), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, name])

    return scan


def _verify(shingle: int, percent: int):
    """Compares the full sets of each pair's texts; sorted by the first text, so that its set is made once."""
    import pyarrow as pa

    def scan(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column("text_a"), shingle), _sets(batch.column("text_b"), shingle), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(len(x) and len(y)) and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scan


def _block_links(table, shingle: int, percent: int) -> tuple[list[bytes], list[bytes]]:
    """Links among the rows of one group that join different components, in the first band only that both rows have in common."""
    nodes, roots, parts = (table.column(c).to_pylist() for c in ("node", "root", "part"))
    if len(set(roots)) < 2:
        return [], []
    n, band = len(nodes), table.column("band")[0].as_py()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    bands = np.asarray(table.column("bands").to_pylist(), np.int64)
    _, root = np.unique(np.asarray(roots, object), return_inverse=True)
    part = np.asarray(parts)
    order = np.argsort(np.asarray(nodes, object), kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    want = (place[:, None] < place[None]) & (root[:, None] != root[None])
    if i != j:  # pairs inside a part belong to that part's own group
        want &= part[:, None] != part[None]
    for earlier in range(band):
        want &= bands[:, earlier][:, None] != bands[:, earlier][None]
    if not want.any():
        return [], []
    sets = [values for chunk in table.column("text").chunks for values in _sets(chunk, shingle)]
    size = np.asarray([len(x) for x in sets])
    owner, values = np.repeat(np.arange(n), size), np.concatenate(sets)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[column] > 1  # a phrase of one row is in no intersection
    names, column = np.unique(column[keep], return_inverse=True)
    owner, shared = owner[keep], np.zeros((n, n), np.float32)
    ordered = np.argsort(column, kind="stable")
    owner, column = owner[ordered], column[ordered]
    for lo in range(0, len(names), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        dense = np.zeros((n, 4096), np.float32)
        dense[owner[a:b], column[a:b] - lo] = 1
        shared += dense @ dense.T
    linked = want & (100 * shared.astype(np.float64) >= percent * (size[:, None] + size[None] - shared.astype(np.float64)))
    x, y = np.nonzero(linked)
    return [nodes[p] for p in x], [nodes[p] for p in y]


def large_star(edges: DataFrame) -> DataFrame:
    """edges (u, v). Connects each node's larger neighbours with its smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Connects each node's smaller neighbours, and itself, with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    Alternates large-star and small-star until the edges stay as they are. Every pass is written
    to the shared folder; only a count and a checksum come to the driver.
    """
    now = scratch.save(edges.select("u", "v").filter("u <> v").distinct(), f"{name}-0")
    state, i = None, 0
    while True:
        after = scratch.save(small_star(large_star(now)), f"{name}-{i + 1}")
        row = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{i}")
        now, i = after, i + 1
        if tuple(row) == state:
            break
        state = tuple(row)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select("v", "v")).distinct()


class NearDuplicates:
    """Links and components of one corpus. See the module's text."""

    def __init__(self, spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, rounds: int = 1, seed: int = 7):
        self.spark, self.docs, self.scratch = spark, docs.select("doc_id", "text"), Scratch(spark)
        self.shingle, self.percent, self.bands, self.rows, self.rounds, self.seed = shingle, percent, bands, rows, rounds, seed

    def _heads(self) -> DataFrame:
        """One row for each class of equal word sequences: node (the class), head (its smallest doc_id), size, signature, bands."""
        id_type = self.docs.schema["doc_id"].dataType.simpleString()
        sketch = self.docs.mapInArrow(_sketch(self.shingle, self.bands, self.rows, self.seed), f"doc_id {id_type}, class binary, n_shingles long, signature binary, bands array<long>")
        self.sketches = self.scratch.save(sketch, "sketches")
        heads = self.sketches.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("head"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        return self.scratch.save(heads.withColumn("node", F.col("class")), "heads")

    def _members(self, heads: DataFrame) -> DataFrame:
        """(band, key, node, n, popular) of the buckets that have more than one class; popular: the sizes of the class's buckets, summed."""
        each = heads.select("node", "n", F.posexplode("bands").alias("band", "key"))
        shared = each.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1")
        found = self.scratch.save(each.join(shared, ["band", "key"]).select("band", "key", "node", "n", "m"), "shared")
        popular = found.groupBy("node").agg(F.sum("m").alias("popular"))
        return self.scratch.save(found.drop("m").join(popular, "node"), "members")

    def _texts(self, heads: DataFrame, members: DataFrame) -> DataFrame:
        """(node, text): one text of each class that has a bucket in common with another, found once for all rounds.
        Rows that share a doc_id are told apart by their class."""
        wanted = members.select("node").distinct().join(heads.select("node", "head"), "node")

        def classify(batches):
            import pyarrow as pa

            for batch in batches:
                same = pa.array([x == y for x, y in zip(_classes(batch.column("text")), batch.column("node").to_pylist(), strict=True)], pa.bool_())
                yield batch.select(["node", "text"]).filter(same)

        named = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("head"))).select("node", "text")
        return self.scratch.save(named.mapInArrow(classify, "node binary, text string").dropDuplicates(["node"]), "texts")

    def _confirmed(self, pairs: DataFrame, signed: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that the lengths, the signatures and then the full sets confirm."""
        pairs = pairs.filter(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)").select("a", "b").distinct()
        width = self.bands * self.rows
        t = self.percent / 100
        least = width * t - 6 * (width * t * (1 - t)) ** 0.5
        pairs = pairs.join(signed.withColumnsRenamed({"node": "a", "signature": "sa"}), "a").join(signed.withColumnsRenamed({"node": "b", "signature": "sb"}), "b")

        def agree(batches):
            import pyarrow as pa

            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

        likely = pairs.mapInArrow(agree, "a binary, b binary")
        full = likely.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
        return self.scratch.save(full.mapInArrow(_verify(self.shingle, self.percent), "a binary, b binary"), f"links-{name}")

    def _in_blocks(self, now: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
        """Links between components of large open buckets. A bucket's members are dealt to parts of about BLOCK_ROWS
        members and BLOCK_SHINGLES phrases; each pair of parts is one group."""
        parts = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("total") / BLOCK_SHINGLES)).cast("int")
        own = now.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = own.select("band", "key", "node", "root", "part", other.alias("other")).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
        full = dealt.join(heads.select("node", "bands"), "node").join(texts, "node")
        shingle, percent = self.shingle, self.percent

        def compare(table):
            import pyarrow as pa

            a, b = _block_links(table, shingle, percent)
            return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        done = full.select("band", "key", "i", "j", "node", "root", "part", "bands", "text").groupBy("band", "key", "i", "j").applyInArrow(compare, "a binary, b binary")
        return self.scratch.save(done, "links-blocks")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Confirmed links (a, b) that span every component, and the classes."""
        heads = self._heads()
        members = self._members(heads)
        texts = self._texts(heads, members)
        signed = heads.select("node", "signature")
        found: list[DataFrame] = []
        self.roots = None
        for i in range(self.rounds + 1):
            now = members.withColumn("root", F.col("node"))
            if self.roots is not None:
                now = members.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
                open_ = now.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band", "key")
                now = self.scratch.save(now.join(open_, ["band", "key"], "left_semi"), f"open-{i}")
                if now.isEmpty():
                    break
            if i < self.rounds:
                order = F.struct(F.col("popular") if i == 0 else F.lit(0), F.xxhash64("node", "band", F.lit(i)))
                centre = now.groupBy("band", "key").agg(F.max_by(F.struct("node", "n", "root"), order).alias("c"))
                pairs = now.join(centre, ["band", "key"]).filter("root <> c.root").select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"), F.col("n").alias("na"), F.col("c.n").alias("nb"))
            else:
                sizes = now.groupBy("band", "key").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
                now = self.scratch.save(now.join(sizes, ["band", "key"]), "sized")
                few = now.filter(f"m <= {FEW}")
                other = few.select("band", "key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
                pairs = few.join(other, ["band", "key"]).filter("node < node2 and root <> root2").filter(f"100 * least(n, n2) >= {self.percent} * greatest(n, n2)").select(F.col("node").alias("a"), F.col("node2").alias("b"), F.col("n").alias("na"), F.col("n2").alias("nb"))
                found.append(self._in_blocks(now.filter(f"m > {FEW}"), heads, texts))
            tried = self._confirmed(pairs, signed, texts, str(i))
            found.append(tried)
            if i == self.rounds and i:
                tried = self.scratch.save(tried.union(found[-2]).distinct(), "last")
            fresh = tried.select(F.col("a").alias("u"), F.col("b").alias("v"))
            if self.roots is not None:
                if tried.isEmpty():
                    continue
                fresh = fresh.union(self.roots.filter("node <> root").select("node", "root"))
            self.roots = star_components(self.spark, fresh, self.scratch, f"star-{i}")
        edges = found[0]
        for x in found[1:]:
            edges = edges.union(x)
        return edges, heads

    def classes(self) -> DataFrame:
        """node (the class), head, root of its component, component_id (smallest doc_id of the component), for classes with words."""
        _, heads = self.links()
        named = heads.select("node", "head").join(self.roots, "node", "left").select("node", "head", F.coalesce("root", "node").alias("root"))
        least = named.groupBy("root").agg(F.min("head").alias("component_id"))
        return self.scratch.save(named.join(least, "root").select("node", "head", "root", "component_id"), "ids")

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, one row for each row of docs."""
        ids = self.classes().select(F.col("node").alias("class"), "component_id")
        # the few classes that stand for several documents or are linked are looked up; any other document is its own component
        out = self.sketches.select("doc_id", "class", "n_shingles").join(ids, "class", "left")
        component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    return NearDuplicates(spark, docs, **options).components()


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row for each component: of its rows with the smallest id, the first by text. Rows that share an id, or have
    none, are told apart by their class. Rows without words are linked with nothing and all stay."""
    ids = NearDuplicates(spark, docs, **options).classes().filter(F.col("head").eqNullSafe(F.col("component_id")))
    own, node, head, root, row = fresh_names(docs.columns, "__own", "__class", "__head", "__root", "__row")
    ids = ids.select(F.col("node").alias(node), F.col("head").alias(head), F.col("root").alias(root))
    marked = docs.mapInArrow(_with_class(own), StructType([*docs.schema.fields, StructField(own, BinaryType())]))
    named = marked.join(ids, (F.col(own) == F.col(node)) & F.col("doc_id").eqNullSafe(F.col(head)))
    one = named.groupBy(root).agg(F.min_by(F.struct(*docs.columns), "text").alias(row)).select(f"{row}.*")
    return one.union(docs.filter(~F.coalesce(F.col("text").rlike(WORD_REGEX), F.lit(False))))
