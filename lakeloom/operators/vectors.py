"""Vector search: exact and approximate neighbours, quantisation, recall.

Queries and data are any number of rows. Search keeps queries in blocks of a bounded
size (broadcast) and sends only each task's best k per query. Distances inside tasks are numpy
matrix products on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.sources.formats import work_dir

MOST_QUERIES, MOST_RESULTS, MOST_TABLES, AT_ONCE = 10_000, 1_000_000, 32 << 20, 128  # of a block: queries, results, bytes of tables; queries scored at once


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None]
    if metric == "dot":
        return -(q @ x.T)
    if metric == "bits":
        whole = lambda v: (v[:, 0].astype(np.uint64) << np.uint64(32)) | v[:, 1].astype(np.uint64)
        return np.bitwise_count(whole(q)[:, None] ^ whole(x)[None]).astype(np.float64)
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    return 1 - np.divide(q @ x.T, n, out=np.zeros_like(n), where=n > 0)


def _query_blocks(queries: DataFrame, key: str, vector: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of all queries, at most so many at a time; one empty block if there are none."""
    ids, rows, any_yet = [], [], False
    for r in queries.select(key, vector).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == most:
            yield np.asarray(ids, np.int64), np.asarray(rows, np.float64)
            ids, rows, any_yet = [], [], True
    if ids or not any_yet:
        yield np.asarray(ids, np.int64), np.asarray(rows, np.float64)


def _search_blocks(spark: SparkSession, queries: DataFrame, key: str, vector: str, prepare: Callable, scan: Callable, data: DataFrame | Callable, k: int, more: str = "", each: int = 0) -> DataFrame:
    """The best k rows of scan(broadcast of prepare(ids, vectors)) for each query. data may be a function of what prepare
    gave: the rows that this block of queries needs. Results of several blocks are written to the shared folder one after
    the other, so that one block at a time is broadcast. more: further columns that scan returns. each: bytes of what prepare gives for one query, if those are many."""

    def search(block) -> tuple[DataFrame, object]:
        ready = prepare(*block)
        handle = spark.sparkContext.broadcast(ready)
        source = data if isinstance(data, DataFrame) else data(ready)
        found = source.mapInPandas(scan(handle), "query_id long, vec_id long, distance double" + more)
        w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), handle

    most = min(MOST_QUERIES, max(1, MOST_RESULTS // k), max(1, MOST_TABLES // each) if each else MOST_QUERIES)
    blocks = _query_blocks(queries, key, vector, most)
    now, after = next(blocks), next(blocks, None)
    if after is None:
        return search(now)[0]
    root, paths = work_dir(spark), []
    while now is not None:
        found, handle = search(now)
        paths.append(f"{root}/block-{len(paths)}")
        found.write.parquet(paths[-1])
        handle.unpersist()
        now, after = after, next(blocks, None)
    return spark.read.schema(found.schema).parquet(*paths)


class Best:
    """The k best rows that some queries have met, ties by the smaller id: at most k a query are held."""

    def __init__(self, queries: int, k: int):
        self.k, self.high = k, np.full(queries, np.inf)
        self.at, self.d, self.own, self.mark = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, which: np.ndarray, d: np.ndarray, own: np.ndarray, mark: int = 0) -> None:
        """Distances of the queries at `which` to rows. Infinite ones and NaN are left out. mark: kept with the rows, such as their cell."""
        high = self.high[which]
        if d.shape[1] > self.k and not np.isfinite(high).all():
            high = np.fmin(high, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero((d <= high[:, None]) & np.isfinite(d))
        if not len(r):
            return
        at, dist, ids = np.concatenate([self.at, which[r]]), np.concatenate([self.d, d[r, c]]), np.concatenate([self.own, own[c]])
        marks = np.concatenate([self.mark, np.full(len(r), mark, np.int32)])
        order = np.lexsort((ids, dist, at))
        rank = np.arange(len(order)) - np.searchsorted(at[order], at[order])
        last = order[rank == self.k - 1]
        self.high[at[last]] = dist[last]
        order = order[rank < self.k]
        self.at, self.d, self.own, self.mark = at[order], dist[order], ids[order], marks[order]

    def rows(self, ids: np.ndarray):
        import pandas as pd

        return pd.DataFrame({"query_id": ids[self.at], "vec_id": self.own, "distance": self.d})


def _scan_best(handle, key: str, vector: str, k: int, metric: str, exclude_self: bool, cell: str | None = None) -> Callable:
    """For mapInPandas: the best k rows of each query in a task. With cell, handle has the cells of each query too, and a query meets the rows of its cells."""

    def run(frames: Iterator) -> Iterator:
        ids, q, *probed = handle.value
        slices = [(slice(lo, lo + AT_ONCE), Best(len(ids[lo : lo + AT_ONCE]), k)) for lo in range(0, len(ids), AT_ONCE)]
        for frame in frames:
            for at, part in frame.groupby(cell) if cell else ((None, frame),):
                if not len(part) or not len(ids):
                    continue
                x, own = np.asarray(part[vector].tolist(), np.float64), part[key].to_numpy(np.int64)
                for span, best in slices:
                    which = np.flatnonzero((probed[0][span] == at).any(1)) if cell else np.arange(len(best.high))
                    if not len(which):
                        continue
                    d = _scores(q[span][which], x, metric)
                    if exclude_self:
                        d[ids[span][which][:, None] == own[None]] = np.inf
                    best.add(which, d, own)
        for span, best in slices:
            if len(best.at):
                yield best.rows(ids[span])

    return run


def nearest(spark: SparkSession, queries: DataFrame, data: DataFrame, k: int, metric: str = "l2", key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """query_id, vec_id, distance, rank: exact neighbours by l2 (squared), cosine, dot (negated) or bits (of bit_halves), ties by vec_id."""

    scan = lambda handle: _scan_best(handle, key, vector, k, metric, exclude_self)
    return _search_blocks(spark, queries, key, vector, lambda ids, q: (ids, q), scan, data.select(key, vector), k)


def kmeans(data: DataFrame, k: int, vector: str = "embedding", seed: int = 1, rounds: int = 20) -> np.ndarray:
    """Centres by Lloyd's rounds from k-means|| starts. A bounded number of centres comes to the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=rounds, initMode="k-means||").fit(data.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    return np.asarray(model.clusterCenters())


def assign_cells(data: DataFrame, centres: np.ndarray, vector: str = "embedding", cells: int = 1, name: str = "cell") -> DataFrame:
    """Adds the nearest cell, or the list of the `cells` nearest."""
    c = np.asarray(centres, np.float64)

    @F.pandas_udf("array<int>")
    def near(v):
        import pandas as pd

        d = _scores(np.asarray(v.tolist(), np.float64), c, "l2")
        return pd.Series(list(np.argsort(d, 1, kind="stable")[:, :cells].astype(np.int32)))

    out = data.withColumn(name, near(F.col(vector)))
    return out.withColumn(name, F.get(name, F.lit(0))) if cells == 1 else out


def ivf_search(spark: SparkSession, queries: DataFrame, data: DataFrame, centres: np.ndarray, k: int, probes: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Neighbours among the probed cells: a row is scored for the queries that probe its cell. Queries come in blocks, so pairs exist inside tasks only, and a large cell is many tasks."""
    c = np.asarray(centres, np.float64)

    def prepare(ids, q):
        near = np.argsort(_scores(q, c, "l2"), 1, kind="stable")[:, :probes] if len(ids) else np.zeros((0, probes), np.int64)
        return ids, q, near

    scan = lambda handle: _scan_best(handle, key, vector, k, "l2", True, "cell")
    return _search_blocks(spark, queries, key, vector, prepare, scan, assign_cells(data.select(key, vector), c, vector), k)


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; distances are held for some rows at a time (32 MB)."""
    step = max(1, (4 << 20) // max(1, len(centres)))
    parts = [_scores(x[i : i + step], centres, "l2").argmin(1) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds from distinct random rows; a centre without rows stays."""
    points = np.unique(x, axis=0)
    centres = points[np.random.default_rng(seed).choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = closest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class ProductQuantizer:
    """Codes of m slices with up to 256 centres each, and asymmetric or symmetric distances by tables."""

    def __init__(self, m: int = 8, codes: int = 16, seed: int = 1):
        self.m, self.codes, self.seed, self.books = m, codes, seed, []

    def fit(self, data: DataFrame, vector: str = "embedding", sample: int = 20_000) -> ProductQuantizer:
        """Learns the books from the `sample` vectors that come first by hash; every row is coded later."""
        rows = data.select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), "v").limit(sample).collect()
        x = np.asarray([r["v"] for r in rows], np.float64)
        width = x.shape[1] // self.m
        self.books = [_lloyd(x[:, i * width : (i + 1) * width], self.codes, self.seed) for i in range(self.m)]
        return self

    def encode(self, data: DataFrame, vector: str = "embedding", name: str = "code") -> DataFrame:
        books, width = self.books, self.books[0].shape[1]

        @F.pandas_udf("array<smallint>")
        def code(v):
            import pandas as pd

            x = np.asarray(v.tolist(), np.float64)
            parts = [_scores(x[:, i * width : (i + 1) * width], b, "l2").argmin(1) for i, b in enumerate(books)]
            return pd.Series(list(np.stack(parts, 1).astype(np.int16)))

        return data.withColumn(name, code(F.col(vector)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of a query's slices to all centres: m x codes."""
        width = self.books[0].shape[1]
        return np.stack([((b - q[i * width : (i + 1) * width]) ** 2).sum(1) for i, b in enumerate(self.books)])

    def search(self, spark: SparkSession, queries: DataFrame, coded: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", symmetric: bool = False) -> DataFrame:
        """Approximate neighbours by summed table entries; symmetric: the query is coded too."""

        def prepare(ids, q):
            if symmetric:
                width = self.books[0].shape[1]
                q = [np.concatenate([b[((b - v[i * width : (i + 1) * width]) ** 2).sum(1).argmin()] for i, b in enumerate(self.books)]) for v in q]
            return ids, [self.tables(v) for v in q]

        def scan(handle):
            def run(frames):
                import pandas as pd

                ids, tables = handle.value
                for frame in frames:
                    code, own = np.asarray(frame["code"].tolist(), np.int64), frame[key].to_numpy(np.int64)
                    if not len(own):
                        continue
                    for i, t in zip(ids, tables, strict=True):
                        d = t[np.arange(code.shape[1])[None], code].sum(1)
                        few = np.argpartition(d, min(k, len(d) - 1))[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                        few = np.flatnonzero(d <= d[few].max())  # ties too
                        keep = few[np.lexsort((own[few], d[few]))]
                        keep = keep[own[keep] != i][:k]
                        yield pd.DataFrame({"query_id": i, "vec_id": own[keep], "distance": d[keep]})

            return run

        return _search_blocks(spark, queries, key, vector, prepare, scan, coded.select(key, "code"), k, each=8 * sum(map(len, self.books)))


def residuals(data: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Adds cell and residual: the vector less its cell's centre."""
    x = assign_cells(data, centres, vector)
    book = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    return x.withColumn("residual", F.zip_with(F.col(vector), F.get(book, F.col("cell")), lambda a, b: a.cast("double") - b))


def principal_rotation(data: DataFrame, vector: str = "embedding") -> np.ndarray:
    """A rotation to principal axes, dealt over slices so that each has a like share of variance. Only a d x d matrix comes to the driver."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    x = data.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    mean = np.asarray(x.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray())

    def products(frames):
        import pandas as pd

        total = np.zeros((len(mean), len(mean)))
        for f in frames:
            m = np.asarray(f["x"].tolist(), np.float64).reshape(-1, len(mean)) - mean
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    rows = data.select(F.col(vector).cast("array<double>").alias("x")).mapInPandas(products, "i int, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = len(mean)
    cov = np.zeros((n, n))
    for r in sums:
        cov[r["i"], r["j"]] = r["v"]
    _, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1]
    return np.concatenate([axes[:, i::8] for i in range(8)], axis=1) if n % 8 == 0 else axes


def rotate(data: DataFrame, axes: np.ndarray, vector: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<double>")
    def turn(v):
        import pandas as pd

        return pd.Series(list(np.asarray(v.tolist(), np.float64) @ axes))

    return data.withColumn(vector, turn(F.col(vector)))


def scalar_ranges(data: DataFrame, vector: str = "embedding") -> tuple[list[float], list[float]]:
    """Least and largest value of each dimension, by aggregation."""
    rows = data.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("i").collect()
    return [float(r["a"]) for r in rows], [float(r["b"]) for r in rows]


def scalar_quantize(vector: str, low: Sequence[float], high: Sequence[float]) -> Column:
    """round((x - min) / (max - min) * 255) of each dimension."""
    bounds = F.arrays_zip(F.col(vector).alias("x"), F.array(*[F.lit(v) for v in low]).alias("a"), F.array(*[F.lit(v) for v in high]).alias("b"))
    return F.transform(bounds, lambda r: F.when(r["b"] == r["a"], 0).otherwise(F.round((r["x"].cast("double") - r["a"]) / (r["b"] - r["a"]) * 255)).cast("int"))


def scalar_restore(code: str, low: Sequence[float], high: Sequence[float]) -> Column:
    bounds = F.arrays_zip(F.col(code).alias("x"), F.array(*[F.lit(v) for v in low]).alias("a"), F.array(*[F.lit(v) for v in high]).alias("b"))
    return F.transform(bounds, lambda r: r["a"] + r["x"] / 255.0 * (r["b"] - r["a"]))


def sign_bits(vector: str, width: int = 64) -> Column:
    """The signs of up to 64 dimensions as one long: bit i is set where x[i] > 0."""
    bits = F.transform(F.slice(vector, 1, width), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def bit_halves(bits: str) -> Column:
    """The upper and lower 32 bits of a long, as a vector."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")
    return F.array(low(F.shiftrightunsigned(F.col(bits), 32)), low(F.col(bits)))


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def rerank(spark: SparkSession, candidates: DataFrame, data: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact distances of candidate pairs (query_id, vec_id), the best k."""
    x = data.select(F.col(key).alias("vec_id"), F.col(vector).alias("x"))
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    pairs = candidates.select("query_id", "vec_id").distinct().join(x, "vec_id").join(q, "query_id").select("query_id", "vec_id", squared_distance("q", "x").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def funnel(spark: SparkSession, queries: DataFrame, data: DataFrame, stages: Sequence[tuple[int, int]], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Prefix funnel: (dimensions, keep) per stage; the first stage scans, later ones rerank what is left."""
    dims, keep = stages[0]
    cut = lambda df, d: df.select(key, F.slice(vector, 1, d).alias(vector))
    found = nearest(spark, cut(queries, dims), cut(data, dims), keep, key=key, vector=vector)
    for dims, keep in stages[1:]:
        found = rerank(spark, found, cut(data, dims), cut(queries, dims), keep, key, vector)
    return found


class SmallWorld:
    """A navigable small-world graph in layers, over the rows of a matrix (Euclidean)."""

    def __init__(self, x: np.ndarray, links: int = 8, effort: int = 48, seed: int = 1):
        self.x, self.links, self.effort = x, links, effort
        rng = np.random.default_rng(seed)
        self.level = np.minimum(8, (-np.log(rng.random(len(x)) + 1e-12) / np.log(links)).astype(int))
        self.graph: list[dict[int, list[int]]] = [{} for _ in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1
        for i in range(len(x)):
            self._insert(i)

    def _d(self, q: np.ndarray, rows) -> np.ndarray:
        return ((self.x[rows] - q) ** 2).sum(1)

    def _layer(self, q: np.ndarray, starts: list[int], effort: int, layer: int) -> list[tuple[float, int]]:
        import heapq

        seen, dist = set(starts), self._d(q, starts)
        todo = [(d, i) for d, i in zip(dist, starts, strict=True)]
        best = [(-d, i) for d, i in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= effort and d > -best[0][0]:
                break
            new = [j for j in self.graph[layer].get(i, ()) if j not in seen]
            seen.update(new)
            if new:
                for e, j in zip(self._d(q, new), new, strict=True):
                    if len(best) < effort or e < -best[0][0]:
                        heapq.heappush(todo, (e, j))
                        heapq.heappush(best, (-e, j))
                        if len(best) > effort:
                            heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _choose(self, found: list[tuple[float, int]]) -> list[int]:
        """Spread-out neighbours: one is taken if it is nearer to the new point than to any taken before."""
        taken: list[int] = []
        for d, i in found:
            if len(taken) == self.links:
                break
            if not taken or (self._d(self.x[i], taken) > d).all():
                taken.append(i)
        for _, i in found:
            if len(taken) >= self.links:
                break
            if i not in taken:
                taken.append(i)
        return taken

    def _insert(self, i: int) -> None:
        top = int(self.level[i])
        if self.entry < 0:
            self.entry = i
            for layer in range(top + 1):
                self.graph[layer][i] = []
            return
        starts = [self.entry]
        for layer in range(int(self.level[self.entry]), -1, -1):
            found = self._layer(self.x[i], starts, self.effort if layer <= top else 1, layer)
            starts = [j for _, j in found]
            if layer <= top:
                own = self._choose(found)
                self.graph[layer][i] = own
                for j in own:
                    back = self.graph[layer].setdefault(j, [])
                    back.append(i)
                    if len(back) > 2 * self.links:
                        self.graph[layer][j] = self._choose(sorted(zip(self._d(self.x[j], back), back, strict=True)))
        for layer in range(int(self.level[self.entry]) + 1, top + 1):
            self.graph[layer][i] = []
        if top > self.level[self.entry]:
            self.entry = i

    def search(self, q: np.ndarray, k: int, effort: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        starts = [self.entry]
        for layer in range(int(self.level[self.entry]), 0, -1):
            starts = [self._layer(q, starts, 1, layer)[0][1]]
        return self._layer(q, starts, max(k, effort), 0)[:k]


def graph_search(spark: SparkSession, queries: DataFrame, data: DataFrame, k: int, links: int = 8, effort: int = 64, block: int = 20_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate neighbours: a small-world graph for each block of rows of a partition, best k merged."""

    def scan(handle):
        def run(frames):
            import pandas as pd

            ids, q = handle.value
            for frame in frames:
                for lo in range(0, len(frame), block):
                    part = frame.iloc[lo : lo + block]
                    own = part[key].to_numpy(np.int64)
                    graph = SmallWorld(np.asarray(part[vector].tolist(), np.float64), links)
                    for i, v in zip(ids, q, strict=True):
                        found = [(d, own[j]) for d, j in graph.search(v, k + 1, effort) if own[j] != i][:k]
                        yield pd.DataFrame({"query_id": i, "vec_id": [j for _, j in found], "distance": [d for d, _ in found]}).astype({"vec_id": "int64", "distance": "float64"})

        return run

    return _search_blocks(spark, queries, key, vector, lambda ids, q: (ids, q), scan, data.select(key, vector), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """The share of true (query_id, vec_id) pairs that were found."""
    hits = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.agg((F.count("hit") / F.count("*")).alias("recall"))
