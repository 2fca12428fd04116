"""A stored inverted file for vector search: rows in folders by cell, of which a search reads those that it probes.

The number of cells is the root of the number of rows. Centres are learned in two levels (groups, then cells within each
group) from a hash sample of about ``train`` rows for each cell, so the model, the sample and each task's share of the training
grow with the root of the rows, too; all rows are then dealt to cells. How many cells a query has to probe depends on the data: it is
measured when the index is built, from the exact neighbours of ``CHECKED`` rows, so that ``target`` of these
are in the probed cells. Data with clusters need few probes; where vectors fill space evenly nearly all cells are probed. Each
result says which share of the rows its query read.

Vectors that are null or hold null or non-finite components are not indexed and as queries find nothing. An index of no rows
finds nothing. Repeated rows are all kept; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators import vectors as vs
from lakeloom.operators.aggregates import top_per_group
from lakeloom.sources.formats import work_dir

#: Rows whose exact neighbours tell how many cells to probe; groups that a row's cell is searched in.
CHECKED, GROUPS_TRIED = 100, 2


def sound(vector: str):
    """Whether a vector can be measured."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))


class _Model:
    """Centres of groups and cells, in memory: cells of one group stand together, ``first[g]`` is where group g begins."""

    def __init__(self, groups: np.ndarray, of_group: np.ndarray, centres: np.ndarray):
        self.groups, self.of_group, self.centres = groups, of_group, centres
        self.first = np.searchsorted(of_group, np.arange(len(groups) + 1))

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell within each row's nearest groups."""
        best, cell = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        near = np.argsort(vs._scores(x, self.groups, "l2"), 1, kind="stable")[:, :GROUPS_TRIED]
        for g in np.unique(near):
            rows = np.flatnonzero((near == g).any(1))
            lo, hi = self.first[g], self.first[g + 1]
            if lo == hi:
                continue
            own = vs.closest(x[rows], self.centres[lo:hi]) + lo
            d = ((x[rows] - self.centres[own]) ** 2).sum(1)
            better = d < best[rows]
            best[rows[better]], cell[rows[better]] = d[better], own[better]
        return cell

    def order(self, q: np.ndarray, most: int) -> np.ndarray:
        """Each query's nearest cells, nearest first, some queries at a time."""
        step = max(1, (4 << 20) // len(self.centres))
        parts = [np.argsort(vs._scores(q[i : i + step], self.centres, "l2"), 1, kind="stable")[:, :most] for i in range(0, len(q), step)]
        return np.concatenate(parts) if parts else np.zeros((0, most), np.int64)


class CellIndex:
    """An index in a folder; any session that is given the folder can search it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._loaded = spark, root, None

    # building

    def build(self, data: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int = 0, train: int = 64, k: int = 10, target: float = 0.95, parts: int = 0, codes: int = 64, seed: int = 1) -> CellIndex:
        """cells: 0 for the root of the rows. parts, codes: slices and centres of product codes of the residuals, stored beside the vectors; 0 parts for none."""
        rows = data.filter(sound(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
        n = rows.count()
        cells = min(cells or round(n**0.5), n) or 1
        model = self._train(rows, n, cells, train, seed) if n else _Model(np.zeros((1, 1)), np.zeros(1, np.int64), np.zeros((1, 1)))
        shared = self.spark.sparkContext.broadcast(model)

        @F.pandas_udf("int")
        def cell_of(v):
            import pandas as pd

            return pd.Series(shared.value.cell_of(_matrix(v)).astype(np.int32))

        dealt, books = rows.withColumn("cell", cell_of("embedding")), []
        if parts and n:
            rest = residuals_to(dealt, model)
            books = vs.ProductQuantizer(parts, codes, seed).fit(rest, "rest").books
            pq = vs.ProductQuantizer(parts, codes, seed)
            pq.books = books
            dealt = pq.encode(rest, "rest").drop("rest")
        # ranges of (cell, hash), so that a cell with many rows is several tasks and files
        dealt = dealt.withColumn("_h", F.xxhash64("vec_id", "embedding")).repartitionByRange("cell", "_h").drop("_h")
        dealt.write.partitionBy("cell").parquet(f"{self.root}/rows")
        self._save(model, books, dealt.schema, k, target)
        return self

    def _train(self, rows: DataFrame, n: int, cells: int, train: int, seed: int) -> _Model:
        share = min(1.0, train * cells / n)
        sample = rows.select(F.col("embedding").cast("array<double>").alias("v"))
        if share < 1:
            sample = sample.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        path = work_dir(self.spark) + "/sample"
        sample.distinct().write.parquet(path)
        sample = self.spark.read.parquet(path)
        groups = vs.kmeans(sample, max(1, round(cells**0.5)), "v", seed, 10)
        total, most = sample.count(), 4 * -(-cells // len(groups))

        def fine(key, frame):
            import pandas as pd

            x = np.asarray(frame.sort_values("_h", kind="stable")["v"].tolist(), np.float64)
            own = min(most, max(1, round(cells * len(x) / total)))  # a group with far more rows than others gets larger cells
            return pd.DataFrame({"g": int(key[0]), "centre": list(vs._lloyd(x[: most * train], own, seed))})

        @F.pandas_udf("int")
        def group_of(v):
            import pandas as pd

            return pd.Series(vs.closest(_matrix(v), groups).astype(np.int32))

        w = Window.partitionBy("g").orderBy("_h")
        in_groups = sample.withColumn("g", group_of("v")).withColumn("_h", F.xxhash64(F.lit(seed), "v")).withColumn("_n", F.row_number().over(w))
        # the sample of a group is cut at what its cells can use: learning only, every row is dealt afterwards
        kept = in_groups.filter(F.col("_n") <= most * train).drop("_n")
        learned = kept.groupBy("g").applyInPandas(fine, "g int, centre array<double>").collect()
        learned = sorted(((r["g"], r["centre"]) for r in learned), key=lambda r: (r[0], list(r[1])))
        return _Model(groups, np.asarray([g for g, _ in learned], np.int64), np.asarray([c for _, c in learned], np.float64))

    def _save(self, model: _Model, books: list, schema, k: int, target: float) -> None:
        """Writes the model: groups, cells with their counts, books, and the number of probes."""
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/rows")
        counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
        put = lambda name, data, columns: self.spark.createDataFrame(data, columns).write.parquet(f"{self.root}/{name}")
        put("groups", [(i, c.tolist()) for i, c in enumerate(model.groups)], "g int, centre array<double>")
        put("cells", [(i, int(g), counts.get(i, 0), c.tolist()) for i, (g, c) in enumerate(zip(model.of_group, model.centres, strict=True))], "cell int, g int, n long, centre array<double>")
        put("books", [(i, j, c.tolist()) for i, b in enumerate(books) for j, c in enumerate(b)], "part int, code int, centre array<double>")
        checked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CHECKED).select("vec_id", "embedding")
        path = work_dir(self.spark) + "/checked"
        checked.write.parquet(path)
        checked = self.spark.read.schema(checked.schema).parquet(path)
        truth = vs.nearest(self.spark, checked, rows, k).select("query_id", "vec_id")
        where = rows.select("vec_id", "cell").join(F.broadcast(truth), "vec_id").join(F.broadcast(checked.withColumnRenamed("vec_id", "query_id")), "query_id")
        pairs = where.select("cell", F.col("embedding").cast("array<double>").alias("q")).collect()  # CHECKED times k rows
        probes = 1
        if pairs:
            order = model.order(np.asarray([r["q"] for r in pairs]), len(model.centres))
            place = (order == np.asarray([r["cell"] for r in pairs])[:, None]).argmax(1) + 1
            probes = int(np.sort(place)[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)])
        put("probes", [(probes,)], "probes int")

    # searching

    def _load(self):
        if self._loaded is None:
            table = lambda name: self.spark.read.parquet(f"{self.root}/{name}")
            cells = table("cells").orderBy("cell").collect()
            model = _Model(np.asarray([r["centre"] for r in table("groups").orderBy("g").collect()]), np.asarray([r["g"] for r in cells], np.int64), np.asarray([r["centre"] for r in cells]))
            books: dict[int, list] = {}
            for r in table("books").orderBy("part", "code").collect():
                books.setdefault(r["part"], []).append(r["centre"])
            self._loaded = model, np.asarray([r["n"] for r in cells], np.int64), [np.asarray(b) for b in books.values()], table("probes").first()[0]
        return self._loaded

    def rows(self) -> DataFrame:
        """vec_id, embedding, code if there are codes, cell (the folder)."""
        schema = "vec_id long, embedding array<double>, " + ("code array<smallint>, " if self._load()[2] else "") + "cell int"
        if not self._load()[1].sum():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/rows")

    def _prepare(self, probes: int):
        model, counts, _, tuned = self._load()
        most = min(probes or tuned, len(counts))

        def prepare(ids, q):
            order = model.order(q, most) if len(ids) and counts.sum() else np.zeros((len(ids), 0), np.int64)
            at: dict[int, np.ndarray] = {}
            if order.size:
                flat, who = order.ravel(), np.repeat(np.arange(len(ids)), order.shape[1])
                by = np.argsort(flat, kind="stable")
                cut = np.flatnonzero(np.diff(flat[by])) + 1
                at = {int(flat[i[0]]): who[i] for i in np.split(by, cut)}
            return ids, q, at, counts[order].sum(1) / max(1, counts.sum())

        return prepare

    def search(self, queries: DataFrame, k: int = 10, probes: int = 0, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
        """query_id, vec_id, distance (squared), share (rows in the probed cells, of all), rank. probes: 0 for the number that the index measured."""

        def measure(ready, cell, frame):
            q, x = ready[1], _matrix(frame["embedding"])
            for some in _chunks(ready[2][cell]):
                yield some, vs._scores(q[some], x, "l2")

        return self._scan(queries, k, probes, key, vector, exclude_self, "embedding", measure)

    def search_codes(self, queries: DataFrame, k: int = 10, probes: int = 0, oversample: int = 5, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
        """As search, with code_distance: candidates come from the codes alone, oversample * k for each query, and are put in order
        by exact distances. The second step reads the vectors of the candidates' cells only."""
        model, _, books, _ = self._load()
        if not books:
            raise ValueError("the index has no codes")
        width = books[0].shape[1]

        def measure(ready, cell, frame):
            q, code = ready[1], _matrix(frame["code"], np.int64)
            for some in _chunks(ready[2][cell]):
                rest, d = q[some] - model.centres[cell], 0.0
                for i, b in enumerate(books):
                    d = d + vs._scores(rest[:, i * width : (i + 1) * width], b, "l2")[:, code[:, i]]
                yield some, d

        found = self._scan(queries, k * oversample, probes, key, vector, exclude_self, "code", measure)
        path = work_dir(self.spark) + "/candidates"
        found.select("query_id", "vec_id", "cell", F.col("distance").alias("code_distance"), "share").write.parquet(path)
        found = self.spark.read.parquet(path)
        wanted = [r["cell"] for r in found.select("cell").distinct().collect()]
        x = self.rows().filter(F.col("cell").isin(wanted)).select("cell", "vec_id", F.col("embedding").alias("x"))
        q = queries.filter(sound(vector)).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("q")).dropDuplicates(["query_id"])
        both = found.join(x, ["cell", "vec_id"]).join(q, "query_id").select("query_id", "vec_id", vs.squared_distance("q", "x").alias("distance"), "code_distance", "share")
        return top_per_group(both.distinct(), ["query_id"], [F.col("distance"), F.col("vec_id")], k)

    def _scan(self, queries: DataFrame, k: int, probes: int, key: str, vector: str, exclude_self: bool, column: str, measure) -> DataFrame:
        def scan(handle):
            def run(frames: Iterator) -> Iterator:
                ready = handle.value
                ids, _, at, share = ready
                bests: dict[int, vs.Best] = {}
                for frame in frames:
                    for cell, part in frame.groupby("cell", sort=False):
                        if cell not in at:
                            continue
                        own = part["vec_id"].to_numpy(np.int64)
                        for some, d in measure(ready, cell, part):
                            if exclude_self:
                                d[ids[some][:, None] == own[None]] = np.inf
                            n = int(some[0]) // vs.AT_ONCE
                            bests.setdefault(n, vs.Best(vs.AT_ONCE, k)).add(some - n * vs.AT_ONCE, d, own, cell)
                for n, best in bests.items():
                    if len(best.at):
                        lo = n * vs.AT_ONCE
                        yield best.rows(ids[lo : lo + vs.AT_ONCE]).assign(share=share[lo + best.at], cell=best.mark)

            return run

        rows = self.rows()
        probed = lambda ready: rows.filter(F.col("cell").isin(sorted(ready[2]))).select("vec_id", column, "cell") if column in rows.columns else rows
        return vs._search_blocks(self.spark, queries.filter(sound(vector)), key, vector, self._prepare(probes), scan, probed, k, ", share double, cell int")


def residuals_to(dealt: DataFrame, model: _Model) -> DataFrame:
    """Adds rest: the vector less its cell's centre."""
    shared = dealt.sparkSession.sparkContext.broadcast(model.centres)

    @F.pandas_udf("array<double>")
    def less(v, cell):
        import pandas as pd

        return pd.Series(list(_matrix(v) - shared.value[cell.to_numpy()]))

    return dealt.withColumn("rest", less("embedding", "cell"))


def _matrix(v, kind=np.float64) -> np.ndarray:
    return np.asarray(v.tolist(), kind) if len(v) else np.zeros((0, 1), kind)


def _chunks(at: np.ndarray) -> Iterator[np.ndarray]:
    """Places of queries in order, those of each AT_ONCE queries together."""
    for some in np.split(at, np.flatnonzero(np.diff(at // vs.AT_ONCE)) + 1):
        if len(some):
            yield some
