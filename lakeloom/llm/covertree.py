"""Exact top-k by inner product: cover trees over queries and data, searched together.

Every data partition is cut into blocks, and each block is indexed by a cover tree; so is each
block of queries. A pair of nodes (query node with centre p and radius r, data node with centre q and radius s) has no
score above  <p, q> + |p| s + |q| r + r s,  and none below  <p, q>  less the same. A pair whose upper bound is below the
worst kth score of the query group, or below the group's (k+1)th largest lower bound, is pruned; leaves that
remain are compared exactly, the most promising first. The traversal goes down both trees level by level, over all
pairs of a level at once, as long as bounds are few beside the pairs of rows (a 64th): where data has no clusters, radii hide
everything, and the pairs of nodes reached by then are compared by one matrix product each, a million scores at a time.
Partial results are merged by (score, id) over partitions, so the result is exact and independent of the blocks.
Leaves have up to ``LEAF`` points, scored together.

Query blocks have at most ``query_block`` rows; only one is held by the driver and broadcast at
a time. Data is never collected.

Components are floor(scale * x) as integers. Products are exact in float64 while a block's
largest possible score stays below 2**53; otherwise leaves are compared in Python integers, and bounds have a slack
of 1e-11 of the product of the nodes' largest norms, which is far above their rounding. A score that does not fit a long
raises an error.

Defined results: vectors that are null or hold null or non-finite components take no part, nor
do rows without an id; vectors of different lengths have no score with each other; identical
rows count once, of rows that share an id the smallest vector counts; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch

LEAF, FAN = 32, 64
PAYS = 64  # there may be a bound for so many pairs of rows
CELLS = 1 << 20  # scores and bounds held at once


class CoverTree:
    """A cover tree over the rows of points. The children of a node are a net of its points, chosen farthest first: centres
    are at least the node's ``reach`` apart, and every point is within it of its own, the nearest, centre. As in a cover
    tree of fixed scales, but each node's scale is the one at which its net has at most ``fan`` centres, so that flat data,
    where a fixed scale would need as many centres as points, keeps a bounded fan; there only so many centres are kept as
    leaves are needed. Radii are the true ones.
    Nodes are arrays: centre, radius, reach, children, rows of leaves; children come after their node."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, base: float = 1.6, fan: int = FAN):
        self.points, self.leaf, self.base, self.fan = points, leaf, base, fan
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.reach: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        if len(points):
            self._build()

    def _distances(self, rows: np.ndarray, c: int) -> np.ndarray:
        d = self.points[rows] - self.points[c]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _node(self, c: int, radius: float) -> int:
        self.centre.append(c)
        self.radius.append(radius)
        self.reach.append(0.0)
        self.children.append([])
        self.rows.append(None)
        return len(self.centre) - 1

    def _build(self) -> None:
        everything = np.arange(len(self.points))
        d = self._distances(everything, 0)
        todo = [(self._node(0, float(d.max())), everything, d)]
        while todo:
            node, rows, d = todo.pop()
            if len(rows) <= self.leaf or self.radius[node] == 0:
                self.rows[node] = rows
                continue
            centres, own, least = [self.centre[node]], np.zeros(len(rows), np.int64), d
            while len(centres) < self.fan and least.max() > self.radius[node] / self.base**4:
                centres.append(int(rows[int(least.argmax())]))
                far = self._distances(rows, centres[-1])
                own = np.where(far < least, len(centres) - 1, own)
                least = np.minimum(least, far)
            if least.max() > self.radius[node] / self.base**4 and len(centres) > (few := max(2, -(-len(rows) // self.leaf))):
                centres, own, least = centres[:few], np.zeros(len(rows), np.int64), d
                for i, c in enumerate(centres[1:], 1):
                    far = self._distances(rows, c)
                    own, least = np.where(far < least, i, own), np.minimum(least, far)
            self.reach[node] = float(least.max())
            for i, c in enumerate(centres):
                mine = own == i
                child = self._node(c, float(least[mine].max()))
                self.children[node].append(child)
                todo.append((child, rows[mine], least[mine]))


class TopK:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        self.worst = np.full(n, -np.inf)
        self.bounded = self.compared = 0  # pairs of nodes with bounds, pairs of rows with scores

    def offer(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        best = np.lexsort((i, -s))[: self.k]
        self.score[q], self.ids[q] = s[best], i[best]
        if len(best) == self.k:
            self.worst[q] = s[best[-1]]


class _Flat:
    """A tree's nodes as arrays, for steps over many nodes at once."""

    def __init__(self, tree: CoverTree):
        self.tree, self.centre, self.radius = tree, np.asarray(tree.centre), np.asarray(tree.radius)
        self.norm = np.linalg.norm(tree.points[self.centre], axis=1)
        self.leaf = np.asarray([rows is not None for rows in tree.rows])
        self.many = np.asarray([len(c) for c in tree.children])
        self.first = np.cumsum(self.many) - self.many
        self.child = np.asarray([c for children in tree.children for c in children], np.int64)

    def rows(self, node: int) -> np.ndarray:
        """The rows under a node."""
        todo, out = [node], []
        while todo:
            n = todo.pop()
            if self.leaf[n]:
                out.append(self.tree.rows[n])
            else:
                todo += self.tree.children[n]
        return np.concatenate(out)

    def least_below(self, values: np.ndarray) -> np.ndarray:
        """The least of its rows' values, for each node."""
        out = np.empty(len(self.centre))
        for n in range(len(out) - 1, -1, -1):
            rows = self.tree.rows[n]
            out[n] = values[rows].min() if rows is not None else out[self.tree.children[n]].min()
        return out

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of all nodes, a leaf for itself, and for each the place of its node in nodes."""
        many = np.maximum(self.many[nodes], 1)
        owner = np.repeat(np.arange(len(nodes)), many)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        out = nodes[owner]
        inner = ~self.leaf[out]
        out[inner] = self.child[self.first[out[inner]] + place[inner]]
        return out, owner


def _bounds(q: _Flat, d: _Flat, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """No score of rows under the query nodes a and the data nodes b is below the first or above the second."""
    some, i = np.unique(a, return_inverse=True)
    others, j = np.unique(b, return_inverse=True)
    if len(some) * len(others) <= max(4 * len(a), CELLS):
        dots = (q.tree.points[q.centre[some]] @ d.tree.points[d.centre[others]].T)[i, j]
    else:
        step = max(1, CELLS // q.tree.points.shape[1])
        dots = np.concatenate([np.einsum("ij,ij->i", q.tree.points[q.centre[a[n : n + step]]], d.tree.points[d.centre[b[n : n + step]]]) for n in range(0, len(a), step)])
    room = q.norm[a] * d.radius[b] + q.radius[a] * (d.norm[b] + d.radius[b]) + 1e-11 * (q.norm[a] + q.radius[a]) * (d.norm[b] + d.radius[b]) + 1e-6
    return dots - room, dots + room


def dual_tree_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, query_tree: CoverTree | None = None, best: TopK | None = None, chunk: int = 16) -> TopK:
    """Adds the rows of data to each query's best k. Vectors are integers held as float64, exact below 2**53."""
    best = best or TopK(len(queries), k)
    if not len(queries) or not len(data):
        return best
    q, d = _Flat(query_tree or CoverTree(queries)), _Flat(CoverTree(data))
    small = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1] < 2.0**53

    def compare(mine: np.ndarray, data_nodes: np.ndarray) -> None:
        b = np.concatenate([d.rows(n) for n in data_nodes])
        best.compared += len(mine) * len(b)
        for lo in range(0, len(b), CELLS):
            some = b[lo : lo + CELLS]
            step = max(1, CELLS // len(some))
            for at in range(0, len(mine), step):
                score_rows(mine[at : at + step], some)

    def score_rows(a: np.ndarray, b: np.ndarray) -> None:
        scores = queries[a] @ data[b].T if small else queries[a].astype(np.int64).astype(object) @ data[b].T.astype(np.int64).astype(object)
        own = query_ids[a][:, None] == ids[b][None]
        scores[own] = 0  # a query is no candidate of its own
        scores = scores.astype(np.int64)
        scores[own] = np.iinfo(np.int64).min
        fit = (scores >= best.worst[a][:, None]) & ~own
        if len(b) > k:
            fit &= scores >= np.partition(scores, len(b) - k, axis=1)[:, len(b) - k][:, None]
        for row in np.flatnonzero(fit.any(1)):
            best.offer(int(a[row]), scores[row][fit[row]], ids[b][fit[row]])

    least, before = q.least_below(best.worst), best.bounded
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(a):
        lower, upper = _bounds(q, d, a, b)
        best.bounded += len(a)
        order = np.lexsort((-lower, a))
        groups, first, many = np.unique(a[order], return_index=True, return_counts=True)
        enough = many > k  # one of these may be the query itself
        least[groups[enough]] = np.maximum(least[groups[enough]], lower[order[first[enough] + k]])
        keep = upper >= least[a]  # equal scores may still win by a smaller id
        a, b, upper = a[keep], b[keep], upper[keep]
        ends = q.leaf[a] & d.leaf[b]
        after = (np.maximum(q.many[a], 1) * np.maximum(d.many[b], 1))[~ends].sum()
        if (best.bounded - before + after) * PAYS > len(queries) * len(data):
            ends[:] = True  # more bounds don't pay
        left.append((a[ends], b[ends], upper[ends]))
        a, b = a[~ends], b[~ends]
        over, owner = q.below(a)
        least[over] = np.maximum(least[over], least[a[owner]])
        a, b = over, b[owner]
        below, owner = d.below(b)
        a, b = a[owner], below
    a, b, upper = (np.concatenate(x) for x in zip(*left, strict=True))
    keep = upper >= least[a]
    a, b, upper = a[keep], b[keep], upper[keep]
    order = np.lexsort((-upper, a))
    a, b, upper = a[order], b[order], upper[order]
    groups, first = np.unique(a, return_index=True)
    for n, lo, hi in zip(groups, first, [*first[1:], len(a)], strict=True):
        mine = q.rows(n)
        while lo < hi and upper[lo] >= best.worst[mine].min():
            to = min(hi, lo + chunk)
            compare(mine, b[lo:to])
            lo = to
    return best


def _block_search(handle, k: int, data_block: int):
    import pandas as pd

    def scan(frames):
        held: list[pd.DataFrame] = []
        trees: dict[int, CoverTree] = {}
        best: dict[int, TopK] = {}
        query_ids, vectors = handle.value
        sizes = np.asarray([len(v) for v in vectors])
        groups = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        matrix = {n: np.asarray([vectors[i] for i in rows], np.float64) for n, rows in groups.items()}

        def search():
            frame = pd.concat(held)
            held.clear()
            length = frame["v"].map(len).to_numpy()
            for n, rows in groups.items():
                own = frame[length == n]
                if len(own):
                    if n not in trees:
                        trees[n], best[n] = CoverTree(matrix[n]), TopK(len(rows), k)
                    dual_tree_search(matrix[n], query_ids[rows], np.asarray(own["v"].tolist(), np.float64).reshape(len(own), n), own["vec_id"].to_numpy(np.int64), k, trees[n], best[n])

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= data_block:
                search()
        if held:
            search()
        for n, rows in groups.items():
            if n in best:
                for at, row in enumerate(rows):
                    if len(best[n].ids[at]):
                        yield pd.DataFrame({"query_id": query_ids[row], "vec_id": best[n].ids[at], "score": best[n].score[at]})

    return scan


def usable_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the integer components; unusable and repeated rows are gone."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    ints = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e).cast("long"))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def exact_top_k(spark: SparkSession, vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, query_block: int = 4096, data_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of every query's best k. is_query: a condition on vec_id."""
    scratch = Scratch(spark)
    data = scratch.save(usable_vectors(vectors, scale), "vectors")
    merge = "query_id long, vec_id long, score long"
    parts, ids, rows = 0, [], []

    def run_block() -> None:
        nonlocal parts
        handle = spark.sparkContext.broadcast((np.asarray(ids, np.int64), list(rows)))
        found = data.mapInPandas(_block_search(handle, k, data_block), merge)
        scratch.save(_ranked(found, k), f"found/part={parts}")
        handle.unpersist()
        parts += 1
        ids.clear()
        rows.clear()

    for row in data.filter(is_query).toLocalIterator():
        ids.append(row["vec_id"])
        rows.append(row["v"])
        if len(ids) == query_block:
            run_block()
    if ids or not parts:
        run_block()
    out = spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*[f"{scratch.root}/found/part={i}" for i in range(parts)])
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Merges partial results. At most k rows of each query come from a task."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))), 1, k)
    lists = found.groupBy("query_id").agg(best.alias("best"))
    rows = lists.select("query_id", F.posexplode("best").alias("p", "b"))
    return rows.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))
