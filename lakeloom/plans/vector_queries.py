"""Queries of vector search. Approximate ones are judged by recall or error bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import rotations as ro
from lakeloom.operators import vectors as vs
from lakeloom.operators.cells import CellIndex
from lakeloom.plans.registry import query
from lakeloom.sources.formats import work_dir

_CAST = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def _knn(distance: str) -> str:
    return f"WITH {_CAST}, d AS (SELECT q.vec_id AS query_id, c.vec_id, {distance} AS distance FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(distance, 4) AS distance FROM r WHERE rank <= 10"


def _queries(t):
    return t.embeddings.filter("vec_id % 50 = 0")


@query("vs1_nearest_l2", _knn("list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])))"))
def _(t):
    return vs.nearest(t.spark, _queries(t), t.embeddings, 10).select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


@query("vs1_nearest_cosine", _knn("1 - list_dot_product(q.x, c.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(c.x, c.x)))"))
def _(t):
    return vs.nearest(t.spark, _queries(t), t.embeddings, 10, "cosine").select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


@query("vs1_nearest_inner_product", _knn("-list_dot_product(q.x, c.x)"))
def _(t):
    return vs.nearest(t.spark, _queries(t), t.embeddings, 10, "dot").select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


@query("vs2_kmeans_cells")
def _(t):
    return vs.assign_cells(t.embeddings, vs.kmeans(t.embeddings, 16)).groupBy("cell").agg(F.count("*").alias("n"))


def _clustered(t):
    """The vectors drawn towards 24 of them, those with the least id of each hash class."""
    x = t.embeddings.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(24)).alias("c"))
    at = x.groupBy("c").agg(F.min_by("embedding", "vec_id").alias("centre"))
    return x.join(F.broadcast(at), "c").select("vec_id", F.zip_with("centre", "embedding", lambda a, b: a.cast("double") + 0.25 * b.cast("double")).alias("embedding"))


def _index(t, data, **options):
    return CellIndex(t.spark, work_dir(t.spark) + "/cells").build(data, **options)


@query("vs3_inverted_file_search")
def _(t):
    return _index(t, t.embeddings).search(_queries(t), 10).drop("cell")


@query("vs3_clustered_search")
def _(t):
    x = _clustered(t)
    return _index(t, x).search(x.filter("vec_id % 50 = 0"), 10).drop("cell")


@query("vs7_ivf_with_product_codes")
def _(t):
    return _index(t, t.embeddings, parts=32).search_codes(_queries(t), 10)


@query("vs7_clustered_codes")
def _(t):
    x = _clustered(t)
    return _index(t, x, parts=16).search_codes(x.filter("vec_id % 50 = 0"), 10)


@query("vs4_residuals")
def _(t):
    x = vs.residuals(t.embeddings, vs.kmeans(t.embeddings, 16))
    return x.select("vec_id", "cell", F.round(F.sqrt(vs.dot("residual", "residual")), 5).alias("length"))


@query("vs5_product_codes")
def _(t):
    return vs.ProductQuantizer(8, 16).fit(t.embeddings).encode(t.embeddings).select("vec_id", "code")


@query("vs6_asymmetric_distance")
def _(t):
    pq = vs.ProductQuantizer(32, 64).fit(t.embeddings)
    return pq.search(t.spark, _queries(t), pq.encode(t.embeddings), 50)


@query("vs6_symmetric_distance")
def _(t):
    pq = vs.ProductQuantizer(32, 64).fit(t.embeddings)
    return pq.search(t.spark, _queries(t), pq.encode(t.embeddings), 50, symmetric=True)


@query("vs9_scalar_quantisation", f"""WITH {_CAST}, u AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e), b AS (SELECT i, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1)
SELECT vec_id, CAST(sum(CASE WHEN hi = lo THEN 0 ELSE round((v - lo) / (hi - lo) * 255) END) AS BIGINT) AS code_sum FROM u JOIN b USING (i) GROUP BY 1""")
def _(t):
    low, high = vs.scalar_ranges(t.embeddings)
    code = vs.scalar_quantize("embedding", low, high)
    return t.embeddings.select("vec_id", F.aggregate(code, F.lit(0).cast("long"), lambda a, b: a + b).alias("code_sum"))


@query("vs10_sign_bits_hamming", f"""WITH {_CAST}, s AS (SELECT vec_id, list_transform(x, lambda v: v > 0) AS b FROM e), d AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(len(list_filter(range(1, 65), lambda i: q.b[i] <> c.b[i])) AS INTEGER) AS distance FROM s q JOIN s c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, vec_id, distance FROM r WHERE rank <= 20""")
def _(t):
    s = t.embeddings.select("vec_id", vs.sign_bits("embedding").alias("b")).filter("b is not null").select("vec_id", vs.bit_halves("b").alias("halves"))
    found = vs.nearest(t.spark, s.filter("vec_id % 50 = 0"), s, 20, "bits", vector="halves")
    return found.select("query_id", "vec_id", F.col("distance").cast("int").alias("distance"))


@query("vs11_oversample_and_rerank")
def _(t):
    short = lambda df: df.select("vec_id", F.slice("embedding", 1, 48).alias("embedding"))
    low = vs.nearest(t.spark, short(_queries(t)), short(t.embeddings), 100)
    return vs.rerank(t.spark, low, t.embeddings, _queries(t), 10)


@query("vs12_prefix_funnel")
def _(t):
    return vs.funnel(t.spark, _queries(t), t.embeddings, [(32, 400), (48, 100), (64, 10)])


@query("vs13_graph_search")
def _(t):
    return vs.graph_search(t.spark, _queries(t), t.embeddings, 10)


@query("vs8_learned_rotation")
def _(t):
    axes, pq, _ = ro.learn_rotation(t.embeddings, 32, 64)
    turned = vs.rotate(t.embeddings, axes)
    return pq.search(t.spark, turned.filter("vec_id % 50 = 0"), pq.encode(turned), 50)


@query("vs8_rotation_errors", "SELECT CAST(i AS INTEGER) AS round, TRUE AS no_worse FROM range(0, 9) r(i)")
def _(t):
    """Whether the squared error rose in a round; the start are principal axes."""
    _, _, errors = ro.learn_rotation(t.embeddings, 32, 64)
    rows = [(i, e <= errors[max(0, i - 1)] * (1 + 1e-9)) for i, e in enumerate(errors)]
    return t.spark.createDataFrame(rows, "round int, no_worse boolean")


@query("vs8_weighted_codes")
def _(t):
    """Rows by the inner product of codes whose error along the vector counts four times."""
    pq = ro.AnisotropicQuantizer(32, 64).fit_weighted(t.embeddings)
    return pq.search(t.spark, _queries(t), pq.encode(t.embeddings), 50)


@query("vs8_weighted_codes_recall", "SELECT TRUE AS enough FROM (SELECT 1)")
def _(t):
    found = _registered("vs8_weighted_codes")(t).select("query_id", "vec_id")
    true = vs.nearest(t.spark, _queries(t), t.embeddings, 10, "dot")
    return true.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").agg((F.count("hit") / F.count("*") >= 0.9).alias("enough"))


@query("vs15_recall_of_full_probe", "SELECT 1.0 AS recall FROM (SELECT 1)")
def _(t):
    centres = vs.kmeans(t.embeddings, 8)
    found = vs.ivf_search(t.spark, _queries(t), t.embeddings, centres, 10, 8)
    return vs.recall(found, vs.nearest(t.spark, _queries(t), t.embeddings, 10))


def _reaches(name: str, found, first: int) -> None:
    """A query that tells whether another one's first rows, reranked by exact distances, hold 0.9 of the true neighbours."""

    @query(f"{name}_recall", "SELECT TRUE AS enough FROM (SELECT 1)")
    def _(t):
        candidates = found(t)
        if first > 10:
            candidates = vs.rerank(t.spark, candidates.filter(F.col("rank") <= first), t.embeddings, _queries(t), 10)
        return vs.recall(candidates, vs.nearest(t.spark, _queries(t), t.embeddings, 10)).select((F.col("recall") >= 0.9).alias("enough"))


def _registered(name: str):
    from lakeloom.plans.registry import QUERIES

    return lambda t: QUERIES[name](t.spark, t.sf_dir)


for _name, _first in (("vs3_inverted_file_search", 10), ("vs6_asymmetric_distance", 50), ("vs6_symmetric_distance", 50), ("vs7_ivf_with_product_codes", 10), ("vs8_rotated_codes", 50), ("vs8_learned_rotation", 50), ("vs11_oversample_and_rerank", 10), ("vs12_prefix_funnel", 10), ("vs13_graph_search", 10)):
    _reaches(_name, _registered(_name), _first)


def _prunes(name: str) -> None:
    """A query that tells whether a search of clustered vectors finds 0.9 of the true neighbours and reads a quarter of the rows at most."""

    @query(f"{name}_recall", "SELECT TRUE AS enough, TRUE AS pruned FROM (SELECT 1)")
    def _(t):
        found, x = _registered(name)(t), _clustered(t)
        path = work_dir(t.spark) + "/found"
        found.write.parquet(path)
        found = t.spark.read.parquet(path)
        share = found.agg((F.avg("share") <= 0.25).alias("pruned"))
        return vs.recall(found, vs.nearest(t.spark, x.filter("vec_id % 50 = 0"), x, 10)).select((F.col("recall") >= 0.9).alias("enough")).crossJoin(share)


for _name in ("vs3_clustered_search", "vs7_clustered_codes"):
    _prunes(_name)
