"""Exact top-k by inner product with an M-tree: paged metric nodes, covering radii, parent distances, best-first search.

Components become integers floor(scale * x), so scores are exact. Inner products become distances by one more coordinate: with M at
least every squared norm, x' = (x, sqrt(M - |x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest x' is the
largest product, and the triangle inequality holds. Squared distances of a query come from the exact integer product; bounds are
compared with a slack above the rounding error.

The tree: routing objects are a bounded sample (``ROUTES`` vectors per dimension, by hash). Every vector goes to its nearest one, there
into one of up to ``RINGS`` rings by its distance (as many as pages are needed), and there into a page of about ``PAGE`` vectors. A ring node has an inner and an
outer covering radius; a page is one row with ids, vectors, and the stored distance of each vector to the parent, in order. Large
rings have many pages; nothing is collected but routing objects and rings, whose number is bounded.

The search is best-first in two waves. Queries travel in blocks of neighbours. First a block meets one page of each ring that lies
nearest, which gives each query a k-th best score. Then it meets the rings that may hold something as good for one of its queries;
inside a page, entries outside the bounds of their stored parent distance are skipped, and the rest is one matrix product. Where
the bounds exclude little (as in many dimensions) this is the scan in blocks that exactness needs.

Defined results: null vectors and vectors with null or non-finite components take no part; vectors are compared within their
dimension only; a query's own rows (its id) are no candidates; fewer than k candidates give fewer rows; ties go to the smaller id;
an empty vector has score 0 with other empty ones; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .core import query, table

SCALE = 256
ROUTES = 64  # routing objects per dimension
RINGS = 16  # per routing object
PAGE = 1_024
BLOCK = 256  # queries that travel together
FIRST = 3  # rings of the first wave


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def _pack(v: np.ndarray) -> bytes:
    """Rows of integers, in 32 bits where they fit; the size of the bytes tells which."""
    small = not v.size or np.abs(v).max() < 2**31
    return v.astype("<i4" if small else "<i8").tobytes()


def _unpack(blob: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(blob, "<i4" if len(blob) == 4 * n * d else "<i8").reshape(n, d).astype(np.int64)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: as doubles where every sum stays below 2^53, else as Python integers."""
    if not a.shape[1] or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


class Tree:
    """``pages(dim, route, ring, deal, n, ids, vectors, distances)`` and, per dimension: routing objects, M, rings (route, ring, inner, outer)."""

    def __init__(self, pages: DataFrame, objects: dict[int, np.ndarray], top: dict[int, float], rings: dict[int, np.ndarray]):
        self.pages, self.objects, self.top, self.rings = pages, objects, top, rings


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1, keepdims=True), 0.0))], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0))


def _assigned(rows: DataFrame, objects: dict[int, np.ndarray], top: dict[int, float]) -> DataFrame:
    """``id, v, dim, route, distance``: the nearest routing object of each row."""
    shared = rows.sparkSession.sparkContext.broadcast((objects, top))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects, top = shared.value
        for batch in batches:
            dims, values = batch.column(2).to_numpy(), batch.column(1).to_pylist()
            route, distance = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                far = _distances(_lifted(np.array([values[i] for i in at], np.int64).reshape(len(at), d), top[d]), _lifted(objects[d], top[d]))
                route[at] = far.argmin(axis=1)
                distance[at] = far[np.arange(len(at)), route[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(route), pa.array(distance)], ["id", "v", "dim", "route", "distance"])

    return cut_lineage(rows.select(F.col("id").cast("long").alias("id"), "v", "dim").mapInArrow(assign, "id long, v array<long>, dim int, route long, distance double"))


def build(vectors: DataFrame, routes: int = ROUTES, page: int = PAGE) -> Tree:
    """Index every row of ``vectors(id, v array<long>)``."""
    rows = cut_lineage(vectors.filter("id is not null").withColumn("dim", F.size("v")).withColumn(
        "norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    top = {r["dim"]: r["top"] for r in rows.groupBy("dim").agg(F.max("norm").alias("top")).collect()}  # a row per dimension
    objects: dict[int, np.ndarray] = {}
    for d in top:
        some = rows.filter(F.col("dim") == d).select("v", F.xxhash64("v", "id").alias("h")).orderBy("h").limit(routes).collect()
        objects[d] = np.array([x["v"] for x in some], np.int64).reshape(len(some), d)
    placed = _assigned(rows, objects, top)
    cuts = cut_lineage(placed.groupBy("dim", "route").agg(F.least(F.lit(RINGS), F.ceil(F.count(F.lit(1)) / page)).alias("parts"), F.percentile_approx("distance", [(i + 1) / RINGS for i in range(RINGS - 1)], 1000).alias("cuts")))
    ringed = cut_lineage(placed.join(cuts, ["dim", "route"]).withColumn("ring", F.floor(F.size(F.filter("cuts", lambda c: c < F.col("distance"))) * F.col("parts") / RINGS).cast("int")).drop("cuts", "parts"))
    sizes = cut_lineage(ringed.groupBy("dim", "route", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("inner"), F.max("distance").alias("outer")))
    rings = {d: np.array([[r["route"], r["ring"], r["inner"], r["outer"]] for r in sizes.filter(F.col("dim") == d).collect()]) for d in top}
    dealt = ringed.join(sizes.select("dim", "route", "ring", "n"), ["dim", "route", "ring"]).withColumn("deal", F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / page)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["distance", "id"])
        v = np.array(group["v"].tolist(), np.int64).reshape(len(group), int(group["dim"].iloc[0]))
        return group[["dim", "route", "ring", "deal"]].iloc[:1].assign(n=len(group), ids=[group["id"].to_numpy(np.int64).tobytes()], vectors=[_pack(v)], distances=[group["distance"].to_numpy().tobytes()])

    pages = dealt.drop("n").groupBy("dim", "route", "ring", "deal").applyInPandas(pack, "dim int, route long, ring int, deal long, n long, ids binary, vectors binary, distances binary")
    return Tree(cut_lineage(pages), objects, top, rings)


def search(tree: Tree, queries: DataFrame, k: int, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``queries(id, v array<long>)``; of a repeated id one row is taken."""
    asked = queries.filter("id is not null").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = _assigned(asked, tree.objects, tree.top)
    sizes = cut_lineage(asked.groupBy("dim", "route").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")))
    asked = cut_lineage(asked.join(sizes, ["dim", "route"]).select("id", "v", "dim", F.concat_ws("-", "dim", "route", F.pmod(F.xxhash64("id"), "parts")).alias("block")))
    begun = _wave(tree, asked.withColumn("least", F.lit(float("-inf"))), k, first)
    best = begun.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("s"))  # k rows of a few pages each
    least = F.when(F.size("s") == k, F.element_at("s", -1).cast("double")).otherwise(float("-inf"))
    known = asked.join(best.select(F.col("query_id").alias("id"), least.alias("least")), "id", "left").fillna(float("-inf"), ["least"])
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return _wave(tree, known, k, None).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _wave(tree: Tree, asked: DataFrame, k: int, first: int | None) -> DataFrame:
    """``query_id, vec_id, score``: the best k of each page that a query's block meets. ``asked(id, v, dim, block, least)``.

    ``first`` says how many rings to try, with one page each; without it, all that may hold a score of at least ``least``.
    """
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast((tree.objects, tree.top, tree.rings))

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        v = np.array(group["v"].tolist(), np.int64).reshape(len(group), int(group["dim"].iloc[0]))
        return group[["block", "dim"]].iloc[:1].assign(m=len(group), q_ids=[group["id"].to_numpy(np.int64).tobytes()], q_vectors=[_pack(v)], q_least=[group["least"].to_numpy(np.float64).tobytes()])

    blocks = cut_lineage(asked.groupBy("block").applyInPandas(gather, "block string, dim int, m long, q_ids binary, q_vectors binary, q_least binary"))

    def reach(q: np.ndarray, least: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each query to each routing object, and the radius inside which its answers lie."""
        objects, top, _ = shared.value
        norm = (q.astype(np.float64) ** 2).sum(axis=1)
        far = _distances(np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1), _lifted(objects[dim], top[dim]))
        return far, np.sqrt(np.maximum(norm + top[dim] - 2 * least, 0.0)) * (1 + 1e-9) + 1e-3

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                d, rings = row["dim"], shared.value[2][row["dim"]]
                q, least = _unpack(row["q_vectors"], row["m"], d), np.frombuffer(row["q_least"], np.float64)
                far, radius = reach(q, least, d)
                far = far[:, rings[:, 0].astype(int)]
                low = np.maximum(np.maximum(far - rings[:, 3], rings[:, 2] - far), 0.0)
                good = np.argsort(low.mean(axis=0), kind="stable")[:first] if first else np.flatnonzero((low <= radius[:, None]).any(axis=0))
                out += [(row["block"], d, int(rings[i, 0]), int(rings[i, 1])) for i in good]
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "dim", "route", "ring"), x)) for x in out], pa.schema([("block", pa.string()), ("dim", pa.int32()), ("route", pa.int64()), ("ring", pa.int32())]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for row in batch.to_pylist():
                d, n = row["dim"], row["n"]
                q, least = _unpack(row["q_vectors"], row["m"], d), np.frombuffer(row["q_least"], np.float64)
                far, radius = reach(q, least, d)
                parent = np.frombuffer(row["distances"], np.float64)
                near = far[:, row["route"]]
                low, high = np.searchsorted(parent, (near - radius).min()), np.searchsorted(parent, (near + radius).max(), "right")
                ids = np.frombuffer(row["ids"], np.int64)[low:high]
                scores = _scores(q, _unpack(row["vectors"], n, d)[low:high])
                for i, me in enumerate(np.frombuffer(row["q_ids"], np.int64)):
                    at = np.flatnonzero((ids != me) & (scores[i] >= least[i]))
                    at = at[np.lexsort((ids[at], -scores[i][at]))][:k] if len(at) else at
                    found.append((np.full(len(at), me), ids[at], scores[i][at].astype(np.int64)))
            columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    pairs = cut_lineage(blocks.mapInArrow(choose, "block string, dim int, route long, ring int"))
    pages = tree.pages.filter("deal = 0") if first else tree.pages
    met = pairs.join(pages, ["dim", "route", "ring"]).join(blocks.drop("dim"), "block")
    return cut_lineage(met.mapInArrow(match, "query_id long, vec_id long, score long"))


@query("op10_metric_search")
def op10(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), integers(F.col("embedding")).alias("v"))
    return search(build(vectors), vectors.filter("id % 50 = 0"), 5)
