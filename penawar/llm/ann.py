"""Approximate nearest neighbours with balanced posting lists and an in-memory centroid graph.

Fit. Centroids come from balanced two-means splits of a bounded sample (``sample_rows`` vectors
of least hash): each split cuts at the median of the projection on the line between its two means,
so all leaves hold nearly equally many vectors. A neighbour graph over the centroids (nearest ones both
ways, and a path along the split order) is searched best first from spread entry points.

Index. Every vector joins the list of its nearest centroid and, if it lies near a boundary, those of
other centroids up to (1 + closure) times as far, ``replicas`` at most. Equal vectors tie for any
query, so only the k + 1 smallest ids of each distinct vector can be in a result: the others are
left out before lists are dealt, which also keeps one very common vector from filling a list. A list
of more than ``piece_rows`` rows is dealt into pieces by hash.

Search. Distinct query vectors find their nearest centroids in the graph; distance-ratio pruning
keeps those up to (1 + probe) times as far as the nearest, and as many as needed to hold enough
candidates for k results. The graph search looks for ``lists`` centroids; a query whose ratio reaches beyond them is
measured against all centroids, so no number of lists is a
limit (within the beam the graph search may miss a centroid). Without a ratio (None) every list is searched and the
result is exact. Queries meet the pieces of their lists; every meeting gives its k + 1
nearest by exact Euclidean distance in double precision, a window merges them.

Rows: null, zero or non-finite vectors, null ids and vectors of another length than most take no
part. Vectors are scaled by a power of two to their largest component before single precision is used for choosing
lists, so large components are no special case. A row isn't a candidate of a query with the same id; rows of one id with different vectors are
as near as the nearest of them, as queries and as candidates. Ties go to the smaller id. Repeated
rows count once. Only the id and vector columns are read; empty input gives no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penawar.llm.common import columns_of, written
from penawar.session import ship_package

SAMPLE_ROWS = 16_384
LIST_ROWS = 128
LEAST_PER_CENTROID = 8
REPLICAS = 4
CLOSURE = 0.15
PROBE = 0.13
LISTS = 96
PIECE_ROWS = 4096
DEGREE = 16
SEED = 23


# ---- index in memory: bounded by the sample ---------------------------------------------

def balanced_centroids(x: np.ndarray, lists: int, seed: int = SEED) -> np.ndarray:
    """Means of ``lists`` leaves of nearly equal size, in the order of the splits."""
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []

    def split(rows: np.ndarray, k: int) -> None:
        if k <= 1 or len(rows) <= 1:
            out.append(x[rows].mean(axis=0))
            return
        a, b = x[rng.choice(rows, 2, replace=False)]
        left = k // 2
        cut = len(rows) * left // k
        for _ in range(6):
            order = np.argsort(x[rows] @ (b - a), kind="stable")
            rows = rows[order]
            a, b = x[rows[:cut]].mean(axis=0) if cut else a, x[rows[cut:]].mean(axis=0)
        split(rows[:cut], left)
        split(rows[cut:], k - left)

    split(np.arange(len(x)), lists)
    return np.vstack(out)


@dataclass
class CentroidGraph:
    centroids: np.ndarray  # (K, d) float32
    neighbours: np.ndarray  # (K, degree) int32
    entries: np.ndarray
    sizes: np.ndarray  # vectors whose nearest centroid it is, at least; filled when indexed
    scale: float = 1.0  # of vectors before they meet the centroids

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = DEGREE, scale: float = 1.0) -> "CentroidGraph":
        c = centroids.astype(np.float32)
        k = len(c)
        m = min(degree, max(k - 1, 0))
        near = np.empty((k, m + 2), np.int32)
        square = (c * c).sum(axis=1)
        for lo in range(0, k, 512):
            d = square[None, :] - 2 * c[lo:lo + 512] @ c.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            if m:
                near[lo:lo + 512, :m] = np.argpartition(d, m - 1, axis=1)[:, :m]
        ids = np.arange(k)
        near[:, m], near[:, m + 1] = (ids + 1) % k, (ids - 1) % k  # keeps the graph connected
        return cls(c, near, np.unique(np.linspace(0, k - 1, min(k, 24)).astype(np.int32)), np.zeros(k, np.int64), scale)

    def measure(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of all centroids, nearest first."""
        q, c = (q * self.scale).astype(np.float32), self.centroids
        d = np.maximum((c * c).sum(axis=1)[None, :] - 2 * q @ c.T + (q * q).sum(axis=1)[:, None], 0)
        ids = np.argsort(d, axis=1, kind="stable")
        return ids, np.take_along_axis(d, ids, axis=1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries at once: (ids, squared distances), nearest first; -1 pads.

        A round opens the nearest unopened node of each query's ``width`` best and stops when all are open."""
        q = (q * self.scale).astype(np.float32)
        n, k = len(q), len(self.centroids)
        width = min(width, k)
        square = (self.centroids ** 2).sum(axis=1)

        def dist(ids):
            return square[ids] - 2 * np.einsum("nd,nmd->nm", q, self.centroids[ids]) + (q * q).sum(axis=1)[:, None]

        ids = np.repeat(self.entries[None, :], n, axis=0)
        d = dist(ids)
        opened = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            ids, d, opened = (np.take_along_axis(z, order, axis=1) for z in (ids, d, opened))
            closed = ~opened & np.isfinite(d)
            rows = np.flatnonzero(closed.any(axis=1))
            if not len(rows):
                break
            at = closed[rows].argmax(axis=1)
            opened[rows, at] = True
            new = np.full((n, self.neighbours.shape[1]), -1, np.int32)
            new[rows] = self.neighbours[ids[rows, at]]
            nd = np.where(new >= 0, dist(np.maximum(new, 0)), np.inf)
            nd[(new[:, :, None] == ids[:, None, :]).any(axis=2)] = np.inf
            first = new[:, :, None] == new[:, None, :]  # a node may be a neighbour twice
            nd[(first & np.tri(new.shape[1], k=-1, dtype=bool)[None]).any(axis=2)] = np.inf
            ids, d = np.concatenate([ids, new], axis=1), np.concatenate([d, nd], axis=1)
            opened = np.concatenate([opened, np.zeros(new.shape, bool)], axis=1)
        return np.where(np.isfinite(d), ids, -1), np.maximum(d, 0)


def fit_graph(vectors: DataFrame, rows: int, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, seed: int = SEED) -> CentroidGraph:
    """Centroids and graph from at most ``sample_rows`` vectors; ``rows``: how many the index will hold."""
    sample = (vectors.orderBy(F.xxhash64(F.lit(seed), "vec"), "vec").limit(sample_rows).select("vec").collect())
    most = vectors.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]  # one number
    scale = float(np.ldexp(1.0, -np.frexp(most)[1]))
    x = (np.array([r.vec for r in sample], np.float64) * scale).astype(np.float32)
    lists = max(1, min(-(-rows // list_rows), len(x) // LEAST_PER_CENTROID))
    return CentroidGraph.build(balanced_centroids(x, lists, seed), scale=scale)


# ---- tables -----------------------------------------------------------------------------

def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>): rows that take part."""
    v = columns_of(df, id_col, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(fine)
    # the most frequent length: one row
    length = (v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect())
    return v.where(F.size("vec") == (length[0]["n"] if length else 0))


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.to_list(), np.float64)


def _reach(d: np.ndarray, ratio: float | None) -> np.ndarray:
    """How far a row's lists may be, from its squared distances in order."""
    return np.full((len(d), 1), np.inf) if ratio is None else (1 + ratio) * np.sqrt(d[:, :1]) + 1e-12


def _pick(ids: np.ndarray, d: np.ndarray, ratio: float | None, most: int | None = None, sizes: np.ndarray | None = None, enough: int = 0):
    """Per row the lists up to (1 + ratio) times as far as the nearest, ``most`` at most; with ``sizes`` at least those
    that hold ``enough`` vectors."""
    keep = (ids >= 0) & (np.sqrt(d) <= _reach(d, ratio))
    if most is not None:
        keep[:, most:] = False
    if sizes is not None:
        held = np.cumsum(np.where(ids >= 0, sizes[np.maximum(ids, 0)], 0), axis=1)
        keep |= (ids >= 0) & (held - np.where(ids >= 0, sizes[np.maximum(ids, 0)], 0) < enough)
    return keep


_LISTED = "id long, vec array<double>, list int, first boolean"


def assign(vectors: DataFrame, graph: CentroidGraph, replicas: int = REPLICAS, closure: float = CLOSURE) -> DataFrame:
    """(id, vec, list, first): a vector's nearest list first, and those it is replicated to."""
    shared = vectors.sparkSession.sparkContext.broadcast(graph)  # bounded by the sample

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo:lo + 2048]
                ids, d = shared.value.search(_matrix(part["vec"]), 2 * replicas + 8)
                r, c = np.nonzero(_pick(ids, d, closure, replicas))
                yield pd.DataFrame({"id": part["id"].to_numpy()[r], "vec": part["vec"].to_numpy()[r],
                                    "list": ids[r, c].astype(np.int32), "first": c == 0})

    return vectors.mapInPandas(run, _LISTED)


def probe(queries: DataFrame, graph: CentroidGraph, k: int, ratio: float | None = PROBE, lists: int = LISTS) -> DataFrame:
    """(q, vec, list): the lists that each query searches."""
    shared = queries.sparkSession.sparkContext.broadcast(graph)

    def picked(part, ids, d, g):
        r, c = np.nonzero(_pick(ids, d, ratio, None, g.sizes, k + 1))
        return pd.DataFrame({"q": part["q"].to_numpy()[r], "vec": part["vec"].to_numpy()[r], "list": ids[r, c].astype(np.int32)})

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part, g = pdf.iloc[lo:lo + 256], shared.value
                x = _matrix(part["vec"])
                ids, d = g.search(x, lists)
                beyond = np.zeros(len(x), bool)
                if ids.shape[1] < len(g.centroids):
                    held = np.where(ids >= 0, g.sizes[np.maximum(ids, 0)], 0).sum(axis=1)
                    beyond = (np.sqrt(d[:, -1:]) <= _reach(d, ratio))[:, 0] | (held <= k)
                yield picked(part[~beyond], ids[~beyond], d[~beyond], g)
                rest = np.flatnonzero(beyond)
                for at in range(0, len(rest), 32):
                    some = rest[at:at + 32]
                    yield picked(part.iloc[some], *g.measure(x[some]), g)

    return queries.mapInPandas(run, "q long, vec array<double>, list int")


_FOUND = "q long, id long, score double"


def _meet(k: int):
    def run(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(vs):
            x, ids = _matrix(vs["vec"]), vs["id"].to_numpy()
            square = (x * x).sum(axis=1)
            for lo in range(0, len(qs), 256):
                part = qs.iloc[lo:lo + 256]
                y = _matrix(part["vec"])
                rough = square[None, :] - 2 * y @ x.T + (y * y).sum(axis=1)[:, None]
                # all that may be among the k + 1 nearest when computed exactly
                kth = np.partition(rough, k, axis=1)[:, k] if len(x) > k + 1 else np.full(len(y), np.inf)
                slack = 1e-9 * (1 + square.max() + (y * y).sum(axis=1))
                r, c = np.nonzero(rough <= (kth + slack)[:, None])
                score = np.sqrt(((y[r] - x[c]) ** 2).sum(axis=1))
                hit = pd.DataFrame({"q": part["q"].to_numpy()[r], "id": ids[c], "score": score})
                out.append(hit.sort_values(["q", "score", "id"]).groupby("q", sort=False).head(k + 1))
        return pd.concat(out) if out else pd.DataFrame({"q": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            probe_ratio: float | None = PROBE, lists: int = LISTS, list_rows: int = LIST_ROWS, sample_rows: int = SAMPLE_ROWS,
            piece_rows: int = PIECE_ROWS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for every row that ``queries`` (a condition on ``id``) selects."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = clean_vectors(vectors, id_col, vec_col)
    same = Window.partitionBy("vec").orderBy("id")
    v = written(v.distinct().withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r")
                .withColumn("key", F.xxhash64("vec")), "ann-vectors")
    all_queries = written(clean_vectors(vectors, id_col, vec_col).where(queries).select("id", "vec").distinct(), "ann-queries")
    rows = v.count()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    graph = fit_graph(v, rows, sample_rows, list_rows, seed)
    listed = written(assign(v.select("id", "vec"), graph), "ann-lists")
    counts = listed.groupBy("list").agg(F.sum(F.col("first").cast("long")).alias("firsts"), F.count(F.lit(1)).alias("n")).collect()  # one row per centroid
    for r in counts:
        graph.sizes[r["list"]] = r["firsts"]
    # distinct query vectors, named by their smallest id
    distinct = all_queries.groupBy("vec").agg(F.min("id").alias("q"))
    probed = probe(distinct.select("q", "vec"), graph, k, probe_ratio, lists)
    pieces = {r["list"]: -(-r["n"] // piece_rows) for r in counts if r["n"] > piece_rows}
    n_pieces = F.lit(1)
    if pieces:
        n_pieces = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in pieces.items() for x in kv]), F.col("list")), F.lit(1))
    probed = probed.withColumn("piece", F.explode(F.sequence(F.lit(0), n_pieces - 1)))
    postings = listed.select("id", "vec", "list", F.pmod(F.xxhash64(F.lit(seed), "id"), n_pieces).cast("int").alias("piece"))
    found = (probed.groupBy("list", "piece").cogroup(postings.groupBy("list", "piece")).applyInPandas(_meet(k), _FOUND)
             .groupBy("q", "id").agg(F.min("score").alias("score")))
    best = Window.partitionBy("q").orderBy("score", "id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    # every query of a vector takes its k nearest but itself
    names = all_queries.join(distinct.withColumnRenamed("vec", "_vec"), F.col("vec") == F.col("_vec")).select(F.col("id").alias("query_id"), "q")
    res = (names.join(found, "q").where(F.col("id") != F.col("query_id"))
           .groupBy("query_id", "id").agg(F.min("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return res.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
