"""Hard negatives against brute force over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from penawar.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor):
    clean = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 2**20 for x in v):
            continue
        clean[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    clean, out = list(clean), []

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    for i, label, v in clean:
        if not anchor(i):
            continue
        best = {}
        for j, other, w in clean:
            if other == label and j != i:
                best[j] = max(best.get(j, -(2**70)), score(v, w))
        for p, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]:
            found = sorted((-score(v, w), j) for j, other, w in clean if other != label and 50 * s <= 100 * score(v, w) <= 95 * s)
            out += [(i, p, k + 1, j, s, -n) for k, (n, j) in enumerate(found[:3])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(seed, n, dims=12, labels=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels * 3, dims))
    rows = []
    for i in range(n):
        c = rng.integers(len(centers))
        rows.append((i, [float(x) for x in (centers[c] + 0.4 * rng.normal(size=dims)).astype(np.float32)], int((c + rng.integers(3)) % labels)))
    return rows


@pytest.mark.parametrize("params", [{}, {"block_rows": 8, "group_rows": 4, "bucket_rows": 60, "slot_blocks": 7, "cell_blocks": 3},
                                    {"sample_rows": 5, "block_rows": 16, "bucket_rows": 20}])
def test_equal_to_brute_force(spark, params):
    rows = clustered(1, 500)
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(60)]  # a very common vector, some of them anchors
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.hard_negatives(df, F.col("id") % 20 == 0, **params)
    assert result(got) == brute(rows, lambda i: i % 20 == 0)


def test_rows_that_take_no_part_and_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.8, 0.1], 2), (3, [0.7], 2), (4, [], 1), (5, [0.0, 0.0], 2), (6, [-1.0, -1.0], 1),
            (None, [1.0, 0.0], 1), (8, None, 1), (9, [1.0, 0.0], None), (10, [nan, 1.0], 1), (11, [inf, 1.0], 2), (12, [1.0, None], 2), (13, [2e6, 0.0], 2),
            (14, [0.9, 0.0, 3.0], 2), (0, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", score int, a string")
    got = result(negatives.hard_negatives(df, F.col("id") % 2 == 0))
    assert got == brute(rows, lambda i: i % 2 == 0) and got
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 2 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert negatives.hard_negatives(one, F.col("id") % 2 == 0).collect() == []


def test_very_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(0.5, 1) * 2**19.9 for _ in range(64)], i % 3) for i in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = result(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 4 == 0, block_rows=4))
    assert got == brute(rows, lambda i: i % 4 == 0) and max(r[4] for r in got) > 2**53


def test_zone_maps_spare_blocks(spark):
    """Well separated clusters: the bounds leave most blocks unread."""
    rng = np.random.default_rng(5)
    dims, rows = 16, []
    centers = np.eye(dims) * 4
    for i in range(1600):
        rows.append((i, [float(x) for x in (centers[i % dims] + 0.05 * rng.normal(size=dims))], int(i % dims) % 4))
    v = negatives.integer_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label")
    classes = v.select("label", "vec", F.array("id").alias("ids"))
    pdf = classes.toPandas()
    curve = negatives.Curve(pdf["label"].to_numpy(), negatives._matrix(pdf["vec"], dims))
    blocks = (negatives.along_curve(classes, curve, dims, 1600, 400).groupBy("bucket", "sub")
              .applyInPandas(negatives._block_task(dims, 25), negatives._BLOCK).toPandas())
    lo, hi = (negatives._unpack(b"".join(blocks[c]), dims) for c in ("lo", "hi"))
    x, labels = negatives._matrix(pdf["vec"], dims), pdf["label"].to_numpy()
    low, high = negatives.intervals(x[:50], lo, hi)
    for b, data in enumerate(blocks["vecs"]):
        scores = x[:50] @ negatives._unpack(data, dims).T
        assert (scores.min(axis=1) >= low[:, b]).all() and (scores.max(axis=1) <= high[:, b]).all()
    wanted = 0
    for a in range(50):
        reached = np.sort(x[labels == labels[a]] @ x[a])[-6]
        wanted += ((blocks["label"].to_numpy() == labels[a]) & (high[a] >= reached)).sum()
    assert wanted < 0.5 * 50 * (blocks["label"].value_counts().mean())


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    index = negatives.hilbert_index(cells, 3)
    assert sorted(index.tolist()) == list(range(512))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
