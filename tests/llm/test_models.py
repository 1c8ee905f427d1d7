"""Quality classifier (held-out accuracy) and nearest neighbours (recall against brute force)."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from penawar.llm import ann, quality, queries
from tests.llm.conftest import docs_of

SF01 = "/root/testdata/sf0.01"


def test_quality_held_out_accuracy(spark):
    rows = queries.op7_quality(spark, SF01).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert len(rows) == docs
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in test if y == 1], [s for s, y in test if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.95, auc
    assert np.mean([s >= 0.3 for s in good]) >= 0.97
    assert np.mean([s < 0.3 for s in bad]) >= 0.6


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)] + [(None, 1, 0), (61, None, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    texts = [(i, "plain words of a text " * 3 if i % 2 else "$$$ ### %%% !!! " * 3) for i in range(1, 60)]
    texts += [(70, None), (71, ""), (72, "plain words " * 50_000), (None, "plain words"), (5, "a second text"), (70, None)]
    docs = docs_of(spark, texts).withColumn("quality", F.lit("clash")).withColumn("score", F.lit(3)).withColumn("ids", F.lit(0))
    rows = quality.quality_scores(docs, labels, per_class=40).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[72].predicted == 1 and by[2].score < by[1].score
    kept = quality.keep_quality(docs, labels, per_class=40)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    again = sorted((str(r.doc_id), r.score) for r in quality.quality_scores(docs.repartition(5), labels, per_class=40).collect())
    assert again == sorted((str(r.doc_id), r.score) for r in rows)
    assert quality.quality_scores(docs_of(spark, []), labels).count() == 0
    one = quality.quality_scores(docs_of(spark, [(1, "x")]), labels.limit(0)).collect()
    assert one[0].score == pytest.approx(0.5)


def test_hinge_loss_fit_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 5
    y = np.array([1, 1, -1, -1] * 5)
    w, b = quality.dual_coordinate_descent(rows, np.ones(4), y, np.ones(20), 50, 1)
    assert all(np.sign(w[r].sum() / np.sqrt(2) + b) == t for r, t in zip(rows, y))


def plain_ratios(rows, y, dim):
    count = {c: [1 + sum(g in set(r.tolist()) for r, t in zip(rows, y) if t == c) for g in range(dim)] for c in (1, -1)}
    return np.array([np.log(a / sum(count[1])) - np.log(b / sum(count[-1])) for a, b in zip(count[1], count[-1])])


def test_ratios_margins_and_optimum_against_a_plain_solve():
    """The log-count ratios by counting, the hinge-loss optimum by projected gradient on the dense dual, margins by hand."""
    rng = np.random.default_rng(3)
    dim = 32
    rows = [np.unique(rng.integers(0, dim, rng.integers(3, 12))).astype(np.int32) for _ in range(60)]
    y = np.array([1 if (r < 12).mean() + rng.normal(0, 0.25) > 0.4 else -1 for r in rows])
    cost = np.where(y > 0, 0.7, 1.3)
    ratios = quality.log_count_ratios(rows, y, dim)
    assert ratios == pytest.approx(plain_ratios(rows, y, dim), rel=1e-12)
    x = np.zeros((60, dim + 1))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r]
        x[i] /= np.sqrt((x[i] ** 2).sum())
    x[:, dim] = 1.0  # the bias
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    best = alpha.sum() - alpha @ q @ alpha / 2
    w, bias = quality.dual_coordinate_descent(quality.Rows.of(rows, 5), ratios, y, cost, 2000, 1)
    v = np.append(w, bias)
    primal = v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert best - 1e-6 <= primal <= best * 1.001  # the gap to the dual optimum is closed
    model = quality.Model(w * ratios, ratios, bias, 1.0, 0.0)
    for i, r in enumerate(rows):
        assert model.margin(r) == pytest.approx(float(x[i] @ v), rel=1e-9, abs=1e-12)


def test_training_rows_are_bounded_in_bytes(spark):
    """Texts with nearly every n-gram take a bit an id; the model is that of plain lists of ids."""
    rng = np.random.default_rng(4)
    dense = [np.flatnonzero(rng.random(1 << 10) < p).astype(np.int32) for p in (0.001, 0.02, 0.5, 1.0)] + [np.zeros(0, np.int32)]
    kept = quality.Rows.of(dense, 10)
    assert len(kept) == 5 and all(len(r) <= 128 for r in kept.raw)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(dense, kept)) and (kept.pick([3, 1])[0] == dense[3]).all()
    noise = "".join(chr(c) for c in rng.integers(0x20, 0x7FF, 400_000))
    texts = [(i, noise[i:] if i % 2 else "plain words " * 5) for i in range(1, 40)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    rows, y, _ = quality.training_rows(docs, labels)
    assert max(map(len, rows.raw)) <= (1 << quality.BITS) // 8
    want = {tuple(quality.ngram_ids(t).tolist()) for i, t in texts if zlib.crc32(str(i).encode()) % 5}
    assert {tuple(r.tolist()) for r in rows} == want and len(y) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i, _ in texts)


def brute_nearest(rows, k=10):
    fine = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    if not fine:
        return out
    x, ids = np.array([v for _, v in fine]), np.array([i for i, _ in fine])
    for q, v in fine:
        if q % 100 == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            best = {}
            for s, i in zip(d, ids):
                if i != q:
                    best[i] = min(best.get(i, np.inf), s)
            for s, i in out.get(q, []):
                best[i] = min(best.get(i, np.inf), s)
            out[q] = [(s, i) for i, s in best.items()]
    return {q: sorted((s, i) for s, i in v)[:k] for q, v in out.items()}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id if "vec_id" in r else r.id))
    return {q: [(s, i) for _, s, i in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got, want = found(queries.op4_ann(spark, f"/root/testdata/{sf}")), brute_nearest(rows)
    assert set(got) == set(want)
    assert all(len(got[q]) == len(want[q]) for q in want)
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9, recall
    vec = dict(rows)
    for q, v in got.items():
        for s, i in v:
            assert s == pytest.approx(np.sqrt(((np.array(vec[q], float) - np.array(vec[i], float)) ** 2).sum()), rel=1e-12)


def test_ann_without_a_ratio_is_exact(spark):
    """Many more lists than the graph search looks for; components far beyond single precision."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * (1e30 if i % 2 else 1e32)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.nearest(df, F.col("id") % 100 == 0, list_rows=10, probe_ratio=None, lists=4))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], rel=1e-12)


def test_ratio_alone_chooses_the_lists(spark):
    rng = np.random.default_rng(6)
    g = ann.CentroidGraph.build(rng.normal(size=(300, 8)))
    g.sizes[:] = 50
    x = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "q long, vec array<double>")
    got = {}
    for r in ann.probe(df, g, 10, 0.8, lists=24).collect():
        got.setdefault(r.q, set()).add(r.list)
    d = np.sqrt(((x[:, None, :] - g.centroids[None].astype(float)) ** 2).sum(axis=2))
    missed = wanted = 0
    for i in range(40):
        far = 1.8 * d[i].min()
        sure = {int(j) for j in np.flatnonzero(d[i] < far - 1e-4)}
        assert got[i] <= {int(j) for j in np.flatnonzero(d[i] < far + 1e-4)}
        if len(got[i]) > 24:  # measured against all centroids
            assert sure <= got[i]
        missed, wanted = missed + len(sure - got[i]), wanted + len(sure)
    assert missed <= 0.01 * wanted  # the graph search of the others is approximate
    assert max(map(len, got.values())) > 24


def test_ann_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(500)]  # a very common vector
    rows += [(0, [0.0] * 4), (400, None), (500, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (700, [1.0, 2.0]), (None, [1.0] * 4), (7, rows[6][1]), (100, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("list", F.lit(1))
    got = found(ann.nearest(df, F.col("id") % 100 == 0, list_rows=20, piece_rows=16, probe_ratio=5.0, lists=64))
    want = brute_nearest([(i, v) for i, v in rows if v is None or len(v) == 4])
    assert set(got) == set(want)
    for q in want:
        assert got[q][0] == want[q][0] and len(got[q]) == 10
        if q >= 1000:
            assert got[q] == want[q]
    few = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [5.0, 1.0])], "vec_id long, embedding array<double>")
    assert [i for _, i in found(ann.nearest(few, F.col("id") % 100 == 0))[100]] == [1, 2]
    assert ann.nearest(few.limit(0), F.col("id") % 100 == 0).count() == 0
