"""word_similarity kernel and the blocked joins against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from penawar.functions.similarity import trigram_seq, word_similarity, word_similarity_brute
from penawar.operators.extract import extract_rules
from penawar.operators.similarity_join import vector_topk, vector_topk_lsh
from penawar.operators.trigram_index import trigram_topk
from penawar.sources import fixtures as fx

from .conftest import SF001

WORDS = st.lists(st.sampled_from(["ab", "abc", "bca", "a", "b", "x1", "1x", "ring", "rin", "old", "abab", "aaa"]),
                 min_size=1, max_size=6).map(" ".join)


def test_goldens():
    assert word_similarity("word", "two words") == 0.8
    assert word_similarity("MCCB Schneider 100A", "MCCB Schneider EZC100F 100A") == 0.75


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_kernel_equals_definition(q, n):
    s = word_similarity(q, n)
    assert abs(s - word_similarity_brute(q, n)) < 1e-12
    assert 0.0 <= s <= 1.0


@settings(max_examples=100, deadline=None)
@given(WORDS)
def test_self_similarity_is_one(q):
    assert word_similarity(q, q) == 1.0


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_upper_bound_holds(q, n):
    tq, tn = set(trigram_seq(q)), set(trigram_seq(n))
    assert word_similarity(q, n) <= len(tq & tn) / len(tq) + 1e-12


def _brute_topk(queries, catalog, k=8, floor=0.3):
    out = {}
    for q in queries:
        sc = [(word_similarity(q, name), len(name), i) for i, name in catalog]
        sc = sorted((s for s in sc if s[0] >= floor), key=lambda s: (-s[0], s[1], s[2]))[:k]
        out[q] = [(r + 1, s[2], round(s[0], 12)) for r, s in enumerate(sc)]
    return out


def test_trigram_topk_matches_brute_force(spark):
    cat = fx.catalog(spark, SF001, with_embedding=False)
    names = extract_rules(fx.lines(spark, SF001)).select(F.col("name").alias("key"))
    got = {}
    for r in trigram_topk(names, cat).collect():
        got.setdefault(r.key, []).append((r.rank, r.id, round(r.score, 12)))
    queries = [r.key for r in names.distinct().collect()]
    want = _brute_topk(queries, [(r.id, r.name) for r in cat.collect()])
    assert {q: sorted(v) for q, v in got.items() if v} == {q: v for q, v in want.items() if v}


def test_trigram_plan_has_no_cross_product(spark):
    cat = fx.catalog(spark, SF001, with_embedding=False)
    names = extract_rules(fx.lines(spark, SF001)).select(F.col("name").alias("key"))
    plan = trigram_topk(names, cat)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "FlatMapCoGroupsInPandas" in plan


def test_vector_topk_matches_brute_force(spark):
    cat = fx.catalog(spark, SF001)
    emb = fx.table(spark, SF001, "embeddings")
    q = emb.select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("qvec"))
    got = sorted((int(r.key), r.rank, r.id) for r in vector_topk(q, cat).collect())
    c = [(r.id, np.asarray(r.embedding, dtype=np.float64)) for r in cat.where("embedding is not null").collect()]
    want = []
    for r in emb.collect():
        v = np.asarray(r.embedding, dtype=np.float64)
        sims = [(float(v @ e / (np.linalg.norm(v) * np.linalg.norm(e))), i) for i, e in c]
        sims = sorted((s for s in sims if s[0] >= 0.3), key=lambda s: (-s[0], s[1]))[:8]
        want += [(r.vec_id, k + 1, i) for k, (_, i) in enumerate(sims)]
    assert got == sorted(want)


def test_offer_top_k_plans_group_limit(spark):
    from penawar.operators.offers import offers_structured

    plan = offers_structured(fx.shopping(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "AdaptiveSparkPlan" in plan
    opt = offers_structured(fx.shopping(spark, SF001))._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in opt


def test_grid_cells_stay_bounded(spark):
    from penawar.operators.similarity_join import CELL_SIDE, CELLS_PER_CORE, _grid

    cells = CELLS_PER_CORE * spark.sparkContext.defaultParallelism
    for f in (1, 10, 100, 1000):
        q, c = 60_000 * f, 20_000 * f
        rows, cols = _grid(spark, q, c)
        assert rows * cols >= cells // 2 and q / rows <= CELL_SIDE and c / cols <= CELL_SIDE
    assert _grid(spark, 1, 10**5)[0] == 1 and _grid(spark, 10**5, 1)[1] == 1


def test_lsh_recall_and_exact_scores(spark):
    """Clustered vectors, some of them equal and many of them in one code: recall at 8 at least 0.9, scores exact."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 32))
    x = centers[rng.integers(30, size=1500)] + 0.5 * rng.normal(size=(1500, 32))
    x[:400] = x[0]
    cat = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, embedding array<float>")
    q = cat.where("id % 15 = 0").select(F.col("id").cast("string").alias("key"), F.col("embedding").alias("qvec"))
    q = q.unionByName(spark.createDataFrame([("null", None), ("short", [1.0]), ("zero", [0.0] * 32)], q.schema))
    exact = {(r.key, r.id): r.sim for r in vector_topk(q.where("key not in ('short')"), cat).collect()}
    found = {(r.key, r.id): r.sim for r in vector_topk_lsh(q, cat).collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(abs(exact[k] - found[k]) < 1e-12 for k in exact.keys() & found.keys())
    ranks = vector_topk_lsh(q, cat, tables=40, bits=2, probes=4).select("key", "rank", "id").collect()
    assert sorted(ranks) == sorted(vector_topk(q.where("key <> 'short'"), cat).select("key", "rank", "id").collect())  # all codes probed: exact


def test_a_vector_is_one_row_whatever_the_tables_and_probes():
    """Vectors travel once with all their codes, not once per table and probed code; those without direction don't."""
    import pandas as pd

    from penawar.operators.similarity_join import _codes

    x = np.random.default_rng(5).normal(size=(50, 6))
    x[7], x[8, 2], x[9, 0] = 0, np.nan, np.inf
    pdf = pd.DataFrame({"key": [str(i) for i in range(50)], "qvec": list(x)})
    got = pd.concat(_codes(["key"], "qvec", 6, 10, 12, 4, 7)(iter([pdf])))
    assert got["key"].tolist() == [str(i) for i in range(50) if i not in (7, 8, 9)]
    codes = [np.frombuffer(b, dtype=np.uint16).reshape(12, 4) for b in got["codes"]]
    assert all(len(set(row)) == 4 for c in codes for row in c)


def _brute_lsh(asked, listed, dims, bits, tables, probes, seed, k=8, floor=0.3):
    planes = np.random.default_rng(seed).normal(size=(tables, dims, bits))

    def probed(v, n):
        out = set()
        for t in range(tables):
            side = v @ planes[t]
            code, unsure = sum(1 << b for b in range(bits) if side[b] > 0), np.argsort(np.abs(side))
            out |= {(t, code ^ sum(1 << int(unsure[j]) for j in range(10) if p >> j & 1)) for p in range(n)}
        return out

    rows = [(i, v, probed(v, 1)) for i, v in listed]
    best = {}
    for key, v in asked:
        mine = probed(v, probes)
        for i, u, codes in rows:
            sim = float(v @ u / (np.linalg.norm(v) * np.linalg.norm(u)))
            if sim >= floor and mine & codes:
                best[key, i] = max(sim, best.get((key, i), 0))
    out = []
    for key in {key for key, _ in best}:
        mine = sorted(((-round(s, 9), i is not None, i or 0) for (q, i), s in best.items() if q == key))[:k]
        out += [(key, r + 1, i if some else None, -s) for r, (s, some, i) in enumerate(mine)]
    return out


def test_lsh_equals_brute_force_over_the_codes(spark, monkeypatch):
    """Equal vectors, ids and keys that repeat with other vectors, a null id, a null key; blocks and runs of a few pairs."""
    from penawar.config import MatchConfig
    from penawar.operators import similarity_join as sj

    rng = np.random.default_rng(11)
    x = (rng.normal(size=(12, 8))[rng.integers(12, size=400)] + 0.6 * rng.normal(size=(400, 8))).astype(np.float32).astype(np.float64)
    x[50:90] = x[50]
    listed = [(None if i in (60, 200) else i % 330, v) for i, v in enumerate(x)]
    y = (x + 0.1 * rng.normal(size=x.shape)).astype(np.float32).astype(np.float64)
    asked = [(None if i == 12 else str(i % 90), y[i]) for i in range(0, 400, 4)] + [("same", x[50])] * 3
    cat = spark.createDataFrame([(i, v.tolist()) for i, v in listed], "id long, embedding array<float>")
    q = spark.createDataFrame([(k, v.tolist()) for k, v in asked], "key string, qvec array<float>")
    want = sorted(_brute_lsh(asked, listed, 8, 5, 3, 2, 7), key=str)
    for tiny in (False, True):
        if tiny:
            monkeypatch.setattr(sj, "WAITING", 0)
            monkeypatch.setattr(sj, "EXACT_PAIRS", 5)
        cfg = MatchConfig(query_block_rows=3, catalog_block_rows=11) if tiny else MatchConfig()
        rows = vector_topk_lsh(q, cat, cfg, bits=5, tables=3, probes=2).collect()
        assert sorted(((r.key, r["rank"], r.id, round(r.sim, 9)) for r in rows), key=str) == want


def test_a_crowd_of_near_vectors_waits_in_bounded_numbers():
    """Thousands of near copies in one code: few of their pairs wait, and the best are those of all pairs."""
    from penawar.operators import similarity_join as sj

    rng = np.random.default_rng(2)
    x = (rng.normal(size=16) + 0.01 * rng.normal(size=(3000, 16))).astype(np.float32)
    side = sj._Side.__new__(sj._Side)
    side.x, side.norm = x, sj._norms(x)
    side.unit = (x / side.norm[:, None]).astype(np.float32)
    best, most = sj._Nearest(side, side, np.arange(3000), 0.3, 8), 0
    for lo in range(0, 3000, 500):
        best.add(np.arange(3000), np.arange(lo, lo + 500))
        most = max(most, best.held)
    best.choose()
    y = x.astype(np.float64)
    sim = y @ y.T / np.outer(side.norm, side.norm)
    want = -np.sort(-sim, axis=1)[:, :8]
    assert np.allclose(best.sim.reshape(3000, 8), want, rtol=0, atol=1e-12)
    assert most <= 2 * sj.WAITING * 3000 and np.array_equal(best.pair // 3000, np.repeat(np.arange(3000), 8))


def _random_names(seed, n, words):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 7))) for _ in range(words)]
    weights = 1 / np.arange(1, words + 1)
    return [" ".join(rng.choice(vocab, rng.integers(1, 6), p=weights / weights.sum())) for _ in range(n)]


def test_index_equals_brute_force_in_tiny_cells(spark, monkeypatch):
    """Frequent and rare words, equal names, blank and null texts; lists and askers cut into many slices."""
    from penawar.operators import trigram_index as ti

    monkeypatch.setattr(ti, "POSTINGS", 16)
    monkeypatch.setattr(ti, "QUERIES", 8)
    monkeypatch.setattr(ti, "BLOCK_CELLS", 4000)
    names = _random_names(1, 300, 40) + ["meja kantor"] * 30 + ["", " -- ", "x" * 400, "meja " + " ".join(f"kata{i}" for i in range(300))]
    asked = _random_names(2, 150, 60) + ["meja kantor", "meja", "??", "", "zzz qqq", "kata7 kata8"]
    cat = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(9999, None)], "id long, name string")
    q = spark.createDataFrame([(a,) for a in asked] + [(None,)], "key string")
    got = {}
    for r in trigram_topk(q, cat).collect():
        got.setdefault(r.key, []).append((r.rank, r.id, round(r.score, 12)))
    want = _brute_topk(sorted(set(asked)), list(enumerate(names)))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_cells_stay_bounded_when_both_sides_double(spark):
    """One entry that all rows have: the largest cell stays the same, the number of cells grows."""
    from penawar.operators.cells import in_cells

    def largest(n):
        q = spark.range(n).select(F.col("id").alias("a"), F.lit("hot").alias("e"))
        c = spark.range(4 * n).select(F.col("id").alias("b"), F.when(F.col("id") % 9 == 0, F.concat(F.lit("r"), F.col("id"))).otherwise(F.lit("hot")).alias("e"))

        def sizes(x, y):
            import pandas as pd

            return pd.DataFrame({"q": [len(x)], "c": [len(y)], "pairs": [len(x.merge(y, on="e"))]})

        rows = in_cells(q, c, "e", "a", "b", 8, list_rows=256, ask_rows=64).applyInPandas(sizes, "q long, c long, pairs long").collect()
        want = n * sum(i % 9 != 0 for i in range(4 * n))
        assert sum(r.pairs for r in rows) == want  # every pair of an entry meets once
        return max(r.q for r in rows), max(r.c for r in rows), len(rows)

    (q1, c1, n1), (q2, c2, n2) = largest(1000), largest(2000)
    assert max(q1, q2) <= 2 * 64 and max(c1, c2) <= 2 * 256 and n2 > 3 * n1


def test_bins_of_short_entries_stay_bounded_on_the_asking_side(spark):
    """Many entries with one listed row and many askers each: a cell holds few askers, not those of all entries."""
    from penawar.operators.cells import in_cells

    q = spark.range(20_000).select(F.col("id").alias("a"), F.concat(F.lit("e"), F.col("id") % 100).alias("e"))
    c = spark.range(100).select(F.col("id").alias("b"), F.concat(F.lit("e"), F.col("id")).alias("e"))

    def sizes(x, y):
        import pandas as pd

        return pd.DataFrame({"q": [len(x)], "n": [len(y)]})

    got = in_cells(q, c, "e", "a", "b", 8, 4096, 1024).applyInPandas(sizes, "q long, n long").collect()
    assert sum(r.q for r in got) == 20_000 and sum(r.n for r in got) == 100
    assert max(r.q for r in got) <= 4 * 1024


def test_rows_are_grouped_exactly():
    from penawar.functions.similarity import _distinct_rows

    rows = np.random.default_rng(0).integers(0, 3, (500, 11)).astype(np.uint8)
    rows[250:] = rows[:250]
    first, number = _distinct_rows(rows)
    assert np.array_equal(rows[first][number], rows) and len(first) == len(np.unique(rows, axis=0))


def test_runs_leave_no_name_out():
    """A block of several runs against single-pair scores: ties, trigrams looked up before, a known score."""
    from penawar.functions.similarity import Numbered
    from penawar.operators import trigram_index as ti
    import pandas as pd

    names = sorted(set(_random_names(4, 700, 30)))
    asked = _random_names(5, 40, 40)
    numbered = Numbered()
    rows = pd.DataFrame({"name": names, "name_no": range(len(names)), "name_len": [len(x) for x in names]})
    qsets = [list(set(numbered.seq(x))) for x in asked]
    before = [numbered.of(sorted(set(trigram_seq(x)))[:i % 3]) for i, x in enumerate(asked)]
    known = np.array([-1.0 if i % 2 else 0.6 for i in range(len(asked))])
    [(part, seqs)] = list(ti.name_blocks(rows, 4096, numbered))
    out, reach = ti.score_block(ti.Names(part, seqs, len(numbered.number)), np.array(asked, dtype=object), qsets, before, known, 0.3, 8)
    for i, x in enumerate(asked):
        gone = set(sorted(set(trigram_seq(x)))[:i % 3])
        want = sorted((-word_similarity(x, n), len(n), j) for j, n in enumerate(names) if not gone & set(trigram_seq(n)))
        want = [v for v in want if -v[0] >= max(known[i], 0.3) - 1e-9][:8]
        if asked.count(x) == 1:
            got = out[out["key"] == x]
            assert [(-s, n, j) for s, n, j in zip(got["score"], got["name_len"], got["name_no"])] == want
            assert len(want) < 8 or abs(reach[i] + want[-1][0]) < 1e-12
