"""N-gram Jaccard join against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from penawar.llm import ngram_join
from penawar.llm.components import connected_components
from tests.llm.conftest import docs_of


def brute(rows, percent=75, size=5):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    places = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            places.setdefault(g, []).append(k)
    pairs = {(a, b) for v in places.values() for x, a in enumerate(v) for b in v[x + 1:]}
    for a, b in pairs:
        if sets[a][0] is None or sets[b][0] is None:
            continue
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= percent * len(sets[a][1] | sets[b][1]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(sets))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in df.collect())


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k:k + 1] = rng.choice([[f"n{rng.randrange(10**6)}"], [], [w[k], f"n{rng.randrange(10**6)}"]])
    return " ".join(w)


@pytest.mark.parametrize("hot", [2, 8])
def test_groups_of_near_copies(spark, hot):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows, k = [], 0
    for n in (6, 12, 30, 60, 150):
        base = [rng.choice(vocab) for _ in range(n)]
        for _ in range(25):
            rows.append((k, edited(rng, base, rng.randrange(0, max(2, n // 12)))))
            k += 1
    for _ in range(40):
        rows.append((k, " ".join([rng.choice(vocab) for _ in range(rng.randrange(5, 30))] + passage)))
        k += 1
    rows += [(1000 + i, rows[i][1].upper()) for i in range(30)]
    got = ngram_join.near_duplicates(docs_of(spark, rows), hot=hot, sketch_bits=14)
    assert result(got) == brute(rows)


def test_shingle_beyond_the_partners_prefix(spark):
    """A prefix shingle that no other class has in its prefix may still stand further back in a partner."""
    rng = random.Random(11)
    x = [f"x{i}" for i in range(16)]
    rows = [(0, " ".join(x))]
    rows += [(1 + i, " ".join(x + [f"y{i}a{j}" for j in range(3)])) for i in range(7)]
    rows.append((20, " ".join(x[:5])))
    rows += [(100 + i, " ".join([f"u{rng.randrange(10**9)}" for _ in range(200)] + x[1:])) for i in range(50)]
    assert result(ngram_join.near_duplicates(docs_of(spark, rows))) == brute(rows)


def test_exact_mode_returns_all_links(spark):
    rng = random.Random(17)
    base = [f"w{i}" for i in range(100)]
    texts = sorted({edited(rng, base, rng.randrange(0, 3)) for _ in range(60)})
    rows = list(enumerate(texts)) + [(900, texts[0].upper())]
    members, links = ngram_join.jaccard_links(docs_of(spark, rows), sketch_bits=14, exact=True, cell_rows=16)
    by = {}
    for r in members.collect():
        by.setdefault(r.sig, min(r.doc_id, by.get(r.sig, r.doc_id)))
    got = sorted(tuple(sorted((by[r.a], by[r.b]))) for r in links.collect())
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets.setdefault(frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)), i)
    x = sorted((i, s) for s, i in sets.items())
    want = [(a, b) for k, (a, s) in enumerate(x) for b, t in x[k + 1:] if 100 * len(s & t) >= 75 * len(s | t)]
    assert got == sorted(want) and len(want) > 100
    per = {by[r.sig]: r.n_links for r in ngram_join.links_per_class(members, links).collect()}
    assert per == {i: sum(i in p for p in want) for i, _ in x}


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE\x0btwo"), (10, "one two three"), (None, "one two"), (11, long),
            (12, long + " end"), (13, "É é a b c d"), (14, "é É a b c d"), (8, "one two"), (8, "an other text of the same id here")]
    docs = docs_of(spark, rows).withColumn("sig", F.lit("clash")).withColumn("_row", F.lit(1)).withColumn("n", F.lit(2))
    assert result(ngram_join.near_duplicates(docs)) == brute(rows)
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text and r.text.strip() and r.doc_id != 8) == sorted(
        [("None", "one two"), ("10", "one two three"), ("11", long), ("13", "É é a b c d"), ("14", "é É a b c d")])
    assert sorted(r.doc_id for r in kept.where("doc_id < 8").collect()) == [5, 6, 7]
    empty = docs_of(spark, [])
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.drop_near_duplicates(empty).count() == 0


def test_a_doc_id_in_two_components_keeps_a_row_in_each(spark):
    near = "the same words of a group in a row " * 2
    rows = [(8, "one two"), (9, "ONE two"), (8, "an other text of the same id here"), (7, near + "x1"), (7, "alone under this id"), (12, near + "x1")]
    kept = ngram_join.drop_near_duplicates(docs_of(spark, rows))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([rows[0], rows[2], rows[3], rows[4]])


def test_one_document_of_each_component_stays(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    found = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(ngram_join.near_duplicates(docs)) == found
    kept = ngram_join.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(int(i) for i, n, c in found if n == 0 or int(i) == c)


def test_prefix_holds_enough_shared_shingles():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - int(rng.integers(0, len(a) // 5 + 1))],
                                      rng.integers(0, 2**62, int(rng.integers(0, n // 6 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        count = lambda s: (s % np.uint64(7)).astype(np.int64) * 9
        pa, la = ngram_join.adaptive_prefix(a, count(a), 3.0, 75)
        pb, lb = ngram_join.adaptive_prefix(b, count(b), 3.0, 75)
        l = min(la, lb)
        o = -(-75 * (len(a) + len(b)) // 175)
        assert len(np.intersect1d(pa[:len(a) - o + l], pb[:len(b) - o + l])) >= l


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 203), (203, 204)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert got[203] == got[204] == got[205] == 203
