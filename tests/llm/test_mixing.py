"""Source mixing against sequential Sainte-Lague, sequential capping and the block rule."""

import heapq
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from penawar.llm import mixing, queries
from tests.llm.conftest import docs_of


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


def brute_seats(votes, seats):
    heap = [(-v, i, 1) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    out = [0] * len(votes)
    for _ in range(seats if heap else 0):
        q, i, k = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * k + 1), i, k + 1))
    return out


@pytest.mark.parametrize("votes,seats", [([5, 3, 1], 7), ([100], 9), ([1, 1, 1, 1], 2), ([0, 8, 3], 4), ([900, 30, 30, 30, 10], 13), ([7, 5], 0), ([1] * 40 + [500], 33)])
def test_apportion_is_sainte_lague(spark, votes, seats):
    p = spark.createDataFrame([(str(i), float(v), seats, 0) for i, v in enumerate(votes)], "_party string, v double, s long, g int")
    got = {int(r._party): r.quota for r in mixing.apportion(p, "v", "s", ["g"], [F.col("_party").cast("int")]).collect()}
    assert [got[i] for i in range(len(votes))] == brute_seats(votes, seats)


def check(rows, block=64, sources_near=None):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
    want = brute_targets(sizes) if sizes else {}
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * block + 0.02 * want[s], (s, taken[s], want[s])


def test_mix_on_table_and_rerun(spark, sf001):
    a = queries.op6_mix_sources(spark, sf001).collect()
    check(a)
    b = queries.op6_mix_sources(spark, sf001).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    docs = spark.read.parquet(f"{sf001}/documents.parquet").repartition(7)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, a), key=str)


def test_many_shards_keep_targets(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    check(mixing.mix(docs, shard_words=1000, block_words=8).collect(), block=8 * 20)


def test_edge_cases(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    texts = [(1, None), (2, ""), (3, "a b c\td\x0be"), (3, "a b c\td\x0be"), (None, "x " * 500), (4, "y " * 30_000), (5, "só um")]
    docs = docs_of(spark, texts, {1: None, 2: None, 4: "hot", 5: "z"}).withColumn("target", F.lit("clash")).withColumn("_src", F.lit(0))
    rows = mixing.mix(docs, block_words=1).collect()
    assert len(rows) == len(texts)
    assert sorted(r["size"] for r in rows) == [0, 0, 1, 5, 5, 500, 30_000]
    check(rows, block=1)
