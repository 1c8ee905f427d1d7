"""The corpus pipeline: every stage's decisions, stage by stage, on the smallest tables."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from penawar.llm import decontam, mixing, quality, secrets
from tests.llm.test_native_scans import brute_spans, words
from tests.llm.test_ngram_join import brute
from tests.llm.test_mixing import check


def test_stages(spark, sf001, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    bench = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    columns, last = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf001).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality":
            labels = spark.read.parquet(f"{sf001}/labels.parquet")
            scores = quality.quality_scores(spark.createDataFrame(list(before.values()), docs.schema), labels).collect()
            assert set(after) == {r.doc_id for r in scores if r.predicted}
        elif name == "near_duplicates":
            found = brute([(i, r.text) for i, r in before.items()])
            assert set(after) == {int(i) for i, n, c in found if n == 0 or int(i) == c}
        elif name == "decontamination":
            grams = {tuple(w[s:s + 13]) for _, w in bench for s in range(len(w) - 12)}
            short = {tuple(w) for _, w in bench if 0 < len(w) < 13}
            bad = set()
            for i, r in before.items():
                w = words(r.text)
                hit = {q for p in range(len(w)) for n in {13, *map(len, short)} if tuple(w[p:p + n]) in grams | short for q in range(p, p + n)}
                if hit and 20 * len(hit) >= len(w):
                    bad.add(i)
            assert set(after) == set(before) - bad
        elif name == "secrets":
            assert set(after) == set(before)
            for i, r in before.items():
                assert (after[i].text == r.text) == (not brute_spans(r.text, secrets.RULES))
                assert after[i].n_chars == len(after[i].text)
        else:
            check(list(after.values()))
        last = after
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf001).collect()}
    assert got == last


ODD = [(1, None), (2, ""), (3, "plain words of a text " * 6), (3, "plain words of a text " * 6), (3, "plain words of another text " * 6),
       (4, "plain words of a text " * 6), (None, "a text without an id, of several plain words"), (None, None),
       (5, " ".join(f"b{i}" for i in range(30))), (6, "password = hunter2secret " + "some plain words " * 4), (7, "very long " * 60_000)]


@pytest.mark.parametrize("rows", [ODD, [], [(None, None)]])
def test_run_on_odd_tables(spark, tmp_path, rows):
    """run() on nulls, empty and long texts, repeated rows and ids, columns that clash with those of every stage, and
    empty tables: no crash, and every stage's decision on its own input."""
    docs = spark.createDataFrame([(i, t, "en", None if i == 5 else "src1", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_row", "_h", "score", "words", "token", "size", "taken", "component_id", "quality"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i != 9), 0) for i in range(3, 12)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench = [("i1", " ".join(f"b{i}" for i in range(14))), ("i2", None)] if rows else []
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    kept = now.collect()
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in kept)
    if len(rows) < 2:
        assert len(got) == len(rows)
        return
    texts = [(r.doc_id, r.text) for r in kept]
    assert (5, " ".join(f"b{i}" for i in range(30))) not in texts  # contaminated
    assert (4, ODD[5][1]) not in texts and (3, ODD[2][1]) in texts  # a copy of a smaller doc_id
    assert [t for i, t in texts if i == 6] == ["[SECRET] " + "some plain words " * 4] and (None, None) in texts and (7, ODD[10][1]) in texts
