"""Substring dedup against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from penawar.llm import substrings
from tests.llm.conftest import docs_of


def brute(rows, size):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for p in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[p:p + size])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - size + 1):
            if i is not None and least[tuple(w[p:p + size])] < i:
                gone |= set(range(p, p + size))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocab) for _ in range(rng.randrange(10, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [rng.choice(vocab) for _ in range(rng.randrange(0, 30))]
            w += rng.choice(passages)
        rows.append((rng.randrange(80), rng.choice([" ", "\n", "\t "]).join(w)))
    rows += rows[:10]  # repeated rows
    rows += [(200 + k, rows[3][1]) for k in range(20)]  # copies
    rows += [(300 + k, rows[3][1] + f" own{k} " + " ".join(passages[0])) for k in range(30)]  # near copies
    rows += [(None, rows[3][1]), (None, None), (400, None), (401, ""), (402, " \t"), (403, "one"), (404, "Größe  x " * 40), (405, "Größe  x " * 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group_rows", [10**6, 40, 3])
def test_windows_of_all_documents(spark, group_rows):
    """Groups that hold everything, prefixes extended to half a window, and to a whole one."""
    rows = corpus(group_rows)
    got = substrings.kept_digest(docs_of(spark, rows), size=12, gram=4, group_rows=group_rows, hot_class=15)
    assert result(got) == brute(rows, 12)


def test_kept_texts_and_production_window(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(50))
    rows = [(5, "a  b " + passage + " c"), (1, "x " + passage + "\ny"), (9, passage), (7, passage[:-1]), (2, "z\n  z")]
    got = {r.doc_id: r.text for r in substrings.drop_passages(docs_of(spark, rows)).collect()}
    assert got == {5: "a b c", 1: rows[1][1], 9: "", 7: rows[3][1], 2: "z\n  z"}
    assert result(substrings.kept_digest(docs_of(spark, rows))) == brute(rows, 50)


def test_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(f"v{rng.randrange(2000)}" for _ in range(150_000))
    rows = [(1, long), (2, "before " + long[5000:400_000] + " after"), (3, "other text")]
    assert result(substrings.kept_digest(docs_of(spark, rows))) == brute(rows, 50)


def test_empty_table_and_clashing_columns(spark):
    assert substrings.kept_digest(docs_of(spark, [])).collect() == []
    assert substrings.drop_passages(docs_of(spark, [])).collect() == []
    clash = spark.createDataFrame([(1, "a b", 1, "x", 2, 3), (2, None, 1, "x", 2, 3)],
                                  "doc_id long, text string, _h int, words_sha string, spans int, pos int")
    assert [r[0] for r in result(substrings.kept_digest(clash))] == ["1", "2"]


def test_run_hashes_and_sliding_minimum():
    words = [f"{i % 7}".encode() for i in range(40)]
    one, ten = substrings.run_hashes(words, 1, 10)
    assert len(one) == 40 and len(ten) == 31
    for k in (1, 2, 3, 10, 25):
        (h,) = substrings.run_hashes(words, k)
        same = {}
        for p, x in enumerate(h.tolist()):
            assert same.setdefault(tuple(words[p:p + k]), x) == x
        assert len(set(same.values())) == len(same)
    x = np.random.default_rng(1).integers(0, 100, 50)
    for width in (1, 2, 3, 8, 41, 50):
        assert substrings.least_of(x, width).tolist() == [x[i:i + width].min() for i in range(50 - width + 1)]


def test_spans_merge():
    assert substrings.merged_spans(np.array([9, 0, 3, 20]), 5) == [(0, 8), (9, 14), (20, 25)]
    assert substrings.merged_spans(np.array([0, 5]), 5) == [(0, 10)]
