"""Substring dedup: suffix trees over groups of suffixes with a common prefix of variable length.

A window is ``size`` consecutive words of one document; a word goes when a window over it also starts in a
document of smaller doc_id.

* Equal word sequences are one class, so copies never enter the trees: the row of least doc_id stands for it.
* Suffixes that can repeat: every window holds the run of ``gram`` words of least hash (its anchor), and equal
  windows have equal anchors. Only suffixes whose anchor occurs under two doc_ids are kept; none that repeats
  is lost. The anchors are about 1/20 of the positions.
* Vertical partitioning: suffixes are counted by a prefix of ``gram`` words; a prefix of more than
  ``group_rows`` suffixes is extended to half a window, and then to a whole one. The prefixes are dealt into
  groups of about ``group_rows`` suffixes, which is what one task holds of a tree.
* A subtree is built from its sorted suffixes. The edges to depth ``size`` carry two labels, the hashes of the
  window's halves; neighbours that agree in both hang under one internal node of depth ``size`` or more. The
  node's leaves of greater doc_id than its least one are repeats.
* A prefix of a whole window that still has more suffixes is one node and needs no tree: its least doc_id is
  an aggregate, combined before the shuffle.
* Consecutive repeats of a document merge into its maximal repeated passages (spans of word numbers).

Words are compared by 64-bit hashes in runs, document classes by SHA-256. A very long document is one row, and
so are its positions. Null text has no words; a row without a doc_id has no order, keeps all its words and
removes none; repeated rows, and rows of one doc_id with different texts, are judged against smaller doc_ids
only. Ties can't occur. Only doc_id and text are read. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from penawar.llm.common import broadcast_if_small, columns_of, maybe_in, row_key, same_key, written
from penawar.session import ship_package

SIZE = 50
GRAM = 10
GROUP_ROWS = 200_000
HOT_CLASS = 1000
FLUSH = 200_000

_MUL = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, one at a time."""
    for x in column.cast(pa.binary()):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


# ---- hashes of runs of words -------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _polynomials(h: np.ndarray, k: int) -> np.ndarray:
    """Per position the polynomial of the k word hashes from there on (halves are joined, so about log k steps)."""
    if k == 1:
        return h
    half = k // 2
    p = _polynomials(h, half)
    n = len(h) - 2 * half + 1
    out = p[:n] * np.uint64(pow(_MUL, half, 1 << 64)) + p[half:half + n]
    if k % 2:
        out = out[:-1] * np.uint64(_MUL) + h[2 * half:2 * half + len(out) - 1]
    return out


def run_hashes(words: list[bytes], *lengths: int) -> list[np.ndarray]:
    h = _mixed(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    return [_mixed(_polynomials(h, k)) for k in lengths]


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum."""
    held, w = x, 1
    while 2 * w <= width:
        held, w = np.minimum(held[:len(held) - w], held[w:]), 2 * w
    n = len(x) - width + 1
    return np.minimum(held[:n], held[width - w:width - w + n])


def window_anchors(grams: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Per window the least hash of its runs of ``gram`` words."""
    return least_of(grams, size - gram + 1)


# ---- documents, classes and anchors ------------------------------------------------------

_DOCS = "doc_id long, _h long, n_words int, words_sha string, anchors array<long>"


def _anchor_task(size: int, gram: int):
    def run(batches):
        for batch in batches:
            n, sha, anchors = [], [], []
            for t in texts_of(batch.column("text")):
                w = t.split()  # at \x20 and \x09-\x0D alone
                n.append(len(w))
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
                a = np.unique(window_anchors(run_hashes(w, gram)[0], size, gram)) if len(w) >= size else np.empty(0, np.uint64)
                anchors.append(a.view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(a) for a in anchors]))).astype(np.int32)
            values = np.concatenate(anchors) if anchors else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_h"), pa.array(n, pa.int32()), pa.array(sha, pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "_h", "n_words", "words_sha", "anchors"])

    return run


# ---- suffixes ----------------------------------------------------------------------------

_SUFFIX = "doc_id long, _h long, pos int, prefix long, left long, right long"


def _suffix_task(size: int, gram: int):
    def run(batches):
        cols: list[list] = [[] for _ in range(6)]
        held = 0

        def flush():
            types = (np.int64, np.int64, np.int32, np.int64, np.int64, np.int64)
            arrays = [pa.array(np.concatenate(c) if c else np.empty(0, t)) for c, t in zip(cols, types)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "_h", "pos", "prefix", "left", "right"])

        for batch in batches:
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("_h").to_pylist(), batch.column("shared"))
            for t, (doc_id, h, shared) in zip(texts_of(batch.column("text")), keys):
                w = t.split()
                grams, halves = run_hashes(w, gram, size // 2)
                wanted = shared.values.to_numpy(zero_copy_only=False).view(np.uint64)
                pos = np.flatnonzero(np.isin(window_anchors(grams, size, gram), wanted)).astype(np.int32)
                for c, a in zip(cols, (np.full(len(pos), doc_id, np.int64), np.full(len(pos), h, np.int64), pos,
                                       grams[pos].view(np.int64), halves[pos].view(np.int64), halves[pos + size // 2].view(np.int64))):
                    c.append(a)
                held += len(pos)
                if held >= FLUSH:
                    yield flush()
                    cols, held = [[] for _ in range(6)], 0
        yield flush()

    return run


def repeating_suffixes(docs: DataFrame, reps: DataFrame, size: int, gram: int) -> DataFrame:
    """(doc_id, _h, pos, prefix, left, right): every suffix of a class's row whose anchor occurs under two doc_ids."""
    anchors = reps.select("doc_id", "_h", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    wanted = written(anchors.join(shared, "anchor").groupBy("doc_id", "_h").agg(F.collect_list("anchor").alias("shared")), "repeats-anchors")
    texts = docs.where(maybe_in(wanted)).join(wanted, ["doc_id", "_h"]).dropDuplicates(["doc_id", "_h"])
    return texts.select("doc_id", "_h", "text", "shared").mapInArrow(_suffix_task(size, gram), _SUFFIX)


# ---- groups and subtrees -----------------------------------------------------------------

def deep_leaves(left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which leaves of a subtree hang under an internal node of whole-window depth beside one of smaller doc_id."""
    order = np.lexsort((doc, right, left))
    left, right, doc = left[order], right[order], doc[order]
    opens = np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    least = doc[opens][np.cumsum(opens) - 1]
    return order[doc > least]


def _subtree(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[deep_leaves(pdf["left"].to_numpy(), pdf["right"].to_numpy(), pdf["doc_id"].to_numpy())][["doc_id", "_h", "pos"]]


def _heavy(suffixes: DataFrame, keys: list[str], rows: int, name: str) -> DataFrame:
    """(keys, least): prefixes of more than ``rows`` suffixes; at most 1/rows of all suffixes."""
    return written(suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
                   .where(F.col("n") > rows).drop("n"), name)


def repeated_suffixes(suffixes: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, _h, pos) of the suffixes whose window also starts under a smaller doc_id."""
    n = suffixes.count()
    heavy = _heavy(suffixes, ["prefix"], group_rows, "repeats-heavy")
    if not heavy.limit(1).count():
        return _trees(suffixes, F.col("prefix"), n, group_rows)
    marked = suffixes.join(broadcast_if_small(heavy.select("prefix", F.lit(True).alias("long"))), "prefix", "left")
    light = marked.where("long is null").drop("long")
    longer = written(marked.where("long").drop("long"), "repeats-longer")
    halves = broadcast_if_small(_heavy(longer, ["left"], group_rows, "repeats-heavy").select("left", F.lit(True).alias("long")))
    longer = longer.join(halves, "left", "left")
    middle = longer.where("long is null").drop("long")
    longest = longer.where("long").drop("long")
    nodes = broadcast_if_small(_heavy(longest, ["left", "right"], group_rows, "repeats-nodes"))
    longest = longest.join(nodes, ["left", "right"], "left")
    hits = longest.where(F.col("doc_id") > F.col("least")).select("doc_id", "_h", "pos")
    key = "prefix_key"
    grouped = (light.withColumn(key, F.col("prefix")).unionByName(middle.withColumn(key, F.col("left")))
               .unionByName(longest.where("least is null").drop("least").withColumn(key, F.xxhash64("left", "right"))))
    return _trees(grouped, F.col(key), n, group_rows).unionByName(hits)


def _trees(suffixes: DataFrame, prefix: Column, n: int, group_rows: int) -> DataFrame:
    groups = max(1, -(-n // group_rows))
    return (suffixes.select(F.pmod(F.xxhash64(prefix), F.lit(groups)).alias("group"), "doc_id", "_h", "pos", "left", "right")
            .groupBy("group").applyInPandas(_subtree, "doc_id long, _h long, pos int"))


# ---- results -----------------------------------------------------------------------------

def merged_spans(pos: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The words that windows at ``pos`` cover, as spans (end exclusive)."""
    pos = np.sort(pos)
    cut = np.flatnonzero(np.diff(pos) > size)
    first = np.concatenate(([0], cut + 1))
    last = np.concatenate((cut, [len(pos) - 1]))
    return [(int(pos[a]), int(pos[b]) + size) for a, b in zip(first, last)]


def _span_task(size: int):
    def run(batches):
        for pdf in batches:
            spans = [[{"start": a, "end": b} for a, b in merged_spans(np.asarray(p), size)] for p in pdf["pos"]]
            yield pd.DataFrame({"words_sha": pdf["words_sha"], "least": pdf["least"], "spans": spans})

    return run


_SPANS = "array<struct<start:int,end:int>>"


def repeated_passages(docs: DataFrame, size: int = SIZE, gram: int = GRAM, group_rows: int = GROUP_ROWS,
                      hot_class: int = HOT_CLASS) -> DataFrame:
    """One row per document: doc_id, _h (hash of the text), n_words, words_sha, spans (word ranges to remove, end exclusive)."""
    ship_package(docs.sparkSession)
    docs = columns_of(docs, "doc_id", "text").select("doc_id", "text", row_key().alias("_h"))
    seen = written(docs.mapInArrow(_anchor_task(size, gram), _DOCS), "repeats-docs")
    judged = seen.where((F.col("n_words") >= size) & F.col("doc_id").isNotNull())
    classes = written(judged.groupBy("words_sha").agg(F.min(F.struct("doc_id", "_h", "anchors")).alias("rep"), F.count(F.lit(1)).alias("rows"))
                      .select("words_sha", "rows", "rep.*"), "repeats-classes")
    suffixes = written(repeating_suffixes(docs, classes, size, gram), "repeats-suffixes")
    hits = repeated_suffixes(suffixes, group_rows).groupBy("doc_id", "_h").agg(F.collect_list("pos").alias("pos"))
    found = (hits.join(classes.select("words_sha", "doc_id", "_h"), ["doc_id", "_h"])
             .select("words_sha", F.col("doc_id").alias("least"), "pos")
             .mapInPandas(_span_task(size), f"words_sha string, least long, spans {_SPANS}"))
    # classes of which any row loses words: those with spans and those with copies
    copied = classes.where("rows > 1").select("words_sha", F.col("doc_id").alias("least"), F.lit(None).cast(_SPANS).alias("spans"), "rows")
    losing = (found.withColumn("rows", F.lit(1).cast("long")).unionByName(copied).groupBy("words_sha")
              .agg(F.min("least").alias("least"), F.first("spans", ignorenulls=True).alias("spans"), F.max("rows").alias("rows")))
    losing = written(losing, "repeats-losing-classes")
    # a class of many rows doesn't meet in one task: there are at most 1/hot_class of those
    hot = broadcast_if_small(losing.where(F.col("rows") > hot_class).select("words_sha", "least", "spans"))
    marked = seen.drop("anchors").join(hot, "words_sha", "left")
    cold = losing.where(F.col("rows") <= hot_class).select("words_sha", "least", "spans")
    judged = marked.where("least is not null").unionByName(marked.where("least is null").drop("least", "spans").join(cold, "words_sha", "left"))
    none = F.array().cast(_SPANS)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"))).cast(_SPANS)
    return judged.select("doc_id", "_h", "n_words", "words_sha",
                         F.when(F.col("doc_id") > F.col("least"), whole)
                         .when(F.col("doc_id") == F.col("least"), F.coalesce("spans", none)).otherwise(none).alias("spans"))


def _keep_task(batches):
    for batch in batches:
        kept = []
        for t, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist()):
            w, at, parts = t.split(), 0, []
            for s in spans:
                parts += w[at:s["start"]]
                at = s["end"]
            kept.append(b" ".join(parts + w[at:]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_h"), pa.array(kept, pa.binary()).cast(pa.string())],
                                         ["doc_id", "_h", "kept"])


def _kept(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, _h, kept): the kept words, joined by a space, of rows that keep some words and lose some."""
    part = written(passages.where((F.size("spans") > 0) & (_removed() < F.col("n_words"))).select("doc_id", "_h", "spans")
                   .dropDuplicates(["doc_id", "_h"]), "repeats-part")
    texts = columns_of(docs, "doc_id", "text").select("doc_id", "text", row_key().alias("_h"))
    return (texts.where(maybe_in(part)).join(part, ["doc_id", "_h"]).dropDuplicates(["doc_id", "_h"])
            .select("doc_id", "_h", "text", "spans").mapInArrow(_keep_task, "doc_id long, _h long, kept string"))


def _removed() -> Column:
    return F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])


def kept_digest(docs: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    found = written(repeated_passages(docs, **params), "repeats-passages")
    kept = _kept(docs, found).select("doc_id", "_h", F.sha2("kept", 256).alias("kept_sha"))
    sha = F.when(_removed() == 0, F.col("words_sha")).when(_removed() == F.col("n_words"), F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha"))
    return same_key(found, kept).select("doc_id", F.col("n_words").cast("long").alias("n_words"),
                                        _removed().cast("long").alias("n_removed"), sha.alias("kept_sha256"))


def drop_passages(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, text): the texts without their repeated passages; a text that loses words has its kept words joined by
    a space ('' when none is left), the others stay as they are. Repeated rows stay repeated."""
    found = written(repeated_passages(docs, **params), "repeats-passages")
    losing = written(found.where(F.size("spans") > 0).select("doc_id", "_h").distinct(), "repeats-losing")
    kept = written(_kept(docs, found), "repeats-kept")
    change = losing.join(kept, ["doc_id", "_h"], "left").select("doc_id", "_h", F.coalesce("kept", F.lit("")).alias("kept"))
    texts = columns_of(docs, "doc_id", "text").select("doc_id", "text", row_key().alias("_h"))
    may = maybe_in(losing) & F.col("doc_id").isNotNull()
    changed = same_key(texts.where(may), change).select("doc_id", F.coalesce("kept", "text").alias("text"))
    return texts.where(~may).select("doc_id", "text").unionByName(changed)
