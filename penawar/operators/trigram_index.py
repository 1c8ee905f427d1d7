"""Top-k word_similarity join through an inverted trigram index (a threshold algorithm in two passes).

A name scores at most ``shared / |T(q)|``, so for a score of t it must hold ceil(t |T(q)|) of the query's trigrams, and
one of its |T(q)| - ceil(t |T(q)|) + 1 rarest. Trigrams are ordered by the number of distinct names that hold them.

* Pass 1 looks a query up under its rarest indexed trigram alone. The k-th best score found proves how good a result
  must be.
* Pass 2 looks it up under the rest of the prefix for t = max(floor, that score). A pair is scored under its first
  common prefix trigram only, so nothing is scored twice and nothing is lost.

Posting lists are dealt into slices of about ``POSTINGS`` names and their queries into slices of about ``QUERIES``
(``operators.cells``). So a cell's memory doesn't grow with either side, however
common a trigram is. Inside a cell names stand by text, and a 0/1 matrix product with the trigrams of each run of
``RUN`` names leaves the runs that can still reach the k-th best score; of these, names whose shared count can reach it
are scored exactly. Names are distinct texts: rows of one name need only their k smallest ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penawar.config import DEFAULT, MatchConfig
from penawar.functions.similarity import Numbered, extent_scores_unique, last_positions, trigram_seq
from penawar.operators.cells import in_cells, small
from penawar.session import cut_lineage, ship_package

EPS = 1e-9
# names per query looked at up front (x k, at least) to find a tight k-th best score
WARM = 2
POSTINGS, QUERIES = 8192, 2048
# neighbours in the order of texts that are judged together before each is looked at
RUN, RUNS_FIRST = 32, 8
# numbers a block's matrices may hold
BLOCK_CELLS = 16_000_000

FOUND = "key string, name_no long, name_len int, score double"
_NONE = pd.DataFrame({"key": pd.Series([], dtype=object), "name_no": pd.Series([], dtype="int64"),
                      "name_len": pd.Series([], dtype="int32"), "score": pd.Series([], dtype="float64")})


# ---- one cell ----------------------------------------------------------------------------

def name_blocks(cdf: pd.DataFrame, block_rows: int, numbered: Numbered):
    """Runs of the names by text (names of very different lengths apart), each with few enough rows for its vocabulary
    and longest name."""
    size = np.log2(np.maximum(cdf["name"].str.len(), 1)).astype(int)
    cdf = cdf.assign(_n=size).sort_values(["_n", "name"], kind="mergesort").drop(columns="_n")
    tri = [numbered.seq(x) for x in cdf["name"]]
    lo = 0
    while lo < len(tri):
        vocab: set[int] = set()
        hi, longest = lo, 0
        while hi < len(tri) and hi - lo < block_rows:
            vocab.update(tri[hi])
            longest = max(longest, len(tri[hi]))
            if hi > lo and (hi - lo + 1) * max(len(vocab), longest) > BLOCK_CELLS:
                break
            hi += 1
        yield cdf.iloc[lo:hi], tri[lo:hi]
        lo = hi


def _bits(marked: np.ndarray) -> np.ndarray:
    """0/1 rows as rows of 64-bit words."""
    packed = np.packbits(marked, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


class Names:
    """A block of catalog names, prepared once for all queries of a cell."""

    def __init__(self, cdf: pd.DataFrame, tri: list, numbers: int):
        lens = np.array([len(x) for x in tri], dtype=np.int64)
        self.no, self.name_len, self.lens, nc = cdf["name_no"].to_numpy(), cdf["name_len"].to_numpy(), lens, len(cdf)
        vocab, inv = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in tri]), return_inverse=True)
        self.width = len(vocab)
        self.place = np.full(numbers, -1, dtype=np.int64)
        self.place[vocab] = np.arange(len(vocab))
        row_of = np.repeat(np.arange(nc), lens)
        present = np.zeros((nc, len(vocab)), dtype=bool)
        present[row_of, inv] = True
        self.bits, self.distinct = _bits(present), present.sum(axis=1)
        # runs of names: the trigrams that some, and that all of a run hold
        at = np.arange(0, nc, RUN)
        self.some = np.logical_or.reduceat(present, at).astype(np.float32)
        self.all = np.logical_and.reduceat(present, at).astype(np.float32)
        # exact word similarity machinery for the block's names
        L = int(lens.max())
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        pos_in_row = np.arange(len(inv)) - np.repeat(starts, lens)
        self.seq = np.full((nc, L), -1, dtype=np.int32)
        self.seq[row_of, pos_in_row] = inv
        # previous position of the same trigram in the same name (vectorised)
        order = np.lexsort((pos_in_row, inv, row_of))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (row_of[order][1:] == row_of[order][:-1]) & (inv[order][1:] == inv[order][:-1])
        prev_flat = np.full(len(order), -1, dtype=np.int32)
        prev_flat[order[1:][same[1:]]] = pos_in_row[order[:-1][same[1:]]]
        self.prev = np.full((nc, L), -1, dtype=np.int32)
        self.prev[row_of, pos_in_row] = prev_flat
        self.last = last_positions(self.prev, lens)

    def marks(self, sets: list) -> np.ndarray:
        """0/1 rows over the block's vocabulary."""
        out = np.zeros((len(sets), self.width), dtype=bool)
        row_of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        if len(row_of):
            pos = self.place[np.concatenate([np.asarray(s, dtype=np.int64) for s in sets])]
            out[row_of[pos >= 0], pos[pos >= 0]] = True
        return out


def score_block(names: Names, keys: np.ndarray, qsets: list, before: list, known: np.ndarray, floor: float,
                k: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The k best names of a block per query (distinct trigrams) that reach its ``known`` score (-1: none) and hold none
    of its trigrams ``before`` this one; and the score that a name must reach from now on to be among a query's k best.

    word_similarity <= shared / m, so a pair can reach a score t only if shared >= t * m; a run of names is left alone
    if the trigrams that any of its names holds don't suffice, or if all of them hold a trigram ``before``."""
    nc, nq = len(names.no), len(keys)
    m = np.array([len(s) for s in qsets], dtype=np.float64)
    held, gone = names.marks(qsets), names.marks(before)
    hbits, gbits = _bits(held), _bits(gone)
    reach = held.astype(np.float32) @ names.some.T  # exact small integers (float32 holds them exactly)
    if gone.any():
        reach[gone.astype(np.float32) @ names.all.T > 0] = -1.0
    qbool = np.concatenate([held, np.zeros((nq, 1), dtype=bool)], axis=1)  # the last column = padding
    kth = np.maximum(known, floor)

    def need():
        return (kth * m - EPS).astype(np.float32)

    def exact(a, b):
        out = np.empty(len(a))
        step = max(1, 4_000_000 // max(names.seq.shape[1], 1))
        for s0 in range(0, len(a), step):
            aa, bb = a[s0:s0 + step], b[s0:s0 + step]
            L = int(names.lens[bb].max())
            sq = names.seq[bb, :L]
            matched = qbool[aa[:, None], np.where(sq < 0, names.width, sq)]
            out[s0:s0 + step] = extent_scores_unique(matched, names.prev[bb, :L], names.lens[bb], m[aa], names.last[bb, :L])
        return out

    def best_of(qi, run):
        """The names that reach the k-th best score in the runs asked for, as (query, name, score)."""
        least, found = need(), []
        step = max(1, 4_000_000 // (RUN * names.bits.shape[1]))
        for s0 in range(0, len(qi), step):
            a = np.repeat(qi[s0:s0 + step], RUN)
            b = (run[s0:s0 + step, None] * RUN + np.arange(RUN)).ravel()
            a, b = a[b < nc], b[b < nc]
            nbits = names.bits[b]
            ok = np.bitwise_count(hbits[a] & nbits).sum(axis=1, dtype=np.int64) >= least[a]
            ok &= ~(gbits[a] & nbits).any(axis=1)
            a, b = a[ok], b[ok]
            sc = exact(a, b)
            ok = sc >= kth[a] - EPS
            found.append((a[ok], b[ok], sc[ok]))
        return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]

    # the names with the best lower bounds (the whole-name score) in the runs of highest reach give a k-th best score
    w, some = WARM * k, min(reach.shape[1], RUNS_FIRST)
    if min(nc, some * RUN) > w:
        first = np.argpartition(-reach, some - 1, axis=1)[:, :some]
        least, step = need(), max(1, 4_000_000 // (some * RUN * names.bits.shape[1]))
        for lo in range(0, nq, step):
            part = slice(lo, lo + step)
            b = (first[part, :, None] * RUN + np.arange(RUN)).reshape(len(m[part]), -1)
            ok = (b < nc) & np.repeat(np.take_along_axis(reach[part], first[part], 1) >= least[part, None], RUN, axis=1)
            b = np.minimum(b, nc - 1)
            nbits = names.bits[b]
            shared = np.bitwise_count(hbits[part, None] & nbits).sum(axis=2, dtype=np.int64)
            ok &= (shared >= least[part, None]) & ~(gbits[part, None] & nbits).any(axis=2)
            low = np.where(ok, shared / (m[part, None] + names.distinct[b] - shared), -1.0)
            top = np.argpartition(-low, w - 1, axis=1)[:, :w]
            a, c = np.nonzero(np.take_along_axis(ok, top, 1))
            sc = np.full(top.shape, -1.0)
            sc[a, c] = exact(lo + a, b[a, top[a, c]])
            kth[part] = np.maximum(kth[part], -np.partition(-sc, k - 1, axis=1)[:, k - 1])
    a, b, sc = best_of(*np.nonzero(reach >= need()[:, None]))
    keep = sc >= floor
    a, b, sc = a[keep], b[keep], sc[keep]
    order = np.lexsort((names.no[b], names.name_len[b], -sc, a))
    a, b, sc = a[order], b[order], sc[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    kth[a[nth == k - 1]] = sc[nth == k - 1]
    a, b, sc = a[nth < k], b[nth < k], sc[nth < k]
    out = {"key": pd.Series(keys[a], dtype=object), "name_no": names.no[b], "name_len": names.name_len[b].astype("int32"), "score": sc}
    return pd.DataFrame(out), kth


def _cell_task(cfg: MatchConfig):
    floor, k = cfg.trigram_floor, cfg.top_k

    def run(qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or cdf.empty:
            return _NONE
        found = []
        numbered = Numbered()
        lists = dict(list(cdf.groupby("tri", sort=False)))
        for tri, mine in qdf.groupby("tri", sort=False):
            if tri not in lists:
                continue
            keys, known = mine["key"].to_numpy(), mine["known"].to_numpy(dtype=np.float64, copy=True)
            qsets = [list(set(numbered.seq(x))) for x in keys]
            before = [numbered.of(b) for b in mine["before"]]
            for rows, seqs in name_blocks(lists[tri], cfg.catalog_block_rows, numbered):
                names = Names(rows, seqs, len(numbered.number))
                step = max(64, min(cfg.query_block_rows, BLOCK_CELLS // max(names.width, len(names.some), 1)))
                for lo in range(0, len(keys), step):
                    part = slice(lo, lo + step)
                    # what a block's names reach binds the blocks that follow
                    out, known[part] = score_block(names, keys[part], qsets[part], before[part], known[part], floor, k)
                    found.append(out)
        found = [x for x in found if len(x)]
        return pd.concat(found, ignore_index=True) if found else _NONE

    return run


# ---- the index ---------------------------------------------------------------------------

def _trigram_rows(keep: list[str], col: str, schema: str):
    """Rows of the columns ``keep`` and one distinct trigram of ``col`` each."""

    def run(batches):
        for pdf in batches:
            tri = [sorted(set(trigram_seq(x))) for x in pdf[col]]
            at = np.repeat(np.arange(len(pdf)), [len(x) for x in tri])
            if not len(at):  # wordless texts alone
                continue
            out = pdf[keep].iloc[at].reset_index(drop=True)
            out["tri"] = [t for x in tri for t in x]
            yield out

    return run, schema


def distinct_names(catalog: DataFrame, name_col: str, k: int) -> DataFrame:
    """(name, name_no, name_len, ids): per distinct name its k smallest ids; name_no is the smallest."""
    c = catalog.select("id", F.col(name_col).alias("name")).where(F.col("id").isNotNull() & F.col("name").isNotNull())
    w = Window.partitionBy("name").orderBy("id")
    c = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return c.select("name", F.get("ids", F.lit(0)).alias("name_no"), F.length("name").alias("name_len"), "ids")


def _looked_up(asked: DataFrame, postings: DataFrame, cfg: MatchConfig, parts: int) -> DataFrame:
    """(key, name_no, name_len, score) from ``asked`` (key, tri, known, before)."""
    return in_cells(cut_lineage(asked), postings, "tri", "key", "name_no", parts, POSTINGS, QUERIES).applyInPandas(_cell_task(cfg), FOUND)


def trigram_topk(queries: DataFrame, catalog: DataFrame, cfg: MatchConfig = DEFAULT, key_col: str = "key", name_col: str = "name") -> DataFrame:
    """Top-k catalog ids per distinct query text by word_similarity >= floor.

    Returns (key, id, name_len, score, rank); rank orders by score desc, length(name) asc, id asc. Null or wordless
    texts find nothing."""
    spark = queries.sparkSession
    ship_package(spark)
    k = cfg.top_k
    names = cut_lineage(distinct_names(catalog, name_col, k))
    postings = cut_lineage(names.select("name", "name_no", "name_len").mapInPandas(
        *_trigram_rows(["name", "name_no", "name_len"], "name", "name string, name_no long, name_len int, tri string")))
    freq = small(postings.groupBy("tri").agg(F.count(F.lit(1)).alias("freq")))
    parts = 8 * spark.sparkContext.defaultParallelism
    # null keys have no trigrams; a filter here would evaluate the key's own expression twice
    keys = queries.select(F.col(key_col).alias("key")).distinct()
    cut = keys.repartition(parts, "key").mapInPandas(*_trigram_rows(["key"], "key", "key string, tri string"))
    ordered = (cut.join(freq, "tri", "left").groupBy("key")
               .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "tri"))).alias("tris")))
    ordered = cut_lineage(ordered.withColumn("m", F.size("tris")).withColumn("unseen", F.size(F.filter("tris", lambda x: x["freq"] == 0))))

    rarest = F.get("tris", F.col("unseen"))
    first = (ordered.where(F.col("unseen") < F.col("m"))
             .select("key", rarest["tri"].alias("tri"), F.lit(-1.0).alias("known"), F.array().cast("array<string>").alias("before")))
    found1 = cut_lineage(_looked_up(first, postings, cfg, parts))
    # names of one text count as often as they have ids
    counted = found1.join(small(names.select("name_no", F.size("ids").alias("n"))), "name_no")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "name_no").rowsBetween(Window.unboundedPreceding, 0)
    known = counted.withColumn("held", F.sum("n").over(best)).where(F.col("held") >= k).groupBy("key").agg(F.max("score").alias("known"))

    t = F.greatest(F.coalesce("known", F.lit(-1.0)), F.lit(cfg.trigram_floor))
    reach = (F.col("m") - F.ceil(t * F.col("m") - EPS) + 1).cast("int")
    rest = (ordered.join(known, "key", "left").withColumn("known", F.coalesce("known", F.lit(-1.0)))
            .withColumn("prefix", F.slice("tris", F.lit(1), reach)).where(F.size("prefix") > F.col("unseen") + 1)
            .select("key", "known", "unseen", "prefix", F.posexplode("prefix").alias("at", "x")).where(F.col("at") > F.col("unseen"))
            .select("key", F.col("x.tri").alias("tri"), "known",
                    F.transform(F.slice("prefix", F.col("unseen") + 1, F.col("at") - F.col("unseen")), lambda x: x["tri"]).alias("before")))
    found2 = _looked_up(rest, postings, cfg, parts)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "name_len", "name_no"))
    top = found1.unionByName(found2).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    ids = top.join(small(names.select("name_no", "ids")), "name_no").select("key", F.explode("ids").alias("id"), "name_len", "score")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "name_len", "id"))
    return ids.withColumn("rank", rank).where(F.col("rank") <= k)
