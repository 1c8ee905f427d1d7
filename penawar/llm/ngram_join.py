"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct word shingles; two link when 100 * |A & B| >= percent * |A | B|.

* Equal sets are one *class*, keyed by a 64-bit hash of the whole set, so copies are never paired.
* Global order: shingles by rarity. Frequencies of all shingles of all documents are counted in a
  table of 2^sketch_bits hashed counters (of fixed size, so it may be broadcast); the order is
  (counter, hash), the same for all documents. An order by estimates is still a total order, so
  the filters below lose nothing.
* Multi-match prefixes: with o = ceil(percent/100 * n), sets that link share at least l shingles
  in their first n - o + l ones. A document's l is chosen by estimated cost: a longer prefix costs
  rows and meetings, and at most (sum of the estimated partners in it) / l documents share l of it.
  Two documents need min(l_a, l_b) shared shingles in the prefixes of that l.
* Pair bounds: sizes (n_b * 100 >= percent * n_a), and positions for the pair's own necessary
  overlap o_ab: only shingles before n - o_ab + l count.
* Hot lists: where a shingle's list has ``hot`` classes or more, each is first compared with the
  list's hub, the class where that shingle comes earliest (it has the fewest rare shingles of its
  own, like the origin of a group of near copies). Classes joined that way need no comparison with
  each other: afterwards only pairs of different components are generated, for all lists.
* Verification: candidate pairs fetch the whole texts and compute the exact Jaccard similarity.
* Links, components and labels stay distributed tables.

Documents: a null doc_id takes no part and gets a null component; texts without words have an
empty set and are their own component; repeated rows are copies; a doc_id with several texts
links all their classes' members by its rows, not by its id. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penawar.llm.common import columns_of, maybe_in, packed, row_key, same_key, written
from penawar.llm.components import connected_components
from penawar.llm.shingles import set_signature, shingle_set
from penawar.session import ship_package

SIZE = 5
PERCENT = 75
SKETCH_BITS = 21
SKETCH_BLOCK = 1 << 14
HOT = 8
MAX_MATCH = 8
PAIR_COST = 4.0
CELL_ROWS = 1024
FLUSH = 500_000


def _need(percent: int, n: int) -> int:
    """Least overlap of a set of n with any set it links with."""
    return -(-percent * n // 100)


def _overlap(percent: int, na: Column, nb: Column) -> Column:
    """Least overlap of linked sets of na and nb."""
    return F.ceil(F.lit(percent) * (na + nb) / (100 + percent) - 1e-9)


TEXT_ROWS, PAIR_ROWS = 1000, 250  # rows in an Arrow batch of texts, and of pairs of texts


def _texts(batch: pa.RecordBatch, name: str = "text"):
    """The texts as bytes, one at a time."""
    for x in batch.column(name).cast(pa.binary()):
        yield x.as_buffer().to_pybytes() if x.is_valid else None


# ---- classes and counters ---------------------------------------------------------------

_SETS = "doc_id long, _h long, sig long, n int, block int, counts binary"


def _set_task(size: int, bits: int):
    def run(batches):
        counters = np.zeros(1 << bits, np.uint32)
        shift = np.uint64(64 - bits)
        for batch in batches:
            sig, n, slots, held = [], [], [], 0
            for t in _texts(batch):
                s = shingle_set(t, size)
                n.append(len(s))
                sig.append(set_signature(s) if len(s) else None)
                slots.append((s >> shift).astype(np.int32))
                held += len(s)
                if held >= FLUSH * 4:
                    counters += np.bincount(np.concatenate(slots), minlength=1 << bits).astype(np.uint32)
                    slots, held = [], 0
            if held:
                counters += np.bincount(np.concatenate(slots), minlength=1 << bits).astype(np.uint32)
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_h"), pa.array(sig, pa.int64()), pa.array(n, pa.int32()),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["doc_id", "_h", "sig", "n", "block", "counts"])
        blocks = [i for i in range(0, 1 << bits, SKETCH_BLOCK) if counters[i:i + SKETCH_BLOCK].any()]
        k = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()),
             pa.array([i // SKETCH_BLOCK for i in blocks], pa.int32()),
             pa.array([zlib.compress(counters[i:i + SKETCH_BLOCK].tobytes(), 1) for i in blocks], pa.binary())],
            ["doc_id", "_h", "sig", "n", "block", "counts"])

    return run


def _add_blocks(batches):
    """Sum the tasks' counters block by block; a task holds the blocks dealt to it, at most the whole table."""
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for block, counts in zip(pdf["block"], pdf["counts"]):
            part = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
            total[block] = total[block] + part if block in total else part
    yield pd.DataFrame({"block": pd.Series(list(total), dtype="int32"),
                        "counts": [zlib.compress(np.minimum(c, 2**32 - 1).astype(np.uint32).tobytes(), 1) for c in total.values()]})


def shingle_counters(parts: DataFrame, bits: int) -> np.ndarray:
    """The counters of all documents: 2^bits numbers, whatever the number of documents."""
    summed = parts.repartition("block").mapInPandas(_add_blocks, "block int, counts binary")
    out = np.zeros(1 << bits, np.uint32)
    for r in summed.collect():  # at most 2^bits / SKETCH_BLOCK rows
        out[r.block * SKETCH_BLOCK:(r.block + 1) * SKETCH_BLOCK] = np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return out


# ---- prefixes ---------------------------------------------------------------------------

_POSTING = "token long, sig long, n int, pos int, l int"


def adaptive_prefix(shingles: np.ndarray, counts: np.ndarray, typical: float, percent: int, max_match: int = MAX_MATCH,
                    pair_cost: float = PAIR_COST) -> tuple[np.ndarray, int]:
    """The shingles of the chosen prefix in global order, and its number of matches l."""
    n = len(shingles)
    o = _need(percent, n)
    order = np.lexsort((shingles, counts))
    top = min(max_match, o)
    longest = order[:n - o + top]
    partners = np.cumsum(np.maximum(counts[longest].astype(np.float64) - typical - 1, 0.0))
    ls = np.arange(1, top + 1)
    # rows that meet partners of about the same size: those must share 2 * percent / (100 + percent) of the shingles
    like = n - -(-2 * percent * n // (100 + percent))
    met = partners[like + ls - 1]
    cost = (n - o + ls) + met + pair_cost * met / ls
    ell = int(ls[np.argmin(cost)])
    return shingles[longest[:n - o + ell]], ell


def _prefix_task(counters, size: int, percent: int):
    def run(batches):
        table = counters.value
        shift = np.uint64(64 - int(len(table)).bit_length() + 1)
        typical = float(table.mean())
        seen: set[int] = set()
        cols: list[list] = [[], [], [], [], []]
        held = 0

        def flush():
            arrays = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(cols, (np.int64, np.int64, np.int32, np.int32, np.int32))]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["token", "sig", "n", "pos", "l"])

        for batch in batches:
            for t in _texts(batch):
                s = shingle_set(t, size)
                if not len(s):
                    continue
                sig = set_signature(s)
                if sig in seen:  # copies in the same task
                    continue
                if len(seen) < 100_000:
                    seen.add(sig)
                p, ell = adaptive_prefix(s, table[(s >> shift).astype(np.int64)], typical, percent)
                k = len(p)
                for c, a in zip(cols, (p.view(np.int64), np.full(k, sig, np.int64), np.full(k, len(s), np.int32),
                                       np.arange(k, dtype=np.int32), np.full(k, ell, np.int32))):
                    c.append(a)
                held += k
                if held >= FLUSH:
                    yield flush()
                    cols, held = [[], [], [], [], []], 0
        yield flush()

    return run


def _fits(percent: int, na: Column, nb: Column) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _within(n: Column, pos: Column, o: Column, ell: Column) -> Column:
    """The shingle counts for a pair that must share o, of which ell in the prefixes."""
    return pos <= n - o + ell - 1


def posting_lists(docs: DataFrame, counters: np.ndarray, size: int, percent: int, hot: int) -> DataFrame:
    """(token, sig, n, pos, l, m, hub*, near): the prefix shingles that two classes or more have; m: how many have it.

    The hub is the class where the shingle comes first; ties by size, then key. In a list of fewer than ``hot`` classes
    ``near`` holds the (sig, l) of the classes before this one that pass the pair bounds with it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counters)
    raw = docs.select("text").mapInArrow(_prefix_task(shared, size, percent), _POSTING)
    order = Window.partitionBy("token").orderBy("pos", "n", "sig")
    every = Window.partitionBy("token")
    again = F.coalesce(F.lag("sig").over(order) == F.col("sig"), F.lit(False))  # a copy from another task
    hub = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lists = (raw.withColumn("again", again)
             .withColumn("hub", F.first("sig").over(hub)).withColumn("hub_n", F.first("n").over(hub))
             .withColumn("hub_pos", F.first("pos").over(hub))
             .withColumn("m", F.sum((~F.col("again")).cast("int")).over(every))
             .where("m >= 2 and not again").drop("again"))
    me = F.struct("sig", "n", "pos", "l")
    before = F.array(*[F.lag(me, k).over(order) for k in range(1, hot)])

    def passes(x: Column) -> Column:
        o, ell = _overlap(percent, F.col("n"), x["n"]), F.least(F.col("l"), x["l"])
        return (x.isNotNull() & _fits(percent, F.col("n"), x["n"]) & _within(F.col("n"), F.col("pos"), o, ell)
                & _within(x["n"], x["pos"], o, ell))

    near = F.transform(F.filter("before", passes), lambda x: F.struct(x["sig"].alias("sig"), F.least(F.col("l"), x["l"]).alias("l")))
    return lists.withColumn("before", before).withColumn("near", F.when(F.col("m") < hot, near)).drop("before")


# ---- verification -----------------------------------------------------------------------

def _texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(sig, text) for the representatives (sig, doc_id, _h). The bit table drops most others before the shuffle."""
    near = docs.select("doc_id", "text", row_key().alias("_h")).where(maybe_in(reps))
    return near.join(reps, ["doc_id", "_h"]).dropDuplicates(["doc_id", "_h"]).select("sig", "text")


def _verify_task(size: int, percent: int):
    def run(batches):
        cache = OrderedDict()

        def of(sig, text):
            s = cache.get(sig)
            if s is None:
                s = cache[sig] = shingle_set(text, size)
                if len(cache) > 64:
                    cache.popitem(last=False)
            return s

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (ta, tb) in enumerate(zip(_texts(batch, "text_a"), _texts(batch, "text_b"))):
                x, y = of(a[i], ta), of(b[i], tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            k = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(k)), batch.column("b").take(pa.array(k))], ["a", "b"])

    return run


def _verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets link."""
    used = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    texts = written(_texts_of(docs, written(reps.join(used, "sig"), "join-reps")), "join-texts")
    both = (pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify_task(size, percent), "a long, b long")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


# ---- the join ---------------------------------------------------------------------------

def _list_pairs(rows: DataFrame, percent: int, cell_rows: int) -> DataFrame:
    """(a, b, l): all pairs of each list that pass the pair bounds. A list of m classes is dealt into m / cell_rows
    pieces by the class's hash, and every two pieces meet in a cell of their own."""
    pieces = F.ceil(F.col("m") / cell_rows).cast("int")
    r = (rows.select("token", "sig", "n", "pos", "l", pieces.alias("pieces"))
         .withColumn("piece", F.pmod(F.xxhash64("sig"), F.col("pieces")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    x = r.select("token", F.col("piece").alias("i"), other.alias("j"), *[F.col(c).alias(f"x_{c}") for c in ("sig", "n", "pos", "l")])
    y = r.select("token", other.alias("i"), F.col("piece").alias("j"), *[F.col(c).alias(f"y_{c}") for c in ("sig", "n", "pos", "l")])
    xn, yn, ell = F.col("x_n"), F.col("y_n"), F.least("x_l", "y_l")
    o = _overlap(percent, xn, yn)
    return (x.join(y, ["token", "i", "j"])
            .where((F.col("x_sig") < F.col("y_sig")) & _fits(percent, xn, yn)
                   & _within(xn, F.col("x_pos"), o, ell) & _within(yn, F.col("y_pos"), o, ell))
            .select(F.col("x_sig").alias("a"), F.col("y_sig").alias("b"), ell.alias("l")))


def jaccard_links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, hot: int = HOT,
                  exact: bool = False, cell_rows: int = CELL_ROWS):
    """(members, links): members (doc_id, _h, sig, n) for every row with a doc_id; links (a, b) between classes.

    By default the links leave out pairs of classes that other links connect already within a hot list: enough for
    components. With ``exact`` they are all pairs of different sets that link, so as many as the square of a group of
    near copies; ``links_per_class`` counts them."""
    ship_package(docs.sparkSession)
    docs = columns_of(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
    sets = written(docs.select("doc_id", "text", row_key().alias("_h")).mapInArrow(_set_task(size, sketch_bits), _SETS), "join-sets", TEXT_ROWS)
    members = sets.where("block is null").select("doc_id", "_h", "sig", "n")
    counters = shingle_counters(sets.where("block is not null").select("block", "counts"), sketch_bits)
    reps = (members.where("n > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "_h")).alias("rep"))
            .select("sig", "rep.doc_id", "rep._h"))
    lists = written(posting_lists(docs, counters, size, percent, hot), "join-lists", TEXT_ROWS)

    if exact:
        near = _list_pairs(lists, percent, cell_rows)
        pairs = (near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.first("l").alias("l")).where("k >= l").select("a", "b"))
        return members, written(_verified(docs, written(pairs, "join-pairs"), reps, size, percent), "join-links", PAIR_ROWS)

    # hot lists: every class against the hub
    o = _overlap(percent, F.col("n"), F.col("hub_n"))
    one = F.lit(1)
    hub_pairs = (lists.where((F.col("m") >= hot) & (F.col("sig") != F.col("hub")) & _fits(percent, F.col("n"), F.col("hub_n"))
                             & _within(F.col("n"), F.col("pos"), o, one) & _within(F.col("hub_n"), F.col("hub_pos"), o, one))
                 .select(*_pair(F.col("sig"), F.col("hub"))).distinct())
    hub_pairs = written(hub_pairs, "join-hub-pairs")
    hub_links = written(_verified(docs, hub_pairs, reps, size, percent), "join-hub-links", PAIR_ROWS)
    joined = connected_components(hub_links)

    # all lists: pairs of different components
    hot_rows = (lists.where(F.col("m") >= hot).join(joined.withColumnRenamed("node", "sig"), "sig", "left")
                .withColumn("root", F.coalesce("root", "sig")))
    by_token = Window.partitionBy("token")
    cols = ("sig", "n", "pos", "l", "root")
    hot_rows = written(hot_rows.withColumn("lo", F.min("root").over(by_token)).withColumn("hi", F.max("root").over(by_token))
                       .where("lo <> hi").select("token", *cols), "join-hot")
    x = hot_rows.withColumnsRenamed({c: f"x_{c}" for c in cols})
    y = hot_rows.withColumnsRenamed({c: f"y_{c}" for c in cols})
    xn, yn, ell = F.col("x_n"), F.col("y_n"), F.least("x_l", "y_l")
    o = _overlap(percent, xn, yn)
    hot_pairs = (x.join(y, "token").where((F.col("x_sig") < F.col("y_sig")) & (F.col("x_root") != F.col("y_root"))
                                          & _fits(percent, xn, yn)
                                          & _within(xn, F.col("x_pos"), o, ell) & _within(yn, F.col("y_pos"), o, ell))
                 .select(F.col("x_sig").alias("a"), F.col("y_sig").alias("b"), ell.alias("l")))
    cold_pairs = (lists.where(F.size("near") > 0).select("sig", F.explode("near").alias("x"))
                  .select(*_pair(F.col("sig"), F.col("x.sig")), F.col("x.l").alias("l")))
    shared = (hot_pairs.unionByName(cold_pairs)
              .groupBy("a", "b").agg(F.count(one).alias("k"), F.first("l").alias("l")).where("k >= l").select("a", "b"))
    rest = written(shared.join(hub_pairs, ["a", "b"], "left_anti"), "join-pairs")
    links = hub_links.unionByName(_verified(docs, rest, reps, size, percent))
    return members, written(links, "join-links", PAIR_ROWS)


def links_per_class(members: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, n_links): for every class with words the number of links it has."""
    ends = links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n_links"))
    return (members.where("n > 0").select("sig").distinct().join(ends, "sig", "left")
            .select("sig", F.coalesce("n_links", F.lit(0)).alias("n_links")))


def _grouped(docs: DataFrame, size: int, percent: int, **params) -> DataFrame:
    """(doc_id, _h, n, root, component_id) for every row with a doc_id; root: the component's class, null without words."""
    members, links = jaccard_links(docs, size, percent, **params)
    roots = connected_components(links)
    least = (members.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
             .join(roots.withColumnRenamed("node", "sig"), "sig", "left"))
    least = least.withColumn("root", F.coalesce("root", "sig"))
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(ids, "root").select("sig", "root", "component_id")
    return (members.join(named, "sig", "left")
            .select("doc_id", "_h", "n", "root", F.coalesce("component_id", "doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, **params) -> DataFrame:
    """One row per document: doc_id, _h, n_shingles, component_id (least doc_id reachable)."""
    found = _grouped(docs, size, percent, **params).select("doc_id", "_h", F.col("n").cast("long").alias("n_shingles"), "component_id")
    ship_package(docs.sparkSession)
    lost = columns_of(docs, "doc_id", "text").where(F.col("doc_id").isNull())
    none = (lost.select("doc_id", "text", row_key().alias("_h")).mapInArrow(_set_task(size, 14), _SETS).where("block is null")
            .select("doc_id", "_h", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
    return found.unionByName(none)


def drop_near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, **params) -> DataFrame:
    """``docs`` with one document of each component (the row of least doc_id, then of least text hash; of equal rows one),
    and every row without words or without a doc_id; columns as they are. Only rows that may go are shuffled."""
    found = (_grouped(docs, size, percent, **params).where("n > 0")
             .groupBy("doc_id", "_h").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("rows")))
    found = written(found, "dedup-found")
    # one doc_id may stand in several components, so a component is told by its root
    named = (found.groupBy("root").agg(F.min(F.struct("doc_id", "_h")).alias("named"))
             .select("named.doc_id", "named._h", F.lit(True).alias("named")))
    go = (found.join(named, ["doc_id", "_h"], "left").withColumn("stays", F.coalesce("named", F.lit(False)))
          .where("not stays or rows > 1").select("doc_id", "_h", "stays"))
    go = written(go, "dedup-go")
    d = packed(docs).drop("text")
    may = maybe_in(go) & F.col("doc_id").isNotNull()
    judged = same_key(d.where(may), go, "left")
    return (d.where(~may).select("_row.*")
            .unionByName(judged.where("stays is null").select("_row.*"))
            .unionByName(judged.where("stays").dropDuplicates(["doc_id", "_h"]).select("_row.*")))
