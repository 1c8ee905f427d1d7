"""Hard-negative mining over Hilbert-ordered candidate blocks with zone maps.

Vectors become integers, floor(256 * x); a score is an integer inner product. An anchor's positives are the best
rows of its label; a positive of score p opens a window of p/2 to 95 p/100, in which the best rows of other labels
are its hard negatives.

* Classes: rows of equal label and vector score alike, so a class keeps its smallest ids only, as many as a result
  can name (positives + 1). Anchors of equal label and vector are searched once.
* Blocks: classes are ordered by (label, Hilbert index of their leading principal components) and written as
  Parquet rows of at most ``block_rows`` classes of one label, with a zone map: least and greatest value per
  dimension. The components and the borders between buckets are fitted on at most ``sample_rows`` rows; they
  only set the order. Every row is in a block, and results don't depend on the fit.
* Interval arithmetic: for an anchor a, every score in a block lies between sum(min(a lo, a hi)) and
  sum(max(a lo, a hi)). A first reading of the most promising blocks gives a score that the k-th best reaches;
  the second reads all blocks whose interval meets what is left: for positives those of the label up to that
  score, for a window those of other labels inside it. Scores are exact (doubles below 2^53, else 64-bit integers).
* Anchors are grouped along the same curve. Groups meet the zone maps in slots of ``slot_blocks`` blocks, and the
  blocks they must read in cells of about ``cell_blocks``, so no task's memory grows with the data. The zone maps
  are 1/64 of the data; every group looks at all of them.

Defined cases: rows with a null id, label or vector, a null or non-finite component, or one of magnitude 2^20 or more
(a score could leave 64 bits) take no part; a shorter vector counts as padded with zeros; equal rows are one; rows of the
anchor's own id are not its positives; a positive of negative score has an empty window. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penawar.llm.common import columns_of, written
from penawar.session import ship_package

POSITIVES, NEGATIVES = 5, 3
BLOCK_ROWS = 128
GROUP_ROWS = 256
BUCKET_ROWS = 8192
SLOT_BLOCKS = 2048
CELL_BLOCKS = 64
SAMPLE_ROWS = 8192
AXES, BITS = 8, 6
SCALE = 256
LARGEST = float(2**20)
SEED = 11


# ---- the Hilbert curve -------------------------------------------------------------------

def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points with integer coordinates below 2^bits, one point a row (after Skilling, 2004)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the sub-cubes
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(up, x[0] ^ (q - 1), x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class Curve:
    """Position of a vector along the curve, and buckets of about equal numbers of rows; fitted on a sample."""

    def __init__(self, labels: np.ndarray, sample: np.ndarray):
        x = sample.astype(np.float64)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(sample.shape[1])
        axes = np.linalg.svd(x - self.mean, full_matrices=False)[2][:AXES] if x.size else np.zeros((0, sample.shape[1]))
        self.axes = axes if len(axes) else np.zeros((1, sample.shape[1]))
        flat = (x - self.mean) @ self.axes.T
        self.low = flat.min(axis=0) if len(flat) else np.zeros(len(self.axes))
        span = (flat.max(axis=0) - self.low) if len(flat) else self.low
        self.step = np.where(span > 0, span, 1.0) / (1 << BITS)
        keys = self.keys(sample) if len(x) else np.empty(0, np.int64)
        order = np.lexsort((keys, labels))
        self.labels, self.sorted_keys = labels[order], keys[order]

    def keys(self, vecs: np.ndarray) -> np.ndarray:
        cells = np.floor(((vecs - self.mean) @ self.axes.T - self.low) / self.step)
        return hilbert_index(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)

    def buckets(self, labels: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` buckets along (label, key): borders at equal shares of the sample."""
        at = np.arange(1, n) * len(self.labels) // max(n, 1)
        out = np.zeros(len(keys), np.int64)
        bl, bk = self.labels[at], self.sorted_keys[at]
        first, last = np.searchsorted(bl, labels, "left"), np.searchsorted(bl, labels, "right")
        for span in {*zip(first.tolist(), last.tolist())}:
            mine = (first == span[0]) & (last == span[1])
            out[mine] = span[0] + np.searchsorted(bk[span[0]:span[1]], keys[mine], "right")
        return out


# ---- vectors, classes, blocks ------------------------------------------------------------

def integer_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec array<int>): rows that take part, each once."""
    d = columns_of(df, id_col, vec_col, label_col).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return (d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & fine)
            .withColumn("vec", F.transform("vec", lambda x: F.floor(x * SCALE).cast("int"))).distinct())


def _matrix(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for row, v in zip(out, column):
        row[:len(v)] = v
    return out


def _pack(x: np.ndarray) -> bytes:
    return x.astype(np.int32).tobytes()


def _unpack(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, dims).astype(np.int64)


def along_curve(df: DataFrame, curve: Curve, dims: int, rows: int, least_rows: int) -> DataFrame:
    """``df`` (label, vec, ...) plus (key, bucket, sub): buckets of about ``least_rows`` rows, in curve order."""
    n = max(1, min(-(-rows // least_rows), len(curve.labels)))
    subs = max(1, -(-rows // (n * 2 * least_rows)))
    shared = df.sparkSession.sparkContext.broadcast(curve)  # bounded by the sample

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo:lo + 4096]
                keys = shared.value.keys(_matrix(part["vec"], dims))
                yield part.assign(key=keys, bucket=shared.value.buckets(part["label"].to_numpy(), keys, n))

    placed = df.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", key long, bucket long")
    return placed.withColumn("sub", F.pmod(F.xxhash64("vec"), F.lit(subs)))


def _cuts(pdf: pd.DataFrame, rows: int):
    """Runs of at most ``rows`` rows of one label, with an id each."""
    pdf = pdf.sort_values(["label", "key"], kind="stable")
    head = (int(pdf["bucket"].iloc[0]) << 40) | (int(pdf["sub"].iloc[0]) << 20)
    no = 0
    for label, mine in pdf.groupby("label", sort=True):
        for lo in range(0, len(mine), rows):
            yield head | no, int(label), mine.iloc[lo:lo + rows]
            no += 1


_BLOCK = "block long, label long, n long, lo binary, hi binary, vecs binary, ids array<long>, counts array<int>"


def _block_task(dims: int, block_rows: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, label, part in _cuts(pdf, block_rows):
            x, ids = _matrix(part["vec"], dims), part["ids"].to_list()
            out.append((block, label, sum(map(len, ids)), _pack(x.min(axis=0)), _pack(x.max(axis=0)), _pack(x), np.concatenate(ids), [len(i) for i in ids]))
        return pd.DataFrame(out, columns=["block", "label", "n", "lo", "hi", "vecs", "ids", "counts"])

    return run


_GROUP = "grp long, label long, names array<string>, anchors binary"


def _group_task(dims: int, group_rows: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(grp, label, part["a"].to_list(), _pack(_matrix(part["vec"], dims))) for grp, label, part in _cuts(pdf, group_rows)],
                            columns=["grp", "label", "names", "anchors"])

    return run


# ---- bounds and reading ------------------------------------------------------------------

def intervals(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each anchor can have in each block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


Chooser = Callable[[pd.Series, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def chosen_blocks(groups: DataFrame, zones: DataFrame, slots: int, dims: int, choose: Chooser) -> DataFrame:
    """(grp, block): what ``choose`` (group row, labels, low, high -> wanted blocks) takes from the zone maps."""
    pairs = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    left = pairs.join(groups, "grp")
    right = pairs.join(zones, "slot").withColumnsRenamed({"grp": "zone_grp", "slot": "zone_slot"})

    def run(g: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(z):
            return pd.DataFrame({"grp": pd.Series([], dtype="int64"), "block": pd.Series([], dtype="int64")})
        low, high = intervals(_unpack(g["anchors"].iloc[0], dims), _unpack(b"".join(z["lo"]), dims), _unpack(b"".join(z["hi"]), dims))
        wanted = choose(g.iloc[0], z["label"].to_numpy(), low, high)
        return pd.DataFrame({"grp": g["grp"].iloc[0], "block": z["block"].to_numpy()[wanted]})

    return left.groupBy("grp", "slot").cogroup(right.groupBy("zone_grp", "zone_slot")).applyInPandas(run, "grp long, block long")


def _top(scores: np.ndarray, ids: np.ndarray, counts: np.ndarray, k: int, ok: np.ndarray):
    """(row, id, score) of the k best ids of every row: score descending, then id. Per class the ids are ascending."""
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    masked = np.where(ok, scores, LOWEST)
    kth = np.partition(masked, -k, axis=1)[:, -k] if masked.shape[1] > k else np.full(len(masked), LOWEST)
    r, c = np.nonzero(ok & (masked >= kth[:, None]))
    order = np.lexsort((ids[first[c]], -scores[r, c], r))
    r, c = r[order], c[order]
    r, c = _heads(r, k, r, c)  # k classes hold the k best ids
    n = counts[c]
    row, cls = np.repeat(r, n), np.repeat(c, n)
    own = ids[first[cls] + np.arange(len(cls)) - np.repeat(np.cumsum(n) - n, n)]
    order = np.lexsort((own, -scores[row, cls], row))
    row, own, cls = row[order], own[order], cls[order]
    row, own, cls = _heads(row, k, row, own, cls)
    return row, own, scores[row, cls]


def _heads(by: np.ndarray, k: int, *cols: np.ndarray):
    """The first k entries of every run of equal ``by``."""
    start = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else np.empty(0, np.int64)
    nth = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return tuple(c[nth < k] for c in cols)


_FOUND = "a string, p long, id long, score long"


def read_blocks(groups: DataFrame, blocks: DataFrame, need: DataFrame, cells: int, dims: int, windows: bool) -> DataFrame:
    """(a, p, id, score): per anchor (and window, named by its positive's score p) the best rows of the blocks it needs."""
    need = need.distinct().withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)))
    right = need.join(blocks.drop("lo", "hi", "n"), "block").withColumnsRenamed({"grp": "block_grp", "cell": "block_cell"})
    left = need.select("grp", "cell").distinct().join(groups.withColumnRenamed("label", "own"), "grp")

    def run(g: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(g) and len(b):
            row = g.iloc[0]
            names, anchors = np.asarray(row["names"], object), _unpack(row["anchors"], dims)
            counts, ids = np.concatenate(b["counts"].to_list()), np.concatenate(b["ids"].to_list())
            labels = np.repeat(b["label"].to_numpy(), [len(c) for c in b["counts"]])
            scores = products(anchors, _unpack(b"".join(b["vecs"]), dims))
            if not windows:
                r, i, s = _top(scores, ids, counts, POSITIVES + 1, np.broadcast_to(labels == row["own"], scores.shape))
                out.append(pd.DataFrame({"a": names[r], "p": 0, "id": i, "score": s}))
            else:
                ps = _windows(row)
                for k in range(ps.shape[1]):
                    low, high, is_open = window_of(ps[:, k])
                    ok = (labels != row["own"])[None, :] & (scores >= low[:, None]) & (scores <= high[:, None]) & is_open[:, None]
                    r, i, s = _top(scores, ids, counts, NEGATIVES, ok)
                    out.append(pd.DataFrame({"a": names[r], "p": ps[r, k], "id": i, "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series([], dtype=object), **{c: pd.Series([], dtype="int64") for c in ("p", "id", "score")}})

    return left.groupBy("grp", "cell").cogroup(right.groupBy("block_grp", "block_cell")).applyInPandas(run, _FOUND)


def window_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest negative score n with 50 p <= 100 n <= 95 p, and whether there can be one."""
    low, high = (p >> 1) + (p & 1), p - (p // 20 + (p % 20 != 0))
    return low, high, (p >= 0) & (low <= high)


WINDOWS = POSITIVES + 1
NO_WINDOW = -1
LOWEST = -(2**63)


def _windows(g) -> np.ndarray:
    """The scores p that open the anchors' windows: a row per anchor."""
    return np.asarray(g["ps"], np.int64).reshape(-1, WINDOWS)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "p").orderBy(F.desc("score"), "id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def _attached(groups: DataFrame, values: DataFrame, name: str, without: Column) -> DataFrame:
    """``groups`` plus an array with the values (an array) of ``values`` (a, name) for its anchors one after the other,
    or ``without``."""
    each = groups.select("grp", F.posexplode("names").alias("pos", "a")).join(values, "a", "left").withColumn(name, F.coalesce(name, without))
    rows = each.groupBy("grp").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", name))), lambda x: x[name])).alias(name))
    return groups.join(rows, "grp")


# ---- choosers ----------------------------------------------------------------------------

def _promising(g, labels, low, high) -> np.ndarray:
    """The two blocks of the label with the greatest bound, per anchor."""
    mine = np.flatnonzero(labels == g["label"])
    if len(mine) <= 2:
        return mine
    return np.unique(mine[np.argpartition(-high[:, mine], 1, axis=1)[:, :2]])


def _reaching(g, labels, low, high) -> np.ndarray:
    """The blocks of the label that may hold a score as high as the one already reached."""
    return np.flatnonzero((labels == g["label"]) & (high >= np.asarray(g["reached"], np.int64)[:, None]).any(axis=0))


def _near_windows(g, labels, low, high) -> np.ndarray:
    """Per window the block of another label whose middle is nearest to the window's top."""
    ps, other = _windows(g), labels != g["label"]
    picked = [np.empty(0, np.int64)]
    middle = (low + high) // 2
    for k in range(ps.shape[1]):
        least, most, is_open = window_of(ps[:, k])
        meets = other[None, :] & (high >= least[:, None]) & (low <= most[:, None]) & is_open[:, None]
        far = np.where(meets, np.abs(middle - most[:, None]), np.iinfo(np.int64).max)
        picked.append(far.argmin(axis=1)[meets.any(axis=1)])
    return np.unique(np.concatenate(picked))


def _meeting(g, labels, low, high) -> np.ndarray:
    """The blocks of other labels whose scores may lie in a window, at least as high as what was found there."""
    ps, other = _windows(g), labels != g["label"]
    reached = np.asarray(g["reached"], np.int64).reshape(-1, WINDOWS)
    wanted = np.zeros(len(labels), bool)
    for k in range(ps.shape[1]):
        least, most, is_open = window_of(ps[:, k])
        least = np.maximum(least, reached[:, k])
        wanted |= (other[None, :] & (high >= least[:, None]) & (low <= most[:, None]) & is_open[:, None]).any(axis=0)
    return np.flatnonzero(wanted)


# ---- the operator ------------------------------------------------------------------------

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, bucket_rows: int = BUCKET_ROWS, slot_blocks: int = SLOT_BLOCKS,
                   cell_blocks: int = CELL_BLOCKS, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` (a condition
    on ``id``) selects."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = written(integer_vectors(vectors, id_col, vec_col, label_col), "negatives-vectors")
    size = v.agg(F.max(F.size("vec")).alias("dims")).first()
    if size["dims"] is None:
        return spark.createDataFrame([], _RESULT)
    dims = max(1, size["dims"])
    smallest = Window.partitionBy("label", "vec").orderBy("id")
    classes = written(v.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= POSITIVES + 1)
                      .groupBy("label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "negatives-classes")
    asked = written(v.where(anchors).withColumn("a", F.md5(F.concat_ws(",", F.col("label").cast("string"), F.array_join("vec", ",")))), "negatives-anchors")

    sample = classes.orderBy(F.xxhash64(F.lit(seed), "vec", "label"), "vec", "label").limit(sample_rows).select("label", "vec").collect()
    curve = Curve(np.array([r.label for r in sample], np.int64), _matrix([r.vec for r in sample], dims))
    n_classes = classes.count()
    placed = along_curve(classes, curve, dims, n_classes, bucket_rows)
    blocks = written(placed.groupBy("bucket", "sub").applyInPandas(_block_task(dims, block_rows), _BLOCK), "negatives-blocks")
    n_blocks = blocks.count()
    slots, cells = max(1, -(-n_blocks // slot_blocks)), max(1, -(-n_blocks // cell_blocks))
    zones = blocks.select("block", "label", "lo", "hi", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"))

    once = asked.select("a", "label", "vec").distinct()
    n_anchors = asked.select("a").distinct().count()
    groups = written(along_curve(once, curve, dims, n_anchors, group_rows).groupBy("bucket", "sub")
                     .applyInPandas(_group_task(dims, group_rows), _GROUP), "negatives-groups")

    def search(groups: DataFrame, choose: Chooser, windows: bool, k: int, name: str) -> DataFrame:
        need = written(chosen_blocks(groups, zones, slots, dims, choose), f"negatives-{name}-need")
        return written(_best(read_blocks(groups, blocks, need, cells, dims, windows), k), f"negatives-{name}")

    first = search(groups, _promising, False, POSITIVES + 1, "first-positives")
    reached = first.where(F.col("r") == POSITIVES + 1).select("a", F.array("score").alias("reached"))
    positives = search(_attached(groups, reached, "reached", F.array(F.lit(LOWEST))), _reaching, False, POSITIVES + 1, "positives").select("a", "id", "score")

    def padded(values: Column, pad: int) -> Column:
        return F.slice(F.concat(values, F.array_repeat(F.lit(pad).cast("long"), WINDOWS)), 1, WINDOWS)

    opened = (positives.where("score >= 0").groupBy("a").agg(F.array_sort(F.collect_set("score")).alias("ps"))
              .withColumn("ps", padded(F.col("ps"), NO_WINDOW)))
    opened = written(opened, "negatives-opened")
    windows = written(_attached(groups, opened, "ps", F.array_repeat(F.lit(NO_WINDOW).cast("long"), WINDOWS)), "negatives-windows")
    first = search(windows, _near_windows, True, NEGATIVES, "first-negatives")
    third = (first.where(F.col("r") == NEGATIVES).groupBy("a")
             .agg(F.map_from_entries(F.collect_list(F.struct("p", "score"))).alias("third")))
    reached = opened.join(third, "a").select("a", F.transform("ps", lambda p: F.coalesce(F.try_element_at("third", p), F.lit(LOWEST))).alias("reached"))
    negatives = search(_attached(windows, reached, "reached", F.array_repeat(F.lit(LOWEST), WINDOWS)), _meeting, True, NEGATIVES, "negatives")

    # every anchor of a class takes the class's positives but itself
    own = (asked.select(F.col("id").alias("anchor_id"), "a").join(positives, "a").where(F.col("id") != F.col("anchor_id"))
           .groupBy("anchor_id", "a", "id").agg(F.max("score").alias("score")))
    best = Window.partitionBy("anchor_id", "a").orderBy(F.desc("score"), "id")
    own = own.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= POSITIVES)
    return (own.select("anchor_id", "a", F.col("id").alias("positive_id"), F.col("score").alias("p"))
            .join(negatives.select("a", "p", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "r"), ["a", "p"])
            .select("anchor_id", "positive_id", F.col("r").cast("int").alias("rank"), "negative_id", F.col("p").alias("positive_score"), "negative_score"))


def mislabelled(vectors: DataFrame) -> DataFrame:
    """The table as the query takes it: where vec_id is divisible by 7 the label becomes (label + 1) % 10."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return columns_of(vectors, "vec_id", "embedding", "label").withColumn("label", wrong)
