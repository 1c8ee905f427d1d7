"""Benchmark decontamination: prefix-filtered set join of documents with benchmark windows.

An item's windows are its runs of ``window`` words (an item of fewer words is one window); a
document contains a window when all its shingles stand there in order. Shingles are ``gram``
words (fewer for an item of fewer).

* Matches: every document is split once; its shingles that occur in the benchmark are written.
* Rarity order: the corpus frequency of every benchmark shingle, counted over all documents.
* Prefix: containment must be whole, so a single shingle is the necessary prefix: each window's
  rarest. Windows with a shingle that never occurs are gone. Neighbouring windows share a prefix.
* Join: the matches meet prefix shingles; the offsets fix where a window would start.
* Positional and length bounds: that start must lie in the document, with room for the window.
* Verification: the document's words there equal the window's; only documents with a candidate
  are read again.

The benchmark is the small side: it is broadcast behind a check of its rows, else shuffled.
Documents: a null text has no words; rows that repeat a doc_id and text repeat their result.
Items: null or wordless texts have no windows; a null item_id is ignored in the list of ids.
Empty tables give empty hits. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penawar.llm.common import alnum_words, broadcast_if_small, columns_of, maybe_in, packed, row_key, same_key, word_hash, written

WINDOW = 13
GRAM = 3


# the token of the row that every document has beside its shingles; those of shingles are even
_WHOLE = -1


def _token(words: Column, at: Column, n: int) -> Column:
    return word_hash(words, at, n).bitwiseAND(F.lit(-2).cast("long"))


def _shingle(words: str, at: str, gram: int) -> Column:
    """Hash of a shingle of 1 to ``gram`` words, by the row's column gram."""
    out = _token(F.col(words), F.col(at), gram)
    for g in range(1, gram):
        out = F.when(F.col("gram") == g, _token(F.col(words), F.col(at), g)).otherwise(out)
    return out


def item_shingles(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(item_id, item, n_item, length, gram, q, token, low, near): each shingle of each distinct item and its place q.

    A row carries the words of the windows that hold its shingle alone (``near``, from word ``low`` on), so the rows of an
    item grow in proportion to its length."""
    it = (columns_of(items, "item_id", "text").select("item_id", alnum_words().alias("words")).distinct()
          .where(F.size("words") > 0)
          .withColumn("item", F.xxhash64("item_id", "words"))
          .withColumn("length", F.least(F.lit(window), F.size("words")))
          .withColumn("gram", F.least(F.lit(gram), F.col("length"))))
    it = it.withColumn("q", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("gram"))))
    span = F.col("length") - F.col("gram")
    it = it.withColumn("low", F.greatest(F.lit(0), F.col("q") - span))
    return it.select("item_id", "item", F.size("words").alias("n_item"), "length", "gram", "q", _shingle("words", "q", gram).alias("token"),
                     "low", F.slice("words", F.col("low") + 1, F.col("q") + F.col("length") - F.col("low")).alias("near"))


def matched_shingles(docs: DataFrame, tokens: DataFrame, grams: list[int]) -> DataFrame:
    """(doc_id, _h, n_words, p, gram, token): a document's shingles that are listed in ``tokens`` (gram, token), and one
    row with p = -1 for itself. Every text is split once, and its shingles meet the list in the same stage."""
    worded = columns_of(docs, "doc_id", "text").select("doc_id", row_key().alias("_h"), alnum_words().alias("words"))
    spark = docs.sparkSession
    listed = tokens.unionByName(spark.createDataFrame([(grams[0], _WHOLE)], "gram int, token long"))
    listed = broadcast_if_small(listed)
    out = None
    for g in grams:
        first = F.lit(-1 if g == grams[0] else 0)
        one = (worded.where((F.size("words") >= g) | (first == -1))
               .withColumn("p", F.explode(F.sequence(first, F.greatest(first, F.size("words") - g))))
               .withColumn("gram", F.lit(g))
               .withColumn("token", F.when(F.col("p") < 0, F.lit(_WHOLE).cast("long")).otherwise(_token(F.col("words"), F.col("p"), g)))
               .join(listed, ["gram", "token"])
               .select("doc_id", "_h", F.size("words").alias("n_words"), "p", "gram", "token"))
        out = one if out is None else out.unionByName(one)
    return out.where((F.col("p") >= 0) == (F.col("token") != _WHOLE))


def _matches(docs: DataFrame, items: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(item shingles, matched shingles), both written."""
    shingles = written(item_shingles(items, window, gram), "benchmark-shingles")
    # at most `gram` different sizes
    grams = sorted(r[0] for r in shingles.select("gram").distinct().collect()) or [gram]
    tokens = shingles.select("gram", "token").distinct()
    return shingles, written(matched_shingles(docs, tokens, grams), "benchmark-matches")


def prefixes(shingles: DataFrame, matches: DataFrame) -> DataFrame:
    """(item, item_id, low, near, length, gram, token, q, starts): the rarest shingle of each window, with the windows
    that share it. Its order is the corpus frequency, counted over all documents."""
    freq = matches.where("p >= 0").groupBy("gram", "token").agg(F.count(F.lit(1)).alias("freq"))
    ranked = shingles.join(freq, ["gram", "token"])  # a shingle that no document has is gone, and its windows below
    # each window s: its shingles q in s .. s + length - gram; the prefix is the rarest
    s = F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - (F.col("length") - F.col("gram"))),
                             F.least(F.col("q"), F.col("n_item") - F.col("length"))))
    per_window = Window.partitionBy("item", "s").orderBy("freq", "token", "q")
    return (ranked.withColumn("s", s)
            .withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("item", "s")))
            .withColumn("r", F.row_number().over(per_window))
            .where((F.col("r") == 1) & (F.col("known") == F.col("length") - F.col("gram") + 1))
            .groupBy("item", "item_id", "low", "near", "length", "gram", "token", "q").agg(F.collect_list("s").alias("starts")))


def _verified(docs: DataFrame, shingles: DataFrame, matches: DataFrame) -> DataFrame:
    prefix = broadcast_if_small(written(prefixes(shingles, matches), "benchmark-prefix"))
    cand = (matches.where("p >= 0").join(prefix, ["gram", "token"])
            .withColumn("s", F.explode("starts")).withColumn("start", F.col("p") - F.col("q") + F.col("s"))
            .where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
            .select("doc_id", "_h", "item_id", "start", "length", F.slice("near", F.col("s") - F.col("low") + 1, F.col("length")).alias("wanted"))
            .distinct())
    cand = written(cand, "benchmark-candidates")
    # the words themselves: only documents with a candidate are read again
    worded = columns_of(docs, "doc_id", "text").withColumn("_h", row_key()).where(maybe_in(cand))
    worded = worded.select("doc_id", "_h", alnum_words().alias("words")).distinct()
    same = same_key(cand, worded, "inner").where(F.slice("words", F.col("start") + 1, F.col("length")) == F.col("wanted"))
    return same.select("doc_id", "_h", "item_id", "start", "length").distinct()


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, _h, item_id, start, length): every place where a window of an item stands, once per distinct row."""
    shingles, matches = _matches(docs, items, window, gram)
    return _verified(docs, shingles, matches)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  share_of: int = 20) -> DataFrame:
    """One row per document: doc_id, _h, n_words, n_hit, items (sorted ids), contaminated (n_hit > 0 and at least one
    word in ``share_of`` hit)."""
    shingles, matches = _matches(docs, items, window, gram)
    occ = written(_verified(docs, shingles, matches), "benchmark-occurrences")
    # words under the union of a document's windows: each window adds what lies beyond those before it
    order = Window.partitionBy("doc_id", "_h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    per_place = occ.groupBy("doc_id", "_h", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    hit = (per_place.withColumn("seen", F.coalesce(F.max("end").over(order), F.lit(0)))
           .groupBy("doc_id", "_h")
           .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).cast("long").alias("n_hit")))
    ids = occ.groupBy("doc_id", "_h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    d = matches.where("p = -1").select("doc_id", "_h", F.col("n_words").cast("long").alias("n_words"))
    d = same_key(same_key(d, hit), ids)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return d.select("doc_id", "_h", "n_words", n_hit.alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    ((n_hit > 0) & (n_hit * share_of >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """``docs`` without the contaminated ones, columns as they are."""
    bad = written(contamination(docs, items, **params).where("contaminated").select("doc_id", "_h").distinct(), "contaminated")
    d, may = packed(docs).drop("text"), maybe_in(bad)
    return (d.where(~may).select("_row.*")  # no shuffle for these
            .unionByName(same_key(d.where(may), bad, "left_anti").select("_row.*")))
