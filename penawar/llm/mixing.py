"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

1. Sizes: words per document, summed per source (grouped aggregation).
2. Targets: every source's share by weight, capped at ``max_passes`` times its size; the
   excess is shared again by weight until no source is above its cap (``targets``).
3. Blocks: documents of a source are dealt into shards of about ``shard_words`` words by a
   seeded hash, so the shards of a hot source are many. In a shard the documents follow each
   other in seeded order and the word stream is cut into blocks of ``block_words`` words.
4. Quotas: the blocks of the whole mix are allocated to sources, then those of a source to its
   shards, by the highest quotients votes / (2k + 1) (``apportion``): integer quotas.
5. Selection: a quota of q over n blocks takes every block q div n times and, once more, the
   q mod n blocks of least seeded hash. A document takes the words its blocks cover.

Only equal rows tie in the seeded order, so reruns agree. Nulls: a null text has size 0; a null source is a source of its own, sorted last; a null
doc_id is kept. Repeated rows are documents of their own. Empty input gives an empty result.
Only doc_id, text and source are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penawar.llm.common import SPACED_WORD, columns_of, whole, written

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3


def sized(docs: DataFrame) -> DataFrame:
    return columns_of(docs, "doc_id", "text", "source").select(
        "doc_id", "source", F.regexp_count(whole(), F.lit(SPACED_WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("_text_hash"))


def targets(sources: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size) -> + target: weighted shares of all words with caps.

    With the sources sorted by cap / weight, the capped ones come first: source j is the first
    that keeps its weighted share of what the capped ones before it leave. One row per source."""
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * max_passes).cast("double")
    s = sources.withColumn("weight", w).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the level holds from the first source whose share is within its cap
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("source", "source_size",
                    F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
                    .alias("target"))


def apportion(parties: DataFrame, votes: str, seats: str, by: list[str], tie: list[Column]) -> DataFrame:
    """Sainte-Lague: ``seats`` of each group ``by`` go to the highest quotients votes / (2k + 1).

    A party holds k seats at a divisor d when votes / d >= k - 1/2. At d = votes / (seats + n/2)
    the n parties hold at least all seats, at d = votes / (seats - n/2) at most all, and the two
    differ by about n seats: only those in between are ranked, never one row per seat."""
    group = Window.partitionBy(*by)
    p = (parties.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_v", F.sum(votes).over(group))
         .where((F.col("_v") > 0) & (F.col(seats) > 0)))

    def held(d: Column) -> Column:
        return F.when(d > 0, F.floor(F.col(votes) * d / F.col("_v") + 0.5)).otherwise(F.lit(0)).cast("long")

    p = (p.withColumn("_low", held(F.col(seats) - F.col("_n") / 2 - 0.01))
         .withColumn("_high", held(F.col(seats) + F.col("_n") / 2 + 0.01))
         .withColumn("_left", F.col(seats) - F.sum("_low").over(group)))
    cand = (p.where(F.col("_high") > F.col("_low"))
            .withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
            .withColumn("_rank", F.row_number().over(group.orderBy(
                F.desc(F.col(votes) / (2 * F.col("_k") - 1)), *tie, F.col("_k")))))
    more = cand.groupBy("_party").agg(F.sum((F.col("_rank") <= F.col("_left")).cast("long")).alias("_more"))
    return (parties.join(p.select("_party", "_low"), "_party", "left").join(more, "_party", "left")
            .withColumn("quota", F.coalesce(F.col("_low"), F.lit(0)) + F.coalesce(F.col("_more"), F.lit(0)))
            .drop("_low", "_more"))


def mix(docs: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES, share: float = 1.0,
        block_words: int = 64, shard_words: int = 250_000, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    d = written(sized(docs).withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    sources = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sources, weights, max_passes)
    if share != 1.0:
        t = t.withColumn("target", F.col("target") * share)
    t = (t.withColumn("_shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words))
         .withColumn("_src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    t = written(t, "mix-targets")  # one row per source

    # integer quotas: sources first, then the shards of each
    seats = t.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    seats = seats.withColumn("_all", F.lit(0)).withColumn("_party", F.col("_src").cast("string"))
    src_quota = apportion(seats, "target", "_seats", ["_all"], [F.col("_src")]).select("_src", F.col("quota").alias("_src_quota"))
    named = t.withColumnRenamed("source", "_source")
    d = (d.join(F.broadcast(named) if named.count() <= 100_000 else named, d["source"].eqNullSafe(named["_source"])).drop("_source")
         .withColumn("_hash", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_text_hash")))
         .withColumn("_shard", F.pmod(F.col("_hash"), F.col("_shards"))))
    shards = d.groupBy("_src", "_shard").agg(F.sum("size").alias("_words"))
    shards = (shards.join(src_quota, "_src", "left")
              .withColumn("_party", F.concat_ws(":", "_src", "_shard")))
    quotas = apportion(shards, "_words", "_src_quota", ["_src"], [F.col("_shard")])
    # a quota can't pass over its blocks more than max_passes times
    quotas = (quotas.withColumn("_blocks", F.ceil(F.col("_words") / block_words))
              .withColumn("quota", F.least("quota", F.col("_blocks") * max_passes))
              .where(F.col("_blocks") > 0)
              .select("_src", "_shard", "_blocks", (F.col("quota") / F.col("_blocks")).cast("long").alias("_passes"),
                      (F.col("quota") % F.col("_blocks")).alias("_once")))
    quotas = written(quotas, "mix-quotas")

    # seeded block selection: the _once blocks of least hash in each shard
    in_shard = Window.partitionBy("_src", "_shard")
    picked = (quotas.where(F.col("_once") > 0)
              .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
              .withColumn("_rank", F.row_number().over(in_shard.orderBy(
                  F.xxhash64(F.lit(seed), F.lit("block"), "_src", "_shard", "_block"), "_block")))
              .where(F.col("_rank") <= F.col("_once"))
              .select("_src", "_shard", "_block", F.lit(1).alias("_hit")))

    end = F.sum("size").over(in_shard.orderBy("_hash", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("size"))
    pieces = (d.where(F.col("size") > 0)
              .withColumn("_block", F.explode(F.sequence((F.col("_start") / block_words).cast("long"),
                                                         ((F.col("_end") - 1) / block_words).cast("long"))))
              .select("_row", "_src", "_shard", "_block",
                      (F.least(F.col("_end"), (F.col("_block") + 1) * block_words)
                       - F.greatest(F.col("_start"), F.col("_block") * block_words)).alias("_w")))
    # hints: the sizes of exploded rows are unknown to the planner, and both sides grow with the input
    extra = (pieces.hint("merge").join(picked.hint("merge"), ["_src", "_shard", "_block"])
             .groupBy("_row").agg(F.sum("_w").alias("_extra")))
    return (d.select("_row", "doc_id", "source", "size", "source_size", "target", "_src", "_shard")
            .join(quotas.select("_src", "_shard", "_passes"), ["_src", "_shard"], "left")
            .join(extra.hint("merge"), "_row", "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("size") * F.coalesce(F.col("_passes"), F.lit(0)) + F.coalesce(F.col("_extra"), F.lit(0)))
                    .cast("long").alias("taken")))
