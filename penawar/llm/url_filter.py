"""URL filter: longest-prefix rules, then a Bloom filter cascade over the corpus's hosts.

A cascade of Bloom filters tells listed keys from all other keys of a known universe without
error: level 0 holds the listed keys; level 1 the unlisted keys that pass level 0; level 2 the
listed keys that pass level 1; and so on until no false positive is left in the universe. A key's
first miss at an even level means unlisted, at an odd level listed; a key that passes all levels
belongs to the kind of the last one.

Filters are arrays of 64-bit words. While all listed keys fit one filter of ``one_filter_keys``
keys, a scalar subquery hands each level to the tasks and pages are judged without a join. Beyond
that the keys are dealt into shards of ``shard_keys`` keys by hash, each with a cascade of its
own, and pages meet the filters of their shard by an equi-join on the shard number.

Urls: null or without "://" have an empty host and path, which is a key like any other. Repeated
rows are judged alike; a null page_id is kept; only page_id and url are read. No rows, no result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penawar.llm.common import columns_of, lower_ascii, written

# fixed values of the contract
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ONE_FILTER_KEYS = 400_000
SHARD_KEYS = 8_000


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: len(x[1])):
        name, slash, rest = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _slots(level: int, hashes: int, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), F.col("key")), F.lit(words * 64)) for j in range(hashes)]


class BloomCascade:
    """The levels of a cascade: (words per shard, hashes, table (shard, words))."""

    def __init__(self, shards: int):
        self.shards = shards
        self.levels: list[tuple[int, int, DataFrame]] = []

    def shard(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), F.col("key")), F.lit(self.shards)).cast("int")

    def _passes(self, words: Column, level: int) -> Column:
        n_words, hashes, _ = self.levels[level]
        return reduce(and_, [F.bit_get(F.get(words, F.shiftright(s, 6).cast("int")), (s % 64).cast("int")) == 1
                             for s in _slots(level, hashes, n_words)])

    def with_level(self, df: DataFrame, level: int, out: str) -> DataFrame:
        """``df`` (with a column key) plus whether the key passes the level."""
        table = self.levels[level][2]
        if self.shards == 1:
            return df.withColumn(out, self._passes(table.agg(F.first("words").alias("w")).scalar(), level))
        table = table.withColumnsRenamed({"shard": "_shard", "words": "_words"})
        return (df.withColumn("_s", self.shard()).join(table, F.col("_s") == F.col("_shard"), "left")
                .withColumn(out, F.coalesce(self._passes(F.col("_words"), level), F.lit(False))).drop("_s", "_shard", "_words"))

    def add_level(self, keys: DataFrame, bits_per_key: int, hashes: int) -> None:
        level = len(self.levels)
        keys = keys.select("key", self.shard().alias("shard"))
        most = keys.groupBy("shard").count().agg(F.max("count").alias("n")).first()["n"]  # one number
        n_words = -(-most * bits_per_key // 64)
        slot = F.explode(F.array(*_slots(level, hashes, n_words)))
        marks = (keys.select("shard", slot.alias("slot"))
                 .select("shard", F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("b"))
                 .groupBy("shard", "w").agg(F.bit_or("b").alias("b")))
        every = marks.select("shard").distinct().withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_words - 1).cast("long"))))
        table = (every.join(marks, ["shard", "w"], "left").groupBy("shard")
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))),
                                  lambda x: x["b"]).alias("words")))
        self.levels.append((n_words, hashes, written(table, f"cascade-{level}")))

    def listed(self, df: DataFrame, out: str = "listed") -> DataFrame:
        """``df`` (with a column key of the universe) plus exact membership."""
        names = [f"_pass{i}" for i in range(len(self.levels))]
        for i, name in enumerate(names):
            df = self.with_level(df, i, name)
        verdict = F.lit(len(names) % 2 == 1)
        for i in reversed(range(len(names))):
            verdict = F.when(~F.col(names[i]), F.lit(i % 2 == 1)).otherwise(verdict)
        return df.withColumn(out, verdict).drop(*names)


def build_cascade(universe: DataFrame, one_filter_keys: int = ONE_FILTER_KEYS, shard_keys: int = SHARD_KEYS,
                  bits_per_key: int = 8, hashes: int = 4) -> BloomCascade:
    """``universe``: (key, listed), one row per key of the corpus, keys not null."""
    universe = universe.select("key", "listed")
    n = universe.where("listed").count()
    cascade = BloomCascade(1 if n <= one_filter_keys else -(-n // shard_keys))
    members, others = universe.where("listed").select("key"), universe.where("not listed").select("key")
    while members.limit(1).count():
        level = len(cascade.levels)
        # a first level of few false positives; the later ones are small
        cascade.add_level(members, bits_per_key if level == 0 else 4, hashes if level == 0 else 3)
        wrong = written(cascade.with_level(others, level, "_p").where("_p").select("key"), f"cascade-false-{level}")
        members, others = wrong, members
    return cascade


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, rule_verdict) by the rules alone."""
    host, path = address(F.col("url"))
    d = columns_of(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return d.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def block_list(pages: DataFrame, rules=RULES) -> DataFrame:
    """(key, listed): every host of the corpus; listed are the hosts that serve a page which a rule blocks."""
    return (judged(pages, rules).groupBy(F.col("host").alias("key"))
            .agg(F.max(F.coalesce(F.col("rule_verdict") == "block", F.lit(False))).alias("listed")))


def filter_urls(pages: DataFrame, rules=RULES, universe: DataFrame | None = None, **params) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed. The verdict is the rule's, else block for the
    listed hosts of ``universe`` (key, listed; by default ``block_list``) and allow for the others. Hosts of ``pages`` that
    a caller's universe lacks join it as unlisted keys, as a cascade is exact over its universe only."""
    keys = block_list(pages, rules)
    if universe is not None:
        hosts = keys.select("key", F.lit(False).alias("listed"))
        known = universe.where(F.col("key").isNotNull()).select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
        keys = known.unionByName(hosts).groupBy("key").agg(F.max("listed").alias("listed"))
    universe = written(keys, "url-keys")
    cascade = build_cascade(universe, **params)
    d = cascade.listed(judged(pages, rules).withColumn("key", F.col("host")))
    return d.select("page_id", "host", "path", "rule",
                    F.coalesce("rule_verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "listed")
