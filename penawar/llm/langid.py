"""Language identification of web pages by Bayesian evidence fusion.

Four pieces of evidence are fused as log probabilities per language:

* text: a naive Bayes model over hashed byte n-grams of the page's whole visible text, trained on
  labelled documents. Its log likelihood is divided by the number of n-grams and multiplied by
  ``text_weight`` effective observations at most, as neighbouring n-grams aren't independent.
* declared: the language that the markup states (<html lang=...>), by P(declared | language);
* suffix: the language-like first path segment and the top-level domain, by P(suffix | language);
* host: a prior P(language | host), smoothed towards the registered domain, that towards the
  top-level domain, that towards the whole corpus.

The tables of the last three are soft counts: posteriors of the text alone, summed over all pages
by grouped aggregation, so one host's pages never meet in one task. The pages of a host take their
own posterior out of its counts (leave one out).

Training: documents with a doc_id, lang and text, of each language the ``per_language`` ids of least hash
(a documented bound of each sample); every language that has such rows is trained, 2^BITS numbers each. Pages: a null html has no
text, a null url no host; then the other evidence decides. Texts of any length are read whole.
Repeated rows are judged alike but count; a null page_id is kept. Only the named columns are read.
Without training rows the language is null.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penawar.llm.common import broadcast_if_small, columns_of, written
from penawar.llm.url_filter import address
from penawar.session import ship_package

BITS = 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 500
TEXT_WEIGHT = 30.0
KAPPA = (5.0, 10.0, 50.0)  # pseudo-counts of domain for host, top-level domain for domain, corpus for top-level domain
_INVISIBLE = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_ENTITY = re.compile(r"&[#\w]+;")


def visible_text(html: str | None) -> str:
    return _ENTITY.sub(" ", _INVISIBLE.sub(" ", html or ""))


def ngram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of hashed byte n-grams of the lower-cased text, digits and spaces folded."""
    t = re.sub(r"[\d\W_]+", " ", text.lower())
    b = np.frombuffer(t.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = np.zeros(1 << bits, np.int64)
    for n in ORDERS:
        if len(b) >= n:
            g = np.full(len(b) - n + 1, n, np.uint32)
            for j in range(n):
                g = g * np.uint32(0x01000193) ^ b[j:len(b) - n + 1 + j]
            out += np.bincount((g * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def least_per_key(rows: DataFrame, key: str, count: int, levels=(10, 20)) -> DataFrame:
    """The ``count`` rows of least (h, doc_id) of every ``key``; h is a 64-bit hash.

    Buckets by the leading bits of h are counted first (partial aggregates), and those that begin beyond ``count`` rows go,
    so the last window sorts ``count`` rows and about one bucket of a key, however many rows the key has."""
    for bits in levels:
        rows = rows.withColumn("bucket", F.shiftright("h", 64 - bits))
        before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        kept = (rows.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
                .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < count).select(key, "bucket"))
        rows = rows.join(broadcast_if_small(kept), [key, "bucket"], "left_semi").drop("bucket")
    order = Window.partitionBy(key).orderBy("h", "doc_id")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= count).drop("r")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 5):
    """(languages, log P(n-gram | language) of shape (languages, 2^BITS))."""
    ship_package(docs.sparkSession)
    d = columns_of(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    # the ids first, without the texts
    ids = d.where(F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct().withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    ids = written(least_per_key(written(ids, "lang-ids"), "lang", per_language).drop("h"), "lang-sample")
    sample = (d.join(broadcast_if_small(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang")
              .agg(F.min_by("text", F.xxhash64("text")).alias("text")))

    def count(batches):
        for pdf in batches:
            for name, part in pdf.groupby("lang"):
                total = np.zeros(1 << BITS, np.int64)
                for t in part["text"]:
                    total += ngram_counts(t)
                yield pd.DataFrame({"lang": [name], "counts": [total.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [total.tobytes()]})

    parts = sample.select("lang", "text").repartition(8).mapInPandas(count, "lang string, counts binary")
    rows = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in parts.groupBy("lang").applyInPandas(add, "lang string, counts binary").collect()}
    if not rows:
        return [], np.zeros((0, 1 << BITS))
    langs = sorted(rows)
    table = np.vstack([rows[x] for x in langs]) + 0.5
    return langs, np.log(table) - np.log(table.sum(axis=1, keepdims=True))


def _sum_by(df: DataFrame, keys: list[str], langs: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.get("post", F.lit(i))) for i in range(len(langs))]).alias(name))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    exps = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, y: a + y))


def identify(pages: DataFrame, docs: DataFrame, text_weight: float = TEXT_WEIGHT, kappa=KAPPA, **params) -> DataFrame:
    """One row per page: page_id, lang (the likeliest), p (its posterior), text_lang, declared, suffix, host."""
    spark = pages.sparkSession
    langs, logp = train(docs, **params)
    host, path = address(F.col("url"))
    p = columns_of(pages, "page_id", "url", "html").withColumn("host", host)
    declared = F.nullif(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    segment = F.regexp_extract(path, r"^/([a-z]{2})(?:[/-]|$)", 1)
    p = p.select("page_id", "host", "html", F.coalesce(declared, F.lit("-")).alias("declared"),
                 F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract("host", r"([^.]+)$", 1).alias("tld"),
                 F.concat_ws(" ", F.regexp_extract("host", r"([^.]+)$", 1), segment).alias("suffix"))
    if not langs:
        none = F.lit(None).cast("string")
        return p.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("p"), none.alias("text_lang"), "declared", "suffix", "host")
    shared = spark.sparkContext.broadcast(logp)  # languages x 2^BITS

    @F.pandas_udf("array<double>")
    def likelihood(html: pd.Series) -> pd.Series:
        out = []
        for h in html:
            c = ngram_counts(visible_text(h))
            at = np.flatnonzero(c)
            n = c[at].sum()
            out.append((shared.value[:, at] @ c[at]) / max(n, 1) * min(text_weight * 10, float(n)) / 10)
        return pd.Series(out)

    p = p.withColumn("text", likelihood(F.coalesce("html", F.lit("")))).drop("html")
    p = written(p.withColumn("post", _softmax(F.col("text"))).withColumn("row", F.monotonically_increasing_id()), "lang-text")
    n = len(langs)
    every = [F.get("all", F.lit(i)) for i in range(n)]
    # one row for the corpus; it is one number a language
    total = _sum_by(p, [], langs, "all").select([((x + 1) / 1).alias(str(i)) for i, x in enumerate(every)]).first()
    total = np.array([float(x) if x is not None else 1.0 for x in total])
    prior = total / total.sum()
    lit = lambda a: F.array(*[F.lit(float(x)) for x in a])

    def given(col: str) -> DataFrame:
        """log P(value | language), smoothed by the value's share of the corpus."""
        s = _sum_by(p, [col], langs, "s")
        share = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.lit(float(total.sum()))
        return s.select(F.col(col).alias(f"_{col}"), F.transform(F.arrays_zip("s", lit(total).alias("t")), lambda x: F.log((x["s"] + 2 * share) / (x["t"] + 2))).alias(f"by_{col}"))

    def counts(col: str) -> DataFrame:
        return _sum_by(p, [col], langs, "s").select(F.col(col).alias(f"_{col}"), F.col("s").alias(f"n_{col}"))

    for table, col in ((given("declared"), "declared"), (given("suffix"), "suffix"), (counts("host"), "host"), (counts("domain"), "domain"), (counts("tld"), "tld")):
        p = p.join(table, p[col] == F.col(f"_{col}"), "left").drop(f"_{col}")
    base = lit(prior)
    for col, k in (("tld", kappa[2]), ("domain", kappa[1]), ("host", kappa[0])):
        own = F.transform(F.arrays_zip(F.col(f"n_{col}").alias("s"), F.col("post").alias("mine")), lambda x: F.greatest(x["s"] - x["mine"], F.lit(0.0)))
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        p = p.withColumn("_base", F.transform(F.arrays_zip(own.alias("c"), base.alias("b")), lambda x: (x["c"] + k * x["b"]) / (size + k)))
        base = F.col("_base")
    fused = F.transform(F.arrays_zip("text", "by_declared", "by_suffix", "_base"),
                        lambda x: x["text"] + x["by_declared"] + x["by_suffix"] + F.log(x["_base"]))
    p = p.withColumn("fused", _softmax(fused))
    best = lambda c: F.get(lit_names, (F.array_position(F.col(c), F.array_max(c)) - 1).cast("int"))
    lit_names = F.array(*[F.lit(x) for x in langs])
    return p.select("page_id", best("fused").alias("lang"), F.array_max("fused").alias("p"), best("post").alias("text_lang"), "declared", "suffix", "host")
