"""License scan: exact set-similarity join of text blocks with license templates.

Words are lower-cased (A-Z) alphanumeric runs. A template's blocks are all runs of ``block`` words of a document
(``block``: twice the template's words, ``LEAST_BLOCK`` at least; shorter at the end of a text). A block matches when it
holds ``threshold`` of the template's distinct words; the best block counts.

* One pass cuts the texts into words and writes the places of all template words. What follows reads those only.
* Frequency order: the corpus frequency of every template word, counted over all documents.
* Prefix filter: of |T| words, ceil(threshold * |T|) must occur, so one of the |T| - ceil(threshold * |T|) + 1 rarest
  does. Only the surroundings of such places are looked at: a band of ``block`` words and its two neighbours, which hold
  every block over the place. A word that stands beyond the prefix starts nothing.
* Length filter: surroundings with fewer distinct template words than must occur hold no match.
* Positional filter and verification: a block may be taken to start at a template word (moving its start there loses
  none); of the starts in the surroundings, each is counted up to ``block`` words on.

License phrases (the base labels) are found from the same places: their rarest word chooses the documents, then all
words must stand at their offsets. Documents: null text counts as empty; repeated rows repeat their
result; only doc_id and text are read. No rows in, no rows out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penawar.llm.common import alnum_words, columns_of, maybe_in, row_key, same_key, word_hash, written

# fixed values of the contract
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# public license notices: the opening or naming line, then the notice as a whole
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "creative commons attribution share alike 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the rights "
            "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
            "whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
            "permission notice shall be included in all copies or substantial portions of the software the software is provided "
            "as is without warranty of any kind express or implied including but not limited to the warranties of "
            "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
            "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
            "arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
                 "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
                 "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                 "without warranties or conditions of any kind either express or implied see the license for the specific "
                 "language governing permissions and limitations under the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
            "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
            "distribution"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
              "license as published by the free software foundation either version 3 of the license or at your option any later "
              "version this program is distributed in the hope that it will be useful but without any warranty without even the "
              "implied warranty of merchantability or fitness for a particular purpose"),
)
THRESHOLD = 0.8
LEAST_BLOCK = 64


def required(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def block_words(template: str) -> int:
    return max(LEAST_BLOCK, 2 * len(template.split()))


def vocabulary(spark, phrases, templates) -> DataFrame:
    """(word, token) of every word of a phrase or template; a small local table."""
    words = sorted({w for _, t in (*phrases, *templates) for w in t.split()})
    return spark.createDataFrame([(w,) for w in words], "word string").withColumn("token", F.xxhash64("word"))


def places(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, _h, n_words, pos, word): a row for every place of a listed word, and one per document at pos -1."""
    worded = columns_of(docs, "doc_id", "text").select("doc_id", row_key().alias("_h"), alnum_words().alias("words"))
    each = (worded.select("*", F.size("words").alias("n_words"))
            .withColumn("pos", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)))
            .withColumn("token", F.when(F.col("pos") >= 0, word_hash(F.col("words"), F.col("pos")))))
    met = each.join(F.broadcast(listed), "token", "left").where((F.col("pos") < 0) | (F.col("word") == F.get("words", F.col("pos"))))
    return met.select("doc_id", "_h", "n_words", "pos", F.when(F.col("pos") >= 0, F.col("word")).alias("word"))


def _patterns(spark, phrases, templates, threshold: float, freq: DataFrame) -> DataFrame:
    """(no, label, is_base, word, at, need, block, probe): a row per word of a pattern. ``at``: its offset in a phrase,
    its rank in the frequency order of a template; ``probe``: a phrase's rarest word, a template's prefix."""
    rows = [(i, label, True, w, k, len(p.split()), 1) for i, (label, p) in enumerate(phrases) for k, w in enumerate(p.split())]
    rows += [(len(phrases) + i, label, False, w, 0, required(len(set(t.split())), threshold), block_words(t))
             for i, (label, t) in enumerate(templates) for w in sorted(set(t.split()))]
    rows = spark.createDataFrame(rows, "no int, label string, is_base boolean, word string, at int, need int, block int")
    rows = rows.join(F.broadcast(freq), "word", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("no").orderBy("freq", "word", "at")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("no"))
    rows = rows.withColumn("rank", rank).withColumn("size", n)
    probe = F.when(F.col("is_base"), F.col("rank") == 0).otherwise(F.col("size") - F.col("rank") >= F.col("need"))
    return rows.withColumn("probe", probe).withColumn("at", F.when(F.col("is_base"), F.col("at")).otherwise(F.col("rank"))).drop("rank", "freq")


def _keys(df: DataFrame) -> DataFrame:
    return df.select("_h").distinct()


def _phrase_places(met: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, _h, label, is_base, start, score): every place where a phrase's words stand at their offsets."""
    ours = F.broadcast(patterns.where("is_base"))
    probed = written(_keys(met.join(F.broadcast(patterns.where("is_base and probe").select("word").distinct()), "word")), "license-phrase-docs")
    hits = met.where(maybe_in(probed)).join(ours, "word").withColumn("start", F.col("pos") - F.col("at"))
    rows = hits.groupBy("doc_id", "_h", "no", "label", "need", "start").agg(F.count_distinct("at").alias("n")).where("n = need")
    return rows.select("doc_id", "_h", "label", F.lit(True).alias("is_base"), "start", F.lit(1.0).alias("score"))


def _best_block(block: Column) -> Column:
    """Of the hits (pos, word), sorted: the greatest number of distinct words within ``block`` words from a hit on, with the
    negated start, so that the first of equal blocks is the greatest."""
    def held(x: Column) -> Column:
        inside = F.filter("hits", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + block))
        return F.struct(F.size(F.array_distinct(F.transform(inside, lambda y: y["word"]))).alias("n"), (-x["pos"]).alias("start"))

    return F.array_max(F.transform("hits", held))


def _template_places(met: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same for templates: the best block of the surroundings of each prefix place."""
    ours = patterns.where("not is_base")
    band = F.floor(F.col("pos") / F.col("block")).cast("long")
    around = (met.join(F.broadcast(ours.where("probe")), "word").select("doc_id", "_h", "no", band.alias("home")).distinct())
    around = written(around, "license-around")
    hits = met.where(maybe_in(_keys(around))).join(F.broadcast(ours), "word").withColumn("band", band)
    spread = around.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_hh"), F.col("no").alias("_no"), "home",
                           F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1)).alias("_band"))
    near = hits.join(spread, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_hh")) & (F.col("no") == F.col("_no")) & (F.col("band") == F.col("_band")))
    # repeated rows repeat their places: a set per surroundings, of at most three bands of words
    rows = (near.groupBy("doc_id", "_h", "no", "label", "need", "block", "size", "home")
            .agg(F.sort_array(F.collect_set(F.struct("pos", "word"))).alias("hits")))
    rows = rows.where(F.size(F.array_distinct(F.transform("hits", lambda y: y["word"]))) >= F.col("need"))
    rows = rows.withColumn("best", _best_block(F.col("block"))).where(F.col("best.n") >= F.col("need"))
    return rows.select("doc_id", "_h", "label", F.lit(False).alias("is_base"), (-F.col("best.start")).alias("start"),
                       (F.col("best.n") / F.col("size")).alias("score"))


def _scanned(docs: DataFrame, phrases, templates, threshold: float) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    listed = vocabulary(spark, phrases, templates)
    found = written(places(docs, listed), "license-places")
    met = found.where("pos >= 0")
    freq = met.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    patterns = written(_patterns(spark, phrases, templates, threshold, freq), "license-patterns")
    matches = _phrase_places(met, patterns).unionByName(_template_places(met, patterns))
    return found, matches.groupBy("doc_id", "_h", "label", "is_base", "start").agg(F.max("score").alias("score"))


def license_matches(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, _h, label, is_base, start, score): places of phrases, and the best blocks around places of templates."""
    return _scanned(docs, phrases, templates, threshold)[1]


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best
    containment found, 1 for a phrase, 0 for nothing)."""
    base = F.col("is_base")
    found, matches = _scanned(docs, phrases, templates, threshold)
    agg = (matches.groupBy("doc_id", "_h")
           .agg(F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
                F.max(F.when(base, F.col("start"))).alias("last_word"),
                F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
                F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score")))
    return same_key(found.where("pos < 0").select("doc_id", "_h", "n_words"), agg).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
