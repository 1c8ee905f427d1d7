"""Embeddings of catalog rows.

A provider is a plain callable ``list[str] -> list[list[float]]`` called with at
most ``embed_batch`` texts at a time inside ``mapInPandas`` (one Arrow batch per
call group); results are keyed by id, so the order of the reply never matters.
A failing call leaves its rows without a vector (``error`` set): they keep their
old value and the next backfill picks them up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penawar.config import DEFAULT, MatchConfig
from penawar.functions.text import embedding_text
from penawar.operators.providers import call_provider

Provider = Callable[[list], list]

def hashed_trigram_provider(dim: int) -> Provider:
    """Offline stand-in model: unit vector of hashed character trigrams."""

    def embed(texts: list) -> list:
        import xxhash

        from penawar.functions.similarity import trigram_seq

        out = []
        for t in texts:
            v = np.zeros(dim, dtype=np.float64)
            for g in trigram_seq(t):
                h = xxhash.xxh64_intdigest(g)
                v[h % dim] += 1.0 if (h >> 32) & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out

    return embed


def embedding_todo(catalog: DataFrame, all_rows: bool = False) -> DataFrame:
    """Rows needing a vector — null ones only, or all; with the text to embed."""
    c = catalog if all_rows else catalog.where(F.col("embedding").isNull())
    return c.select("id", embedding_text("name", "brand", "category").alias("text"))


VECTOR = T.ArrayType(T.FloatType())


def embed_texts(todo: DataFrame, provider: Provider, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """(id, text) -> (id, new_embedding, error), ``embed_batch`` texts per call; a failed call is tried again text
    by text, so one bad text leaves its neighbours their vectors."""
    return (call_provider(todo.select("id", "text"), "text", provider, "new_embedding", cfg.embed_batch, VECTOR)
            .select(F.col("id").cast("long").alias("id"), "new_embedding", "error"))


def embed_queries(texts: DataFrame, provider: Provider, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """(qvec_id, text) -> (qvec_id, qvec, error). A text whose call failed has no vector, so its search keeps the
    trigram ranks alone."""
    return call_provider(texts, "text", provider, "qvec", cfg.embed_batch, VECTOR).select("qvec_id", "qvec", "error")


def apply_embeddings(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Write vectors back by id; rows whose call failed keep their old value."""
    ok = new.where(F.col("error").isNull()).select("id", "new_embedding")
    j = catalog.join(ok, "id", "left")
    return j.withColumn("embedding", F.coalesce("new_embedding", "embedding")).drop("new_embedding")


def reembed_worklist(snapshot: DataFrame) -> DataFrame:
    """C4: created rows and rows whose name, brand or category was sent."""
    return snapshot.where(F.col("reembed")).select("id", embedding_text("name", "brand", "category").alias("text"))
