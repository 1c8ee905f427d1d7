"""Provider calls (E1, E2, E3, E6 on a remote model): a plain callable over a batch of rows.

``call_provider`` runs the callable in Arrow tasks, ``batch`` rows at a time. A batch whose call raises is tried again
row by row, so one bad row never takes its neighbours along: the failing rows get the error text, the others their
answer. Which rows fail depends on the callable alone (E8 turns them into ``error`` results).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penawar.session import ship_package

Provider = Callable[[list], list]


def answers_of(provider: Provider, texts: list) -> tuple[list, list]:
    """(answers, errors) of one call; if it raises, of one call per text, so that a bad text fails alone."""
    try:
        got = list(provider(texts))
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} answers to {len(texts)} texts")
        return got, [None] * len(texts)
    except Exception as e:  # noqa: BLE001 - a failed call must not stop the run
        if len(texts) == 1:
            return [None], [str(e)]
        pairs = [answers_of(provider, [t]) for t in texts]
        return [p[0][0] for p in pairs], [p[1][0] for p in pairs]


def call_provider(df: DataFrame, text_col: str, provider: Provider, out: str = "response", batch: int = 50,
                  out_type: T.DataType = T.StringType()) -> DataFrame:
    """``df`` plus ``out`` (the provider's answer to ``text_col``) and ``error`` (why its call failed, else null)."""
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, out_type), T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo:lo + batch].copy()
                part[out], part["error"] = (pd.Series(x, index=part.index, dtype=object) for x in answers_of(provider, part[text_col].tolist()))
                yield part

    return df.mapInPandas(run, schema)


def error_results(called: DataFrame) -> DataFrame:
    """Rows whose call failed become ``error`` results with the message; the others have no source yet."""
    return called.withColumn("source", F.when(F.col("error").isNotNull(), F.lit("error")))
