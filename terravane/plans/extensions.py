"""What a session gets from the library by name: functions for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..operators import extraction


def register(spark: SparkSession, embed=None) -> list[str]:
    """Make tv_embed(text) and tv_symbols(path, language, text) known to SQL; their names.

    embed(list of texts) -> list of vectors is any embedding backend; without one, tv_embed is not registered.
    tv_symbols is a table function: one row for each symbol of a text.
    """
    names = ["tv_symbols"]

    class Symbols:
        def eval(self, path: str, language: str, text: str):
            found = (extraction._python(path, text or "") or [()])[0] if language == "python" else extraction._by_table(path, text or "", extraction._rules(language or ""))
            yield from found

    spark.udtf.register("tv_symbols", F.udtf(Symbols, returnType=extraction.SYMBOL))
    if embed is not None:

        @F.pandas_udf(ArrayType(DoubleType()))
        def vectors(texts: pd.Series) -> pd.Series:
            # alike lengths together, so that a model pads little
            order = texts.fillna("").str.len().argsort(kind="stable")
            got = embed(texts.fillna("").iloc[order].tolist())
            return pd.Series([[float(x) for x in v] for v in got], index=texts.index[order]).reindex(texts.index)

        spark.udf.register("tv_embed", vectors)
        names.append("tv_embed")
    return names
