"""Own embedders: any function from texts to vectors, with a version that goes with every row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embed = Callable[[list[str]], np.ndarray]
_RESULT = T.StructType([T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("embedding_version", T.StringType())])


def embed(docs: DataFrame, text: str, primary: Embed, version: str, fallback: Embed | None = None, fallback_version: str = "fallback") -> DataFrame:
    """Adds embedding and embedding_version. Where the primary fails, a batch gets the fallback's vectors and the fallback's version."""

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        given, used = texts.fillna("").tolist(), version
        try:
            vectors = primary(given)
        except Exception:
            if fallback is None:
                raise
            vectors, used = fallback(given), fallback_version
        return pd.DataFrame({"embedding": [np.asarray(v, float).tolist() for v in vectors], "embedding_version": used})

    return docs.withColumn("__e", run(text)).select(*docs.columns, "__e.*")
