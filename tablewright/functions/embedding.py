"""Text vectors for recall: hashed character n-grams by built-in functions, or any model as an iterator UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngram_vector(text: Column, n: int = 2, size: int = 64) -> Column:
    """A unit vector of hashed n-gram counts; zeros for texts shorter than n. Stays in the JVM."""
    t = F.coalesce(text, F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(t, i, F.lit(n))), F.lit(size)).cast("int"))
    zero = F.array_repeat(F.lit(0.0), size)
    counts = F.when(F.length(t) < n, zero).otherwise(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(grams, lambda g: g == k)).cast("double")))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(counts, lambda v: F.coalesce(F.try_divide(v, norm), F.lit(0.0)).cast("float"))


def model_vector(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """An iterator UDF around a model that each Python worker loads once."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(embed, "array<float>")
