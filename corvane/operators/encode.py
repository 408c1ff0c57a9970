"""Text vectors without a model: the default encoder behind dense search.  Any function from a text Column to a vector Column can stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.scores import let
from corvane.functions.text import bm25_tokens

DIMENSIONS = 64


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of a text's tokens by hash bucket, scaled to length one; all zero without a token."""
    buckets = F.transform(bm25_tokens(F.coalesce(text, F.lit(""))), lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % dimensions)
    counts = let(buckets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return let(counts, lambda c: let(F.struct(c.alias("c"), norm(c).alias("n")), lambda s: F.transform(s["c"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0))))


def encode(df: DataFrame, text: str, vector: str = "vector", encoder=hashed_vector) -> DataFrame:
    """Adds a vector of each text.  A model goes here as a pandas UDF; sort by length inside partitions before it, to pad little."""
    return df.withColumn(vector, encoder(F.col(text)))
