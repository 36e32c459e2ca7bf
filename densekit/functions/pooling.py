"""Pooling of token vectors `id, pos, vec, mask` into one vector per id."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_vectors(df: DataFrame, by: str, vec: str, name: str = "embedding") -> DataFrame:
    """Mean vector per key; partial sums are combined before the shuffle."""
    as_vector = array_to_vector(F.col(vec).cast("array<double>"))
    return df.groupBy(by).agg(vector_to_array(Summarizer.mean(as_vector)).alias(name))


def mean_pool(tokens: DataFrame) -> DataFrame:
    """Mean of the unmasked token vectors; an id with no unmasked token pools to zeros."""
    masked = F.transform("vec", lambda x: x.cast("double") * F.col("mask"))
    sums = tokens.groupBy("id").agg(
        vector_to_array(Summarizer.sum(array_to_vector(masked))).alias("total"),
        F.sum("mask").alias("n"),
    )
    return sums.select(
        "id", F.transform("total", lambda x: x / F.greatest("n", F.lit(1e-9))).alias("embedding")
    )


def first_token_pool(tokens: DataFrame) -> DataFrame:
    """The vector at the lowest position."""
    return tokens.groupBy("id").agg(F.min_by("vec", "pos").alias("embedding"))


POOLINGS = {"mean": mean_pool, "cls": first_token_pool}


def pool(tokens: DataFrame, how: str = "mean") -> DataFrame:
    if how not in POOLINGS:
        raise ValueError(f"unknown pooling {how!r}, expected one of {sorted(POOLINGS)}")
    return POOLINGS[how](tokens)
