"""Building training and development bundles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densekit.operators.prep import lookup, referenced_texts, tokenize, triplet_pids
from densekit.operators.sampling import sample_queries
from densekit.session import pin
from densekit.sources.writers import write_bundle, write_run_json, write_tokens


class Bundle(NamedTuple):
    rows: DataFrame  # triplets, or candidates of a development bundle
    queries: DataFrame
    passages: DataFrame


def _texts(ids: DataFrame, collection: DataFrame, strict: bool) -> DataFrame:
    """Texts of distinct ids; with `strict` an id without text raises."""
    ids = ids.distinct()
    return lookup(ids, collection, "id") if strict else referenced_texts(ids, collection)


def build_bundle(triplets: DataFrame, queries: DataFrame, passages: DataFrame, strict: bool = True) -> Bundle:
    """Triplets with the query and passage texts they refer to."""
    qids = triplets.select(F.col("qid").alias("id"))
    pids = triplet_pids(triplets).withColumnRenamed("pid", "id")
    return Bundle(triplets, _texts(qids, queries, strict), _texts(pids, passages, strict))


def build_dev_bundle(
    run: DataFrame, queries: DataFrame, passages: DataFrame, n: int = -1, seed: int = 1, strict: bool = True
) -> Bundle:
    """Candidates of n sampled queries (all if n <= 0) with their texts."""
    kept = pin(sample_queries(run, n, seed))  # drawn once, for all three parts
    qids, pids = (kept.select(F.col(c).alias("id")) for c in ("qid", "pid"))
    return Bundle(kept, _texts(qids, queries, strict), _texts(pids, passages, strict))


def save_bundle(bundle: Bundle, path: str) -> None:
    write_bundle(*bundle, path)


def save_dev_bundle(bundle: Bundle, path: str) -> None:
    write_run_json(bundle.rows, f"{path}/candidates")
    bundle.queries.write.parquet(f"{path}/queries")
    bundle.passages.write.parquet(f"{path}/passages")


def build_token_bundle(triplets: DataFrame, queries: DataFrame, passages: DataFrame, vocabulary: DataFrame, max_len: int | None = 128) -> Bundle:
    """Triplets with token ids, cut to `max_len` words: of all queries, and of the passages that the triplets refer to and no others."""
    pids = triplet_pids(triplets).withColumnRenamed("pid", "id")
    return Bundle(triplets, tokenize(queries, vocabulary, max_len), tokenize(referenced_texts(pids, passages), vocabulary, max_len))


def save_token_bundle(bundle: Bundle, path: str) -> None:
    bundle.rows.write.parquet(f"{path}/triplets")
    write_tokens(bundle.queries, f"{path}/queries")
    write_tokens(bundle.passages, f"{path}/passages")
