"""Searching by a chosen index and judging the result."""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densekit.operators.ivf import ivf_build, ivf_search
from densekit.operators.knn import knn_exact
from densekit.operators.metrics import eval_report
from densekit.operators.packed import kind_of
from densekit.operators.pq import ivfpq_build, ivfpq_search
from densekit.session import new_path, pin

METHODS = ("exact", "ivf", "ivfpq")


def build_index(docs: DataFrame, method: str, **options):
    """Index of the documents by method name; an unknown name raises. 'exact' is the table itself."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    return {"exact": lambda d: d, "ivf": ivf_build, "ivfpq": ivfpq_build}[method](docs, **options)


def search(queries: DataFrame, index, method: str, k: int, nprobe: int = 10) -> DataFrame:
    if method == "exact":
        return knn_exact(queries, index, k)
    return {"ivf": ivf_search, "ivfpq": ivfpq_search}[method](queries, index, k, nprobe)


def knn(queries: DataFrame, docs: DataFrame, k: int, method: str = "exact", nprobe: int = 10, **options) -> DataFrame:
    """Top-k documents per query by the named index."""
    return search(queries, build_index(docs, method, **options), method, k, nprobe)


def retrieve_and_evaluate(queries: DataFrame, docs: DataFrame, qrels: DataFrame, k: int = 100, method: str = "exact", **options) -> DataFrame:
    """Search and report in one plan."""
    return eval_report(knn(queries, docs, k, method, **options).select("qid", "pid", "rk"), qrels)


def compare_indexes(
    queries: DataFrame, docs: DataFrame, qrels: DataFrame, k: int = 100, nprobes=(1, 4), nlist: int = 8,
    m: int = 8, nbits: int = 4, fraction: float = 0.3, timed: bool = True, path: str | None = None,
) -> DataFrame:
    """One row per configuration: the evaluation report, overlap with the exact result, seconds per
    query (build not included) and the bytes that the saved index has on disk.

    Each index is built, saved (below `path`) and loaded once, and each result pinned, so that timing and report use the same rows.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "indexes")
    n = queries.count()
    kind = "float" if kind_of(docs) == np.float32 else "double"
    options = {
        "exact": {}, "ivf": {"nlist": nlist, "fraction": fraction},
        "ivfpq": {"nlist": nlist, "fraction": fraction, "m": m, "nbits": nbits},
    }
    rows, exact = [], None
    for method in METHODS:
        index, at = build_index(docs, method, **options[method]), f"{path}/{method}"
        if method == "exact":
            index.write.parquet(at)
            index = spark.read.schema(docs.schema).parquet(at)
        else:
            index.save(at)
            index = type(index).load(spark, at, index.metric, kind)
        size = bytes_on_disk(spark, at)
        for nprobe in (0,) if method == "exact" else nprobes:
            started = time.perf_counter()
            run = pin(search(queries, index, method, k, nprobe).select("qid", "pid", "rk"))
            seconds = (time.perf_counter() - started) / max(1, n)
            exact = run if exact is None else exact
            same = run.join(exact, ["qid", "pid"], "left_semi").agg(F.count("*")).scalar()
            total = exact.agg(F.greatest(F.lit(1), F.count("*"))).scalar()
            rows.append(
                eval_report(run, qrels).select(
                    F.lit(method).alias("method"), F.lit(nprobe).alias("nprobe"), "*",
                    F.round(same / total, 6).alias("overlap"),
                    F.lit(seconds if timed else None).cast("double").alias("seconds_per_query"),
                    size.alias("bytes_on_disk"),
                )
            )
    return reduce(DataFrame.unionByName, rows)


def bytes_on_disk(spark: SparkSession, path: str) -> Column:
    """Bytes of all Parquet files below a path, as a scalar subquery: from file metadata, no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.sum("length")).scalar()
