"""Hard-negative mining from triplets to a new training bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densekit.operators.negatives import hard_negatives
from densekit.operators.prep import subset_by_keys
from densekit.plans.bundles import Bundle, build_bundle
from densekit.plans.retrieval import knn
from densekit.session import pin


def mine_hard_negatives(
    triplets: DataFrame, qrels: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame,
    k: int = 200, method: str = "ivf", **options,
) -> DataFrame:
    """Search with the triplets' queries only, then replace each negative by a harder one."""
    needed = subset_by_keys(query_vecs, triplets.select(F.col("qid").alias("id")), "id")
    run = knn(needed, doc_vecs, k, method, **options)
    if method == "ivfpq":
        run = run.drop("score")  # scored against the codes, not the vectors
    return hard_negatives(triplets, run, qrels, query_vecs, doc_vecs)


def mined_bundle(triplets: DataFrame, qrels: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame, queries: DataFrame, passages: DataFrame, **options) -> Bundle:
    """The mined triplets, written once, with the texts they refer to."""
    mined = mine_hard_negatives(triplets, qrels, query_vecs, doc_vecs, **options)
    return build_bundle(pin(mined.select("qid", "pos_pid", "neg_pid")), queries, passages)
