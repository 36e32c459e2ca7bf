"""Grouping queries into topics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densekit.operators.blocks import matrix, numbers, round_half_up
from densekit.operators.prep import SLICE_ROWS, list_slices, lookup, one_per_key
from densekit.operators.ranking import preview
from densekit.operators.sampling import training_sample

NOISE = -1
MAX_CENTERS = 10_000


def _features(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def reduce_dimensions(embeddings: DataFrame, dims: int = 5) -> DataFrame:
    """`id, embedding` projected on the first principal components."""
    vecs = _features(embeddings)
    model = PCA(k=dims, inputCol="features", outputCol="reduced").fit(vecs)
    return model.transform(vecs).select("id", vector_to_array("reduced").alias("embedding"))


def mark_noise(assigned: DataFrame, min_size: int = 30, max_dist: float | None = None) -> DataFrame:
    """`qid, label` from `qid, label, dist`: far points, then members of small clusters, become -1.

    A cluster's size is that left after the far points are gone.
    """
    near = assigned if max_dist is None else assigned.withColumn(
        "label", F.when(F.col("dist") <= max_dist, F.col("label")).otherwise(NOISE)
    )
    sizes = one_per_key(near, ["label"], F.count("*").alias("_size"))
    kept = F.when((F.col("label") != NOISE) & (F.col("_size") >= min_size), F.col("label"))
    return near.join(sizes, "label").select("qid", F.coalesce(kept, F.lit(NOISE)).alias("label"))


def assign_clusters(embeddings: DataFrame, centers: DataFrame) -> DataFrame:
    """Nearest of the given centres `label, center`: `qid, label, dist`, lower label on ties.

    The centres are sent to every task, once their number is known to be small.
    """
    table = centers.limit(MAX_CENTERS + 1).toArrow().sort_by("label")
    if table.num_rows > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centres")
    side = embeddings.sparkSession.sparkContext.broadcast((numbers(table["label"]), matrix(table["center"])))

    def run(batches):
        labels, points = side.value
        for batch in batches:
            if batch.num_rows:
                vecs = matrix(batch.column("embedding"))
                far = round_half_up(np.stack([np.linalg.norm(vecs - c, axis=1) for c in points], axis=1))
                best = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(labels[best], pa.int32()), pa.array(far[np.arange(len(best)), best])],
                    names=["qid", "label", "dist"],
                )

    return embeddings.select("id", "embedding").mapInArrow(run, "qid bigint, label int, dist double")


def cluster(
    embeddings: DataFrame, k: int, min_size: int = 30, max_dist: float | None = None, seed: int = 1, fraction: float = 1.0
) -> DataFrame:
    """`qid, label`: k-means clusters, with -1 for points beyond `max_dist` and for small clusters.

    The centres are fitted on a fraction of the queries; all queries are then assigned.
    """
    sample = embeddings if fraction >= 1 else training_sample(embeddings, fraction, seed)
    vecs = _features(sample).persist()
    try:
        model = KMeans(k=k, seed=seed).fit(vecs)
    finally:
        vecs.unpersist()
    centers = embeddings.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "label int, center array<double>"
    )
    return mark_noise(assign_clusters(embeddings, centers), min_size, max_dist)


def members_only(labels: DataFrame, legacy: bool = False) -> DataFrame:
    """Rows of real clusters; `legacy` leaves out cluster 0 with the noise."""
    return labels.filter(F.col("label") > (0 if legacy else NOISE))


def cluster_members(labels: DataFrame, legacy: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """`label, start, values`: the queries of each cluster as sorted lists."""
    return list_slices(members_only(labels, legacy), "label", "qid", slice_rows)


def split_noise(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, noise)."""
    return members_only(labels), labels.filter(F.col("label") == NOISE)


def cluster_preview(labels: DataFrame, texts: DataFrame, wanted: list[int] | None = None, n: int = 3) -> DataFrame:
    """`label, place, qid, text`: the first n queries of the wanted clusters, by id."""
    chosen = members_only(labels) if wanted is None else labels.filter(F.col("label").isin(wanted))
    first = preview(chosen, "label", "qid", n)
    text = texts.select(F.col("id").alias("qid"), "text")
    return lookup(first, text, "qid").select("label", "place", "qid", "text")
