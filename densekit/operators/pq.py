"""Product quantisation on top of the inverted file: residuals coded by one code per sub-vector."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densekit.operators.blocks import check_metric, matrix, numbers
from densekit.operators.ivf import CENTROIDS, Coarse, IvfIndex, into_blocks, load_cells, located, search_cells, train_centroids
from densekit.operators.packed import BLOCKS, code_kind, kind_of, unpack
from densekit.operators.sampling import training_sample

FITS_AT_ONCE = 4  # sub-spaces trained side by side
MOST_BITS = 16  # of a code; with the dimension of the vectors this bounds the code books
CODEBOOKS = "m int, code int, subvector array<double>"


@dataclass
class IvfPqIndex(IvfIndex):
    """Blocks that hold `m` codes per document, one or two bytes each, with `codebooks(m, code, subvector)`."""

    codebooks: DataFrame = None

    @cached_property
    def books(self) -> np.ndarray:
        """Code words as an array (m, codes, sub-dimension): 2^nbits times the dimension in all."""
        table = self.codebooks.orderBy("m", "code").toArrow()
        m = int(numbers(table["m"]).max()) + 1
        words = matrix(table["subvector"])
        return words.reshape(m, -1, words.shape[1])

    @property
    def postings(self) -> DataFrame:
        """The documents as rows: `list_id, pid, codes`."""
        return unpack(self.blocks, self.kind, self.books)

    def save(self, path: str) -> None:
        super().save(path)
        self.codebooks.write.parquet(f"{path}/codebooks")

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: str = "ip", kind: str = "float") -> "IvfPqIndex":
        return cls(
            spark.read.schema(CENTROIDS).parquet(f"{path}/centroids"), spark.read.schema(BLOCKS).parquet(f"{path}/blocks"),
            check_metric(metric), kind, spark.read.schema(CODEBOOKS).parquet(f"{path}/codebooks"),
        )


def residuals(docs: DataFrame, centroids: DataFrame, cells: Coarse | None, metric: str) -> DataFrame:
    """`pid, residual`: what is left of each vector after its centroid."""
    rows = located(docs, centroids, cells, metric)
    side = docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        cells = side.value
        for batch in batches:
            if batch.num_rows:
                vecs = matrix(batch.column("embedding"))
                if cells is None:
                    left = vecs - matrix(batch.column("centroid"))
                else:
                    left = vecs - cells.vecs[np.searchsorted(cells.ids, cells.nearest(vecs, 1)[:, 0])]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(left) + 1) * left.shape[1], pa.int32()), pa.array(left.ravel())
                )
                yield pa.RecordBatch.from_arrays([batch.column("pid"), lists], names=["pid", "residual"])

    return rows.mapInArrow(run, "pid bigint, residual array<double>")


def train_codebooks(left: DataFrame, m: int = 8, nbits: int = 8, seed: int = 1, iterations: int = 10) -> DataFrame:
    """`m, code, subvector`: k-means with 2^nbits centres in each of the m sub-spaces.

    Every fit runs on all executors over the cached sample. A sub-space with fewer distinct
    centres than codes repeats its last one, so that all sub-spaces have the same number.
    """
    spark = left.sparkSession
    dim = left.select(F.size("residual")).first()[0]
    if not 1 <= nbits <= MOST_BITS:
        raise ValueError(f"a code has 1 to {MOST_BITS} bits")
    if dim % m:
        raise ValueError(f"dimension {dim} is not divisible by m = {m}")
    sub, codes = dim // m, 2**nbits
    parts = left.select(
        *(array_to_vector(F.slice("residual", i * sub + 1, sub)).alias(f"s{i}") for i in range(m))
    ).persist()

    def fit(i: int) -> list[tuple]:
        model = KMeans(k=codes, seed=seed + i, maxIter=iterations, featuresCol=f"s{i}").fit(parts)
        centers = [[float(x) for x in c] for c in model.clusterCenters()]
        centers += [centers[-1]] * (codes - len(centers))
        return [(i, c, v) for c, v in enumerate(centers)]

    try:
        with ThreadPool(min(m, FITS_AT_ONCE)) as pool:
            rows = [row for book in pool.map(inheritable_thread_target(spark)(fit), range(m)) for row in book]
    finally:
        parts.unpersist()
    return spark.createDataFrame(rows, CODEBOOKS)


def _nearest_codes(left: np.ndarray, books: np.ndarray) -> np.ndarray:
    m, _, sub = books.shape
    out = np.empty((len(left), m), np.int64)
    for i in range(m):
        part = left[:, i * sub : (i + 1) * sub]
        far = (books[i] ** 2).sum(1)[None, :] - 2 * part @ books[i].T
        out[:, i] = np.round(far, 9).argmin(1)  # first, that is lowest, code on ties
    return out


def _coded(left: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and the residuals that these stand for."""
    codes = _nearest_codes(left, books)
    return codes.astype(code_kind(books)), np.concatenate([w[codes[:, i]] for i, w in enumerate(books)], axis=1)


def ivfpq_from_tables(docs: DataFrame, centroids: DataFrame, codebooks: DataFrame, metric: str = "ip") -> IvfPqIndex:
    """Every document in its best cell, as the nearest code word per sub-vector of its residual, lower code on ties."""
    plain = "float" if kind_of(docs) == np.float32 else "double"
    index = IvfPqIndex(centroids, docs, check_metric(metric), plain, codebooks)
    index.blocks = into_blocks(located(docs, centroids, index.cells, metric), index.cells, _coded, index.books)
    return index


def ivfpq_build(
    docs: DataFrame, nlist: int = 1000, m: int = 8, nbits: int = 8, fraction: float = 0.1,
    seed: int = 1, metric: str = "ip",
) -> IvfPqIndex:
    """Cells and code books trained on a sample, all documents coded."""
    centroids = train_centroids(docs, nlist, fraction, seed, metric=check_metric(metric))
    left = residuals(training_sample(docs, fraction, seed), centroids, load_cells(centroids, metric), metric)
    return ivfpq_from_tables(docs, centroids, train_codebooks(left, m, nbits, seed), metric)


def ivfpq_search(queries: DataFrame, index: IvfPqIndex, k: int, nprobe: int = 10, blocks: bool = False) -> DataFrame:
    """Top-k by the exact query against the coded documents of the visited cells, by look-up tables; no code is turned into
    a vector."""
    return search_cells(queries, index, k, nprobe, blocks)


def coding_error(docs: DataFrame, index: IvfPqIndex) -> DataFrame:
    """Mean squared distance between the vectors and what their codes stand for, in one row."""
    books = docs.sparkSession.sparkContext.broadcast(index.books)
    centroids = index.centroids.select("list_id", "centroid")
    coded = index.postings.join(docs.select(F.col("id").alias("pid"), "embedding"), "pid").join(centroids, "list_id")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = matrix(batch.column("codes")).astype(np.int64)
                near = np.concatenate([w[codes[:, i]] for i, w in enumerate(books.value)], axis=1) + matrix(batch.column("centroid"))
                gap = ((near - matrix(batch.column("embedding"))) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(gap)], names=["gap"])

    return coded.mapInArrow(run, "gap double").agg(F.avg("gap").alias("mse"), F.count("*").alias("docs"))
