"""Inverted-file index: documents sorted into cells around centroids, queries visit a few cells."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densekit.operators.blocks import Best, check_metric, matrix, numbers, raw_scores
from densekit.operators.knn import Queries, as_docs, as_queries, block_of, knn_exact, ranked, small_table
from densekit.operators.packed import BLOCKS, LOOKUP, Packer, block_batch, code_kind, kind_of, meet, pack_queries, scan, unpack, work_of_key
from densekit.operators.sampling import training_sample
from densekit.session import pin

CENTROIDS = "list_id int, centroid array<double>"
PART_ROWS = 250_000  # documents of a cell that meet its queries in one task, or are written by one
SENT_CELLS = 16_000_000  # most centroid elements sent to every task; more are searched like documents


class Coarse:
    """Centroids in groups around super-cells, about the square root of their number, to find the best few without
    scoring all.

    A vector is scored with the centroids of its best group, then with those of the groups that may hold a better one: the
    triangle inequality (or Cauchy-Schwarz, for inner products) bounds every score in a group by that of the
    group's centre. So the result is that of scoring all, and no more than a group's scores are held at a time.
    """

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, metric: str):
        order = np.argsort(ids)
        self.ids, self.vecs, self.metric = ids[order], vecs[order], metric
        n = max(1, int(len(ids) ** 0.5))
        centers = self.vecs[np.linspace(0, max(0, len(ids) - 1), n).astype(int)] if len(ids) else np.zeros((0, 1))
        for _ in range(5 if len(ids) else 0):
            of = raw_scores(self.vecs, centers, "l2").argmax(axis=1)
            centers = np.stack([self.vecs[of == g].mean(axis=0) if (of == g).any() else c for g, c in enumerate(centers)])
        of = raw_scores(self.vecs, centers, "l2").argmax(axis=1) if len(ids) else np.zeros(0, int)
        self.groups = [np.flatnonzero(of == g) for g in range(len(centers))]
        self.centers = np.stack([c for c, g in zip(centers, self.groups) if len(g)]) if len(ids) else centers
        self.groups = [g for g in self.groups if len(g)]
        self.radius = np.array([np.linalg.norm(self.vecs[g] - c, axis=1).max() for g, c in zip(self.groups, self.centers)])

    def _upper(self, x: np.ndarray) -> np.ndarray:
        """A score that no centroid of the group exceeds, per vector and group."""
        if self.metric == "ip":
            return x @ self.centers.T + np.linalg.norm(x, axis=1)[:, None] * self.radius
        gap = np.sqrt(np.maximum(0, -raw_scores(x, self.centers, "l2")))
        return -np.maximum(gap - self.radius, 0) ** 2

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n best cells of each vector, best first, lower cell on ties; all, if there are fewer."""
        n = min(n, len(self.ids))
        if not len(x) or not n:
            return np.zeros((len(x), n), np.int32)
        best, upper = Best(len(x), n), self._upper(x)
        first = upper.argmax(axis=1)
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(first == g)
            if len(rows):
                best.add(rows, self.ids[members], raw_scores(x[rows], self.vecs[members], self.metric))
        best.settle()
        for g, members in enumerate(self.groups):
            # scores are compared rounded to 6 places, and the bound has an error of its own
            may = upper[:, g] + 2e-6 + 1e-9 * np.abs(upper[:, g]) >= best.floor
            rows = np.flatnonzero(may & (first != g))
            if len(rows):
                best.add(rows, self.ids[members], raw_scores(x[rows], self.vecs[members], self.metric))
        best.settle()
        return best.pid.reshape(len(x), n).astype(np.int32)

    def centroid(self, cell: int) -> np.ndarray:
        return self.vecs[np.searchsorted(self.ids, cell)]


def load_cells(centroids: DataFrame, metric: str) -> Coarse | None:
    """The centroids, if they are known to be small enough for every task; else None."""
    size = centroids.agg(F.sum(F.size("centroid"))).first()[0] or 0
    if size > SENT_CELLS:
        return None
    table = centroids.orderBy("list_id").toArrow()
    return Coarse(numbers(table["list_id"]), matrix(table["centroid"]), metric)


@dataclass
class IvfIndex:
    """An inverted-file index: `centroids(list_id, centroid)` and the documents as packed `blocks` of one cell each."""

    centroids: DataFrame
    blocks: DataFrame
    metric: str = "ip"
    kind: str = "float"  # of the vectors: float or double

    #: code words, in an index that has them
    books = None

    @cached_property
    def cells(self) -> Coarse | None:
        return load_cells(self.centroids, self.metric)

    @property
    def item(self) -> str:
        return "float32" if self.kind == "float" else "float64"

    @property
    def postings(self) -> DataFrame:
        """The documents as rows: `list_id, pid, embedding`."""
        return unpack(self.blocks, self.kind)

    def save(self, path: str) -> None:
        """One folder per cell, so that a search reads only the cells it visits.

        Blocks are dealt by (cell, part): a large cell is written by several tasks, a small one by one task into one file.
        """
        self.centroids.write.parquet(f"{path}/centroids")
        held = pin(self.blocks)
        sizes = held.groupBy("list_id").agg(F.ceil(F.sum("n") / PART_ROWS).cast("int").alias("_n"))
        dealt = held.join(sizes, "list_id").withColumn("_part", block_of("ids", F.col("_n")))
        dealt.repartition("list_id", "_part").drop("_part", "_n").write.partitionBy("list_id").parquet(f"{path}/blocks")

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: str = "ip", kind: str = "float") -> "IvfIndex":
        return cls(
            spark.read.schema(CENTROIDS).parquet(f"{path}/centroids"), spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), check_metric(metric), kind,
        )


def train_centroids(
    docs: DataFrame, nlist: int = 1000, fraction: float = 0.1, seed: int = 1, iterations: int = 10, metric: str = "ip"
) -> DataFrame:
    """Centroids of k-means on a sample of the documents: `list_id, centroid`; by cosine for 'ip', by distance for 'l2'.

    There may be fewer than `nlist`, as empty cells are left out. Zero vectors, which have no
    direction, do not take part in the first.
    """
    spark = docs.sparkSession
    some = training_sample(docs, fraction, seed)
    if metric == "ip":
        some = some.filter(F.exists("embedding", lambda x: x != 0))
    sample = some.select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    ).persist()
    try:
        measure = "cosine" if metric == "ip" else "euclidean"
        model = KMeans(k=nlist, seed=seed, maxIter=iterations, distanceMeasure=measure).fit(sample)
        centers = model.clusterCenters()
    finally:
        sample.unpersist()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, CENTROIDS)


def _given_cells(batch, cells: Coarse | None, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and its centroid of each row, found here or standing in the row."""
    if cells is None:
        return numbers(batch.column("list_id")), matrix(batch.column("centroid"))
    best = cells.nearest(vecs, 1)[:, 0]
    return best, cells.vecs[np.searchsorted(cells.ids, best)]


def located(docs: DataFrame, centroids: DataFrame, cells: Coarse | None, metric: str) -> DataFrame:
    """`pid, embedding`, and where the centroids are too many for every task, the best cell `list_id` and its `centroid`:
    the documents then search the centroids as queries search documents."""
    plain = as_docs(docs)
    if cells is not None:
        return plain
    found = knn_exact(docs, centroids.select(F.col("list_id").alias("id"), F.col("centroid").alias("embedding")), 1, metric, blocks=True)
    of = pin(found.select(F.col("qid").alias("pid"), F.col("pid").cast("int").alias("list_id")))
    return plain.join(of, "pid").join(centroids, "list_id")


def into_blocks(rows: DataFrame, cells: Coarse | None, coded=None, shared=None) -> DataFrame:
    """Located documents as blocks of their cells; no shuffle. `coded(residuals, shared)` gives codes and what they
    stand for; without it the vectors themselves are held."""
    kind = kind_of(rows)
    side = rows.sparkSession.sparkContext.broadcast((cells, shared))

    def run(batches):
        cells, shared = side.value
        packer, centers = Packer(), {}

        def out():
            for cell, ids, far, data in packer.flush():
                yield block_batch(cell, ids, far, data, centers[cell])
            centers.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = matrix(batch.column("embedding"))
            found, center = _given_cells(batch, cells, vecs)
            for cell, at in zip(*np.unique(found, return_index=True)):
                centers[int(cell)] = center[at]
            data = vecs.astype(kind)
            left = data.astype(np.float64) - center
            if coded is not None:
                data, left = coded(left, shared)
            if packer.add(found, numbers(batch.column("pid")), np.linalg.norm(left, axis=1), data):
                yield from out()
        yield from out()

    return rows.mapInArrow(run, BLOCKS)


def ivf_from_centroids(docs: DataFrame, centroids: DataFrame, metric: str = "ip") -> IvfIndex:
    """Every document in its best cell, lower cell on ties."""
    plain = "float" if kind_of(docs) == np.float32 else "double"
    index = IvfIndex(centroids, docs, check_metric(metric), plain)
    index.blocks = into_blocks(located(docs, centroids, index.cells, metric), index.cells)
    return index


def ivf_build(docs: DataFrame, nlist: int = 1000, fraction: float = 0.1, seed: int = 1, metric: str = "ip") -> IvfIndex:
    """Train centroids on a sample and sort all documents into their cells."""
    return ivf_from_centroids(docs, train_centroids(docs, nlist, fraction, seed, metric=check_metric(metric)), metric)


def _visits(q: DataFrame, index: IvfIndex, nprobe: int) -> DataFrame:
    """The queries as blocks of the cells they visit."""
    if index.cells is not None:
        return pack_queries(q, lambda vecs, cells: cells.nearest(vecs, nprobe), index.cells)
    cells = index.centroids.select(F.col("list_id").alias("id"), F.col("centroid").alias("embedding"))
    found = knn_exact(q.withColumnRenamed("qid", "id"), cells, nprobe, index.metric, blocks=True)
    lists = found.groupBy("qid").agg(F.collect_list("pid").alias("_cells"))
    each = q.join(lists, "qid").select("qid", "embedding", F.explode("_cells").cast("int").alias("list_id"))
    return pack_queries(each.repartition("list_id", block_of("qid", F.lit(16))).sortWithinPartitions("list_id"))


def search_cells(queries: DataFrame, index: IvfIndex, k: int, nprobe: int, blocks: bool = False) -> DataFrame:
    """Common search over the blocks of an index."""
    if nprobe < 1:
        raise ValueError("nprobe must be at least 1")
    q = as_queries(queries)
    small = None if blocks or index.cells is None else small_table(q, k)
    if small is not None:
        near = Queries(numbers(small["qid"]), matrix(small["embedding"]))
        visits = index.cells.nearest(near.vecs, nprobe) if len(near.vecs) else np.empty((0, 0), np.int32)
        # the visited cells are known here, so only their folders are read
        wanted = index.blocks.filter(F.col("list_id").isin(np.unique(visits).astype(int).tolist()))
        return ranked(scan(wanted, near._replace(cells=visits), k, index.metric, index.item, index.books), k, index.metric)
    held = pin(index.blocks)
    visits = pin(_visits(q, index, nprobe))
    # a large cell is cut into parts, each of which meets all queries of the cell, and its queries into groups of bounded work
    row = F.sum(F.length("data")) / np.dtype(index.item).itemsize if index.books is None else LOOKUP * F.sum(F.length("data")) / code_kind(index.books).itemsize
    cells = held.groupBy("list_id").agg(F.ceil(F.sum("n") / PART_ROWS).cast("int").alias("_n"), row.alias("_row"))
    asked = visits.groupBy("list_id").agg((F.sum(F.length("ids")) / 8).alias("_q"))
    work = pin(cells.join(asked, "list_id").withColumn("_work", F.col("_row") * F.col("_q")))
    most = work_of_key(held.sparkSession, int(work.agg(F.sum("_work")).first()[0] or 0))
    sizes = work.select("list_id", "_n", F.ceil(F.col("_work") / F.col("_n") / most).cast("int").alias("_m"))
    keys = int(sizes.agg(F.sum(F.col("_n") * F.greatest(F.lit(1), F.col("_m")))).first()[0] or 1)

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - 1)))

    left = visits.join(sizes, "list_id").withColumn("_g", block_of("ids", F.greatest(F.lit(1), F.col("_m")))).withColumn("_p", every("_n"))
    right = held.join(sizes, "list_id").withColumn("_p", block_of("ids", F.col("_n"))).withColumn("_g", every("_m"))
    found = meet(left, right, ["list_id", "_g", "_p"], keys, k, index.metric, index.item, kind_of(q).name, index.books)
    return ranked(found, k, index.metric)


def ivf_search(queries: DataFrame, index: IvfIndex, k: int, nprobe: int = 10, blocks: bool = False) -> DataFrame:
    """Top-k among the documents of the `nprobe` best cells per query; no padding rows.

    Few queries, proven so, are sent to every task; many are packed by the cells they visit and meet the cells' blocks in a join
    (`blocks` does so at any size). A block whose distance from the centroid proves that it cannot enter a query's list is not
    scored for it.
    """
    return search_cells(queries, index, k, nprobe, blocks)
