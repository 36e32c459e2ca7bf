"""Nearest neighbours: scanning documents past a set of queries, or joining blocks of both if these are many."""

from __future__ import annotations

from typing import Callable, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densekit.operators.blocks import Best, check_metric, matrix, numbers
from densekit.operators.packed import kind_of, meet, pack, pack_queries, work_of_key
from densekit.operators.ranking import topk
from densekit.schemas import SCORED
from densekit.session import pin

BROADCAST_ROWS = 20_000  # most queries sent to every task ...
BROADCAST_CELLS = 8_000_000  # ... and most of their vector elements, and of results held per task
GROUP_RESULTS = 4_000_000  # results of the queries of a group
PART_BYTES = 64 << 20  # of the vectors of a part of the documents
RESULT_BYTES = 192  # bytes of blocks that take as long as a row of results, which is sorted and sent by itself
FLOOR_SHARE = 8  # one block in so many is searched for floors


class Queries(NamedTuple):
    """Small query side held by every task: ids, vectors and, for an index, the cells to visit."""

    qids: np.ndarray
    vecs: np.ndarray
    cells: np.ndarray | None = None  # queries x nprobe


def small_table(df: DataFrame, k: int, dim_col: str = "embedding") -> pa.Table | None:
    """The rows, if proven few enough to send to every task; else None.

    Rows and elements are counted first, in the tasks; only a table within both bounds is fetched.
    """
    few = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum(F.size(dim_col)).alias("cells")).first()
    if few.n > BROADCAST_ROWS or max(few.cells or 0, few.n * k) > BROADCAST_CELLS:
        return None
    return df.toArrow()


def scan(docs: DataFrame, small: Queries, k: int, metric: str) -> DataFrame:
    """Each task runs its documents past all queries and emits at most k rows per query.

    The documents are not shuffled; a few large tasks per core keep the emitted rows down.
    """
    spark = docs.sparkSession
    side = spark.sparkContext.broadcast(tuple(small))
    # the second bound holds where executors are still to come
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        qids, q, _ = side.value
        best, every = Best(len(qids), k), np.arange(len(qids))
        for batch in batches:
            if batch.num_rows and len(qids):
                best.add_tiled(every, q, numbers(batch.column("pid")), matrix(batch.column("embedding")), metric)
        yield from best.batches(qids)

    return docs.coalesce(tasks).mapInArrow(run, SCORED)


def block_of(id_col: str, blocks) -> F.Column:
    return F.pmod(F.xxhash64(id_col), blocks).cast("int")


def as_queries(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("qid"), "embedding")


def as_docs(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("pid"), "embedding")


def ranked(partial: DataFrame, k: int, metric: str) -> DataFrame:
    """Final top-k per query over the tasks' results: `qid, pid, rk, score`."""
    out = topk(partial, k)
    if metric == "l2":
        out = out.withColumn("score", 0 - F.col("score"))  # reported as a distance
    return out.select("qid", "pid", "rk", "score")


def knn_exact(queries: DataFrame, docs: DataFrame, k: int, metric: str = "ip", blocks: bool = False) -> DataFrame:
    """Exact top-k documents per query, `qid, pid, rk, score`.

    Inner product descending ('ip') or squared distance ascending ('l2'), lower pid on ties. Few
    queries, proven so, are sent to every task and the documents scanned in place; many meet them block by block in
    a join. `blocks` takes the second way at any size.
    """
    check_metric(metric)
    q, d = as_queries(queries), as_docs(docs)
    small = None if blocks else small_table(q, k)
    if small is None:
        return ranked(knn_blocks(q, d, k, metric), k, metric)
    near = Queries(numbers(small["qid"]), matrix(small["embedding"]))
    return ranked(scan(d, near, k, metric), k, metric)


def knn_blocks(q: DataFrame, d: DataFrame, k: int, metric: str) -> DataFrame:
    """`qid, pid, score`: at most k rows per query and part of the documents, the k best overall among them.

    Queries and documents are packed and written; query groups and document parts of bounded size and work meet in a join, each group
    with each part. With many parts, an eighth of the document blocks is searched first: the k-th score found there is a floor below
    which nothing is scored again, sorted or sent; it lets pass some `FLOOR_SHARE` lists of a query, so fewer parts go without.
    Nothing but counts goes through the driver, and the plan is the same for any number of queries.
    """
    item, query_item = kind_of(d).name, kind_of(q).name
    documents, q = pin(pack(d)), pin(q)
    groups, parts = grid_shape(q.count(), documents, k, np.dtype(item).itemsize)
    packed = dealt(q, groups)
    if parts > FLOOR_SHARE:
        some = documents.filter(F.pmod(F.xxhash64("ids"), F.lit(FLOOR_SHARE)) == 0)
        first = topk(_grid(packed, some, (groups, -(-parts // FLOOR_SHARE)), k, metric, item, query_item), k)
        floors = pin(first.filter(F.col("rk") == k).select("qid", F.col("score").alias("floor")))
        packed = dealt(q.join(floors, "qid", "left"), groups)
    return _grid(packed, documents, (groups, parts), k, metric, item, query_item)


def dealt(q: DataFrame, groups: int) -> DataFrame:
    """Queries packed by their group `_g`, each with as many queries as any other."""
    if groups == 1:
        return pin(pack_queries(q).withColumn("_g", F.lit(0)))
    return pin(pack_queries(q.repartition(groups)).withColumn("_g", F.spark_partition_id()))


def grid_shape(asked: int, documents: DataFrame, k: int, size: int) -> tuple[int, int]:
    """Into how many groups `asked` queries and parts the documents are cut: each meeting of the two has a bounded work, and each group and part its
    bound. A group more sends all documents once more, as blocks; a part more sends a list more of each query, as rows: what costs least is taken."""
    there = documents.agg(F.sum(F.length("data")).alias("bytes")).first()
    held, total = there.bytes or 0, asked * (there.bytes or 0) // size
    cells = -(-total // work_of_key(documents.sparkSession, total))
    parts = max(1, round((cells * held / max(1, asked * max(1, k) * RESULT_BYTES)) ** 0.5), -(-held // PART_BYTES))
    groups = min(max(1, asked), max(1, -(-cells // parts), -(-asked * max(1, k) // GROUP_RESULTS)))
    return groups, max(parts, -(-cells // groups))


def _grid(queries: DataFrame, documents: DataFrame, shape: tuple[int, int], k: int, metric: str, item: str, query_item: str) -> DataFrame:
    """Every query block with every document block: each group of the one meets each part of the other."""
    groups, parts = shape

    def every(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("_p", every(parts))
    right = documents.withColumn("_p", block_of("ids", F.lit(parts))).withColumn("_g", every(groups))
    return meet(left, right, ["_g", "_p"], groups * parts, k, metric, item, query_item)
