"""Vectors packed into blocks: one row holds the ids and the vectors, or codes, of up to a few thousand.

A block belongs to a cell and knows its centre (a table without cells is one cell around zero) and the least and largest
distance of its vectors from it. That bounds every score a query can have in the block, by the triangle inequality and by
Cauchy-Schwarz, so a block that cannot enter a query's list is skipped.

Which blocks meet which queries is decided by Spark: queries sent to all tasks (`scan`), or blocks of queries that meet blocks of
vectors in a join (`meet`).
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densekit.operators.blocks import Best, matrix, numbers, raw_scores
from densekit.schemas import SCORED

BLOCK_ROWS = 4096  # most vectors of a block ...
BLOCK_BYTES = 1 << 20  # ... and most bytes of them, but for a single one
HELD_BYTES = 32 << 20  # vectors a packing task holds
CHUNK = 1024  # queries scored at a time ...
TILE = 1024  # ... against so many vectors: their scores stay in a core's cache
LOOKED_UP = 64  # vectors whose codes are looked up at a time, for the same reason
TASK_WORK = 1 << 36  # most multiply-adds of queries and vectors that meet under one key, some ten seconds ...
LEAST_WORK = 1 << 32  # ... and the least for which a key of its own pays
LOOKUP = 16  # multiply-adds that take as long as looking up a code
BLOCKS = "list_id int, n int, lo double, hi double, center binary, ids binary, data binary"
QUERY_BLOCKS = "list_id int, ids binary, data binary, floor binary"
_SLACK = 1e-6  # scores are compared rounded to 6 places


def cut(cells: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows sorted by cell: one cell each, at most `size` rows."""
    starts = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1)) if len(cells) else []
    for a, b in zip(starts, [*starts[1:], len(cells)]):
        for at in range(a, b, size):
            yield at, min(at + size, b)


class Packer:
    """Rows of one task, given back as blocks: by cell, and within a cell the nearest to its centre first."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, cells: np.ndarray, ids: np.ndarray, far: np.ndarray, data: np.ndarray) -> bool:
        """Take rows in; whether it is time to flush."""
        self.rows.append((cells, ids, far, data))
        self.held += data.nbytes
        return self.held >= HELD_BYTES

    def flush(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(cell, ids, distances, data) of each block."""
        if not self.rows:
            return
        if len({d.shape[1:] for *_, d in self.rows}) > 1:
            raise ValueError("vectors of different length in one table")
        cells, ids, far, data = (np.concatenate(p) for p in zip(*self.rows))
        self.rows, self.held = [], 0
        order = np.lexsort((ids, far, cells))
        cells = cells[order]
        size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, data[:1].nbytes)))
        for a, b in cut(cells, size):
            part = order[a:b]
            yield int(cells[a]), ids[part], far[part], data[part]


def kind_of(df: DataFrame, column: str = "embedding") -> np.dtype:
    """In what numbers a vector column is held: float32 where that is its type, else float64."""
    return np.dtype(np.float32 if df.schema[column].dataType.elementType.typeName() == "float" else np.float64)


def block_batch(cell: int, ids: np.ndarray, far: np.ndarray, data: np.ndarray, center: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([cell], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([far.min()]), pa.array([far.max()]),
            pa.array([b"" if center is None else center.astype(np.float64).tobytes()], pa.binary()),
            pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()),
        ],
        names=["list_id", "n", "lo", "hi", "center", "ids", "data"],
    )


def pack(docs: DataFrame) -> DataFrame:
    """`pid, embedding` as blocks of one cell around zero; no shuffle."""
    kind = kind_of(docs)

    def run(batches):
        packer = Packer()

        def out():
            for cell, ids, far, data in packer.flush():
                yield block_batch(cell, ids, far, data, None)

        for batch in batches:
            if batch.num_rows:
                vecs = matrix(batch.column("embedding"))
                if packer.add(np.zeros(len(vecs), np.int32), numbers(batch.column("pid")), np.linalg.norm(vecs, axis=1), vecs.astype(kind)):
                    yield from out()
        yield from out()

    return docs.select("pid", "embedding").mapInArrow(run, BLOCKS)


def pack_queries(queries: DataFrame, cells_of=None, shared=None) -> DataFrame:
    """`qid, embedding` and perhaps `floor`, the score a result must reach, and `list_id` as blocks; no shuffle.

    `cells_of(vectors, shared)` gives the cells each query visits; without it a row's cell is `list_id`, or there is one cell.
    """
    kind, floors, given = kind_of(queries), "floor" in queries.columns, "list_id" in queries.columns
    side = queries.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        packer = Packer()

        def out():
            for cell, ids, floor, data in packer.flush():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int64), data, floor))],
                    names=["list_id", "ids", "data", "floor"],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            vecs, qids = matrix(batch.column("embedding")), numbers(batch.column("qid"))
            low = np.full(len(vecs), -np.inf)
            if floors:
                low = batch.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            if cells_of is not None:
                cells = cells_of(vecs, side.value)
            else:
                cells = (numbers(batch.column("list_id")) if given else np.zeros(len(vecs), np.int32))[:, None]
            at = np.repeat(np.arange(len(vecs)), cells.shape[1])
            if packer.add(cells.ravel(), qids[at], low[at], vecs.astype(kind)[at]):
                yield from out()
        yield from out()

    return queries.select("qid", "embedding", *["floor"] * floors, *["list_id"] * given).mapInArrow(run, QUERY_BLOCKS)


def unpack(blocks: DataFrame, kind: str, books: np.ndarray | None = None) -> DataFrame:
    """Blocks as rows `list_id, pid` and `embedding` (of type `kind`), or `codes`."""
    name, item = ("embedding", np.float32 if kind == "float" else np.float64) if books is None else ("codes", code_kind(books))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, data = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], item).reshape(row["n"], -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1) * data.shape[1], pa.int32()), pa.array(data.ravel()))
                if books is not None:
                    lists = lists.cast(pa.list_(pa.int32()))
                cells = pa.array(np.full(len(ids), row["list_id"]), pa.int32())
                yield pa.RecordBatch.from_arrays([cells, pa.array(ids), lists], names=["list_id", "pid", name])

    return blocks.mapInArrow(run, f"list_id int, pid bigint, {name} array<{kind if books is None else 'int'}>")


def code_kind(books: np.ndarray) -> np.dtype:
    """The bytes a code word's number takes."""
    return np.dtype(np.uint8 if books.shape[1] <= 256 else np.uint16)


class Cell:
    """Some queries and the centre of a cell: bounds and scores of the cell's blocks.

    Vectors are scored by a matrix product. Codes are never turned into vectors: the products of a query's sub-vectors with
    all code words are a look-up table of m x codes numbers, a document's score is the sum of the m numbers
    its codes point at, plus what depends on the query and the centre only (and for squared distances on the
    code and the centre only).
    """

    def __init__(self, q: np.ndarray, center: bytes, item: np.dtype, metric: str, books: np.ndarray | None):
        self.q, self.item, self.metric, self.books = q, item, metric, books
        self.center = np.frombuffer(center, np.float64) if center else np.zeros(q.shape[1])
        if len(self.center) != q.shape[1]:
            raise ValueError(f"vectors of {q.shape[1]} and {len(self.center)} elements meet")
        self.dot, self.norm = q @ self.center, np.linalg.norm(q, axis=1)
        self.gap = np.linalg.norm(q - self.center, axis=1)
        self.tables: dict[int, np.ndarray] = {}

    def upper(self, lo: float, hi: float) -> np.ndarray:
        """A score that no vector at a distance of lo to hi from the centre exceeds, per query."""
        if self.metric == "ip":
            return self.dot + self.norm * hi
        return -np.maximum(np.maximum(self.gap - hi, lo - self.gap), 0) ** 2

    def _table(self, chunk: int) -> np.ndarray:
        """(m, codes, queries of the chunk): products of sub-vectors and code words."""
        if chunk not in self.tables:
            part = self.q[chunk * CHUNK : (chunk + 1) * CHUNK]
            sub = self.books.shape[2]
            self.tables[chunk] = np.stack([w @ part[:, i * sub : (i + 1) * sub].T for i, w in enumerate(self.books)])
        return self.tables[chunk]

    def vectors(self, data: bytes, n: int) -> np.ndarray:
        """The vectors, or codes, of a block."""
        if self.books is None:
            return np.frombuffer(data, self.item).reshape(n, -1).astype(np.float64)
        return np.frombuffer(data, code_kind(self.books)).reshape(n, -1).astype(np.intp)

    def scores(self, chunk: int, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of the queries `rows`, all of a chunk, and vectors or codes; larger is better."""
        if self.books is None:
            return raw_scores(self.q[rows], codes, self.metric)
        n = len(codes)
        table = self._table(chunk)
        if len(rows) < table.shape[2]:
            table = table[:, :, rows - chunk * CHUNK]
        total, found = np.empty((n, len(rows))), np.empty((LOOKED_UP, len(rows)))
        for at in range(0, n, LOOKED_UP):
            part = total[at : at + LOOKED_UP]
            np.take(table[0], codes[at : at + LOOKED_UP, 0], axis=0, out=part, mode="clip")
            for i in range(1, codes.shape[1]):
                part += np.take(table[i], codes[at : at + LOOKED_UP, i], axis=0, out=found[: len(part)], mode="clip")
            if self.metric == "ip":
                part += self.dot[rows]
        if self.metric == "ip":
            return total.T
        own = np.zeros(n)
        for i, part in enumerate(self.center.reshape(len(self.books), -1)):
            own += ((self.books[i] ** 2).sum(1) + 2 * self.books[i] @ part)[codes[:, i]]
        return np.minimum(2 * total.T - self.gap[rows][:, None] ** 2 - own[None, :], 0)


def enter(best: Best, rows: np.ndarray, cell: Cell, block: dict) -> int:
    """Take a block's vectors into the lists of the queries `rows` (row i of `best` is query i of `cell` in order of `rows`);
    the number of queries the block was scored for."""
    upper = cell.upper(block["lo"], block["hi"])
    floor = best.floor[rows]
    may = np.flatnonzero(upper + _SLACK + 1e-9 * np.abs(upper) >= floor)
    if len(may):
        ids, data = np.frombuffer(block["ids"], np.int64), cell.vectors(block["data"], block["n"])
        chunk_of = may // CHUNK
        for chunk in np.unique(chunk_of):
            part = may[chunk_of == chunk]
            for at in range(0, len(ids), TILE):
                best.add(rows[part], ids[at : at + TILE], cell.scores(int(chunk), part, data[at : at + TILE]))
    return len(may)


def scan(blocks: DataFrame, small, k: int, metric: str, item: str, books: np.ndarray | None = None) -> DataFrame:
    """Queries held by every task (`knn.Queries`) past the blocks where they lie: at most k rows per query and task."""
    spark = blocks.sparkSession
    side = spark.sparkContext.broadcast((tuple(small), books))
    kind = np.dtype(item)
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        (qids, q, cells), books = side.value
        best, at, cell, rows = Best(len(qids), k), None, None, np.arange(len(qids))
        for batch in batches:
            for block in batch.to_pylist():
                if at != (block["list_id"], block["center"]):
                    at = block["list_id"], block["center"]
                    if cells is not None:
                        rows = np.flatnonzero((cells == block["list_id"]).any(axis=1))
                    cell = Cell(q[rows], block["center"], kind, metric, books) if len(rows) else None
                if cell is not None:
                    enter(best, rows, cell, block)
        yield from best.batches(qids)

    return blocks.coalesce(tasks).mapInArrow(run, SCORED)


def work_of_key(spark, total: int) -> int:
    """Work per key of a join of blocks, if all of it is `total`: a few keys a core, within the bounds above."""
    return max(LEAST_WORK, min(TASK_WORK, total // (3 * spark.sparkContext.defaultParallelism)))


def meet(queries: DataFrame, blocks: DataFrame, on: list[str], keys: int, k: int, metric: str, item: str, query_item: str, books: np.ndarray | None = None) -> DataFrame:
    """Blocks of queries meet blocks of vectors that agree in the columns `on`: at most k rows per query, for each of its blocks.

    A sort-merge join gives a query block with all its blocks one after another, so a task holds the lists of one query block at a time.
    Blocks are few bytes for the time they take, so they are dealt out here, to twice as many tasks as there are `keys`, not by their size.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(books)
    kind, query_kind = np.dtype(item), np.dtype(query_item)
    left = queries.select(*on, F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("floor").alias("q_floor"))
    right = blocks.select(*on, "n", "lo", "hi", "center", "ids", "data")
    left, right = (side.repartition(2 * keys, *on) for side in (left, right))
    joined = left.hint("merge").join(right, on).select("q_ids", "q_data", "q_floor", "n", "lo", "hi", "center", "ids", "data")

    def run(batches):
        held = qids = best = q = at = cell = rows = None
        for batch in batches:
            for block in batch.to_pylist():
                # what a query block holds may not differ from another's in ids alone: a cell's floors do
                key = block["q_ids"], block["q_floor"]
                if held != key:
                    if best is not None:
                        yield from best.batches(qids)
                    held, at = key, None
                    qids = np.frombuffer(block["q_ids"], np.int64)
                    q = np.frombuffer(block["q_data"], query_kind).reshape(len(qids), -1).astype(np.float64)
                    best, rows = Best(len(qids), k), np.arange(len(qids))
                    best.floor = np.frombuffer(block["q_floor"], np.float64).copy()
                if at != block["center"]:
                    at = block["center"]
                    cell = Cell(q, at, kind, metric, shared.value)
                enter(best, rows, cell, block)
        if best is not None:
            yield from best.batches(qids)

    return joined.mapInArrow(run, SCORED)
