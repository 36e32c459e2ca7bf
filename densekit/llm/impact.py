"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors become integers, floor(scale * x). The index is cut into blocks of rows. In a block every dimension
has posting segments: the rows whose component lies in one quantisation level, with the least and the
greatest component there. For a query a segment's impact is the most that it can add to a score, counted
from the least that its dimension adds to any row of the block; so impacts are never negative, whatever
the signs are.

Segments are processed by descending quantised impact in rounds. A row's accumulator holds the impacts of its
segments met so far; none of its other dimensions can add more than the impact at which the round ended, so
accumulator + dimensions left x that impact bounds its score. The best rows so far are scored exactly, which
gives the k-th best score for certain. Processing stops when few rows have a bound that reaches it, or when no segment is
left; every row whose bound reaches it is then scored exactly. Nothing is estimated and no row is dropped without
that proof.

Queries are packed into blocks as well, and blocks of queries meet blocks of the index by their numbers in a
sort-merge join: an index row is read once per block of queries, and a task holds one block of each. Nothing is
broadcast, and many blocks of queries are cut into groups, so that what meets under one key is bounded. The k best per
block of the index are merged by a window that keeps k rows per query.

Defined cases: vectors that are null or hold null or non-finite components take no part; missing components
of shorter vectors count as 0; ties go to the smaller id; equal vectors are different rows; a query never
finds rows with its own id; null ids take no part; an empty table gives an empty result; of the input only the id and the vector
are read, whatever other columns are called. Scores are exact at any size of the components: where dimensions x
greatest query component x greatest component of the block could leave 2^53, up to which the accumulators are exact, the block's rows
are scored one by one in integers of any length. A component, and a score, beyond the range of a long counts as the end of that range.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densekit.session import pin

SCALE = 256
INDEX_ROWS, QUERY_ROWS = 4096, 256  # rows of a block
MOST_MET = 64  # blocks of queries that meet a block of the index in one task, some half a minute
LEVELS = 32  # quantisation levels of a dimension
ROUNDS = 12  # parts into which the segments of a query are cut
ENOUGH = 256  # candidates few enough to be scored at once
MOST_INDEXED = 2**31  # components from here on are in no segment
EXACT = 2**53  # integers below it are exact in the accumulators


def integer_vectors(rows: DataFrame, vector: str, scale: int = SCALE) -> Column:
    """The vector in integers, null if it takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~odd, whole)


class Block:
    """Posting segments of some rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that the first of equals has the smaller id
        self.ids, self.vectors = ids[order], vectors[order]
        self.largest = magnitude(vectors)
        if self.largest >= MOST_INDEXED:
            return
        n, dims = self.vectors.shape
        low, high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        level = (self.vectors - low) * LEVELS // (high - low + 1)
        segment = (level + np.arange(dims) * LEVELS).T.ravel()  # by dimension, then row
        by_segment = np.argsort(segment, kind="stable")
        self.rows = np.tile(np.arange(n), dims)[by_segment]  # the postings
        counts = np.bincount(segment, minlength=dims * LEVELS)
        filled = np.flatnonzero(counts)
        self.dim, self.count = filled // LEVELS, counts[filled]
        self.start = np.cumsum(self.count) - self.count
        values = self.vectors.T.ravel()[by_segment]
        self.least, self.most = np.minimum.reduceat(values, self.start), np.maximum.reduceat(values, self.start)

    def search(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, best first."""
        n, dims = self.vectors.shape
        if self.largest >= MOST_INDEXED or dims * self.largest * magnitude(query) >= EXACT:
            return self.search_wide(own_id, query, k)
        weight = query[self.dim]
        ends = np.where(weight < 0, self.least, self.most) * weight  # the most a segment's rows can get
        base = np.full(dims, np.iinfo(np.int64).max)
        np.minimum.at(base, self.dim, np.where(weight < 0, self.most, self.least) * weight)
        impact = ends - base[self.dim]
        order = np.argsort(-impact, kind="stable")
        postings = np.cumsum(self.count[order])
        cuts = np.unique(np.searchsorted(postings, np.linspace(0, postings[-1], ROUNDS + 1)[1:]) + 1)
        held, met = np.zeros(n), np.zeros(n)
        other, floor = self.ids != own_id, base.sum()
        live, at = np.flatnonzero(other), 0
        for cut in np.minimum(cuts, len(order)):
            part = order[at:cut]
            sizes = self.count[part]
            ends_at = np.cumsum(sizes)
            rows = self.rows[np.repeat(self.start[part] - (ends_at - sizes), sizes) + np.arange(ends_at[-1])]
            held += np.bincount(rows, np.repeat(impact[part], sizes), n)
            met += np.bincount(rows, minlength=n)
            left = impact[order[cut]] if cut < len(order) else 0
            bound = held[live] + (dims - met[live]) * left + floor
            if len(live) <= k:
                break
            best = live[np.argpartition(-bound, k)[: 2 * k]]
            sure = np.sort(self.vectors[best] @ query)[-k] if len(best) >= k else None
            if sure is not None:
                live = live[bound >= sure]
            if len(live) <= ENOUGH:
                break
            at = cut
        scores = self.vectors[live] @ query
        top = np.lexsort((live, -scores))[:k]
        return live[top], scores[top]


    def search_wide(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same by integers of any length, row by row."""
        live = np.flatnonzero(self.ids != own_id)
        exact = self.vectors[live].astype(object) @ query.astype(object)
        ends = np.iinfo(np.int64)
        scores = np.array([min(max(int(s), ends.min), ends.max) for s in exact], np.int64)
        # the bitwise complement turns the order round without leaving the range
        top = np.lexsort((live, ~scores))[:k]
        return live[top], scores[top]


def magnitude(values: np.ndarray) -> int:
    """The greatest absolute value."""
    return max(-int(values.min()), int(values.max()), 0) if values.size else 0


def pack(rows: DataFrame, size: int, count: int) -> DataFrame:
    """Rows `id`, `v` as blocks: `block`, `ids` (longs), `vectors` (ints, or longs where a component needs them), `dims`."""
    blocks = max(1, -(-count // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                dims = max(map(len, vectors), default=0)
                flat = np.zeros((len(ids), dims), np.int64)
                for row, v in zip(flat, vectors):
                    row[: len(v)] = v
                item = np.int32 if magnitude(flat) < 2**31 else np.int64
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int64()), "ids": [np.array(ids, np.int64).tobytes()],
                    "vectors": [flat.astype(item).tobytes()], "dims": pa.array([dims], pa.int32()),
                })

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    grouped = dealt.groupBy("block").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vectors"))
    return grouped.mapInArrow(run, "block long, ids binary, vectors binary, dims int")


def _unpack(ids: bytes, vectors: bytes, dims: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    who = np.frombuffer(ids, np.int64)
    item = np.int64 if len(vectors) == 8 * len(who) * dims else np.int32
    found = np.frombuffer(vectors, item).reshape(len(who), dims).astype(np.int64)
    return who, np.pad(found, ((0, 0), (0, width - dims)))


def _numbers(count: int) -> Column:
    """0 to `count` - 1."""
    return (F.sequence(F.lit(0), F.lit(count - 1)) if count else F.array()).cast("array<bigint>")


def top_k(rows: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """`query_id`, `rank` (int, from 1), `vec_id`, `score` (long): the k best rows for every query."""
    sides = []
    for df, size in ((rows, INDEX_ROWS), (queries, QUERY_ROWS)):
        taken = df.select(F.col(id).cast("long").alias("id"), integer_vectors(df, vector).alias("v"))
        taken = taken.filter("id is not null and v is not null")
        sides.append(pin(pack(taken, size, taken.count())))
    index, asked = sides

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                width = max(row["dims"], row["q_dims"])
                if held != (row["block"], width):
                    ids, vectors = _unpack(row["ids"], row["vectors"], row["dims"], width)
                    held, block = (row["block"], width), Block(ids, vectors) if width else None
                q_ids, q_vectors = _unpack(row["q_ids"], row["q_vectors"], row["q_dims"], width)
                who, found, scores = [], [], []
                for q, query in zip(q_ids, q_vectors):
                    if block is None:  # vectors without components: all scores are 0
                        places = np.sort(ids[ids != q])[:k]
                        values = np.zeros(len(places), np.int64)
                    else:
                        at, values = block.search(q, query, k)
                        places = block.ids[at]
                    who.append(np.full(len(places), q))
                    found.append(places)
                    scores.append(values)
                columns = [np.concatenate(c).astype(np.int64) for c in (who, found, scores)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    # a block of queries goes to every block of the index: far more bytes than Spark takes an explode to make, so both are shuffled
    n, m = (side.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0] for side in sides)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = -(-m // max(1, min(MOST_MET, n * m // (3 * cores))))
    keys = max(1, n * groups)
    dealt = asked.withColumn("group", F.pmod("block", F.lit(max(1, groups)))).repartition(max(1, min(m, 3 * cores)))
    spread = dealt.select(
        F.explode(_numbers(n)).alias("block"), "group",
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("dims").alias("q_dims"),
    )
    copies = index.withColumn("group", F.explode(_numbers(groups)))
    # dealt by number and not by bytes, which are few for the time they take
    spread, copies = (side.repartition(2 * keys, "block", "group") for side in (spread, copies))
    met = spread.hint("merge").join(copies, ["block", "group"]).select("block", "ids", "vectors", "dims", "q_ids", "q_vectors", "q_dims")
    best = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.vec_id as query_id, d.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::bigint as score
  from whole q join whole d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
ranked as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
