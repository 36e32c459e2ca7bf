"""Neighbours in a sorted order of a whole table.

Rows are dealt by range of the order columns; these end with a unique one, so no value is too frequent to
be split. Each task sorts its range and compares every row with the next ones. The first and last rows of
each range, a few per task, are compared in one small further step, so the result is that of one sorted
list, whatever the ranges are.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from densekit.session import pin

#: (rows, rows that come some places later) -> rows of the result, as Arrow columns
Compare = Callable[[pa.RecordBatch, pa.RecordBatch], list[pa.Array]]


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def sorted_neighbours(df: DataFrame, order: list[str], compare: Compare, result: T.StructType, reach: int = 1) -> DataFrame:
    """What `compare` makes of every row and each of the next `reach` rows in the order; equal results of a
    batch are given once."""
    row_type = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    edge, found = to_arrow_schema(row_type), to_arrow_schema(result)
    out = T.StructType([
        T.StructField("_found", result), T.StructField("_range", T.IntegerType()),
        T.StructField("_place", T.LongType()), T.StructField("_edge", row_type),
    ])
    arrow = to_arrow_schema(out)

    def struct(columns: list[pa.Array], schema: pa.Schema) -> pa.Array:
        return pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], fields=list(schema))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last = TaskContext.get().partitionId(), 0, None

        def edges(rows: pa.RecordBatch, at: int) -> pa.RecordBatch:
            n = rows.num_rows
            columns = [pa.nulls(n, arrow[0].type), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, struct(rows.columns, edge)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            if place < reach:
                yield edges(batch.slice(0, reach - place), place)
            held = last.num_rows if last is not None else 0
            rows = _one([last, batch]) if held else batch
            place += batch.num_rows
            made = []
            for step in range(1, reach + 1):
                first = max(step, held)  # pairs whose later row is in this batch
                if first < rows.num_rows:
                    made.append(struct(compare(rows.slice(first - step, rows.num_rows - first), rows.slice(first)), found))
            if sum(map(len, made)):
                once = pa.Table.from_struct_array(pa.concat_arrays(made)).group_by(found.names).aggregate([])
                once = struct([c.combine_chunks() for c in once.select(found.names).columns], found)
                n = len(once)
                columns = [once, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, arrow[3].type)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            last = rows.slice(max(0, rows.num_rows - reach))
        if place > reach:  # the last rows, but those among the first
            extra = min(reach, place - reach)
            yield edges(last.slice(last.num_rows - extra), place - extra)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    done = pin(dealt.mapInArrow(scan, out))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], []
        for batch in batches:
            parts += batch.column(0).to_pylist()
            rows += batch.column(2).to_pylist()
        rows = pa.RecordBatch.from_pylist(rows, schema=edge)
        for step in range(1, reach + 1):
            ends = [i for i in range(len(parts) - step) if parts[i] != parts[i + step]]
            if ends:
                pairs = compare(rows.take(pa.array(ends)), rows.take(pa.array([i + step for i in ends])))
                yield pa.RecordBatch.from_struct_array(struct(pairs, found))

    ends = done.filter("_edge is not null").select("_range", "_place", "_edge")
    across = ends.repartition(1).sortWithinPartitions("_range", "_place").mapInArrow(meet, result)
    return done.filter("_found is not null").select("_found.*").unionByName(across)
