"""Ranks, top-k and row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densekit.session import pin

LIST_ROWS = 1_000_000  # a longer list is ranked by many tasks instead of one


def best_first() -> tuple[Column, Column]:
    return F.desc("score"), F.asc("pid")


def longest(df: DataFrame, by: str) -> int:
    """Rows of the largest group, by one pass over the key column."""
    return df.groupBy(by).count().agg(F.max("count")).first()[0] or 0


def place_rows(df: DataFrame, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Range-partition rows on (by, order), cutting also through a large group, sort and pin them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, by), *order]
    at = F.monotonically_increasing_id()
    return pin(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("_at", at).withColumn("_piece", F.shiftright("_at", 33))
    )


def piece_offsets(placed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group and piece of placed rows: `_from`, the least `_at`, and `_before`, the rows of the group in earlier pieces."""
    pieces = placed.groupBy(*by, "_piece").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(
        *by, "_piece", "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )


def number_placed(placed: DataFrame, by: tuple[str, ...] = (), name: str = "n", some: Column | None = None) -> DataFrame:
    """Number placed rows from 1: place in the own piece plus the sizes of the group's earlier pieces. With `some`, only
    these rows are given, numbered among all."""
    offsets = piece_offsets(placed, by)
    columns = [c for c in placed.columns if c not in ("_at", "_piece")]
    number = F.col("_at") - F.col("_from") + F.col("_before") + 1
    rows = placed if some is None else placed.filter(some)
    return rows.join(offsets, [*by, "_piece"]).select(*columns, number.alias(name))


def number_rows(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), name: str = "n") -> DataFrame:
    """Number rows from 1 in `order`, per `by` or over the whole table, without a single-task sort.

    `order` must be a total order.
    """
    return number_placed(place_rows(df, order, by), by, name)


def _rank(df: DataFrame, order, max_list: int | None) -> DataFrame:
    if (longest(df, "qid") if max_list is None else max_list) > LIST_ROWS:
        ranked = number_rows(df, list(order), ("qid",), "rk")
    else:
        ranked = df.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked.withColumn("rk", F.col("rk").cast("int"))


def with_rank(scored: DataFrame, max_list: int | None = None) -> DataFrame:
    """Rank 1..n per query by descending score, lower pid first on ties.

    `max_list` is a known bound on the list length; without it the longest list is counted first.
    """
    return _rank(scored, best_first(), max_list)


def order_run(run: DataFrame, max_list: int | None = None) -> DataFrame:
    """Renumber a run 1..n per query in (rank, pid) order."""
    given = run.withColumnRenamed("rk", "_given")
    return _rank(given, (F.asc("_given"), F.asc("pid")), max_list).drop("_given")


def topk(scored: DataFrame, k: int, by: str = "qid", order=None, name: str = "rk") -> DataFrame:
    """First k rows per key. Each map task cuts to k before the shuffle, so a hot key stays small."""
    w = Window.partitionBy(by).orderBy(*(order or best_first()))
    return (
        scored.withColumn(name, F.row_number().over(w))
        .filter(F.col(name) <= k)
        .withColumn(name, F.col(name).cast("int"))
    )


def cutoff(run: DataFrame, k: int) -> DataFrame:
    """Ranks up to k."""
    return run.filter(F.col("rk") <= k)


def preview(df: DataFrame, by: str, order: str, n: int = 3) -> DataFrame:
    """First n rows of each group."""
    return topk(df, n, by, (F.asc(order),), "place")


def limit_queries(queries: DataFrame, n: int = 101) -> DataFrame:
    """The n queries with the lowest ids."""
    return queries.orderBy("qid").limit(n)
