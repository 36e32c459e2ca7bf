"""Reproducible samples: the same rows for the same seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densekit.functions.hashing import BUCKETS, hash_bucket, hash_wide
from densekit.operators.ranking import number_placed, place_rows

_COARSE = 100  # hash buckets per histogram bar: at most 10,001 bars
FINE = 1e-3  # a smaller share of rows is drawn by a finer hash


def _lowest(keyed: DataFrame, by: str, wanted: Column, order: list[str]) -> DataFrame:
    """Of each group `by` the `wanted` rows with the lowest (_h, order); rows that agree in all of it are interchangeable.

    A histogram of the hash, of bounded size per group, finds the bar in which the last row falls; bars below it are kept
    whole and only the rows of that one bar are ranked, hash by hash.
    """
    barred = keyed.withColumn("_bar", F.floor(F.col("_h") / _COARSE).cast("int"))
    bars = barred.groupBy(by, "_bar").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(by).orderBy("_bar").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bars = bars.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_wanted", wanted)
    # one row per bar: those up to the one that is cut
    bars = bars.filter(F.col("_upto") - F.col("_n") < F.col("_wanted"))
    placed = barred.join(F.broadcast(bars), [by, "_bar"])
    columns = keyed.columns
    whole = placed.filter(F.col("_upto") <= F.col("_wanted")).select(*columns)
    split = placed.filter(F.col("_upto") > F.col("_wanted"))
    place = F.row_number().over(Window.partitionBy(by, "_bar").orderBy("_h", *order))
    rest = split.withColumn("_place", place).filter(F.col("_place") <= F.col("_wanted") - F.col("_upto") + F.col("_n"))
    return whole.unionByName(rest.select(*columns))


def pick_ids(ids: DataFrame, col: str, n: int, seed: int = 1) -> DataFrame:
    """Exactly n distinct ids (all, if n <= 0 or there are fewer), lowest (hash, id) first."""
    distinct = ids.select(col).distinct()
    if n <= 0:
        return distinct
    keyed = distinct.select(col, F.lit(0).alias("_tier"), hash_bucket(col, seed=seed).alias("_h"))
    return _lowest(keyed, "_tier", F.lit(n), [col]).select(col)


def sample_queries(run: DataFrame, n: int = -1, seed: int = 1) -> DataFrame:
    """Rows of n sampled queries, complete lists; n <= 0 keeps all."""
    if n <= 0:
        return run
    return run.join(pick_ids(run, "qid", n, seed), "qid", "left_semi")


def triplet_tier(triplets: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """All triplets of n sampled queries."""
    return sample_queries(triplets, n, seed)


def triplet_tiers(triplets: DataFrame, sizes: tuple[int, ...], seed: int = 1) -> DataFrame:
    """`tier` and the triplets of as many sampled queries, for each size; the i-th is the tier of seed `seed + i`.

    One pass over the ids draws all tiers, one over the triplets collects them.
    """
    draws = F.array(*(
        F.struct(F.lit(n).alias("tier"), hash_bucket("qid", seed=seed + i).alias("_h")) for i, n in enumerate(sizes)
    ))
    keyed = triplets.select("qid").distinct().select("qid", F.inline(draws))
    picked = _lowest(keyed, "tier", F.col("tier"), ["qid"]).groupBy("qid").agg(F.collect_list("tier").alias("_tiers"))
    return triplets.join(picked, "qid").select(F.explode("_tiers").alias("tier"), *triplets.columns)


def triplet_key() -> Column:
    """One non-negative integer per triplet, mixed from its three ids."""
    return (
        hash_bucket("qid", 1) * 998951 + hash_bucket("pos_pid", 2) * 31 + hash_bucket("neg_pid", 3)
    )


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """The rows of exactly n distinct keys (all, if there are fewer), lowest hash first."""
    return df.join(pick_ids(df, key, n, seed), key, "left_semi") if n > 0 else df.filter(F.lit(False))


def sample_rows(df: DataFrame, fraction: float, key, seed: int = 1) -> DataFrame:
    """Rows whose hashed key falls below the fraction: a plain filter, no shuffle.

    Rows with the same key are taken or left together. A fraction below FINE is measured in a finer hash.
    """
    if fraction < FINE:
        return df.filter(hash_wide(key, seed=seed) < round(fraction * BUCKETS * BUCKETS))
    return df.filter(hash_bucket(key, seed=seed) < round(fraction * BUCKETS))


def sample_rows_exact(df: DataFrame, n: int, key, seed: int = 1) -> DataFrame:
    """Exactly n rows (all, if there are fewer), lowest (hash of the key, values) first; rows of one key may be parted.

    All columns must have an order.
    """
    if n <= 0:
        return df.filter(F.lit(False))
    keyed = df.withColumns({"_tier": F.lit(0), "_h": hash_bucket(key, seed=seed)})
    return _lowest(keyed, "_tier", F.lit(n), df.columns).select(*df.columns)


def training_sample(embeddings: DataFrame, fraction: float = 0.1, seed: int = 1, id_col: str = "id", n: int | None = None) -> DataFrame:
    """Sample without replacement for index training: a fraction, or the rows of exactly n ids."""
    if n is not None:
        return exact_sample(embeddings, n, id_col, seed)
    return sample_rows(embeddings, fraction, id_col, seed)


def draws(queries: DataFrame, pool: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k draws with replacement per query from the distinct pids of `pool`: `qid, draw, pid`."""
    placed = place_rows(pool.select("pid").distinct(), [F.asc("pid")])
    numbered, size = number_placed(placed, name="_slot"), max(1, placed.count())
    wanted = (
        queries.select("qid").distinct()
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("_slot", F.pmod(hash_wide("qid", F.col("draw"), seed), F.lit(size)) + 1)
    )
    return wanted.join(numbered, "_slot").select("qid", "draw", "pid")
