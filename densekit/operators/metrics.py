"""Ranking metrics over long tables: run (qid, pid, rk), qrels (qid, pid), scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densekit.functions.vectors import norm
from densekit.operators.prep import one_per_key, require
from densekit.operators.ranking import best_first, number_placed, place_rows

REPORT_KS = (5, 20, 100)
LADDER_KS = (1000, 200, 50, 10, 5, 1)


def per_query(run: DataFrame, qrels: DataFrame, ks, eval_qids: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """One row per query: judged, in_run, n_gt, first relevant rank, hits at each k.

    Run and qrels are stacked and reduced to one row per (qid, pid), which takes the place of a
    join and spreads a query with very many rows over tasks up to the final, partially combined,
    aggregation. `n_gt` counts qrels rows, hits count distinct pids. `eval_qids` names the judged
    queries instead of the qrels; it is the way to count a query whose list of relevant passages
    is empty. `parts`, for short lists, deals whole queries to so many tasks, whatever the session's number of shuffle partitions: then
    it bounds the memory of a task.
    """
    listed = run.select("qid", "pid", "rk", F.lit(0).alias("gt"))
    wanted = qrels.select("qid", "pid", F.lit(None).cast("int").alias("rk"), F.lit(1).alias("gt"))
    stacked = listed.unionByName(wanted)
    if parts:
        stacked = stacked.repartition(parts, "qid")
    pairs = stacked.groupBy("qid", "pid").agg(F.min("rk").alias("rk"), F.sum("gt").alias("n_gt"))
    hit = F.col("n_gt") > 0
    out = pairs.groupBy("qid").agg(
        F.sum("n_gt").alias("n_gt"),
        F.max(F.col("rk").isNotNull()).alias("in_run"),
        F.min(F.when(hit, F.col("rk"))).alias("first"),
        *(F.count_if(hit & (F.col("rk") <= k)).alias(f"hits_{k}") for k in ks),
    )
    if eval_qids is None:
        return out.withColumn("judged", F.col("n_gt") > 0)
    asked = eval_qids.select("qid").distinct().withColumn("judged", F.lit(True))
    return out.join(asked, "qid", "full").fillna({"n_gt": 0, "in_run": False, "judged": False}).fillna(
        0, [f"hits_{k}" for k in ks]
    )


def _judged():
    return F.count_if("judged")


def _mrr(k: int):
    inverse = F.when(F.col("judged") & (F.col("first") <= k), 1.0 / F.col("first"))
    return F.coalesce(F.sum(inverse), F.lit(0.0)) / _judged()


def _recall(k: int, over: str):
    places = {"qrels": 5, "run": 7}
    if over not in places:
        raise ValueError(f"unknown over={over!r}, expected 'qrels' or 'run'")
    share = F.coalesce(F.col(f"hits_{k}"), F.lit(0)) / F.greatest(F.lit(1), F.col("n_gt"))
    return F.round(F.avg(F.when(F.col("judged" if over == "qrels" else "in_run"), share)), places[over])


def _checked(summary: DataFrame) -> DataFrame:
    """No query both judged and ranked is an error."""
    message = F.lit("no judged query occurs in the run: is this the evaluation set?")
    return require(summary, F.col("_both") > 0, message).drop("_both")


def _both():
    return F.count_if(F.col("judged") & F.col("in_run")).alias("_both")


def mrr_at_k(run: DataFrame, qrels: DataFrame, k: int = 10, eval_qids: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """`k, mrr, queries_ranked`: mean inverse rank of the first relevant passage within k.

    The mean is over all judged queries, ranked or not.
    """
    q = per_query(run, qrels, (), eval_qids, parts)
    summary = q.agg(
        F.lit(k).alias("k"), F.round(_mrr(k), 6).alias("mrr"), F.count_if("in_run").alias("queries_ranked"), _both()
    )
    return _checked(summary)


def recall_ladder(
    run: DataFrame, qrels: DataFrame, ks=LADDER_KS, over: str = "qrels",
    eval_qids: DataFrame | None = None, strict: bool = False, parts: int | None = None,
) -> DataFrame:
    """`k, recall` for each k, all from one pass.

    `over='qrels'` averages over judged queries (5 places), `over='run'` over ranked ones (7).
    With `strict` a judged query that is not in the run raises instead of counting 0.
    """
    q = per_query(run, qrels, ks, eval_qids, parts)
    if strict:
        message = F.concat(F.lit("not in the run: query "), F.col("qid").cast("string"))
        q = require(q, F.col("in_run") | ~F.col("judged"), message)
    wide = q.agg(*(_recall(k, over).alias(f"r{k}") for k in ks))
    rungs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks))
    return wide.select(F.inline(rungs))


def recall_at_k(run: DataFrame, qrels: DataFrame, k: int, over: str = "qrels", **options) -> DataFrame:
    return recall_ladder(run, qrels, (k,), over, **options)


def eval_report(
    run: DataFrame, qrels: DataFrame, ks=REPORT_KS, k_mrr: int = 10,
    eval_qids: DataFrame | None = None, strict: bool = False, min_label: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """One row: MRR at k_mrr, queries ranked, recall at each k.

    `eval_qids` names the queries to judge, `min_label` the least label of a relevant passage; with
    `strict` a judged query that is not in the run raises instead of counting 0.
    """
    q = per_query(run, qrels if min_label is None else qrels.filter(F.col("label") >= min_label), ks, eval_qids, parts)
    if strict:
        message = F.concat(F.lit("not in the run: query "), F.col("qid").cast("string"))
        q = require(q, F.col("in_run") | ~F.col("judged"), message)
    summary = q.agg(
        F.round(_mrr(k_mrr), 6).alias(f"mrr_{k_mrr}"),
        F.count_if("in_run").alias("queries_ranked"),
        *(_recall(k, "qrels").alias(f"recall_{k}") for k in ks),
        _both(),
    )
    return _checked(summary)


def short_lists(run: DataFrame, k: int = 10) -> DataFrame:
    """Queries with fewer than k candidates, and how many they have."""
    return run.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") < k)


def mean_list_length(run: DataFrame) -> DataFrame:
    """Candidates per query, integer division."""
    return run.groupBy("qid").agg(F.count("*").alias("n")).agg(
        F.expr("cast(sum(n) div count(*) as bigint)").alias("mean_length")
    )


def _labelled_places(scored: DataFrame, ks=()) -> DataFrame:
    """`qid`, `first` (place of the first pair labelled 1), `n_pos` and `h{k}` (of them among the first k) of every query.

    The pairs are sorted once, by (query, score) ranges that cut through long lists; only those labelled 1 need their place.
    Ties in score go to the lower pid.
    """
    placed = place_rows(scored.select("qid", "pid", "score", "label"), list(best_first()), ("qid",))
    positives = number_placed(placed, ("qid",), "_place", F.col("label") == 1).groupBy("qid").agg(
        F.min("_place").alias("first"), F.count("*").alias("n_pos"), *(F.count_if(F.col("_place") <= k).alias(f"h{k}") for k in ks)
    )
    return placed.select("qid").distinct().join(positives, "qid", "left")


def _mean_inverse() -> Column:
    return F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6)


def _mean_share(k: int) -> Column:
    return F.round(F.avg(F.coalesce(F.col(f"h{k}") / F.col("n_pos"), F.lit(0.0))), 6)


def _rungs(values: DataFrame, ks) -> DataFrame:
    return values.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks))))


def pairs_mrr(scored: DataFrame) -> DataFrame:
    """Mean inverse position of the first pair labelled 1 among a query's pairs by score.

    Ties in score go to the lower pid; a query without a label 1 counts 0.
    """
    return _labelled_places(scored).agg(_mean_inverse().alias("mrr"), F.count("*").alias("queries"))


def pairs_recall(scored: DataFrame, ks=(5, 20, 100, 200, 1000)) -> DataFrame:
    """`k, recall`: share of a query's labelled pairs among its first k by score, averaged.

    A query without a label 1 counts 0.
    """
    return _rungs(_labelled_places(scored, ks).agg(*(_mean_share(k).alias(f"r{k}") for k in ks)), ks)


def pairs_report(scored: DataFrame, ks=(5, 20, 100, 200, 1000)) -> DataFrame:
    """`metric, value`: `mrr` and `recall_k` of a scored and labelled candidate set, from one pass over it."""
    wide = _labelled_places(scored, ks).agg(_mean_inverse().alias("mrr"), *(_mean_share(k).alias(f"recall_{k}") for k in ks))
    names = ["mrr", *(f"recall_{k}" for k in ks)]
    return wide.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))))


def norm_histogram(embeddings: DataFrame, bins: int = 10) -> DataFrame:
    """`bin, lower, n`: equal-width histogram of vector lengths, empty bins included.

    Equal lengths throughout are put into a range of width 1 around them.
    """
    norms = embeddings.select(F.round(norm("embedding"), 6).alias("norm"))
    counts = norms.groupBy("norm").count()  # equal rounded lengths are combined map-side
    ends = counts.agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("norm") - lo) / width), F.lit(bins - 1)).cast("int")
    filled = counts.groupBy(place.alias("bin")).agg(F.sum("count").alias("n"))
    all_bins = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(filled, "bin", "left").select(
        "bin", F.round(lo + F.col("bin") * width, 6).alias("lower"), F.coalesce("n", F.lit(0)).alias("n")
    )
