"""Mining negatives for training triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densekit.operators.prep import drop_relevant, lookup, one_per_key, score_pairs, triplet_pids
from densekit.operators.ranking import place_rows, topk
from densekit.operators.sampling import draws


def simple_negatives(triplets: DataFrame, qrels: DataFrame, topk_draws: int, seed: int = 1) -> DataFrame:
    """Random negatives: `qid, pos_pid, neg_pid`.

    Each query draws `topk_draws` pids (with replacement) from all pids of the triplets, relevant
    ones are removed, and the query's n-th triplet, in (pos_pid, neg_pid) order, takes the n-th of
    the rest from the end. Triplets beyond the supply are dropped. A query uses at most
    `topk_draws` triplets, so both sides are cut to that in the map tasks.
    """
    drawn = drop_relevant(draws(triplets, triplet_pids(triplets), topk_draws, seed), qrels)
    supply = topk(drawn, topk_draws, "qid", (F.desc("draw"),), "_n").select("qid", "_n", F.col("pid").alias("_new"))
    numbered = topk(triplets, topk_draws, "qid", (F.asc("pos_pid"), F.asc("neg_pid")), "_n")
    return numbered.join(supply, ["qid", "_n"]).select("qid", "pos_pid", F.col("_new").alias("neg_pid"))


def score_triplets(triplets: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame, strict: bool = False) -> DataFrame:
    """Triplets with `old_score`, the rounded inner product of the query and its present negative.

    Triplets without a vector are left out, or raise if `strict`.
    """
    pairs = triplets.withColumn("pid", F.col("neg_pid"))
    return score_pairs(pairs, query_vecs, doc_vecs, strict=strict).withColumnRenamed("score", "old_score").drop("pid")


def hard_negatives(
    triplets: DataFrame, run: DataFrame, qrels: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame,
    pick: str = "last", strict: bool = False,
) -> DataFrame:
    """Triplets whose negative is replaced by a harder one, with `old_score` and `new_score`.

    Among the query's candidates that are not relevant and score strictly above the present
    negative, take the lowest-ranked ('last') or the best-scored ('hardest'); with none the
    triplet is dropped. A query without qrels and an id without a vector raise if `strict`; otherwise triplets and
    candidates without a vector are left out, as `mining_summary` reports. A run that brings a `score` column, the rounded inner product, is not
    scored again.

    No triplet meets the candidates of its query one by one, and no list of them is built: see `last_above`.
    """
    if pick not in ("last", "hardest"):
        raise ValueError(f"unknown pick {pick!r}, expected 'last' or 'hardest'")
    if strict:
        triplets = lookup(triplets, one_per_key(qrels, ["qid"]), "qid")
    old = score_triplets(triplets, query_vecs, doc_vecs, strict)
    candidates = drop_relevant(run, qrels)
    if "score" not in run.columns:
        candidates = score_pairs(candidates, query_vecs, doc_vecs, strict=strict)
    kept = [c for c in triplets.columns if c != "neg_pid"]
    result = [*kept, F.col("_new.pid").alias("neg_pid"), "old_score", F.col("_new.score").alias("new_score")]
    if pick == "hardest":
        # on equal scores the higher rank wins
        order = F.struct("score", -F.col("rk"))
        best = one_per_key(candidates, ["qid"], F.max_by(F.struct("pid", "score"), order).alias("_new"))
        return old.join(best, "qid").filter(F.col("_new.score") > F.col("old_score")).select(*result)
    return last_above(old, candidates).select(*result)


def last_above(thresholds: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of `thresholds` (`qid`, `old_score`, ...) with `_new`, the lowest-ranked of the query's candidates (`qid, rk, pid, score`) that
    score strictly higher; rows without one are left out.

    Candidates and thresholds of a query stand in one order, by score; at a threshold the answer is the highest rank so far. The order is cut
    into ranges, through a query too, and what earlier ranges of the query had comes from a small table, so a query with a third of all
    rows is as many tasks as any other third.
    """
    row = F.struct(*(c for c in thresholds.columns if c not in ("qid", "old_score")))
    candidate = F.struct("rk", "pid", "score")
    events = candidates.select("qid", "score", candidate.alias("_c"), F.lit(None).alias("_row")).unionByName(
        thresholds.select("qid", F.col("old_score").alias("score"), F.lit(None).alias("_c"), row.alias("_row"))
    )
    # of equal scores the thresholds come first; what follows parts ties
    marked = events.withColumns({"_last": F.col("_row").isNull(), "_tie": F.coalesce(F.col("_c.rk").cast("long"), F.xxhash64("_row"))})
    placed = place_rows(marked, [F.desc("score"), F.asc("_last"), F.asc("_tie")], ("qid",))
    pieces = placed.groupBy("qid", "_piece").agg(F.max("_c").alias("_top"))
    before = Window.partitionBy("qid").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("qid", "_piece", F.max("_top").over(before).alias("_carried"))
    here = Window.partitionBy("qid", "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("_here", F.max("_c").over(here)).filter("_row is not null")
    found = run.join(carried, ["qid", "_piece"]).withColumn("_new", F.greatest("_here", "_carried")).filter("_new is not null")
    return found.select("qid", F.col("score").alias("old_score"), "_row.*", "_new")


def mining_summary(
    triplets: DataFrame, mined: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame
) -> DataFrame:
    """One row: mean old score over the input triplets, mean new score over the replaced ones; how many triplets came
    in, how many of them have no score for want of a vector, and how many were replaced."""
    nothing = F.lit(None).cast("double")
    given = triplets.select(nothing.alias("old_score"), nothing.alias("new_score"), F.lit(1).alias("_given"))
    old = score_triplets(triplets, query_vecs, doc_vecs).select("old_score", nothing.alias("new_score"), F.lit(0).alias("_given"))
    new = mined.select(nothing.alias("old_score"), "new_score", F.lit(0).alias("_given"))
    return given.unionByName(old).unionByName(new).agg(
        F.round(F.avg("old_score"), 6).alias("old_mean_all"),
        F.round(F.avg("new_score"), 6).alias("new_mean_replaced"),
        F.sum("_given").alias("triplets"),
        (F.sum("_given") - F.count("old_score")).alias("unscored"),
        F.count("new_score").alias("replaced"),
    )


def in_batch_documents(batches: DataFrame) -> DataFrame:
    """`batch_id, j, pid, role, target_of`: the documents every query of a batch is scored against.

    Positives come first (j = i), then negatives (j = batch size + i). `target_of` is the row whose
    positive the document is; the pairs themselves are never written out.
    """
    sizes = one_per_key(batches, ["batch_id"], F.count("*").alias("_size"))
    docs = F.array(
        F.struct(F.col("i").cast("bigint").alias("j"), F.col("pos_pid").alias("pid"), F.lit("positive").alias("role"), F.col("i").cast("bigint").alias("target_of")),
        F.struct((F.col("i") + F.col("_size")).alias("j"), F.col("neg_pid").alias("pid"), F.lit("negative").alias("role"), F.lit(None).cast("bigint").alias("target_of")),
    )
    return batches.join(sizes, "batch_id").select("batch_id", F.inline(docs))
