"""Re-ranking candidate lists by vectors or by a trained pair classifier."""

from __future__ import annotations

import re
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densekit.functions.vectors import dot
from densekit.operators.metrics import pairs_report
from densekit.operators.prep import TOKEN, hydrate_pairs, label_candidates, one_per_key, score_pairs, words
from densekit.operators.ranking import longest, with_rank
from densekit.schemas import SCORED
from densekit.session import pin

FEATURES = ("overlap", "idf_overlap", "similarity", "query_words", "passage_words")


def rerank_dot(run: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame, max_list: int | None = None) -> DataFrame:
    """`qid, pid, score, rk`: candidates by inner product; those without a vector are left out."""
    scored = score_pairs(run.select("qid", "pid"), query_vecs, doc_vecs)
    # scoring never adds rows, so the candidate lists bound the result's without scoring twice
    return with_rank(scored, longest(run, "qid") if max_list is None else max_list)


def score_pairs_model(pairs: DataFrame, factory: Callable[[], Callable], batch: int = 256) -> DataFrame:
    """`qid, pid, score` of text pairs by a scorer built once per task.

    The scorer takes two lists of texts and returns one number per pair.
    """

    def run(batches):
        scorer = factory()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = (part.column(c).to_pylist() for c in ("query_text", "passage_text"))
                score = np.asarray(scorer(*texts), dtype=np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("qid"), part.column("pid"), pa.array(score)], names=["qid", "pid", "score"]
                )

    return pairs.select("qid", "pid", "query_text", "passage_text").mapInArrow(run, SCORED)


class OverlapScorer:
    """Share of a query's distinct words that occur in the passage."""

    def __init__(self):
        self.word = re.compile(TOKEN)

    def __call__(self, queries: list[str], passages: list[str]) -> list[float]:
        q, p = ([set(self.word.findall((t or "").lower())) for t in texts] for texts in (queries, passages))
        return [len(a & b) / max(1, len(a)) for a, b in zip(q, p)]


def idf_table(passages: DataFrame) -> DataFrame:
    """`token, idf` over the passages of a collection."""
    n = passages.agg(F.count("*")).scalar()
    df = passages.select(F.explode(F.array_distinct(words())).alias("token")).groupBy("token").count()
    return df.select("token", F.log((n + 1) / (F.col("count") + 1)).alias("idf"))


def pair_features(pairs: DataFrame, queries: DataFrame, passages: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame) -> DataFrame:
    """Text pairs (columns of `pairs`, which must hold distinct qid, pid) with the numbers in FEATURES.

    The idf weights are added up per query word found in the passage. Word weights are joined to
    the queries, once per query, and not to the pairs.
    """
    weights = (
        queries.select(F.col("id").alias("qid"), F.explode(F.array_distinct(words())).alias("token"))
        .join(idf_table(passages), "token")
        .groupBy("qid").agg(F.collect_list(F.struct("token", "idf")).alias("_weights"))
    )
    q = queries.select("id", "text").join(weights.withColumnRenamed("qid", "id"), "id", "left")
    text = q.select(F.col("id").alias("qid"), words().alias("_q"), "_weights").join(
        query_vecs.select(F.col("id").alias("qid"), F.col("embedding").alias("_qv")), "qid", "left"
    )
    text = one_per_key(text, ["qid"], *(F.first(c).alias(c) for c in ("_q", "_weights", "_qv")))
    passage = passages.select(F.col("id").alias("pid"), words().alias("_p")).join(
        doc_vecs.select(F.col("id").alias("pid"), F.col("embedding").alias("_pv")), "pid", "left"
    )
    passage = one_per_key(passage, ["pid"], *(F.first(c).alias(c) for c in ("_p", "_pv")))
    both = pairs.join(text, "qid").join(passage, "pid")
    found = F.filter("_weights", lambda w: F.array_contains("_p", w["token"]))
    total = F.aggregate(found, F.lit(0.0), lambda acc, w: acc + w["idf"])
    return both.select(
        *pairs.columns,
        F.size(F.array_intersect("_q", "_p")).cast("double").alias("overlap"),
        F.coalesce(total, F.lit(0.0)).alias("idf_overlap"),
        F.coalesce(dot("_qv", "_pv"), F.lit(0.0)).alias("similarity"),
        F.size("_q").cast("double").alias("query_words"),
        F.size("_p").cast("double").alias("passage_words"),
    )


def fit_pair_ranker(features: DataFrame, iterations: int = 20) -> PipelineModel:
    """Two-class classifier on labelled pairs with FEATURES."""
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        LogisticRegression(maxIter=iterations, regParam=0.01, labelCol="label"),
    ]
    return Pipeline(stages=stages).fit(features)


def score_features(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Pairs with `score`, the classifier's raw output for class 1, and `logits` of both classes."""
    out = model.transform(features).withColumn("logits", vector_to_array("rawPrediction"))
    return out.withColumn("score", F.col("logits")[1]).drop("features", "rawPrediction", "probability", "prediction")


def rerank_eval(scored: DataFrame, qrels: DataFrame, ks=(5, 20, 100, 200, 1000)) -> DataFrame:
    """`metric, value`: MRR and recall at each k of a scored candidate set.

    One pass: the scores are labelled and sorted once, so a scorer behind them sees each pair once or, as Spark looks for the
    ranges of a sort first, twice; a slow scorer's result should be written before.
    """
    return pairs_report(label_candidates(scored.select("qid", "pid", "score"), qrels), ks)


def rerank_text_eval(run: DataFrame, qrels: DataFrame, queries: DataFrame, passages: DataFrame, factory: Callable) -> DataFrame:
    """`rerank_eval` with the scores of a text-pair scorer."""
    return rerank_eval(pin(score_pairs_model(hydrate_pairs(run.select("qid", "pid"), queries, passages), factory)), qrels)


def best_models(metrics: DataFrame, n: int = 3, by: str = "val_mrr", name: str = "model") -> DataFrame:
    """The n models with the highest validation metric."""
    return metrics.orderBy(F.desc(by), F.asc(name)).limit(n)
