import math

import pytest
from conftest import rows

from densekit.operators import metrics

RUN, QRELS, LABELLED = "qid bigint, pid bigint, rk int", "qid bigint, pid bigint", "qid bigint, pid bigint, score double, label int"


def tables(spark, run, qrels):
    return spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, QRELS)


def mrr(spark, run, qrels, **options):
    return metrics.mrr_at_k(*tables(spark, run, qrels), **options).first()


def recall(spark, run, qrels, k=10, **options):
    return metrics.recall_at_k(*tables(spark, run, qrels), k, **options).first().recall


def test_no_hit_counts_zero(spark):
    assert mrr(spark, [(1, 9, 1)], [(1, 5)]).mrr == 0
    assert recall(spark, [(1, 9, 1)], [(1, 5)]) == 0


def test_judged_query_missing_in_the_run(spark):
    run, qrels = [(1, 5, 1)], [(1, 5), (2, 6)]
    assert mrr(spark, run, qrels).mrr == 0.5
    assert recall(spark, run, qrels) == 0.5
    with pytest.raises(Exception, match="not in the run: query 2"):
        recall(spark, run, qrels, strict=True)


def test_duplicate_qrels_lower_recall(spark):
    assert recall(spark, [(1, 5, 1)], [(1, 5), (1, 5)]) == 0.5


def test_no_common_query_is_an_error(spark):
    with pytest.raises(Exception, match="evaluation set"):
        mrr(spark, [(2, 5, 1)], [(1, 5)])


def test_first_relevant_counts_and_cutoff_holds(spark):
    run = [(1, p, p) for p in range(1, 13)]
    assert mrr(spark, run, [(1, 4), (1, 2)]).mrr == 0.5
    assert mrr(spark, run, [(1, 11)]).mrr == 0
    assert mrr(spark, run, [(1, 11)], k=11).mrr == pytest.approx(1 / 11, abs=1e-6)


def test_unjudged_ranked_queries_count_in_queries_ranked_only(spark):
    row = mrr(spark, [(1, 5, 1), (2, 5, 1), (3, 5, 1)], [(1, 5)])
    assert (row.mrr, row.queries_ranked) == (1.0, 3)
    assert recall(spark, [(1, 5, 1), (2, 5, 1)], [(1, 5)], over="run") == 0.5


def test_eval_qids_count_queries_without_relevant_passages(spark):
    run, qrels = tables(spark, [(1, 5, 1)], [(1, 5)])
    asked = spark.createDataFrame([(1,), (2,)], "qid bigint")
    assert metrics.mrr_at_k(run, qrels, eval_qids=asked).first().mrr == 0.5
    assert metrics.recall_at_k(run, qrels, 5, eval_qids=asked).first().recall == 0.5


def test_rounding_places(spark):
    run, qrels = [(1, 5, 1)], [(1, 5), (1, 6), (1, 7)]
    assert recall(spark, run, qrels) == 0.33333
    assert recall(spark, run, qrels, over="run") == 0.3333333
    with pytest.raises(ValueError):
        recall(spark, run, qrels, over="both")


def test_short_lists(spark):
    run, _ = tables(spark, [(1, 5, 1), (1, 6, 2), (1, 7, 3), (2, 5, 1)], [(1, 5)])
    assert rows(metrics.short_lists(run, 10)) == [(1, 3), (2, 1)]
    assert rows(metrics.short_lists(run, 2)) == [(2, 1)]


def test_pair_metrics(spark):
    pairs = spark.createDataFrame(
        [(1, 1, 0.9, 0), (1, 2, 0.8, 1), (1, 3, 0.8, 1), (2, 1, 0.3, 0), (2, 2, 0.5, 1), (3, 7, 0.1, 0)], LABELLED
    )
    row = metrics.pairs_mrr(pairs).first()
    assert row.queries == 3 and row.mrr == pytest.approx((0.5 + 1 + 0) / 3, abs=1e-6)
    got = {r.k: r.recall for r in metrics.pairs_recall(pairs, (1, 2, 3)).collect()}
    assert got[1] == pytest.approx(1 / 3, abs=1e-6)
    assert got[2] == pytest.approx((0.5 + 1) / 3, abs=1e-6)
    assert got[3] == pytest.approx(2 / 3, abs=1e-6)


def test_pair_mrr_tie_goes_to_lower_pid(spark):
    pairs = spark.createDataFrame([(1, 1, 0.5, 0), (1, 2, 0.5, 1)], LABELLED)
    assert metrics.pairs_mrr(pairs).first().mrr == 0.5


def test_histogram_counts_every_vector(spark):
    vecs = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(11)], "id bigint, embedding array<double>")
    bins = metrics.norm_histogram(vecs, 10).orderBy("bin").collect()
    assert [b.n for b in bins] == [1] * 9 + [2]
    assert math.isclose(bins[3].lower, 3.0)


def test_lines_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    """Tasks grow in number with the lines, whatever the session's number of shuffle partitions."""
    from catalog import views

    monkeypatch.setattr(views, "TASK_LINES", 100)
    spark.range(8000).selectExpr(
        "id div 4 as l_orderkey", "id as l_partkey", "cast(id % 97 as double) as l_extendedprice", "'R' as l_returnflag", "cast(id % 4 as int) as l_linenumber"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(2000).selectExpr("id as o_orderkey", "id + 9000 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    v = views.Views(spark, str(tmp_path))
    assert v.parts == 80 and v.run.rdd.getNumPartitions() == 80
    per = metrics.per_query(v.run, v.qrels, (1, 3), parts=v.parts)
    assert per.rdd.getNumPartitions() == 80
    assert rows(per) == rows(metrics.per_query(v.run, v.qrels, (1, 3))) and per.count() == 2000
