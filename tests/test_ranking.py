import random

import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from densekit.operators import ranking, sampling
from densekit.schemas import SCORED


@pytest.fixture(scope="module")
def skewed(spark):
    """One query holds a third of all rows, with many equal scores."""
    return spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 0, id % 500 + 1) as qid", "id as pid", "cast(id * 7919 % 97 as double) as score"
    ).cache()


def test_spread_ranks_equal_plain_ranks(skewed, monkeypatch):
    plain = ranking.with_rank(skewed)
    monkeypatch.setattr(ranking, "LIST_ROWS", 50)
    same(ranking.with_rank(skewed), plain)


def test_spread_order_equals_plain_order(skewed, monkeypatch):
    run = skewed.select("qid", "pid", F.col("score").cast("int").alias("rk"))
    plain = ranking.order_run(run)
    monkeypatch.setattr(ranking, "LIST_ROWS", 50)
    same(ranking.order_run(run), plain)


def test_number_rows_over_a_whole_table(spark):
    words = spark.createDataFrame([(w,) for w in "the quick brown fox jumps over a lazy dog".split()], "token string")
    numbered = ranking.number_rows(words, [F.asc("token")])
    expected = sorted("the quick brown fox jumps over a lazy dog".split())
    assert [w for _, w in sorted((r.n, r.token) for r in numbered.collect())] == expected
    assert sorted(r.n for r in numbered.collect()) == list(range(1, 10))


def test_topk_is_cut_before_the_shuffle(skewed):
    best = ranking.topk(skewed, 2000)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert best.filter("qid = 0").count() == 2000


def test_equal_scores_go_to_the_lower_pid(spark):
    scored = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.7)], SCORED)
    assert rows(ranking.with_rank(scored), "rk", "pid") == [(1, 4), (2, 3), (3, 9)]


@pytest.mark.parametrize("n", [1, 77, 499, 500, 501, 5000])
def test_pick_ids_is_exact_and_repeatable(skewed, n):
    picked = rows(sampling.pick_ids(skewed, "qid", n))
    assert len(picked) == len(set(picked)) == min(n, 501)
    assert picked == rows(sampling.pick_ids(skewed.repartition(3), "qid", n))


def test_pick_ids_depends_on_the_seed(skewed):
    assert rows(sampling.pick_ids(skewed, "qid", 50, 1)) != rows(sampling.pick_ids(skewed, "qid", 50, 2))


def test_sample_queries_keeps_whole_lists(skewed):
    kept = sampling.sample_queries(skewed, 20)
    sizes = {r.qid: r["count"] for r in skewed.groupBy("qid").count().collect()}
    assert all(sizes[r.qid] == r["count"] for r in kept.groupBy("qid").count().collect())
    assert kept.select("qid").distinct().count() == 20
    assert sampling.sample_queries(skewed, 0) is skewed


def test_draws_spread_over_the_pool(spark):
    random.seed(1)
    pool = spark.createDataFrame([(random.randrange(10**12),) for _ in range(300)], "pid bigint")
    queries = spark.range(1000).withColumnRenamed("id", "qid")
    drawn = sampling.draws(queries, pool, 5)
    assert drawn.count() == 5000
    counts = [r["count"] for r in drawn.groupBy("pid").count().collect()]
    assert len(counts) == 300 and max(counts) < 50


def test_hashes_take_any_id(spark):
    ids = spark.createDataFrame([(2**63 - 1,), (-(2**63),), (0,)], "id bigint")
    assert sampling.sample_rows(ids, 1.0, "id").count() == 3


def test_all_tiers_at_once(spark, skewed):
    triplets = skewed.selectExpr("qid", "pid as pos_pid", "pid + 1 as neg_pid")
    sizes = (5, 40, 10**6)
    at_once = sampling.triplet_tiers(triplets, sizes, seed=3)
    for i, n in enumerate(sizes):
        same(at_once.filter(F.col("tier") == n).drop("tier"), sampling.triplet_tier(triplets, n, 3 + i))


@pytest.mark.parametrize("n", [0, 1, 37, 5000, 10**7])
def test_exact_row_samples(spark, n):
    """Rows of a hot key and repeated rows are parted where the number asks for it."""
    df = spark.range(6000).selectExpr("if(id < 3000, 1, id % 700) as qid", "id % 90 as pid")
    got = sampling.sample_rows_exact(df, n, "qid")
    assert got.count() == min(n, 6000)
    assert got.exceptAll(df).count() == 0
    same(got, sampling.sample_rows_exact(df.repartition(5), n, "qid"))


def test_small_fractions_draw_rows(spark):
    df = spark.range(4_000_000).withColumnRenamed("id", "qid")
    assert 1 <= sampling.sample_rows(df, 2e-6, "qid").count() <= 30
    assert 2000 < sampling.sample_rows(df, 7e-4, "qid").count() < 3600
