"""One key holds a third of all rows: joins must be split, and the results must not change."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from densekit.operators import audits, metrics, negatives, prep, ranking

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture(scope="module")
def scored(spark):
    table = spark.range(0, 60_000, 1, 8).selectExpr(
        "if(id % 3 = 0, 0, id % 4000 + 1) as qid", "id as pid", "cast(id * 7919 % 1009 as double) / 100 as score"
    )
    return table.cache()


@pytest.fixture
def small_parts(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def texts(spark):
    return spark.range(60_000).select(F.col("id").alias("qid"), F.concat(F.lit("t"), "id").alias("text"))


def labelled(scored):
    return scored.withColumn("label", (F.col("pid") % 11 == 0).cast("int"))


CASES = {
    "lookup": lambda s, t: prep.lookup(t, texts(s), "qid"),
    "subset_by_keys": lambda s, t: prep.subset_by_keys(t, t.filter("pid % 5 = 0"), "qid"),
    "softmax": lambda s, t: audits.softmax(t),
    "group_lists": lambda s, t: prep.group_lists(t, 500),
    "in_batch_documents": lambda s, t: negatives.in_batch_documents(
        t.selectExpr("qid as batch_id", "pid as i", "qid", "pid as pos_pid", "pid + 1 as neg_pid")
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_hot_key_is_split(spark, scored, small_parts, name):
    df = CASES[name](spark, scored)
    result = rows(df.select(*[F.col(c).cast("string") if t.startswith("array") else F.col(c) for c, t in df.dtypes]))
    spread = CASES[name](spark, scored)
    spread.collect()
    assert "skew=true" in spread._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = CASES[name](spark, scored)
        assert rows(again.select(*[F.col(c).cast("string") if t.startswith("array") else F.col(c) for c, t in again.dtypes])) == result
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_pairs_of_a_hot_query_are_sorted_by_several_tasks(scored):
    placed = ranking.place_rows(labelled(scored), [F.desc("score"), F.asc("pid")], ("qid",))
    assert placed.filter("qid = 0").select("_piece").distinct().count() > 1
    got = {r.metric: r.value for r in metrics.pairs_report(labelled(scored), (5, 1000)).collect()}
    lists = {}
    for r in labelled(scored).collect():
        lists.setdefault(r.qid, []).append((-r.score, r.pid, r.label))
    places = [[i for i, x in enumerate(sorted(v), 1) if x[2]] for v in lists.values()]
    assert got["mrr"] == round(sum(1 / p[0] if p else 0 for p in places) / len(places), 6)
    for k in (5, 1000):
        assert got[f"recall_{k}"] == round(sum(sum(x <= k for x in p) / len(p) if p else 0 for p in places) / len(places), 6)


def test_simple_negatives_of_a_hot_query(spark, scored):
    triplets = scored.selectExpr("qid", "pid as pos_pid", "pid % 100 as neg_pid")
    qrels = scored.select("qid", "pid")
    mined = negatives.simple_negatives(triplets, qrels, 8)
    assert mined.join(qrels, [mined.qid == qrels.qid, mined.neg_pid == qrels.pid], "left_semi").count() == 0
    assert mined.groupBy("qid").count().filter("count > 8").count() == 0
    assert mined.filter("qid = 0").count() >= 1


def test_report_of_a_hot_query(scored):
    run = scored.filter("qid < 50").withColumn("rk", F.col("pid").cast("int") + 1)
    report = metrics.eval_report(run, run.filter("pid % 2 = 0"), (5, 40_000)).first()
    assert report.queries_ranked == run.select("qid").distinct().count()
    assert report.recall_40000 > report.recall_5
