import random

import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from densekit.operators import knn, negatives, prep
from densekit.plans import mining

VEC = "id bigint, embedding array<double>"


@pytest.fixture(scope="module")
def case(spark):
    """One query holds a third of the triplets and of the candidates."""
    rng = random.Random(3)
    queries = spark.createDataFrame([(q, [rng.gauss(0, 1) for _ in range(4)]) for q in range(20)], VEC)
    docs = spark.createDataFrame([(d, [rng.gauss(0, 1) for _ in range(4)]) for d in range(200)], VEC)
    trip = [(q if t % 3 else 0, rng.randrange(200), rng.randrange(200)) for t, q in enumerate(rng.choices(range(20), k=300))]
    triplets = spark.createDataFrame(trip, "qid bigint, pos_pid bigint, neg_pid bigint")
    lists = [(q, p, i + 1) for q in range(20) for i, p in enumerate(rng.sample(range(200), 150 if q == 0 else 15))]
    run = spark.createDataFrame(lists, "qid bigint, pid bigint, rk int")
    qrels = triplets.selectExpr("qid", "pos_pid as pid")
    return triplets, run, qrels, queries, docs


def walked(case):
    """Brute force: pop candidates from the end until one beats the old negative."""
    triplets, run, qrels, queries, docs = case
    q, d = ({r.id: r.embedding for r in t.collect()} for t in (queries, docs))
    relevant = set(rows(qrels))

    def score(qid, pid):
        return round(sum(a * b for a, b in zip(q[qid], d[pid])), 6)

    lists = {}
    for qid, pid, _ in sorted(rows(run), key=lambda r: (r[0], r[2])):
        if (qid, pid) not in relevant:
            lists.setdefault(qid, []).append(pid)
    out = []
    for qid, pos, neg in rows(triplets):
        for pid in reversed(lists.get(qid, [])):
            if score(qid, pid) > score(qid, neg):
                out.append((qid, pos, pid))
                break
    return sorted(out)


def test_hard_negatives_equal_the_walk(case):
    mined = negatives.hard_negatives(*case)
    assert rows(mined, "qid", "pos_pid", "neg_pid") == walked(case)


def test_hard_negatives_beat_the_old_ones_and_are_not_relevant(case):
    triplets, run, qrels, queries, docs = case
    for pick in ("last", "hardest"):
        mined = negatives.hard_negatives(*case, pick=pick)
        assert mined.filter("new_score <= old_score").count() == 0
        assert mined.selectExpr("qid", "neg_pid as pid").join(qrels, ["qid", "pid"], "left_semi").count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(*case, pick="first")


def test_scores_brought_along_are_used(case):
    triplets, run, qrels, queries, docs = case
    scored = prep.score_pairs(run, queries, docs)
    same(negatives.hard_negatives(triplets, scored, qrels, queries, docs), negatives.hard_negatives(*case))


def test_equal_score_is_not_enough(spark):
    vec = spark.createDataFrame([(1, [1.0]), (2, [0.5]), (3, [0.5]), (4, [0.2])], VEC)
    triplets = spark.createDataFrame([(1, 1, 2)], "qid bigint, pos_pid bigint, neg_pid bigint")
    run = spark.createDataFrame([(1, 3, 1), (1, 4, 2)], "qid bigint, pid bigint, rk int")
    qrels = spark.createDataFrame([(1, 1)], "qid bigint, pid bigint")
    assert negatives.hard_negatives(triplets, run, qrels, vec, vec).count() == 0


def test_simple_negatives_are_limited_by_the_supply(spark):
    triplets = spark.createDataFrame([(1, i, 100 + i) for i in range(5)], "qid bigint, pos_pid bigint, neg_pid bigint")
    qrels = spark.createDataFrame([(1, 0)], "qid bigint, pid bigint")
    mined = negatives.simple_negatives(triplets, qrels, 3)
    assert 1 <= mined.count() <= 3
    assert mined.filter("neg_pid = 0").count() == 0
    assert mined.select("pos_pid").distinct().count() == mined.count()


def test_mining_by_search(case):
    triplets, _, qrels, queries, docs = case
    run = knn.knn_exact(queries, docs, 30)
    by_plan = mining.mine_hard_negatives(triplets, qrels, queries, docs, k=30, method="exact")
    same(by_plan, negatives.hard_negatives(triplets, run.drop("score"), qrels, queries, docs))


def test_mined_bundle(case):
    triplets, _, qrels, queries, docs = case
    texts = docs.select("id", F.concat(F.lit("t"), "id").alias("text"))
    bundle = mining.mined_bundle(triplets, qrels, queries, docs, texts, texts, k=30, method="exact")
    used = bundle.rows.selectExpr("inline(array(struct(pos_pid as id), struct(neg_pid as id)))").distinct()
    assert rows(bundle.passages, "id") == rows(used)


def test_missing_vectors_are_reported_or_raise(case):
    triplets, run, qrels, queries, docs = case
    few = docs.filter("id % 10 <> 3")
    lost = triplets.filter("neg_pid % 10 = 3").count()
    mined = negatives.hard_negatives(triplets, run, qrels, queries, few)
    summary = negatives.mining_summary(triplets, mined, queries, few).first()
    assert (summary.triplets, summary.unscored) == (triplets.count(), lost) and lost > 0
    with pytest.raises(Exception, match="no row for"):
        negatives.hard_negatives(triplets, run, qrels, queries, few, strict=True).count()


def test_last_above_with_ties_and_a_hot_query(spark):
    """Thousands of events of one query, many of equal score, cut into ranges."""
    rng = random.Random(9)
    cands = [(q, r + 1, 1000 * q + r, rng.randint(0, 40) / 4) for q, n in ((1, 5000), (2, 3), (3, 40)) for r in range(n)]
    olds = [(rng.choice([1, 1, 1, 2, 3, 4]), i, rng.randint(-4, 44) / 4) for i in range(4000)]
    thresholds = spark.createDataFrame([(q, float(s), i) for q, i, s in olds], "qid bigint, old_score double, tid bigint")
    candidates = spark.createDataFrame(cands, "qid bigint, rk int, pid bigint, score double")
    got = negatives.last_above(thresholds, candidates)
    want = []
    for q, i, s in olds:
        above = [c for c in cands if c[0] == q and c[3] > s]
        if above:
            want.append((i, max(above, key=lambda c: c[1])[2]))
    assert sorted((r.tid, r._new.pid) for r in got.collect()) == sorted(want) and len(want) > 1000
