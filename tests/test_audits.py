import numpy as np
import pytest
from conftest import rows, same

from densekit.operators import audits

LAYOUT = "batch_id bigint, i bigint, q_vec array<double>, pos_vec array<double>, neg_vec array<double>"
SIZES = {7: 30, 8: 1, 9: 4}  # one batch holds most of the rows


def made(spark, seed):
    rng = np.random.default_rng(seed)
    data = {b: rng.normal(size=(3, n, 5)) for b, n in SIZES.items()}
    table = [(b, i, *(m[part, i].tolist() for part in range(3))) for b, m in data.items() for i in range(SIZES[b])]
    return data, spark.createDataFrame(table, LAYOUT)


@pytest.fixture(scope="module")
def batches(spark):
    return made(spark, 1), made(spark, 2)


def cos(m):
    q, d = m[0], np.concatenate([m[1], m[2]])
    return (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T


def soft(x):
    e = np.exp(x)
    return e / e.sum(axis=1, keepdims=True)


def check(df, expected):
    got = dict(rows(df, "batch_id", "value"))
    assert got == pytest.approx(expected, abs=2e-6)


@pytest.mark.parametrize("tile", [4, 1024])
def test_against_numpy(batches, tile):
    (s_data, student), (t_data, teacher) = batches
    s, t = ({b: cos(m) for b, m in data.items()} for data in (s_data, t_data))
    check(
        audits.in_batch_softmax(student, tile=tile),
        {b: float(np.mean(-np.log(np.diag(soft(20 * s[b]))))) for b in SIZES},
    )
    check(audits.score_gap(student, teacher, tile=tile), {b: float(np.mean((t[b] - s[b]) ** 2)) for b in SIZES})
    p, q = ({b: soft(x[b] / 0.3) for b in SIZES} for x in (t, s))
    check(
        audits.kl_agreement(student, teacher, 0.3, tile=tile),
        {b: float(np.mean((p[b] * (np.log(p[b]) - np.log(q[b]))).sum(axis=1))) for b in SIZES},
    )
    check(
        audits.listnet_agreement(student, teacher, 0.3, tile=tile),
        {b: float(np.mean(-(p[b] * np.log(q[b] + 1e-6)).sum(axis=1))) for b in SIZES},
    )


def test_two_by_two_with_equal_sides(spark):
    vec = [[1.0, 1.0], [2.0, 2.0]]
    table = spark.createDataFrame([(0, i, v, v, v) for i, v in enumerate(vec)], LAYOUT)
    assert audits.score_gap(table, table).first().value == 0
    assert audits.kl_agreement(table, table).first().value == 0
    assert audits.in_batch_softmax(table).first().value == pytest.approx(np.log(4), abs=1e-6)


def test_margin_by_distance(batches):
    data, student = batches[0]
    gap = {b: np.linalg.norm(m[0] - m[1], axis=1) - np.linalg.norm(m[0] - m[2], axis=1) for b, m in data.items()}
    check(audits.triplet_margin(student, 0.5), {b: float(np.maximum(g + 0.5, 0).mean()) for b, g in gap.items()})
    gap = {b: np.abs(m[0] - m[1]).sum(axis=1) - np.abs(m[0] - m[2]).sum(axis=1) for b, m in data.items()}
    check(audits.triplet_margin(student, 0.0, "manhattan"), {b: float(np.maximum(g, 0).mean()) for b, g in gap.items()})


def test_similarity_by_name_or_function(batches):
    student = batches[0][1]
    same(audits.in_batch_softmax(student, scale=1.0, similarity="dot"), audits.in_batch_softmax(student, scale=1.0, similarity=lambda q, d: q @ d.T))


def test_unknown_names_raise(batches):
    student = batches[0][1]
    for call in (
        lambda: audits.triplet_margin(student, 1.0, "hamming"),
        lambda: audits.agreement(student, student, "huber"),
        lambda: audits.in_batch_softmax(student, similarity="tanimoto"),
    ):
        with pytest.raises(ValueError, match="unknown"):
            call()


def test_weighted_sum(batches):
    student, teacher = batches[0][1], batches[1][1]
    parts = [dict(rows(f, "batch_id", "value")) for f in (audits.in_batch_softmax(student), audits.agreement(student, teacher, "mse"))]
    check(audits.weighted_audit(student, teacher, "mse", 2.0, 0.5), {b: 2 * parts[0][b] + 0.5 * parts[1][b] for b in SIZES})


def test_softmax_sums_to_one(spark):
    scored = spark.range(300).selectExpr("if(id % 3 = 0, 0, id % 10) as qid", "id as pid", "cast(id * 10 as double) as score")
    sums = audits.softmax(scored, 50.0).groupBy("qid").sum("p").collect()
    assert all(r[1] == pytest.approx(1, abs=1e-3) for r in sums)


def test_pair_cross_entropy(spark):
    pairs = spark.createDataFrame([([0.0, 0.0], 1), ([1000.0, -1000.0], 0)], "logits array<double>, label int")
    row = audits.pair_cross_entropy(pairs).first()
    assert row.value == pytest.approx(np.log(2) / 2, abs=1e-6) and row.pairs == 2


def test_weighted_sum_passes_options_to_both_parts(batches):
    student, teacher = batches[0][1], batches[1][1]
    options = dict(similarity="dot", tile=2)
    only = {r.batch_id: r.value for r in audits.in_batch_softmax(student, **options).collect()}
    check(audits.weighted_audit(student, teacher, "mse", 1.0, 0.0, **options), only)
