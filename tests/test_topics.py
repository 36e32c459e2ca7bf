import numpy as np
import pytest
from conftest import rows

from densekit.operators import topics

LABELS = "qid bigint, label int"


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    points = [rng.normal(c, 0.1, size=8) for c in (0, 10) for _ in range(50)] + [rng.normal(100, 0.1, size=8) for _ in range(3)]
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, embedding array<double>")


def test_small_clusters_are_noise(blobs):
    labels = dict(rows(topics.cluster(blobs, 3), "qid", "label"))
    assert {labels[i] for i in (100, 101, 102)} == {-1}
    assert len({labels[i] for i in range(50)}) == 1 and len({labels[i] for i in range(100)}) == 2


def test_far_points_are_noise_before_sizes_count(spark):
    assigned = spark.createDataFrame([(i, 0, 0.1 * i) for i in range(10)] + [(20, 1, 0.0)], "qid bigint, label int, dist double")
    assert dict(rows(topics.mark_noise(assigned, 1, 0.45))) == {**{i: 0 if i < 5 else -1 for i in range(10)}, 20: 1}
    assert {v for _, v in rows(topics.mark_noise(assigned, 6, 0.45))} == {-1}


def test_reduction(blobs):
    reduced = topics.reduce_dimensions(blobs, 2)
    assert rows(reduced, "id") == rows(blobs, "id")
    first = {r.id: r.embedding[0] for r in reduced.collect()}
    assert abs(first[0] - first[1]) < 2 < abs(first[0] - first[60])


def test_members_and_noise(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, -1)], LABELS)
    assert rows(topics.cluster_members(labels), "label", "values") == [(0, [1, 2]), (1, [3])]
    assert rows(topics.cluster_members(labels, legacy=True), "label", "values") == [(1, [3])]
    members, noise = topics.split_noise(labels)
    assert rows(members, "qid") == [(1,), (2,), (3,)] and rows(noise, "qid") == [(4,)]


def test_preview(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(99, -1)], LABELS)
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "id bigint, text string")
    assert rows(topics.cluster_preview(labels, texts, n=2), "label", "qid") == [(0, 0), (0, 2), (1, 1), (1, 3)]
    assert rows(topics.cluster_preview(labels, texts, [1], 1), "label", "text") == [(1, "t1")]
