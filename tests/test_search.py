import numpy as np
import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from densekit.operators import ivf, knn, packed, pq
from densekit.plans import retrieval

K = 15


@pytest.fixture(scope="module")
def exact(vecs):
    return knn.knn_exact(vecs, vecs, K).cache()


def test_scan_equals_numpy(vecs, exact):
    data = sorted(vecs.collect())
    m = np.array([r.embedding for r in data], dtype=np.float64)
    s = np.round(m @ m.T, 6)
    for q in (0, 17, 499):
        want = sorted(range(len(m)), key=lambda d: (-s[q, d], d))[:K]
        got = [r.pid for r in exact.filter(F.col("qid") == q).orderBy("rk").collect()]
        assert got == want


def test_blocks_equal_scan(vecs, exact, monkeypatch):
    monkeypatch.setattr(knn, "PART_BYTES", 64 * 90)
    monkeypatch.setattr(knn, "GROUP_RESULTS", 200 * K)
    monkeypatch.setattr(packed, "BLOCK_ROWS", 60)
    same(knn.knn_exact(vecs, vecs, K, blocks=True), exact)


def test_many_queries_take_the_block_way(vecs, exact, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 100)
    assert knn.small_table(knn.as_queries(vecs), K) is None
    same(knn.knn_exact(vecs, vecs, K), exact)


def test_partitioning_does_not_matter(vecs, exact):
    same(knn.knn_exact(vecs, vecs.repartition(7), K), exact)


def test_l2_orders_unit_vectors_like_inner_product(vecs, exact):
    l2 = knn.knn_exact(vecs, vecs, 1, "l2")
    assert l2.filter("qid = pid and score = 0").count() == vecs.count()


def test_ties_and_short_corpus(spark):
    docs = spark.createDataFrame([(7, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [0.0, 1.0])], "id bigint, embedding array<float>")
    query = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, embedding array<float>")
    for blocks in (False, True):
        found = knn.knn_exact(query, docs, 1000, blocks=blocks)
        assert rows(found, "rk", "pid") == [(1, 3), (2, 7), (3, 5)]
        assert rows(knn.knn_exact(query, docs, 1, blocks=blocks), "pid") == [(3,)]


def test_no_queries(spark, vecs):
    assert knn.knn_exact(vecs.filter("id < 0"), vecs, 3).count() == 0


@pytest.fixture(scope="module")
def index(vecs):
    built = ivf.ivf_build(vecs, nlist=8, fraction=0.5)
    built.blocks.cache()
    return built


def test_every_document_is_in_one_cell(vecs, index):
    assert rows(index.postings, "pid") == rows(vecs, "id")


def test_all_cells_give_the_exact_result(vecs, exact, index):
    for blocks in (False, True):
        same(ivf.ivf_search(vecs, index, K, 8, blocks=blocks), exact)


def test_blocks_equal_scan_within_cells(vecs, index, monkeypatch):
    scan = ivf.ivf_search(vecs, index, K, 3)
    monkeypatch.setattr(ivf, "PART_ROWS", 40)
    monkeypatch.setattr(packed, "BLOCK_ROWS", 30)
    same(ivf.ivf_search(vecs, index, K, 3, blocks=True), scan)


def test_recall_grows_with_nprobe(vecs, exact, index):
    found = [ivf.ivf_search(vecs, index, K, n).join(exact, ["qid", "pid"], "left_semi").count() for n in (1, 2, 4, 8)]
    assert found == sorted(found) and found[0] < found[-1] == exact.count()


def test_zero_vectors_are_indexed_too(spark, vecs):
    zeros = spark.createDataFrame([(1000 + i, [0.0] * 64) for i in range(5)], "id bigint, embedding array<float>")
    both = vecs.unionByName(zeros)
    index = ivf.ivf_build(both, nlist=4, fraction=1.0)
    same(ivf.ivf_search(both, index, 3, 4), knn.knn_exact(both, both, 3))


def test_nprobe_must_be_positive(vecs, index):
    with pytest.raises(ValueError):
        ivf.ivf_search(vecs, index, K, 0)


def test_saved_index_reads_only_visited_cells(spark, vecs, index, tmp_path):
    index.save(f"{tmp_path}/ivf")
    loaded = ivf.IvfIndex.load(spark, f"{tmp_path}/ivf")
    same(ivf.ivf_search(vecs, loaded, K, 2), ivf.ivf_search(vecs, index, K, 2))
    one = vecs.filter("id = 3")
    plan = ivf.ivf_search(one, loaded, K, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan


def test_finer_codes_lose_less(vecs):
    errors = [
        pq.coding_error(vecs, pq.ivfpq_build(vecs, nlist=4, m=m, nbits=nbits, fraction=1.0)).first().mse
        for m, nbits in ((4, 2), (4, 4), (8, 4))
    ]
    assert errors == sorted(errors, reverse=True)


def test_coded_search_by_blocks_and_from_disk(spark, vecs, tmp_path):
    index = pq.ivfpq_build(vecs, nlist=4, m=8, nbits=3, fraction=0.5)
    scan = pq.ivfpq_search(vecs, index, K, 2)
    same(pq.ivfpq_search(vecs, index, K, 2, blocks=True), scan)
    index.save(f"{tmp_path}/pq")
    same(pq.ivfpq_search(vecs, pq.IvfPqIndex.load(spark, f"{tmp_path}/pq"), K, 2), scan)


def test_dimension_must_divide(vecs):
    with pytest.raises(ValueError, match="divisible"):
        pq.ivfpq_build(vecs, nlist=2, m=7, nbits=2, fraction=0.5)


def test_unknown_names_raise(vecs):
    with pytest.raises(ValueError):
        retrieval.knn(vecs, vecs, 3, "hnsw")
    with pytest.raises(ValueError):
        knn.knn_exact(vecs, vecs, 3, "cosine")


def test_comparison_has_a_row_per_configuration(vecs):
    qrels = vecs.selectExpr("id as qid", "id as pid")
    got = {(r.method, r.nprobe): r for r in retrieval.compare_indexes(vecs, vecs, qrels, k=10).collect()}
    assert set(got) == {("exact", 0), ("ivf", 1), ("ivf", 4), ("ivfpq", 1), ("ivfpq", 4)}
    assert got["exact", 0].overlap == 1 and got["exact", 0].mrr_10 == 1
    assert got["ivf", 1].overlap <= got["ivf", 4].overlap <= 1
    assert 0 < got["ivfpq", 4].bytes_on_disk < got["ivf", 4].bytes_on_disk


@pytest.mark.parametrize("bad", [[1.0], [1.0, float("nan")], None, [1.0, None]])
def test_vectors_without_a_place_in_the_order_raise(spark, bad):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, bad), (3, [0.0, 1.0])], "id bigint, embedding array<double>").coalesce(1)
    query = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, embedding array<double>")
    with pytest.raises(Exception, match="vector"):
        knn.knn_exact(query, docs, 3).count()


def test_work_of_a_join_is_dealt_to_many_tasks(spark, monkeypatch):
    """What meets under one key is bounded, and keys are not put together by their few bytes."""
    monkeypatch.setattr(packed, "BLOCK_ROWS", 50)
    monkeypatch.setattr(packed, "LEAST_WORK", 1 << 18)
    monkeypatch.setattr(packed, "TASK_WORK", 1 << 18)
    rng = np.random.default_rng(3)
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))], "id long, embedding array<float>")
    keys, meet = [], packed.meet

    def recorded(left, right, on, *rest):
        met = left.join(right, on).groupBy(*on).agg(F.sum(F.length(left["ids"]) / 8 * F.length(right["data"]) / 4).alias("work"))
        keys.append([r.work for r in met.collect()])
        return meet(left, right, on, *rest)

    monkeypatch.setattr(knn, "meet", recorded)
    monkeypatch.setattr(ivf, "meet", recorded)
    assert rows(knn.knn_exact(vecs, vecs, 5, blocks=True)) == rows(knn.knn_exact(vecs, vecs, 5))
    assert len(keys[-1]) >= 8 and max(keys[-1]) <= 8 * (1 << 18)
    centroids = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2, 8)))], "list_id int, centroid array<double>")
    index = ivf.ivf_from_centroids(vecs, centroids)
    assert rows(ivf.ivf_search(vecs, index, 5, 2, blocks=True)) == rows(ivf.ivf_search(vecs, index, 5, 2))
    assert len(keys[-1]) >= 8


def test_long_lists_are_not_sent_once_a_part(spark, monkeypatch):
    """With long lists the queries are cut, evenly, and not the documents: each query has one list, and no floors are looked for first."""
    monkeypatch.setattr(packed, "BLOCK_ROWS", 50)
    monkeypatch.setattr(packed, "LEAST_WORK", 1 << 18)
    monkeypatch.setattr(packed, "TASK_WORK", 1 << 18)
    rng = np.random.default_rng(5)
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))], "id long, embedding array<float>")
    groups, sent, meet = [], [], packed.meet

    def recorded(left, right, on, *rest):
        sizes = left.groupBy(*on).agg((F.sum(F.length("ids")) / 8).cast("int").alias("n")).collect()
        groups.append([r.n for r in sizes])
        found = meet(left, right, on, *rest)
        sent.append(found.count())
        return found

    monkeypatch.setattr(knn, "meet", recorded)
    assert rows(knn.knn_exact(vecs, vecs, 100, blocks=True)) == rows(knn.knn_exact(vecs, vecs, 100))
    assert sent == [600 * 100]
    assert sum(groups[0]) == 600 and len(groups[0]) >= 8 and max(groups[0]) <= 2 * min(groups[0])
