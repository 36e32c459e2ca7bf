import random
import re

import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from densekit.operators import prep, word_blocks
from densekit.plans import bundles

TRIPLETS = [(1, 10, 20), (1, 10, 20), (2, 11, 10)]


@pytest.fixture(scope="module")
def triplets(spark):
    return spark.createDataFrame(TRIPLETS, "qid bigint, pos_pid bigint, neg_pid bigint")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, f"text {i}") for i in (1, 2, 3, 10, 11, 20, 30)], "id bigint, text string")


def test_duplicate_triplets_stay(triplets):
    assert prep.triplets_to_pairs(triplets).count() == 6


def test_missing_id_raises_even_if_no_text_is_used(spark, triplets, texts):
    some = texts.filter("id <> 11").withColumnRenamed("id", "pos_pid")
    joined = prep.lookup(triplets, some, "pos_pid")
    with pytest.raises(Exception, match="no row for pos_pid 11"):
        joined.count()
    assert prep.lookup(triplets, some, "pos_pid", strict=False).count() == 2


def test_lookup_keeps_the_column_order(triplets, texts):
    assert prep.lookup(triplets, texts.withColumnRenamed("id", "neg_pid"), "neg_pid").columns == ["qid", "pos_pid", "neg_pid", "text"]


def test_labels_do_not_multiply_pairs(spark):
    run = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1)], "qid bigint, pid bigint, rk int")
    qrels = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (1, 6, 0)], "qid bigint, pid bigint, label int")
    assert rows(prep.label_candidates(run, qrels), "qid", "pid", "label") == [(1, 5, 1), (1, 6, 1), (2, 5, 0)]
    assert rows(prep.label_candidates(run, qrels, min_label=1), "qid", "pid", "label") == [(1, 5, 1), (1, 6, 0), (2, 5, 0)]
    with pytest.raises(Exception, match="no row for qid 2"):
        prep.label_candidates(run, qrels, strict=True).count()
    assert rows(prep.drop_relevant(run, qrels, min_label=1), "qid", "pid", "rk") == [(1, 6, 2), (2, 5, 1)]


def test_bundle_has_each_text_once(triplets, texts):
    bundle = bundles.build_bundle(triplets, texts, texts)
    assert rows(bundle.queries, "id") == [(1,), (2,)]
    assert rows(bundle.passages, "id") == [(10,), (11,), (20,)]
    with pytest.raises(Exception, match="no row for id 11"):
        bundles.build_bundle(triplets, texts, texts.filter("id <> 11")).passages.count()


def test_long_groups_are_sliced_whole(spark):
    qrels = spark.range(1000).selectExpr("if(id < 700, 1, id) as qid", "id as pid")
    lists = prep.group_lists(qrels, slice_rows=50).filter("qid = 1")
    found = sorted((r["start"], r["values"]) for r in lists.collect())
    assert [start for start, _ in found] == list(range(1, 701, 50))
    assert [p for _, values in found for p in values] == list(range(700))


def test_rows_with_one_id_are_tokenised_each(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "c a"), (1, None), (1, "c a")], "id bigint, text string")
    tokens = prep.tokenize(docs, prep.build_vocabulary(docs), None)
    assert sorted(r.tokens for r in tokens.collect()) == [[], [1, 2, 3], [3, 1], [3, 1]]


def test_tokens(spark):
    docs = spark.createDataFrame(
        [(1, "The cat, the CAT & the dog"), (2, ""), (3, "été unknown"), (4, "dog2 dog cat")], "id bigint, text string"
    )
    vocabulary = prep.build_vocabulary(docs).filter("token <> 'unknown'")
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    tokens = {r.id: r.tokens for r in prep.tokenize(docs, vocabulary, None).collect()}
    assert tokens[1] == [ids[w] for w in ("the", "cat", "the", "cat", "the", "dog")]
    assert tokens[2] == [] and tokens[3] == [ids["t"]]
    assert min(ids.values()) == 1 and sorted(ids, key=ids.get) == sorted(ids)


def test_blocks_of_words_do_not_matter(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    docs += [(None, "a b"), (7, None), (7, "A-a É a1"), (8, "k " * 30000)]
    df = spark.createDataFrame(docs, "id bigint, text string")
    vocabulary = prep.build_vocabulary(df).filter("token <> 'bb'")
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    want = sorted((str(i), [ids[w] for w in re.findall("[a-z0-9]+", (t or "").lower())[:50] if w in ids]) for i, t in docs)
    for chars, out in ((1, 3), (500, 1 << 20), (4 << 20, 100)):
        monkeypatch.setattr(word_blocks, "BLOCK_CHARS", chars)
        monkeypatch.setattr(word_blocks, "OUT_TOKENS", out)
        got = prep.tokenize(df.repartition(3), vocabulary, 50).collect()
        assert sorted((str(r.id), r.tokens) for r in got) == want


def test_only_referenced_passages_are_tokenised(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"w{i} x y z") for i in range(9)], "id bigint, text string")
    triplets = spark.createDataFrame([(1, 2, 3), (1, 2, 5)], "qid bigint, pos_pid bigint, neg_pid bigint")
    bundle = bundles.build_token_bundle(triplets, texts, texts, prep.build_vocabulary(texts), 2)
    bundles.save_token_bundle(bundle, f"{tmp_path}/b")
    read = [spark.read.parquet(f"{tmp_path}/b/{part}") for part in ("queries", "passages", "triplets")]
    assert rows(read[0], "id") == [(i,) for i in range(9)] and rows(read[1], "id") == [(2,), (3,), (5,)] and read[2].count() == 2
    assert all(len(r.tokens) == 2 for r in read[1].collect())


def test_padding(spark):
    tokens = spark.createDataFrame([(1, [5, 6]), (2, []), (3, [1, 2, 3, 4, 5])], "id bigint, tokens array<int>")
    got = {r.id: (r.input_ids, r.attention_mask) for r in prep.pad_tokens(tokens, 4).collect()}
    assert got == {1: ([5, 6, 0, 0], [1, 1, 0, 0]), 2: ([0] * 4, [0] * 4), 3: ([1, 2, 3, 4], [1] * 4)}


def test_pairs_without_vector_are_skipped(spark):
    run = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "qid bigint, pid bigint")
    vec = "id bigint, embedding array<float>"
    scored = prep.score_pairs(run, spark.createDataFrame([(1, [1.0, 2.0])], vec), spark.createDataFrame([(5, [3.0, 0.5])], vec))
    assert rows(scored) == [(1, 5, 4.0)]


def test_similarity_can_be_given(spark):
    run = spark.createDataFrame([(1, 1)], "qid bigint, pid bigint")
    vecs = spark.createDataFrame([(1, [3.0, 4.0])], "id bigint, embedding array<float>")
    assert prep.score_pairs(run, vecs, vecs, "cosine").first().score == 1
    assert prep.score_pairs(run, vecs, vecs, lambda a, b: F.size(a) + F.size(b).cast("double")).first().score == 4
    with pytest.raises(ValueError):
        prep.score_pairs(run, vecs, vecs, "tanimoto")


def test_key_overlap(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "qid bigint")
    b = spark.createDataFrame([(2,), (3,), (4,), (4,)], "qid bigint")
    assert rows(prep.key_overlap(a, b, "qid")) == [(2, 3, 1)]
