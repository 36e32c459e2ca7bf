import json

import pytest
from conftest import rows

import __spark_entry__ as entry
from densekit import schemas
from densekit.operators.ranking import with_rank
from densekit.sources import readers, writers


@pytest.fixture
def put(tmp_path):
    def write(text, name="in.txt"):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return write


def test_collection_last_duplicate_wins_and_quotes_are_data(spark, put):
    path = put('1\tfirst\n 2\t"quoted\n1\tsecond  \n')
    assert rows(readers.read_collection(spark, path), "id", "text") == [(1, "second"), (2, '"quoted')]


def test_later_files_win(spark, put, tmp_path):
    put("1\tolder\n" + "".join(f"{i}\tx\n" for i in range(2, 5000)), "a.txt")
    put("1\tnewer\n", "b.txt")
    found = readers.read_collection(spark, str(tmp_path))
    assert found.count() == 4999
    assert found.filter("id = 1").first().text == "newer"


@pytest.mark.parametrize("line", ["3\t", "3\ta\tb", "3", "x\ttext"])
def test_bad_lines_raise_or_are_counted(spark, put, line):
    path = put(f"1\tfine\n{line}\n")
    with pytest.raises(Exception, match="bad line"):
        readers.read_collection(spark, path).count()
    assert rows(readers.read_collection(spark, path, "permissive")) == [(1, "fine")]
    assert rows(readers.bad_lines(spark, path)) == [(1, 2)]
    with pytest.raises(ValueError):
        readers.read_collection(spark, path, "lenient")


def test_collection_query_keeps_null_and_empty_texts(spark, tmp_path):
    texts = ["plain", None, "", " \t\n ", "\\N", "\\", "\\\\x", "a\tb", "N"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["s1_read_collection"](spark, str(tmp_path))
    kept = ["plain", None, "", "", "\\N", "\\", "\\\\x", "a b", "N"]
    assert {(r.id, r.text) for r in found.collect()} == set(enumerate(kept))


@pytest.mark.parametrize("line", ["\t3", "3\ta\tb", "3", "x\t", ""])
def test_bad_lines_of_escaped_collections(spark, put, line):
    path = put(f"1\t\n 2\t \n4\t\\N\n{line}\n")
    with pytest.raises(Exception, match="bad line"):
        readers.read_collection(spark, path, escaped=True).count()
    found = readers.read_collection(spark, path, "permissive", escaped=True)
    assert {(r.id, r.text) for r in found.collect()} == {(1, ""), (2, ""), (4, None)}


def test_bad_lines_of_triplets(spark, put):
    path = put("1\t2\t3\n1\tx\t3\n1\t2\n")
    assert rows(readers.bad_lines(spark, path, schemas.TRIPLETS)) == [(2, 3)]
    assert readers.read_triplets(spark, path, "permissive").count() == 1


def test_qrels_and_runs_split_on_any_white_space(spark, put):
    assert rows(readers.read_qrels(spark, put("1 0 5 1\n1\t0  6\t0\n1 0 5 1\n"))) == [(1, 0, 5, 1), (1, 0, 5, 1), (1, 0, 6, 0)]
    assert rows(readers.read_run_tsv(spark, put("1 9 10\n1\t8\t2\n"))) == [(1, 8, 2), (1, 9, 10)]


def test_triplets(spark, put):
    assert rows(readers.read_triplets(spark, put("1\t2\t3\n1\t2\t3\n"))) == [(1, 2, 3)] * 2


def test_run_json_in_one_object(spark, put):
    lists = {"1": ["7", "5"], "2": [9], "3": []}
    want = [(1, 5, 2), (1, 7, 1), (2, 9, 1)]
    assert rows(readers.read_run_json(spark, put(json.dumps(lists)))) == want
    assert rows(readers.read_run_json(spark, put(json.dumps(lists, indent=1)), wholetext=True)) == want


def test_one_object_is_many_tasks(spark, tmp_path):
    lists = {str(q): [str(q * 1000 + i) for i in range(200)] for q in range(4000)}
    lists["4001"] = []
    for name, text in (("compact", json.dumps(lists)), ("spread", json.dumps(lists, indent=2)), ("two", json.dumps(lists) + "\n" + '{"5000": [1, 2]}\n{}\n')):
        (tmp_path / name).write_text(text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        try:
            run = readers.read_run_json(spark, f"{tmp_path}/{name}", wholetext=True)
            assert run.rdd.getNumPartitions() > 4
            got = run.groupBy("qid").agg({"pid": "sum", "rk": "max"}).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        want = [(q, sum(map(int, lists[str(q)])), 200) for q in range(4000)] + [(5000, 3, 2)] * (name == "two")
        assert sorted((r.qid, r["sum(pid)"], r["max(rk)"]) for r in got) == sorted(want)


def test_objects_are_written_by_many_tasks(spark, tmp_path):
    run = spark.range(20_000).selectExpr("id div 5 as qid", "id as pid", "cast(id % 5 + 1 as int) as rk")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_run_object(run, f"{tmp_path}/run")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [json.loads(f.read_text()) for f in (tmp_path / "run").glob("part-*")]
    assert len(files) == 8 and max(map(len, files)) < 1000  # each a valid object with its share of the lists
    assert rows(readers.read_run_json(spark, f"{tmp_path}/run", wholetext=True), "qid", "pid", "rk") == rows(run)
    writers.write_run_object(run.limit(0), f"{tmp_path}/none")
    assert readers.read_run_json(spark, f"{tmp_path}/none", wholetext=True).count() == 0


def test_no_query_writes_through_one_task(spark, tmp_path, monkeypatch):
    from catalog import storage
    from catalog.registry import QUERIES
    from catalog.views import Views

    spark.range(8000).selectExpr(
        "id div 4 as l_orderkey", "id as l_partkey", "cast(id % 97 as double) as l_extendedprice"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = []
    monkeypatch.setattr(storage, "new_path", lambda spark, name: made.append(f"{tmp_path}/{name}") or made[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert QUERIES["s5_read_run_object"](Views(spark, str(tmp_path))).count() == 8000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len([*(tmp_path / "object").glob("part-*")]) > 1


@pytest.mark.parametrize("bad", ['{"1": [1], "2" [3]}', '{"1": [1, {}]}', '{"1": [1 2]}', '[["1"]]', '{"1": [1]} x', '{"1": ["a"]}', '{"1": [[1], [2]]}'])
def test_malformed_objects_raise(spark, tmp_path, bad):
    (tmp_path / "bad").write_text(bad)
    with pytest.raises(Exception):
        readers.read_run_json(spark, f"{tmp_path}/bad", wholetext=True).collect()


def test_run_json_round_trip_with_sliced_lists(spark, tmp_path):
    run = spark.range(1000).selectExpr("if(id < 700, 1, id) as qid", "id as pid", "cast(id * 31 % 89 as double) as score")
    run = with_rank(run).select("qid", "pid", "rk")
    writers.write_run_json(run, f"{tmp_path}/run", slice_rows=100)
    assert rows(readers.read_run_json(spark, f"{tmp_path}/run"), "qid", "pid", "rk") == rows(run)
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/run").collect()]
    assert max(len(v) for line in lines for v in line.values()) == 100
    assert {"1@1", "1@101", "1@601", "999@1"} <= {k for line in lines for k in line}
    writers.write_run_json(run, f"{tmp_path}/whole")
    assert rows(readers.read_run_json(spark, f"{tmp_path}/whole"), "qid", "pid", "rk") == rows(run)
    whole = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/whole").collect()]
    assert max(len(v) for line in whole for v in line.values()) == 700 and {"1", "999"} <= {k for line in whole for k in line}


def test_run_tsv_round_trip(spark, tmp_path):
    run = spark.createDataFrame([(1, 5, 1), (1, 3, 2)], schemas.RUN)
    writers.write_run_tsv(run, f"{tmp_path}/run")
    assert rows(readers.read_run_tsv(spark, f"{tmp_path}/run")) == rows(run)
    assert {r.value for r in spark.read.text(f"{tmp_path}/run").collect()} == {"1\t5\t1", "1\t3\t2"}


def test_texts_that_would_break_a_line_are_refused(spark, tmp_path):
    for i, text in enumerate(("two\nlines", "a\ttab")):
        with pytest.raises(Exception, match="tab or line break in column text"):
            writers.write_tsv(spark.createDataFrame([(1, text)], schemas.COLLECTION), f"{tmp_path}/{i}")


def test_awkward_texts_survive_tsv(spark, tmp_path):
    texts = spark.createDataFrame([(1, '"quoted" \\ back'), (2, "  inner  blanks "), (3, "#not a comment"), (4, "'")], schemas.COLLECTION)
    writers.write_tsv(texts, f"{tmp_path}/t")
    back = readers.read_collection(spark, f"{tmp_path}/t")
    assert rows(back, "id", "text") == [(i, t.strip() if i != 2 else "  inner  blanks") for i, t in rows(texts)]
    assert rows(readers.read_tsv(spark, f"{tmp_path}/t", schemas.COLLECTION), "id", "text") == rows(texts)


def test_labels_both_ways(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, -1)], schemas.LABELS)
    writers.write_labels(labels, str(tmp_path))
    assert rows(readers.read_labels(spark, f"{tmp_path}/by_label"), "qid", "label") == rows(labels)
    assert rows(spark.read.schema(schemas.LABELS).json(f"{tmp_path}/by_query")) == rows(labels)


def test_embedding_reader_reads_two_columns(spark):
    plan = readers.read_embeddings(spark, "/root/testdata/sf0.001/embeddings.parquet", "vec_id")
    assert "label" not in plan._jdf.queryExecution().executedPlan().toString()
