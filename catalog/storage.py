"""Readers and writers: whole tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.evaluation import _TOPICS, _marked
from catalog.preparation import SAMPLE, TOKENS, VOCABULARY, _picked
from catalog.registry import query
from catalog.views import Views, sql
from densekit import schemas
from densekit.operators import prep, sampling
from densekit.plans.bundles import build_dev_bundle, build_token_bundle, save_dev_bundle, save_token_bundle
from densekit.session import new_path
from densekit.sources import readers, writers

ONE_LINE = "trim(regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g'))"


def _lines(v: Views):
    """Documents with their line breaks turned into blanks."""
    return v.documents.select("id", F.trim(F.regexp_replace("text", r"[\t\r\n]+", " ")).alias("text"))


def _written(v: Views, name: str, write, df) -> str:
    path = new_path(v.spark, name)
    write(df, path)
    return path


@query("s1_read_collection", f"select doc_id as id, {ONE_LINE} as text from documents")
def _(v: Views):
    path = new_path(v.spark, "collection")
    writers.write_tsv(_lines(v), path, escaped=True)
    return readers.read_collection(v.spark, path, escaped=True)


@query("s2_read_triplets", sql("select * from triplets", "triplets"))
def _(v: Views):
    return readers.read_triplets(v.spark, _written(v, "triplets", writers.write_tsv, v.triplets))


@query("s4_read_qrels", sql("select * from qrels", "qrels"))
def _(v: Views):
    return readers.read_qrels(v.spark, _written(v, "qrels", writers.write_tsv, v.qrels))


@query("p8_id_normalisation", sql("select distinct qid, pid from qrels", "qrels"))
def _(v: Views):
    texts = v.qrels.select(*(F.col(c).cast("string").alias(c) for c in ("qid", "iter", "pid", "label")))
    return readers.read_qrels(v.spark, _written(v, "ids", writers.write_tsv, texts)).select("qid", "pid").distinct()


@query("s5_read_run_json", sql("select * from run", "run"))
def _(v: Views):
    return readers.read_run_json(v.spark, _written(v, "lists", writers.write_run_json, v.run))


@query("s5_read_run_object", sql("select * from run", "run"))
def _(v: Views):
    path = _written(v, "object", writers.write_run_object, v.run)
    return readers.read_run_json(v.spark, path, wholetext=True)


@query("k2_write_run_json", sql("select * from run", "run"))
def _(v: Views):
    path = new_path(v.spark, "run")
    writers.write_run_json(v.run, path, slice_rows=2)
    return readers.read_run_json(v.spark, path)


@query("s6_read_run_tsv", sql("select * from run", "run"))
def _(v: Views):
    return readers.read_run_tsv(v.spark, _written(v, "run", writers.write_run_tsv, v.run))


@query("k3_write_run_tsv", sql("select concat(qid, '|', pid, '|', rk) as line from run", "run"))
def _(v: Views):
    lines = v.spark.read.text(_written(v, "run", writers.write_run_tsv, v.run))
    return lines.select(F.regexp_replace("value", "\t", "|").alias("line"))


@query("s7_read_named_tsv", sql(
    "select r.qid, r.pid, q.text as query, p.text as passage from run r join order_texts q on q.id = r.qid join part_texts p on p.id = r.pid",
    "run", "order_texts", "part_texts"))
def _(v: Views):
    pairs = prep.hydrate_pairs(v.run.select("qid", "pid"), v.order_texts, v.part_texts)
    path = _written(v, "first-stage", writers.write_tsv, pairs)
    return readers.read_tsv(v.spark, path, schemas.FIRST_STAGE_TSV)


@query("s8_read_embeddings", sql(
    "select vec_id as id, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as x from embeddings"))
def _(v: Views):
    vecs = readers.read_embeddings(v.spark, f"{v.sf_dir}/embeddings.parquet", "vec_id")
    return _elements(vecs)


def _elements(vecs):
    rows = vecs.select("id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("id", (F.col("pos").cast("bigint") + 1).alias("pos"), F.col("x").cast("double").alias("x"))


@query("k5_write_embeddings", sql(
    "select vec_id as id, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as x from embeddings"))
def _(v: Views):
    return _elements(readers.read_embeddings(v.spark, _written(v, "vectors", writers.write_embeddings, v.vecs)))


@query("k6_write_tokens", sql("select id, pos, cast(token_id as integer) as token_id from tokens", vocabulary=VOCABULARY, tokens=TOKENS))
def _(v: Views):
    tokens = prep.tokenize(v.documents, prep.build_vocabulary(v.documents), max_len=None)
    rows = readers.read_tokens(v.spark, _written(v, "tokens", writers.write_tokens, tokens))
    rows = rows.select("id", F.posexplode("tokens").alias("pos", "token_id"))
    return rows.select("id", (F.col("pos").cast("bigint") + 1).alias("pos"), "token_id")


_BOTH_TEXTS = "(select text from order_texts union all select text from part_texts)"
_CUT = 4  # words kept: fewer than most of these texts have


def _bundle_tokens(kind: str, texts: str) -> str:
    words = f"regexp_extract_all(lower(text), '[a-z0-9]+')[1:{_CUT}]"
    return (
        f"select '{kind}' as kind, id, pos, cast(token_id as integer) as token_id from (select id, unnest({words}) as token,"
        f" unnest(range(1, len({words}) + 1)) as pos from {texts}) join words using (token)"
    )


@query("k6_token_bundle", sql(
    _bundle_tokens("query", "order_texts") + " union all " + _bundle_tokens(
        "passage", "(select * from part_texts where id in (select pos_pid from triplets union select neg_pid from triplets))"),
    "triplets", "order_texts", "part_texts", words="select token, row_number() over (order by token) as token_id from"
    f" (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from {_BOTH_TEXTS})"))
def _(v: Views):
    vocabulary = prep.build_vocabulary(v.order_texts.unionByName(v.part_texts))
    path = new_path(v.spark, "token-bundle")
    save_token_bundle(build_token_bundle(v.triplets, v.order_texts, v.part_texts, vocabulary, _CUT), path)
    kinds = (("query", "queries"), ("passage", "passages"))
    parts = [readers.read_tokens(v.spark, f"{path}/{folder}").withColumn("kind", F.lit(kind)) for kind, folder in kinds]
    rows = parts[0].unionByName(parts[1]).select("kind", "id", F.posexplode("tokens").alias("pos", "token_id"))
    return rows.withColumn("pos", F.col("pos").cast("bigint") + 1)


@query("k1_write_bundle", sql(
    "select 'triplet' as kind, qid as id, concat(pos_pid, ' ', neg_pid) as text from triplets"
    " union all select 'query', id, text from order_texts where id in (select qid from triplets)"
    " union all select 'passage', id, text from part_texts where id in (select pos_pid from triplets union select neg_pid from triplets)",
    "triplets", "order_texts", "part_texts"))
def _(v: Views):
    path = new_path(v.spark, "bundle")
    writers.write_bundle(v.triplets, v.order_texts, v.part_texts, path)
    return _bundle_rows(v, path, "triplet", v.spark.read.schema(schemas.TRIPLETS).parquet(f"{path}/triplets").selectExpr(
        "qid as id", "concat(pos_pid, ' ', neg_pid) as text"))


def _bundle_rows(v: Views, path: str, kind: str, rows):
    out = rows.withColumn("kind", F.lit(kind))
    for name, folder in (("query", "queries"), ("passage", "passages")):
        texts = v.spark.read.schema(schemas.COLLECTION).parquet(f"{path}/{folder}")
        out = out.unionByName(texts.withColumn("kind", F.lit(name)))
    return out


@query("k4_write_tsv_subset", sql("select * from triplets where qid in (select qid from picked)", "triplets", picked=_picked("triplets", 400, 1)))
def _(v: Views):
    return readers.read_tsv(v.spark, _written(v, "tier", writers.write_tsv, sampling.triplet_tier(v.triplets, 400)), schemas.TRIPLETS)


@query("k7_write_sampled_candidates", sql(
    "select 'candidate' as kind, qid as id, concat(pid, ' ', rk) as text from run where qid in (select qid from picked)"
    " union all select 'query', id, text from order_texts where id in (select qid from picked)"
    " union all select 'passage', id, text from part_texts where id in (select pid from run where qid in (select qid from picked))",
    "run", "order_texts", "part_texts", picked=_picked("run", SAMPLE, 1)))
def _(v: Views):
    path = new_path(v.spark, "dev")
    save_dev_bundle(build_dev_bundle(v.run, v.order_texts, v.part_texts, SAMPLE), path)
    rows = readers.read_run_json(v.spark, f"{path}/candidates").selectExpr("qid as id", "concat(pid, ' ', rk) as text")
    return _bundle_rows(v, path, "candidate", rows)


@query("k8_write_labels", sql("select qid, label from marked", "topic_vecs", "centroids", **_TOPICS))
def _(v: Views):
    path = new_path(v.spark, "labels")
    writers.write_labels(_marked(v), path)
    by_label = readers.read_labels(v.spark, f"{path}/by_label")
    by_query = v.spark.read.schema(schemas.LABELS).json(f"{path}/by_query")
    return by_label.join(by_query, ["qid", "label"])
