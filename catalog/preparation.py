"""Projections, joins, sets, windows, limits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import Views, sql
from densekit.functions.hashing import BUCKETS, hash_bucket_sql
from densekit.operators import prep, ranking, sampling
from densekit.plans.bundles import build_bundle, build_dev_bundle

SAMPLE = 500  # queries in the sampled development set
TIERS = (400, 4000, 12000, 40000)


@query("p1_triplets_to_pairs", sql(
    "select qid, pos_pid as pid, 1 as label from triplets union all select qid, neg_pid, 0 from triplets", "triplets"))
def _(v: Views):
    return prep.triplets_to_pairs(v.triplets)


LABELLED = (
    "select r.qid, r.pid, r.rk, case when q.pid is null then 0 else 1 end as label from run r"
    " left join (select distinct qid, pid from qrels) q on q.qid = r.qid and q.pid = r.pid"
)


@query("p2_label_candidates", sql(LABELLED, "run", "qrels"))
def _(v: Views):
    return prep.label_candidates(v.run, v.qrels)


@query("p3_hydrate_triplets", sql(
    "select q.text as qid_text, p.text as pid_text_pos, n.text as pid_text_neg, qid, pos_pid as pid_pos,"
    " neg_pid as pid_neg, pos_pid as qrel from triplets join order_texts q on q.id = qid"
    " join part_texts p on p.id = pos_pid join part_texts n on n.id = neg_pid",
    "triplets", "order_texts", "part_texts"))
def _(v: Views):
    return prep.hydrate_triplets(v.triplets, v.order_texts, v.part_texts)


@query("p4_hydrate_pairs", sql(
    "select l.qid, l.pid, l.label, q.text as query_text, p.text as passage_text from labelled l"
    " join order_texts q on q.id = l.qid join part_texts p on p.id = l.pid",
    "run", "qrels", "order_texts", "part_texts", labelled=LABELLED))
def _(v: Views):
    pairs = prep.label_candidates(v.run, v.qrels).drop("rk")
    return prep.hydrate_pairs(pairs, v.order_texts, v.part_texts)


@query("p5_subset_by_keys", sql(
    "select * from run where qid in (select qid from qrels where label = 1 and iter > 0)", "run", "qrels"))
def _(v: Views):
    return prep.subset_by_keys(v.run, v.qrels.filter("label = 1 and iter > 0"), "qid")


VOCABULARY = (
    "select token, row_number() over (order by token) as token_id from"
    " (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents)"
)
TOKENS = (
    "select id, pos, token_id from (select id, unnest(w) as token, unnest(range(1, len(w) + 1)) as pos from"
    " (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents)) join vocabulary using (token)"
)


@query("p6_tokenize", sql("select id, pos, cast(token_id as integer) as token_id from tokens", vocabulary=VOCABULARY, tokens=TOKENS))
def _(v: Views):
    tokens = prep.tokenize(v.documents, prep.build_vocabulary(v.documents), max_len=None)
    return tokens.select("id", F.posexplode("tokens").alias("pos", "token_id")).withColumn("pos", F.col("pos").cast("bigint") + 1)


@query("p7_pad_tokens", sql(
    "select d.doc_id as id, p.pos as pos, cast(coalesce(t.token_id, 0) as integer) as input_id,"
    " case when t.id is null then 0 else 1 end as mask from documents d, (select unnest(range(1, 129)) as pos) p"
    " left join tokens t on t.id = d.doc_id and t.pos = p.pos", vocabulary=VOCABULARY, tokens=TOKENS))
def _(v: Views):
    tokens = prep.tokenize(v.documents, prep.build_vocabulary(v.documents), max_len=128)
    both = F.arrays_zip("input_ids", "attention_mask")
    rows = prep.pad_tokens(tokens, 128).select("id", F.posexplode(both).alias("pos", "t"))
    return rows.select(
        "id", (F.col("pos").cast("bigint") + 1).alias("pos"), F.col("t.input_ids").alias("input_id"), F.col("t.attention_mask").alias("mask")
    )


@query("p9_rank_cutoff", sql("select * from run where rk <= 3", "run"))
def _(v: Views):
    return ranking.cutoff(v.run, 3)


@query("j1_strict_lookup", sql("select triplets.*, text from triplets join order_texts on id = qid", "triplets", "order_texts"))
def _(v: Views):
    return prep.lookup(v.triplets, v.order_texts.withColumnRenamed("id", "qid"), "qid")


@query("j1_lenient_lookup", sql("select c.qid, c.pid, text from (select qid, pid from qrels) c join part_texts on id = c.pid", "qrels", "part_texts"))
def _(v: Views):
    return prep.lookup(v.qrels.select("qid", "pid"), v.part_texts.withColumnRenamed("id", "pid"), "pid", strict=False)


@query("j2_referenced_texts", sql("select * from part_texts where id in (select neg_pid from triplets)", "part_texts", "triplets"))
def _(v: Views):
    return prep.referenced_texts(v.triplets.select(F.col("neg_pid").alias("id")), v.part_texts)


@query("j3_drop_relevant", sql(
    "select * from run r where not exists (select 1 from qrels q where q.qid = r.qid and q.pid = r.pid)", "run", "qrels"))
def _(v: Views):
    return prep.drop_relevant(v.run, v.qrels)


@query("j6_score_pairs", sql(
    "select r.qid, r.pid, r.rk, round(list_dot_product(q.embedding, d.embedding), 6) as score from vec_run r"
    " join vecs q on q.id = r.qid join vecs d on d.id = r.pid", "vec_run", "vecs"))
def _(v: Views):
    return prep.score_pairs(v.vec_run, v.vecs, v.vecs)


@query("j7_embedding_subset", sql(
    "select id, pos, x from (select id, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as pos from vecs"
    " where id in (select neg_pid from vec_triplets))", "vecs", "vec_triplets"))
def _(v: Views):
    kept = prep.subset_by_keys(v.vecs, v.vec_triplets.select(F.col("neg_pid").alias("id")), "id")
    rows = kept.select("id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("x").cast("double").alias("x"))


@query("s3_triplet_stats", sql(
    "select count(*) as triplets, count(distinct qid) as queries, (select count(*) from"
    " (select pos_pid from triplets union select neg_pid from triplets)) as passages from triplets", "triplets"))
def _(v: Views):
    return prep.triplet_stats(v.triplets)


@query("a1_row_count", sql("select count(*) as rows, count(distinct qid) as distinct_qid, count(distinct pid) as distinct_pid from qrels", "qrels"))
def _(v: Views):
    return prep.profile(v.qrels, ("qid", "pid"))


@query("a2_key_overlap", sql(
    "select (select count(distinct qid) from run) as left_keys, (select count(distinct qid) from judged) as right_keys,"
    " (select count(*) from (select qid from run intersect select qid from judged)) as common_keys",
    "run", "qrels", judged="select qid from qrels"))
def _(v: Views):
    return prep.key_overlap(v.run, v.qrels, "qid")


@query("a3_group_lists", sql(
    "select qid, start, string_agg(pid::varchar, ',' order by pid) as pids from (select qid, pid,"
    " (row_number() over (partition by qid order by pid) - 1) // 2 * 2 + 1 as start from qrels) group by qid, start", "qrels"))
def _(v: Views):
    lists = prep.group_lists(v.qrels, slice_rows=2)
    joined = F.array_join(F.transform("values", lambda p: p.cast("string")), ",")
    return lists.select("qid", "start", joined.alias("pids"))


@query("u4_set_difference", sql("select qid, pid from run except select qid, pid from qrels", "run", "qrels"))
def _(v: Views):
    return prep.drop_relevant(v.run.select("qid", "pid"), v.qrels)


@query("u1_triplet_pids", sql("select pos_pid as pid from triplets union select neg_pid from triplets", "triplets"))
def _(v: Views):
    return prep.triplet_pids(v.triplets)


@query("u2_corpus_subset", sql(
    "select * from part_texts where id in (select pos_pid from triplets union select neg_pid from triplets"
    " union select pid from qrels union select pid from run)", "part_texts", "triplets", "qrels", "run"))
def _(v: Views):
    def ids(df, col):
        return df.select(F.col(col).alias("id"))

    return prep.corpus_subset(v.part_texts, ids(prep.triplet_pids(v.triplets), "pid"), ids(v.qrels, "pid"), ids(v.run, "pid"))


@query("u3_intersection_size", sql(
    "select count(*) as n from (select qid, pid from run intersect select qid, pid from qrels)", "run", "qrels"))
def _(v: Views):
    return v.run.select("qid", "pid").intersect(v.qrels.select("qid", "pid")).agg(F.count("*").alias("n"))


@query("w1_with_rank", sql("select qid, pid, score, cast(row_number() over (partition by qid order by score desc, pid) as integer) as rk from scored", "scored"))
def _(v: Views):
    return ranking.with_rank(v.scored)


@query("t2_full_sort", sql("select qid, pid, score, cast(row_number() over (partition by qid order by score desc, pid) as integer) as rk from scored", "scored"))
def _(v: Views):
    # the way taken for lists too long for one task
    return ranking.with_rank(v.scored, max_list=ranking.LIST_ROWS + 1)


@query("w2_order_run", sql(
    "select qid, pid, cast(row_number() over (partition by qid order by rk, pid) as integer) as rk from cut",
    "run", cut="select qid, pid, rk * 2 + pid % 2 as rk from run"))
def _(v: Views):
    # ranks with gaps and other ties than before
    return ranking.order_run(v.run.withColumn("rk", F.expr("rk * 2 + pid % 2")))


@query("w3_first_relevant", sql(
    "select qid, min(rk) as first from run join (select distinct qid, pid from qrels) using (qid, pid) group by qid", "run", "qrels"))
def _(v: Views):
    hits = v.run.join(prep.relevant_pairs(v.qrels), ["qid", "pid"], "left_semi")
    return hits.groupBy("qid").agg(F.min("rk").alias("first"))


@query("w4_nth_from_the_end", sql(
    "select qid, pid, n from (select qid, pid, cast(row_number() over (partition by qid order by score, pid desc) as integer) as n from scored) where n <= 2", "scored"))
def _(v: Views):
    return ranking.topk(v.scored, 2, order=(F.asc("score"), F.desc("pid")), name="n").select("qid", "pid", "n")


@query("t1_topk", sql(
    "select * from (select qid, pid, score, cast(row_number() over (partition by qid order by score desc, pid) as integer) as rk from scored) where rk <= 2", "scored"))
def _(v: Views):
    return ranking.topk(v.scored, 2)


@query("t3_preview", sql(
    "select label, vec_id, cast(place as integer) as place from (select label, vec_id, row_number() over"
    " (partition by label order by vec_id) as place from embeddings) where place <= 3"))
def _(v: Views):
    return ranking.preview(v.table("embeddings").select("label", "vec_id"), "label", "vec_id")


@query("t4_limit_queries", sql("select id as qid, text from order_texts order by id limit 101", "order_texts"))
def _(v: Views):
    return ranking.limit_queries(v.order_texts.withColumnRenamed("id", "qid"))


def _picked(view: str, n: int, seed: int) -> str:
    return f"select qid from (select distinct qid from {view}) order by {hash_bucket_sql('qid', seed=seed)}, qid limit {n}"


@query("r1_sample_queries", sql("select * from run where qid in (select qid from picked)", "run", picked=_picked("run", SAMPLE, 1)))
def _(v: Views):
    return sampling.sample_queries(v.run, SAMPLE)


@query("r2_triplet_tiers", sql(
    " union all ".join(f"select {n} as tier, triplets.* from triplets where qid in (select qid from tier_{n})" for n in TIERS),
    "triplets", **{f"tier_{n}": _picked("triplets", n, i + 1) for i, n in enumerate(TIERS)}))
def _(v: Views):
    return sampling.triplet_tiers(v.triplets, TIERS)


_TRIPLET_KEY = f"({hash_bucket_sql('qid', '1')} * 998951 + {hash_bucket_sql('pos_pid', '2')} * 31 + {hash_bucket_sql('neg_pid', '3')})"


@query("r3_sample_rows", sql(
    " union all ".join(
        f"select {p} as percent, triplets.* from triplets where {hash_bucket_sql(_TRIPLET_KEY, seed=s)} < {round(p / 100 * BUCKETS)}"
        for s, p in ((1, 1), (2, 3))), "triplets"))
def _(v: Views):
    one = sampling.sample_rows(v.triplets, 0.01, sampling.triplet_key(), 1).withColumn("percent", F.lit(1))
    three = sampling.sample_rows(v.triplets, 0.03, sampling.triplet_key(), 2).withColumn("percent", F.lit(3))
    return one.unionByName(three)


@query("r3_sample_rows_exact", sql(
    f"select * from triplets order by {hash_bucket_sql(_TRIPLET_KEY, seed=3)}, qid, pos_pid, neg_pid limit 777", "triplets"))
def _(v: Views):
    return sampling.sample_rows_exact(v.triplets, 777, sampling.triplet_key(), 3)


@query("r4_training_sample", sql(f"select id from vecs where {hash_bucket_sql('id')} < {round(0.3 * BUCKETS)}", "vecs"))
def _(v: Views):
    return sampling.training_sample(v.vecs, 0.3).select("id")


@query("r4_training_sample_exact", sql(f"select id from vecs order by {hash_bucket_sql('id')}, id limit 123", "vecs"))
def _(v: Views):
    return sampling.training_sample(v.vecs, n=123).select("id")


@query("n4_training_bundle", sql(
    "select 'query' as kind, id, text from order_texts where id in (select qid from triplets) union all"
    " select 'passage', id, text from part_texts where id in (select pos_pid from triplets union select neg_pid from triplets)",
    "order_texts", "part_texts", "triplets"))
def _(v: Views):
    bundle = build_bundle(v.triplets, v.order_texts, v.part_texts)
    return bundle.queries.withColumn("kind", F.lit("query")).unionByName(bundle.passages.withColumn("kind", F.lit("passage")))


@query("n5_dev_bundle", sql(
    "select 'query' as kind, id, text from order_texts where id in (select qid from picked) union all"
    " select 'passage', id, text from part_texts where id in (select pid from run where qid in (select qid from picked))",
    "order_texts", "part_texts", "run", picked=_picked("run", SAMPLE, 1)))
def _(v: Views):
    bundle = build_dev_bundle(v.run, v.order_texts, v.part_texts, SAMPLE)
    return bundle.queries.withColumn("kind", F.lit("query")).unionByName(bundle.passages.withColumn("kind", F.lit("passage")))
