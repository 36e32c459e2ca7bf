"""Metrics, vector functions, re-ranking, negatives, audits and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import LIST, Views, sql
from densekit.functions import pooling, vectors
from densekit.functions.hashing import hash_wide_sql
from densekit.operators import audits, metrics, negatives, prep, rerank, sampling, topics

DISTINCT = "select distinct qid, pid from qrels"
PER_QUERY = (
    "select g.qid, g.n_gt, {hits} from (select qid, count(*) as n_gt from qrels group by qid) g"
    " left join (select r.qid, r.rk from run r join rel using (qid, pid)) h on h.qid = g.qid group by g.qid, g.n_gt"
)


def _hits(ks) -> str:
    return ", ".join(f"count(case when h.rk <= {k} then 1 end) as h{k}" for k in ks)


MRR = (
    "(select coalesce(sum(1.0::double / f), 0) from (select r.qid, min(r.rk) as f from run r join rel using (qid, pid)"
    " where r.rk <= {k} group by r.qid)) / (select count(distinct qid) from qrels)"
)


@query("a5_mrr_at_10", sql(
    f"select 10 as k, round({MRR.format(k=10)}, 6) as mrr, (select count(distinct qid) from run) as queries_ranked",
    "run", "qrels", rel=DISTINCT))
def _(v: Views):
    return metrics.mrr_at_k(v.run, v.qrels, 10, parts=v.parts)


@query("j4_run_join_qrels", sql(
    "select coalesce(g.qid, r.qid) as qid, coalesce(n_gt, 0) as n_gt, r.qid is not null as in_run, first, coalesce(h1, 0) as hits_1,"
    " coalesce(h3, 0) as hits_3, g.qid is not null as judged from (select g.*, f.first from per_query g left join"
    " (select r.qid, min(r.rk) as first from run r join rel using (qid, pid) group by r.qid) f on f.qid = g.qid) g"
    " full join (select distinct qid from run) r on r.qid = g.qid",
    "run", "qrels", rel=DISTINCT, per_query=PER_QUERY.format(hits=_hits((1, 3)))))
def _(v: Views):
    return metrics.per_query(v.run, v.qrels, (1, 3), parts=v.parts)


@query("a6_short_lists", sql("select qid, count(*) as n from run group by qid having count(*) < 3", "run"))
def _(v: Views):
    return metrics.short_lists(v.run, 3)


@query("a7_recall_over_qrels", sql(
    "select 3 as k, round(avg(h3::double / greatest(1, n_gt)), 5) as recall from per_query",
    "run", "qrels", rel=DISTINCT, per_query=PER_QUERY.format(hits=_hits((3,)))))
def _(v: Views):
    return metrics.recall_at_k(v.run, v.qrels, 3, parts=v.parts)


@query("a8_recall_over_run", sql(
    "select 3 as k, round(avg(coalesce(h3, 0)::double / greatest(1, coalesce(n_gt, 0))), 7) as recall"
    " from (select distinct qid from run) left join per_query using (qid)",
    "run", "qrels", rel=DISTINCT, per_query=PER_QUERY.format(hits=_hits((3,)))))
def _(v: Views):
    return metrics.recall_at_k(v.run, v.qrels, 3, over="run", parts=v.parts)


@query("a9_recall_ladder", sql(
    " union all ".join(f"select {k} as k, round(avg(h{k}::double / greatest(1, n_gt)), 5) as recall from per_query" for k in metrics.LADDER_KS),
    "run", "qrels", rel=DISTINCT, per_query=PER_QUERY.format(hits=_hits(metrics.LADDER_KS))))
def _(v: Views):
    return metrics.recall_ladder(v.run, v.qrels, parts=v.parts)


@query("a12_eval_report", sql(
    f"select round({MRR.format(k=10)}, 6) as mrr_10, (select count(distinct qid) from run) as queries_ranked, "
    + ", ".join(f"(select round(avg(h{k}::double / greatest(1, n_gt)), 5) from per_query) as recall_{k}" for k in metrics.REPORT_KS),
    "run", "qrels", rel=DISTINCT, per_query=PER_QUERY.format(hits=_hits(metrics.REPORT_KS))))
def _(v: Views):
    return metrics.eval_report(v.run, v.qrels, parts=v.parts)


@query("a12_eval_report_min_label", sql(
    f"select round({MRR.format(k=10)}, 6) as mrr_10, (select count(distinct qid) from run) as queries_ranked, "
    + ", ".join(f"(select round(avg(h{k}::double / greatest(1, n_gt)), 5) from per_query) as recall_{k}" for k in metrics.REPORT_KS),
    "run", "qrels", rel="select distinct qid, pid from qrels where label >= 1", judged="select * from qrels where label >= 1",
    per_query=PER_QUERY.format(hits=_hits(metrics.REPORT_KS)).replace("qrels", "judged")))
def _(v: Views):
    return metrics.eval_report(v.run, v.qrels, min_label=1, parts=v.parts)


@query("a4_mean_list_length", sql("select count(*) // count(distinct qid) as mean_length from run", "run"))
def _(v: Views):
    return metrics.mean_list_length(v.run)


LABELLED = (
    "select s.qid, s.pid, s.score, case when r.pid is null then 0 else 1 end as label,"
    " row_number() over (partition by s.qid order by s.score desc, s.pid) as rk"
    " from scored s left join rel r on r.qid = s.qid and r.pid = s.pid"
)


@query("a10_pairs_mrr", sql(
    "select round(avg(coalesce(1.0::double / f, 0)), 6) as mrr, count(*) as queries from"
    " (select qid, min(case when label = 1 then rk end) as f from labelled group by qid)",
    "scored", "qrels", rel=DISTINCT, labelled=LABELLED))
def _(v: Views):
    return metrics.pairs_mrr(prep.label_candidates(v.scored, v.qrels))


PAIR_KS = (1, 2, 5)


@query("a11_pairs_recall", sql(
    " union all ".join(
        f"select {k} as k, round(avg(h::double / greatest(1, n)), 6) as recall from (select qid, sum(label) as n,"
        f" sum(case when rk <= {k} then label else 0 end) as h from labelled group by qid)" for k in PAIR_KS),
    "scored", "qrels", rel=DISTINCT, labelled=LABELLED))
def _(v: Views):
    return metrics.pairs_recall(prep.label_candidates(v.scored, v.qrels), PAIR_KS)


# sums of drawn pairs, whose lengths differ, unlike those of the unit vectors themselves
@query("a14_norm_histogram", sql(
    "select cast(b.bin as integer) as bin, round(lo + b.bin * (hi - lo) / 10, 6) as lower, count(x.norm) as n"
    " from ends cross join (select unnest(range(0, 10)) as bin) b left join norms x"
    " on least(floor((x.norm - lo) / ((hi - lo) / 10)), 9) = b.bin group by b.bin, lo, hi",
    "vec_run", "vecs",
    norms="select round(sqrt(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: (z[1] + z[2]) * (z[1] + z[2])))), 6) as norm"
    " from vec_run r join vecs q on q.id = r.qid join vecs d on d.id = r.pid",
    ends="select min(norm) as lo, max(norm) as hi from norms"))
def _(v: Views):
    q = v.vecs.select(F.col("id").alias("qid"), F.col("embedding").alias("a"))
    d = v.vecs.select(F.col("id").alias("pid"), F.col("embedding").alias("b"))
    pairs = v.vec_run.join(q, "qid").join(d, "pid")
    sums = F.zip_with("a", "b", lambda x, y: x.cast("double") + y.cast("double"))
    return metrics.norm_histogram(pairs.select(sums.alias("embedding")))


# vector functions

PAIRED = "from vec_run r join vecs q on q.id = r.qid join vecs d on d.id = r.pid"
_DOT, _Q2, _D2 = (f"list_dot_product({a}.embedding, {b}.embedding)" for a, b in (("q", "d"), ("q", "q"), ("d", "d")))
_COS = f"{_DOT} / (greatest(sqrt({_Q2}), 1e-12) * greatest(sqrt({_D2}), 1e-12))"
_GAPS = "list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1] - z[2])"
PAIR_FUNCTIONS = {
    "v1_dot": (vectors.dot, _DOT),
    "v4_cosine": (vectors.cosine, _COS),
    "v5_cosine_distance": (vectors.cosine_distance, f"1 - {_COS}"),
    "v6_euclidean": (vectors.euclidean, f"sqrt(list_sum(list_transform({_GAPS}, lambda x: x * x)))"),
    "v7_manhattan": (vectors.manhattan, f"list_sum(list_transform({_GAPS}, lambda x: abs(x)))"),
    "v8_l2sq": (vectors.l2sq, f"list_sum(list_transform({_GAPS}, lambda x: x * x))"),
}


def _on_pairs(function):
    def build(v: Views):
        q = v.vecs.select(F.col("id").alias("qid"), F.col("embedding").alias("_q"))
        d = v.vecs.select(F.col("id").alias("pid"), F.col("embedding").alias("_d"))
        return v.vec_run.join(q, "qid").join(d, "pid").select("qid", "pid", vectors.rounded(function("_q", "_d")).alias("value"))

    return build


for _name, (_function, _text) in PAIR_FUNCTIONS.items():
    query(_name, sql(f"select r.qid, r.pid, round({_text}, 6) as value {PAIRED}", "vec_run", "vecs"))(_on_pairs(_function))


@query("v2_norm", sql("select id, round(sqrt(list_dot_product(embedding, embedding)), 6) as value from coarse", "coarse"))
def _(v: Views):
    return _coarse(v).select("id", vectors.rounded(vectors.norm("embedding")).alias("value"))


def _coarse(v: Views):
    pairs = F.sequence(F.lit(0), F.expr("size(embedding) div 2 - 1"))
    added = F.transform(pairs, lambda p: F.get("embedding", p * 2).cast("double") + F.get("embedding", p * 2 + 1).cast("double"))
    return v.vecs.select("id", added.alias("embedding"))


@query("v3_normalize", sql(
    "select id, unnest(range(1, len(embedding) + 1)) as pos, round(unnest(embedding) / greatest(len2, 1e-12), 6) as value"
    " from (select *, sqrt(list_dot_product(embedding, embedding)) as len2 from coarse)", "coarse"))
def _(v: Views):
    return _long(_coarse(v).select("id", vectors.normalize("embedding").alias("embedding")))


def _long(df):
    rows = df.select("id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("value"))


def _token_vectors(v: Views):
    """Each query's drawn vectors as its token vectors; those of its own label are masked out."""
    labels = v.table("embeddings").select("vec_id", "embedding", "label")
    q = labels.selectExpr("vec_id as qid", "label as ql")
    d = labels.selectExpr("vec_id as pid", "embedding as vec", "label as dl")
    return v.vec_run.join(q, "qid").join(d, "pid").selectExpr("qid as id", "rk as pos", "vec", "if(ql = dl, 0, 1) as mask")


@query("v9_mean_pool", sql(
    "select id, dim as pos, round(sum(x * mask) / greatest(sum(mask), 1e-9), 6) as value from (select r.qid as id,"
    " unnest(d.embedding)::double as x, unnest(range(1, len(d.embedding) + 1)) as dim, case when q.label = d.label then 0 else 1 end as mask"
    " from vec_run r join embeddings q on q.vec_id = r.qid join embeddings d on d.vec_id = r.pid) group by id, dim", "vec_run"))
def _(v: Views):
    return _long(pooling.pool(_token_vectors(v), "mean"))


@query("v10_first_token_pool", sql(
    "select r.qid as id, unnest(range(1, len(embedding) + 1)) as pos, round(unnest(embedding), 6) as value"
    " from vec_run r join vecs on id = r.pid where r.rk = 1", "vec_run", "vecs"))
def _(v: Views):
    return _long(pooling.pool(_token_vectors(v), "cls"))


VEC_SCORED = f"select r.qid, r.pid, round({_DOT}, 6) as score {PAIRED}"


@query("v11_softmax", sql(
    "select qid, pid, round(exp(score / 0.5 - top) / sum(exp(score / 0.5 - top)) over (partition by qid), 6) as p"
    " from (select *, max(score / 0.5) over (partition by qid) as top from vec_scored)", "vec_run", "vecs", vec_scored=VEC_SCORED))
def _(v: Views):
    return audits.softmax(prep.score_pairs(v.vec_run, v.vecs, v.vecs), 0.5)


# re-ranking


@query("e4_rerank_dot", sql(
    "select qid, pid, score, cast(row_number() over (partition by qid order by score desc, pid) as integer) as rk from vec_scored",
    "vec_run", "vecs", vec_scored=VEC_SCORED))
def _(v: Views):
    return rerank.rerank_dot(v.vec_run, v.vecs, v.vecs, max_list=LIST)


VEC_LABELLED = (
    "select s.*, case when r.pid is null then 0 else 1 end as label, row_number() over (partition by s.qid order by s.score desc, s.pid) as rk"
    " from vec_scored s left join (select distinct qid, pid from vec_qrels) r on r.qid = s.qid and r.pid = s.pid"
)


@query("e7_rerank_eval", sql(
    "select 'mrr' as metric, round(avg(coalesce(1.0::double / f, 0)), 6) as value from"
    " (select qid, min(case when label = 1 then rk end) as f from labelled group by qid)"
    + "".join(
        f" union all select 'recall_{k}', round(avg(h::double / greatest(1, n)), 6) from (select qid, sum(label) as n,"
        f" sum(case when rk <= {k} then label else 0 end) as h from labelled group by qid)" for k in (5, 20, 100, 200, 1000)),
    "vec_run", "vec_qrels", "vecs", vec_scored=VEC_SCORED, labelled=VEC_LABELLED))
def _(v: Views):
    return rerank.rerank_eval(rerank.rerank_dot(v.vec_run, v.vecs, v.vecs, max_list=LIST), v.vec_qrels)


@query("e8_best_models", sql(
    "select l_suppkey as model, round(avg(l_discount), 6) as val_mrr from lineitem group by 1 order by 2 desc, 1 limit 5"))
def _(v: Views):
    scores = v.table("lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(F.round(F.avg("l_discount"), 6).alias("val_mrr"))
    return rerank.best_models(scores, 5)


# negatives

POOL = (
    "select pid, row_number() over (order by pid) - 1 as slot from (select pos_pid as pid from triplets union select neg_pid from triplets)"
)
SIMPLE_DRAWS = 6
DRAWN = (
    f"select q.qid, d.draw, p.pid from (select distinct qid from triplets) q cross join (select unnest(range(0, {SIMPLE_DRAWS})) as draw) d"
    f" join pool p on p.slot = {hash_wide_sql('q.qid', 'd.draw')} % (select count(*) from pool)"
)


@query("r5_draws", sql("select * from drawn", "triplets", pool=POOL, drawn=DRAWN))
def _(v: Views):
    return sampling.draws(v.triplets, prep.triplet_pids(v.triplets), SIMPLE_DRAWS).withColumn("draw", F.col("draw").cast("bigint"))


@query("n1_simple_negatives", sql(
    "select t.qid, t.pos_pid, s.pid as neg_pid from (select *, row_number() over (partition by qid order by pos_pid, neg_pid) as n from triplets) t"
    " join (select *, row_number() over (partition by qid order by draw desc) as n from drawn d where not exists"
    " (select 1 from qrels r where r.qid = d.qid and r.pid = d.pid)) s on s.qid = t.qid and s.n = t.n",
    "triplets", "qrels", pool=POOL, drawn=DRAWN))
def _(v: Views):
    return negatives.simple_negatives(v.triplets, v.qrels, SIMPLE_DRAWS)


OLD = (
    "select t.tid, t.qid, t.pos_pid, round(list_dot_product(q.embedding, d.embedding), 6) as old_score"
    " from vec_triplets t join vecs q on q.id = t.qid join vecs d on d.id = t.neg_pid"
)
CANDS = (
    f"select r.qid, r.pid, r.rk, round({_DOT}, 6) as score {PAIRED} where not exists"
    " (select 1 from vec_qrels x where x.qid = r.qid and x.pid = r.pid)"
)
MINED = (
    "select o.tid, o.qid, o.pos_pid, arg_max(c.pid, c.rk) as neg_pid, o.old_score, arg_max(c.score, c.rk) as new_score"
    " from old o join cands c on c.qid = o.qid and c.score > o.old_score group by o.tid, o.qid, o.pos_pid, o.old_score"
)
_MINING = ("vec_triplets", "vec_run", "vec_qrels", "vecs")


def _mined(v: Views, **options):
    return negatives.hard_negatives(v.vec_triplets, v.vec_run, v.vec_qrels, v.vecs, v.vecs, **options)


@query("n2_hard_negatives", sql("select * from mined", *_MINING, old=OLD, cands=CANDS, mined=MINED))
def _(v: Views):
    return _mined(v)


@query("n2_hardest_negatives", sql(
    "select o.tid, o.qid, o.pos_pid, c.pid as neg_pid, o.old_score, c.score as new_score from old o join"
    " (select * from (select *, row_number() over (partition by qid order by score desc, rk) as n from cands) where n = 1) c"
    " on c.qid = o.qid and c.score > o.old_score", *_MINING, old=OLD, cands=CANDS))
def _(v: Views):
    return _mined(v, pick="hardest")


@query("w5_last_above_threshold", sql("select tid, neg_pid as pid from mined", *_MINING, old=OLD, cands=CANDS, mined=MINED))
def _(v: Views):
    return _mined(v).select("tid", F.col("neg_pid").alias("pid"))


@query("a13_mining_summary", sql(
    "select (select round(avg(old_score), 6) from old) as old_mean_all, (select round(avg(new_score), 6) from mined) as new_mean_replaced,"
    " (select count(*) from vec_triplets) as triplets, (select count(*) from vec_triplets) - (select count(*) from old) as unscored, (select count(*) from mined) as replaced", *_MINING, old=OLD, cands=CANDS, mined=MINED))
def _(v: Views):
    return negatives.mining_summary(v.vec_triplets, _mined(v), v.vecs, v.vecs)


@query("n3_in_batch_documents", sql(
    "select batch_id, i as j, pos_pid as pid, 'positive' as role, i as target_of from batches union all"
    " select b.batch_id, b.i + s.n, b.neg_pid, 'negative', null from batches b join"
    " (select batch_id, count(*) as n from batches group by batch_id) s on s.batch_id = b.batch_id", "batches"))
def _(v: Views):
    return negatives.in_batch_documents(v.batches)


# audits


def _matrix(view: str, similarity: str = "cosine") -> str:
    docs = f"select batch_id, i as j, pos_vec as vec from {view} union all select b.batch_id, b.i + s.n, b.neg_vec from {view} b join sizes s on s.batch_id = b.batch_id"
    norms = " / (greatest(sqrt(list_dot_product(a.q_vec, a.q_vec)), 1e-12) * greatest(sqrt(list_dot_product(d.vec, d.vec)), 1e-12))"
    return (
        "select a.batch_id, a.i, d.j, list_dot_product(a.q_vec, d.vec)"
        f"{norms if similarity == 'cosine' else ''} as score"
        f" from {view} a join ({docs}) d on d.batch_id = a.batch_id"
    )


SIZES = "select batch_id, count(*) as n from batches group by batch_id"
SOFT = "select batch_id, i, j, exp(score / {t}) / sum(exp(score / {t})) over (partition by batch_id, i) as p from {m}"
CONTRAST = (
    "select batch_id, avg(lse - own) as value from (select batch_id, i, ln(sum(exp(20 * score))) as lse,"
    " sum(case when i = j then 20 * score end) as own from s_matrix group by batch_id, i) group by batch_id"
)
_BOTH = dict(sizes=SIZES, s_matrix=_matrix("student"), t_matrix=_matrix("teacher"))
KL = (
    "select batch_id, sum(x) / max(i + 1) as value from (select t.batch_id, t.i, t.p * (ln(t.p) - ln(s.p)) as x from t_soft t"
    " join s_soft s on s.batch_id = t.batch_id and s.i = t.i and s.j = t.j) group by batch_id"
)
LISTNET = (
    "select batch_id, sum(x) / max(i + 1) as value from (select t.batch_id, t.i, -t.p * ln(s.p + 1e-6) as x from t_soft t"
    " join s_soft s on s.batch_id = t.batch_id and s.i = t.i and s.j = t.j) group by batch_id"
)
GAP = (
    "select t.batch_id, avg((t.score - s.score) * (t.score - s.score)) as value from t_matrix t join s_matrix s"
    " on s.batch_id = t.batch_id and s.i = t.i and s.j = t.j group by t.batch_id"
)


def _soft(temperature) -> dict:
    return dict(_BOTH, s_soft=SOFT.format(t=temperature, m="s_matrix"), t_soft=SOFT.format(t=temperature, m="t_matrix"))


_ROUNDED = "select batch_id, round(value, 6) as value from result"


def _euclid(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query("l1_triplet_margin", sql(
    f"select batch_id, round(avg(greatest({_euclid('q_vec', 'pos_vec')} - {_euclid('q_vec', 'neg_vec')} + 1, 0)), 6) as value"
    " from student group by batch_id", "student"))
def _(v: Views):
    return audits.triplet_margin(v.student, 1.0)


@query("l2_in_batch_softmax", sql(_ROUNDED, "student", sizes=SIZES, s_matrix=_matrix("student"), result=CONTRAST))
def _(v: Views):
    return audits.in_batch_softmax(v.student)


@query("l3_score_gap", sql(_ROUNDED, "student", "teacher", **_BOTH, result=GAP))
def _(v: Views):
    return audits.score_gap(v.student, v.teacher)


@query("l4_kl_agreement", sql(_ROUNDED, "student", "teacher", **_soft(0.5), result=KL))
def _(v: Views):
    return audits.kl_agreement(v.student, v.teacher, 0.5)


@query("l5_listnet_agreement", sql(_ROUNDED, "student", "teacher", **_soft(1.0), result=LISTNET))
def _(v: Views):
    return audits.listnet_agreement(v.student, v.teacher)


@query("l6_weighted_audit", sql(
    "select c.batch_id, round(0.7 * c.value + 0.3 * r.value, 6) as value from contrast c join result r on r.batch_id = c.batch_id",
    "student", "teacher", **_soft(1.0), contrast=CONTRAST, result=KL))
def _(v: Views):
    return audits.weighted_audit(v.student, v.teacher, "kl", 0.7, 0.3)


@query("l6_weighted_dot_mse", sql(
    "select c.batch_id, round(0.6 * c.value + 0.4 * r.value, 6) as value from contrast c join result r on r.batch_id = c.batch_id",
    "student", "teacher", sizes=SIZES, s_matrix=_matrix("student", "dot"), t_matrix=_matrix("teacher", "dot"), contrast=CONTRAST, result=GAP))
def _(v: Views):
    return audits.weighted_audit(v.student, v.teacher, "mse", 0.6, 0.4, similarity="dot")


@query("l6_weighted_listnet", sql(
    "select c.batch_id, round(0.5 * c.value + 0.5 * r.value, 6) as value from contrast c join result r on r.batch_id = c.batch_id",
    "student", "teacher", **_soft(1.0), contrast=CONTRAST, result=LISTNET))
def _(v: Views):
    return audits.weighted_audit(v.student, v.teacher, "listnet", 0.5, 0.5)


@query("l7_pair_cross_entropy", sql(
    "select round(avg(ln(1 + exp(case when label = 1 then -5 * score else 5 * score end))), 6) as value, count(*) as pairs from labelled",
    "vec_run", "vec_qrels", "vecs", vec_scored=VEC_SCORED, labelled=VEC_LABELLED))
def _(v: Views):
    pairs = prep.label_candidates(prep.score_pairs(v.vec_run, v.vecs, v.vecs), v.vec_qrels)
    return audits.pair_cross_entropy(pairs.withColumn("logits", F.array(F.lit(0.0), 5 * F.col("score"))))


# topics

NOISE_DIST = 0.6
ASSIGNED = (
    "select qid, label, dist from (select v.id as qid, c.list_id as label, round(sqrt(list_sum(list_transform(list_zip(v.embedding, c.centroid),"
    " lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) as dist, row_number() over (partition by v.id order by round(sqrt(list_sum(list_transform("
    "list_zip(v.embedding, c.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6), c.list_id) as n from topic_vecs v cross join centroids c) where n = 1"
)
NEAR = f"select qid, case when dist <= {NOISE_DIST} then label else -1 end as label from assigned"
MARKED = (
    "select qid, case when s.n >= 30 then near.label else -1 end as label from near"
    " join (select label, count(*) as n from near group by label) s on s.label = near.label"
)
_TOPICS = dict(assigned=ASSIGNED, near=NEAR, marked=MARKED)


def _marked(v: Views):
    centers = v.centroids.withColumnsRenamed({"list_id": "label", "centroid": "center"})
    return topics.mark_noise(topics.assign_clusters(v.topic_vecs, centers), 30, NOISE_DIST)


@query("c3_cluster_noise_rule", sql("select qid, label from marked", "topic_vecs", "centroids", **_TOPICS))
def _(v: Views):
    return _marked(v)


@query("c3_cluster")
def _(v: Views):
    return topics.cluster(v.topic_vecs, 10)


@query("c2_reduce_dimensions")
def _(v: Views):
    return _long(topics.reduce_dimensions(v.vecs, 5))


@query("c4_cluster_members", sql(
    "select label, start, string_agg(qid::varchar, ',' order by qid) as members from (select qid, label,"
    " (row_number() over (partition by label order by qid) - 1) // 20 * 20 + 1 as start from marked where label >= 0) group by label, start", "topic_vecs", "centroids", **_TOPICS))
def _(v: Views):
    joined = F.array_join(F.transform("values", lambda q: q.cast("string")), ",")
    return topics.cluster_members(_marked(v), slice_rows=20).select("label", "start", joined.alias("members"))


@query("c5_split_noise", sql(
    "select case when label = -1 then 'noise' else 'member' end as part, qid, label from marked", "topic_vecs", "centroids", **_TOPICS))
def _(v: Views):
    members, noise = topics.split_noise(_marked(v))
    return members.withColumn("part", F.lit("member")).unionByName(noise.withColumn("part", F.lit("noise")))


@query("c6_cluster_preview", sql(
    "select label, cast(place as integer) as place, qid, o.text from (select label, qid, row_number() over (partition by label order by qid) as place"
    " from marked where label >= 0) p join order_texts o on o.id = p.qid where place <= 3", "topic_vecs", "centroids", "order_texts", **_TOPICS))
def _(v: Views):
    return topics.cluster_preview(_marked(v), v.order_texts)
