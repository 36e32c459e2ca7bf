"""Nearest neighbours, indexes, encoders and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.evaluation import CANDS, MINED, OLD, _long
from catalog.registry import query
from catalog.views import Views, sql
from densekit.operators import encode, ivf, knn, pq, rerank
from densekit.operators.prep import hydrate_pairs, triplets_to_pairs
from densekit.plans.mining import mine_hard_negatives, mined_bundle
from densekit.plans.retrieval import compare_indexes, retrieve_and_evaluate
from densekit.session import new_path

K = 20
PROBES = 3

ALL_PAIRS = "select q.id as qid, d.id as pid, round(list_dot_product(q.embedding, d.embedding), 6) as score from vecs q cross join vecs d"
TOP = (
    "select * from (select qid, pid, cast(row_number() over (partition by qid order by score desc, pid) as integer) as rk, score"
    " from {source}) where rk <= {k}"
)


@query("i1_knn_exact", sql(TOP.format(source="pairs", k=K), "vecs", pairs=ALL_PAIRS))
def _(v: Views):
    return knn.knn_exact(v.vecs, v.vecs, K)


@query("j5_vector_theta_join", sql(TOP.format(source="pairs", k=5), "vecs", pairs=ALL_PAIRS))
def _(v: Views):
    return knn.knn_exact(v.vecs, v.vecs, 5, blocks=True)


@query("i2_knn_l2", sql(
    "select * from (select qid, pid, cast(row_number() over (partition by qid order by score, pid) as integer) as rk, score"
    f" from pairs) where rk <= {K}", "vecs",
    pairs="select q.id as qid, d.id as pid, round(list_sum(list_transform(list_zip(q.embedding, d.embedding),"
    " lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) as score from vecs q cross join vecs d"))
def _(v: Views):
    return knn.knn_exact(v.vecs, v.vecs, K, "l2")


CELLS = (
    "select v.id, c.list_id, row_number() over (partition by v.id order by round(list_dot_product(v.embedding, c.centroid), 6) desc, c.list_id) as n"
    " from vecs v cross join centroids c"
)
POSTED = "select id as pid, list_id from cells where n = 1"
VISITED = f"select id as qid, list_id from cells where n <= {PROBES}"
_INDEX = dict(cells=CELLS, posted=POSTED, visited=VISITED)
VISITED_PAIRS = (
    "select v.qid, p.pid, round(list_dot_product(q.embedding, d.embedding), 6) as score from visited v"
    " join posted p on p.list_id = v.list_id join vecs q on q.id = v.qid join {docs} d on d.id = p.pid"
)


@query("i3_ivf_assign", sql("select list_id, pid from posted", "vecs", "centroids", **_INDEX))
def _(v: Views):
    return ivf.ivf_from_centroids(v.vecs, v.centroids).postings.select("list_id", "pid")


@query("i3_ivf_build")
def _(v: Views):
    index = ivf.ivf_build(v.vecs, nlist=8, fraction=0.3)
    return index.postings.groupBy("list_id").agg(F.count("*").alias("docs"))


@query("i4_ivf_search", sql(
    TOP.format(source="pairs", k=K), "vecs", "centroids", **_INDEX, pairs=VISITED_PAIRS.format(docs="vecs")))
def _(v: Views):
    return ivf.ivf_search(v.vecs, ivf.ivf_from_centroids(v.vecs, v.centroids), K, PROBES)


@query("i4_ivf_search_blocks", sql(
    TOP.format(source="pairs", k=K), "vecs", "centroids", **_INDEX, pairs=VISITED_PAIRS.format(docs="vecs")))
def _(v: Views):
    return ivf.ivf_search(v.vecs, ivf.ivf_from_centroids(v.vecs, v.centroids), K, PROBES, blocks=True)


@query("i4_ivf_saved", sql(
    TOP.format(source="pairs", k=K), "vecs", "centroids", **_INDEX, pairs=VISITED_PAIRS.format(docs="vecs")))
def _(v: Views):
    path = new_path(v.spark, "ivf")
    ivf.ivf_from_centroids(v.vecs, v.centroids).save(path)
    return ivf.ivf_search(v.vecs, ivf.IvfIndex.load(v.spark, path), K, PROBES)


RESIDUALS = (
    "select p.pid, p.list_id, m, list_transform(list_zip(d.embedding[8 * m + 1 : 8 * m + 8], c.centroid[8 * m + 1 : 8 * m + 8]),"
    " lambda z: z[1] - z[2]) as part from (select *, unnest(range(0, 8)) as m from posted) p"
    " join vecs d on d.id = p.pid join centroids c on c.list_id = p.list_id"
)
CODED = (
    "select pid, list_id, m, code, subvector from (select r.pid, r.list_id, r.m, b.code, b.subvector, row_number() over"
    " (partition by r.pid, r.m order by round(list_dot_product(b.subvector, b.subvector) - 2 * list_dot_product(r.part, b.subvector), 9), b.code) as n"
    " from residuals r join codebooks b on b.m = r.m) where n = 1"
)
DECODED = (
    "select t.pid as id, list_transform(list_zip(c.centroid, t.words), lambda z: z[1] + z[2]) as embedding from"
    " (select pid, list_id, flatten(list(subvector order by m)) as words from coded group by pid, list_id) t"
    " join centroids c on c.list_id = t.list_id"
)
_PQ = dict(_INDEX, residuals=RESIDUALS, coded=CODED)


def _given_pq(v: Views):
    return pq.ivfpq_from_tables(v.vecs, v.centroids, v.codebooks)


@query("i5_ivfpq_codes", sql("select list_id, pid, m, code from coded", "vecs", "centroids", "codebooks", **_PQ))
def _(v: Views):
    codes = _given_pq(v).postings.select("list_id", "pid", F.posexplode("codes").alias("m", "code"))
    return codes.select("list_id", "pid", F.col("m").cast("bigint").alias("m"), F.col("code").cast("int").alias("code"))


@query("i5_ivfpq_build")
def _(v: Views):
    return pq.coding_error(v.vecs, pq.ivfpq_build(v.vecs, nlist=8, m=8, nbits=4, fraction=0.5))


@query("i6_ivfpq_search", sql(
    TOP.format(source="pairs", k=K), "vecs", "centroids", "codebooks", **_PQ, decoded=DECODED, pairs=VISITED_PAIRS.format(docs="decoded")))
def _(v: Views):
    return pq.ivfpq_search(v.vecs, _given_pq(v), K, PROBES)


@query("i6_ivfpq_saved", sql(
    TOP.format(source="pairs", k=K), "vecs", "centroids", "codebooks", **_PQ, decoded=DECODED, pairs=VISITED_PAIRS.format(docs="decoded")))
def _(v: Views):
    path = new_path(v.spark, "ivfpq")
    _given_pq(v).save(path)
    return pq.ivfpq_search(v.vecs, pq.IvfPqIndex.load(v.spark, path), K, PROBES)


@query("i7_compare_indexes")
def _(v: Views):
    return compare_indexes(v.vecs, v.vecs, v.vec_qrels, k=100)


@query("q1_retrieve_and_evaluate", sql(
    "select round((select coalesce(sum(1.0::double / f), 0) from (select r.qid, min(r.rk) as f from top r join rel using (qid, pid)"
    " where r.rk <= 10 group by r.qid)) / (select count(distinct qid) from rel), 6) as mrr_10,"
    " (select count(distinct qid) from top) as queries_ranked, "
    + ", ".join(
        f"(select round(avg(h::double / n), 5) from (select rel.qid, count(*) as n, count(case when rk <= {k} then 1 end) as h"
        f" from rel left join top using (qid, pid) group by rel.qid)) as recall_{k}" for k in (5, 20, 100)),
    "vecs", "vec_qrels", pairs=ALL_PAIRS, top=TOP.format(source="pairs", k=100), rel="select distinct qid, pid from vec_qrels"))
def _(v: Views):
    return retrieve_and_evaluate(v.vecs, v.vecs, v.vec_qrels)


@query("q2_mine_hard_negatives", sql(
    "select * from mined", "vec_triplets", "vec_qrels", "vecs", pairs=ALL_PAIRS, top=TOP.format(source="pairs", k=K), old=OLD,
    cands="select * from top r where not exists (select 1 from vec_qrels x where x.qid = r.qid and x.pid = r.pid)", mined=MINED))
def _(v: Views):
    return mine_hard_negatives(v.vec_triplets, v.vec_qrels, v.vecs, v.vecs, k=K, method="exact")


@query("q2_mine_by_ivf", sql(
    "select * from mined", "vec_triplets", "vec_qrels", "vecs", pairs=ALL_PAIRS, top=TOP.format(source="pairs", k=K), old=OLD,
    cands="select * from top r where not exists (select 1 from vec_qrels x where x.qid = r.qid and x.pid = r.pid)", mined=MINED))
def _(v: Views):
    # a trained index; with every cell visited its result is the exact one
    return mine_hard_negatives(v.vec_triplets, v.vec_qrels, v.vecs, v.vecs, k=K, method="ivf", nlist=8, nprobe=8, fraction=0.5)


@query("q2_mined_bundle", sql(
    "select distinct 'query' as kind, qid as id, concat('v', qid) as text from mined"
    " union all select 'passage', pid, concat('v', pid) from (select pos_pid as pid from mined union select neg_pid from mined)",
    "vec_triplets", "vec_qrels", "vecs", pairs=ALL_PAIRS, top=TOP.format(source="pairs", k=K), old=OLD,
    cands="select * from top r where not exists (select 1 from vec_qrels x where x.qid = r.qid and x.pid = r.pid)", mined=MINED))
def _(v: Views):
    texts = v.vecs.select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("text"))
    bundle = mined_bundle(v.vec_triplets, v.vec_qrels, v.vecs, v.vecs, texts, texts, k=K, method="exact")
    return bundle.queries.withColumn("kind", F.lit("query")).unionByName(bundle.passages.withColumn("kind", F.lit("passage")))


# encoders


def _hashed(texts: str, role: str | None = None) -> str:
    """Hashed encoding of a table `id, text` as rows `id, pos, value`, zeros included."""
    words = "regexp_extract_all(lower(text), '[a-z0-9]+')"
    if role:
        words = f"case when len({words}) > 0 then list_append({words}, 'role={role}') else [] end"
    return (
        f"with hashed as (select id, ('0x' || left(md5(token), 8))::bigint as h from (select id, unnest({words}) as token from {texts})),"
        " slots as (select id, h % 64 + 1 as pos, sum(1 - 2 * ((h // 64) % 2))::double as x from hashed group by 1, 2),"
        " norms as (select id, sqrt(sum(x * x)) as n from slots group by id)"
        " select t.id, p.pos, round(coalesce(s.x / greatest(n, 1e-12), 0)::float::double, 6) as value"
        f" from {texts} t cross join (select unnest(range(1, 65)) as pos) p"
        " left join slots s on s.id = t.id and s.pos = p.pos left join norms on norms.id = t.id"
    )


_DOCS, _BENCH = "(select doc_id as id, text from documents)", "(select item_id as id, text from benchmark)"


@query("e1_encode", _hashed(_DOCS))
def _(v: Views):
    return _long(encode.encode(v.documents))


@query("e1_encode_word2vec")
def _(v: Views):
    model = encode.fit_word2vec(v.documents, dim=16)
    return _long(encode.encode_word2vec(v.documents, model))


@query("e2_encode_role", _hashed(_BENCH, "query"))
def _(v: Views):
    return _long(encode.encode(v.benchmark, role="query"))


@query("e3_encode_partitioned", _hashed(_DOCS, "document"))
def _(v: Views):
    return _long(encode.encode(v.documents, role="document", batch=64, partitions=5))


@query("c1_embed_queries", _hashed(_BENCH))
def _(v: Views):
    return _long(encode.encode(v.benchmark))


def _turn_pairs(v: Views):
    return triplets_to_pairs(v.turn_triplets).distinct()


TURN_PAIRS = "select qid, pos_pid as pid, 1 as label from turn_triplets union select qid, neg_pid, 0 from turn_triplets"
WORDS = "list_distinct(regexp_extract_all(lower({}.text), '[a-z0-9]+'))"
TURN_WORDS = (
    f"select t.qid, t.pid, t.label, {WORDS.format('q')} as qw, {WORDS.format('p')} as pw,"
    " len(regexp_extract_all(lower(q.text), '[a-z0-9]+')) as nq, len(regexp_extract_all(lower(p.text), '[a-z0-9]+')) as np"
    " from turn_pairs t join user_turns q on q.id = t.qid join answers p on p.id = t.pid"
)


@query("e5_score_pairs_model", sql(
    "select qid, pid, round(len(list_intersect(qw, pw))::double / greatest(1, len(qw)), 6) as score from turn_words",
    "turn_triplets", turn_pairs=TURN_PAIRS, turn_words=TURN_WORDS))
def _(v: Views):
    pairs = hydrate_pairs(_turn_pairs(v), v.turns("user"), v.turns("assistant"))
    return rerank.score_pairs_model(pairs, rerank.OverlapScorer).withColumn("score", F.round("score", 6))


@query("e7_rerank_text_eval", sql(
    "select 'mrr' as metric, round(avg(coalesce(1.0::double / f, 0)), 6) as value from"
    " (select qid, min(case when label = 1 then rk end) as f from ranked group by qid)"
    + "".join(
        f" union all select 'recall_{k}', round(avg(h::double / greatest(1, n)), 6) from (select qid, sum(label) as n,"
        f" sum(case when rk <= {k} then label else 0 end) as h from ranked group by qid)" for k in (5, 20, 100, 200, 1000)),
    "turn_triplets", turn_pairs=TURN_PAIRS, turn_words=TURN_WORDS,
    ranked="select qid, pid, label, row_number() over (partition by qid order by len(list_intersect(qw, pw))::double / greatest(1, len(qw)) desc, pid)"
    " as rk from turn_words"))
def _(v: Views):
    qrels = v.turn_triplets.select("qid", F.col("pos_pid").alias("pid"))
    return rerank.rerank_text_eval(_turn_pairs(v).select("qid", "pid"), qrels, v.turns("user"), v.turns("assistant"), rerank.OverlapScorer)


def _turn_features(v: Views):
    asked, answers = v.turns("user"), v.turns("assistant")
    return rerank.pair_features(_turn_pairs(v), asked, answers, encode.encode(asked), encode.encode(answers))


@query("e6_pair_features", sql(
    "select qid, pid, label, len(list_intersect(qw, pw))::double as overlap, round(coalesce((select sum(idf) from"
    " (select unnest(list_intersect(qw, pw)) as token) x join idf using (token)), 0), 6) as idf_overlap,"
    " nq::double as query_words, np::double as passage_words from turn_words",
    "turn_triplets", turn_pairs=TURN_PAIRS, turn_words=TURN_WORDS,
    idf="select token, ln(((select count(*) from answers) + 1)::double / (count(*) + 1)) as idf from"
    " (select id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as token from answers) group by token"))
def _(v: Views):
    return _turn_features(v).withColumn("idf_overlap", F.round("idf_overlap", 6)).drop("similarity")


@query("e6_fit_pair_ranker")
def _(v: Views):
    features = _turn_features(v).persist()
    scored = rerank.score_features(features, rerank.fit_pair_ranker(features))
    return scored.select("qid", "pid", "label", F.round("score", 6).alias("score"))
