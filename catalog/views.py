"""Retrieval-shaped views of the test tables, as DataFrames and as SQL.

Orders are queries and parts are passages: an order's lines are its candidate list (dearest
first), the lines already judged (returned or accepted) and the order's customer number are its
qrels, and (order, part, supplier) are training triplets. All embeddings are both queries and
documents; hashed ids pair them up. In the conversations a user turn is a query and the
assistant's next turn its passage. Nothing is sampled or cut.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densekit.functions.pooling import mean_vectors
from densekit.operators.ranking import number_rows, with_rank

LIST = 50  # candidates drawn per vector query
LINES = 1000  # no order has as many lines: picks how lists are ranked, cuts nothing
JUDGED = (3, 11, 60)  # draws taken as relevant: two inside the list, one outside
BATCH = 16  # triplets per training batch
TASK_LINES = 500_000  # lines of orders that a task takes


class Views:
    """The views over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # orders and parts

    @cached_property
    def parts(self) -> int:
        """Tasks that the lines of orders are dealt to, all of an order to one; the lines are counted from the files' metadata."""
        lines = self.table("lineitem").count()
        return max(self.spark.sparkContext.defaultParallelism, -(-lines // TASK_LINES))

    @cached_property
    def scored(self) -> DataFrame:
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("pid"), F.col("l_extendedprice").alias("score")
        )
        return lines.repartition(self.parts, "qid").groupBy("qid", "pid").agg(F.max("score").alias("score"))

    @cached_property
    def run(self) -> DataFrame:
        return with_rank(self.scored, LINES).select("qid", "pid", "rk")

    @cached_property
    def qrels(self) -> DataFrame:
        lines = self.table("lineitem").filter("l_returnflag <> 'N'").selectExpr(
            "l_orderkey as qid", "l_linenumber as iter", "l_partkey as pid", "if(l_returnflag = 'R', 1, 0) as label"
        )
        return lines.unionByName(
            self.table("orders").selectExpr("o_orderkey as qid", "0 as iter", "o_custkey as pid", "1 as label")
        )

    @cached_property
    def triplets(self) -> DataFrame:
        return self.table("lineitem").selectExpr("l_orderkey as qid", "l_partkey as pos_pid", "l_suppkey as neg_pid")

    @cached_property
    def order_texts(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey as id", "concat(o_orderpriority, ' ', o_orderstatus, ' ', o_custkey) as text"
        )

    @cached_property
    def part_texts(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey as id", "concat(p_name, ' ', p_brand, ' ', p_type) as text")

    # vectors

    @cached_property
    def vecs(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id as id", "embedding")

    def drawn(self, draw) -> F.Column:
        """The document that a draw pairs with `qid`."""
        n = self.table("embeddings").agg(F.count("*")).scalar()
        draw = draw if isinstance(draw, F.Column) else F.lit(draw)
        return F.pmod(F.col("qid") * 7919 + draw * 104729, n)

    @cached_property
    def vec_run(self) -> DataFrame:
        draws = self.vecs.select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(1), F.lit(LIST))).alias("rk"))
        return draws.select("qid", self.drawn(F.col("rk").cast("bigint")).alias("pid"), "rk")

    @cached_property
    def vec_qrels(self) -> DataFrame:
        draws = self.vecs.select(F.col("id").alias("qid"), F.explode(F.array(*map(F.lit, JUDGED))).alias("j"))
        return draws.select("qid", self.drawn(F.col("j").cast("bigint")).alias("pid"))

    @cached_property
    def vec_triplets(self) -> DataFrame:
        draws = self.vecs.select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("j"))
        j = F.col("j").cast("bigint")
        return draws.select(
            (F.col("qid") * 4 + F.col("j") - 1).alias("tid"), "qid",
            self.drawn(j).alias("pos_pid"), self.drawn(j + 100).alias("neg_pid"),
        )

    @cached_property
    def batches(self) -> DataFrame:
        """Training batches of ids."""
        return self.vec_triplets.select(
            F.expr(f"tid div {BATCH}").alias("batch_id"), F.expr(f"tid % {BATCH}").alias("i"), "qid", "pos_pid", "neg_pid"
        )

    @cached_property
    def student(self) -> DataFrame:
        """Training batches of vectors."""
        rows = self.batches
        for key, name in (("qid", "q_vec"), ("pos_pid", "pos_vec"), ("neg_pid", "neg_vec")):
            rows = rows.join(self.vecs.select(F.col("id").alias(key), F.col("embedding").alias(name)), key)
        return rows.select("batch_id", "i", "q_vec", "pos_vec", "neg_vec")

    @cached_property
    def teacher(self) -> DataFrame:
        """The same batches as seen by a coarser model: each pair of neighbouring dimensions added up."""
        def halved(name):
            pairs = F.sequence(F.lit(0), F.expr(f"size({name}) div 2 - 1"))
            return F.transform(
                pairs, lambda p: F.get(name, p * 2).cast("double") + F.get(name, p * 2 + 1).cast("double")
            ).alias(name)

        return self.student.select("batch_id", "i", *map(halved, ("q_vec", "pos_vec", "neg_vec")))

    @cached_property
    def centroids(self) -> DataFrame:
        """Given centroids: the mean vector of each label, to 6 places."""
        means = mean_vectors(self.table("embeddings"), "label", "embedding", "centroid")
        return means.select(
            F.col("label").alias("list_id"), F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid")
        )

    @cached_property
    def codebooks(self) -> DataFrame:
        """Given code words: each centroid cut into 8 and halved."""
        parts = F.array(*(F.slice("centroid", 8 * m + 1, 8) for m in range(8)))
        cut = self.centroids.select(F.col("list_id").alias("code"), F.posexplode(parts).alias("m", "part"))
        return cut.select("m", "code", F.transform("part", lambda x: x / 2).alias("subvector"))

    @cached_property
    def topic_vecs(self) -> DataFrame:
        """Vectors with clusters and noise: near their label's mean, but every eleventh as it is."""
        near = F.zip_with("centroid", "embedding", lambda c, x: c + 0.25 * x.cast("double"))
        own = F.transform("embedding", lambda x: x.cast("double"))
        rows = self.table("embeddings").join(self.centroids, F.col("label") == F.col("list_id"))
        return rows.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 11 == 0, own).otherwise(near).alias("embedding"))

    # texts

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").selectExpr("doc_id as id", "text")

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.table("benchmark").selectExpr("item_id as id", "text")

    def turns(self, role: str) -> DataFrame:
        chosen = self.table("conversations").filter(F.col("role") == role)
        return chosen.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")

    @cached_property
    def turn_triplets(self) -> DataFrame:
        """Every answered user turn, the answer to it, and the answer that comes next in the order of ids, the first after the last."""
        asked = self.turns("user").select(F.col("id").alias("qid"), (F.col("id") + 1).alias("pos_pid"))
        numbered = number_rows(self.turns("assistant").select("id"), [F.asc("id")])
        n = numbered.agg(F.count("*")).scalar()
        following = numbered.select(F.col("id").alias("neg_pid"), (F.pmod(F.col("n") - 2, n) + 1).alias("n"))
        after = numbered.join(following, "n").select(F.col("id").alias("pos_pid"), "neg_pid")
        return asked.join(after, "pos_pid").select("qid", "pos_pid", "neg_pid")


_DRAW = "(qid * 7919 + {} * 104729) % (select count(*) from embeddings)"

# name: (views it needs, text)
SQL = {
    "scored": ((), "select l_orderkey as qid, l_partkey as pid, max(l_extendedprice) as score from lineitem group by 1, 2"),
    "run": (
        ("scored",),
        "select qid, pid, cast(row_number() over (partition by qid order by score desc, pid) as integer) as rk from scored",
    ),
    "qrels": (
        (),
        "select l_orderkey as qid, l_linenumber as iter, l_partkey as pid, case when l_returnflag = 'R' then 1 else 0 end as label"
        " from lineitem where l_returnflag <> 'N'"
        " union all select o_orderkey, 0, o_custkey, 1 from orders",
    ),
    "triplets": ((), "select l_orderkey as qid, l_partkey as pos_pid, l_suppkey as neg_pid from lineitem"),
    "order_texts": ((), "select o_orderkey as id, concat(o_orderpriority, ' ', o_orderstatus, ' ', o_custkey) as text from orders"),
    "part_texts": ((), "select p_partkey as id, concat(p_name, ' ', p_brand, ' ', p_type) as text from part"),
    "vecs": ((), "select vec_id as id, embedding::double[] as embedding from embeddings"),
    "vec_run": (
        (),
        f"select qid, {_DRAW.format('rk')} as pid, cast(rk as integer) as rk"
        f" from (select vec_id as qid, unnest(generate_series(1, {LIST})) as rk from embeddings)",
    ),
    "vec_qrels": (
        (),
        f"select qid, {_DRAW.format('j')} as pid from (select vec_id as qid, unnest({list(JUDGED)}) as j from embeddings)",
    ),
    "vec_triplets": (
        (),
        f"select qid * 4 + j - 1 as tid, qid, {_DRAW.format('j')} as pos_pid, {_DRAW.format('(j + 100)')} as neg_pid"
        " from (select vec_id as qid, unnest(generate_series(1, 4)) as j from embeddings)",
    ),
    "batches": (("vec_triplets",), f"select tid // {BATCH} as batch_id, tid % {BATCH} as i, qid, pos_pid, neg_pid from vec_triplets"),
    "student": (
        ("batches", "vecs"),
        "select batch_id, i, q.embedding as q_vec, p.embedding as pos_vec, n.embedding as neg_vec from batches"
        " join vecs q on q.id = qid join vecs p on p.id = pos_pid join vecs n on n.id = neg_pid",
    ),
    "coarse": (
        ("vecs",),
        "select id, list_transform(range(0, len(embedding) // 2), lambda p: embedding[p * 2 + 1] + embedding[p * 2 + 2]) as embedding from vecs",
    ),
    "teacher": (
        ("batches", "coarse"),
        "select batch_id, i, q.embedding as q_vec, p.embedding as pos_vec, n.embedding as neg_vec from batches"
        " join coarse q on q.id = qid join coarse p on p.id = pos_pid join coarse n on n.id = neg_pid",
    ),
    "centroids": (
        (),
        "select label as list_id, list(mean order by pos) as centroid from (select label, pos, round(avg(x::double), 6) as mean"
        " from (select label, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as pos from embeddings)"
        " group by label, pos) group by label",
    ),
    "topic_vecs": (
        ("centroids",),
        "select e.vec_id as id, case when e.vec_id % 11 = 0 then e.embedding::double[] else"
        " list_transform(list_zip(c.centroid, e.embedding::double[]), lambda z: z[1] + 0.25 * z[2]) end as embedding"
        " from embeddings e join centroids c on c.list_id = e.label",
    ),
    "codebooks": (
        ("centroids",),
        "select m, list_id as code, list_transform(centroid[8 * m + 1 : 8 * m + 8], lambda x: x / 2) as subvector"
        " from (select list_id, centroid, unnest(range(0, 8)) as m from centroids)",
    ),
    "documents_t": ((), "select doc_id as id, text from documents"),
    "user_turns": ((), "select conv_id * 1000 + turn as id, text from conversations where role = 'user'"),
    "answers": ((), "select conv_id * 1000 + turn as id, text from conversations where role = 'assistant'"),
    "turn_triplets": (
        ("user_turns", "answers"),
        "select u.id as qid, a.id as pos_pid, a.next as neg_pid from user_turns u join"
        " (select id, coalesce(lead(id) over (order by id), (select min(id) from answers)) as next from answers) a on a.id = u.id + 1",
    ),
}


def sql(body: str, *views: str, **extra: str) -> str:
    """`body` with the views it needs in front; `extra` are further common tables, in order."""
    order: list[str] = []

    def need(name):
        for other in SQL[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in views:
        need(name)
    parts = [f"{name} as materialized ({SQL[name][1]})" for name in order]
    parts += [f"{name} as materialized ({text})" for name, text in extra.items()]
    return f"with {', '.join(parts)} {body}" if parts else body
