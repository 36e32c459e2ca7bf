"""Training-data audits: what a loss would say about batches of triplets, one value per batch.

Input rows are `batch_id, i, q_vec, pos_vec, neg_vec` with i = 0 .. size - 1 in each batch; the
teacher's table has the same layout. The score matrix of a batch pairs its queries with all its
positives followed by all its negatives. It is computed tile by tile: rows are cut into blocks of
TILE rows by i, each (query block, document block) is one task-sized group, and a group emits one
partial sum per query row and never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densekit.functions.vectors import distance
from densekit.operators.blocks import matrix, numbers
from densekit.operators.prep import one_per_key

TILE = 1024  # batch rows per block
PACK_ROWS = 2048  # rows of small batches scored together
EPSILON = 1e-6


def triplet_margin(batches: DataFrame, margin: float = 1.0, by: str = "euclidean") -> DataFrame:
    """Mean over a batch of max(0, d(query, positive) - d(query, negative) + margin)."""
    d = distance(by)
    gap = d("q_vec", "pos_vec") - d("q_vec", "neg_vec") + margin
    return batches.groupBy("batch_id").agg(F.round(F.avg(F.greatest(gap, F.lit(0.0))), 6).alias("value"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _similarity(how):
    """Score matrix function by name ('cosine', 'dot'), or a function of two matrices as it is."""
    named = {"cosine": lambda q, d: _unit(q) @ _unit(d).T, "dot": lambda q, d: q @ d.T}
    if not callable(how) and how not in named:
        raise ValueError(f"unknown similarity {how!r}, expected one of {sorted(named)}")
    return how if callable(how) else named[how]


def _lse(x: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of each row."""
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def _rounded(values: DataFrame) -> DataFrame:
    return values.withColumn("value", F.round("value", 6))


def _single(batches: DataFrame, tile: int) -> bool:
    """Whether every batch fits one tile."""
    return (batches.agg(F.max("i")).first()[0] or 0) < tile


def _by_batch(body, left: pa.Table, right: pa.Table) -> pa.Table:
    """Run `body` on the rows of each batch in turn."""
    left = left.sort_by("batch_id")
    right = right.sort_by("batch_id")
    ids, starts = np.unique(numbers(left["batch_id"]), return_index=True)
    right_ids, out = numbers(right["batch_id"]), []
    for batch, start, end in zip(ids, starts, np.append(starts[1:], left.num_rows)):
        at, to = np.searchsorted(right_ids, [batch, batch + 1])
        q = left.slice(start, end - start)
        values = body(q, right.slice(at, to - at))
        out.append(pa.table({"batch_id": numbers(q["batch_id"]), "i": numbers(q["i"]), **values}))
    return pa.concat_tables(out)


def _packed(batches: DataFrame, columns: list[str], body, schema: str) -> DataFrame:
    """Run `body` on whole batches of one tile each, about PACK_ROWS rows to a task group.

    A group per small batch would cost more to hand over than to score.
    """
    packs = batches.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PACK_ROWS))).scalar()
    rows = batches.select("batch_id", "i", *columns, F.pmod(F.xxhash64("batch_id"), packs).alias("_pack"))
    return rows.groupBy("_pack").applyInArrow(lambda t: _by_batch(body, t, t), f"batch_id bigint, i bigint, {schema}")


def _tiled(batches: DataFrame, query_cols: list[str], doc_cols: list[str], body, schema: str, tile: int) -> DataFrame:
    """Run `body` on every (query block, document block) of a batch."""
    last = one_per_key(batches, ["batch_id"], F.floor(F.max("i") / tile).cast("int").alias("_last"))
    rows = batches.join(last, "batch_id").withColumn("_block", F.floor(F.col("i") / tile).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_last")))

    def side(block: str, other: str, columns: list[str]) -> DataFrame:
        key = [F.col(c).alias(c) for c in ("batch_id", "i")]
        return rows.select(*key, F.col("_block").alias(block), others.alias(other), *columns)

    key = ["batch_id", "_qb", "_db"]
    q, d = side("_qb", "_db", query_cols), side("_db", "_qb", doc_cols)
    return q.groupBy(*key).cogroup(d.groupBy(*key)).applyInArrow(
        lambda left, right: _by_batch(body, left, right), f"batch_id bigint, i bigint, {schema}"
    )


def _tiles(batches: DataFrame, query_cols: list[str], doc_cols: list[str], body, schema: str, tile: int) -> DataFrame:
    if _single(batches, tile):
        return _packed(batches, query_cols + doc_cols, body, schema)
    return _tiled(batches, query_cols, doc_cols, body, schema, tile)


def _sides(left: pa.Table, right: pa.Table, prefix: str, similarity) -> np.ndarray:
    docs = np.concatenate([matrix(right[f"{prefix}pos_vec"]), matrix(right[f"{prefix}neg_vec"])])
    return similarity(matrix(left[f"{prefix}q_vec"]), docs)


def _log_sum_exp(part: str) -> Column:
    """Merge a row's partial log-sum-exps; as many as its batch has blocks."""
    high = F.max(part)
    return high + F.log(F.aggregate(F.collect_list(part), F.lit(0.0), lambda acc, x: acc + F.exp(x - high)))


def _contrast(batches: DataFrame, scale: float = 20.0, similarity="cosine", tile: int = TILE) -> DataFrame:
    similarity = _similarity(similarity)

    def body(left, right):
        s = scale * _sides(left, right, "", similarity)
        own = numbers(left["i"])[:, None] == numbers(right["i"])[None, :]
        target = np.where(own, s[:, : right.num_rows], 0.0).sum(axis=1)
        return {"lse": _lse(s), "target": target}

    vecs = ["q_vec"], ["pos_vec", "neg_vec"]
    parts = _tiles(batches, *vecs, body, "lse double, target double", tile)
    rows = parts.groupBy("batch_id", "i").agg(
        _log_sum_exp("lse").alias("lse"), F.sum("target").alias("target")
    )
    return rows.groupBy("batch_id").agg(F.avg(F.col("lse") - F.col("target")).alias("value"))


def _with_teacher(student: DataFrame, teacher: DataFrame) -> DataFrame:
    named = teacher.select(
        "batch_id", "i", *(F.col(c).alias(f"t_{c}") for c in ("q_vec", "pos_vec", "neg_vec"))
    )
    return student.select("batch_id", "i", "q_vec", "pos_vec", "neg_vec").join(named, ["batch_id", "i"])


_Q, _D = ["q_vec", "t_q_vec"], ["pos_vec", "neg_vec", "t_pos_vec", "t_neg_vec"]


def _score_gap(student: DataFrame, teacher: DataFrame, similarity="cosine", tile: int = TILE) -> DataFrame:
    """Mean squared difference of the two score matrices of a batch."""
    similarity = _similarity(similarity)

    def body(left, right):
        gap = _sides(left, right, "t_", similarity) - _sides(left, right, "", similarity)
        return {"total": (gap * gap).sum(axis=1), "n": np.full(len(gap), gap.shape[1], np.int64)}

    parts = _tiles(_with_teacher(student, teacher), _Q, _D, body, "total double, n bigint", tile)
    return parts.groupBy("batch_id").agg((F.sum("total") / F.sum("n")).alias("value"))


def _kl(student: DataFrame, teacher: DataFrame, temperature: float = 1.0, similarity="cosine", tile: int = TILE) -> DataFrame:
    """Mean over a batch's rows of KL(teacher || student) of the softmax of their scores."""
    similarity = _similarity(similarity)

    def body(left, right):
        t = _sides(left, right, "t_", similarity) / temperature
        s = _sides(left, right, "", similarity) / temperature
        t_lse = _lse(t)
        lean = (np.exp(t - t_lse[:, None]) * (t - s)).sum(axis=1)
        return {"t_lse": t_lse, "s_lse": _lse(s), "lean": lean}

    parts = _tiles(_with_teacher(student, teacher), _Q, _D, body, "t_lse double, s_lse double, lean double", tile)
    rows = parts.groupBy("batch_id", "i").agg(
        *(_log_sum_exp(c).alias(c) for c in ("t_lse", "s_lse")),
        F.collect_list(F.struct(F.col("t_lse").alias("part"), "lean")).alias("leans"),
    )
    # the teacher's mean of (teacher score - student score), then the two normalisers
    expected = F.aggregate("leans", F.lit(0.0), lambda acc, p: acc + p["lean"] * F.exp(p["part"] - F.col("t_lse")))
    return rows.groupBy("batch_id").agg(F.avg(expected - F.col("t_lse") + F.col("s_lse")).alias("value"))


def _listnet(student: DataFrame, teacher: DataFrame, temperature: float = 1.0, similarity="cosine", tile: int = TILE) -> DataFrame:
    """Mean over a batch's rows of -sum(teacher softmax * log(student softmax + 1e-6)).

    The constant inside the logarithm needs the student's normaliser first, hence two passes.
    """
    similarity = _similarity(similarity)
    both = _with_teacher(student, teacher)

    def scores_of(left, right):
        return (_sides(left, right, prefix, similarity) / temperature for prefix in ("t_", ""))

    def normalisers(left, right):
        t, s = scores_of(left, right)
        return {"t_lse": _lse(t), "s_lse": _lse(s)}

    def crossed(left, right, lse):
        t, s = (x - lse[name][:, None] for x, name in zip(scores_of(left, right), ("t_lse", "s_lse")))
        return {"total": -(np.exp(t) * np.log(np.exp(s) + EPSILON)).sum(axis=1)}

    if _single(both, tile):
        rows = _packed(both, _Q + _D, lambda q, d: crossed(q, d, normalisers(q, d)), "total double")
        return rows.groupBy("batch_id").agg(F.avg("total").alias("value"))
    parts = _tiled(both, _Q, _D, normalisers, "t_lse double, s_lse double", tile)
    lse = parts.groupBy("batch_id", "i").agg(*(_log_sum_exp(c).alias(c) for c in ("t_lse", "s_lse")))

    def given(left, right):
        return crossed(left, right, {c: numbers(left[c]) for c in ("t_lse", "s_lse")})

    sums = _tiled(both.join(lse, ["batch_id", "i"]), [*_Q, "t_lse", "s_lse"], _D, given, "total double", tile)
    rows = sums.groupBy("batch_id", "i").agg(F.sum("total").alias("total"))
    return rows.groupBy("batch_id").agg(F.avg("total").alias("value"))


def in_batch_softmax(batches: DataFrame, **options) -> DataFrame:
    """Mean over a batch of -log softmax(scale * scores) at the row's own positive."""
    return _rounded(_contrast(batches, **options))


def score_gap(student: DataFrame, teacher: DataFrame, **options) -> DataFrame:
    return _rounded(_score_gap(student, teacher, **options))


def kl_agreement(student: DataFrame, teacher: DataFrame, temperature: float = 1.0, **options) -> DataFrame:
    return _rounded(_kl(student, teacher, temperature, **options))


def listnet_agreement(student: DataFrame, teacher: DataFrame, temperature: float = 1.0, **options) -> DataFrame:
    return _rounded(_listnet(student, teacher, temperature, **options))


def _by_name(kind: str):
    audits = {"kl": _kl, "listnet": _listnet, "mse": _score_gap}
    if kind not in audits:
        raise ValueError(f"unknown audit {kind!r}, expected one of {sorted(audits)}")
    return audits[kind]


def agreement(student: DataFrame, teacher: DataFrame, kind: str, **options) -> DataFrame:
    """Teacher-student audit by name; an unknown name raises."""
    return _rounded(_by_name(kind)(student, teacher, **options))


def weighted_audit(
    student: DataFrame, teacher: DataFrame, kind: str, contrast_coeff: float = 1.0, distill_coeff: float = 1.0, **options
) -> DataFrame:
    """contrast_coeff * in-batch softmax + distill_coeff * the named agreement, per batch.

    `similarity` and `tile` hold for both parts, `scale` for the first and `temperature` for the second.
    """
    both = {name: options.pop(name) for name in ("similarity", "tile") if name in options}
    first = both | {name: options.pop(name) for name in ("scale",) if name in options}
    agreed = _by_name(kind)(student, teacher, **both, **options).withColumnRenamed("value", "_agreed")
    total = contrast_coeff * F.col("value") + distill_coeff * F.col("_agreed")
    return _rounded(_contrast(student, **first).join(agreed, "batch_id").select("batch_id", total.alias("value")))


def pair_cross_entropy(pairs: DataFrame) -> DataFrame:
    """Mean -log softmax(logits)[label] over pairs with `logits` of two classes, in one row."""
    a, b = F.col("logits")[0], F.col("logits")[1]
    high = F.greatest(a, b)
    lse = high + F.log(F.exp(a - high) + F.exp(b - high))
    own = F.when(F.col("label") == 1, b).otherwise(a)
    return pairs.agg(F.round(F.avg(lse - own), 6).alias("value"), F.count("*").alias("pairs"))


def softmax(scored: DataFrame, temperature: float = 1.0) -> DataFrame:
    """`qid, pid, p`: softmax over each query's scores.

    Highest score and log-sum-exp are aggregated and joined back, so a long list stays spread over
    tasks.
    """
    x = F.col("score") / temperature
    tops = one_per_key(scored, ["qid"], F.max(x).alias("_top"))
    sums = one_per_key(
        scored.join(tops, "qid"), ["qid"], (F.max("_top") + F.log(F.sum(F.exp(x - F.col("_top"))))).alias("_lse")
    )
    return scored.join(sums, "qid").select("qid", "pid", F.round(F.exp(x - F.col("_lse")), 6).alias("p"))
