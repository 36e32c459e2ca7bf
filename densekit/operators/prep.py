"""Preparing collections, qrels, candidates and triplets: lookups, subsets, labels, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densekit.functions.vectors import rounded
from densekit.functions.vectors import similarity as named_similarity
from densekit.operators.ranking import number_rows
from densekit.operators.word_blocks import TOKEN, mapped, word_blocks
from densekit.session import pin

SLICE_ROWS = 100_000  # longest list held in one row


def require(df: DataFrame, ok: Column, message: Column) -> DataFrame:
    """Raise when a row breaks `ok`. A filter, as a checking column would be pruned when unused."""
    return df.filter(ok | F.raise_error(message).cast("boolean"))


def one_per_key(df: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """One row per key, for a join on that key.

    AQE splits a hot key of a join only if both sides come straight from a shuffle on the join
    key. A plain `groupBy(key)` would be reused as the join's partitioning and stand in the way;
    grouping by the key and its hash gives the join a (small) shuffle of its own.
    """
    return df.groupBy(F.xxhash64(*keys).alias("_mark"), *keys).agg(F.lit(1).alias("_one"), *values).drop("_mark", "_one")


def lookup(df: DataFrame, dim: DataFrame, on: str, strict: bool = True) -> DataFrame:
    """Attach the columns of `dim` by id. A missing id raises, or drops the row if not strict."""
    columns = [*df.columns, *(c for c in dim.columns if c != on)]
    if not strict:
        return df.join(dim, on, "inner").select(*columns)
    found = dim.withColumn("_found", F.lit(True))
    joined = df.join(found, on, "left")
    message = F.concat(F.lit(f"no row for {on} "), F.col(on).cast("string"))
    return require(joined, F.col("_found").isNotNull(), message).select(*columns)


def triplets_to_pairs(triplets: DataFrame) -> DataFrame:
    """Each triplet gives a pair labelled 1 and a pair labelled 0; duplicates stay."""
    pair = F.array(
        F.struct(F.col("pos_pid").alias("pid"), F.lit(1).alias("label")),
        F.struct(F.col("neg_pid").alias("pid"), F.lit(0).alias("label")),
    )
    return triplets.select("qid", F.explode(pair).alias("p")).select("qid", "p.pid", "p.label")


def relevant_pairs(qrels: DataFrame, min_label: int | None = None) -> DataFrame:
    """Distinct relevant (qid, pid). The label column is ignored unless `min_label` is given."""
    if min_label is not None:
        qrels = qrels.filter(F.col("label") >= min_label)
    return one_per_key(qrels, ["qid", "pid"])


def label_candidates(run: DataFrame, qrels: DataFrame, min_label: int | None = None, strict: bool = False) -> DataFrame:
    """Label 1 where the candidate is relevant for its query, else 0.

    A query without qrels gets zeros; `strict` makes it an error.
    """
    if strict:
        run = lookup(run, one_per_key(qrels, ["qid"]), "qid")
    rel = relevant_pairs(qrels, min_label).withColumn("_rel", F.lit(1))
    return run.join(rel, ["qid", "pid"], "left").withColumn("label", F.coalesce("_rel", F.lit(0))).drop("_rel")


def drop_relevant(run: DataFrame, qrels: DataFrame, min_label: int | None = None) -> DataFrame:
    """Candidates that are not relevant for their query; ranks are kept as they were."""
    return run.join(relevant_pairs(qrels, min_label), ["qid", "pid"], "left_anti")


def hydrate_triplets(triplets: DataFrame, queries: DataFrame, passages: DataFrame, strict: bool = True) -> DataFrame:
    """Triplets with their three texts; `qrel` repeats the positive id."""
    def texts(coll, key, text):
        return coll.select(F.col("id").alias(key), F.col("text").alias(text))

    out = lookup(triplets, texts(queries, "qid", "qid_text"), "qid", strict)
    out = lookup(out, texts(passages, "pos_pid", "pid_text_pos"), "pos_pid", strict)
    out = lookup(out, texts(passages, "neg_pid", "pid_text_neg"), "neg_pid", strict)
    return out.select(
        "qid_text", "pid_text_pos", "pid_text_neg", "qid", F.col("pos_pid").alias("pid_pos"),
        F.col("neg_pid").alias("pid_neg"), F.col("pos_pid").alias("qrel"),
    )


def hydrate_pairs(pairs: DataFrame, queries: DataFrame, passages: DataFrame, strict: bool = True) -> DataFrame:
    """Pairs with query and passage text."""
    out = lookup(pairs, queries.select(F.col("id").alias("qid"), F.col("text").alias("query_text")), "qid", strict)
    return lookup(out, passages.select(F.col("id").alias("pid"), F.col("text").alias("passage_text")), "pid", strict)


def subset_by_keys(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Rows whose key occurs in `keys`.

    Repeated keys are combined in the map tasks before they are shuffled.
    """
    return df.join(one_per_key(keys, [col]), col, "left_semi")


def referenced_texts(ids: DataFrame, collection: DataFrame) -> DataFrame:
    """The part of a collection that `ids` (one column `id`) refers to."""
    return subset_by_keys(collection, ids, "id")


def triplet_pids(triplets: DataFrame) -> DataFrame:
    """Distinct passage ids used as positive or negative."""
    return triplets.select(F.explode(F.array("pos_pid", "neg_pid")).alias("pid")).distinct()


def corpus_subset(collection: DataFrame, *idsets: DataFrame) -> DataFrame:
    """The part of a collection referred to by any of the id sets (column `id`)."""
    return referenced_texts(reduce(DataFrame.unionByName, [s.select("id") for s in idsets]), collection)


def triplet_stats(triplets: DataFrame) -> DataFrame:
    """Rows, distinct queries and distinct passages of a triplet table, in one row."""
    sides = triplets.select(
        "qid", F.posexplode(F.array("pos_pid", "neg_pid")).alias("side", "pid")
    )
    return sides.agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("triplets"),
        F.count_distinct("qid").alias("queries"),
        F.count_distinct("pid").alias("passages"),
    )


def profile(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Row count and distinct count per key column."""
    return df.agg(F.count("*").alias("rows"), *(F.count_distinct(c).alias(f"distinct_{c}") for c in keys))


def key_overlap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct keys on either side and in common, in one row."""
    def marked(df, side):
        return df.select(col).distinct().withColumn("_side", F.lit(side))

    sides = marked(a, 1).unionByName(marked(b, 2)).groupBy(col).agg(F.sum("_side").alias("_in"))
    return sides.agg(
        F.count_if(F.col("_in") != 2).alias("left_keys"),
        F.count_if(F.col("_in") != 1).alias("right_keys"),
        F.count_if(F.col("_in") == 3).alias("common_keys"),
    )


def list_slices(df: DataFrame, by: str, value: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Groups as lists in order, `by, start, values`: `values` holds the group's rows from place `start` (from 1) on.

    A record has `slice_rows` values at most, so no row grows with its group; places come from a
    range-partitioned sort that cuts through large groups.
    """
    placed = number_rows(df.select(by, value), [F.asc(value)], (by,), "_n")
    start = F.floor((F.col("_n") - 1) / slice_rows).cast("bigint") * slice_rows + 1
    return placed.withColumn("start", start).groupBy(by, "start").agg(F.array_sort(F.collect_list(value)).alias("values"))


def group_lists(qrels: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """`qid, start, values`: the pids of each query, sorted, duplicates kept."""
    return list_slices(qrels, "qid", "pid", slice_rows)


def score_pairs(run: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame, similarity="dot", strict: bool = False) -> DataFrame:
    """Rounded similarity of each (qid, pid), by name or as a function of two columns.

    Pairs without a vector are skipped, or raise if `strict`.
    """
    score = rounded(named_similarity(similarity)("_q", "_d"))
    q = query_vecs.select(F.col("id").alias("qid"), F.col("embedding").alias("_q"))
    d = doc_vecs.select(F.col("id").alias("pid"), F.col("embedding").alias("_d"))
    met = lookup(lookup(run, q, "qid", strict), d, "pid", strict)
    return met.withColumn("score", score).select(*run.columns, "score")


def words(text: str = "text") -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))


def build_vocabulary(collection: DataFrame) -> DataFrame:
    """`token, token_id`: the distinct words numbered from 1 in byte order; 0 is left for padding."""
    tokens = collection.select(F.explode(F.array_distinct(words())).alias("token")).distinct()
    return number_rows(tokens, [F.asc("token")], name="token_id").withColumn(
        "token_id", F.col("token_id").cast("int")
    )


def tokenize(collection: DataFrame, vocabulary: DataFrame, max_len: int | None = 128) -> DataFrame:
    """`id, tokens`: token ids of each text in order, cut to `max_len` words (None keeps all).

    Unknown words are dropped. Every row gives a row, also where ids repeat. Texts become blocks of codes with a dictionary each; only
    the dictionaries meet the vocabulary, tokens themselves are never shuffled one by one.
    """
    return mapped(pin(word_blocks(collection, max_len)), vocabulary)


def pad_tokens(tokens: DataFrame, max_len: int = 128) -> DataFrame:
    """`id, input_ids, attention_mask`, both exactly `max_len` long; 0 pads."""
    kept = F.least(F.size("tokens"), F.lit(max_len))
    padded = F.slice(F.concat("tokens", F.array_repeat(F.lit(0), max_len)), 1, max_len)
    mask = F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: (i <= kept).cast("int"))
    return tokens.select("id", padded.alias("input_ids"), mask.alias("attention_mask"))
