"""Words grouped with their spelling variants: pairs one edit apart by asymmetric q-chunks.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Of two such words the shorter
(or either, if they are equally long) is cut into two disjoint chunks, its halves; the edit touches one of them, so the
other stands unchanged in the longer word, and at most one place away from where it was: a first half at the same place,
a last half at the same distance from the end. The longer word gives the grams with their places that can meet such a chunk: of each size
that a word as long, or one shorter, has chunks of, those at a place within shift one. Chunks and grams meet in an equi join on
(length of the cut word, size, place, gram); the pairs are verified by their edit distance.

Many short words share a half. What lies outside the chunk holds the edit, so it is cut into two chunks again, and one of these is unchanged
too: a key has a half and one of the two parts of the other half. So a key holds at least three quarters of a word and
few words agree in it, other than words that differ in that quarter alone; no group of words is ever gathered, the join is of rows.
All joins are sort-merge joins: Spark takes keys to be as small as the words' file, and would gather and broadcast many times that.

A word's form is the near word of largest count (ties: the smallest in code-point order) if that is at least `ratio` times its
own. Counts grow by that factor along forms, so a chain has no cycle and at most log2 of the largest count steps; roots are found by
doubling pointers.

Defined cases: null and empty texts have no words; a null id is spelled as the empty string; repeated rows count as often as they
stand there; an empty table gives an empty result; only the id and text columns are read, whatever the others are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densekit.llm.common import full_text
from densekit.session import pin

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 97  # one run of so many loses a code point


def runs(docs: DataFrame) -> DataFrame:
    """`word`: every run of every text, lower-cased from A to Z, some with a code point less (see the contract: by the CRC-32
    of id and run)."""
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.translate(full_text("text"), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("_run"),
    )
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (h % F.char_length("_run")).cast("int")
    less = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    return found.select(F.when(h % SLIP == 0, less).otherwise(F.col("_run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """`word`, `n`: words long and frequent enough."""
    counted = words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _gram(word: Column, place: Column, size: Column) -> Column:
    return F.substring(word, (place + 1).cast("int"), size.cast("int"))


def _keys(length: Column, shift: Column) -> Column:
    """The four keys of a word for cut words of `length`, given that it is longer by `shift`: (length, which, both grams).

    Key 0 and 1: the first half, and the first or last part of the second half. Key 2 and 3: the second half, and the first or last
    part of the first. A gram behind the edit stands `shift` places further on.
    """
    word = F.col("word")
    half = F.floor(length / 2).cast("int")
    other = length - half
    cut, cut_first = F.floor(other / 2).cast("int"), F.floor(half / 2).cast("int")
    zero = F.lit(0)
    first, second = _gram(word, zero, half), _gram(word, half + shift, other)
    parts = [
        (first, _gram(word, half, cut)),
        (first, _gram(word, half + cut + shift, other - cut)),
        (_gram(word, zero, cut_first), second),
        (_gram(word, cut_first + shift, half - cut_first), second),
    ]
    return F.array(*[
        F.struct(length.alias("length"), F.lit(i).cast("byte").alias("which"), a.alias("a"), b.alias("b")) for i, (a, b) in enumerate(parts)
    ])


def near_pairs(words: DataFrame) -> DataFrame:
    """`x`, `y`: the pairs of distinct words one edit apart, each once and in no particular order."""
    size = F.char_length("word")
    chunks = words.select(F.col("word").alias("x"), F.explode(_keys(size, F.lit(0))).alias("key"))
    grams = words.select(
        F.col("word").alias("y"),
        F.explode(F.concat(_keys(size, F.lit(0)), _keys(size - 1, F.lit(1)))).alias("key"),
    )
    met = chunks.hint("merge").join(grams, "key").filter(
        ((F.col("key.length") < F.char_length("y")) | (F.col("x") < F.col("y"))) & (F.levenshtein("x", "y", 1) == 1)
    )
    return met.select("x", "y").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root` of the words that have a form: pointers are doubled until all point to words without one."""
    at = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = pin(at.hint("merge").join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = joined.select("word", "root")
        if joined.filter("_moved").isEmpty():
            return at


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` of every word of the documents (`doc_id`, `text`)."""
    words = pin(vocabulary(runs(docs), least_length, least_count))
    pairs = near_pairs(words.select("word"))
    ways = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    both = pairs.select(F.explode(ways).alias("_w")).select("_w.*")
    counted = both.hint("merge").join(words.select(F.col("word").alias("y"), F.col("n").alias("_n")), "y")
    # of the largest count the smallest word: strings are in code-point order, as UTF-8 bytes are
    best = F.min(F.struct((-F.col("_n")).alias("_minus"), F.col("y").alias("word")))
    near = counted.groupBy(F.col("x").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    judged = words.hint("merge").join(near, "word", "left").withColumn("_found", -F.col("_best._minus") >= F.lit(ratio) * F.col("n"))
    known = pin(judged.select(
        "word", F.when(F.col("_found"), F.col("_best.word")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_found"), -F.col("_best._minus")).alias("form_n"),
    ))
    root = roots(known.filter("form is not null"))
    return known.hint("merge").join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
