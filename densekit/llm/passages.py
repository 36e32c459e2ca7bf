"""Passages repeated between documents, by a sparse suffix array.

Only suffixes that begin at minimisers are kept: of every `MIN_WORDS` - `GRAM` + 1 consecutive grams
of `GRAM` words the one with the smallest hash. The choice depends on the words alone, so every passage of
`MIN_WORDS` words holds a kept suffix, and wherever the passage occurs, the same one. Suffixes whose
first gram occurs once in the corpus cannot belong to a repeated passage; they are dropped by an
aggregation over the grams' hashes, before any text is fetched.

The others are sorted by the words that follow. Neighbours share the longest beginning that either shares with
any suffix; their match is extended to the left and right, and counts if it has `MIN_WORDS` words. As a suffix
further on may share less to the right but more to the left, each is compared with the next `REACH`. Where a gram has more
suffixes than these meet, every window of `MIN_WORDS` words that holds one of them is hashed (64 bits); windows
that occur twice are matches.
A match covers words; what is covered in a text is merged into spans.

Exact copies are one text: it is handled once, and the whole text is a span of each copy.

Words are compared by 64-bit hashes in the choice of suffixes and by 24 bits of them in the sorted
comparison, where a match takes at least `MIN_WORDS` equal ones; so one end of a match in some ten million
lies a word too far.

Defined cases: null, empty and short texts have no spans; a null doc_id is an id like any other; rows alike in
doc_id and text are one document and give one row per span; repeats within one text count, if they do not
overlap themselves into one run; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from densekit.llm.neighbours import sorted_neighbours
from densekit.llm.shingles import fold, words_of
from densekit.operators.prep import one_per_key
from densekit.session import pin

MIN_WORDS, GRAM = 50, 16
REACH = 8  # suffixes after each one in the order that it is compared with
WORD_BYTES = 3  # of a word's hash, in the sorted comparison
_ROWS_AT_A_TIME = 4096


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (np.minimum or np.maximum) over every window of `width` values, by doubling."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = pick(out[:-step], out[step:])
        reach += step
    return out


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the values that are least in some window of `width`; equal ones all count."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    least = _sliding(grams, width, np.minimum)
    # a value is chosen if it is the least of a window holding it: the greatest of those windows' least
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == grams)


def suffixes(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`doc_id`, text key `_t1`, `_t2`, `n_words` and `_s`: the kept suffixes as (gram hash, place)."""
    item = pa.struct([("g", pa.int64()), ("p", pa.int32())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, grams_of, places_of = [], [], []
            for text in batch.cast(pa.binary()):
                h = words_of(text.as_py() or b"")[0]
                counts.append(len(h))
                if len(h) >= min_words:
                    grams = fold([h[k : len(h) - GRAM + 1 + k] for k in range(GRAM)])
                    at = minimisers(grams, min_words - GRAM + 1)
                else:
                    grams, at = h, np.zeros(0, np.int64)
                grams_of.append(grams[at].view(np.int64))
                places_of.append(at.astype(np.int32))
            upto = np.cumsum([0, *map(len, places_of)])
            flat = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((grams_of, np.int64), (places_of, np.int32))]
            items = pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(item))
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), items)
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists], names=["n", "s"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, "n long, s array<struct<g:long,p:int>>")
    keyed = docs.select("doc_id", *_text_key(), made("text").alias("_u"))
    return keyed.select("doc_id", "_t1", "_t2", F.col("_u.n").alias("n_words"), F.col("_u.s").alias("_s"))


def _text_key():
    return [F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(0x5EED), "text").alias("_t2")]


def word_codes(text: bytes | None) -> bytes:
    """`WORD_BYTES` bytes of each word's hash, not all 0, one after another."""
    h = words_of(text or b"")[0]
    low = h & np.uint64((1 << 8 * WORD_BYTES) - 1)
    return np.maximum(low, 1).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()


def contexts(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """`_after` (the words from the suffix on), `_before` (those before it, backwards), `_t1`, `_t2`, `_p`."""

    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([word_codes(text.as_py()) for text in batch.cast(pa.binary())], pa.binary())

    codes.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    coded = docs.select(F.col("doc_id").alias("_doc"), *_text_key(), F.arrow_udf(codes, "binary")("text").alias("_words"))
    met = coded.join(wanted.hint("merge"), ["_t1", "_t2"]).filter(F.col("_doc").eqNullSafe(F.col("_first")))
    once = met.groupBy("_t1", "_t2").agg(F.first("_words").alias("_words"), F.first("_ps").alias("_ps"))
    before = min_words - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, words, places in zip(*batch.columns):
                words = np.frombuffer(words.as_py(), np.uint8).reshape(-1, WORD_BYTES)
                padded = np.zeros((len(words) + before + min_words, WORD_BYTES), np.uint8)
                padded[before : before + len(words)] = words
                places = np.sort(places.values.to_numpy())
                for at in range(0, len(places), _ROWS_AT_A_TIME):
                    p = places[at : at + _ROWS_AT_A_TIME]
                    after = padded[p[:, None] + np.arange(before, before + min_words)]
                    left = padded[p[:, None] + np.arange(before - 1, -1, -1)]
                    n = len(p)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r.tobytes() for r in after], pa.binary()), pa.array([r.tobytes() for r in left], pa.binary()),
                            pa.array([t1.as_py()] * n, pa.int64()), pa.array([t2.as_py()] * n, pa.int64()), pa.array(p, pa.int32()),
                        ],
                        names=["_after", "_before", "_t1", "_t2", "_p"],
                    )

    return once.mapInArrow(run, "_after binary, _before binary, _t1 long, _t2 long, _p int")


def _words(column: pa.Array) -> np.ndarray:
    """Values of one length as an array of rows, words and bytes, without a copy."""
    upto = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[upto[0] : upto[-1]].reshape(len(column), -1, WORD_BYTES)


def _common(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Equal words at the beginning; the zeros past a text's end equal nothing."""
    a, b = _words(x), _words(y)
    differ = (a != b).any(axis=2) | ~a.any(axis=2)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def matches(found: DataFrame, min_words: int) -> DataFrame:
    """Covered words of texts: `_t1`, `_t2`, `_from`, `_to`."""
    result = T.StructType([T.StructField(c, T.LongType()) for c in ("_t1", "_t2", "_from", "_to")])

    def compare(x: pa.RecordBatch, y: pa.RecordBatch) -> list[pa.Array]:
        r, l = (_common(x.column(i), y.column(i)) for i in (0, 1))
        hit = np.flatnonzero((r >= GRAM) & (l + r >= min_words))
        pieces = []
        for rows in (x, y):
            t1, t2, p = (rows.column(i).to_numpy()[hit].astype(np.int64) for i in (2, 3, 4))
            pieces.append((t1, t2, p - l[hit], p + r[hit]))
        return [pa.array(np.concatenate(c)) for c in zip(*pieces)]

    return sorted_neighbours(found, ["_after", "_before", "_t1", "_t2", "_p"], compare, result, REACH)


def windows(docs: DataFrame, crowd: DataFrame, min_words: int) -> DataFrame:
    """The windows of `min_words` words that hold a suffix of `crowd` (`_t1`, `_t2`, `_first`, `_crowd`: its places) and occur
    more than once: `_t1`, `_t2`, `_from`, `_to`."""
    texts = docs.select(F.col("doc_id").alias("_doc"), *_text_key(), "text").join(crowd, ["_t1", "_t2"])
    same = texts.filter(F.col("_doc").eqNullSafe(F.col("_first")))
    once = same.groupBy("_t1", "_t2").agg(F.first("text").alias("text"), F.first("_crowd").alias("_crowd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, text, places in zip(*batch.columns):
                h = words_of(text.as_py().encode())[0]
                last = len(h) - min_words
                starts = places.values.to_numpy()[:, None] - np.arange(min_words - GRAM + 1)
                starts = np.unique(starts[(starts >= 0) & (starts <= last)])
                hashes = fold([h[k : last + 1 + k] for k in range(min_words)])[starts].view(np.int64)
                for at in range(0, len(starts), _ROWS_AT_A_TIME):
                    p = starts[at : at + _ROWS_AT_A_TIME]
                    n = len(p)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes[at : at + n]), pa.array([t1.as_py()] * n, pa.int64()),
                            pa.array([t2.as_py()] * n, pa.int64()), pa.array(p.astype(np.int64)),
                        ],
                        names=["_h", "_t1", "_t2", "_from"],
                    )

    found = pin(once.mapInArrow(run, "_h long, _t1 long, _t2 long, _from long"))
    twice = one_per_key(found, ["_h"], F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_h")
    return found.join(twice, "_h").select("_t1", "_t2", "_from", (F.col("_from") + min_words).alias("_to"))


def merged(covered: DataFrame) -> DataFrame:
    """Overlapping and touching pieces of a text as one: `_t1`, `_t2`, `start`, `end`."""
    along = Window.partitionBy("_t1", "_t2").orderBy("_from", "_to")
    seen = F.max("_to").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(seen.isNull() | (F.col("_from") > seen), 1).otherwise(0)
    runs = covered.distinct().withColumn("_open", opens).withColumn("_run", F.sum("_open").over(along))
    return runs.groupBy("_t1", "_t2", "_run").agg(F.min("_from").alias("start"), F.max("_to").alias("end")).drop("_run")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`doc_id`, `start`, `end` (words, `end` exclusive) and `n_words` of every stretch of a document that repeats passages
    of `min_words` words or more."""
    base = pin(suffixes(docs, min_words))
    texts = base.filter(F.size("_s") > 0).groupBy("_t1", "_t2").agg(F.min("doc_id").alias("_first"), F.first("_s").alias("_s"))
    places = texts.select("_t1", "_t2", "_first", F.explode("_s").alias("_e")).select("_t1", "_t2", "_first", "_e.g", "_e.p")
    # with a shuffle of its own for the join, a gram found everywhere is split by AQE
    grams = one_per_key(places, ["g"], F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    grams = grams.select("g", (F.col("_c") > REACH + 1).alias("_many"))
    met = places.join(grams, "g").groupBy("_t1", "_t2")
    crowded = F.collect_set(F.when(F.col("_many"), F.col("p"))).alias("_crowd")
    wanted = pin(met.agg(F.collect_set("p").alias("_ps"), crowded, F.first("_first").alias("_first")))
    covered = matches(contexts(docs, wanted.drop("_crowd"), min_words), min_words)
    crowd = wanted.filter(F.size("_crowd") > 0).select("_t1", "_t2", "_first", "_crowd")
    if not crowd.isEmpty():
        covered = covered.unionByName(windows(docs, crowd, min_words))
    spans = merged(covered)
    rows = base.select("doc_id", "_t1", "_t2", "n_words").distinct()
    copies = rows.groupBy("_t1", "_t2", "n_words").agg(F.count(F.lit(1)).alias("_c")).filter((F.col("_c") > 1) & (F.col("n_words") >= min_words))
    whole = copies.select("_t1", "_t2", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    parts = spans.join(copies.select("_t1", "_t2"), ["_t1", "_t2"], "left_anti")
    table = pin(parts.unionByName(whole))
    return rows.drop("n_words").join(table, ["_t1", "_t2"]).select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
