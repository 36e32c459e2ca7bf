"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Each text becomes a row of statistics (`STATISTICS`): counts of words, lines and kinds of characters, shares of repeated words,
lines and pairs, lengths, entropy. Nothing of a row but its text is looked at. The trees of `boosting.py` are
fitted on the driver on a sample of labelled rows of documented size, `Sample.rows`, those with the smallest hashes;
their flat arrays, of a size that `Growth` fixes, are sent to the tasks, which score Arrow batches with numpy. No row is shuffled.

Defined cases: a null text is empty; an empty text has statistics of zeros and a score like any other; a null id is spelled as
the empty string when rows are held out; labels that are null or that contradict each other for an id are not learned from; with no
labels, or of one class only, every row gets the same score; repeated rows get equal scores; an empty table gives an
empty result; of the input columns only `doc_id` and `text` are read, and `doc_id` for holding out only.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densekit.llm.boosting import Growth, Trees, constant, fit
from densekit.llm.common import row_key

SPACES = b" \t\n\x0b\x0c\r"
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": SPACES,
    "stop": b".!?", "exclaim": b"!", "comma": b",;:", "bar": b"|", "symbol": b"#*$%&<>^~\\=+@_", "bracket": b"(){}[]", "quote": b"\"'`-/",
}
STATISTICS = (
    "n_words", "mean_word", "longest_word", "short_words", "long_words", "distinct_words", "top_word", "repeated_pairs", "follow_self",
    "lone_marks", "ending_marks", "capital_words", "shout_words", "n_lines", "mean_line", "repeated_lines", "longest_line", "text_bytes",
    "entropy", "beyond_ascii", *_KINDS,
)
_MARKS = tuple("#*$%&|<>!?~^=+@_")


@dataclass(frozen=True)
class Sample:
    """What the classifier learns from."""

    rows: int = 20_000  # labelled rows the trees are fitted on, at most
    held_out: int = 2  # rows whose CRC-32 of the id, modulo 4, is this are never learned from


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    data = text.encode("utf-8", "surrogatepass")
    size = len(data)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if size else np.zeros(256, np.int64)
    words = data.split()  # parts bytes at ASCII white space
    n, lines = len(words), [x for x in data.split(b"\n") if x.strip(SPACES)]
    out = [0.0] * 20
    if n:
        counts, lengths = Counter(words), np.fromiter(map(len, words), np.int64, n)
        pairs = n - 1 - len(set(zip(words, words[1:]))) if n > 1 else 0
        marks = [w for w in words if w[-1:] in _MARK_BYTES]
        out[:13] = [
            np.log1p(n), lengths.mean(), np.log1p(lengths.max()), (lengths <= 2).mean(), (lengths >= 12).mean(), len(counts) / n,
            max(counts.values()) / n, pairs / n, sum(map(bytes.__eq__, words, words[1:])) / n, sum(len(w) == 1 for w in marks) / n,
            len(marks) / n, sum(w[0] in _UPPER for w in words) / n, sum(w.isupper() and len(w) > 1 for w in words) / n,
        ]
    if lines:
        longest = max(map(len, lines))
        out[13:17] = [np.log1p(len(lines)), np.log1p(sum(map(len, lines)) / len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(longest)]
    if size:
        share = histogram[histogram > 0] / size
        out[17:20] = [np.log1p(size), float(-(share * np.log2(share)).sum()), histogram[128:].sum() / size]
    return out + [float(histogram[k].sum()) / max(size, 1) for k in _KIND_BYTES]


_KIND_BYTES = [np.frombuffer(k, np.uint8) for k in _KINDS.values()]
_MARK_BYTES = frozenset(m.encode() for m in _MARKS)
_UPPER = frozenset(_KINDS["upper"])


def _matrix(batch: pa.Array) -> np.ndarray:
    rows = [statistics(t or "") for t in batch.to_pylist()]
    return np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))


def with_statistics(docs: DataFrame, name: str = "statistics") -> DataFrame:
    """`docs` with the statistics of the text as an array of double."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = _matrix(batch)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, "array<double>")("text"))


def held_out(doc_id, sample: Sample = Sample()) -> Column:
    """Whether a row is kept for judging the classifier."""
    spelled = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(spelled.cast("binary")) % 4 == sample.held_out


def learned_rows(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """`label`, `statistics` of the rows learned from, at most `sample.rows`, in no particular order.

    The labels are cut to the sample before they meet the documents, so what is broadcast is bounded; the rows met are cut
    again, as an id may stand in many.
    """
    clear = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_max"))
    clear = clear.filter(F.col("label").isin(0, 1) & (F.col("label") == F.col("_max")) & ~held_out("doc_id", sample))
    some = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample.rows).select("doc_id", F.col("label").cast("int"))
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", *row_key("doc_id", "text"), "text")
    narrow = with_statistics(met).select("label", "_k1", "_k2", "statistics")
    return narrow.orderBy("_k1", "_k2").limit(sample.rows).select("label", "statistics")


def learn(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), growth: Growth = Growth()) -> Trees:
    """The classifier: trees that score the statistics of a text."""
    rows = learned_rows(docs, labels, sample).toArrow()
    if not rows.num_rows:
        return constant(0.5)
    x = rows["statistics"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, len(STATISTICS))
    y = rows["label"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # sums of floats do not depend on how the rows arrived
    return fit(x[order], y[order], growth)


def with_score(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """`docs` with the probability that a text is of class 1."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(sent.value.score(_matrix(batch)), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, "double")("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: Sample = Sample(), growth: Growth = Growth()) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` (1 from the threshold on) of every document."""
    scored = with_score(docs.select("doc_id", "text"), learn(docs, labels, sample, growth))
    return scored.select(
        "doc_id", held_out("doc_id", sample).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
