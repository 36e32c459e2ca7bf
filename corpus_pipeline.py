"""The corpus pipeline: five stages over `documents`, each written as Parquet and read by the next.

Rejected documents go, repeated lines go, near copies go, sources are mixed to their target weights, and
what is left is encoded. A document that loses all its lines to earlier documents goes with them.

Defined cases, for every stage: a null text is an empty one and stays null; an empty table gives an empty table; columns a stage does not need
keep their values, whatever they are called. Each stage's docstring says what it does with the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densekit.llm import bpe, line_dedup, minhash, mixing, quality
from densekit.llm.common import full_text, shielded
from densekit.session import pin, tune

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject: null, empty and short texts, repetitive ones, and outliers of their language
    and source (null is one of each). Repeated rows and rows of one doc_id, null or not, are judged each by its own text, very long texts whole."""
    tune(spark)
    return shielded(docs, lambda d: quality.quality_rules(d).filter("kept"), COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines. `n_chars` follows the text.

    Of equal windows of three lines the first by doc_id (null first), row key and place stays; rows alike in doc_id and text are one place, so
    neither loses lines to the other. A text that loses all its lines goes."""
    tune(spark)

    def clean(d: DataFrame) -> DataFrame:
        cleaned = line_dedup.line_dedup(d.withColumn("_null", F.col("text").isNull()))
        left = cleaned.filter((F.col("n_removed") == 0) | full_text("text").rlike(r"[^\x20\x09-\x0D]"))
        left = left.withColumn("text", F.when(~F.col("_null"), F.col("text")))
        changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast(d.schema["n_chars"].dataType))
        return left.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))

    return shielded(docs, clean, COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that of the smallest doc_id, null last; of
    rows that agree in doc_id and text one. Texts without words are in no group and stay."""
    tune(spark)
    return shielded(docs, lambda d: minhash.drop_near_duplicates(d, SHINGLE_WORDS, SIMILAR_PERCENT), COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target rate says; a null source is one. Repeated rows, and rows of one doc_id,
    are drawn alike; documents without words add nothing to a source and are drawn at its rate."""
    tune(spark)
    return shielded(docs, mixing.mix, COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of each row, and whether they decode to its text, in one pass; an empty text has no ids."""
    tune(spark)
    encoded = bpe.encode_checked(docs.select("doc_id", "source", "text"), bpe.default_path())
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: The robust estimate and the components of a graph are loops that SQL does not state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
