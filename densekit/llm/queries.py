"""The registered queries: each operator over its whole table, and the SQL it must agree with."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densekit.llm import alignment, bpe, classifier, html, impact, line_dedup, minhash, mixing, passages, pii, quality, sharding, spelling
from densekit.session import pin, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(tune(spark), sf_dir)
        if check is not None:
            CHECKS[name] = check
        return build

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_impact_topk", impact.ORACLE)
def _op1(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return impact.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


@query("op2_quality_rules")
def _op2(spark, sf_dir):
    measured = quality.measure(_documents(spark, sf_dir))
    narrow = pin(measured.select("doc_id", "lang", "source", *quality.COUNTS, "_lines"))
    judged = quality.judge(narrow, quality.fit(narrow))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def digests(encoded: DataFrame) -> DataFrame:
    """Rows with `ids` and `decoded`: the digest columns instead."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(joined, 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }).drop("ids", "decoded")


@query("op3_bpe")
def _op3(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    encoded = bpe.encode(docs, bpe.default_path()).drop("text")
    return digests(bpe.decode(encoded, bpe.default_path(), text="decoded"))


@query("op4_html_text")
def _op4(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op5_line_dedup", line_dedup.ORACLE)
def _op5(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


@query("op6_ring_shards")
def _op6(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return sharding.assign(docs, shards=8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op7_pii_boosting")
def _op7(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    rows = pii.by_document(docs, pii.pii_spans(docs))
    base = F.filter("_spans", lambda s: s["base"])

    def spelled(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("_spans")).alias("spans"))


@query("op8_mixing", mixing.oracle())
def _op8(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_suffix_passages")
def _op9(spark, sf_dir):
    return passages.repeated_passages(_documents(spark, sf_dir).select("doc_id", "text"))


@query("op10_minhash_forest")
def _op10(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return minhash.near_duplicates(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


@query("op11_token_alignment")
def _op11(spark, sf_dir):
    aligned = alignment.align(_documents(spark, sf_dir), *alignment.default_paths())
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.withColumn("groups_sha256", digest).drop("groups")


@query("op12_spelling_variants")
def _op12(spark, sf_dir):
    return spelling.variants(_documents(spark, sf_dir))


@query("op13_quality_trees")
def _op13(spark, sf_dir):
    return classifier.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
