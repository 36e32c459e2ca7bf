"""Readers. Every one casts ids to BIGINT and declares its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densekit import schemas

MODES = ("strict", "permissive")
# fixed value: the characters that str.strip() removes
_WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _fields(spark: SparkSession, path: str, split: str, last_empty: bool = False) -> DataFrame:
    """Lines without surrounding white space, as an array of fields; with `last_empty` a tab that ends the first field may end the line."""
    lines = spark.read.text(path).select(F.trim("value", F.lit(_WHITE)).alias("line"), F.ltrim("value", F.lit(_WHITE)).alias("whole"), "_metadata")
    fields = F.split("line", split, -1)
    if last_empty:
        fields = F.when(~F.contains("line", F.lit("\t")) & F.contains("whole", F.lit("\t")), F.array("line", F.lit(""))).otherwise(fields)
    return lines.select("line", fields.alias("f"), "_metadata")


def _values(layout: str) -> tuple[dict[str, Column], Column]:
    """The fields cast to `layout`, and whether a line has that shape."""
    columns = [part.strip().split(" ") for part in layout.split(",")]
    values = {name: F.get("f", i) if kind == "string" else F.get("f", i).try_cast(kind) for i, (name, kind) in enumerate(columns)}
    ok = F.size("f") == len(columns)
    for name, kind in columns:
        if kind != "string":
            ok = ok & values[name].isNotNull()
    return values, F.coalesce(ok, F.lit(False))


def _typed(lines: DataFrame, layout: str, mode: str, *extra: str) -> DataFrame:
    """Cast the fields to `layout`, keeping the columns `extra`.

    A line of another shape raises or is left out. Lines are turned into rows by `inline`, which
    is worked out once per line and cannot be pruned with the check in it.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    values, ok = _values(layout)
    row = F.array(F.struct(*(value.alias(name) for name, value in values.items()), *extra))
    rows = F.when(ok, row)
    if mode == "strict":
        rows = rows.otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.substring("line", 1, 200))))
    return lines.select(F.inline(rows))


def bad_lines(spark: SparkSession, path: str, layout: str = schemas.COLLECTION, split: str = "\t") -> DataFrame:
    """How many lines a permissive read of text in that layout leaves out, in one row."""
    _, ok = _values(layout)
    return _fields(spark, path, split).agg(F.count_if(~ok).alias("bad"), F.count("*").alias("lines"))


def read_collection(spark: SparkSession, path: str, mode: str = "strict", escaped: bool = False) -> DataFrame:
    """`id, text` from tab-separated lines of exactly two fields.

    The last line of an id wins, in the order of file names and of lines within a file. Read as
    text and not as CSV, because quotes in a passage are data. `escaped` reads what `write_tsv` writes so: a text may be
    empty, `\\N` is a null one, and of other texts that begin with a backslash the first one goes.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = _fields(spark, path, "\t", last_empty=escaped).withColumn("_at", place)
    text = F.max_by("text", "_at")
    if escaped:
        text = F.when(text != "\\N", F.when(F.startswith(text, F.lit("\\")), F.substr(text, F.lit(2))).otherwise(text))
    return _typed(lines, schemas.COLLECTION, mode, "_at").groupBy("id").agg(text.alias("text"))


def read_triplets(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """`qid, pos_pid, neg_pid`; duplicates stay."""
    return _typed(_fields(spark, path, "\t"), schemas.TRIPLETS, mode)


def read_qrels(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """`qid, iter, pid, label` from four fields parted by white space; duplicates stay."""
    return _typed(_fields(spark, path, r"\s+"), schemas.QRELS, mode)


def read_run_tsv(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """`qid, pid, rk` from three fields parted by white space."""
    return _typed(_fields(spark, path, r"\s+"), schemas.RUN, mode)


def read_run_json(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """`qid, pid, rk` from JSON objects `{qid: [pid, ...], ...}`, lists best first.

    One object per line; with `wholetext` objects may span lines, and a file that is one large object is read by
    many tasks. A key `qid@start` holds the part of a query's list that begins at rank `start`, as `write_run_json` makes for
    long lists. Text of another shape raises.
    """
    lists = _object_lists(spark, path) if wholetext else _line_lists(spark, path)
    key = F.split("key", "@")
    slices = lists.select(
        key[0].cast("bigint").alias("qid"), F.coalesce(F.get(key, 1).cast("int"), F.lit(1)).alias("start"), "pids"
    )
    return slices.select("qid", "start", F.posexplode("pids").alias("pos", "pid")).select(
        "qid", F.col("pid").cast("bigint").alias("pid"), (F.col("start") + F.col("pos")).alias("rk")
    )


def _line_lists(spark: SparkSession, path: str) -> DataFrame:
    lists = F.from_json("value", "map<string,array<string>>", {"mode": "FAILFAST"})
    return spark.read.text(path).select(F.explode(lists).alias("key", "pids"))


#: What stands before a key: the start of an object, a comma, or the end of one object and the start of the next
_ENTRY = r'^(?:\s*\{|\s*,|\s*\}\s*\{)\s*"([^"\\]+)"\s*:\s*(\[[^\[\]]*)$'
_REST = r"^\s*(?:\{?\s*\}\s*)*$"


def _object_lists(spark: SparkSession, path: str) -> DataFrame:
    """`key, pids` of objects of any size. Ids hold no bracket, so a closing one ends a list: the text is cut there, at any place
    of a file, and each piece is one key with its list."""
    pieces = spark.read.option("lineSep", "]").text(path)
    ids = F.from_json(F.concat(F.regexp_extract("value", _ENTRY, 2), F.lit("]")), "array<string>", {"mode": "FAILFAST"})
    entry = F.array(F.struct(F.regexp_extract("value", _ENTRY, 1).alias("key"), ids.alias("pids")))
    kind = "array<struct<key: string, pids: array<string>>>"
    wrong = F.raise_error(F.concat(F.lit("no list of ids under a key: "), F.substring("value", 1, 200))).cast(kind)
    # one expression, so that the check is never pruned and a list is looked at only where there is one
    found = F.when(F.col("value").rlike(_ENTRY), entry).when(F.col("value").rlike(_REST), F.array().cast(kind)).otherwise(wrong)
    return pieces.select(F.inline(found))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated values without a header, under the given names and types; quotes are data."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, sep="\t", quote="", escape="")


def read_embeddings(spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """`id, embedding` from parquet; other columns are not read."""
    return spark.read.parquet(path).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("embedding")
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TOKENS).parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """`qid, label` from the cluster lists that `write_labels` makes."""
    lists = spark.read.schema("label int, start bigint, `values` array<bigint>").json(path)
    return lists.select(F.explode("values").alias("qid"), "label")
