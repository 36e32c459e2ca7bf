"""Column helpers the operators share.

Every operator follows the same rules. Output columns are named in its docstring; an input column of
such a name is replaced, every other input column passes through. Work columns start with `_`. A row
is known by `row_key`, a 128-bit hash of id and text, so that null or repeated ids need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"  # what parts words


def full_text(text) -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_list(text: Column) -> Column:
    """The words of a non-null text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns, `_k1` and `_k2`; never null."""
    return [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(0x5EED), *columns).alias("_k2")]


def unit_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only (52 bits of an MD5)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def unit_draw_sql(key: str, seed: str) -> str:
    """The same in DuckDB."""
    return f"(('0x' || substr(md5('{seed}:' || coalesce(cast({key} as varchar), 'null')), 1, 13))::bigint / {float(2**52)!r}::double)"


def keep_columns(df: DataFrame, *drop: str) -> list[Column]:
    """The columns of `df` but those an operator is about to write."""
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in {d.lower() for d in drop}]


def shielded(docs: DataFrame, stage, needed: tuple[str, ...]) -> DataFrame:
    """`stage(docs)` with the columns of `docs`; those it does not need keep their values, whatever they are called."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns) if c.lower() not in needed}
    done = stage(docs.withColumnsRenamed(names))
    return done.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])
