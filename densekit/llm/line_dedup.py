"""Line dedup by overlapping windows of three lines.

The lines of a text are parted by \\n; lines without a word are left out of the count. Every three
consecutive lines are a window, known by a 128-bit hash. Of each window that occurs more than once in
the whole corpus, the occurrence with the smallest (doc_id, row hash, place) stays; the lines that
any other occurrence covers are removed. Overlapping occurrences are merged by the set of covered
lines, so a long repeated passage goes as one.

Only hashes are shuffled: one partially aggregated pass finds each window's first occurrence, a join
finds the others (a hot window is split by AQE), and the removed places of a text, no more than it has
lines, meet its row by the row's own hash.

Defined cases: a null text is empty; texts with fewer than three lines that have a word are unchanged;
a null doc_id sorts first; rows alike in doc_id and text are one place, so none removes lines of the
other; an empty table gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densekit.llm.common import full_text, keep_columns, row_key

_OUT = ("text", "n_lines", "n_removed")


def _worded(text):
    """The lines that have a word, with their places."""
    placed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(placed, lambda e: e["x"].rlike(r"[^\x20\x09-\x0D]"))


def windows(docs: DataFrame) -> DataFrame:
    """`doc_id`, `_k1`, `_k2`, `_j` (the place among worded lines), `_h1`, `_h2` of every window."""
    lines = docs.select("doc_id", *row_key("doc_id", "text"), _worded(full_text("text")).alias("_l"))
    starts = F.sequence(F.lit(0), F.size("_l") - 3)
    hashed = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("_j"),
            F.xxhash64(*[F.get("_l", i + d)["x"] for d in range(3)]).alias("_h1"),
            F.xxhash64(F.lit(3), *[F.get("_l", i + d)["x"] for d in range(3)]).alias("_h2"),
        ),
    )
    return (
        lines.filter(F.size("_l") >= 3)
        .select("doc_id", "_k1", "_k2", F.explode(hashed).alias("_e"))
        .select("doc_id", "_k1", "_k2", "_e.*")
    )


def repeated(found: DataFrame) -> DataFrame:
    """The occurrences of windows after their first one: `_k1`, `_k2`, `_j`."""
    place = F.struct("doc_id", "_k1", "_k2", "_j")
    first = (
        found.groupBy("_h1", "_h2")
        .agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
        .filter(F.col("_first") != F.col("_last"))
        .select("_h1", "_h2", "_first")
    )
    return found.join(first, ["_h1", "_h2"]).filter(place != F.col("_first")).select("_k1", "_k2", "_j")


def line_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with `text` without the repeated lines, `n_lines` (lines before) and `n_removed` (long)."""
    places = repeated(windows(docs)).groupBy("_k1", "_k2").agg(F.collect_set("_j").alias("_js"))
    covered = F.array_distinct(F.flatten(F.transform("_js", lambda j: F.sequence(j, j + 2))))
    rows = docs.select(*keep_columns(docs, *_OUT), full_text("text").alias("text"), *row_key("doc_id", "text"))
    hit = (
        rows.join(places, ["_k1", "_k2"], "left")
        .withColumn("_lines", F.split("text", "\n"))
        .withColumn("_w", F.when(F.col("_js").isNotNull(), F.transform(_worded(F.col("text")), lambda e: e["i"])))
        .withColumn("_gone", F.transform(covered, lambda j: F.get("_w", j)))
        .withColumn("_stay", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")))
    )
    cleaned = F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")
    return hit.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_removed": F.when(F.col("_js").isNull(), 0).otherwise(F.size("_gone")).cast("long"),
        "text": F.when(F.col("_js").isNull(), F.col("text")).otherwise(cleaned),
    }).drop("_k1", "_k2", "_js", "_lines", "_w", "_gone", "_stay")


ORACLE = r"""
with lines as (
  select doc_id, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as x,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents),
worded as (
  select doc_id, text, x, i, row_number() over (partition by doc_id order by i) as j
  from lines where regexp_matches(x, '[^\x20\x09-\x0D]')),
wins as (
  select doc_id, i, j, x as a, lead(x) over w as b, lead(x, 2) over w as c
  from worded window w as (partition by doc_id order by i)),
marked as (
  select doc_id, j, row_number() over (partition by a, b, c order by doc_id, j) as occurrence
  from wins where c is not null),
gone as (
  select distinct w.doc_id, w.i from worded w join marked m
    on m.doc_id = w.doc_id and m.occurrence > 1 and w.j between m.j and m.j + 2)
select l.doc_id, count(*) as n_lines, count(g.i) as n_removed,
       coalesce(string_agg(case when g.i is null then l.x end, chr(10) order by l.i), '') as text
from lines l left join gone g on g.doc_id = l.doc_id and g.i = l.i
group by l.doc_id
"""
