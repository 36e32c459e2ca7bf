"""Mixing sources to target weights.

Sizes are words. The sources in order of their code points, null last, weigh `weights`, repeating, and
share `budget` times the size of all documents; no source gets more than `most` times its own size,
and what is above that is shared anew by weight until no source is above. That fixed point is found
without a loop: with sources sorted by size per weight, those that reach their limit come first, and the
largest "rest of the budget / rest of the weights" over that order is what every other source gets
per weight.

A document of a source with target / size = r is taken floor(r) times and once more if its own draw,
a hash of doc_id and seed, is below the fraction of r. So the mix does not depend on partitioning, and
reruns agree.

The documents are read twice and never shuffled: sizes are summed per source (map-side first), and the
targets, one row per source, are written and joined back.

Defined cases: a null or empty text has size 0 and is taken by the same draw; a null source is a source
of its own; rows with the same doc_id share a draw; a source without words has target 0 and its
documents are not taken; an empty table gives an empty result; input columns named like an output are
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densekit.llm.common import full_text, keep_columns, n_words, unit_draw, unit_draw_sql
from densekit.session import pin

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = "mix"
_OUT = ("size", "source_size", "target", "copies", "taken")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """`source`, `source_size` -> with `target`. One row per source in, the windows run over those alone."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("_rank", order).withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("_limit", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    by_need = Window.orderBy(F.col("_limit") / F.col("_w"), "_rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_need.rowsBetween(0, Window.unboundedFollowing)
    per_weight = (
        F.sum("source_size").over(everything) * float(budget) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    ) / F.sum("_w").over(onwards)
    return (
        weighed.withColumn("_each", per_weight)
        .withColumn("target", F.least(F.col("_limit"), F.max("_each").over(everything) * F.col("_w")))
        .select("source", "source_size", "target")
    )


def plan_mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """`docs` with `size`, `source_size`, `target` (double), `copies` and `taken` = copies x size (long)."""
    sized = docs.select(*keep_columns(docs, *_OUT), n_words(full_text("text")).alias("size"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = pin(targets(sums, weights, budget, most)).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(table, sized["source"].eqNullSafe(table["_source"]), "left").drop("_source").withColumn("_r", rate)
    extra = unit_draw(F.col("doc_id"), seed) < F.col("_r") - F.floor("_r")
    copies = F.floor("_r").cast("long") + extra.cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_r")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as they are taken, with the columns of `docs`."""
    planned = plan_mix(docs, **options).filter("copies > 0")
    repeated = planned.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(seed: str = SEED) -> str:
    return rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
sums as (
  select source, sum(size)::bigint as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w,
         row_number() over (order by source nulls last) as rank
  from sized group by source),
each as (
  select *, source_size * 2.0::double as cap,
         (sum(source_size) over () * 1.5::double
          - coalesce(sum(source_size * 2.0::double) over (order by source_size * 2.0::double / w, rank rows between unbounded preceding and 1 preceding), 0))
         / sum(w) over (order by source_size * 2.0::double / w, rank rows between current row and unbounded following) as per_weight
  from sums),
goals as (select source, source_size, least(cap, max(per_weight) over () * w) as target from each),
rated as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as r
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (floor(r)::bigint + case when {unit_draw_sql('doc_id', seed)} < r - floor(r) then 1 else 0 end) * size as taken
from rated
"""
