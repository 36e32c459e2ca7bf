"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has `SLOTS` slots, into which the ids are hashed; every shard has `nodes` virtual nodes at slots of
its own, and an arc is what lies between two nodes, served by the node at its end. A shard may hold
n / shards rows, rounded down, and the first n mod shards of them one more: the room is that of all
rows, so counts differ by one at most (the law `rows`).

Arcs fill their own shard first, in ring order. What overflows goes on clockwise to the next other shard, in
as many rounds as there are other shards; a round is a running sum per shard over the arcs. So only rows
above a shard's share move, and none that fits its own shard is pushed out by another's overflow.

That plan is made on the counts of the arcs, a table of shards x nodes rows. Rows are counted and
numbered by cell, a part of an arc: a 2^20th of the ring, so the largest sort is that of one cell. A row's
number in its arc picks its piece of the plan, and with it shard and slot.

Defined cases: a null text has no bytes and CRC 0; rows with a null id are hashed by their text; rows with the
same id lie in one cell, ordered by their other columns, and alike rows are exchangeable; an empty table gives an empty result;
input columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densekit.llm.common import full_text, keep_columns
from densekit.session import pin

SLOT_BITS, CELL_BITS = 12, 20
SLOTS = 1 << SLOT_BITS
NODES = 64
_OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def ring(shards: int, nodes: int = NODES) -> tuple[list[int], list[list[int]]]:
    """The arc of every slot, and for every arc the shards in clockwise order, its own first."""
    if shards * nodes > SLOTS // 2:
        raise ValueError("too many nodes for the ring")
    owner: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            digest = hashlib.sha256(f"{shard}:{node}".encode()).digest()
            slot = int.from_bytes(digest[:8], "big") % SLOTS
            while slot in owner:
                slot = (slot + 1) % SLOTS
            owner[slot] = shard
    ends = sorted(owner)
    arc_of, arc = [], 0
    for slot in range(SLOTS):
        while arc < len(ends) and ends[arc] < slot:
            arc += 1
        arc_of.append(arc % len(ends))
    around = [owner[s] for s in ends]
    return arc_of, [list(dict.fromkeys(around[i:] + around[:i])) for i in range(len(ends))]


def _lookup(values: list[int], at):
    return F.get(F.lit(values), at)


def plan(loads: DataFrame, shards: int, orders: list[list[int]]) -> DataFrame:
    """From the rows of each arc (`_arc`, `_n`) to pieces: `_arc`, `_from`, `_to` (numbers in the arc), `shard`, `_base` (slot of
    the first). Every window runs over the arcs alone."""
    spark = loads.sparkSession
    arcs = spark.range(len(orders)).select(F.col("id").cast("int").alias("_arc")).join(loads, "_arc", "left")
    everything = Window.partitionBy()
    df = arcs.select("_arc", F.coalesce("_n", F.lit(0)).alias("_left")).withColumn("_all", F.sum("_left").over(everything))
    share = F.floor(F.col("_all") / shards).cast("long")
    df = df.withColumns({f"_cap{s}": share + (F.lit(s) < F.col("_all") % shards).cast("long") for s in range(shards)})
    df = df.withColumns({f"_room{s}": F.col(f"_cap{s}") for s in range(shards)} | {"_from": F.lit(0).cast("long"), "_pieces": F.array().cast("array<struct<_from:bigint,_to:bigint,shard:int,_base:bigint>>")})

    def of_shard(name: str):
        return reduce(lambda other, s: F.when(F.col("_s") == s, F.col(f"{name}{s}")).otherwise(other), range(shards), F.lit(0))

    for hop in range(shards):
        df = df.withColumn("_s", _lookup([order[hop] for order in orders], F.col("_arc")))
        earlier = Window.partitionBy("_s").orderBy("_arc").rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_before", F.coalesce(F.sum("_left").over(earlier), F.lit(0)))
        df = df.withColumn("_take", F.greatest(F.lit(0), F.least(F.col("_left"), of_shard("_room") - F.col("_before"))))
        piece = F.struct(
            F.col("_from").alias("_from"), (F.col("_from") + F.col("_take")).alias("_to"), F.col("_s").cast("int").alias("shard"),
            (of_shard("_cap") - of_shard("_room") + F.col("_before")).alias("_base"),
        )
        used = {s: F.sum(F.when(F.col("_s") == s, F.col("_take")).otherwise(0)).over(everything) for s in range(shards)}
        df = df.withColumns(
            {f"_room{s}": F.col(f"_room{s}") - used[s] for s in used}
            | {
                "_pieces": F.when(F.col("_take") > 0, F.concat("_pieces", F.array(piece))).otherwise(F.col("_pieces")),
                "_left": F.col("_left") - F.col("_take"), "_from": F.col("_from") + F.col("_take"),
            }
        )
    return df.select("_arc", F.explode("_pieces").alias("_p")).select("_arc", "_p.*")


def assign(docs: DataFrame, shards: int = 8, nodes: int = NODES, text: str = "text", id: str = "doc_id") -> DataFrame:
    """`docs` with `size` (UTF-8 bytes + 1), `text_crc32`, `law`, `shard`, `slot` (gapless in the shard) and `grown_shard`, null under
    this law. The rows of `docs` are shuffled once, by cell: leave out columns that are not needed."""
    arc_of, orders = ring(shards, nodes)
    rows = docs.select(
        *keep_columns(docs, *_OUT),
        (F.octet_length(full_text(text)) + 1).cast("long").alias("size"),
        F.crc32(full_text(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(id).cast("string"), full_text(text))).alias("_h"),
    )
    return place(rows, shards, arc_of, orders, id)


def place(rows: DataFrame, shards: int, arc_of: list[int], orders: list[list[int]], id: str) -> DataFrame:
    placed = rows.withColumn("_cell", F.shiftrightunsigned("_h", 64 - CELL_BITS).cast("int")).withColumn(
        "_arc", _lookup(arc_of, F.shiftrightunsigned("_h", 64 - SLOT_BITS).cast("int"))
    )
    # a cell is a part of a slot and so of an arc; numbers in the arc follow cell, then hash
    along = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_arc", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = pin(counts.withColumn("_offset", F.coalesce(F.sum("_n").over(along), F.lit(0))))
    pieces = pin(plan(cells.groupBy("_arc").agg(F.sum("_n").alias("_n")), shards, orders))
    within = Window.partitionBy("_cell").orderBy("_h", id, "text_crc32", "size")
    numbered = placed.withColumn("_i", F.row_number().over(within)).join(cells.select("_cell", "_offset"), "_cell")
    numbered = numbered.withColumn("_i", F.col("_i") + F.col("_offset") - 1)
    # at most shards pieces for each of shards x nodes arcs: a size fixed by the parameters
    met = numbered.join(F.broadcast(pieces), "_arc").filter((F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to")))
    return met.withColumns({
        "slot": F.col("_base") + F.col("_i") - F.col("_from"), "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int"),
    }).drop("_h", "_cell", "_arc", "_i", "_offset", "_from", "_to", "_base")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The documents as one folder per shard, each file holding a run of slots in order."""
    assigned = assign(docs, **options).drop("law", "grown_shard")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = assigned.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
