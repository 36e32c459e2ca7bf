"""Near-duplicate documents by an LSH forest over MinHash signatures.

A text is the set of its word shingles, its class all texts with the same set. Each class has
`TREES` x `DEPTH` minima. A tree is the order of all classes by its own `DEPTH` minima; in it, neighbours
share the longest prefix that any other class shares with them, so the depth at which two classes part
adapts to the region: many minima among look-alikes, few elsewhere. Neighbours that share at least
`MIN_DEPTH` minima in any tree, and whose set sizes allow the similarity, are candidates: in a tree each class
meets the `REACH` after it.

Candidates whose whole signatures are alike enough are confirmed on the full sets. Links make components; every document gets the smallest
doc_id of its component.

More than `REACH` + 1 classes that share `MIN_DEPTH` minima in a tree are a crowd: some of them did not meet. The classes of all crowds
that are of more than one component are joined exactly by prefixes (`crowd_links`): of two similar sets, ordered by how rare the shingles are among
these classes, the smaller one's first 8% (at 0.85) and the larger one's first 15% share a shingle. Shingles that all look-alikes hold come last and
are in no prefix unless a set has hardly any of its own, and pairs within a component are never formed, so a crowd is not compared pair by pair.
So any two classes that share `MIN_DEPTH` minima in any tree are found, or are in one component already, however many look-alikes
stand between them.

At similarity 0.85 two classes share three minima in a tree with probability 0.61 and so miss each
other in all 16 trees with probability below 1e-6. Sets are of 64-bit hashes.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing;
a text with fewer words than a shingle is one shingle; rows with the same doc_id have results of their own
text each; a null doc_id names a component only if all of it is null; an empty table gives an empty
result; input columns named like an output are replaced.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from densekit.llm.common import row_key
from densekit.llm.components import components
from densekit.llm.neighbours import sorted_neighbours
from densekit.llm.shingles import shingle_sets
from densekit.session import pin

TREES, DEPTH, MIN_DEPTH, REACH = 16, 8, 3, 2
BUCKETS = 1 << 20  # of the table that tells rare shingles from frequent ones
FILTER_BITS = 1 << 25  # of the filter that keeps texts from a shuffle
_OUT = ("n_shingles", "component_id", "kept")
_RANDOM = np.random.Generator(np.random.PCG64(850320))
_FACTORS = (_RANDOM.integers(0, 2**31, TREES * DEPTH, np.uint32) * 2 + 1).astype(np.uint32)[:, None]
_OFFSETS = _RANDOM.integers(0, 2**32, TREES * DEPTH, np.uint32)[:, None]
_PIECE = 2048


def signature(shingles: np.ndarray) -> bytes:
    """The minima of a non-empty set, big-endian, so that bytes sort like numbers."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = None
    for at in range(0, len(x), _PIECE):
        low = (_FACTORS * x[at : at + _PIECE] + _OFFSETS).min(axis=1)
        least = low if least is None else np.minimum(least, low)
    return least.astype(">u4").tobytes()


def _texts(batch: pa.Array) -> list[bytes]:
    """Lower-cased (A to Z) UTF-8; null is empty."""
    return [b"" if t is None else t.lower() for t in batch.cast(pa.binary()).to_pylist()]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """`doc_id`, row key, `n_shingles`, `class` (128-bit hash of the set), `signature` and `brief`, its low
    bytes; these are null if the set is empty."""
    kind = pa.struct([("n_shingles", pa.int64()), ("class", pa.binary()), ("signature", pa.binary()), ("brief", pa.binary())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [
                (len(s), xxhash.xxh3_128_digest(s.tobytes()), m := signature(s), m[3::4]) if len(s) else (0, None, None, None)
                for s in shingle_sets(_texts(batch), size)
            ]
            columns = zip(*rows) if rows else [[], [], [], []]
            yield pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind)], fields=list(kind))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, "n_shingles long, class binary, signature binary, brief binary")
    return docs.select("doc_id", *row_key("doc_id", "text"), made("text").alias("_s")).select("doc_id", "_k1", "_k2", "_s.*")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """`class`, `text` -> `class`, `shingles` (array of long)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = list(shingle_sets(_texts(batch), size))
            upto = np.cumsum([0, *map(len, sets)])
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return texts.select("class", F.arrow_udf(run, "array<long>")("text").alias("shingles"))


def forest_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Candidates `a` < `b` from the trees over `class`, `n_shingles`, `signature`."""
    width = 4 * DEPTH
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.cast("byte").alias("tree"), F.substring("signature", t * width + 1, F.lit(width)).alias("minima")),
    )
    rows = classes.select("class", "n_shingles", F.explode(trees).alias("_t")).select("_t.*", "class", "n_shingles")
    result = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def compare(before: pa.RecordBatch, after: pa.RecordBatch) -> list[pa.Array]:
        x, y = (
            np.frombuffer(b"".join(r.column("minima").to_pylist()), np.uint32).reshape(-1, DEPTH) for r in (before, after)
        )
        n, m = (r.column("n_shingles").to_numpy() for r in (before, after))
        fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        same_tree = before.column("tree").to_numpy() == after.column("tree").to_numpy()
        hit = pa.array(same_tree & fits & (x[:, :MIN_DEPTH] == y[:, :MIN_DEPTH]).all(axis=1))
        p, q = before.column("class").filter(hit), after.column("class").filter(hit)
        less = pc.less(p, q)
        return [pc.if_else(less, p, q), pc.if_else(less, q, p)]

    return sorted_neighbours(rows, ["tree", "minima", "class"], compare, result, REACH).distinct()


def least_agreement(percent: int) -> int:
    """Equal minima, of all, that two sets at the similarity have but once in 10^11 cases: seven standard deviations."""
    share, n = percent / 100, TREES * DEPTH
    return int(n * (share - 7 * (share * (1 - share) / n) ** 0.5))


def agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The candidates whose signatures are as alike as those of similar sets are; the full sets, many times
    as long, are fetched for these alone. One byte of each minimum is compared: equal minima have equal bytes."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, TREES * DEPTH) for s in (a, b))
        return pa.array((x == y).sum(axis=1), pa.int32())

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    of_a, of_b = (classes.select(F.col("class").alias(side), F.col("brief").alias(f"_{side}")) for side in "ab")
    equal = F.arrow_udf(run, "int")("_a", "_b")
    return pairs.join(of_a, "a").join(of_b, "b").withColumn("_equal", equal).filter(F.col("_equal") >= least_agreement(percent)).select("a", "b")


def possible(keys: DataFrame) -> np.ndarray:
    """A table of `FILTER_BITS` bits, eight a byte, with that of every key (column `_k1`) set: whatever the number of keys, its size is fixed;
    with very many of them it lets everything pass."""
    size = FILTER_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = _place(batch.column(0), size)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from _pieces_of(bits)

    return _merged(keys.select("_k1").mapInArrow(mark, _PIECE_TYPE), np.uint8, np.bitwise_or, size // 8)


def _place(keys: pa.Array, bits: int) -> np.ndarray:
    """The bit of each key."""
    return (keys.to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(bits)).astype(np.int64)


_PIECE_TYPE = "piece int, data binary"
_PIECES = 64


def _pieces_of(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table in compressed pieces, those of zeros left out."""
    for i, part in enumerate(table.reshape(_PIECES, -1)):
        if part.any():
            data = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "data": pa.array([data], pa.binary())})


def _merged(pieces: DataFrame, kind, merge, size: int) -> np.ndarray:
    """One table from those of all tasks, merged piece by piece in tasks; what comes to the driver is one table of fixed size."""
    width = size // _PIECES * np.dtype(kind).itemsize

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield i, np.frombuffer(pa.decompress(data, width, codec="zstd", asbytes=True), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for i, part in parts(batches):
            held[i] = merge(held[i], part) if i in held else part
        for i, part in held.items():
            data = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "data": pa.array([data], pa.binary())})

    table = np.zeros((_PIECES, size // _PIECES), kind)
    for i, part in parts(pieces.repartition("piece").mapInArrow(run, _PIECE_TYPE).toArrow().to_batches()):
        table[i] = part
    return table.ravel()


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """`class`, `shingles` of the wanted classes. Rows that cannot be wanted are left out before the texts are shuffled."""
    rows = pin(classes.select("class", "_row._k1", "_row._k2").join(wanted, "class", "left_semi"))
    side = docs.sparkSession.sparkContext.broadcast(possible(rows))

    def may(keys: pa.Array) -> pa.Array:
        at = _place(keys, 8 * len(side.value))
        return pa.array((side.value[at >> 3] >> (at & 7)) & 1 == 1)

    may.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    some = docs.select("text", *row_key("doc_id", "text")).filter(F.arrow_udf(may, "boolean")("_k1"))
    # a shuffle at every size: of several rows with the key, one is taken; a key is of one class, so the texts are shuffled once
    texts = some.join(rows.hint("merge"), ["_k1", "_k2"]).groupBy("_k1", "_k2", "class").agg(F.first("text").alias("text"))
    return pin(full_sets(texts.select("class", "text"), size))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `a`, `b` whose full sets are similar."""
    of_a, of_b = (sets.withColumnsRenamed({"class": side, "shingles": f"_{side}"}) for side in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    met = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", both.alias("_both"), (F.size("_a") + F.size("_b")).alias("_sum"))
    return met.filter(F.col("_both") * 100 >= F.lit(percent) * (F.col("_sum") - F.col("_both"))).select("a", "b")


def gathered(rows: DataFrame) -> DataFrame:
    """Classes: `class`, `n_shingles`, `doc_id` (the smallest), signature, `brief` and the key of a row."""
    return pin(
        rows.filter("class is not null").groupBy("class").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
            F.first("brief").alias("brief"), F.min(F.struct("_k1", "_k2")).alias("_row"),
        )
    )


def crowds(classes: DataFrame) -> DataFrame:
    """`head`, `class`: the crowds, by a hash of tree and first minima, and the classes in them."""
    heads = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.xxhash64(t, F.substring("signature", t * 4 * DEPTH + 1, F.lit(4 * MIN_DEPTH))),
    )
    rows = classes.select("class", F.explode(heads).alias("head"))
    large = pin(rows.groupBy("head").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > REACH + 1).select("head"))
    return pin(rows.join(large, "head"))


def crowded(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`class`, `root` of the classes that are in a crowd of more than one component."""
    rows = members.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    several = rows.groupBy("head").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo != _hi").select("head")
    return pin(rows.join(several, "head", "left_semi").select("class", "root").distinct())


def rarity(sets: DataFrame) -> np.ndarray:
    """For each of `BUCKETS` hash buckets, how many of the sets' shingles fall into it: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount((values % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        yield from _pieces_of(total)

    return _merged(sets.select("shingles").mapInArrow(count, _PIECE_TYPE), np.int64, np.add, BUCKETS)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """`class`, `root`, `shingles` -> `element`, `ref` and `root` (64 bits of class and root), `n`, `place`, `lead`: the first, rarest, shingles of each
    set that a similar set can share, `lead` of them if that set is not smaller. Shingles that only one set holds are left out."""
    side = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = side.value
        for batch in batches:
            for at in range(batch.num_rows):
                values = batch.column("shingles")[at].values.to_numpy(zero_copy_only=False)
                held = table[(values.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)]
                order = np.lexsort((values, held))
                n = len(values)
                # the overlap needed is at least percent / 100 of n, and of 2 n / (1 + percent / 100) if the other is not smaller
                probe = n - -(-percent * n // 100) + 1
                lead = n - -(-2 * percent * n // (100 + percent)) + 1
                first = order[:probe]
                place = np.flatnonzero(held[first] > 1)
                m = len(place)
                ref, root = (int.from_bytes(batch.column(c)[at].as_py()[:8], "big", signed=True) for c in ("class", "root"))
                yield pa.RecordBatch.from_pydict({
                    "element": pa.array(values[first[place]]), "ref": pa.array(np.full(m, ref)), "root": pa.array(np.full(m, root)),
                    "n": pa.array(np.full(m, n, np.int32)), "place": pa.array(place.astype(np.int32)), "lead": pa.array(place < lead),
                })

    return sets.select("class", "root", "shingles").mapInArrow(run, "element long, ref long, root long, n int, place int, lead boolean")


def crowd_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links `a`, `b` between the roots of components that hold similar classes of a crowd, by an exact prefix-filter join over `members`
    (`class`, `root`).

    Pairs of one component need not be found. Of the rows with one shingle, those of its most frequent root, which may be thousands, meet only the
    rows of other roots.
    """
    rows = pin(prefixes(sets.join(members, "class"), percent))
    roots = rows.groupBy("element", "root").agg(F.count(F.lit(1)).alias("_c"))
    most = roots.groupBy("element").agg(F.max(F.struct("_c", "root")).alias("_m"), F.count(F.lit(1)).alias("_roots"))
    shared = pin(most.filter("_roots > 1").select("element", F.col("_m.root").alias("_most")))
    rows = pin(rows.join(shared, "element").withColumn("_main", F.col("root") == F.col("_most")).drop("_most"))
    small, large = (rows.select("element", *(F.col(c).alias(f"_{c}_{s}") for c in ("ref", "root", "n", "place", "lead", "_main"))) for s in "ab")
    # at these places the sets share one shingle, and at most all behind both places
    need = -(-F.lit(percent) * (F.col("_n_a") + F.col("_n_b")) / F.lit(100 + percent))
    left = 1 + F.least(F.col("_n_a") - F.col("_place_a") - 1, F.col("_n_b") - F.col("_place_b") - 1)
    first = (F.col("_n_a") < F.col("_n_b")) | ((F.col("_n_a") == F.col("_n_b")) & (F.col("_ref_a") < F.col("_ref_b")))
    fits = (F.col("_n_a") * 100 >= F.col("_n_b") * percent) & (left >= need) & first & (F.col("_root_a") != F.col("_root_b"))
    leads = small.filter("_lead_a")
    met = leads.filter("not __main_a").join(large, "element").filter(fits).select("_ref_a", "_ref_b").unionByName(
        leads.filter("__main_a").join(large.filter("not __main_b"), "element").filter(fits).select("_ref_a", "_ref_b")
    )
    named = pin(members.select("class", F.conv(F.hex(F.substring("class", 1, 8)), 16, -10).cast("long").alias("_ref")))
    a, b = (named.select(F.col("_ref").alias(f"_ref_{s}"), F.col("class").alias(s)) for s in "ab")
    pairs = pin(met.distinct().join(a, "_ref_a").join(b, "_ref_b").select("a", "b"))
    similar = confirmed(pairs, sets, percent)
    of_a, of_b = (members.select(F.col("class").alias(s), F.col("root").alias(f"_{s}")) for s in "ab")
    return similar.join(of_a, "a").join(of_b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """`doc_id`, row key, `n_shingles`, `component_id` and `group`, the hash that names the component (null without words), for every row."""
    rows = pin(sketches(docs, size))
    classes = gathered(rows)
    pairs = pin(agreeing(forest_pairs(classes.select("class", "n_shingles", "signature"), percent), classes, percent))
    crowd = crowds(classes)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(crowd.select("class")).distinct()
    sets = sets_of(docs, classes, wanted, size)
    roots = pin(components(confirmed(pairs, sets, percent)).withColumnsRenamed({"node": "class"}))
    wider = components(crowd_links(crowded(crowd, roots), sets, percent)).select(F.col("node").alias("root"), F.col("root").alias("_wider"))
    rooted = classes.select("class", "doc_id").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    rooted = pin(rooted.join(wider, "root", "left").select("class", "doc_id", F.coalesce("_wider", "root").alias("root")))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    table = pin(rooted.select("class", "root").join(named, "root").select("class", "component_id", F.col("root").alias("group")))
    found = rows.select("doc_id", "_k1", "_k2", "n_shingles", "class").join(table, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.withColumn("component_id", component).drop("class")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`doc_id`, row key, `n_shingles`, `component_id` and `kept` (doc_id = component_id) for every row."""
    return grouped(docs, size, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("group")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs` for each group: that of the smallest doc_id (null last), of several with it the one of the smallest row key, and
    one of the rows alike in id and text. Rows without words are in no group and all stay."""
    found = pin(grouped(docs, size, percent).select("doc_id", "_k1", "_k2", "group"))
    keyed = found.filter("group is not null").groupBy("group", "doc_id", "_k1", "_k2").agg(F.count(F.lit(1)).alias("_alike"))
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_k1", "_k2", "_alike")
    stays = keyed.groupBy("group").agg(F.min(order).alias("_f")).select("_f._k1", "_f._k2", "_f._alike")
    lone = found.filter("group is null").select("_k1", "_k2").distinct().withColumn("_alike", F.lit(0).cast("long"))
    wanted = pin(stays.unionByName(lone))
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*row_key("doc_id", "text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    single = rows.join(wanted.filter("_alike < 2").select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").select(*names.values())
    # of alike rows the least by a hash; each task sends one of them
    hashed = F.xxhash64(*[names[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()])
    several = rows.join(wanted.filter("_alike > 1").select("_k1", "_k2"), ["_k1", "_k2"])
    one = several.groupBy("_k1", "_k2").agg(F.min_by(F.struct(*names.values()), hashed).alias("_row")).select("_row.*")
    return single.unionByName(one).select(*[F.col(n).alias(c) for c, n in names.items()])
