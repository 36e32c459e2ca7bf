"""Quality rules: text statistics, plain rules, and robust multivariate outliers.

The outlier verdict is a minimum-covariance-determinant (MCD) estimate per language and source. It
starts from the medians, then takes concentration steps: each keeps, in every group, the `support`
share of rows nearest to the present centre in Mahalanobis distance and computes centre and
covariance anew from them, enlarged by the factor that makes the covariance of the nearest share of normal rows that
of all (`consistency`). A row whose final squared distance exceeds the chi-square cut-off is
rejected. Little more than half of the rows need be good: the support is 0.55.

One step is one aggregation. Rows are summed per (group, distance bin), so that a group with a third of
all rows is pre-aggregated to a few hundred partial sums wherever its rows lie; a running sum over the
bins of a group finds the smallest ball holding the support, and its sums are the moments. No row is
moved, ranked or sampled. Distances are binned by their logarithm (`_BINS_PER_OCTAVE`), so the ball
holds the support or slightly more.

Groups with fewer than `min_group` judged rows join the rest of their language, and languages with
fewer the rest of all; a rest with fewer than `min_group` rows has no outliers.

Defined cases: a null or empty text has no words and fails the base rules; null languages and sources
are groups of their own; repeated rows count as often as they occur and get the same verdict; an empty
table gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densekit.llm.common import full_text, keep_columns, word_list
from densekit.session import pin

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BINS_PER_OCTAVE = 16
_EPS = 2.0**-20
SALTS = 8  # parts of a group that meet its estimate apart, where the estimates are too many to broadcast


@dataclass(frozen=True)
class Rules:
    """Parameters. `floors` are standard deviations below which a spread is not taken for real, but raised to them: most
    texts have no symbol at all, and a covariance of zeros would make any symbol infinitely far."""

    min_words: int = 50
    max_repeat_percent: int = 50
    support: float = 0.55
    steps: int = 5
    min_group: int = 50
    tail: float = 1e-5
    #: log words, log word length, symbol share, share of repeated lines, share of repeated words
    floors: tuple[float, ...] = (1.5, 0.08, 0.01, 0.15, 0.15)


def chi_square_cut(dims: int, tail: float) -> float:
    """The value a chi-square variable exceeds with probability `tail` (Wilson and Hilferty)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - tail)
    return dims * (1 - 2 / (9 * dims) + z * math.sqrt(2 / (9 * dims))) ** 3


def consistency(dims: int, support: float) -> float:
    """What the covariance of the nearest `support` of normal rows is multiplied by to be that of all."""
    from statistics import NormalDist

    x, d = chi_square_cut(dims, 1 - support), dims + 2
    z = ((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    return support / NormalDist().cdf(z)


def _let(value: Column, body) -> Column:
    """`body(value)`, evaluating the value once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are told apart by 64-bit hashes.

    Hashes are sorted with their positions, so equal ones are neighbours; texts without a repeat, the
    most, stop at the count of distinct hashes.
    """

    def covered(s: Column) -> Column:
        same = F.filter(
            s,
            lambda e, i: (F.get(s, i - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(e["h"])),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda e: F.sequence(e["i"], e["i"] + 2)))))

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(placed, covered))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words` (long)."""
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))
    three = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
    )
    counts = [
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.when(F.col("_t").rlike(f"[{SYMBOLS}]"), symbols).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w"), F.col("_h")).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("_lines"),
    ]
    # the explode of one element is a border over which Spark does not copy expressions: what is made of
    # the counts later reads them instead of counting again
    return (
        docs.select(*keep_columns(docs, *COUNTS, "_t", "_w", "_n", "_l", "_h"), full_text(text).alias("_t"))
        .withColumn("_w", word_list(F.col("_t")))
        .withColumn("_l", lines)
        .withColumn("_n", F.size("_w"))
        .withColumn("_h", F.when(F.col("_n") >= 3, three).otherwise(F.array().cast("array<bigint>")))
        .select(*keep_columns(docs, *COUNTS, "_t", "_w", "_n", "_l", "_h"), F.explode(F.array(F.struct(*counts))).alias("_counts"))
        .select(*keep_columns(docs, *COUNTS, "_t", "_w", "_n", "_l", "_h"), "_counts.*")
    )


def _vector(stats: DataFrame, rules: Rules) -> DataFrame:
    """Adds `base_failed`, and the transformed statistics `_x0`..: null in rows that the base rules reject."""
    words = F.col("n_words").cast("double")
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.lit(rules.max_repeat_percent) * F.col("n_words")
    )
    xs = [
        F.log(words),
        F.log(F.col("word_chars") / words),
        F.col("n_symbols") / F.col("word_chars"),
        F.col("n_dup_lines") / F.col("_lines"),
        F.col("n_repeat_words") / words,
    ]
    # rules.min_words may be 0: a text without words has no statistics and is never an outlier
    judged = ~failed & (F.col("n_words") > 0)
    return stats.withColumns(
        {"base_failed": failed} | {f"_x{j}": F.when(judged, x / rules.floors[j]) for j, x in enumerate(xs)}
    )


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _invert(moments: DataFrame, p: int, factor: float) -> DataFrame:
    """From count and sums to the centre `_m*` and the inverse `_u*` of the lower Cholesky factor.

    A variance of the scaled statistics below 1, the square of the floor, is raised to 1 on the diagonal, so the factor exists
    whatever the rows are, and a wider spread never counts less.
    """
    # one select, in which an expression may name the ones before it
    steps = {f"m{i}": f"_s{i} / _c" for i in range(p)}
    for i, j in _pairs(p):
        own = f"{factor!r}D * (_q{i}_{j} / _c - m{i} * m{j})"
        steps[f"v{i}_{j}"] = f"greatest({own}, 1D)" if i == j else own
    for i, j in _pairs(p):
        rest = " - ".join([f"v{i}_{j}", *[f"l{i}_{k} * l{j}_{k}" for k in range(j)]])
        steps[f"l{i}_{j}"] = f"sqrt(greatest({rest}, 1e-9D))" if i == j else f"({rest}) / l{j}_{j}"
    for j in range(p):
        for i in range(j, p):
            rest = " - ".join(["1D" if i == j else "0D", *[f"l{i}_{k} * u{k}_{j}" for k in range(j, i)]])
            steps[f"u{i}_{j}"] = f"({rest}) / l{i}_{i}"
    solved = moments.selectExpr("_g", *[f"{value} as {name}" for name, value in steps.items()])
    return solved.selectExpr(
        "_g", *[f"round(m{i}, 9) as _m{i}" for i in range(p)], *[f"round(u{i}_{j}, 9) as _u{i}_{j}" for i, j in _pairs(p)]
    )


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimate."""
    total = F.lit(0.0)
    for i in range(p):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"_u{i}_{j}") * (F.col(f"_x{j}") - F.col(f"_m{j}"))
        total = total + part * part
    return total


def _concentrate(rows: DataFrame, p: int, support: float, distance: Column) -> DataFrame:
    """Moments of the nearest `support` of each group's rows."""
    bins = F.floor(F.log2(distance + _EPS) * _BINS_PER_OCTAVE)
    sums = {f"_s{i}": F.col(f"_x{i}") for i in range(p)} | {
        f"_q{i}_{j}": F.col(f"_x{i}") * F.col(f"_x{j}") for i, j in _pairs(p)
    }
    parts = rows.withColumn("_b", bins).groupBy("_g", "_b").agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(v).alias(k) for k, v in sums.items()]
    )
    upto = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_g")
    run = parts.select(
        "_g", "_b", F.sum("_c").over(upto).alias("_c"), F.sum("_c").over(whole).alias("_all"), F.col("_c").alias("_own"),
        *[F.sum(k).over(upto).alias(k) for k in sums],
    )
    need = F.ceil(F.col("_all") * support)
    return run.filter((F.col("_c") >= need) & (F.col("_c") - F.col("_own") < need))


def _groups(rows: DataFrame, min_group: int) -> DataFrame:
    """language, source -> `_g`: the pair itself, or the rest of the language, or the rest of all."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_c"))
    small = F.sum(F.when(F.col("_c") < min_group, F.col("_c")).otherwise(0)).over(Window.partitionBy("lang"))
    nothing = F.lit(None).cast("string")
    name = (
        F.when(F.col("_c") >= min_group, F.struct(F.lit(0).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")))
        .when(F.col("_small") >= min_group, F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), nothing.alias("source")))
        .otherwise(F.struct(F.lit(2).alias("level"), nothing.alias("lang"), nothing.alias("source")))
    )
    return sizes.withColumn("_small", small).select("lang", "source", F.to_json(name).alias("_g"))


def fit(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Centre and scatter of every group, one row per (lang, source): written to the shared folder.

    `stats` has the columns of `measure`, `lang` and `source`; it is read once per step, so pass a
    written table. What is sent around is one row per group.
    """
    p = len(rules.floors)
    judged = _vector(stats, rules).filter("_x0 is not null")
    groups = pin(_groups(judged, rules.min_group))
    rows = judged.select("lang", "source", *[f"_x{i}" for i in range(p)])
    rows = _with(rows, groups).withColumn("_salt", F.pmod(F.xxhash64(*[f"_x{i}" for i in range(p)]), F.lit(SALTS)))
    # medians as the first centre, unit spread (the floors) as the first scatter
    start = rows.groupBy("_g").agg(*[F.percentile_approx(f"_x{i}", 0.5, 1000).alias(f"_m{i}") for i in range(p)])
    params = pin(start.select(
        "_g", *[F.col(f"_m{i}") for i in range(p)], *[F.lit(1.0 if i == j else 0.0).alias(f"_u{i}_{j}") for i, j in _pairs(p)]
    ))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    for _ in range(rules.steps):
        met = rows.join(params.withColumn("_salt", salts), ["_g", "_salt"])
        near = _concentrate(met, p, rules.support, _distance(p))
        params = pin(_invert(near.filter(F.col("_all") >= rules.min_group), p, consistency(p, rules.support)))
    return pin(groups.join(params, "_g", "left"))


def _with(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the columns that a (lang, source) table has for them, nulls matching."""
    table = table.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    met = rows["lang"].eqNullSafe(table["_lang"]) & rows["source"].eqNullSafe(table["_source"])
    return rows.join(table, met, "left").drop("_lang", "_source")


def judge(stats: DataFrame, params: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds `base_failed`, `distance` (squared; null where there is no estimate) and `kept` to measured rows."""
    p = len(rules.floors)
    scored = _with(_vector(stats, rules).drop("distance", "kept"), params).withColumn("distance", _distance(p))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi_square_cut(p, rules.tail))
    work = ["_lines", "_g", *[f"_x{i}" for i in range(p)], *[f"_m{i}" for i in range(p)], *[f"_u{i}_{j}" for i, j in _pairs(p)]]
    return scored.withColumn("kept", kept).drop(*work)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """`docs` with the counts, `base_failed`, `distance` and `kept`.

    The estimates come from a narrow written table of counts; the texts are read a second time for the
    verdict instead of being written or shuffled.
    """
    measured = measure(docs, text)
    narrow = pin(measured.select("lang", "source", *COUNTS, "_lines"))
    return judge(measured, fit(narrow, rules), rules)
