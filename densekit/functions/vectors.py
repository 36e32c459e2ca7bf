"""Vector arithmetic on array columns, evaluated in the JVM in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_PLACES = 6  # scores are rounded to this many places before they are ranked or compared


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _gaps(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))


def dot(a, b) -> Column:
    """Inner product."""
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def normalize(v) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(1e-12))
    # the one-element array lets the length be worked out once instead of once per element
    return F.flatten(
        F.transform(
            F.array(length), lambda n: F.transform(_col(v), lambda x: x.cast("double") / n)
        )
    )


def cosine(a, b) -> Column:
    """Inner product of the two unit vectors."""
    floor = F.lit(1e-12)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def cosine_distance(a, b) -> Column:
    return 1 - cosine(a, b)


def l2sq(a, b) -> Column:
    """Squared Euclidean distance."""
    return _total(F.transform(_gaps(a, b), lambda x: x * x))


def euclidean(a, b) -> Column:
    return F.sqrt(l2sq(a, b))


def manhattan(a, b) -> Column:
    return _total(F.transform(_gaps(a, b), F.abs))


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_PLACES)


DISTANCES = {"euclidean": euclidean, "cosine": cosine_distance, "manhattan": manhattan}
SIMILARITIES = {"dot": dot, "cosine": cosine}


def distance(name: str):
    """Distance function by name; an unknown name raises."""
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name!r}, expected one of {sorted(DISTANCES)}")
    return DISTANCES[name]


def similarity(name):
    """Similarity by name, or a function of two columns as it is."""
    if callable(name):
        return name
    if name not in SIMILARITIES:
        raise ValueError(f"unknown similarity {name!r}, expected one of {sorted(SIMILARITIES)}")
    return SIMILARITIES[name]
