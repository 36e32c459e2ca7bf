"""Personal data: validated base rules, and high-recall candidates selected by boosted trees.

Base spans are emails, IPv4 addresses, payment cards and phone numbers by their patterns and checks. Generators with
wider patterns propose further spans: anything around an @, mails spelled out (`x at y dot z`), any long run of digit groups, with
or without a +, and IPv6 addresses; they may overlap each other and the base.

There are examples of personal data, the validated spans, but none of its absence: what fails a check may be personal data all the same. So
the trees learn from positive and unlabelled candidates. Gradient-boosted trees tell candidates that overlap a validated span of their kind from the
others, by features of the format and the context that do not restate the checks: no +, no counts of digits, no check sums; spelled-out mails are
seen as mails, IPv6 groups as numbers. Taking it that validated spans are a share c of all personal data, the same for every format and context, a
candidate is personal data with the probability p / c (Elkan and Noto), where c is the mean p of validated spans that the trees
have not seen, by kind. Candidates that touch no base span and reach the probability `sure` are added. So a number of the length and in the
places of cards that fails their check sum is added where most such numbers in such places are like validated ones, and look-alikes whose formats or
contexts validated spans do not have are not. A kind with fewer than `least` unseen validated spans takes c from all kinds.

Places of matches come from the text between them: a text split by a pattern gives the pieces whose lengths, summed over
the matches before, are the starts. Only matches are shuffled, as numbers. The trees learn from all candidates, and c is the mean over all
unseen validated ones: candidates alike in all features and the label are one row, weighted by their number.

Patterns are written so that no input makes them slow: runs are possessive and begin where a run begins.

Defined cases: a null text is empty and has no spans; rows alike in doc_id and text have the same spans each; an empty
table, and one with no or only validated candidates, adds nothing; input columns named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densekit.llm.common import full_text, row_key
from densekit.session import pin

KINDS = ("email", "ip", "card", "phone")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "at": r"(?:(?<![^\x20\x09-\x0D@])|\G)[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++",
    "digits": r"\+?\(?[0-9](?:[\x20().:/-]{0,2}[0-9]){6,}+",
    "spelled": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\x20(?:\(at\)|\[at\]|at)\x20[A-Za-z0-9-]++(?:\x20(?:\(dot\)|\[dot\]|dot)\x20[A-Za-z0-9-]++)++",
    "groups": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])",
}
#: What a text must contain for the pattern to be tried at all
_HINT = {
    "email": "@", "at": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
    "digits": r"[0-9][\x20().:/-]{0,2}[0-9][\x20().:/-]{0,2}[0-9]", "spelled": r"\x20[(\[]?dot[)\]]?\x20", "groups": r":[0-9A-Fa-f:]+:",
}
CONTEXT = 24
WORDS = {
    "email": "mail|contact|write|kontakt|correo", "ip": "ip|host|server|addr", "card": "card|visa|master|amex|credit|carte|karte|tarjeta",
    "phone": "tel|phone|call|fax|mobil|cell|whatsapp|sms",
}
#: Words that stand before other numbers
OTHER_NUMBERS = "order|invoice|isbn|issn|article|item|part|serial|version|page|pages|doi|nr|no|number"


@dataclass(frozen=True)
class Training:
    held_out: float = 0.3  # of the candidates: calibrate the trees, which learn from the rest
    sure: float = 0.5  # least probability of an added span
    least: int = 30  # unseen validated spans of a kind that its share of validated ones must rest on
    rounds: int = 10
    depth: int = 4


def _matches(text: Column, name: str, pattern: str) -> Column:
    """Array of (name, number, length before, match, characters before, characters after)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def rows(both: Column) -> Column:
        return F.transform(
            both["m"],
            lambda m, i: F.struct(
                F.lit(name).alias("_name"), i.alias("_i"), F.char_length(F.get(both["p"], i)).alias("_gap"), m.alias("_m"),
                F.substring(F.get(both["p"], i), -CONTEXT, CONTEXT).alias("_before"), F.substring(F.get(both["p"], i + 1), 1, 2).alias("_after"),
            ),
        )

    kind = "array<struct<_name:string,_i:int,_gap:int,_m:string,_before:string,_after:string>>"
    both = F.transform(F.array(F.struct(found.alias("m"), pieces.alias("p"))), rows)[0]
    return F.when(text.rlike(_HINT[name]), both.cast(kind)).otherwise(F.array().cast(kind))


def found_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Base matches that pass their checks and all wide matches: row key, `kind`, `start`, `end` (code points), `base`, `_m` and
    the characters around."""
    rows = docs.select(*row_key("doc_id", text), full_text(text).alias("_t"))
    parts = [_matches(F.col("_t"), name, pattern) for name, pattern in (BASE | WIDE).items()]
    each = rows.select("_k1", "_k2", F.explode(F.concat(*parts)).alias("_e")).select("_k1", "_k2", "_e.*").distinct()
    size = F.char_length("_m")
    upto = Window.partitionBy("_k1", "_k2", "_name").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("_gap") + size).over(upto).cast("long")).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("_m", "[^0-9]", "")
    n = F.char_length(digits)
    valid = (
        F.when(F.col("_name") == "ip", F.col("_m").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(F.col("_name") == "card", n.between(16, 19) & F.call_function("luhn_check", digits))
        .when(F.col("_name") == "phone", n.between(8, 15))
        .otherwise(True)
    )
    guess = (
        F.when(F.col("_name").isin("at", "spelled"), "email").when(F.col("_name") == "groups", "ip").when(F.col("_name") != "digits", F.col("_name"))
        .when(F.col("_m").rlike(r"^[0-9]+(?:\.[0-9]+){3}"), "ip").when(F.col("_m").startswith("+"), "phone").when(n >= 13, "card").otherwise("phone")
    )
    return placed.filter(valid).withColumns({"kind": guess, "base": F.col("_name").isin(*KINDS)}).drop("_i", "_gap", "_name")


def features(spans: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numbers for the trees, columns `_f0`.. They tell format and context, but nothing that the checks of base spans ask for."""
    before, after = F.col("_before"), F.col("_after")
    # spelled-out mails as mails; of numbers only how they are parted
    mail = F.regexp_replace(F.regexp_replace("_m", r"\x20[(\[]?at[)\]]?\x20", "@"), r"\x20[(\[]?dot[)\]]?\x20", ".")
    m = F.when(F.col("kind") == "email", mail).when(F.col("kind") == "ip", F.regexp_replace(F.regexp_replace("_m", "[0-9A-Fa-f]+", "0"), ":+", "."))
    m = m.otherwise(F.regexp_replace(F.regexp_replace("_m", r"^\+", ""), "[0-9]+", "0"))
    is_mail = (F.col("kind") == "email").cast("int")
    digits = F.array_distinct(F.regexp_extract_all("_m", F.lit("[0-9]"), F.lit(0)))

    def count(pattern: str) -> Column:
        return F.char_length(m) - F.char_length(F.regexp_replace(m, pattern, ""))

    made = [
        *[(F.col("kind") == k).cast("int") for k in KINDS],
        is_mail * count("@"), is_mail * count(r"[^\x00-\x7F]"), is_mail * count(r"[^A-Za-z0-9._%+@-]"), is_mail * count(r"^@|@$|\.\.|\.$"),
        is_mail * F.char_length(F.regexp_extract(m, r"@.*\.([^.@]+)$", 1)), count("[:/]"), (F.size(digits) <= 2).cast("int"),
        before.rlike(r"[\x20\x09-\x0D]$").cast("int"), (before == "").cast("int"), before.rlike("[0-9A-Za-z]$").cast("int"),
        after.rlike(r"^[\x20\x09-\x0D]").cast("int"), (after == "").cast("int"), after.rlike("^[0-9A-Za-z]").cast("int"),
        *[F.lower(before).rlike(rf"(?:{words})[^0-9]*$").cast("int") for words in WORDS.values()],
        F.lower(before).rlike(rf"(?:{OTHER_NUMBERS})[^0-9]*$").cast("int"),
    ]
    names = [f"_f{i}" for i in range(len(made))]
    return spans.withColumns({name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in zip(names, made)}), names


def _touching(spans: DataFrame) -> DataFrame:
    """Adds `touches` (a base span of any kind) and `label` (one of its own kind)."""

    def overlap(*keys: str) -> Column:
        along = Window.partitionBy("_k1", "_k2", *keys).orderBy("start", "end", F.col("base").desc())
        ends = F.max(F.when(F.col("base"), F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
        starts = F.min(F.when(F.col("base"), F.col("start"))).over(along.rowsBetween(1, Window.unboundedFollowing))
        return F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))

    return spans.withColumns({"touches": overlap(), "label": overlap("kind").cast("double")})


def _selected(wide: DataFrame, names: list[str], training: Training) -> DataFrame:
    """Wide candidates that the calibrated trees select."""
    nothing = wide.filter(F.lit(False)).select("_k1", "_k2", "kind", "start", "end")
    draw = F.xxhash64(F.xxhash64("_k1", "_k2", "kind", "start", "end"))
    held = F.pmod(draw, F.lit(1000)) < int(1000 * training.held_out)
    # few rows, whose weights stand for every candidate
    alike = pin(wide.groupBy("kind", "label", *names, held.alias("_held")).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    part = alike.filter("not _held")
    if part.select("label").distinct().count() < 2:
        return nothing
    vector = VectorAssembler(inputCols=names, outputCol="_v")
    trees = GBTClassifier(
        featuresCol="_v", labelCol="label", weightCol="_n", maxIter=training.rounds, maxDepth=training.depth, seed=7, checkpointInterval=-1
    )
    model = trees.fit(vector.transform(part))

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(vector.transform(df)).withColumn("_p", F.round(vector_to_array("probability")[1], 4))
        return scored.drop("_v", "rawPrediction", "probability", "prediction")

    unseen = score(alike.filter("_held and label = 1"))
    mean = F.sum(F.col("_p") * F.col("_n")) / F.sum("_n")
    own = unseen.groupBy("kind").agg(F.sum("_n").alias("_n"), mean.alias("_c")).filter(F.col("_n") >= training.least)
    every = unseen.agg(mean).scalar()
    # one row per kind
    scored = score(wide.filter("not touches")).join(F.broadcast(own), "kind", "left")
    return scored.filter(F.col("_p") >= training.sure * F.coalesce("_c", every)).select("_k1", "_k2", "kind", "start", "end")


def pii_spans(docs: DataFrame, training: Training = Training(), text: str = "text") -> DataFrame:
    """Row key, `kind`, `start`, `end`, `base` of every span. Added spans of a kind do not overlap."""
    with_features, names = features(_touching(found_spans(docs, text)))
    spans = pin(with_features.drop("_m", "_before", "_after"))
    columns = ["_k1", "_k2", "kind", "start", "end"]
    added = _selected(spans.filter("not base"), names, training)
    along = Window.partitionBy("_k1", "_k2").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    apart = added.distinct().withColumn("_seen", F.max("end").over(along)).filter("_seen is null or _seen <= start").drop("_seen")
    return spans.filter("base").select(*columns, F.lit(True).alias("base")).unionByName(apart.withColumn("base", F.lit(False)))


def by_document(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`doc_id`, row key and `_spans`, all spans of the row in order of kind and start (never null)."""
    number = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int")
    item = F.struct(number.alias("n"), "start", "end", "kind", "base")
    lists = spans.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(item)).alias("_spans"))
    rows = docs.select("doc_id", *row_key("doc_id", "text")).join(lists, ["_k1", "_k2"], "left")
    nothing = F.array().cast("array<struct<n:int,start:bigint,end:bigint,kind:string,base:boolean>>")
    return rows.withColumn("_spans", F.coalesce("_spans", nothing))


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    lists = by_document(docs.select("doc_id", "text"), spans).filter(F.size("_spans") > 0).select("_k1", "_k2", "_spans").distinct()
    rows = docs.withColumns({c: k for c, k in zip(("_k1", "_k2"), row_key("doc_id", "text"))}).join(lists, ["_k1", "_k2"], "left")
    in_order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    whole = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        hit = F.struct(F.concat(acc["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), (-s["back"]).alias("at"))
        return F.when(s["start"] >= acc["at"], hit).otherwise(acc)

    done = F.aggregate(in_order, whole, step)
    text = F.concat(done["out"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.char_length("text")))
    return rows.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(text)).drop("_k1", "_k2", "_spans")
