"""Personal data in texts: rules, and boosted trees over spans that loose patterns propose.

Rules give the base spans: emails, IPv4 addresses, card numbers with a right check digit, and international phone
numbers.  Beyond them, high-recall generators propose spans that may overlap.  Each proposal gets format and context
features; gradient-boosted trees learn from all proposals of the corpus, counted by their features, which are personal
data; the threshold per kind is the lowest at which a held-out half reaches ``precision``.  Proposals above it are added
unless they overlap a base span or a better proposal; base spans always stay.

What the trees learn for emails, cards and phones: the spans that the rules confirm are rewritten in loose formats
(``name [at] host [dot] org``, groups parted by dots, no ``+``), each where it stands, and are the right ones; what the
rules find in its own format teaches nothing, since it is never added.  Proposals on a span of another kind and those
that cannot be what they are proposed as (``doubtful``) are the wrong ones.  The rest is unlabelled and takes no part in
the fit.  For secrets, a cue such as ``token =`` makes a proposal right and its absence wrong.

Only DataFrame functions are used: spans are found as the lengths of matches and of what lies between them, the
training table is an aggregate whose rows are bounded by the binned features, and the trees become column expressions,
so scoring neither shuffles nor leaves the JVM.

Null texts are empty and have no spans.  Offsets count code points, ends are exclusive.  A corpus whose proposals are
all right or all wrong adds nothing.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.session import materialise

#: What counts as each kind, in the order in which spans are listed.  Possessive quantifiers keep Java's
#: matcher from recursion and change no match: what follows each of them cannot start with what it takes.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "[+][0-9]"}

#: Loose patterns: spelled-out addresses, numbers with any usual separators, long mixed identifiers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9])\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}+(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
#: What a text must match for a loose pattern to be tried.
LOOSE_NEEDS = {"email": "@|[(\\[]at[)\\]]", "card": "[0-9]", "phone": "[0-9]", "secret": "[0-9]"}
CUES = {
    "mail": r"(?i)(?:mail|contact|write|reach)\W{0,6}(?:me|us|to|at)?\W{0,4}$",
    "call": r"(?i)(?:phone|tel|call|fax|mobile|cell)\w{0,6}\W{0,6}$",
    "pay": r"(?i)(?:card|visa|credit|debit|account|payment)\w{0,4}\W{0,6}(?:no|number)?\W{0,4}$",
    "key": r"(?i)(?:token|secret|passw\w{2,4}|api.?key|key|auth)\W{1,6}$",
}
#: Dates, which look like short phone numbers.
DATE = r"^(?:(?:19|20)[0-9]{2}[./ -][0-9]{1,2}[./ -][0-9]{1,2}|[0-9]{1,2}[./ -][0-9]{1,2}[./ -](?:19|20)[0-9]{2})(?![0-9])"
FEATURES = ["kind", "digits", "letters", "marks", "dots", "spaces", "length", "plus", "bracket", "at", "luhn", "runs",
            "mail", "call", "pay", "glued"]


def pieces(text: Column, pattern: str, needs: str) -> Column:
    """``start, end, match, before`` of each match; ``before`` is the text between it and the match before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("match"), between.alias("before"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["before"])
        end = start + F.length(pair["match"])
        one = F.struct(
            start.alias("start"), end.alias("end"), pair["match"].alias("match"),
            F.right(pair["before"], F.lit(32)).alias("before"),
        )
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

    kind = "array<struct<start:int,end:int,match:string,before:string>>"
    empty = F.array().cast(kind)
    spans = F.aggregate(
        F.filter(pairs, lambda p: p["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("spans")), step,
    )["spans"].cast(kind)
    return F.when(text.rlike(needs), spans).otherwise(empty)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        # a part of more than nine digits may be padded with zeros
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^[0-9]{0,3}$")
                        & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(match)).between(16, 19) & F.call_function("luhn_check", digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def base_of(kind: str, found: Column) -> Column:
    good = F.filter(found, lambda s: valid(kind, s["match"]))
    return F.transform(
        good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def base_spans(text: Column) -> Column:
    """``kind, start, end``, by kind as listed and then by start."""
    parts = []
    for kind, pattern in BASE.items():
        parts.append(base_of(kind, pieces(text, pattern, NEEDS[kind])))
    return F.concat(*parts)


def features(kind: str, span: Column) -> dict[str, Column]:
    """Small whole numbers; every one has a bounded range."""
    match, before = span["match"], span["before"]

    def count(pattern: str, most: int, per: int = 1) -> Column:
        n = F.length(match) - F.length(F.regexp_replace(match, pattern, ""))
        return F.least(F.floor(n / per).cast("int"), F.lit(most))

    plain = digits(match)
    return {
        "kind": F.lit(list(LOOSE).index(kind)),
        "digits": count("[0-9]", 20), "letters": count("[A-Za-z]", 8, 5), "marks": count("[^A-Za-z0-9]", 6),
        "dots": count("[.]", 4), "spaces": count("[ ]", 4), "length": count("(?s).", 12, 5),
        "plus": F.startswith(match, F.lit("+")).cast("int"), "bracket": F.contains(match, F.lit("(")).cast("int"),
        "at": F.contains(match, F.lit("@")).cast("int"),
        "luhn": F.when(F.length(plain).between(12, 19), F.call_function("luhn_check", plain)).otherwise(F.lit(False)).cast("int"),
        "runs": F.least(F.size(F.split(match, "[0-9]++")), F.lit(8)),
        **{cue: F.coalesce(before.rlike(CUES[cue]), F.lit(False)).cast("int") for cue in ("mail", "call", "pay")},
        "glued": F.coalesce(before.rlike("[A-Za-z0-9]$"), F.lit(False)).cast("int"),
    }


def doubtful(kind: str, match: Column) -> Column:
    """Whether a proposal cannot be what it is proposed as, or has nothing but its digits to say so."""
    if kind == "card":
        return ~valid("card", match)
    if kind == "phone":
        parts = F.size(F.split(match, "[^0-9]++"))
        return ~valid("phone", match) | (parts < 3) | match.rlike(DATE)
    return F.lit(False)


def loosened(kind: str, match: Column) -> Column:
    """A base span in a format that its rule does not take; which one is chosen by a hash of the span."""
    if kind == "email":
        name, host = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
        dots = F.replace(host, F.lit("."), F.lit(" [dot] ")), F.replace(host, F.lit("."), F.lit("(dot)"))
        ways = [
            F.concat(name, F.lit(" [at] "), dots[0]), F.concat(name, F.lit("(at)"), dots[1]),
            F.concat(name, F.lit(" (at) "), host), F.concat(name, F.lit("[at]"), host),
        ]
    elif kind == "card":
        ways = [F.regexp_replace(digits(match), "([0-9]{4})(?=[0-9])", f"$1{mark}") for mark in "./"]
    else:
        plain = digits(match)
        last = F.right(plain, F.lit(10))
        ways = [F.regexp_replace(last, "^([0-9]+)([0-9]{3})([0-9]{4})$", way)
                for way in ("$1-$2-$3", "$1.$2.$3", "($1) $2-$3", "$1 $2 $3")]
        ways.append(F.regexp_replace(plain, "^([0-9]+)([0-9]{3})([0-9]{3})([0-9]{4})$", "$1-$2-$3-$4"))
        ways.append(F.substring(match, 2, 64))
    pick = F.pmod(F.xxhash64(match), F.lit(len(ways)))
    return reduce(lambda out, at: F.when(pick == at, ways[at]).otherwise(out), range(1, len(ways)), ways[0])


def proposal(kind: str, span: Column, good: Column) -> Column:
    x = features(kind, span)
    return F.struct(
        F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
        F.array(*[x[name].cast("int") for name in FEATURES]).alias("x"), good.cast("boolean").alias("good"),
    )


def proposals_of(kind: str, found: Column, base: Column) -> Column:
    def one(s: Column) -> Column:
        if kind == "secret":
            return proposal(kind, s, F.coalesce(s["before"].rlike(CUES["key"]), F.lit(False)))
        same = F.exists(base, lambda b: (b["kind"] == kind) & overlaps(b, s))
        other = F.exists(base, lambda b: (b["kind"] != kind) & overlaps(b, s))
        return proposal(kind, s, F.when(~same & (other | doubtful(kind, s["match"])), F.lit(False)))

    return F.transform(found, one)


def proposals(text: Column, base: Column) -> Column:
    """``kind, start, end, x, good``: features as an array in the order of FEATURES, and what a proposal teaches."""
    return F.concat(*[
        proposals_of(kind, pieces(text, pattern, LOOSE_NEEDS[kind]), base)
        for kind, pattern in LOOSE.items()
    ])


def rewritten(text: Column) -> Column:
    """Base spans as proposals in loose formats, all of them right."""
    def of(kind: str) -> Column:
        good = F.filter(pieces(text, BASE[kind], NEEDS[kind]), lambda s: valid(kind, s["match"]))
        # a step of its own, so that the features refer to the new span instead of making it again each time
        loose = F.transform(good, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), loosened(kind, s["match"]).alias("match"),
            s["before"].alias("before"),
        ))
        return F.transform(loose, lambda s: proposal(kind, s, F.lit(True)))

    return F.concat(*[of(kind) for kind in ("email", "card", "phone")])


def tree_columns(model, x: Column) -> Column:
    """The sum of the trees' weighted predictions as one column expression, from the model's description."""
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        lines = [line.strip() for line in tree.toDebugString.splitlines()[1:] if line.strip()]

        def build(at: int, lines: list[str] = lines) -> tuple[Column, int]:
            leaf = re.match(r"Predict: (\S+)", lines[at])
            if leaf:
                return F.lit(float(leaf[1])), at + 1
            index, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
            left, at = build(at + 1)
            right, at = build(at + 1)  # past the line that says Else
            return F.when(x[int(index)] <= F.lit(float(limit)), left).otherwise(right), at

        total = total + F.lit(float(weight)) * build(0)[0]
    return total


def fit(counted: DataFrame, trees: int, depth: int, precision: float):
    """The boosted trees and the threshold per kind; None if there is nothing to tell apart.

    ``counted`` has a row per features, outcome and half with the number ``n`` of such proposals.  One half of the
    documents, by hash of their text, trains; the other half sets the thresholds.
    """
    rows = counted.select(
        "x", F.col("good").cast("int").cast("double").alias("label"), F.col("n").cast("double").alias("weight"),
        *[F.col("x")[i].cast("double").alias(f"f{i}") for i in range(len(FEATURES))],
        "train",
    )
    shaped = VectorAssembler(inputCols=[f"f{i}" for i in range(len(FEATURES))], outputCol="features").transform(rows)
    train = shaped.where("train")
    if train.select("label").distinct().count() < 2:
        return None
    boost = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=7, maxBins=32)
    model = boost.fit(train)
    scored = rows.where("not train").select(
        F.col("x")[0].alias("kind"), "label", "weight", F.round(tree_columns(model, F.col("x")), 2).alias("score")
    )
    # one row per kind and score of two decimals
    tally = scored.groupBy("kind", "score").agg(
        F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all")
    )
    seen: dict[int, list] = {}
    for r in sorted(tally.collect(), key=lambda r: -r["score"]):
        seen.setdefault(r["kind"], []).append(r)
    best: dict[int, float] = {}
    for kind, steps in seen.items():
        good = total = 0.0
        for at, r in enumerate(steps):
            good, total = good + r["good"], total + r["all"]
            if good >= precision * total:
                # half-way to the next score seen; below the last one, to even odds
                below = steps[at + 1]["score"] if at + 1 < len(steps) else min(0.0, r["score"] - 0.01)
                best[kind] = (r["score"] + below) / 2
    return model, best


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def find_spans(
    df: DataFrame, text_col: str = "text", trees: int = 12, depth: int = 3, precision: float = 0.98
) -> DataFrame:
    """``df`` with ``base`` and ``spans``, arrays of ``kind, start, end``; columns of these names are replaced.

    ``spans`` holds the base spans and what the trees add, by kind as listed (``secret`` last) and then by start.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(text)
    half = (F.pmod(F.xxhash64(text), F.lit(2)) == 0).alias("train")
    lessons = df.select(half, F.inline(F.concat(proposals(text, base), rewritten(text)))).where(F.col("good").isNotNull())
    counted = materialise(lessons.groupBy("x", "good", "train").agg(F.count(F.lit(1)).alias("n")), "proposals")
    fitted = fit(counted, trees, depth, precision)
    with_base = df.withColumn("base", base)
    if fitted is None:
        return with_base.withColumn("spans", F.col("base"))
    model, limits = fitted
    kinds = list(LOOSE)

    def scored(p: Column) -> Column:
        return F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"),
                        tree_columns(model, p["x"]).alias("score"))

    def passes(p: Column) -> Column:
        return reduce(
            lambda out, k: F.when(p["kind"] == kinds[k], p["score"] >= limits[k]).otherwise(out), limits, F.lit(False)
        )

    names = F.array(*[F.lit(k) for k in (*BASE, "secret")])

    def before(a: Column, b: Column) -> Column:
        """Whether a is to be kept rather than b: better score, then longer, then earlier kind, then earlier."""
        def key(s: Column) -> Column:
            return F.struct(-s["score"], s["start"] - s["end"], F.array_position(names, s["kind"]), s["start"])

        return key(a) < key(b)

    fresh = F.filter(
        F.transform(
            F.filter(proposals(text, F.col("base")), lambda p: ~F.exists(F.col("base"), lambda b: overlaps(p, b))), scored
        ),
        passes,
    )
    added = F.filter(F.col("_fresh"), lambda a: ~F.exists(F.col("_fresh"), lambda b: overlaps(a, b) & before(b, a)))
    plain = F.transform(added, lambda a: F.struct(a["kind"].alias("kind"), a["start"].alias("start"), a["end"].alias("end")))
    ordered = F.array_sort(F.transform(
        F.concat(F.col("base"), plain),
        lambda s: F.struct(
            F.array_position(names, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"),
            s["kind"].alias("kind"),
        ),
    ))
    spans = F.transform(
        ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    return with_base.withColumn("_fresh", fresh).withColumn("spans", spans).drop("_fresh")


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    by_place = F.array_sort(F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))
    ))

    def step(state: Column, s: Column) -> Column:
        end = -s["back"]
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        cut = F.concat(state["out"], before, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        inside = s["start"] < state["at"]
        return F.struct(
            F.greatest(state["at"], end).alias("at"), F.when(inside, state["out"]).otherwise(cut).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(by_place, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
