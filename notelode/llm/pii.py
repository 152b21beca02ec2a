"""Personal data by candidate generators and gradient-boosted trees, in DataFrame functions only.

Fixed patterns give the base spans. Wider generators propose further, overlapping spans: written
out e-mail addresses, digit groups of any punctuation, hexadecimal addresses. Boosted trees judge
a proposal by format and context features. They are trained on all proposals outside the
calibration's quarter of the documents: those that a base span confirms are the positive ones, all others negative, and the features
leave out what the base patterns test (check digit, number ranges). The threshold is calibrated
on proposals kept out of training: the lowest one at which ``PRECISION`` of what it selects is
confirmed. Proposals above it that touch no base span are added; base spans always stay.

A text is never shuffled: every match leaves the scan as a short row with its context.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .tables import measured, table

SPAN = "struct<start:bigint,rank:int,end:bigint>"
KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
CONTEXT = 24
# Texts with spans are broadcast up to this number (some 100 bytes each), joined beyond it.
MAX_BROADCAST_SPANS = 250_000

# The base patterns, written without repeated groups: those recurse once for each repetition and
# overflow the stack on long texts. Each matches what its plain form in the comment matches.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-][A-Za-z0-9.-]*?"
    r"(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?![\x20-]{2})[0-9\x20-]*?[0-9](?=[\x20-]{2}|[\x20-]?(?![0-9\x20-]))",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generator: (kind of its spans, pattern). Quantifiers are bounded, so a long text costs no more
# than a linear scan.
WIDE = {
    "written": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]{1,63}"
                r"(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}){1,5}"),
    "digits": ("phone", r"(?<![0-9])[+(]{0,2}[0-9][0-9\x20()./-]{5,28}[0-9](?![0-9])"),
    "long": ("card", r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,18}(?![0-9])"),
    "octets": ("ip", r"(?<![0-9.])[0-9]{1,4}(?:\x20?\.\x20?[0-9]{1,4}){3}(?![0-9.])"),
    "hex": ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])"),
}
HINT = r"(?i)(?:tel|phone|call|fax|mail|contact|card|visa|account|ip|addr|host)"


def _matches(text: Column, source: str, kind: str, pattern: str, hint: Column) -> Column:
    """Leftmost matches as structs with the length of text before each and its surroundings."""
    rest, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # One struct column holds both arrays, so each regular expression runs once for a text.
    pair = F.struct(rest.alias("rest"), found.alias("found"))
    built = F.transform(F.array(pair), lambda p: _rows(p, source, kind))[0]
    return F.when(hint, built)


def _rows(pair: Column, source: str, kind: str) -> Column:
    rest, found = pair["rest"], pair["found"]
    return F.transform(
        found,
        lambda match, i: F.struct(
            F.lit(source).alias("source"), F.lit(kind).alias("kind"), i.alias("at"),
            F.length(F.get(rest, i)).alias("gap"), match.alias("match"),
            F.right(F.get(rest, i), F.lit(CONTEXT)).alias("left"),
            F.left(F.get(rest, i + 1), F.lit(CONTEXT)).alias("right"),
        ),
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(F.lit(True))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """One row per match of any pattern, and one with null ``source`` for a text without any.

    Columns: row (number of the text's row), doc_id, source, kind, start, end, match, left, right,
    base (a base span that passes its test).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mail, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    hints = {"email": mail, "ip": digit, "card": digit, "phone": digit & F.contains(text, F.lit("+")),
             "written": mail | text.rlike(r"[(\[]at[)\]]"), "digits": digit, "long": digit, "octets": digit,
             "hex": digit & F.contains(text, F.lit(":"))}
    named = [(k, k, p) for k, p in BASE.items()] + [(s, k, p) for s, (k, p) in WIDE.items()]
    none = F.expr("array()")
    lists = [F.coalesce(_matches(text, s, k, p, hints[s]), none) for s, k, p in named]
    # ``row`` only tells rows of one and the same scan apart; nothing is joined by it.
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("text_key"),
        F.concat(*lists).alias("found"),
    )
    one = rows.select("row", "doc_id", "text_key", F.explode_outer("found").alias("c"))
    one = one.select("row", "doc_id", "text_key", "c.*")
    before = Window.partitionBy("row", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(before).cast("long")
    placed = one.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    base = F.col("source").isin(*BASE) & _valid(F.col("kind"), F.col("match"))
    return placed.select("row", "doc_id", "text_key", "source", "kind", "start", "end", "match", "left", "right",
                         F.coalesce(base, F.lit(False)).alias("base"))


def _touches(a_start, a_end, b_start, b_end) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def judged(found: DataFrame) -> DataFrame:
    """Wide proposals with features and ``label``: 1 where a base span of the text touches them."""
    # Base spans stand at their start and proposals at their end: of the base spans that begin before a
    # proposal ends, the furthest end says whether one touches it. One sort, linear in the spans.
    place = F.when(F.col("base"), F.col("start")).otherwise(F.col("end"))
    before = Window.partitionBy("row").orderBy(place, F.col("base").cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = found.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(before)).where(F.col("source").isin(*WIDE))
    label = F.coalesce(F.col("reach") > F.col("start"), F.lit(False))
    count = lambda p: F.length(F.regexp_replace("match", f"[^{p}]", "")).cast("double")
    yes = lambda c: c.cast("double")
    digits = _digits(F.col("match"))
    card = (F.col("source") == "digits") & F.length(digits).between(12, 19) & ~F.col("match").startswith("+")
    kind = F.when(F.when(card, _luhn(digits)).otherwise(F.lit(False)), "card").otherwise(F.col("kind"))
    return wide.select(
        "row", "doc_id", "text_key", "source", kind.alias("kind"), "start", "end", label.cast("double").alias("label"),
        F.length("match").cast("double").alias("f_length"), count("0-9").alias("f_digits"),
        count(r"\x20").alias("f_spaces"), count("-").alias("f_hyphens"), count(".").alias("f_dots"),
        count("()").alias("f_parens"), count("/").alias("f_slashes"), count("@").alias("f_at"),
        count(":").alias("f_colons"), yes(F.col("match").startswith("+")).alias("f_plus"),
        F.size(F.split("match", "[^0-9]+")).cast("double").alias("f_groups"),
        F.size(F.array_distinct(F.split(_digits(F.col("match")), ""))).cast("double").alias("f_distinct"),
        yes(F.col("left").rlike(r"[\x20\n(:]$|^$")).alias("f_free_left"),
        yes(F.col("right").rlike(r"^[\x20\n).,;]|^$")).alias("f_free_right"),
        yes(F.col("left").rlike(HINT)).alias("f_hint"), yes(F.col("left").rlike("[0-9]")).alias("f_digit_left"),
        yes(F.col("right").rlike("[0-9]")).alias("f_digit_right"),
        *(yes(F.col("source") == s).alias(f"f_from_{s}") for s in WIDE),
    )


def train(proposals: DataFrame):
    """(assembler, trees, threshold), or None without both kinds of proposals.

    Every proposal counts. Those with equal features, label and side are one row with their number as its
    weight, which is the same to the trees; the features are small counts, so such rows are far fewer.
    """
    features = [c for c in proposals.columns if c.startswith("f_")]
    side = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    alike = proposals.groupBy(side.alias("held"), "label", *features).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    counted = cut(alike.repartition(4, *features).sortWithinPartitions("held", "label", *features))
    fit, held = counted.where(~F.col("held")), counted.where(F.col("held"))
    seen = fit.agg(F.sum("weight"), F.coalesce(F.sum(F.col("label") * F.col("weight")), F.lit(0.0))).first()
    if seen[1] in (0, seen[0]):
        return None
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=12, maxDepth=4, seed=7, cacheNodeIds=False)
    model = trees.fit(assembler.transform(fit))
    scored = model.transform(assembler.transform(held)).select(
        F.round(vector_to_array("probability")[1], 3).alias("p"), "label", "weight"
    )
    good_of = F.sum(F.col("label") * F.col("weight")).alias("good")
    steps = scored.groupBy("p").agg(good_of, F.sum("weight").alias("n")).orderBy(F.desc("p"))
    good = n = 0
    threshold = 2.0
    for step in steps.collect():  # at most 1,001 rows: p has three decimals
        good, n = good + step["good"], n + step["n"]
        if good >= PRECISION * n:
            threshold = step["p"]
    return assembler, model, threshold


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"]), s["start"], s["end"])), ","
    )


def find_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, and arrays of (start, rank, end): base, added.

    ``rank`` is the kind's place in ``KINDS``, from 1; ``text_key`` a hash of the text. A null text is empty and has no span; repeated rows are each returned, null ids too. Places
    count code points, the end exclusive. Without proposals of both kinds to learn from nothing is
    added. An empty table gives an empty result; other columns are ignored.
    """
    found = candidates(docs.select("doc_id", "text"))
    held = cut(found)
    model = train(judged(held))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    slim = held.select(
        "row", "doc_id", "text_key", F.when(F.col("base"), F.struct("start", rank.alias("rank"), "end")).alias("base"),
        F.lit(None).cast(SPAN).alias("more"),
    )
    if model is not None:
        assembler, trees, threshold = model
        scored = trees.transform(assembler.transform(judged(held).where("label = 0")))
        p = vector_to_array("probability")[1]
        likely = scored.where(F.round(p, 3) >= threshold).select(
            "row", "doc_id", "text_key", F.struct("start", rank.alias("rank"), "end", p.alias("p")).alias("s")
        )
        slim = slim.unionByName(_likeliest(likely).withColumn("base", F.lit(None).cast(SPAN)))
    one = slim.groupBy("row", "doc_id", "text_key").agg(
        F.array_sort(F.collect_list("base")).alias("base"), F.array_sort(F.collect_list("more")).alias("added")
    )
    return one.select("doc_id", "text_key", "base", "added")


def _likeliest(likely: DataFrame) -> DataFrame:
    """Of proposals ``s`` of a text that touch each other the likelier stays, the earlier and wider one on a tie.

    Proposals are compared inside islands alone: stretches of the text that overlapping proposals cover.
    """
    placed = likely.select("row", "doc_id", "text_key", "s", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    order = Window.partitionBy("row").orderBy("start", "end", "s")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = placed.withColumn("fresh", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    islands = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    together = islands.groupBy("row", "doc_id", "text_key", "island").agg(F.collect_list("s").alias("all"))
    better = lambda s, o: (
        _touches(s["start"], s["end"], o["start"], o["end"])
        & (F.struct(o["p"], -o["start"], o["end"], -o["rank"]) > F.struct(s["p"], -s["start"], s["end"], -s["rank"]))
    )
    kept = F.filter("all", lambda s: ~F.exists("all", lambda o: better(s, o)))
    spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return together.select("row", "doc_id", "text_key", F.explode(F.array_distinct(spans)).alias("more"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_<kind> (base spans), base_sha256, spans, n_added; see ``find_spans``."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind) + 1)).cast("long")
    return find_spans(docs).select(
        "doc_id", *(n(k).alias(f"n_{k}") for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets, like ``[EMAIL]``.

    Spans that touch each other become one, named by the first. Texts without spans, null ones
    too, stay as they are; all rows and columns stay.
    """
    spans = F.array_sort(F.concat("base", "added")).alias("_spans")
    found = find_spans(docs).where(F.size("base") + F.size("added") > 0)
    found = measured(
        found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), spans).distinct(), MAX_BROADCAST_SPANS
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_key"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(done: Column, span: Column) -> Column:
        between = F.substr("text", done["at"] + 1, (span["start"] - done["at"]).cast("int"))
        more = F.concat(done["text"], between, F.element_at(names, span["rank"]))
        return F.struct(
            F.greatest(done["at"], span["end"].cast("int")).alias("at"),
            F.when(span["start"] >= done["at"], more).otherwise(done["text"]).alias("text"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    masked = F.aggregate("_spans", start, step, lambda done: F.concat(done["text"], F.substr("text", done["at"] + 1)))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(masked)
    return docs.join(found, same, "left").withColumn("text", text).select(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op4_pii": op4_pii}
