"""Lexical search: AND of all question words, ranked by BM25.

A chunk has to hold every word, so candidates come from the question's rarest word only and
are then checked against the rest; common words never fan out into postings.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut
from .sizing import MAX_BROADCAST_QUERIES, few, salted_join, small_rows, top_k

# BM25 parameters and the floor of the inverse document frequency.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
# Up to this many question terms are matched as a literal set inside each row.
MAX_LITERAL_TERMS = 256

_TOTALS = ""  # stands for the whole corpus beside the real terms, which are never empty
QUERY_SCHEMA = (
    "query_id string, probe string, terms array<string>, phrases array<array<string>>,"
    " words array<struct<parts:array<string>,weight:double>>, avgdl double"
)


def index_chunks(chunks: DataFrame) -> DataFrame:
    """``chunk_id, doc_tokens`` of the lexical index; only the content is indexed."""
    return chunks.select("chunk_id", T.index_tokens(F.col("content")).alias("doc_tokens"))


def term_statistics(index: DataFrame) -> DataFrame:
    """Document and corpus frequency of every term."""
    # What is needed beside the exploded column is computed first: columns computed afterwards
    # would carry the whole token array along with every exploded row. The outer form keeps
    # Catalyst from inferring a filter on the array and tokenizing again for it.
    sized = index.withColumn("once", F.array_distinct("doc_tokens")).select(
        F.size("once").alias("distinct"), F.concat("once", "doc_tokens").alias("all")
    )
    each = sized.select("distinct", F.posexplode_outer("all").alias("at", "term")).where(
        F.col("at").isNotNull()
    )
    once = F.col("at") < F.col("distinct")
    return each.groupBy("term").agg(F.count_if(once).alias("df"), F.count_if(~once).alias("cf"))


def question_words(questions: DataFrame) -> DataFrame:
    """``query_id, words``: each word as the list of its parts, repeats kept.

    An underscore splits a word into a phrase. Questions without any word, or with a word made
    of underscores alone, match nothing and are dropped.
    """
    parts = F.transform(
        T.query_tokens(F.col("question")),
        lambda word: F.filter(F.split(F.lower(word), "_", -1), lambda part: part != ""),
    )
    return questions.select(F.col("query_id").cast("string"), parts.alias("words")).where(
        (F.size("words") > 0) & ~F.exists("words", lambda word: F.size(word) == 0)
    )


def idf(total: Column, df: Column) -> Column:
    raw = F.ln((total - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def _occurrences(tokens: Column, parts: Column) -> Column:
    """How often a word occurs: single terms by counting, phrases by position."""
    single = F.size(tokens) - F.size(F.array_remove(tokens, F.get(parts, F.lit(0))))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - F.size(parts) + 1, F.lit(1)))
    runs = F.filter(starts, lambda at: F.slice(tokens, at, F.size(parts)) == parts)
    return F.when(F.size(parts) == 1, single).otherwise(F.size(runs))


def _has_phrases(tokens: Column, phrases: Column) -> Column:
    return F.forall(phrases, lambda parts: _occurrences(tokens, parts) > 0)


def _score(tokens: Column, words: Column, avgdl: Column) -> Column:
    """BM25 as the index reports it: negative, lower is better."""
    length = K1 * (1 - B + B * F.size(tokens) / avgdl)

    def gain(word: Column) -> Column:
        tf = _occurrences(tokens, word["parts"]).cast("double")
        return word["weight"] * tf * (K1 + 1) / (tf + length)

    return -F.aggregate(F.transform(words, gain), F.lit(0.0), lambda acc, x: acc + x)


def _count_terms(index: DataFrame, terms: Column) -> DataFrame:
    """``term, df, length`` of the array ``terms`` and of the corpus as the term ``_TOTALS``."""
    sized = index.select(
        F.array_append(terms, _TOTALS).alias("terms"),
        F.size("doc_tokens").cast("long").alias("length"),
    )
    return sized.select(F.explode_outer("terms").alias("term"), "length")


def _document_frequencies(index: DataFrame, wanted: DataFrame | list[str]) -> DataFrame:
    """Document frequency of the wanted terms, and of the corpus as the term ``_TOTALS``.

    A short list of terms is intersected inside each row, so only hits are exploded. A table of wanted
    terms, of any size, meets the counts, which tasks add up before anything is shuffled.
    """
    listed = isinstance(wanted, list)
    if listed and len(wanted) <= MAX_LITERAL_TERMS:
        literal = F.array(*map(F.lit, wanted)).cast("array<string>")
        terms = _count_terms(index, F.array_intersect("doc_tokens", literal))
    else:
        if listed:
            rows = [(term,) for term in [*wanted, _TOTALS]]
            wanted = F.broadcast(index.sparkSession.createDataFrame(rows, "term string"))
        terms = _count_terms(index, F.array_distinct("doc_tokens"))
        if listed:
            terms = terms.join(wanted, "term", "left_semi")
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("length"))
    return counts if listed else counts.join(wanted, "term", "left_semi")


def _phrase_frequencies(
    index: DataFrame, probes: dict[tuple[str, ...], str]
) -> dict[tuple[str, ...], int]:
    """Document frequency of phrases, looked for where their rarest part (the value) occurs."""
    if not probes:
        return {}
    rows = [(probe, list(parts)) for parts, probe in probes.items()]
    phrases = index.sparkSession.createDataFrame(rows, "probe string, parts array<string>")
    near = _candidates_small(index, phrases, sorted(set(probes.values())))
    found = near.where(
        (F.size(F.array_except("parts", "doc_tokens")) == 0)
        & (_occurrences(F.col("doc_tokens"), F.col("parts")) > 0)
    )
    return {tuple(r["parts"]): r["count"] for r in found.groupBy("parts").count().collect()}


def _plan_small(
    spark: SparkSession, index: DataFrame, rows: list
) -> tuple[DataFrame, list[str]]:
    """Questions with rarest term, word weights and corpus statistics, and the rarest terms."""
    parsed: dict[str, Counter] = {}
    for row in rows:  # rows that repeat an id are one question with the words of all
        parsed.setdefault(row["query_id"], Counter()).update(tuple(word) for word in row["words"])
    words = {word for counts in parsed.values() for word in counts}
    terms = sorted({part for word in words for part in word})
    stats = {row["term"]: row for row in _document_frequencies(index, terms).collect()}
    if _TOTALS not in stats:
        return spark.createDataFrame([], QUERY_SCHEMA), []
    total, length = stats[_TOTALS]["df"], stats[_TOTALS]["length"]
    df = {(term,): row["df"] for term, row in stats.items() if term}

    def rarest(parts: tuple[str, ...]) -> str:
        return min(parts, key=lambda term: (df[(term,)], term))

    known = [w for w in words if len(w) > 1 and all((part,) in df for part in w)]
    df.update(_phrase_frequencies(index, {w: rarest(w) for w in known}))
    plans = []
    for query_id, counts in parsed.items():
        if any(word not in df for word in counts):
            continue
        singles = sorted({part for word in counts for part in word})
        plans.append((query_id, rarest(tuple(singles)), singles, [list(w) for w in counts if len(w) > 1],
                      [(list(w), n, df[w]) for w, n in sorted(counts.items())]))
    raw = spark.createDataFrame(
        plans,
        "query_id string, probe string, terms array<string>, phrases array<array<string>>,"
        " counted array<struct<parts:array<string>,n:long,df:long>>",
    )
    weighted = F.transform(
        "counted",
        lambda w: F.struct(
            w["parts"].alias("parts"),
            (w["n"] * idf(F.lit(float(total)), w["df"])).alias("weight"),
        ),
    )
    average = F.lit(float(length) / total if total else 0.0)
    table = raw.select(
        "query_id", "probe", "terms", "phrases", weighted.alias("words"), average.alias("avgdl")
    )
    return table, sorted({plan[1] for plan in plans})


def _candidates_small(index: DataFrame, plans: DataFrame, probes: list[str]) -> DataFrame:
    hit = F.array_intersect("doc_tokens", F.array(*map(F.lit, probes)).cast("array<string>"))
    return index.withColumn("probe", F.explode(hit)).join(F.broadcast(plans), "probe")


def _phrase_documents(index: DataFrame, phrases: DataFrame, df: DataFrame) -> DataFrame:
    """``parts, df`` of phrases: places of all their parts, less the part's own place, meet by chunk.

    Only places of words that some phrase has are exploded, and token arrays are not copied.
    """
    parts = phrases.select("parts", F.posexplode("parts").alias("k", "term"))
    known = parts.join(df.select("term"), "term", "left_semi")
    wanted = few(cut(known.select("term").distinct()), "term")
    at = index.select("chunk_id", F.posexplode("doc_tokens").alias("at", "term")).join(wanted, "term", "left_semi")
    # Only chunks that hold the rarest part bring the places of the others.
    probes = parts.join(df, "term", "left").groupBy("parts").agg(
        F.min_by("term", F.struct("df", "term")).alias("term"), F.bool_or(F.col("df").isNull()).alias("missing")
    ).where(~F.col("missing")).drop("missing")
    near = salted_join(at.select("chunk_id", "term").distinct(), probes, ["term"], "chunk_id").drop("term")
    pairs = near.withColumn("part", F.explode(F.transform("parts", lambda p, k: F.struct(k.alias("k"), p.alias("term")))))
    pairs = pairs.select("parts", "chunk_id", F.col("part.k").alias("k"), F.col("part.term").alias("term"))
    begun = pairs.join(at, ["chunk_id", "term"]).groupBy("parts", "chunk_id", (F.col("at") - F.col("k")).alias("first")).agg(
        F.count(F.lit(1)).alias("n")
    )
    held = begun.where(F.col("n") == F.size("parts")).select("parts", "chunk_id").distinct()
    return held.groupBy("parts").agg(F.count(F.lit(1)).alias("df"))


def _plan_large(index: DataFrame, words: DataFrame) -> DataFrame:
    """The same table as ``_plan_small`` built by joins, for question sets of any size."""
    each = words.select("query_id", F.explode("words").alias("parts"))
    each = cut(each.groupBy("query_id", "parts").agg(F.count(F.lit(1)).alias("n")))
    terms = each.select(F.explode("parts").alias("term")).distinct()
    totals = index.agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.size("doc_tokens")).alias("length")
    ).first()
    total, length = totals["total"], totals["length"] or 0
    df = cut(_document_frequencies(index, terms).select("term", "df"))
    phrases = cut(each.where(F.size("parts") > 1).select("parts").distinct())
    known = df.select(F.array("term").alias("parts"), "df")
    if not phrases.isEmpty():
        known = known.unionByName(_phrase_documents(index, phrases, df))
    counted = each.join(known, "parts", "left")
    parts = each.select("query_id", F.explode("parts").alias("term")).distinct().join(df, "term", "left")
    rarest = parts.groupBy("query_id").agg(
        F.min_by("term", F.struct("df", "term")).alias("probe"),
        F.sort_array(F.collect_set("term")).alias("terms"),
        F.bool_or(F.col("df").isNull()).alias("missing"),
    )
    weight = F.col("n") * idf(F.lit(float(total)), F.col("df"))
    grouped = counted.groupBy("query_id").agg(
        F.bool_or(F.col("df").isNull()).alias("unknown"),
        F.sort_array(F.collect_list(F.struct("parts", weight.alias("weight")))).alias("words"),
    )
    is_phrase = F.filter("words", lambda w: F.size(w["parts"]) > 1)
    return (
        grouped.join(rarest, "query_id")
        .where(~F.col("unknown") & ~F.col("missing"))
        .select(
            "query_id", "probe", "terms",
            F.transform(is_phrase, lambda w: w["parts"]).alias("phrases"),
            "words", F.lit(float(length) / total if total else 0.0).alias("avgdl"),
        )
    )


def _candidates_large(index: DataFrame, plans: DataFrame) -> DataFrame:
    """Only probes are exploded, only ids are salted; tokens and words join the pairs that are left."""
    plans = cut(plans)
    terms = index.select("chunk_id", F.explode(F.array_distinct("doc_tokens")).alias("probe"))
    terms = terms.join(few(plans.select("probe").distinct(), "probe"), "probe", "left_semi")
    pairs = cut(salted_join(terms, plans.select("query_id", "probe"), ["probe"], "chunk_id"))
    held = index.join(few(pairs.select("chunk_id").distinct(), "chunk_id"), "chunk_id", "left_semi")
    return pairs.drop("probe").join(held, "chunk_id").join(plans, "query_id")


def lexical_hits(
    index: DataFrame, questions: DataFrame, max_questions: int = MAX_BROADCAST_QUERIES
) -> DataFrame:
    """Every chunk that holds all words of a question: ``query_id, chunk_id, bm25, score``.

    ``index`` has token arrays or is the stored index of postings, which is not tokenized again.

    ``bm25`` is what ranks (lower is better); ``score`` is the reciprocal form handed on.
    """
    if "positions" in index.columns:
        from .postings import hits

        return hits(index, questions)
    words = question_words(questions)
    rows = small_rows(words, F.size("words") * 64, max_questions)
    if rows is None:
        found = _candidates_large(index, _plan_large(index, words))
    else:
        found = _candidates_small(index, *_plan_small(index.sparkSession, index, rows))
    tokens = F.col("doc_tokens")
    matched = found.where(
        (F.size(F.array_except("terms", "doc_tokens")) == 0)
        & _has_phrases(tokens, F.col("phrases"))
    )
    bm25 = _score(tokens, F.col("words"), F.col("avgdl"))
    return matched.select("query_id", "chunk_id", bm25.alias("bm25")).withColumn(
        "score", 1 / F.nullif(F.col("bm25") + 1, F.lit(0.0))
    )


def lexical_top_k(
    index: DataFrame,
    questions: DataFrame,
    k: int,
    max_questions: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Best ``k`` hits per question. Filters apply to this result, after the cut."""
    if "positions" in index.columns:
        from .postings import best_hits

        return best_hits(index, questions, k)
    hits = lexical_hits(index, questions, max_questions)
    order = [F.asc(F.round("bm25", 12)), F.asc("chunk_id")]
    return top_k(hits, ["query_id"], order, k, spread="chunk_id")
