"""Registered queries: each takes a session and a table folder and returns a DataFrame."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Chunking, Config, Features, Retrieval
from ..functions import frontmatter as fm
from ..functions import markers as M
from ..functions import tags as G
from ..functions import text as T
from ..functions import vectors as V
from ..functions.prompts import render_prompt
from ..models import StandIn, embedding
from ..operators import chunk_sql as table_function
from ..operators import chunking, clusters, evaluate, fusion, hygiene, indexing, journal, lexical, packing, postings
from ..operators.filters import Filters, long_enough, user_text
from ..operators.lineage import cut, settled, shared_folder
from ..operators.mmr import diversify
from ..operators.rerank import preview, reorder
from ..operators.vector import related_files, vector_top_k
from ..plans import answer as answer_plan
from ..plans import writers
from ..plans.index_run import index_notes
from ..plans.retrieve import filter_hits, retrieve, settle
from ..shipping import ship
from ..sources.store import NoteStore
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SETTINGS = Retrieval()
CLIENT = StandIn()


class Backwards(StandIn):
    """Answers a reranking prompt with a JSON array of its ids, the last one first."""

    def generate(self, prompt, model, options):
        return json.dumps(re.findall(r"^ID: (\d+)$", prompt, re.MULTILINE)[::-1])


MODEL_FREE = Config(features=Features(reranking=False))
FILTERS = Filters(path_prefix="src1", tags=["en", "fr"], chunk_types=["text", "code"])



def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ship(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _ranked(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select("query_id", *columns, F.col("rank").cast("long").alias("rank"))


def _rounded(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


# --- vectors ---------------------------------------------------------------------------------


@query
def vector_topk(spark, sf_dir):
    """Dot product plus recency, best 40 chunks per label centroid."""
    boost = V.recency_boost(F.col("mtime"), SETTINGS.recency_boost, I.NOW_MS)
    hits = vector_top_k(
        I.vectors(spark, sf_dir), I.label_questions(spark, sf_dir), SETTINGS.vector_top_k, boost
    )
    return _ranked(hits, "chunk_id", _rounded("score"))


@query
def vector_topk_pruned(spark, sf_dir):
    """The same over a table stored by cluster, reading only clusters that can matter."""
    boost = V.recency_boost(F.col("mtime"), SETTINGS.recency_boost, I.NOW_MS)
    folder = shared_folder(spark, "clusters")
    clusters.write(I.vectors(spark, sf_dir), folder, 32)
    hits = clusters.top_k_pruned(spark, folder, I.label_questions(spark, sf_dir), SETTINGS.vector_top_k, boost)
    return _ranked(hits, "chunk_id", _rounded("score"))


@query
def related_all(spark, sf_dir):
    """Five other vectors per vector, every one against all, in pairs of blocks."""
    notes = I.vectors(spark, sf_dir).withColumn("file_path", F.concat(F.lit("v/"), "chunk_id", F.lit(".md")))
    asked = notes.select(F.col("chunk_id").alias("query_id"), F.col("file_path").alias("path"), F.col("embedding").alias("vector"))
    return _ranked(related_files(notes, asked, 5, max_questions=256), "path", _rounded("score"))


@query
def related_sources(spark, sf_dir):
    """Five other files per source file by the cosine of their closest chunk."""
    chunks = I.corpus(spark, sf_dir)
    notes = I.centroids(chunks, "file_path").select(
        F.col("file_path").alias("query_id"), F.col("file_path").alias("path"), "vector"
    )
    return _ranked(related_files(chunks, notes, 5), "path", _rounded("score"))


@query
def related_lines(spark, sf_dir):
    """The same as numbered wiki-link lines per source."""
    chunks = I.corpus(spark, sf_dir)
    notes = I.centroids(chunks, "file_path").select(
        F.col("file_path").alias("query_id"), F.col("file_path").alias("path"), "vector"
    )
    hits = related_files(chunks, notes, 5)
    line = writers.related_line(F.col("rank"), F.col("path"), F.col("score"))
    return hits.groupBy("query_id").agg(packing.join_in_order(F.col("rank"), line, "\n").alias("lines"))


@query
def vector_similarity(spark, sf_dir):
    """Dot product and cosine of each vector with its label centroid."""
    chunks = I.vectors(spark, sf_dir)
    mean = I.centroids(chunks, "label")
    return chunks.join(mean, "label").select(
        "chunk_id",
        F.round(V.dot(F.col("embedding"), F.col("vector")), 6).alias("dot"),
        F.round(V.cosine(F.col("embedding"), F.col("vector")), 6).alias("cosine"),
    )


@query
def l2_normalize(spark, sf_dir):
    """Norm of each vector scaled by its label, and its normalized form (label 0 has none)."""
    scaled = I.vectors(spark, sf_dir).select(
        "chunk_id", F.transform("embedding", lambda x: x * F.col("label")).alias("v")
    )
    unit = V.normalize(F.col("v"))
    return scaled.select(
        "chunk_id", F.round(V.norm(F.col("v")), 6).alias("norm"),
        F.round(V.norm(unit), 6).alias("unit_norm"),
        F.round(F.element_at(unit, 1), 6).alias("first"),
        F.round(F.element_at(unit, -1), 6).alias("last"),
    )


@query
def recency_boost(spark, sf_dir):
    notes = I.plain_notes(spark, sf_dir)
    stored = V.recency_boost(F.col("mtime"), 0.05, I.NOW_MS)
    seconds = V.recency_boost(F.col("mtime"), 0.05, I.NOW_MS, unit_ms=1000)
    return notes.select(
        "file_path", F.round(stored * 1e6, 6).alias("boost_e6"), F.round(seconds, 9).alias("by_seconds")
    )


# --- lexical ---------------------------------------------------------------------------------


@query
def query_words(spark, sf_dir):
    """Words a question is reduced to, for every conversation turn."""
    words = T.query_tokens(F.col("text"))
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n")
    )


@query
def term_statistics(spark, sf_dir):
    index = lexical.index_chunks(I.documents_as_chunks(spark, sf_dir))
    return lexical.term_statistics(index)


@query
def fts_match(spark, sf_dir):
    """Documents holding every word of a benchmark passage."""
    index = lexical.index_chunks(I.documents_as_chunks(spark, sf_dir))
    hits = lexical.lexical_hits(index, I.benchmark_questions(spark, sf_dir))
    return hits.select("query_id", "chunk_id")


def _bm25(spark, sf_dir, questions):
    index = lexical.index_chunks(I.documents_as_chunks(spark, sf_dir))
    return lexical.lexical_top_k(index, questions, SETTINGS.lexical_top_k)


@query
def bm25_topk(spark, sf_dir):
    hits = _bm25(spark, sf_dir, I.word_questions(spark, sf_dir))
    return _ranked(hits, "chunk_id", _rounded("bm25", 9), _rounded("score", 6))


@query
def bm25_passages(spark, sf_dir):
    hits = _bm25(spark, sf_dir, I.benchmark_questions(spark, sf_dir))
    return _ranked(hits, "chunk_id", _rounded("bm25", 9))


@query
def bm25_phrases(spark, sf_dir):
    hits = _bm25(spark, sf_dir, I.phrase_questions(spark, sf_dir))
    return _ranked(hits, "chunk_id", _rounded("bm25", 9))


@query
def lexical_postfilter(spark, sf_dir):
    """Metadata filters apply to the lexical list after its cut."""
    questions, small = settle(I.word_questions(spark, sf_dir).withColumn("vector", F.array()))
    chunks = I.documents_as_chunks(spark, sf_dir)
    return _ranked(filter_hits(_bm25(spark, sf_dir, questions), chunks, FILTERS, small), "chunk_id")


# --- fusion and what follows -------------------------------------------------------------------


def _lists(spark, sf_dir):
    chunks = I.stored_corpus(spark, sf_dir)
    questions, small = settle(I.source_questions(spark, sf_dir))
    boost = V.recency_boost(F.col("mtime"), SETTINGS.recency_boost, I.NOW_MS)
    vector = vector_top_k(chunks, questions, SETTINGS.vector_top_k, boost)
    words = lexical.lexical_top_k(lexical.index_chunks(chunks), questions, SETTINGS.lexical_top_k)
    return chunks, vector, words, small


def _fused(spark, sf_dir, *columns):
    chunks, vector, words, small = _lists(spark, sf_dir)
    fused = fusion.fuse(vector, words).select("query_id", "chunk_id", "score", "rank")
    return fusion.attach(fused, chunks, columns, small) if columns else fused


@query
def fuse_rankings(spark, sf_dir):
    return _ranked(_fused(spark, sf_dir), "chunk_id", _rounded("score"))


@query
def cap_per_file(spark, sf_dir):
    capped = fusion.cap_per_file(_fused(spark, sf_dir, "file_path"))
    return _ranked(capped, "chunk_id", "file_path", _rounded("score"))


@query
def mmr_select(spark, sf_dir):
    """Twelve of the first forty fused chunks per question."""
    fused = _fused(spark, sf_dir, "embedding")
    pool = fused.where(F.col("rank") <= SETTINGS.diversification_pool)
    picked = diversify(pool, SETTINGS.rerank_top_n, SETTINGS.mmr_lambda)
    return _ranked(picked, "chunk_id", _rounded("score"))


@query
def merge_results(spark, sf_dir):
    """Two result lists, fused with opposite weights, merged by best score."""
    _, vector, words, _ = _lists(spark, sf_dir)
    merged = fusion.merge_results(fusion.fuse(vector, words), fusion.fuse(vector, words, 0.3, 0.7))
    return _ranked(merged, "chunk_id", _rounded("score"))


@query
def rerank_by_ids(spark, sf_dir):
    """Final lists reordered by a JSON response: every id backwards, the best one twice."""
    fused = _fused(spark, sf_dir, "heading_path", "content")
    top = fused.where(F.col("rank") <= SETTINGS.rerank_top_n)
    rows = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "heading_path", "content")))
    lists = top.groupBy("query_id").agg(rows.alias("rows"))
    ids = F.transform("rows", lambda row: row["chunk_id"])
    odd = F.filter(F.reverse(ids), lambda i: i.cast("long") % 2 == 1)
    response = F.to_json(F.concat(odd, F.slice(ids, 1, 1), F.array(F.lit("unknown"))))
    ordered = reorder(F.col("rows"), T.json_ids(response))
    return lists.select("query_id", F.posexplode(ordered).alias("at", "row")).select(
        "query_id", "row.chunk_id", T.sha1(preview(F.col("row"))).alias("preview_sha1"),
        (F.col("at") + 1).cast("long").alias("rank"),
    )


@query
def pack_context(spark, sf_dir):
    """Greedy packing of every document of a language, in id order, into 1800 tokens."""
    docs = I.table(spark, sf_dir, "documents")
    order = F.col("doc_id")
    ranked = docs.select(
        F.col("lang").alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"),
        order.alias("rank"), T.count_tokens(F.col("text")).alias("tokens"), F.col("text").alias("content"),
    )
    packed = packing.pack(ranked, SETTINGS.context_token_budget)
    return packed.select(
        "query_id", "chunk_id", F.col("tokens").cast("long").alias("tokens"),
        F.col("label").cast("long").alias("label"),
    )


@query
def hybrid_retrieve(spark, sf_dir):
    """Vector and lexical top-k, fusion, per-file cap and diversification for each source."""
    final = retrieve(
        I.stored_corpus(spark, sf_dir), I.source_questions(spark, sf_dir), MODEL_FREE, I.NOW_MS
    )
    return _ranked(final, "chunk_id", "file_path", _rounded("score"))


@query
def hybrid_filtered(spark, sf_dir):
    final = retrieve(
        I.stored_corpus(spark, sf_dir), I.source_questions(spark, sf_dir), MODEL_FREE, I.NOW_MS, FILTERS
    )
    return _ranked(final, "chunk_id", "file_path", _rounded("score"))


@query
def hybrid_passages(spark, sf_dir):
    """Hybrid retrieval for every benchmark passage."""
    final = retrieve(
        I.stored_corpus(spark, sf_dir), I.benchmark_questions(spark, sf_dir), MODEL_FREE, I.NOW_MS
    )
    return _ranked(final, "chunk_id", "file_path", _rounded("score"))


@query
def answer_context(spark, sf_dir):
    """Packed context with citations per benchmark passage, as handed to the answering model."""
    final = retrieve(
        I.stored_corpus(spark, sf_dir), I.benchmark_questions(spark, sf_dir), MODEL_FREE, I.NOW_MS
    )
    packed = packing.contexts(packing.pack(final, SETTINGS.context_token_budget))
    return packed.select(
        "query_id", "context", "citation_lines", F.size("citations").cast("long").alias("cited"),
        F.array_join("paths", " ").alias("paths"),
    )


@query
def answer_questions(spark, sf_dir):
    """The whole answer loop with the model stand-in: rewrites, follow-ups, merges, answer."""
    questions = I.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question")
    )
    result = answer_plan.answer(I.stored_corpus(spark, sf_dir), questions, CLIENT, Config(), I.NOW_MS)
    return result.select("query_id", "answer", "context", F.size("paths").cast("long").alias("cited"))


@query
def eval_metrics(spark, sf_dir):
    """Recall and citation accuracy of packed passages against their lexical matches."""
    chunks = I.stored_corpus(spark, sf_dir)
    questions, small = settle(I.benchmark_questions(spark, sf_dir))
    hits = lexical.lexical_top_k(lexical.index_chunks(chunks), questions, SETTINGS.lexical_top_k)
    expected = fusion.attach(hits, chunks, ["file_path"], small).groupBy("query_id").agg(
        F.array_sort(F.collect_set("file_path")).alias("expected_paths")
    )
    final = cut(retrieve(chunks, questions, MODEL_FREE, I.NOW_MS))
    packed = packing.contexts(packing.pack(final, SETTINGS.context_token_budget))
    cases = packed.select("query_id", "paths").join(expected, "query_id", "left")
    result = evaluate.metrics(evaluate.score_cases(cases, SETTINGS.rerank_top_n))
    return result.select(_rounded("recall_at_k"), _rounded("citation_accuracy"))


@query
def eval_answers(spark, sf_dir):
    """The evaluation over the whole answer loop: each item expects the file of the document of its number."""
    docs = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.array(F.concat("source", F.lit(".md"))).alias("expected_paths")
    )
    cases = I.table(spark, sf_dir, "benchmark").join(docs, "item_id", "left").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"),
        F.coalesce("expected_paths", F.array().cast("array<string>")).alias("expected_paths"),
    )
    result = answer_plan.evaluate(I.stored_corpus(spark, sf_dir), cases, CLIENT, MODEL_FREE, I.NOW_MS)
    return result.select(_rounded("recall_at_k"), _rounded("citation_accuracy"))


@query
def rerank_model(spark, sf_dir):
    """Hybrid retrieval whose final lists a model reorders: the stand-in answers all ids backwards."""
    final = retrieve(
        I.stored_corpus(spark, sf_dir), I.source_questions(spark, sf_dir), Config(), I.NOW_MS, client=Backwards()
    )
    return _ranked(final, "chunk_id", "file_path", _rounded("score"))


# --- chunking --------------------------------------------------------------------------------


def _chunk_rows(chunks):
    return chunks.select(
        "chunk_id", "file_path", "note_title", F.array_join("heading_path", ">").alias("heading_path"),
        F.col("ordinal").cast("long").alias("ordinal"), "chunk_type", F.array_join("tags", ",").alias("tags"),
        F.array_join("links", ",").alias("links"), "mtime", "content", "content_hash",
        T.sha1(F.col("representation")).alias("representation_sha1"),
        F.col("tokens").cast("long").alias("tokens"),
    )


@query
def chunk_documents(spark, sf_dir):
    """Unstructured documents: one chunk each, and an overlap chunk after a size flush."""
    return _chunk_rows(chunking.chunk_notes(I.plain_notes(spark, sf_dir)))


@query
def chunk_notes(spark, sf_dir):
    """Structured notes: frontmatter, headings, lists, fences, links, generated blocks."""
    return _chunk_rows(chunking.chunk_notes(I.rich_notes(spark, sf_dir)))


@query
def chunk_sql(spark, sf_dir):
    """The same by the registered table function, called laterally."""
    return _chunk_rows(table_function.chunk_notes_sql(I.rich_notes(spark, sf_dir)))


@query
def chunk_titles_only(spark, sf_dir):
    """Chunking without strong list or code boundaries and with title prefixes."""
    from ..config import StrongBoundaries

    loose = Chunking(
        strong_boundaries=StrongBoundaries(list=False, code=False), metadata_prefix_strategy="title_only"
    )
    return _chunk_rows(chunking.chunk_notes(I.rich_notes(spark, sf_dir), loose))


@query
def classify_lines(spark, sf_dir):
    """Line classes of every structured note, fences not considered."""
    return _line_classes(I.rich_notes(spark, sf_dir))


@query
def classify_grammar(spark, sf_dir):
    """The same for notes that hold every class of line."""
    return _line_classes(I.grammar_notes(spark, sf_dir))


def _line_classes(notes):
    lines = notes.select("file_path", F.posexplode(F.split("markdown", "\n", -1)).alias("at", "line"))
    return lines.groupBy("file_path", chunking.line_kind(F.col("line")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").cast("long").alias("first_line")
    )


@query
def token_counts(spark, sf_dir):
    """The three ways of counting tokens."""
    text = F.concat(F.col("text"), F.lit("\n"))
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", T.count_tokens(text).cast("long").alias("tokens"),
        T.count_pieces_or_zero(text).cast("long").alias("pieces"),
        T.count_pieces(F.concat(F.lit(" "), text)).cast("long").alias("raw_pieces"),
        T.utf16_length(text).cast("long").alias("units"),
    )


@query
def overlap_text(spark, sf_dir):
    """The last 60 tokens of every document that has more."""
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", T.last_tokens(F.col("text"), 60).alias("overlap")
    )


# --- notes as text ---------------------------------------------------------------------------


@query
def frontmatter(spark, sf_dir):
    """Frontmatter detection, tags, title and body of every structured note."""
    notes = I.rich_notes(spark, sf_dir).withColumn(
        "front", fm.yaml_facets(fm.fence_source(F.col("markdown")))
    )
    return notes.select(
        "file_path", fm.has_fence(F.col("markdown")).alias("has"),
        F.col("front.title").alias("title"), F.col("front.summary").alias("summary"),
        F.array_join(G.note_tags(F.col("front.tag_list"), F.col("front.tag_text")), ",").alias("tags"),
        F.array_join(G.existing_tags(F.col("front.tag_strings"), F.col("front.tag_text")), ",").alias("existing"),
        T.sha1(fm.fence_body(F.col("markdown"))).alias("body_sha1"),
    )


@query
def ensure_frontmatter(spark, sf_dir):
    notes = I.rich_notes(spark, sf_dir)
    created = T.created_at(F.lit(0.0), F.col("mtime") * 1000)
    full = fm.ensure_frontmatter(F.col("markdown"), T.drop_md(T.base_name(F.col("file_path"))), created)
    return notes.select("file_path", created.alias("created"), full.alias("markdown"))


@query
def generated_blocks(spark, sf_dir):
    """Stripping, dropping, extracting and unwrapping generated blocks."""
    text = F.col("markdown")
    dropped = M.drop_blocks(text, lambda line: line.startswith("AI Summary"))
    kept = M.drop_blocks(text, lambda line: line.startswith("AI Journal"))
    return I.rich_notes(spark, sf_dir).select(
        "file_path", T.sha1(M.strip_blocks(text)).alias("stripped"),
        T.sha1(dropped["content"]).alias("dropped"), dropped["removed"].cast("long").alias("removed"),
        T.sha1(kept["content"]).alias("kept"), kept["removed"].cast("long").alias("kept_removed"),
        F.array_join(M.extract_blocks(text), "|").alias("blocks"),
        T.sha1(M.strip_markers(text)).alias("unwrapped"),
    )


@query
def wiki_links(spark, sf_dir):
    links = T.wiki_links(F.concat(F.col("markdown"), F.lit(" [[a#b]] [[ x |y]] [[x]]")))
    return I.rich_notes(spark, sf_dir).select("file_path", F.array_join(links, ",").alias("links"))


@query
def normalize_tags(spark, sf_dir):
    """Tag candidates of every conversation turn, normalized, distinct and capped."""
    candidates = G.tag_candidates(F.col("text"))
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(candidates).cast("long").alias("candidates"),
        F.array_join(G.distinct_tags(candidates, 6), ",").alias("tags"),
        F.array_join(G.distinct_tags(G.plain_candidates(F.col("text")), None), ",").alias("all_tags"),
    )


@query
def merge_tags(spark, sf_dir):
    """Tags of a turn added to the role and turn tags it already has, six at most."""
    candidates = G.distinct_tags(G.tag_candidates(F.col("text")), 6)
    existing = G.existing_tags(F.array("role", F.concat(F.lit("#Turn "), F.col("turn").cast("string"))), F.lit(None).cast("string"))
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(existing, ",").alias("existing"),
        F.array_join(G.added_tags(existing, candidates, 6), ",").alias("added"),
    )


@query
def parse_responses(spark, sf_dir):
    """Model responses as arrays: strict JSON, JSON or lines, bullets."""
    lines = F.split("text", "\n", -1)
    as_json = F.to_json(lines)
    broken = F.concat(as_json, F.lit(" junk"))
    bullets = F.concat(F.lit("* "), F.array_join(lines, "\n- "))
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(T.json_ids(as_json)).cast("long").alias("ids"),
        F.size(T.json_ids(broken)).cast("long").alias("broken_ids"),
        T.sha1(F.array_join(T.json_array_or_lines(as_json), "|")).alias("from_json"),
        F.array_join(T.json_array_or_lines(F.col("text")), "|").alias("from_lines"),
        F.array_join(T.bullet_lines(bullets), "|").alias("from_bullets"),
    )


@query
def render_prompts(spark, sf_dir):
    """A template whose values hold slot-like text, filled in one pass."""
    values = {
        "name": F.concat(F.lit("{{ text }} "), F.col("source")), "text": F.col("text"), "n": F.col("n_chars"),
    }
    rendered = render_prompt("Hi {{name}} [{{ n }}] {{missing}}{{text}}!", values)
    return I.table(spark, sf_dir, "documents").select("doc_id", T.sha1(rendered).alias("prompt_sha1"))


@query
def truncate_text(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", T.truncate(F.col("text"), 1500).alias("snippet"),
        F.length(T.utf16_prefix(F.col("text"), 4000)).cast("long").alias("prefix_chars"),
    )


@query
def path_labels(spark, sf_dir):
    """Relative, posix, directory, title and wiki-link forms of every path."""
    path = F.replace(F.concat(F.lit("/vault/"), F.col("file_path")), F.lit("/1"), F.lit("\\1"))
    relative = T.relative_to(path, "/vault")
    return I.plain_notes(spark, sf_dir).select(
        "file_path", relative.alias("relative"), T.dir_name(F.col("file_path")).alias("dir"),
        T.drop_md(T.base_name(F.col("file_path"))).alias("title"),
        T.wiki_link(F.col("file_path")).alias("link"),
    )


@query
def time_labels(spark, sf_dir):
    """ISO times and duration labels of every event."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.expr("extract(SECOND FROM ts)")
    day = F.unix_date(F.to_date("ts")).cast("long") * 86_400_000
    ms = day + F.floor(seconds * 1000).cast("long")
    return I.table(spark, sf_dir, "events").select(
        "event_id", T.iso_millis(ms).alias("iso"),
        T.duration_label(F.floor(F.abs(F.col("value")) * 1000).cast("long")).alias("took"),
    )


@query
def filter_notes(spark, sf_dir):
    """Chunks of structured notes under a path, tag and chunk-type filter."""
    chunks = chunking.chunk_notes(I.rich_notes(spark, sf_dir))
    return chunks.where(FILTERS.predicate()).select("chunk_id", "file_path", "chunk_type")


@query
def filter_stored(spark, sf_dir):
    """The same over a written index, whose files are sorted by path."""
    store = NoteStore(spark, shared_folder(spark, "index"), buckets=16, files_per_bucket=1)
    index_notes(store, I.rich_notes(spark, sf_dir), CLIENT)
    return store.chunks().where(FILTERS.predicate()).select("chunk_id", "file_path", "chunk_type")


@query
def length_gates(spark, sf_dir):
    """Which writers would take a note, by the length of its user text."""
    limits = writers.Limits()
    cleaned = user_text(F.col("markdown"))
    return I.plain_notes(spark, sf_dir).select(
        "file_path", T.utf16_length(cleaned).cast("long").alias("units"),
        long_enough(cleaned, limits.tag_min_chars).alias("tag"),
        long_enough(cleaned, limits.summary_min_chars).alias("summary"),
    )


@query
def note_hygiene(spark, sf_dir):
    issues = hygiene.note_issues(I.rich_notes(spark, sf_dir), max_tokens=100)
    return issues.select("path", "type", "detail", F.col("seq").cast("long").alias("seq"))


@query
def hygiene_plain(spark, sf_dir):
    """Issues of notes without frontmatter and headings."""
    issues = hygiene.note_issues(I.plain_notes(spark, sf_dir), max_tokens=100)
    return issues.select("path", "type", "detail", F.col("seq").cast("long").alias("seq"))


@query
def journal_history(spark, sf_dir):
    """Recent sibling entries of every conversation turn."""
    notes = I.turn_notes(spark, sf_dir)
    return journal.recent_entries(notes, notes, I.NOW_MS, snippet_chars=300, max_chars=2000)


# --- index -----------------------------------------------------------------------------------


def _stored_files(spark, sf_dir):
    """Stored states: labelled documents (stale where quality is 0) and pages that are gone."""
    docs = I.table(spark, sf_dir, "documents")
    labels = I.table(spark, sf_dir, "labels")
    known = docs.join(labels, "doc_id").select(
        I.doc_path().alias("path"), (I.doc_mtime() - F.when(F.col("quality") == 0, 1).otherwise(0)).alias("mtime")
    )
    pages = I.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit(I.EPOCH).cast("long").alias("mtime"),
    )
    return known.unionByName(pages)


def _stored_chunks(spark, sf_dir):
    """Chunks of the stored version: stale documents had their text twice."""
    docs = I.table(spark, sf_dir, "documents")
    labels = I.table(spark, sf_dir, "labels")
    old = F.when(F.col("quality") == 0, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text"))
    notes = docs.join(labels, "doc_id").select(
        I.doc_path().alias("file_path"), I.doc_mtime().alias("mtime"), old.alias("markdown")
    )
    marker = F.array(F.lit(1.0), F.lit(0.0))
    return chunking.chunk_notes(notes).withColumn("embedding", marker)


@query
def index_status(spark, sf_dir):
    return indexing.file_status(I.plain_notes(spark, sf_dir), _stored_files(spark, sf_dir))


@query
def index_counters(spark, sf_dir):
    status = indexing.file_status(I.plain_notes(spark, sf_dir), _stored_files(spark, sf_dir))
    names = {"fresh": "new", "changed": "changed", "skipped": "unchanged", "removed": "removed"}
    return indexing.counters({n: status.where(F.col("status") == s) for n, s in names.items()})


def _fresh(spark, sf_dir):
    return chunking.chunk_notes(I.plain_notes(spark, sf_dir))


def _snapshots(spark, sf_dir):
    """Stored and fresh chunks, each chunked once: the joins of a change read only their columns."""
    return tuple(
        settled(chunks, shared_folder(spark, name))
        for name, chunks in (("stored", _stored_chunks(spark, sf_dir)), ("fresh", _fresh(spark, sf_dir)))
    )


@query
def index_reuse(spark, sf_dir):
    """Fresh chunks and whether the stored embedding can be kept."""
    matched = indexing.match_chunks(_fresh(spark, sf_dir), _stored_chunks(spark, sf_dir))
    return matched.select(
        "chunk_id", "file_path", "reused",
        F.when(F.col("reused"), F.size("embedding")).otherwise(0).cast("long").alias("dimensions"),
    )


@query
def index_stale(spark, sf_dir):
    return indexing.stale_chunks(_stored_chunks(spark, sf_dir), _fresh(spark, sf_dir))


@query
def index_upsert(spark, sf_dir):
    """The chunk table after stale chunks are deleted and fresh ones upserted."""
    stored, fresh = _snapshots(spark, sf_dir)
    changes = indexing.match_chunks(fresh, stored).select(*stored.columns)
    kept = indexing.delete(stored, indexing.stale_chunks(stored, fresh), "chunk_id")
    after = indexing.upsert(kept, changes, "chunk_id")
    return after.select("chunk_id", "file_path", "content_hash", F.col("tokens").cast("long").alias("tokens"))


@query
def index_postings(spark, sf_dir):
    """The lexical index after stale chunks are deleted and fresh ones upserted."""
    stored, fresh = _snapshots(spark, sf_dir)
    before = indexing.delete(stored, indexing.stale_chunks(stored, fresh), "chunk_id")
    matched = indexing.match_chunks(fresh, stored).where(~F.col("reused")).select("chunk_id", "file_path", "content")
    changed = settled(matched, shared_folder(spark, "changed"))
    # Chunks that go are left out before their postings are made: those would be joined row by row.
    kept = indexing.delete(before.select("chunk_id", "file_path", "content"), changed.select("chunk_id"), "chunk_id")
    after = postings.postings(kept).unionByName(postings.postings(changed))
    return after.where(F.col("term") != postings.ALL).select(
        "term", "chunk_id", "length", F.size("positions").cast("long").alias("tf"),
        F.array_max("positions").cast("long").alias("last_position"),
    )


@query
def bm25_postings(spark, sf_dir):
    """The word and phrase questions answered from postings."""
    index = settled(postings.postings(I.documents_as_chunks(spark, sf_dir)), shared_folder(spark, "postings"))
    asked = I.word_questions(spark, sf_dir).select("query_id", "question").unionByName(
        I.phrase_questions(spark, sf_dir).select(F.concat(F.lit("phrase "), "query_id").alias("query_id"), "question")
    )
    hits = lexical.lexical_top_k(index, asked, SETTINGS.lexical_top_k)
    return _ranked(hits, "chunk_id", _rounded("bm25", 9))


@query
def bm25_topk_stored(spark, sf_dir):
    """The word questions over a written index: only classes of postings that can matter are read."""
    folder = shared_folder(spark, "postings")
    postings.write(postings.postings(I.documents_as_chunks(spark, sf_dir)), folder, 8)
    hits = lexical.lexical_top_k(spark.read.parquet(folder), I.word_questions(spark, sf_dir), SETTINGS.lexical_top_k)
    return _ranked(hits, "chunk_id", _rounded("bm25", 9), _rounded("score", 6))


@query
def fts_phrases(spark, sf_dir):
    """Documents and occurrences of every pair of neighbouring words of the benchmark passages."""
    w = T.index_tokens(F.col("text"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.slice("w", i, 2))
    asked = I.table(spark, sf_dir, "benchmark").select(w.alias("w")).where(F.size("w") > 1)
    phrases = cut(asked.select(F.explode(pairs).alias("parts")).distinct())
    index = settled(postings.postings(I.documents_as_chunks(spark, sf_dir)), shared_folder(spark, "postings"))
    found = postings.phrase_hits(index, phrases)
    return found.groupBy(F.array_join("parts", " ").alias("phrase")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences")
    )


def _committed(spark, sf_dir):
    """An index after two runs: old versions and pages first, then all documents as they are."""
    labelled = I.table(spark, sf_dir, "documents").join(I.table(spark, sf_dir, "labels"), "doc_id")
    stale = F.col("quality") == 0
    old = labelled.select(
        I.doc_path().alias("file_path"), (I.doc_mtime() - F.when(stale, 1).otherwise(0)).alias("mtime"),
        F.when(stale, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text")).alias("markdown"),
    )
    pages = I.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("file_path"),
        F.lit(I.EPOCH).cast("long").alias("mtime"), F.col("url").alias("markdown"),
    )
    store = NoteStore(spark, shared_folder(spark, "index"), buckets=16, files_per_bucket=1)
    index_notes(store, old.unionByName(pages), CLIENT)
    index_notes(store, I.plain_notes(spark, sf_dir), CLIENT)
    return store.pinned()


@query
def index_committed(spark, sf_dir):
    """Chunks, postings and file states of one state of the index, read back after two runs."""
    store = _committed(spark, sf_dir)
    none = F.lit(None).cast("string")
    chunks = store.chunks().select(
        F.lit("chunks").alias("part"), F.col("chunk_id").alias("key"), "file_path", "content_hash", F.col("tokens").cast("long").alias("n")
    )
    states = store.files().select(F.lit("files"), "path", F.col("path"), "content_hash", F.col("chunk_count").cast("long"))
    held = store.lexical_index().where(F.col("term") != postings.ALL).groupBy("chunk_id", "file_path").agg(F.sum("tf").alias("n"))
    return chunks.union(states).union(held.select(F.lit("postings"), "chunk_id", "file_path", none, "n"))


@query
def index_statistics(spark, sf_dir):
    """Document and corpus frequencies that the commits of two runs have left, added up over buckets."""
    found = postings.merged(_committed(spark, sf_dir).statistics()).where(F.col("term") != postings.ALL)
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


@query
def index_file_states(spark, sf_dir):
    """File rows after a run: reused chunks are listed before embedded ones."""
    matched = indexing.match_chunks(_fresh(spark, sf_dir), _stored_chunks(spark, sf_dir))
    written = matched.withColumn("write_order", F.struct(~F.col("reused"), F.col("ordinal")))
    states = indexing.file_states(written)
    return states.select("path", "mtime", F.col("chunk_count").cast("long").alias("chunk_count"), "content_hash")


@query
def index_run(spark, sf_dir):
    """Statistics of a whole index run over the two snapshots; changed chunks are embedded."""
    stored = settled(_stored_chunks(spark, sf_dir), shared_folder(spark, "stored"))
    change = indexing.plan_change(
        I.plain_notes(spark, sf_dir), None, _stored_files(spark, sf_dir),
        lambda paths: stored.join(paths.select("file_path").distinct(), "file_path", "left_semi"),
        lambda text: embedding(text, CLIENT),
    )
    return change.stats


# --- writers ---------------------------------------------------------------------------------


@query
def summarize_notes(spark, sf_dir):
    return writers.summarize(I.rich_notes(spark, sf_dir), CLIENT, I.NOW_MS)


@query
def tag_notes(spark, sf_dir):
    result = writers.tag(I.rich_notes(spark, sf_dir), CLIENT)
    return result.select("file_path", "status", "message", "new_markdown")


@query
def related_notes(spark, sf_dir):
    """Related blocks for structured notes; the stand-in embeds the notes."""
    chunks = I.corpus(spark, sf_dir)
    return writers.related(I.rich_notes(spark, sf_dir), chunks, CLIENT, I.NOW_MS)


@query
def rework_notes(spark, sf_dir):
    notes = I.rich_notes(spark, sf_dir).select(
        "file_path", "markdown", (F.col("mtime") * 1000).cast("double").alias("mtime_ms"),
        F.lit(0.0).alias("birth_ms"),
    )
    return writers.rework(notes, CLIENT)


@query
def journal_notes(spark, sf_dir):
    """Reflections for every conversation turn with history and knowledge context."""
    notes = I.turn_notes(spark, sf_dir)
    return writers.journal(notes, notes, I.stored_corpus(spark, sf_dir, counted=True), CLIENT, I.NOW_MS, MODEL_FREE)


@query
def enrich_notes(spark, sf_dir):
    """Summary, tags and related content of every structured note in turn."""
    return writers.enrich(I.rich_notes(spark, sf_dir), I.corpus(spark, sf_dir), CLIENT, I.NOW_MS)
