"""Chunker grammar and builder, worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from notelode.config import Chunking, StrongBoundaries
from notelode.functions.markers import BLOCK_END, BLOCK_START
from notelode.operators.chunking import chunk_notes

SMALL = Chunking(target_tokens=50, max_tokens=80, min_tokens=10, overlap_tokens=5)


@pytest.fixture(scope="module")
def chunks_of(spark):
    def run(markdown, config=SMALL, path="Note.md"):
        notes = spark.createDataFrame([(path, 1, markdown)], "file_path string, mtime long, markdown string")
        return chunk_notes(notes, config).orderBy("ordinal").collect()

    return run


def test_generated_text_is_left_out_and_metadata_kept(chunks_of):
    rows = chunks_of(
        f'---\ntags: ["#foo"]\n---\n# Heading\nReal content line\n{BLOCK_START}\nnot indexed\n{BLOCK_END}\nMore'
    )
    assert [r["content"] for r in rows] == ["Real content line\nMore"]
    assert rows[0]["tags"] == ["foo"] and rows[0]["heading_path"] == ["Heading"]
    assert rows[0]["representation"] == "Heading: Heading\nTags: foo\n\nReal content line\nMore"


def test_code_stays_whole(chunks_of):
    rows = chunks_of("# H1\n```ts\nconst foo = 1;\n\n# no heading\n~~~\n```")
    assert len(rows) == 1 and rows[0]["chunk_type"] == "code"
    assert "# no heading" in rows[0]["content"]


def test_callout_is_a_boundary(chunks_of):
    rows = chunks_of("# H1\n> [!NOTE] callout\n\nParagraph")
    assert [r["chunk_type"] for r in rows] == ["callout", "text"]


def test_callout_body_is_a_quote_of_its_own(chunks_of):
    rows = chunks_of("> [!note] title\n> more\n> lines")
    assert [(r["chunk_type"], r["content"]) for r in rows] == [
        ("callout", "> [!note] title"), ("quote", "> more\n> lines"),
    ]


def test_unclosed_fence_runs_to_the_end_and_indented_fence_closes(chunks_of):
    assert [r["content"] for r in chunks_of("```\na\n\n# b")] == ["```\na\n\n# b"]
    rows = chunks_of("~~~\na\n  ~~~\nafter")
    assert [r["content"] for r in rows] == ["~~~\na\n  ~~~", "after"]
    assert [r["chunk_type"] for r in chunks_of("x\n  ```\ntext")] == ["text"]


def test_table_is_emitted_before_the_paragraph_it_interrupts(chunks_of):
    rows = chunks_of("before\n| a | b |\n| --- | --- |\n| 1 | 2 |\nafter")
    assert [(r["chunk_type"], r["content"]) for r in rows] == [
        ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("text", "before\nafter"),
    ]
    assert rows[0]["tokens"] == 15


def test_tight_separator_splits_the_header_row(chunks_of):
    rows = chunks_of("| a |\n|---|\n| 1 |")
    assert [(r["chunk_type"], r["content"]) for r in rows] == [
        ("table", "| a |"), ("table", "| 1 |"), ("text", "|---|"),
    ]


def test_rule_wins_over_list_and_is_a_chunk(chunks_of):
    rows = chunks_of("a\n- - -\n- item\n* * x")
    assert [(r["chunk_type"], r["content"]) for r in rows] == [
        ("text", "a"), ("text", "- - -"), ("list", "- item\n* * x"),
    ]


def test_indented_continuation_leaves_the_list(chunks_of):
    rows = chunks_of("1. one\n   more\n2. two")
    assert [(r["chunk_type"], r["content"]) for r in rows] == [
        ("list", "1. one"), ("text", "more"), ("list", "2. two"),
    ]


def test_carriage_returns_hide_headings(chunks_of):
    rows = chunks_of("# Title\r\ntext\r\n")
    assert [r["content"] for r in rows] == ["# Title\r\ntext"]
    assert rows[0]["heading_path"] == ["Note"]


def test_heading_stack_and_titles(chunks_of):
    rows = chunks_of("# A\na\n### C\nc\n## B\nb\n# A\nagain")
    assert [r["heading_path"] for r in rows] == [["A"], ["A", "C"], ["A", "B"], ["A"]]
    rows = chunks_of("---\ntitle: ' T '\n---\n# A\na\n# \nb")
    assert [r["heading_path"] for r in rows] == [["T", "A"], ["T"]]
    assert chunks_of("# \nx", path="dir/My.MD")[0]["note_title"] == "My"


def test_size_flush_leaves_an_overlap_tail(chunks_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = chunks_of(f"# One\n{text}\n# Two\nend")
    assert [(r["heading_path"], r["tokens"]) for r in rows] == [
        (["One"], 60), (["One"], 5), (["One", "Two"], 1),
    ]
    assert rows[1]["content"] == "w55 w56 w57 w58 w59"


def test_overlap_joins_the_next_block(chunks_of):
    first = " ".join(f"a{i}" for i in range(52))
    second = " ".join(f"b{i}" for i in range(46))
    rows = chunks_of(f"{first}\n\n{second}\n\nlast")
    assert rows[1]["content"] == f"a47 a48 a49 a50 a51\n\n{second}"
    assert rows[1]["tokens"] == 51
    assert rows[2]["content"] == "b41 b42 b43 b44 b45\n\nlast"


def test_overlap_reaches_back_over_several_blocks(chunks_of):
    config = Chunking(target_tokens=4, max_tokens=9, overlap_tokens=3, min_tokens=0)
    rows = chunks_of("a b c d\n\ne\n\nf\n\ng", config)
    assert [r["content"] for r in rows] == ["a b c d", "b c d\n\ne", "c d e\n\nf", "d e f\n\ng", "e f g"]


def test_max_tokens_does_not_split_blocks(chunks_of):
    text = " ".join("x" * 1 for _ in range(500))
    assert chunks_of(text)[0]["tokens"] == 500


def test_merging_needs_size_flushed_chunks_below_the_minimum(chunks_of):
    config = Chunking(target_tokens=4, max_tokens=9, overlap_tokens=0, min_tokens=6)
    rows = chunks_of("a b c d\n\ne f g h\n\ni", config)
    assert [(r["content"], r["tokens"]) for r in rows] == [("a b c d\n\ne f g h", 8), ("i", 1)]
    unmerged = Chunking(target_tokens=4, max_tokens=9, overlap_tokens=0, merge_small_chunks=False)
    assert len(chunks_of("a b c d\n\ne f g h\n\ni", unmerged)) == 3


def test_type_is_the_heaviest_and_ties_follow_declaration(chunks_of):
    loose = Chunking(strong_boundaries=StrongBoundaries(False, False, False, False, False))
    assert chunks_of("a b\n\n- c", loose)[0]["chunk_type"] == "text"
    assert chunks_of("a b\n\n- c d e", loose)[0]["chunk_type"] == "list"
    assert chunks_of("> q\n\n```\n```", loose)[0]["chunk_type"] == "code"


def test_ids_hashes_and_links(chunks_of):
    row = chunks_of("# H\nsee [[x]] and [[y|z]]", path="d/n.md")[0]
    assert row["chunk_id"] == hashlib.sha1(b"d/n.md|H|1").hexdigest()
    assert row["content_hash"] == hashlib.sha1(row["content"].encode()).hexdigest()
    assert row["links"] == ["x", "y"]


def test_empty_and_broken_notes_yield_nothing(chunks_of):
    assert chunks_of("") == [] and chunks_of("# only\n\n## headings") == []
    assert chunks_of("---\na: [\n---\ntext") == []


def test_long_note_does_not_overflow(chunks_of):
    rows = chunks_of("-" * 20_000 + "\n" + "\n".join("line" for _ in range(20_000)))
    assert [r["tokens"] for r in rows] == [1, 20_000, 5]
