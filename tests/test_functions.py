"""Scalar functions against hand-worked values."""

import json

import pytest
from pyspark.sql import functions as F

from notelode.functions import frontmatter as fm
from notelode.functions import markers as M
from notelode.functions import tags as G
from notelode.functions import text as T
from notelode.functions import vectors as V
from notelode.functions.prompts import render_prompt

B, E = M.BLOCK_START, M.BLOCK_END
NBSP, BOM = chr(0xA0), chr(0xFEFF)


@pytest.mark.parametrize(
    "text, expected",
    [
        (f"Hello world\n{B}\nx\n{E}\nGoodbye", "Hello world\nGoodbye"),
        (f"Intro\n{B}\na\n{E}\nMiddle\n{B}\nb\n{E}", "Intro\nMiddle"),
        ("Plain text", "Plain text"),
        (f"one\n\ntwo\n\n\n{B}x{E}", "one\ntwo"),  # all blank lines go once a block exists
        (f"open {B} never closed\n\nend", f"open {B} never closed\nend"),
        ("a\n\nb", "a\n\nb"),
    ],
)
def test_strip_blocks(one, text, expected):
    assert one(M.strip_blocks, text) == expected


def test_drop_blocks_by_title(one):
    text = f"A\n\n\n\n{B}\n\n  AI Summary of x\nbody\n{E}\n\n{B}\nOther\n{E}\n  "
    result = one(lambda c: M.drop_blocks(c, lambda line: line.startswith("AI Summary")), text)
    assert result["removed"] == 1
    assert result["content"] == f"A\n\n{B}\nOther\n{E}"
    assert one(lambda c: M.drop_blocks(c, lambda line: line == ""), f"x{B}{E}y")["content"] == "xy"
    untouched = one(lambda c: M.drop_blocks(c, lambda line: F.lit(True)), "no blocks  \n\n\n\n")
    assert untouched["content"] == "no blocks  \n\n\n\n" and untouched["removed"] == 0


def test_nested_start_marker_belongs_to_the_outer_block(one):
    text = f"a {B} x {B} y {E} b"
    assert one(M.extract_blocks, text) == [f"x {B} y"]
    assert one(lambda c: M.drop_blocks(c, lambda line: F.lit(True))["content"], text) == "a  b"


def test_extract_and_unwrap_blocks(one):
    text = f"x {B}\n one \n{E} y {B}  {E}"
    assert one(M.extract_blocks, text) == ["one"]
    assert one(M.strip_markers, f"{B}\n body \n{E}\nrest") == "body\nrest"
    assert one(M.strip_markers, "<!--AI:BEGIN-->x<!--  AI:END  -->") == "x"


def test_append_block(one):
    fresh = one(lambda c: M.append_block(c, " T ", F.lit(" body\n")), "")
    assert fresh == f"{B}\nT\n\nbody\n{E}\n\n"
    old = f"Note\n\n{B}\nT one\n\nold\n{E}\n\n"
    again = one(lambda c: M.append_block(c, "T", F.lit("new"), lambda l: l.startswith("T")), old)
    assert again == f"Note\n\n{B}\nT\n\nnew\n{E}\n\n"


def test_white_space_is_unicode(one):
    text = f"{BOM} a{NBSP}b c 　"
    assert one(T.trim, text) == f"a{NBSP}b c"
    assert one(T.count_tokens, text) == 3
    assert one(T.words, text) == ["a", "b", "c"]
    assert one(T.is_blank, f"{NBSP} \n{BOM}") is True
    assert one(T.count_tokens, "a\u0085b") == 1  # NEL is no white space here


def test_token_counts_differ_at_edges_and_blanks(one):
    for text, a, b, c in (("", 0, 0, 1), ("  ", 0, 0, 2), (" a b ", 2, 4, 4), ("a", 1, 1, 1)):
        assert one(T.count_tokens, text) == a
        assert one(T.count_pieces_or_zero, text) == b
        assert one(T.count_pieces, text) == c


def test_lengths_count_utf16_units(one):
    face = chr(0x1F600)
    assert one(T.utf16_length, face + "b") == 3
    assert one(lambda c: T.utf16_prefix(c, 3), face + "bc") == face + "b"
    assert one(lambda c: T.utf16_prefix(c, 1), face + "bc") == ""
    assert one(lambda c: T.truncate(c, 4), "abc  def") == "abc\n..."
    assert one(lambda c: T.truncate(c, 8), "abc  def") == "abc  def"


def test_last_tokens(one):
    assert one(lambda c: T.last_tokens(c, 2), "a b\nc") == "b c"
    assert one(lambda c: T.last_tokens(c, 3), "a b c") is None
    assert one(lambda c: T.last_tokens(c, 0), "a b c") is None


def test_paths(one):
    assert one(T.wiki_link, "a/b.MD") == "[[a/b]]"
    assert one(T.dir_name, "a/b/c.md") == "a/b" and one(T.dir_name, "c.md") == "."
    assert one(lambda c: T.relative_to(c, "/v/"), "/v/a\\b.md") == "a/b.md"


def test_times(one):
    assert one(T.iso_millis, 1_700_000_000_123) == "2023-11-14T22:13:20.123Z"
    assert one(T.iso_millis, -1) == "1969-12-31T23:59:59.999Z"
    assert one(T.created_at, 0.0, 1000.0) == "1970-01-01T00:00:01.000Z"
    assert one(T.created_at, 2000.0, 1000.0) == "1970-01-01T00:00:02.000Z"
    labels = {12: "12ms", 1500: "1.50s", 123000: "2m3.0s", 230250: "3m50.3s", 104050: "1m44.0s"}
    for ms, label in labels.items():
        assert one(T.duration_label, ms) == label
    assert one(lambda c: T.fixed(c, 2), 1.005) == "1.00"


def test_wiki_links(one):
    text = "[[b]] [[a|label]] [[x#y]] [[ b ]] [[ ]] [[c\nd]]"
    assert one(T.wiki_links, text) == ["b", "a", "c\nd"]


def test_index_and_query_tokens(one):
    assert one(T.index_tokens, "Naïve foo_bar Über-x2") == ["naive", "foo", "bar", "uber", "x2"]
    assert one(T.index_tokens, "naïve") == ["naive"]
    assert one(T.query_tokens, "Über foo_bar `x`") == ["ber", "foo_bar", "x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('["a", "b"]', ["a", "b"]),
        (' ["a", 1, true, null] ', ["a", "1", "true", "null"]),
        ("[]", []),
        ('["a"] junk', None),
        ('["a"],["b"]', None),
        ('["a"]],[', None),
        ('{"a": 1}', None),
        ("", None),
        ("x", None),
    ],
)
def test_strict_json_array(one, text, expected):
    assert one(T.strict_json_array, text) == expected


def test_model_responses(one):
    assert one(T.json_ids, "nothing") == []
    assert one(T.json_array_or_lines, " one \n\n- two") == ["one", "- two"]
    assert one(T.bullet_lines, "* one\n-two\n\n  * three\n- ") == ["one", "two", "* three"]


def test_frontmatter_goldens(one):
    def facets(text):
        return one(lambda c: fm.yaml_facets(fm.fence_source(c)), text)

    note = "---\ntags:\n  - #foo\n---\nBody text"
    assert facets(note)["tag_list"] == ["#foo"]
    assert one(fm.fence_body, note) == "Body text"
    assert one(fm.has_fence, "No frontmatter\nLine2") is False
    assert one(fm.fence_body, "---\ntags: #foo\nBody") == "---\ntags: #foo\nBody"
    assert one(fm.has_fence, "---\ntags: #foo\nBody") is False
    assert one(fm.fence_body, "---\n---\nfoo\n---\nbar") == "foo\n---\nbar"
    assert one(fm.fence_body, " ---\r\na: 1\n--- \nrest") == "rest"
    assert one(fm.has_fence, "---\na: 1\n---") is True
    assert facets("---\n\n---\nx")["json"] == "{}"
    assert facets("---\na: [1\n---\nx")["error"]


def test_frontmatter_uses_the_core_schema(one):
    note = "---\nday: 2024-01-02\nyes: yes\nn: 0o17\nt: 12:30\nnone: ~\nf: 1.5\ntags: [1, true, x]\n---\n"
    row = one(lambda c: fm.yaml_facets(fm.fence_source(c)), note)
    data = json.loads(row["json"])
    assert data == {
        "day": "2024-01-02", "yes": "yes", "n": 15, "t": "12:30", "none": None, "f": 1.5,
        "tags": [1, True, "x"],
    }
    assert row["tag_list"] == ["1", "true", "x"] and row["tag_strings"] == ["x"]


def test_frontmatter_text(one):
    def build(data, body):
        return one(lambda d, b: fm.with_frontmatter_text(d, b), json.dumps(data), body)

    expected = '---\ntags:\n  - "#foo"\n  - "#bar"\n---\nContent\nWith lines'
    assert build({"tags": ["#foo", "#bar"]}, "Content\nWith lines") == expected
    assert build({}, "Body text") == "---\n---\nBody text"
    assert build({"a": "1", "b": "yes"}, "\n\nx") == '---\na: "1"\nb: yes\n---\nx'
    assert build({"a": 1}, "") == "---\na: 1\n---\n"


def test_tags(one):
    assert one(lambda c: G.note_tags(c, F.lit(None).cast("string")), ["#a", " ", "##b", "c "]) == ["a", "#b", "c"]
    assert one(lambda c: G.note_tags(F.lit(None).cast("array<string>"), c), "#a, b  c") == ["a", "b", "c"]
    for raw, tag in (("## My Tag! ", "#my-tag"), ("#", None), ("ÄÖ", None), ("a-b  c", "#a-b-c")):
        assert one(G.normalize_tag, raw) == tag
    assert one(G.tag_candidates, '["a", 2]') == ["a", "2"]
    assert one(G.tag_candidates, "- a,*b, *c\n\nd") == ["a", "b", "*c", "d"]
    assert one(lambda c: G.distinct_tags(c, 2), ["a", "#A", "", "b", "c"]) == ["#a", "#b"]
    assert one(lambda e, c: G.added_tags(e, c, 3), ["#a", "#b"], ["b", "c", "d"]) == ["#c"]
    assert one(lambda e, c: G.added_tags(e, c, 1), ["#a", "#b"], ["c"]) == []


def test_prompts_render_in_one_pass(one):
    render = lambda template, **values: one(lambda z: render_prompt(template, values), "")
    assert render("Hello {{name}}", name="world") == "Hello world"
    assert render("Hello {{name}}, your score is {{score}}.", name="Vault", score=42) == (
        "Hello Vault, your score is 42."
    )
    assert render("a{{ missing }}b") == "ab"
    assert render("{{a}}{{b}}", a="{{b}}", b="x") == "{{b}}x"


def test_vectors(one):
    assert one(V.cosine, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]) == pytest.approx(1)
    assert one(V.cosine, [1.0, 0.0], [0.0, 1.0]) == 0
    assert one(V.cosine, [0.0, 0.0], [1.0, 1.0]) == 0
    assert one(V.cosine, [3.0, 4.0, 9.0], [3.0, 4.0]) == pytest.approx(1)
    assert one(V.dot, [1.0, 2.0, 3.0], [4.0, 5.0]) == 14
    assert one(V.normalize, [3.0, 4.0]) == [0.6, 0.8]
    assert one(V.normalize, [0.0, 0.0]) == [0, 0]


def test_recency_takes_seconds_as_milliseconds(one):
    now = 1_700_000_000_000
    day = V.DAY_MS
    assert one(lambda m: V.recency_boost(m, 0.05, now), now) == 0.05
    assert one(lambda m: V.recency_boost(m, 0.05, now), now + 5) == 0.05
    assert one(lambda m: V.recency_boost(m, 0.05, now), now - day) == 0.025
    assert one(lambda m: V.recency_boost(m, 0.05, now), now // 1000) < 1e-5
    assert one(lambda m: V.recency_boost(m, 0.05, now, 1000), now // 1000) == 0.05
    assert one(lambda m: V.recency_boost(m, 0.0, now), 1) == 0
