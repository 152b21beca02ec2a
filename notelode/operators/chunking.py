"""Structure-aware chunking of Markdown notes.

The text stays in the JVM. Each line is classified to one letter and a token count by column
expressions; a small Arrow function sees only those letters, counts and heading texts and
decides which lines form which chunk; the chunk texts, ids, hashes and links are then column
expressions again. Notes are never shuffled or split across rows before the final explode.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import frontmatter as fm
from ..functions import text as T
from ..functions.markers import strip_blocks
from ..functions.steps import in_steps
from ..functions.tags import note_tags
from ..schema import CHUNK_COLUMNS, CHUNK_TYPES

S = T.SPACE
_DOT = f"[^{T.LINE_END}]"

# Line grammar, first match wins. A digit is a heading depth; ``b`` and ``t`` are
# paragraph lines that would close an open fence.
LINE_GRAMMAR = (
    *((str(n), rf"\A#{{{n}}}[{S}]+{_DOT}*\z") for n in range(1, 7)),
    ("`", r"\A```"),
    ("~", r"\A~~~"),
    (".", rf"\A[{S}]*\z"),
    ("-", rf"\A(?:\*[{S}]*\*[{S}]*\*[*{S}]*|-[{S}]*-[{S}]*-[-{S}]*|_[{S}]*_[{S}]*_[_{S}]*)\z"),
    ("|", rf"\A[{S}]*\|(?!---)"),
    ("!", rf"(?i)\A>[{S}]*\[![A-Z]+\]{_DOT}*\z"),
    (">", r"\A>"),
    ("*", rf"\A[{S}]{{0,3}}(?:[-*+]|[0-9]+\.)[{S}]+"),
    ("b", rf"\A[{S}]*```"),
    ("t", rf"\A[{S}]*~~~"),
)
PLAN_TYPE = (
    "struct<title:string,chunks:array<struct<heading_path:array<string>,"
    "parts:array<struct<overlap:boolean,lines:array<int>>>,tokens:int,chunk_type:string>>>"
)
_PART = pa.struct({"overlap": pa.bool_(), "lines": pa.list_(pa.int32())})
_CHUNK = pa.struct(
    {"heading_path": pa.list_(pa.string()), "parts": pa.list_(_PART), "tokens": pa.int32(), "chunk_type": pa.string()}
)
_PLAN = pa.struct({"title": pa.string(), "chunks": pa.list_(_CHUNK)})


def line_kind(line: Column) -> Column:
    """Letter of one line, looked at on its own."""
    letters = iter(LINE_GRAMMAR)
    letter, pattern = next(letters)
    kind = F.when(line.rlike(pattern), F.lit(letter))
    for letter, pattern in letters:
        kind = kind.when(line.rlike(pattern), F.lit(letter))
    return kind.otherwise(F.lit("p"))


def heading_text(line: Column) -> Column:
    return T.trim(F.regexp_replace(line, rf"\A#{{1,6}}[{S}]+", ""))


_TYPES = {"`": "code", "~": "code", "!": "callout", ">": "quote", "*": "list"}
_CLOSES = {"`": "`b", "~": "~t"}


def _blocks(kinds: str) -> Iterable[tuple[str, list[int]]]:
    """Blocks in emission order as ``(type, line numbers)``; headings carry their depth digit.

    Table rows gather beside an open paragraph, list or quote without closing it, so a table is
    emitted before the text it interrupts.
    """
    fence, kind, lines, table = "", "", [], []

    def drain():
        nonlocal kind, lines, table
        if table:
            yield "table", table
            table = []
        if lines:
            yield kind, lines
            kind, lines = "", []

    for number, letter in enumerate(kinds):
        if fence:
            lines.append(number)
            if letter in _CLOSES[fence]:
                fence = ""
                yield from drain()
        elif letter == "|":
            table.append(number)
        elif letter in "123456-.":
            yield from drain()
            if letter != ".":
                yield ("hr" if letter == "-" else letter), [number]
        elif letter in "`~":
            yield from drain()
            fence, kind, lines = letter, "code", [number]
        else:
            if table:
                yield "table", table
                table = []
            soft = _TYPES.get(letter, "paragraph")
            if soft == kind and soft != "callout":
                lines.append(number)
            else:
                yield from drain()
                kind, lines = soft, [number]
    yield from drain()


def _heading_path(title: str, stack: dict[int, str]) -> list[str]:
    path = [title]
    for depth in sorted(stack):
        if stack[depth] and stack[depth] != path[-1]:
            path.append(stack[depth])
    return path


class _Builder:
    """Greedy chunk builder over the blocks of one note."""

    def __init__(self, costs: list[int], title: str, config: Chunking):
        self.costs, self.title, self.config = costs, title, config
        self.stack: dict[int, str] = {}
        self.chunks: list[dict] = []
        self._restart([])

    def _restart(self, overlap: list[int]) -> None:
        n = self.config.overlap_tokens
        self.parts = [{"overlap": True, "lines": overlap}] if overlap else []
        self.total = n if overlap else 0
        self.by_type = dict.fromkeys(CHUNK_TYPES, 0)
        self.by_type["text"] = self.total

    def heading(self, depth: int, text: str) -> None:
        self.flush("heading")
        self.stack = {d: t for d, t in self.stack.items() if d < depth} | {depth: text}

    def block(self, kind: str, lines: list[int]) -> None:
        strong = getattr(self.config.strong_boundaries, kind, False)
        if strong:
            self.flush("boundary")
        cost = sum(self.costs[i] for i in lines)
        self.parts.append({"overlap": False, "lines": lines})
        self.total += cost
        self.by_type[kind if kind in self.by_type else "text"] += cost
        if strong:
            self.flush("boundary")
        elif self.total >= min(self.config.target_tokens, self.config.max_tokens):
            self.flush("size")

    def flush(self, reason: str) -> None:
        if not self.parts:
            return
        self.chunks.append(
            {
                "heading_path": _heading_path(self.title, self.stack),
                "parts": self.parts,
                "tokens": self.total,
                "chunk_type": max(CHUNK_TYPES, key=lambda t: self.by_type[t]),
                "by_size": reason == "size",
            }
        )
        self._restart(self._tail() if reason == "size" else [])

    def _tail(self) -> list[int]:
        """Fewest last lines of the chunk that hold the overlap; empty when it has too few."""
        need = self.config.overlap_tokens
        if need <= 0 or self.total <= need:
            return []
        tail: list[int] = []
        for line in reversed([i for part in self.parts for i in part["lines"]]):
            if need <= 0:
                break
            tail.append(line)
            need -= self.costs[line]
        return tail[::-1]

    def merged(self) -> list[dict]:
        if not self.config.merge_small_chunks:
            return self.chunks
        out: list[dict] = []
        for chunk in self.chunks:
            last = out[-1] if out else None
            if (
                last
                and chunk["tokens"] < self.config.min_tokens
                and last["by_size"]
                and chunk["by_size"]
                and last["heading_path"] == chunk["heading_path"]
            ):
                last["parts"] = last["parts"] + chunk["parts"]
                last["tokens"] += chunk["tokens"]
            else:
                out.append(chunk)
        return out


def plan_note(
    kinds: str, costs: list[int], headings: list[str], title: str, fallback: str, config: Chunking
) -> dict:
    """Title and chunks of one note as line numbers."""
    text_of = dict(zip((i for i, k in enumerate(kinds) if k in "123456"), headings))
    blocks = list(_blocks(kinds))
    first = next((text_of[lines[0]] for kind, lines in blocks if kind in "123456"), "")
    title = title or first or fallback
    builder = _Builder(costs, title, config)
    for kind, lines in blocks:
        if kind in "123456":
            builder.heading(int(kind), text_of[lines[0]])
        else:
            builder.block(kind, lines)
    builder.flush("end")
    return {"title": title, "chunks": builder.merged()}


def _plan_udf(config: Chunking):
    def plans(kinds: pa.Array, costs: pa.Array, headings: pa.Array, title: pa.Array, fallback: pa.Array) -> pa.Array:
        rows = [
            {"title": f, "chunks": []} if k is None else plan_note(k, c, h, t or "", f, config)
            for k, c, h, t, f in zip(*(column.to_pylist() for column in (kinds, costs, headings, title, fallback)))
        ]
        return pa.array(rows, _PLAN)

    @F.arrow_udf(PLAN_TYPE)
    def plan(
        kinds: pa.Array, costs: pa.Array, headings: pa.Array, title: pa.Array, fallback: pa.Array
    ) -> pa.Array:
        return in_steps(plans, [kinds, costs, headings, title, fallback], _PLAN)

    return plan


def parse_notes(notes: DataFrame) -> DataFrame:
    """Notes with ``body``, ``front`` (parsed frontmatter) and ``lines``."""
    return (
        notes.withColumn("_clean", strip_blocks(F.col("markdown")))
        .withColumn("front", fm.yaml_facets(fm.fence_source(F.col("_clean"))))
        .withColumn("body", T.trim(fm.fence_body(F.col("_clean"))))
        .withColumn("lines", F.split("body", "\n", -1))
        .drop("_clean")
    )


def _part_text(lines: Column, part: Column, overlap: int) -> Column:
    picked = F.transform(part["lines"], lambda i: F.element_at(lines, i + 1))
    joined = F.array_join(picked, "\n")
    if overlap <= 0:
        return joined
    tail = F.array_join(F.slice(T.words(joined), -overlap, overlap), " ")
    return F.when(part["overlap"], tail).otherwise(joined)


def representation(
    content: Column, heading_path: Column, title: Column, tags: Column, strategy: str
) -> Column:
    """Text that gets embedded: a heading or title line, a tag line, a blank line, the content."""
    if strategy == "heading_path":
        head = F.concat(F.lit("Heading: "), F.array_join(heading_path, " > "))
    else:
        head = F.concat(F.lit("Title: "), title)
    tag_line = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    return T.trim(F.concat(F.concat_ws("\n", head, tag_line), F.lit("\n\n"), content))


def chunk_id(file_path: Column, heading_path: Column, ordinal: Column) -> Column:
    """Stable id; ordinals count through the note, so an inserted chunk renumbers later ones."""
    return T.sha1(
        F.concat_ws("|", file_path, F.array_join(heading_path, ">"), ordinal.cast("string"))
    )


def line_columns() -> dict[str, Column]:
    """What ``plan_note`` takes of a parsed note, as columns."""
    lines = F.col("lines")
    is_heading = F.filter(lines, lambda line: line.rlike(rf"\A#{{1,6}}[{S}]+{_DOT}*\z"))
    return {
        "kinds": F.when(F.col("front.error").isNull(), F.array_join(F.transform(lines, line_kind), "")),
        "costs": F.transform(F.split(T.plain_spaces(F.col("body")), "\n", -1), T.count_words),
        "headings": F.transform(is_heading, heading_text),
        "title": T.trim(F.col("front.title")),
        "fallback": T.drop_md(T.base_name(F.col("file_path"))),
    }


def with_ids(chunks: DataFrame, config: Chunking) -> DataFrame:
    """Rows of the chunk table from cut chunks: ids, links, embedded text and hashes."""
    full = chunks.withColumns(
        {
            "chunk_id": chunk_id(F.col("file_path"), F.col("heading_path"), F.col("ordinal")),
            "links": T.wiki_links(F.col("content")),
            "representation": representation(
                F.col("content"), F.col("heading_path"), F.col("note_title"), F.col("tags"),
                config.metadata_prefix_strategy,
            ),
            "content_hash": T.sha1(F.col("content")),
        }
    )
    return full.select(*(F.col(c).cast(t).alias(c) for c, t in CHUNK_COLUMNS.items()))


def chunk_notes(notes: DataFrame, config: Chunking | None = None) -> DataFrame:
    """Chunks of ``notes(file_path, mtime, markdown)``; notes with invalid YAML yield none."""
    config = config or Chunking()
    lines = F.col("lines")
    parsed = parse_notes(notes).withColumn("plan", _plan_udf(config)(*line_columns().values()))
    built = F.transform(
        F.col("plan.chunks"),
        lambda chunk: F.struct(
            chunk["heading_path"].alias("heading_path"),
            T.trim(
                F.array_join(
                    F.transform(
                        chunk["parts"],
                        lambda part: _part_text(lines, part, config.overlap_tokens),
                    ),
                    "\n\n",
                )
            ).alias("content"),
            chunk["tokens"].alias("tokens"),
            chunk["chunk_type"].alias("chunk_type"),
        ),
    )
    # Everything is computed before the explode, so that lines and plans are not copied per chunk;
    # the outer form keeps Catalyst from inferring a filter that would plan every note twice.
    whole = parsed.select(
        "file_path",
        F.col("mtime").cast("long").alias("mtime"),
        F.col("plan.title").alias("note_title"),
        note_tags(F.col("front.tag_list"), F.col("front.tag_text")).alias("tags"),
        F.col("front.json").alias("frontmatter"),
        built.alias("built"),
    )
    exploded = whole.select(
        "file_path", "mtime", "note_title", "tags", "frontmatter",
        F.posexplode_outer("built").alias("_at", "c"),
    ).where(F.col("_at").isNotNull()).select("*", "c.*", (F.col("_at") + 1).alias("ordinal"))
    return with_ids(exploded, config)
