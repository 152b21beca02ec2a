"""Whitespace, token counts, lengths, slices and hashes.

The engine's contract is defined over Unicode white space and UTF-16 lengths, while Java's
``\\s`` and Spark's ``trim``/``length`` are not, so the differences are bridged here once.
"""

from __future__ import annotations

import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACE_CODES = (
    *(0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680),
    *range(0x2000, 0x200B),
    *(0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF),
)
SPACE_CHARS = "".join(map(chr, SPACE_CODES))
# The same as the inside of a Java regex class.
SPACE = "".join(rf"\x{{{code:X}}}" for code in SPACE_CODES)
SPACE_NO_NEWLINE = "".join(rf"\x{{{code:X}}}" for code in SPACE_CODES if code != 0x0A)
# The characters that end a line for ``.`` and multi-line ``^``.
LINE_END = r"\n\r\u2028\u2029"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"

_RARE = "".join(ch for ch in SPACE_CHARS if ord(ch) > 0x7F)
_ASCII_SPACE = r"[ \t\n\x0B\f\r]"
_ASCII_WORD = r"[^ \t\n\x0B\f\r]+"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return trim(text) == ""


def plain_spaces(text: Column) -> Column:
    """Non-ASCII white space as plain spaces.

    Regex classes over ASCII alone are many times faster in Java, and most texts pass the check
    without being touched.
    """
    replaced = F.translate(text, _RARE, " " * len(_RARE))
    return F.when(text.rlike(f"[{_RARE}]"), replaced).otherwise(text)


def words(text: Column) -> Column:
    """Non-empty white-space separated pieces, in order."""
    return F.regexp_extract_all(plain_spaces(text), F.lit(_ASCII_WORD), F.lit(0))


def count_words(plain: Column) -> Column:
    """Token count of a text that went through ``plain_spaces``."""
    return F.regexp_count(plain, F.lit(_ASCII_WORD))


def count_tokens(text: Column) -> Column:
    """Pieces of visible text; blank text counts 0."""
    return count_words(plain_spaces(text))


def count_pieces(text: Column) -> Column:
    """Split size including empty edge pieces, never below 1."""
    return F.size(F.split(plain_spaces(text), f"{_ASCII_SPACE}+", -1))


def count_pieces_or_zero(text: Column) -> Column:
    return F.when(is_blank(text), F.lit(0)).otherwise(count_pieces(text))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)).cast("int")


def utf16_prefix(text: Column, units: int) -> Column:
    """First ``units`` UTF-16 units; a surrogate pair cut in half is dropped."""

    def width(ch: Column) -> Column:
        return F.when(ch.rlike(ASTRAL), F.lit(2)).otherwise(F.lit(1))

    def step(acc: Column, ch: Column) -> Column:
        used = acc["used"] + width(ch)
        text_ = F.when(used <= units, F.concat(acc["text"], ch)).otherwise(acc["text"])
        return F.struct(text_.alias("text"), used.alias("used"))

    head = F.substring(text, 1, units)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))
    folded = F.aggregate(F.split(head, ""), start, step, lambda acc: acc["text"])
    return F.when(head.rlike(ASTRAL), folded).otherwise(head)


def truncate(text: Column, limit: int) -> Column:
    """Cut to ``limit`` units, drop trailing space and mark the cut."""
    cut = F.concat(trim_end(utf16_prefix(text, limit)), F.lit("\n..."))
    return F.when(utf16_length(text) <= limit, text).otherwise(cut)


def last_tokens(text: Column, count: int) -> Column:
    """The last ``count`` tokens joined by one space; null when there are no more than that."""
    pieces = words(text)
    tail = F.array_join(F.slice(pieces, -count, count), " ")
    if count <= 0:
        return F.lit(None).cast("string")
    return F.when(F.size(pieces) > count, tail)


def sha1(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def posix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def dir_name(path: Column) -> Column:
    """Directory part, ``.`` for a bare file name."""
    parent = F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)
    return F.when(path.contains("/"), parent).otherwise(F.lit("."))


def drop_md(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md\z", "")


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    cut = F.substr(path, F.lit(len(prefix) + 1))
    return posix_path(F.when(path.startswith(prefix), cut).otherwise(path))


def wiki_link(path: Column) -> Column:
    return F.concat(F.lit("[["), drop_md(path), F.lit("]]"))


def iso_millis(epoch_ms: Column) -> Column:
    """Epoch milliseconds as ``YYYY-MM-DDTHH:MM:SS.mmmZ``, whatever the session time zone."""
    ms = F.floor(epoch_ms).cast("long")
    days = F.floor(ms / F.lit(86_400_000)).cast("int")
    rest = F.pmod(ms, F.lit(86_400_000))
    return F.concat(
        F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd"),
        F.format_string(
            "T%02d:%02d:%02d.%03dZ",
            F.floor(rest / 3_600_000).cast("int"),
            F.pmod(F.floor(rest / 60_000), F.lit(60)).cast("int"),
            F.pmod(F.floor(rest / 1000), F.lit(60)).cast("int"),
            F.pmod(rest, F.lit(1000)).cast("int"),
        ),
    )


def created_at(birth_ms: Column, mtime_ms: Column) -> Column:
    """Birth time when finite and positive, else modification time, as ISO text."""
    known = birth_ms.isNotNull() & ~F.isnan(birth_ms.cast("double")) & (birth_ms > 0)
    return iso_millis(F.when(known, birth_ms).otherwise(mtime_ms))


def fixed(value: Column, digits: int) -> Column:
    """Decimal text rounded by the exact binary value, halves away from zero.

    Java's formatter rounds the shortest decimal form instead, which differs near halves.
    """
    step = Decimal(1).scaleb(-digits)

    @F.pandas_udf("string")
    def to_fixed(values: pd.Series) -> pd.Series:
        return values.map(
            lambda x: None if pd.isna(x) else str(Decimal(x).quantize(step, ROUND_HALF_UP))
        )

    return to_fixed(value.cast("double"))


def duration_label(ms: Column) -> Column:
    """``12ms``, ``1.50s`` or ``2m3.0s``."""
    minutes = F.floor(ms / 60_000)
    rest = ms / 1000 - minutes * 60
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(fixed(ms / 1000, 2), F.lit("s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m"), fixed(rest, 1), F.lit("s")))
    )


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Accent folding as one ``translate`` table, derived from the Unicode database.

    Letters that decompose to one base letter plus marks map to the base; marks themselves sit
    past the end of the target string, which is how ``translate`` deletes characters.
    """
    source, target, marks = [], [], []
    for code in range(0x80, 0x110000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        base = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != ch:
            source.append(ch)
            target.append(base[0])
    return "".join(source + marks), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents. Plain ASCII text skips the translation."""
    source, target = _fold_table()
    lowered = F.lower(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(lowered, source, target)).otherwise(
        lowered
    )


def index_tokens(text: Column) -> Column:
    """Tokens of the lexical index: folded runs of letters and digits, in order."""
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    other = F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))
    return F.when(text.rlike(r"[^\x00-\x7F]"), other).otherwise(plain)


def query_tokens(question: Column) -> Column:
    """Words of a question: ASCII letters, digits and underscores only."""
    return F.regexp_extract_all(question, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def wiki_links(text: Column) -> Column:
    """Distinct ``[[target]]`` / ``[[target|alias]]`` targets in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|#]+)(?:\|[^\[\]]+)?\]\]"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, trim)), lambda link: link != "")


def bullet_lines(response: Column) -> Column:
    """Non-empty lines with one leading ``*`` or ``-`` bullet removed."""
    lines = F.split(response, "\n", -1)
    bare = F.transform(lines, lambda l: trim(F.regexp_replace(l, rf"\A[*-][{SPACE}]*", "")))
    return F.filter(bare, lambda l: l != "")


def strict_json_array(text: Column) -> Column:
    """Elements of a JSON array as strings; null for anything else, trailing junk included.

    Spark's JSON parser stops at the end of the first value, so the text is parsed inside an
    outer array that must end in a marker.
    """
    marker = "--end--"
    outer = F.concat(F.lit("["), text, F.lit(f',"{marker}"]'))
    parsed = F.try_parse_json(outer).try_cast("array<variant>")
    whole = (F.size(parsed) == 2) & (parsed[1].try_cast("string") == marker)
    items = parsed[0].try_cast("array<string>")
    return F.when(whole, F.transform(items, lambda x: F.coalesce(x, F.lit("null"))))


def json_array_or_lines(response: Column) -> Column:
    """A JSON array of strings, or else the non-empty trimmed lines."""
    lines = F.transform(F.split(response, "\n", -1), trim)
    return F.coalesce(
        strict_json_array(trim(response)), F.filter(lines, lambda line: line != "")
    )


def json_ids(response: Column) -> Column:
    """A JSON array of ids, or else an empty array."""
    return F.coalesce(strict_json_array(trim(response)), F.array().cast("array<string>"))
