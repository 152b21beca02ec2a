"""Frontmatter: the fence is split by the JVM; only the YAML text itself goes to Python."""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from .steps import in_steps
from .text import SPACE, SPACE_NO_NEWLINE, trim, trim_end

_W = f"[{SPACE_NO_NEWLINE}]*"
# Both fences and what is between them; the body is what follows the match.
FENCE_PATTERN = rf"\A{_W}---{_W}\n(?:((?s:.*?))\n)??{_W}---{_W}(?:\n|\z)"

FACETS = (
    "struct<json:string,title:string,summary:string,tag_list:array<string>,"
    "tag_text:string,tag_strings:array<string>,error:string>"
)
_TEXTS = pa.list_(pa.string())
_FACETS = pa.struct(
    {
        "json": pa.string(), "title": pa.string(), "summary": pa.string(), "tag_list": _TEXTS,
        "tag_text": pa.string(), "tag_strings": _TEXTS, "error": pa.string(),
    }
)


def has_fence(text: Column) -> Column:
    return text.rlike(FENCE_PATTERN)


def fence_source(text: Column) -> Column:
    """YAML text between the fences with ``- #tag`` items quoted; null without frontmatter."""
    source = F.regexp_extract(text, FENCE_PATTERN, 1)
    quoted = F.regexp_replace(
        source, rf"(?<=\n|\A)({_W})- #{_W}([^\n]*?){_W}(?<!\r)(?=\n|\z)", '$1- "#$2"'
    )
    return F.when(has_fence(text), trim(quoted))


def fence_body(text: Column) -> Column:
    """What follows the frontmatter; the whole text without one."""
    fence = F.regexp_extract(text, FENCE_PATTERN, 0)
    return F.substr(text, F.length(fence) + 1)


class _CoreLoader(yaml.SafeLoader):
    """YAML 1.2 core schema: no dates, no sexagesimals, only true/false as booleans."""


_CoreLoader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    (
        "float",
        r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?"
        r"|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$",
        list("-+.0123456789"),
    ),
):
    _CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)


def _construct_int(loader: yaml.SafeLoader, node: yaml.ScalarNode) -> int:
    text = loader.construct_scalar(node)
    return int(text, 0) if text[:2] in ("0o", "0x") else int(text)


_CoreLoader.add_constructor("tag:yaml.org,2002:int", _construct_int)


def _construct_mapping(loader: yaml.SafeLoader, node: yaml.MappingNode, deep: bool = False) -> dict:
    """Repeated keys are refused, as the core schema asks."""
    seen = set()
    for key_node, _ in node.value:
        key = (key_node.tag, getattr(key_node, "value", None) if isinstance(key_node, yaml.ScalarNode) else id(key_node))
        if key in seen and key_node.tag != "tag:yaml.org,2002:merge":
            raise yaml.constructor.ConstructorError(None, None, "a key is repeated", key_node.start_mark)
        seen.add(key)
    return yaml.SafeLoader.construct_mapping(loader, node, deep)


_CoreLoader.construct_mapping = _construct_mapping


def _plain(value: object, depth: int = 0) -> object:
    """The value as JSON can hold it: no infinities, no loops."""
    if depth > 200:
        raise ValueError("the frontmatter holds itself")
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {key if isinstance(key, str) else _as_text(key): _plain(x, depth + 1) for key, x in value.items()}
    if isinstance(value, list):
        return [_plain(x, depth + 1) for x in value]
    return value


def _as_text(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, list):
        return ",".join("" if item is None else _as_text(item) for item in value)
    return "[object Object]" if isinstance(value, dict) else str(value)


def _facets(source: str | None) -> dict:
    row = dict.fromkeys(
        ("json", "title", "summary", "tag_list", "tag_text", "tag_strings", "error")
    )
    row["json"] = "{}"
    if not source:
        return row
    try:
        data = yaml.load(source, Loader=_CoreLoader)  # noqa: S506 - a SafeLoader subclass
        text = json.dumps(_plain({} if data is None else data), ensure_ascii=False, default=str)
        text.encode("utf-8")  # an escaped half of a surrogate pair cannot leave Python
    except Exception as error:  # noqa: BLE001 - one odd note must not end the others
        row["error"] = (str(error).splitlines() or [""])[0] or type(error).__name__
        return row
    row["json"] = text
    if isinstance(data, dict):
        for key in ("title", "summary"):
            if isinstance(data.get(key), str):
                row[key] = data[key]
        tags = data.get("tags")
        if isinstance(tags, list):
            row["tag_list"] = [_as_text(tag) for tag in tags]
            row["tag_strings"] = [tag for tag in tags if isinstance(tag, str)]
        elif isinstance(tags, str):
            row["tag_text"] = tags
    return row


@lru_cache(maxsize=1)
def _facets_udf():
    @F.arrow_udf(FACETS)
    def read_yaml(source: pa.Array) -> pa.Array:
        return in_steps(lambda texts: pa.array([_facets(text) for text in texts.to_pylist()], _FACETS), [source], _FACETS)

    return read_yaml


def yaml_facets(source: Column) -> Column:
    """Parsed frontmatter as JSON plus the typed fields the engine reads.

    Invalid YAML gives an ``error`` text instead of failing the job, so one bad note is
    reported and the others go on.
    """
    return _facets_udf()(source)


class _NoteDumper(yaml.SafeDumper):
    def increase_indent(self, flow: bool = False, indentless: bool = False):
        return super().increase_indent(flow, False)

    def choose_scalar_style(self):
        style = super().choose_scalar_style()
        return '"' if style == "'" else style


_NoteDumper.yaml_implicit_resolvers = _CoreLoader.yaml_implicit_resolvers


@lru_cache(maxsize=1)
def _yaml_text_udf():
    @F.pandas_udf("string")
    def write_yaml(data: pd.Series) -> pd.Series:
        def dump(text: str | None) -> str | None:
            fields = json.loads(text) if text else {}
            if not fields:
                return ""
            return yaml.dump(fields, Dumper=_NoteDumper, sort_keys=False, allow_unicode=True)

        return data.map(dump)

    return write_yaml


def with_frontmatter_text(data_json: Column, body: Column) -> Column:
    """A note made of a JSON object as YAML frontmatter and a body."""
    section = trim_end(_yaml_text_udf()(data_json))
    section = F.when(section == "", F.lit("")).otherwise(F.concat(section, F.lit("\n")))
    bare = F.regexp_replace(body, r"\A\n+", "")
    return F.concat(F.lit("---\n"), section, F.lit("---\n"), bare)


def string_field_json(*pairs: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*(value.alias(name) for name, value in pairs)))


def ensure_frontmatter(content: Column, title: Column, created: Column) -> Column:
    """Add ``title`` and ``created`` frontmatter where a note has none."""
    data = string_field_json(("title", title), ("created", created))
    return F.when(has_fence(content), trim_end(content)).otherwise(
        with_frontmatter_text(data, trim_end(content))
    )
