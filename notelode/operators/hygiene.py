"""Note-quality checks, one row per issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import text as T

S = T.SPACE
HEADING_LINE = rf"(?:\A|(?<=[{T.LINE_END}]))#{{1,6}}[{S}]+"
SECTION_START = rf"\n(?=#{{1,6}}[{S}])"
TIGHT_HEADING = rf"#{{1,6}}[^{T.LINE_END}]*\n[^\n#]"
SUMMARY_HEADING = rf"(?i)#{{1,3}}[{S}]+Summary"

# Issue details.
DETAILS = {
    "missing_frontmatter": "Add YAML frontmatter for consistent metadata.",
    "no_headings": "Add headings to improve chunk structure.",
    "long_section": "Section exceeds {limit} tokens.",
    "separator": "Add blank lines after headings for consistent parsing.",
    "missing_summary": "Add a summary heading or frontmatter summary.",
}


def _conditions(text: Column, body: Column, summary: Column, limit: int) -> dict[str, Column]:
    sections = F.split(body, SECTION_START, -1)
    has_summary = body.rlike(SUMMARY_HEADING) | (F.coalesce(T.trim(summary), F.lit("")) != "")
    return {
        "missing_frontmatter": ~fm.has_fence(text),
        "no_headings": ~body.rlike(HEADING_LINE),
        "long_section": F.exists(sections, lambda section: T.count_pieces(section) > limit),
        "separator": body.rlike(TIGHT_HEADING),
        "missing_summary": ~has_summary,
    }


def note_issues(notes: DataFrame, max_tokens: int = 900) -> DataFrame:
    """``path, type, detail, seq`` in check order per note; generated blocks are not removed.

    Invalid YAML ends a run in the engine's contract; here the note reports no issues that need
    the parsed fields and the job goes on.
    """
    limit = max_tokens * 3
    parsed = notes.withColumn(
        "front", fm.yaml_facets(fm.fence_source(F.col("markdown")))
    ).withColumn("body", fm.fence_body(F.col("markdown")))
    checks = _conditions(F.col("markdown"), F.col("body"), F.col("front.summary"), limit)
    found = F.array(
        *(
            F.when(
                condition,
                F.struct(
                    F.lit(name).alias("type"),
                    F.lit(DETAILS[name].format(limit=limit)).alias("detail"),
                    F.lit(seq).alias("seq"),
                ),
            )
            for seq, (name, condition) in enumerate(checks.items(), start=1)
        )
    )
    issues = F.explode(F.filter(found, lambda issue: issue.isNotNull()))
    return parsed.select(F.col("file_path").alias("path"), issues.alias("i")).select("path", "i.*")
