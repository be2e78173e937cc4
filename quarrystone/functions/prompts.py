"""Prompts as projections: templates over columns, and blocks read back from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, extract_code_block, strip


def fill(template: str, **columns: Column | str) -> Column:
    """The template with each {name} replaced by its column; {{ and }} are braces; a null column is empty."""
    pieces = []
    for part in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if part in ("{{", "}}"):
            pieces.append(F.lit(part[0]))
        elif re.fullmatch(r"\{\w+\}", part):
            pieces.append(F.coalesce(col(columns[part[1:-1]]).cast("string"), F.lit("")))
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def section(title: str, body: Column | str) -> Column:
    """A titled section, or nothing if the body is null or blank."""
    return F.when(F.length(strip(col(body))) > 0, F.concat(F.lit(f"### {title}\n"), col(body), F.lit("\n"))).otherwise("")


def block_after(text: Column | str, label: str) -> Column:
    """The fenced block that follows a label; null without one."""
    found = F.regexp_extract(col(text), rf"(?s)\Q{label}\E[^`]*```[^\n]*\n(.*?)```", 1)
    return F.nullif(found, F.lit(""))


def explanation_and_code(text: Column | str) -> Column:
    """struct(explanation, code): what stands before the first fence, and the code block of an answer."""
    before = F.regexp_extract(col(text), r"(?s)^(.*?)(?:```|\z)", 1)
    return F.struct(strip(before).alias("explanation"), extract_code_block(text).alias("code"))


def literal_json(text: Column | str) -> Column:
    """A Python literal of names, numbers, booleans and plain strings as JSON text."""
    out = F.replace(col(text), F.lit("'"), F.lit('"'))
    for word, by in (("True", "true"), ("False", "false"), ("None", "null")):
        out = F.regexp_replace(out, rf"\b{word}\b", by)
    return out
