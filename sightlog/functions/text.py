"""Column functions on recognised text, identifiers and model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightlog import vocab


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.btrim(text, F.lit(" \t\n\r\f\v"))


def first_int(text: Column) -> Column:
    """First run of digits; NULL for '', 'info', text without digits and a number past the type."""
    digits = F.regexp_extract(text, r"(\d+)", 1)
    return F.when((text != "info") & (digits != ""), digits.try_cast("bigint"))


def _first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = None
    for key, name in rules:
        cond, value = text.contains(key), F.lit(vocab.CLASSES.index(name))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def button_class(text: Column) -> Column:
    """Class id of the first rule whose key occurs in the text (case-sensitive)."""
    return _first_rule(text, vocab.BUTTON_TEXT)


def any_button_class(text: Column) -> Column:
    """Base rules first, then the donation rules."""
    return F.coalesce(button_class(text), _first_rule(text, vocab.EXTRA_BUTTON_TEXT))


def clean_cell(text: Column) -> Column:
    """Tags out, white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\s+", " "))


def front_matter(text: Column) -> Column:
    """Key/value map of the leading ``---`` block; outer double quotes are removed."""
    body = F.regexp_extract(F.regexp_replace(text, "^﻿+", ""), r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_]\w*:"))

    def entry(line):
        value = strip(F.regexp_extract(line, r"^[A-Za-z_]\w*:\s*(.*)$", 1))
        return F.struct(F.substring_index(line, ":", 1).alias("key"), F.regexp_replace(value, r'(?s)\A"(.*)"\z', "$1").alias("value"))

    def last(pairs):
        # a repeated key keeps its last value
        return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])))

    # the block is read once: the pairs are a variable, where a column would be made again for each of them
    return F.get(F.transform(F.array(F.transform(lines, entry)), last), F.lit(0))


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def link_id(link: Column) -> Column:
    return F.substring_index(link, "-", 1)


def fenced_json(text: Column) -> Column:
    """The JSON text inside model output: the fenced block if any, and if that does not
    parse, the part from the first ``{`` to the last ``}``. NULL when neither parses."""
    trimmed = strip(text)
    fence = F.regexp_extract(trimmed, r"```(?:json)?\s*([\s\S]*?)```", 1)
    inner = F.when(trimmed.rlike(r"```(?:json)?\s*[\s\S]*?```"), strip(fence)).otherwise(trimmed)
    span = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    return F.when(is_json(inner), inner).when((span != "") & is_json(span), span)


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def safe_name(text: Column) -> Column:
    """Everything but letters and digits becomes '_'."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def severity_rank(severity: Column) -> Column:
    return vocab.lookup(severity, {s: i for i, s in enumerate(vocab.SEVERITIES)}, -1)


def number_pair(raw: Column) -> Column:
    """Point from '[x, y]', 'x, y' or four corner numbers (their centre), rounded half to even."""
    nums = F.transform(
        F.regexp_extract_all(raw, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double")
    )

    def point(n):
        at = lambda i: F.get(n, F.lit(i))
        pair = lambda x, y: F.struct(
            F.rint(x).cast("bigint").alias("x"), F.rint(y).cast("bigint").alias("y")
        )
        return F.when(F.size(n) >= 4, pair((at(0) + at(2)) / 2, (at(1) + at(3)) / 2)).when(F.size(n) >= 2, pair(at(0), at(1)))

    # the lambda binds the numbers, so that the text is searched once
    return F.get(F.transform(F.array(nums), point), F.lit(0))
