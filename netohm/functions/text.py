"""Text functions of the netlist and data file formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def trim_blanks(x: Column) -> Column:
    return F.trim(x, F.lit(" \t\r\n"))


def strip_quotes(x: Column) -> Column:
    return F.when(x.rlike(r'(?s)^".*"$') & (F.length(x) >= 2), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)


def strip_comment(x: Column) -> Column:
    return F.regexp_replace(x, r"//.*$", "")


def split_tokens(x: Column, most: int) -> Column:
    """Tokens between blanks; those past `most` are dropped."""
    t = F.trim(x, F.lit(" \t\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(t, r"[ \t]+"), 1, most))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\([\[\]])", "$1")


def pin_base(x: Column) -> Column:
    return F.substring_index(x, ":", 1)


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def parse_data_number(x: Column) -> Column:
    """The number at the front; null where there is none."""
    return F.nullif(F.regexp_extract(x, NUMBER, 0), F.lit("")).try_cast("double")


def parse_number(x: Column) -> Column:
    """The number at the front, or that of the characters numbers are made of, or 0."""
    cleaned = F.when(F.length(x) < 64, F.regexp_replace(x, r"[^-+.eE0-9]", "")).otherwise(F.lit(""))
    return F.coalesce(parse_data_number(x), parse_data_number(cleaned), F.lit(0.0))


def format_number(v: Column) -> Column:
    return (
        F.when(v == 0, F.lit("0"))
        .when(F.abs(v) < 1e-4, F.format_string("%.6e", v))
        .otherwise(F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", ""))
    )


def ratio(a: Column, b: Column) -> Column:
    """b / a as text; inf where a is 0."""
    return F.when(a == 0, F.lit("inf")).otherwise(F.try_divide(b, a).cast("string"))


def hover_number(v: Column) -> Column:
    """A short form for details of a point: more digits for small numbers, four significant ones from 1000 on."""
    a = F.abs(v)
    large = F.when(a < 9999.5, F.format_string("%.0f", v)).otherwise(F.regexp_replace(F.format_string("%.3e", v), r"\.?0+e", "e"))
    return F.when(v == 0, F.lit("0")).when(a < 1e-3, F.format_string("%.4e", v)).when(a < 1, F.format_string("%.6f", v)).when(a < 1000, F.format_string("%.4f", v)).otherwise(large)


def stat_number(v: Column) -> Column:
    """A short form for statistics."""
    return F.when(v == 0, F.lit("0")).when(F.abs(v) >= 1e-3, F.format_string("%.4f", v)).otherwise(F.format_string("%.4e", v))


def pin_role(kind: Column, direction: Column) -> Column:
    """driver or sink by pin kind (*I instance, *P port) and direction letter; null for others."""
    driver = (direction == "B") | ((kind == "*I") & (direction == "O")) | ((kind == "*P") & (direction == "I"))
    sink = ((kind == "*I") & (direction == "I")) | ((kind == "*P") & (direction == "O"))
    return F.when(driver, F.lit("driver")).when(sink, F.lit("sink"))
