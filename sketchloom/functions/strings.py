"""String functions: globs, chunks, maps, templates and cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadPattern(ValueError):
    """A glob that no string can be matched against."""


def _quoted(char: str) -> str:
    return f"\\x{{{ord(char):x}}}" if not char.isalnum() or ord(char) > 127 else char


def _class(pattern: str, at: int) -> tuple[str, int]:
    """The regex of the character class whose ``[`` is before ``at``, and the place after it."""
    end = len(pattern)
    negated = at < end and pattern[at] in "!^"
    at += negated
    out: list[str] = []

    def one(at: int) -> tuple[str, int]:
        if at < end and pattern[at] == "\\":
            at += 1
        if at >= end:
            raise BadPattern(pattern)
        return pattern[at], at + 1

    while at < end:
        if pattern[at] == "]" and out:
            return f"[{'^' * negated}{''.join(out)}]", at + 1
        low, at = one(at)
        if at + 1 < end and pattern[at] == "-" and pattern[at + 1] != "]":
            high, at = one(at + 1)
            if low > high:
                raise BadPattern(pattern)
            out.append(f"{_quoted(low)}-{_quoted(high)}")
        else:
            out.append(_quoted(low))
    raise BadPattern(pattern)


def glob_regex(pattern: str, separators: str | None = None) -> str:
    """A Java regex for a glob.  With ``separators``, ``*`` and ``?`` stop at them and ``**`` does not.

    A bad pattern raises here, whatever the strings are.
    """
    out, at = [], 0
    inside = "".join(map(_quoted, separators or ""))
    single = f"[^{inside}]" if separators else "."
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            stars = 1
            while at < len(pattern) and pattern[at] == "*":
                stars, at = stars + 1, at + 1
            out.append(".*" if stars > 1 or not separators else f"{single}*")
        elif c == "?":
            out.append(single)
        elif c == "[":
            part, at = _class(pattern, at)
            out.append(part)
        elif c == "\\":
            if at >= len(pattern):
                raise BadPattern(pattern)
            out.append(_quoted(pattern[at]))
            at += 1
        else:
            out.append(_quoted(c))
    return f"(?s)\\A{''.join(out)}\\z"


def glob_match(value: Column, pattern: str) -> Column:
    """Whether a string matches a glob; ``*`` crosses everything, also ``/``.

    A glob that is a plain prefix becomes ``startswith``, which a Parquet scan can use.
    """
    if plain := re.fullmatch(r"([^*?\[\\]*)\*+", pattern):
        return value.startswith(plain[1])
    return value.rlike(glob_regex(pattern))


def glob_match_segments(value: Column, pattern: str, separators: str = "/") -> Column:
    """Whether a string matches a glob by segments; ``**`` crosses separators, ``*`` and ``?`` don't."""
    return value.rlike(glob_regex(pattern, separators or "/"))


def chunks(values: Column, size: int) -> Column:
    """An array cut into arrays of at most ``size``."""
    if size < 1:
        raise ValueError("size must be positive")
    count = F.ceil(F.size(values) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * size + 1, F.lit(size)))
    return F.when(F.size(values) == 0, F.slice(F.array(values), 1, 0)).otherwise(parts)


def sort_map(values: Column) -> Column:
    """A map with its entries in the order of their keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(values)))


def replace_map(text: Column, values: dict[str, str]) -> Column:
    """Every key replaced by its value, keys in order: later ones also see what earlier ones put in."""
    for key in sorted(values):
        text = F.replace(text, F.lit(key), F.lit(values[key]))
    return text


def replace_map_column(text: Column, values: Column) -> Column:
    """``replace_map`` with a map column."""
    return F.aggregate(F.array_sort(F.map_entries(values)), text, lambda t, e: F.replace(t, e["key"], e["value"]))


_TAG = r"\{\{\s*(\w+)\s*\}\}"


def simple_template(template: Column, values: Column) -> Column:
    """``{{ key }}`` replaced by the map's value; unknown keys stay, and values are not expanded again."""
    text = F.split(template, _TAG, -1)
    tags = F.regexp_extract_all(template, F.lit(_TAG), 0)
    keys = F.regexp_extract_all(template, F.lit(_TAG), 1)
    filled = F.zip_with(tags, keys, lambda t, k: F.coalesce(F.try_element_at(values, k), t))
    return F.array_join(F.zip_with(text, filled, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def slice_contains(values: Column, key) -> Column:
    return F.array_contains(values, key)


def string_clean(value: Column) -> Column:
    """Without the non-graphic characters at both ends; those inside stay."""
    dull = r"[\p{C}\p{Zl}\p{Zp}]+"
    return F.regexp_replace(value, rf"\A{dull}|{dull}\z", "")


def camel_to_snake(value: Column) -> Column:
    """``maxItems`` and ``HTTPPort`` to ``max_items`` and ``http_port``."""
    split = F.regexp_replace(value, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(split, r"([A-Z]+)([A-Z][a-z])", "$1_$2"))
