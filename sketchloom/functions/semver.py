"""Semantic versions: parsing, precedence and constraints as Catalyst columns.

A constraint is compiled on the driver to one Boolean column over the precedence key, so a
filter by version stays inside generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = r"[0-9A-Za-z-]+"
_PRE = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
_VERSION = rf"\Av?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-({_PRE}(?:\.{_PRE})*))?(?:\+({_ID}(?:\.{_ID})*))?\z"
_LIMIT = 2**64


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; keeps generated code small."""
    return F.transform(F.array(value), body)[0]


def parse(text: Column) -> Column:
    """Struct (major, minor, patch, prerelease, build), or null where the text is no version."""
    groups = F.array(*(F.regexp_extract(text, _VERSION, k) for k in range(1, 6)))

    def whole(p: Column) -> Column:
        digits = F.transform(F.slice(p, 1, 3), lambda x: F.regexp_replace(F.when(x == "", "0").otherwise(x), "^0+(?=.)", ""))
        fits = lambda d: F.when(F.length(d) <= 20, d).cast("decimal(38,0)")
        numbers = F.transform(digits, lambda d: F.when(fits(d) < F.lit(str(_LIMIT)).cast("decimal(38,0)"), fits(d)).cast("decimal(20,0)"))
        fields = lambda n: F.struct(n[0].alias("major"), n[1].alias("minor"), n[2].alias("patch"), F.nullif(p[3], F.lit("")).alias("prerelease"), F.nullif(p[4], F.lit("")).alias("build"))
        return F.when(p[0] != "", _once(numbers, lambda n: F.when(F.forall(n, lambda x: x.isNotNull()), fields(n))))

    return _once(groups, whole)


def is_valid(text: Column) -> Column:
    return F.coalesce(parse(text).isNotNull(), F.lit(False))


def to_text(v: Column) -> Column:
    return _once(v, _text)


def _text(v: Column) -> Column:
    core = F.concat_ws(".", v["major"], v["minor"], v["patch"])
    pre = F.when(v["prerelease"].isNotNull(), F.concat(F.lit("-"), v["prerelease"])).otherwise("")
    build = F.when(v["build"].isNotNull(), F.concat(F.lit("+"), v["build"])).otherwise("")
    return F.when(v.isNotNull(), F.concat(core, pre, build))


def key(v: Column) -> Column:
    """Orders by precedence: a prerelease comes before its release, numbers before names, builds don't count."""
    return _once(v, _key)


def _key(v: Column) -> Column:
    def one(x: Column) -> Column:
        is_number = x.rlike(r"\A[0-9]+\z")
        number = F.when(is_number & (F.length(x) <= 20), x).cast("decimal(20,0)")
        return F.struct((~is_number).alias("name"), F.when(is_number, F.coalesce(number, F.lit("99999999999999999999").cast("decimal(20,0)"))).alias("n"), F.when(is_number, "").otherwise(x).alias("t"))

    ids = F.transform(F.split(F.coalesce(v["prerelease"], F.lit("")), r"\."), one)
    return F.when(v.isNotNull(), F.struct(v["major"].alias("a"), v["minor"].alias("b"), v["patch"].alias("c"), v["prerelease"].isNull().alias("d"), ids.alias("e")))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two parsed versions."""
    pair = F.struct(key(a).alias("x"), key(b).alias("y"))
    return _once(pair, lambda p: F.when(p["x"] < p["y"], -1).when(p["x"] > p["y"], 1).when(p["x"] == p["y"], 0))


def increment(v: Column, part: str) -> Column:
    """The next major, minor or patch version; lower parts, prerelease and build are reset."""
    return _once(v, lambda x: _incremented(x, part))


def _incremented(v: Column, part: str) -> Column:
    k = ("major", "minor", "patch").index(part)
    zero = F.lit(0).cast("decimal(20,0)")
    fields = [(v[n] if j < k else (v[n] + 1).cast("decimal(20,0)") if j == k else zero).alias(n) for j, n in enumerate(("major", "minor", "patch"))]
    return F.when(v.isNotNull(), F.struct(*fields, F.lit(None).cast("string").alias("prerelease"), F.lit(None).cast("string").alias("build")))


def diff(a: Column, b: Column) -> Column:
    """The first part in which two versions differ: major, minor, patch, prerelease, or ''."""
    return _once(F.struct(a.alias("a"), b.alias("b")), lambda p: _difference(p["a"], p["b"]))


def _difference(a: Column, b: Column) -> Column:
    out = F.when(a["major"] != b["major"], "major").when(a["minor"] != b["minor"], "minor").when(a["patch"] != b["patch"], "patch")
    return out.when(~a["prerelease"].eqNullSafe(b["prerelease"]), "prerelease").otherwise("")


class BadConstraint(ValueError):
    pass


@dataclass(frozen=True)
class _Wanted:
    """A version in a constraint, which may be partial."""

    numbers: tuple[int, int, int]
    prerelease: str | None
    parts: int
    wildcard: bool


def _wanted(text: str) -> _Wanted:
    m = re.fullmatch(rf"v?((?:[0-9]+|[*xX])(?:\.(?:[0-9]+|[*xX])){{0,2}})(?:-({_PRE}(?:\.{_PRE})*))?(?:\+{_ID}(?:\.{_ID})*)?", text)
    if not m:
        raise BadConstraint(text)
    parts = m[1].split(".")
    stars = [p in "*xX" for p in parts]
    if stars != sorted(stars) or any(not s and int(p) >= _LIMIT for p, s in zip(parts, stars, strict=True)):
        raise BadConstraint(text)
    numbers = [0 if s else int(p) for p, s in zip(parts, stars, strict=True)]
    return _Wanted((*numbers, 0, 0)[:3], m[2], len(parts), any(stars))


Term = tuple[str, tuple[int, int, int], str | None]


def _next(v: _Wanted, k: int) -> Term:
    """Below the next version at place ``k``."""
    return "<", tuple(n if j < k else n + 1 if j == k else 0 for j, n in enumerate(v.numbers)), None


def _term(text: str) -> list[Term]:
    low, hyphen, high = text.partition(" - ")
    if hyphen:
        a, b = _wanted(low.strip()), _wanted(high.strip())
        first = (">=", a.numbers, a.prerelease)
        if b.parts == 3 and not b.wildcard:
            return [first, ("<=", b.numbers, b.prerelease)]
        return [first, _next(b, 0 if b.parts == 1 else 1)]
    m = re.match(r">=|<=|!=|==|~>|[<>~^=]|", text)
    v, op = _wanted(text[m.end() :].strip()), m[0]
    own = (">=", v.numbers, v.prerelease)
    bare = (">=", v.numbers, None)
    if op in ("~", "~>"):
        return [bare, _next(v, 0)] if v.parts == 1 or (v.wildcard and v.parts == 2) else [own, _next(v, 1)]
    if op == "^":
        return [own, _next(v, next((k for k in (0, 1) if v.numbers[k]), 2))]
    if op in ("", "=", "=="):
        if v.wildcard and v.parts == 1:
            return []
        if v.wildcard or v.parts < 3:
            return [bare, _next(v, v.parts - 1 - v.wildcard)]
        return [("=", v.numbers, v.prerelease)]
    return [(op, v.numbers, v.prerelease)]


def expand(constraint: str) -> list[list[Term]]:
    """The constraint as an OR of ANDs of plain comparisons; raises BadConstraint."""
    groups = []
    for group in constraint.split("||"):
        terms = [t.strip() for t in group.split(",")]
        if not all(terms):
            raise BadConstraint(constraint)
        groups.append([x for t in terms for x in _term(t)])
    return groups


def satisfies(v: Column, constraint: str) -> Column:
    """Whether a parsed version meets the constraint; null for a null version."""
    groups = expand(constraint)

    def tested(own: Column) -> Column:
        any_ = F.lit(False)
        for group in groups:
            all_ = F.lit(True)
            for op, (a, b, c), pre in group:
                number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
                other = key(F.struct(number(a).alias("major"), number(b).alias("minor"), number(c).alias("patch"), F.lit(pre).cast("string").alias("prerelease")))
                all_ = all_ & {"=": own == other, "!=": own != other, ">": own > other, ">=": own >= other, "<": own < other, "<=": own <= other}[op]
            any_ = any_ | all_
        return F.when(own.isNotNull(), any_)

    return _once(key(v), tested)
