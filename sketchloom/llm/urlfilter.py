"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host (it and all subdomains) with a path prefix, or a wildcard pattern over
``host + path``; rules are also read from lines of a block list.  Each rule is filed under the one of its literal tokens that the fewest
URLs hold; a URL's tokens fetch the candidate rules, and only those run their regular
expression.  The longest rule that fits decides.

Defined cases: a null URL, or one without ``://``, has empty host and path and no rule;
repeated rows are judged alike; rules without a complete literal token are filed under
the empty token, which every URL has; an empty rule set allows everything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, let, lower_ascii, unused

#: Characters that end a token, in hosts and paths alike.
_DELIMITERS = r"[\x00-/:-@\[-^`{-\x7f]"


@dataclass(frozen=True)
class UrlRule:
    """``allow`` or ``block`` for a host and its subdomains under a path prefix.

    With ``wildcard`` host and path may hold ``*`` (any run; in a host, within it) and an
    empty host fits any host.
    """

    verdict: str
    host: str
    path: str = "/"
    wildcard: bool = False

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    @property
    def regex(self) -> str:
        quote = lambda s: re.sub(r"([\x00-.:-@\[-^`{-\x7f])", r"\\\1", s)
        labels = "[^/]*".join(map(quote, self.host.split("*"))) if self.wildcard else quote(self.host)
        host = rf"([^/]*\.)?{labels}" if self.host else "[^/]*"
        path = ".*".join(map(quote, self.path.split("*"))) if self.wildcard else quote(self.path)
        return f"(?s)^{host}{path}"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every URL which fits must hold whole."""
        found = []
        for k, run in enumerate(labels := self.host.split("*") if self.wildcard else [self.host]):
            parts = re.split(_DELIMITERS, run)
            found += [t for j, t in enumerate(parts) if t and not (k and j == 0) and not (k < len(labels) - 1 and j == len(parts) - 1)]
        for k, run in enumerate(self.path.split("*") if self.wildcard else [self.path]):
            parts = re.split(_DELIMITERS, run)
            # what touches a wildcard or the prefix's open end may be part of a longer token
            found += [t for j, t in enumerate(parts) if t and j < len(parts) - 1 and not (k and j == 0)]
        return found


#: The contract's rules.
BASE_RULES = (
    UrlRule("allow", "org"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)

#: Words of hosts and paths that training text is not taken from.
BLOCKED_WORDS = (
    "porn xxx sex adult nude escort "
    "casino poker betting slots lottery bingo "
    "ads adserver adclick banner doubleclick popunder sponsor "
    "track tracking pixel beacon analytics telemetry "
    "warez crack keygen torrent phishing"
).split()

#: Used where no base rule fits: each word as a host's label, as a folder and as a file's name.
METHOD_RULES = tuple(UrlRule("block", host, path, True) for w in BLOCKED_WORDS for host, path in ((f"{w}.*", "/"), ("", f"*/{w}/"), ("", f"*/{w}.")))


def read_rules(lines: list[str]) -> list[UrlRule]:
    """Rules of a block list: ``||host^`` or ``||host/path``, patterns with ``*``, ``@@`` before exceptions.

    A pattern without ``||`` fits at any place of the path.  Empty lines and those that start
    with ``!``, ``#`` or ``[`` are remarks; options after ``$`` and element rules (``##``) do not concern pages
    and raise, so that none is passed over.
    """
    rules = []
    for line in map(str.strip, lines):
        if not line or line[0] in "!#[":
            continue
        if "##" in line or "$" in line:
            raise ValueError(f"not a rule for pages: {line}")
        verdict, pattern = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
        if pattern.startswith("||"):
            host, slash, path = pattern[2:].rstrip("^").partition("/")
            rules.append(UrlRule(verdict, host.lower(), slash + path or "/", True))
        else:
            rules.append(UrlRule(verdict, "", "*" + pattern.lstrip("*"), True))
    return rules


def host_and_path(url: Column) -> Column:
    """Struct (host, path): the parts of a URL as the module's docstring defines them."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.struct(host.alias("host"), path.alias("path"))


def url_tokens(target: Column) -> Column:
    """The distinct tokens of ``host + path``, with the empty token for rules that have none."""
    return F.array_union(F.split(target, _DELIMITERS), F.array(F.lit("")))


def file_rules(urls: DataFrame, rules: list[tuple[UrlRule, bool]]) -> dict[str, list[tuple[UrlRule, bool]]]:
    """Rules by the literal token that the fewest URLs hold.

    ``urls`` has host and path.  Only tokens that occur in rules are counted, so what
    reaches the driver is bounded by the rules.
    """
    literal = sorted({t for r, _ in rules for t in r.tokens})
    held: dict[str, int] = {}
    if literal:
        tokens = F.array_intersect(F.split(F.concat("host", "path"), _DELIMITERS), F.array(*map(F.lit, literal)))
        held = {r["t"]: r["count"] for r in urls.select(F.explode(tokens).alias("t")).groupBy("t").count().collect()}
    index: dict[str, list[tuple[UrlRule, bool]]] = {}
    for rule, base in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (held.get(t, 0), t), default=""), []).append((rule, base))
    return index


def _entry(rule: UrlRule, base: bool) -> Column:
    """A rule as a struct that sorts by precedence: base rules first, then the longest."""
    fields = {"base": base, "len": len(rule.name), "host_len": len(rule.host), "rule": rule.name, "verdict": rule.verdict, "regex": rule.regex}
    return F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))


def judge_urls(pages: DataFrame, base=BASE_RULES, method=METHOD_RULES, inline_rules: int = 256) -> DataFrame:
    """``pages`` with the columns host, path, rule, method_rule and verdict.

    Up to ``inline_rules`` rules the index is a constant map and the whole operator one scan
    without a shuffle.  Larger rule sets become a table: distinct (host, path) explode to
    tokens, join the index, and the verdicts join back.
    """
    rules = [(r, True) for r in base] + [(r, False) for r in method]
    names = {k: unused(pages, k) for k in ("parts", "best", "host", "path")}
    parts = pages.withColumn(names["parts"], host_and_path(F.col("url")))
    split = parts.select(F.col(names["parts"])["host"].alias("host"), F.col(names["parts"])["path"].alias("path"))
    target = F.concat(F.col(names["parts"])["host"], F.col(names["parts"])["path"])
    index = file_rules(split, rules)
    if not rules:
        best = parts.withColumn(names["best"], F.lit(None).cast("struct<base:boolean,rule:string,verdict:string>"))
    elif len(rules) <= inline_rules:
        filed = F.create_map(*(x for t, rs in index.items() for x in (F.lit(t), F.array(*(_entry(*r) for r in rs)))))

        def winner(t: Column) -> Column:
            fetched = F.flatten(F.filter(F.transform(url_tokens(t), lambda k: F.try_element_at(filed, k)), lambda x: x.isNotNull()))
            return F.array_max(F.filter(fetched, lambda r: F.regexp_like(t, r["regex"])))

        best = parts.withColumn(names["best"], let(target, winner))
    else:
        best = _judge_by_join(parts, split, index, names)
    b = F.col(names["best"])
    kept = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "method_rule", "verdict")]
    return best.select(
        *kept,
        F.col(names["parts"])["host"].alias("host"),
        F.col(names["parts"])["path"].alias("path"),
        F.when(b["base"], b["rule"]).alias("rule"),
        F.when(~b["base"], b["rule"]).alias("method_rule"),
        F.coalesce(b["verdict"], F.lit("allow")).alias("verdict"),
    )


def _judge_by_join(parts: DataFrame, split: DataFrame, index: dict, names: dict) -> DataFrame:
    spark = parts.sparkSession
    rows = [(t, b, len(r.name), len(r.host), r.name, r.verdict, r.regex) for t, rs in index.items() for r, b in rs]
    table = spark.createDataFrame(rows, "token string, base boolean, len int, host_len int, rule string, verdict string, regex string")
    tokens = split.distinct().select("host", "path", F.explode(url_tokens(F.concat("host", "path"))).alias("token"))
    candidates = join_checked(tokens, table, "token", "inner").where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    order = F.struct("base", "len", "host_len", "rule", "verdict")
    best = candidates.groupBy(F.col("host").alias(names["host"]), F.col("path").alias(names["path"])).agg(F.max(order).alias(names["best"]))
    at = F.col(names["parts"])
    return join_checked(parts, best, (at["host"] == best[names["host"]]) & (at["path"] == best[names["path"]]), "left")
