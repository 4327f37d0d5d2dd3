"""Column functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from sketchloom.functions import addresses, entropy, names, numbers, semver, strings


def table(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*(c.alias(k) for k, c in columns.items())).collect()


GLOBS = [
    ("abc", "abc", True), ("abc", "abd", False), ("*", "", True), ("*", "any/thing", True), ("a*c", "abbbc", True), ("a*c", "abbbd", False),
    ("**", "x/y", True), ("a?c", "abc", True), ("a?c", "ac", False), ("?", "é", True), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False),
    ("[^a-c]x", "dx", True), ("[]]", "]", True), ("[a-]", "-", True), (r"\*", "*", True), (r"\*", "x", False), ("/api/*/users", "/api/v1/x/users", True),
    ("a.c", "abc", False), ("[&&]", "&", True), ("", "", True), ("", "a", False), ("h*llo*", "hello world", True), ("a\nb", "a\nb", True),
]


@pytest.mark.parametrize("pattern,text,want", GLOBS)
def test_globs(spark, pattern, text, want):
    assert table(spark, [(text,)], "s string", x=strings.glob_match(F.col("s"), pattern))[0].x is want


SEGMENTS = [
    ("/a/*/c", "/a/b/c", "/", True), ("/a/*/c", "/a/b/x/c", "/", False), ("/a/**/c", "/a/b/x/c", "/", True), ("a:*", "a:b:c", ":", False),
    ("a:*", "a:b/c", ":", True), ("?", "/", "/", False), ("[/]", "/", "/", True), ("a/*:*", "a/b:c", "/:", True), ("**/a*c", "x/ab/ac", "/", True),
]


@pytest.mark.parametrize("pattern,text,seps,want", SEGMENTS)
def test_segment_globs(spark, pattern, text, seps, want):
    assert table(spark, [(text,)], "s string", x=strings.glob_match_segments(F.col("s"), pattern, seps))[0].x is want


@pytest.mark.parametrize("pattern", ["[", "[]", "[a", "[b-a]", "a\\", "[!", "[\\"])
def test_bad_globs(pattern):
    with pytest.raises(strings.BadPattern):
        strings.glob_regex(pattern)


def test_prefix_globs_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/pages.parquet").where(strings.glob_match(F.col("url"), "https*"))._jdf.queryExecution().toString()
    assert "StringStartsWith(url,https)" in plan


def test_string_helpers(spark):
    m = F.create_map(*map(F.lit, ("name", "Ann", "b", "{{ name }}")))
    r = table(
        spark, [(list("abcde"), [], "Hi {{ name }}, {{b}} and {{ c }}!", "\u0000​ x y\t ")], "a array<string>, e array<string>, t string, d string",
        c=strings.chunks(F.col("a"), 2), n=strings.chunks(F.col("e"), 2), t=strings.simple_template(F.col("t"), m), d=strings.string_clean(F.col("d")),
        s=strings.sort_map(F.create_map(*map(F.lit, ("z", "1", "a", "2")))), r=strings.replace_map(F.lit("abc"), {"b": "c", "a": "b"}), k=strings.slice_contains(F.col("a"), "c"),
        snake=strings.camel_to_snake(F.lit("HTTPPortMaxIdle")),
    )[0]
    assert r.c == [["a", "b"], ["c", "d"], ["e"]] and r.n == []
    assert r.t == "Hi Ann, {{ name }} and {{ c }}!" and r.d == " x y" and list(r.s.items()) == [("a", "2"), ("z", "1")]
    assert r.r == "ccc" and r.k and r.snake == "http_port_max_idle"


@pytest.mark.parametrize("data,shannon,least", [(b"", 0, 0), (b"a", 0, 0), (b"aaaaaaaaaa", 0, 0), (b"aabb", 1, 1), (b"aabbccdd", 2, 2), (bytes(range(256)), 8, 8), (b"aaab", 0.811278, 0.415037)])
def test_entropy(spark, data, shannon, least):
    r = entropy.entropy(spark.createDataFrame([(1, bytearray(data))], "id int, d binary"), "id", "d").first()
    assert abs(r.shannon - shannon) < 1e-6 and abs(r.min_entropy - least) < 1e-6
    assert abs(r.metric - 100 * r.normalized) < 1e-9 and 0 <= r.normalized <= 1


def test_entropy_of_rows_that_share_a_key(spark):
    rows = entropy.entropy(spark.createDataFrame([(1, bytearray(b"aa")), (1, bytearray(b"ab")), (1, None)], "id int, d binary"), "id", "d").collect()
    assert sorted(r.shannon for r in rows) == [0.0, 0.0, 1.0]


def test_numbers_and_ids(spark):
    r = table(
        spark, [(12.3456, 12.5, 1.005)], "a double, b double, c double",
        a=numbers.round64(F.col("a"), 2), b=numbers.round64(F.col("b"), 0), c=numbers.round64(F.col("c"), 2), up=numbers.round64_up(F.lit(12.3416), 2), down=numbers.round64_down(F.lit(12.3496), 2),
        i=numbers.uxid(F.lit("2024-01-01").cast("timestamp"), F.lit(1)), j=numbers.uxid(F.lit("2024-01-02").cast("timestamp"), F.lit(1)), n=numbers.base34(F.lit(34 * 34 + 35).cast("decimal(20,0)"), 4),
    )[0]
    assert (r.a, r.b, r.c, r.up, r.down) == (12.35, 13.0, 1.0, 12.35, 12.34)
    assert len(r.i) == 24 and r.i < r.j and r.i[12:] == r.j[12:] and r.n == "0111"
    with pytest.raises(ValueError):
        numbers.rand_int(3, 3, 1)


def test_names(spark):
    r = table(spark, [("a.b.example.com",), ("localhost",), ("x.",)], "h string", d=names.domain_from_hostname(F.col("h")), g=names.domain_name_guesses(F.col("h")), z=names.normalize_zone(F.col("h")))
    assert [x.d for x in r] == ["b.example.com", None, ""]
    assert r[0].g == ["a.b.example.com", "b.example.com", "example.com", "com"] and [x.z for x in r] == ["a.b.example.com.", "localhost.", "x."]


VERSIONS = [("1.2.3", "1.2.3"), ("v1.2", "1.2.0"), ("1", "1.0.0"), ("01.002.3", "1.2.3"), ("1.2.3-rc.1+b.01", "1.2.3-rc.1+b.01"), ("1.2.3-01", None), ("1.2.3.4", None), ("", None), ("a.b", None), ("1.2.3-", None), ("1.2.3+", None), ("vv1", None), ("18446744073709551615.0.0", "18446744073709551615.0.0"), ("18446744073709551616", None), ("1.2.3-a..b", None)]


def test_versions(spark):
    r = table(spark, [(a,) for a, _ in VERSIONS], "v string", t=semver.to_text(semver.parse(F.col("v"))))
    assert [x.t for x in r] == [b for _, b in VERSIONS]


def test_precedence(spark):
    order = "0.9.9 1.0.0-1 1.0.0-2 1.0.0-10 1.0.0-alpha 1.0.0-alpha.1 1.0.0-alpha.beta 1.0.0-beta 1.0.0-beta.2 1.0.0-beta.11 1.0.0-rc.1 1.0.0 1.0.1 1.1.0 2.0.0".split()
    df = spark.createDataFrame([(k, v) for k, v in reversed(list(enumerate(order)))], "k int, v string")
    assert [r.k for r in df.orderBy(semver.key(semver.parse(F.col("v")))).collect()] == list(range(len(order)))
    assert table(spark, [("1.0.0+a", "1.0.0+b")], "a string, b string", c=semver.compare(semver.parse(F.col("a")), semver.parse(F.col("b"))))[0].c == 0


CONSTRAINTS = [
    ("^1.2.3", "1.9.0", True), ("^1.2.3", "2.0.0", False), ("^0.2.3", "0.2.9", True), ("^0.2.3", "0.3.0", False), ("^0", "0.0.0", True), ("^0", "0.0.1", False),
    ("~1.2.3", "1.2.9", True), ("~1.2.3", "1.3.0", False), ("~1", "1.9.9", True), ("~*", "0.9.0", True), ("~*", "1.0.0", False), ("1.2", "1.2.7", True), ("1.x", "1.9.0", True),
    ("*", "9.9.9-rc.1", True), ("1.2.3 - 2.3", "2.3.9", True), ("1.2.3 - 2.3", "2.4.0", False), ("1 - 2.*", "2.0.9", True), ("1 - 2.*", "2.1.0", False), ("!=1.2", "1.2.0", False),
    ("!=1.2", "1.2.1", True), (">=1.0.0, <2.0.0 || 3.0.0", "3.0.0", True), (">=1.0.0, <2.0.0", "2.0.0-rc.1", True), ("=1.2.3", "1.2.3+build", True), ("==1.2.x", "1.2.5", True), ("> 1.2.3", "1.2.3", False),
]


def test_constraints(spark):
    df = spark.createDataFrame([(v,) for _, v, _ in CONSTRAINTS], "v string").withColumn("p", semver.parse(F.col("v")))
    for c, v, want in CONSTRAINTS:
        assert df.where(F.col("v") == v).select(semver.satisfies(F.col("p"), c).alias("x")).first().x is want, (c, v)
    for bad in ("", "1.*.3", ">", "abc", "1.2.3,", "1 || ", ">>1"):
        with pytest.raises(semver.BadConstraint):
            semver.expand(bad)


def test_increments_and_diffs(spark):
    v = semver.parse(F.col("v"))
    r = table(spark, [("1.2.3-rc.1+b",)], "v string", a=semver.to_text(semver.increment(v, "major")), b=semver.to_text(semver.increment(v, "minor")), c=semver.to_text(semver.increment(v, "patch")), d=semver.diff(v, semver.parse(F.lit("1.2.3"))), e=semver.diff(v, v))[0]
    assert tuple(r) == ("2.0.0", "1.3.0", "1.2.4", "prerelease", "")


def test_addresses(spark):
    n = addresses.ipv4_network(F.col("c"))
    r = table(spark, [("10.0.0.7/24",), ("0.0.0.0/0",), ("1.2.3.4/33",), ("x",), ("1.2.3.256/8",)], "c string", n=n)
    assert tuple(r[0].n) == (167772160, 167772415, 24) and tuple(r[1].n) == (0, 2**32 - 1, 0) and [x.n for x in r[2:]] == [None] * 3
    ips = [("192.168.77.5", "192.168.64.0"), ("2001:db8:1:2::3", "2001:db8::"), ("::ffff:10.1.2.3", "10.1.0.0"), ("bad", None), (None, None)]
    r = table(spark, [(a,) for a, _ in ips], "i string", x=addresses.strip_address(F.col("i"), 18, 32))
    assert [x.x for x in r][:2] == [b for _, b in ips][:2] and [x.x for x in r][3:] == [None, None]


def test_proxy_headers(spark):
    lines = ["PROXY TCP4 1.2.3.4 5.6.7.8 1 65535\r\n", "PROXY TCP6 ::1 2001:db8::1 80 443\r\n", "PROXY UNKNOWN\r\n", "PROXY TCP4 ::1 ::1 1 2\r\n", "PROXY TCP4 1.2.3.4 5.6.7.8 1 65536\r\n", "GET /\r\n"]
    r = [x.h for x in table(spark, [(x,) for x in lines], "l string", h=addresses.proxy_v1(F.col("l")))]
    assert tuple(r[0]) == ("TCP4", "1.2.3.4", "5.6.7.8", 1, 65535) and r[1].family == "TCP6" and tuple(r[2]) == ("UNKNOWN", None, None, None, None) and r[3:] == [None] * 3
    head = b"\r\n\r\n\x00\r\nQUIT\n"
    good = head + b"\x21\x11\x00\x0e" + bytes([1, 2, 3, 4, 5, 6, 7, 8]) + b"\x00\x50\x01\xbb" + b"xx"
    data = [(good,), (head + b"\x20\x00\x00\x00",), (head + b"\x21\x11\x00\x04abcd",), (b"short",), (None,)]
    r = [x.h for x in table(spark, data, "d binary", h=addresses.proxy_v2(F.col("d")))]
    assert tuple(r[0]) == ("PROXY", "TCP4", "1.2.3.4", "5.6.7.8", 80, 443) and r[1].command == "LOCAL" and all(x.command is None for x in r[2:])
