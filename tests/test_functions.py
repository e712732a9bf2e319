"""Scalar functions on hand-written rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import color as co
from corpusloom.functions import text as tx
from corpusloom.operators import registry

#: Published CIEDE2000 test pairs (Sharma, Wu, Dalal 2005), the first, blue, grey and large ones.
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (50.0, 2.5, 0.0, 58.0, 24.0, 15.0, 19.4535),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373),
    (90.8027, -2.0831, 1.441, 91.1528, -1.6435, 0.0447, 1.4441),
]


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(expr.alias("v")).first().v


def test_delta_e(spark):
    import numpy as np

    df = spark.createDataFrame(PAIRS, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    lab = lambda k: F.struct(F.col(f"l{k}").alias("L"), F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"))
    rows = df.withColumn("p", lab(1)).withColumn("q", lab(2)).select("want", co.delta_e(registry.lab_fields(F.col("p")), registry.lab_fields(F.col("q"))).alias("got")).collect()
    for r in rows:
        assert r.got == pytest.approx(r.want, abs=1e-4)
    for *x, want in PAIRS:
        assert registry.delta_e(np.array(x[:3]), np.array([x[3:]]))[0] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(
    ("target", "want"),
    [
        ("https://Example.com:3000/Pricing/?q=1", "example-com-pricing"),
        ("/proj/src/pages/Index.tsx", "src-pages-index-tsx"),
        ("/elsewhere/deep/File.tsx", "file-tsx"),
        ("https://exa mple/%%", None),
        ("", None),
        ("a" * 60, "a" * 50),
    ],
)
def test_slug(spark, target, want):
    assert one(spark, tx.slug(F.col("t"), "/proj"), t=target) == want


def test_stamp(spark):
    df = spark.createDataFrame([(datetime.datetime(2026, 5, 12, 18, 30, 0, 123000),)], "t timestamp")
    assert df.select(tx.file_stamp(F.col("t")).alias("v")).first().v == "2026-05-12T18-30-00Z"


@pytest.mark.parametrize(("path", "want"), [("app/index.tsx", "/"), ("app/(tabs)/home.tsx", "/home"), ("src/app/settings/index.tsx", "/settings"), ("app/u/[id].tsx", "/u/[id]")])
def test_file_route(spark, path, want):
    assert one(spark, tx.file_route(F.col("p")), p=path) == want


def test_params(spark):
    assert [tuple(x) for x in one(spark, tx.route_params(F.col("p")), p="app/[team]/[...rest].tsx")] == [("team", False), ("rest", True)]


@pytest.mark.parametrize(("v", "want"), [("^0.73.2", True), ("~0.72", False), (">=1", True), ("latest", False)])
def test_versions(spark, v, want):
    assert one(spark, tx.version_at_least(F.col("v"), 0, 73), v=v) is want


@pytest.mark.parametrize(("h", "want"), [("#FFF", "ffffff"), ("#12ab", "1122aa"), ("#11223344", "112233"), ("#12345", None)])
def test_hex(spark, h, want):
    assert one(spark, co.expand_hex(F.col("h")), h=h) == want


def test_provider_blocks(spark):
    text = "a\n<one>\nonly one\n</one>\n<two>\nonly two\n</two>\n<div>\nx\n</div>\nz"
    assert one(spark, tx.provider_blocks(F.col("t"), ["one"], ["one", "two"]), t=text) == "a\nonly one\n\n<div>\nx\n</div>\nz"
    assert one(spark, tx.provider_blocks(F.col("t"), [], ["three"]), t=text) == text


@pytest.mark.parametrize(("v", "want"), [("", True), ("a: b", True), ("a:b", False), ("- x", True), ("-x", False), ("yes", True), ("3.5", True), ("plain", False), ("x #y", True), (" x", True)])
def test_yaml_quoting(spark, v, want):
    assert one(spark, tx.yaml_needs_quotes(F.col("v")), v=v) is want


def test_clip_and_names(spark):
    assert one(spark, tx.humanized(F.col("v")), v="design-system-audit") == "Design System Audit"
    long = "word " * 30
    got = one(spark, tx.clip(F.col("v")), v=long)
    assert got.endswith("word...") and len(got) <= 90
    assert one(spark, tx.toml_string(F.col("v")), v='a"b\n') == '"a\\"b\\n"'


def test_positions(spark):
    df = spark.createDataFrame([("ab\nécd\n", 4)], "t string, o int")
    r = df.select(tx.line_of(F.col("t"), F.col("o")).alias("l"), tx.column_of(F.col("t"), F.col("o")).alias("c"), tx.window(F.col("t"), F.col("o"), 10, 2).alias("w")).first()
    assert (r.l, r.c, r.w) == (2, 2, "ab\nécd")
