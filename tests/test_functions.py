"""Hand-written edge cases for the column functions (FIXTURES section 3)."""

from pyspark.sql import functions as F

from linkloom.functions.text import clean_title, cleanup_name, first_words, title_tokens
from linkloom.functions.timefn import epoch_to_iso, utc_to_epoch
from linkloom.functions.urls import registrable_labels, suffix_host, suffix_rules_df, url_host
from linkloom.functions.vectors import argmax_first, dot, l2_normalize, vec_from_json
from linkloom.operators.common import tolerant_int
from linkloom.operators.profiles import drop_missing

URLS_EDGE = [
    (1, "HTTP://WWW.Example.COM/a", "example.com"),
    (2, "http://user:pw@www.evil.com:8080/x", "user:pw@www.evil.com:8080"),
    (3, "https://www.www.example.com/", "www.example.com"),
    (4, "example.com/path", ""),
    (5, "//host/p", "host"),
    (6, "", None),
    (7, None, None),
    (8, "http://exa mple.com/", "exa mple.com"),
    (9, "http://[::1/x", None),
    (10, "  http://a.com/x", "a.com"),
    (11, "http://10.0.0.1:80/", "10.0.0.1:80"),
    (12, "mailto:someone@example.com", ""),
]


def test_url_host(spark):
    df = spark.createDataFrame(URLS_EDGE, "id int, url string, expected string")
    got = {r["id"]: r["h"] for r in df.select("id", url_host(F.col("url")).alias("h")).collect()}
    for i, _, exp in URLS_EDGE:
        assert got[i] == exp, (i, got[i], exp)


SUFFIX_RULES = "com org net uk co.uk *.ck !www.ck jp co.jp io tr com.tr il co.il".split()
LABELS_EDGE = [
    ("http://a.bbc.co.uk/x", "bbc"),
    ("bbc.co.uk", "bbc"),
    ("https://co.uk", "none"),
    ("http://www.ck", "www"),
    ("http://foo.bar.ck/", "foo"),
    ("http://192.168.0.1/a", "192.168.0.1"),
    ("http://localhost:8080", "localhost"),
    ("HTTP://User@Sub.Example.COM:8080/x", "example"),
    ("example.io", "example"),
    ("http://shop.example.co.jp.", "example"),
    ("", "none"),
    # private suffixes are no rules: the ICANN suffix counts
    ("http://github.io/", "github"),
    ("http://foo.github.io/", "github"),
    ("http://bar.blogspot.com/2024", "blogspot"),
    ("http://x.com.tr", "x"),
    ("http://www.y.co.il/z", "y"),
    ("http://com.tr/", "none"),
    ("http://[2001:db8::1]:8080/x", "[2001:db8::1]"),
]


def test_registrable_labels(spark):
    rules = suffix_rules_df(spark, SUFFIX_RULES)
    df = spark.createDataFrame([(u,) for u, _ in LABELS_EDGE], "url string")
    hosts = df.select(suffix_host(F.col("url")).alias("host")).distinct()
    lab = {r["host"]: r["label"] for r in registrable_labels(hosts, rules).collect()}
    for url, exp in LABELS_EDGE:
        h = spark.createDataFrame([(url,)], "url string").select(suffix_host(F.col("url"))).first()[0]
        assert lab[h] == exp, (url, h, lab[h], exp)


TITLES_EDGE = [
    (1, "Ask HN: Show HN: something", "show hn something"),
    (2, "Show HN - My Project", "my project"),
    (3, "Videos about PDF", "s about"),
    (4, "Acme is hiring engineers", "acme engineers"),
    (5, "C++ is great!", "c is great"),
    (6, "naïve café", "na ve caf"),
    (7, "a b c", "a b c"),
    (8, "!!!", ""),
    (9, "Launch HN: Rocket", "rocket"),
]


def test_clean_title(spark):
    df = spark.createDataFrame(TITLES_EDGE, "id int, title string, expected string")
    for r in df.select("id", "expected", clean_title(F.col("title")).alias("c")).collect():
        assert r["c"] == r["expected"], (r["id"], r["c"])


def test_na_titles_dropped(spark):
    df = spark.createDataFrame([(1, "null"), (2, "NaN"), (3, ""), (4, None), (5, "ok"), (6, "N/A")],
                               "id int, title string")
    assert [r["id"] for r in drop_missing(df, ["title"]).collect()] == [5]


def test_tokens_and_stop_words(spark):
    df = spark.createDataFrame([("the rust compiler is a b fast 3d",)], "t string")
    toks = df.select(title_tokens(F.col("t")).alias("x")).first()["x"]
    assert toks == ["rust", "compiler", "fast", "3d"]


def test_tolerant_int(spark):
    rows = [("12", 12), (" 12 ", 12), ("12.0", None), ("", None), ("x", None), ("-3", -3), (None, None),
            ("1_000", 1000)]
    df = spark.createDataFrame(rows, "raw string, expected long")
    for r in df.select("expected", tolerant_int(F.col("raw")).alias("v")).collect():
        assert r["v"] == r["expected"]


def test_vectors_json(spark):
    rows = [("[1, 2, 2]",), ("bad",), ('[1, "a", 2]',), ("[1, 2]",), ("[0, 0, 0]",)]
    df = spark.createDataFrame(rows, "raw string")
    got = [r[0] for r in df.select(vec_from_json(F.col("raw"), 3)).collect()]
    assert got[0] == [1.0, 2.0, 2.0]
    assert got[1] is None and got[2] is None and got[3] is None
    assert got[4] == [0.0, 0.0, 0.0]
    v = df.limit(1).select(l2_normalize(vec_from_json(F.col("raw"))).alias("u")).first()["u"]
    assert abs(sum(x * x for x in v) - 1.0) < 1e-12
    z = spark.createDataFrame([("[0,0,0]",)], "raw string").select(
        l2_normalize(vec_from_json(F.col("raw"))).alias("u")).first()["u"]
    assert z == [0.0, 0.0, 0.0]


def test_dot_and_first_argmax(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [0.5, 0.9, 0.9])], "a array<double>, b array<double>, s array<double>")
    r = df.select(dot(F.col("a"), F.col("b")).alias("d"), argmax_first(F.col("s")).alias("m")).first()
    assert r["d"] == 11.0 and r["m"] == 2


def test_time_roundtrip(spark):
    df = spark.createDataFrame([(1735689600,), (1735689599,)], "t long")
    r = df.select(epoch_to_iso(F.col("t")).alias("iso"),
                  utc_to_epoch(F.to_timestamp_ntz(epoch_to_iso(F.col("t")))).alias("back")).collect()
    assert r[0]["iso"] == "2025-01-01T00:00:00" and r[1]["iso"] == "2024-12-31T23:59:59"
    assert [x["back"] for x in r] == [1735689600, 1735689599]


def test_name_helpers(spark):
    df = spark.createDataFrame([('  "Rust*"  compilers\nare   fast today  ',)], "t string")
    r = df.select(first_words(F.col("t"), 4).alias("f"), cleanup_name(F.col("t")).alias("c")).first()
    assert r["f"] == '"Rust*" compilers are fast'
    assert r["c"] == "Rust compilers are fast today"
