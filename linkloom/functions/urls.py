"""URL column functions (SCL8, SCL9, SCL11) -- all native Spark expressions.

Two different notions of "domain" exist in the analyses and are kept apart:

* ``url_host``: the network location as a standard URL splitter returns it --
  lower-cased, one leading ``www.`` dropped, port and user info kept; a URL
  without ``//`` has no host (``''``); an unbalanced IPv6 bracket is a parse
  error (null).
* ``registrable_label``: the label just left of the public suffix
  (``a.bbc.co.uk`` -> ``bbc``), found by joining suffix candidates against a
  rule table (exact, ``*.`` wildcard and ``!`` exception rules).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from linkloom.operators.common import sized_broadcast

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Scheme + authority prefix of a URL (RFC 3986 scheme characters).
AUTHORITY_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
# Characters a URL splitter strips from the front (C0 controls and space) and
# removes everywhere (tab, CR, LF).
LEADING_JUNK_RE = r"^[\x00-\x20]+"
UNSAFE_CHARS_RE = r"[\t\r\n]"
# Scheme prefix removed before suffix matching (any scheme chars, optional).
SCHEME_PREFIX_RE = r"^(?:[A-Za-z0-9+.-]+:)?//"
IPV4_RE = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
NO_DOMAIN = "none"


def url_host(url: Column) -> Column:
    """Network location of ``url`` as a URL splitter yields it (SCL9).

    null/empty input -> null (the caller's ``if url`` test); no ``//`` -> ``''``;
    unbalanced ``[``/``]`` -> null; lower-cased; one leading ``www.`` removed.
    Port and user info are kept (``evil.com:8080`` stays as is).
    """
    u = F.regexp_replace(F.regexp_replace(url, UNSAFE_CHARS_RE, ""), LEADING_JUNK_RE, "")
    net = F.lower(F.regexp_extract(u, AUTHORITY_RE, 1))
    bad_bracket = net.contains("[") != net.contains("]")
    host = F.regexp_replace(net, r"^www\.", "")
    return (F.when(url.isNull() | (url == ""), F.lit(None).cast("string"))
            .when(bad_bracket, F.lit(None).cast("string"))
            .otherwise(host))


def suffix_host(url: Column) -> Column:
    """Host used for public-suffix matching.

    Scheme optional, ``//`` optional (``example.com/x`` has host
    ``example.com``), path/query/fragment, user info and port removed,
    lower-cased, trailing dots dropped.
    """
    u = F.regexp_replace(F.trim(url), SCHEME_PREFIX_RE, "")
    u = F.regexp_extract(u, r"^([^/?#]*)", 1)
    u = F.regexp_replace(u, r"^.*@", "")
    v6 = F.regexp_extract(u, r"^(\[[^\]]*\])", 1)  # an IPv6 address keeps its brackets and colons
    u = F.when(v6 != "", v6).otherwise(F.regexp_replace(u, r":.*$", ""))
    return F.regexp_replace(F.lower(u), r"\.+$", "")


def parent_domains(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]`` (SCL11); empty/null host -> empty array."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(host.isNull() | (host == ""), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")))


def suffix_rules_df(spark: SparkSession, rules: list[str] | DataFrame) -> DataFrame:
    """Rule table ``(key, kind)`` with kind in exact / wild / exc.

    ``rules`` is the caller's list: rule strings, or a one-column DataFrame of
    rule lines (e.g. ``spark.read.text(path)`` of a public-suffix file, of which
    the analyses use the ICANN section only).  Comment (``//``) and blank lines
    are ignored.
    """
    if isinstance(rules, DataFrame):
        raw = rules.select(F.trim(F.col(rules.columns[0])).alias("rule"))
    else:
        raw = spark.createDataFrame([(r,) for r in rules], "rule string")
    raw = raw.filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    rule = F.lower(F.col("rule"))
    return raw.select(
        F.when(rule.startswith("!"), F.substring(rule, 2, 10_000))
        .when(rule.startswith("*."), F.substring(rule, 3, 10_000))
        .otherwise(rule).alias("key"),
        F.when(rule.startswith("!"), "exc").when(rule.startswith("*."), "wild")
        .otherwise("exact").alias("kind"),
    ).distinct()


def registrable_labels(hosts: DataFrame, rules: DataFrame, host_col: str = "host") -> DataFrame:
    """Add ``label`` (SCL8) to a DataFrame of hosts.

    Works on whatever rows it is given; callers pass *distinct* hosts so the
    candidate explosion is paid once per host, not once per post.  The rule
    table is a bounded reference list and is broadcast.
    """
    parts = F.split(F.col(host_col), r"\.")
    n = F.size(parts)
    cands = (hosts.select(host_col).filter(F.col(host_col) != "")
             .select(host_col, F.posexplode(F.sequence(F.lit(1), n)).alias("_p", "i"))
             .select(host_col, "i",
                     F.array_join(F.slice(parts, F.col("i"), n - F.col("i") + 1), ".").alias("cand"),
                     F.when(F.col("i") < n, F.array_join(F.slice(parts, F.col("i") + 1, n - F.col("i")), "."))
                     .alias("parent")))
    probes = cands.select(host_col, "i", F.explode(F.array(
        F.struct(F.col("cand").alias("key"), F.lit("exact").alias("kind")),
        F.struct(F.col("cand").alias("key"), F.lit("exc").alias("kind")),
        F.struct(F.col("parent").alias("key"), F.lit("wild").alias("kind")),
    )).alias("p")).select(host_col, "i", "p.key", "p.kind").filter(F.col("key").isNotNull())
    hits = probes.join(sized_broadcast(rules), ["key", "kind"], "inner")
    start = (hits.groupBy(host_col).agg(
        F.min(F.when(F.col("kind") == "exc", F.col("i") + 1)).alias("exc_start"),
        F.min(F.when(F.col("kind") != "exc", F.col("i"))).alias("rule_start"))
        .select(host_col, F.coalesce("exc_start", "rule_start").alias("suffix_start")))
    out = hosts.join(start, host_col, "left")
    parts = F.split(F.col(host_col), r"\.")
    n = F.size(parts)
    label = (F.when(F.col(host_col).isNull() | (F.col(host_col) == ""), F.lit(NO_DOMAIN))
             .when(F.col(host_col).rlike(IPV4_RE) | F.col(host_col).startswith("["), F.col(host_col))
             .when(F.col("suffix_start").isNull(), F.element_at(parts, -1))
             .when(F.col("suffix_start") <= 1, F.lit(NO_DOMAIN))
             .otherwise(F.element_at(parts, (F.col("suffix_start") - 1).cast("int"))))
    label = F.when(label == "", F.lit(NO_DOMAIN)).otherwise(label)
    return out.withColumn("label", label).drop("suffix_start")
