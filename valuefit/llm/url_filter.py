"""URL filters by expression hashing.

Each URL is expanded into expressions, a host suffix followed by a path prefix.  Expressions meet rules in an
equi-join on a short hash prefix; the full digest then confirms a meeting, and of the rules that fit the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: host, path, verdict
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    if not rules:
        return spark.range(0).select(*(F.lit(None).cast("string").alias(c) for c in ("host", "path", "verdict")))
    rows = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(r, ("host", "path", "verdict")))) for r in rules))
    return spark.range(1).select(F.inline(rows))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased.  Path: from there up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    broadcast_rows: int = 200_000,
    salts: int = 16,
) -> DataFrame:
    """One row for each row of ``pages``: key, host, path, rule, verdict, and ``url``.

    A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the rule's path.
    The longest rule string wins; among equal lengths the longer host, then ``block``.  URLs without a rule get
    ``default``, as do null URLs and URLs without ``://`` (host and path empty).  Repeated rows come back as often as
    they came; a null key is kept.  Other columns of ``pages`` are not carried.  Rules with a null host or path fit
    nothing; whole URLs of any length are read, and the plan grows with the number of distinct lengths of rule paths.  A
    rule given twice counts once, its ``block`` before its ``allow``.  Without rules all get ``default``.

    Rules are broadcast if a count shows that they fit ``broadcast_rows``; more rules are joined by a shuffle in which
    the URLs' expressions are salted, since an expression such as ``com/`` may belong to a third of the URLs.
    """
    rules = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(F.translate("host", UPPER, UPPER.lower()).alias("host"), "path", "verdict")
        .withColumn("text", F.concat("host", "path"))
    )
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # a URL's length at most
    by_prefix = (
        rules.groupBy("host", "path", "text").agg(F.max("verdict").alias("verdict"))
        .withColumn("digest", F.sha2("text", 256))
        .groupBy(_short(F.col("digest")).alias("short"))
        .agg(F.collect_list(F.struct("digest", "host", "path", "text", "verdict")).alias("rules"))
    )
    host, path = split_url(F.col("url"))
    rows = (
        pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
        .withColumn("host", host)
        .withColumn("path", path)
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = F.filter(F.array(*(F.lit(n) for n in sorted(lengths))).cast("array<int>"), lambda n: F.length("path") >= n)
    prefixes = F.transform(fit, lambda n: F.substr("path", F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    # explode_outer keeps URLs without expressions; position 0 or null marks the first row of each URL
    opened = rows.select("*", F.posexplode_outer(expressions).alias("at", "expression")).withColumn(
        "full", F.sha2("expression", 256)
    ).withColumn("short", _short(F.col("full")))
    n_rules = by_prefix.count()
    if n_rules <= broadcast_rows:
        met = opened.join(F.broadcast(by_prefix), "short", "left")
    else:
        salted = by_prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = opened.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(salts)).cast("int")).join(
            salted, ["short", "salt"], "left"
        )
    fits = F.filter("rules", lambda r: (r["digest"] == F.col("full")) & (r["text"] == F.col("expression")))
    # one digest is one rule string; host and path tell apart rules whose strings agree (none when paths start with /)
    fits = F.filter(fits, lambda r: F.startswith(F.col("path"), r["path"]) & (
        (F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))))
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        F.length(r["text"]).alias("size"), F.length(r["host"]).alias("host_size"),
        r["verdict"].alias("verdict"), r["text"].alias("rule"))))
    out = (
        met.withColumn("best", best)
        .groupBy("key", "url", "host", "path")
        .agg(F.max("best").alias("best"), F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("times"))
        .withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    )
    return out.select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "url",
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), rules_frame(spark)).drop("url")


SQL = {
    "op1_url_filter": r"""
WITH rules(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS n,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, n, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
m AS (SELECT n, arg_max(struct_pack(rule := rh || rp, verdict := r.verdict), length(rh || rp)) AS b
  FROM p JOIN rules r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY n)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""
}
QUERIES = {"op1_url_filter": op1_url_filter}
