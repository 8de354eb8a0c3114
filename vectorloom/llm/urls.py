"""URL filters: host-suffix and path-prefix expressions against hashed rules.

A rule has a host and a path. It fits a URL when its host is the URL's or a parent domain of it
and the URL's path starts with the rule's; the longest fitting rule decides. Each URL is
expanded into one expression per pair of a host suffix (at label boundaries) and a path prefix,
of the numbers of labels and the lengths that occur among the rules: no other can meet one, and a host of
very many labels costs no more than its length. The expressions meet the rules in an equi-join on
the first 32 bits of their SHA-256 digest; whole digests then confirm each meeting.

Equal (page_id, url) rows are judged once and given back as often as they came. The rules are a
small list beside the pages; whether they are broadcast is left to Spark, which looks at their
size, and otherwise adaptive execution splits a frequent prefix such as that of ``com/``.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and
gets the method's verdict, as does a URL that no rule fits; an empty host or a host with empty
labels is compared as it stands; rules with the same host and path: block wins; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.columns import col

#: Fixed rules: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression.cast("binary"), 256))


def short(full: Column) -> Column:
    """The first 32 bits of a digest."""
    return F.substring(full, 1, 4)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def hashed_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path) with its digest; of two verdicts ``block`` wins."""
    single = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    expression = F.concat("host", "path")
    return single.select(
        digest(expression).alias("digest"),
        short(digest(expression)).alias("prefix"),
        F.struct(
            F.length(expression).alias("length"),
            F.length("host").alias("host_length"),
            expression.alias("rule"),
            F.col("verdict"),
        ).alias("found"),
    )


def expressions(host: Column, path: Column, counts: list[int], lengths: list[int]) -> Column:
    """``host suffix + path prefix`` of a URL for these numbers of labels and lengths of the prefix."""
    labels = F.split(host, r"\.", -1)

    def known(values: list[Column]) -> Column:
        return F.array_compact(F.array(*values).cast("array<string>"))

    suffixes = known([F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in counts])
    prefixes = known([F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host != "", F.array_distinct(pairs))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    otherwise: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row."""
    lengths = [r.n for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    labels = F.size(F.split("host", r"\.", -1)).alias("n")
    counts = [r.n for r in rules.select(labels).distinct().orderBy("n").collect()]
    urls = pages.groupBy(col(id_col).alias("page_id"), col(url_col).alias("url")).agg(F.count("*").alias("rows"))
    host, path = parse_url(F.col("url"))
    parsed = urls.select("page_id", "url", "rows", host.alias("host"), path.alias("path"))
    expanded = parsed.select(
        "*", F.explode_outer(expressions(F.col("host"), F.col("path"), counts, lengths)).alias("expression")
    ).select("*", digest(F.col("expression")).alias("own"), short(digest(F.col("expression"))).alias("own_prefix"))
    met = expanded.join(hashed_rules(rules), F.col("own_prefix") == F.col("prefix"), "left")
    confirmed = F.when(F.col("own") == F.col("digest"), F.col("found"))
    best = met.groupBy("page_id", "url", "host", "path", "rows").agg(F.max(confirmed).alias("best"))
    judged = best.select(
        "page_id", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    )
    return judged.drop("copy")
