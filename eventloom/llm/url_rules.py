"""Allow and block rules for URLs, matched by hashes of host-suffix and path-prefix expressions.

Only DataFrame functions: each distinct URL is expanded into ``host suffix + path prefix``
expressions, these are joined with the rules on a short prefix of their digest, the full
digests confirm, and the longest rule that fits decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8
#: host, path, verdict
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_of(url: Column) -> Column:
    """From behind the first :// to the next / ? # or the end, A-Z lower-cased; else empty."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host to the next ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Per row: page_id, host, path, rule and verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the
    path starts with its path; of several that fit, the longest host and path together
    wins, then the longer host, then ``block``. No rule: null, and the default verdict.
    A null URL or one without ``://`` has an empty host and path and fits no rule with a
    host. Repeated rows each get their answer; repeated rules count once.

    Expressions are made only of suffixes with as many labels and prefixes of as many
    characters as some rule has: two scalar subqueries over the rules give these small sets.
    """
    lengths = rules.agg(F.collect_set(F.length("path"))).scalar()
    labels = rules.agg(F.collect_set(F.size(F.split("host", r"\.")))).scalar()
    digest = F.sha2(F.col("expression"), 256)
    hashed = (
        rules.select(
            F.concat("host", F.lit("\n"), "path").alias("expression"), F.concat("host", "path").alias("rule"),
            F.length("host").alias("host_length"), "verdict",
        )
        .distinct()
        .withColumn("digest", digest)
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
        .drop("expression")
    )
    urls = pages.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    parts = urls.select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        lengths.alias("lengths"), labels.alias("labels"),
    )
    words = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter("labels", lambda n: n <= F.size(words)),
        lambda n: F.array_join(F.slice(words, F.size(words) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    expressions = (
        parts.select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("url", "suffix", F.explode("prefixes").alias("prefix"))
        .select("url", F.concat("suffix", F.lit("\n"), "prefix").alias("expression"))
        .select("url", digest.alias("full"), F.substring(digest, 1, PREFIX_HEX).alias("short"))
    )
    fitting = expressions.join(hashed, "short").where(F.col("full") == F.col("digest"))
    order = F.struct(F.length("rule"), "host_length", F.col("verdict") == "block")
    judged = fitting.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).join(judged, "url", "left")
    return found.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
