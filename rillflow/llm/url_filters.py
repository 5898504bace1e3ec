"""URL rules by hashed host-suffix and path-prefix expressions.

Each distinct URL is expanded into every pair of a host suffix (the host and its parent
domains) and a path prefix (of each length that some rule has). Expressions meet rules
in an equi-join on a short prefix of their digests; a match counts only once the full
digests agree, and the longest rule that fits wins. Everything runs on DataFrame
functions; URLs that occur many times are expanded once.

A null URL or one without ``://`` has an empty host and path and fits no rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import quoted

#: Hexadecimal digits of a digest that the join compares first.
SHORT = 8
#: Rules up to this number are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))


def _expressions(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    prefixes = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(
            host_suffixes(host),
            lambda h: F.transform(prefixes, lambda n: F.struct(h.alias("host"), F.substring(path, F.lit(1), n).alias("path"))),
        )
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row; ``rules`` are (host, path prefix, verdict).

    Of the rules that fit, the longest (host and path together, then host, then the
    rule's own text) decides; where none fits, ``default`` does.
    """
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, path, _ in rules}) or [0]
    rows = [(host, path, verdict) for host, path, verdict in dict.fromkeys(rules)]
    table = spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string").select(
        F.concat("rule_host", "rule_path").alias("rule"),
        F.length("rule_host").alias("rule_n_host"),
        "rule_verdict",
        _digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"),
    )
    table = table.withColumn("short", F.substring("rule_digest", 1, SHORT))
    urls = pages.select(F.col(quoted(url_col)).alias("url")).where(F.col("url").isNotNull()).distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where(F.col("host") != "")
    exprs = parts.select("url", F.explode(_expressions(F.col("host"), F.col("path"), lengths)).alias("e"))
    exprs = exprs.select("url", _digest(F.col("e.host"), F.col("e.path")).alias("digest"))
    exprs = exprs.withColumn("short", F.substring("digest", 1, SHORT))
    right = F.broadcast(table) if len(rows) <= BROADCAST_RULES else table
    fits = exprs.join(right, "short").where(F.col("digest") == F.col("rule_digest"))
    best = fits.groupBy("url").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule_n_host", "rule", "rule_verdict")).alias("best")
    )
    judged = best.select(F.col("url").alias("judged_url"), F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    page = pages.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(url_col)).alias("url"))
    return page.join(judged, page["url"] == judged["judged_url"], "left").select(
        F.col("_id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict")
    )
