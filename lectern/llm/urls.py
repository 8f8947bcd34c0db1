"""Operator 4: URL filter rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    rest = F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.regexp_replace(url, "(?s)^.*?://", "")).otherwise("")
    return lower_ascii(F.regexp_extract(rest, "(?s)^[^/?#]*", 0)), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", hash_bytes: int = 4) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    rules: host, path, verdict.  A rule fits its host and all subdomains if the page's path starts with
    the rule's; the longest (host and path together, then host) wins, and of equal rules block wins.
    Without a fitting rule, or with a url that is null or has no ``://`` (host and path are then empty),
    rule is null and verdict is default.  Rules whose host is null or empty are ignored; a null path is
    empty, and rule hosts are compared in lower case without a leading dot.  Repeated pages keep their
    rows; an empty table of pages gives an empty result; other columns are ignored.

    A distinct host and path is expanded into host suffixes (of no more labels than rules have) times path prefixes (of the lengths that
    rules have), which meet the rules in an equi-join on the first bytes of a SHA-256 digest; the whole
    digest and text are confirmed after it.  Spark broadcasts the rules where its size threshold allows.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    wanted = (
        rules.select(F.regexp_replace(lower_ascii(F.col("host")), "^\\.", "").alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), F.col("verdict").alias("rv"))
        .where("rh <> ''")
        .groupBy("rh", "rp")
        .agg(F.max("rv").alias("rv"))  # of allow and block, block
    )
    text = F.concat(F.col("rh"), F.lit("\n"), F.col("rp"))
    wanted = wanted.withColumn("digest", F.sha2(text, 256)).withColumn("short", F.substring("digest", 1, 2 * hash_bytes))
    # one number for each length of path, and the most labels of a host: longer suffixes fit no rule
    lengths, most = wanted.agg(F.sort_array(F.collect_set(F.length("rp"))), F.coalesce(F.max(F.size(F.split("rh", "\\."))), F.lit(0))).first()

    labels = F.split(F.col("host"), "\\.")  # of a long host, those that a suffix can hold
    parts = F.slice(labels, F.greatest(F.size(labels) - most + 1, F.lit(1)), F.lit(max(1, most)))
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    prefixes = F.array_distinct(F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k)))
    expressions = (
        seen.select("host", "path").where("host <> ''").distinct()
        .select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps"))
        .select("host", "path", "h", F.explode("ps").alias("p"))
        .withColumn("full", F.sha2(F.concat(F.col("h"), F.lit("\n"), F.col("p")), 256))
    )
    hits = (
        expressions.join(wanted, F.substring("full", 1, 2 * hash_bytes) == F.col("short"))
        .where((F.col("full") == F.col("digest")) & (F.col("h") == F.col("rh")) & (F.col("p") == F.col("rp")))
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("nh"), F.col("rv"), F.concat("rh", "rp").alias("rule"))).alias("best"))
        .select(F.col("host").alias("fh"), F.col("path").alias("fp"), "best.rule", "best.rv")
    )
    return seen.join(hits, (F.col("host") == F.col("fh")) & (F.col("path") == F.col("fp")), "left").select("page_id", "host", "path", "rule", F.coalesce("rv", F.lit(default)).alias("verdict"))
