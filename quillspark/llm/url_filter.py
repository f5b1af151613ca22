"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Only DataFrame functions are used. Each distinct URL is expanded into the concatenations of its host's suffixes (by label)
and its path's prefixes, as far as some rule has as many labels and as long a path. Expressions and rules are joined on the
first 32 bits of their SHA-256 digests; full digests confirm, and the longest confirmed rule gives the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_verdicts(pages: DataFrame, rules: DataFrame, url_column: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The kept columns with host, path, rule (host and path of the deciding rule, else null) and verdict.

    rules has host, path, verdict. A rule fits its host and all subdomains where the URL's path starts with the rule's; the
    longest fitting rule decides, of equal rules with several verdicts the last by name ("block" over "allow"). A URL that no
    rule fits gets the default. A null URL, and one without ://, has an empty host and path and the default. Equal URLs get
    equal rows, one for each row of pages; other columns of pages aren't read. With no rules all get the default.
    """
    pages = pages.select(*[F.col(c) for c in keep], F.col(url_column).alias("__url"))
    rules = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .withColumn("rule", F.concat("rule_host", "rule_path"))
    )
    # what the rules can fit: numbers of labels and lengths of paths, some small integers
    shape = rules.agg(F.max(F.size(F.split("rule_host", "\\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    labels, lengths = shape.labels or 1, sorted(shape.lengths)
    urls = pages.select("__url").where("__url IS NOT NULL").distinct()
    parts = urls.select("__url", F.split(host_of(F.col("__url")), "\\.").alias("labels"), path_of(F.col("__url")).alias("path"))
    n = F.size("labels")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - F.lit(labels - 1)), n), lambda i: F.array_join(F.slice("labels", i, n - i + 1), "."))
    prefixes = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda x: x <= F.length("path")), lambda x: F.substring(F.col("path"), F.lit(1), x))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    asked = parts.select("__url", F.explode(expressions).alias("expression")).withColumn("digest", F.sha2("expression", 256)).select("__url", "digest", F.left("digest", F.lit(8)).alias("short"))
    hashed = rules.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("short", F.left("rule_digest", F.lit(8)))
    decided = (
        asked.join(hashed, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("__url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))).alias("best"))
        .select(F.col("__url").alias("__decided"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return pages.join(decided, pages["__url"] == decided["__decided"], "left").select(
        *[F.col(c) for c in keep], host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
