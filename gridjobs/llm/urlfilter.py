"""URL rules by host-suffix and path-prefix expressions.

A rule is a host, a path and a verdict; it fits a URL on its host or a subdomain of it whose path starts with the rule's.
The longest fitting rule decides (host and path together; then the longer host; of equal rules ``block`` wins), and where
none fits the default verdict holds.

Every distinct (host, path) of the URLs is expanded into the concatenations of a host suffix and a path prefix: suffixes
start at the host's beginning and after each dot, prefixes are the empty one and those that end in a slash.  A rule is
indexed under its host and its path up to the last slash.  The first ``short`` hexadecimal digits of an expression's
SHA-256 meet those of the rules in an equi-join; what meets is confirmed by the full digest of the rule's host and whole
path.  Expansion goes only as deep as the deepest rule, which loses nothing and bounds what a URL of a million slashes
makes.  Rules are joined as Catalyst sizes them: a short list is broadcast by its measured size, a long one is shuffled.

Nulls: a null URL, or one without ``://``, has an empty host and path, which no rule with a host fits; a null id is kept.
Repeated rows each get their row, ties are decided as above, an empty table gives no rows, and columns of other names are
ignored whatever their names.  A rule with a null host is ignored, one with a null path has the empty path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table that Catalyst knows to be small."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, in ASCII lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(expression: str) -> Column:
    return F.expr(f"sha2({expression}, 256)")


def index_rules(rules: DataFrame, short: int) -> DataFrame:
    """Rules with the short hash they are looked up by, and the digest that confirms them."""
    rules = rules.where("host IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    rules = rules.withColumn("above", F.regexp_extract("rule_path", "(?s)^.*/", 0))
    return rules.select("*", F.left(digest("concat(rule_host, above)"), F.lit(short)).alias("short"), digest("concat(rule_host, rule_path)").alias("full"))


def expressions(urls: DataFrame, labels: int, slashes: int, short: int) -> DataFrame:
    """Rows (host, path, suffix, short) for each expression of at most so many host labels and slashes."""
    suffixes = f"transform(sequence(greatest(1, size(split(host, '[.]')) - {labels - 1}), size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, {labels}), '.'))"
    prefixes = f"transform(sequence(0, size(split(path, '/', {slashes + 1})) - 1), k -> concat(array_join(slice(split(path, '/', {slashes + 1}), 1, k), '/'), IF(k > 0, '/', '')))"
    each = urls.select("host", "path", F.expr(prefixes).alias("prefixes"), F.explode(F.expr(suffixes)).alias("suffix"))
    each = each.select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    return each.select("host", "path", "suffix", F.left(digest("concat(suffix, prefix)"), F.lit(short)).alias("short"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", short: int = 8) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each row of ``pages``; rules: host, path, verdict."""
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    index = index_rules(rules, short)
    deepest = index.agg(F.max(F.size(F.split("rule_host", "[.]"))), F.max(F.length("above") - F.length(F.replace("above", F.lit("/"), F.lit(""))))).first()
    labels, slashes = max(1, deepest[0] or 1), deepest[1] or 0
    met = expressions(urls.select("host", "path").distinct(), labels, slashes, short).join(index, "short")
    sure = met.where("startswith(path, above) AND full = sha2(concat(suffix, left(path, length(rule_path))), 256)")
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("best")
    chosen = sure.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.rule_verdict")
    return urls.join(chosen, ["host", "path"], "left").select("id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def op12_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"), rule_table(spark, RULES)).withColumnRenamed("id", "page_id")
