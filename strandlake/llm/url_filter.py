"""URL rules by host-suffix and path-prefix expressions, joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hash on which expressions meet rules, before full digests are compared.
PREFIX_BITS = 32

#: Bytes of rules up to which they are broadcast; beyond, both sides are shuffled by hash prefix.
BROADCAST_BYTES = 16 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """The domains of so many labels that the host is or lies in."""
    own = [F.when(F.regexp_count(host, F.lit(r"\.")) >= n - 1, F.substring_index(host, ".", -n)) for n in labels]
    return F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_BITS // 4), 16, 10).cast("long")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of pages and _host, _path, _rule string (host and path of the rule, null for none), _verdict string;
    columns of pages with these names are replaced.

    rules: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with the rule's. The
    longest rule (host and path together) wins, of equal ones the longer host, then the smaller verdict; without a rule,
    `default`. Rules with a null are left out, repeated rules count once. A null url, or one without `://`, has an empty
    host and path. Verdicts are found once for each distinct host and path and joined back. Of hosts and paths only the
    suffixes and prefixes are made that have as many labels or characters as some rule.
    """
    added = ["_host", "_path", "_rule", "_verdict"]
    names = [c for c in pages.columns if c not in added]
    address = F.col(f"`{url}`")
    pages = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), url_host(address).alias("_host"), url_path(address).alias("_path"))
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").dropna().distinct()
    rules = rules.withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)).withColumn("short", _short(F.col("digest")))
    count = F.collect_set(F.regexp_count("rule_host", F.lit(r"\.")) + 1)
    size, lengths, labels = rules.agg(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 80), F.collect_set(F.length("rule_path")), count).first()
    places = pages.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_pages"))
    fitting = F.filter(F.array(*(F.lit(n) for n in sorted(lengths or [0]))), lambda n: n <= F.length("_path"))
    expressions = places.select("_host", "_path", F.explode(host_suffixes(F.col("_host"), sorted(labels))).alias("suffix"), fitting.alias("_n"))
    expressions = expressions.select("_host", "_path", "suffix", F.explode("_n").alias("_n"))
    expressions = expressions.select("_host", "_path", "suffix", F.expr("substring(_path, 1, _n)").alias("prefix"))
    expressions = expressions.withColumn("own", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256)).withColumn("own_short", _short(F.col("own")))
    small = F.broadcast(rules) if (size or 0) <= BROADCAST_BYTES else rules
    met = expressions.join(small, F.col("own_short") == F.col("short")).where((F.col("own") == F.col("digest")) & (F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")))
    rank = F.struct((-F.length("rule_host") - F.length("rule_path")).alias("a"), (-F.length("rule_host")).alias("b"), F.col("verdict").alias("c"))
    best = F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict"))
    won = met.groupBy(F.col("_host").alias("_h"), F.col("_path").alias("_p")).agg(F.min_by(best, rank).alias("_won"))
    out = pages.join(won, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")), "left")
    return out.select(*pages.columns, F.col("_won.rule").alias("_rule"), F.coalesce("_won.verdict", F.lit(default)).alias("_verdict")).toDF(*names, *added)
