"""URL filters: fixed rules, else the host's reputation by empirical Bayes, in DataFrame functions.

Labelled outcomes of pages are summed by host, registered domain and suffix. Each level's mean is
shrunk to that of the level above by a beta-binomial prior, whose strength is fitted by moments to
how far the groups of the level differ. A host is blocked when even the upper bound of its posterior is low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Second-level labels under which domains are registered.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
CUT, DEVIATIONS = 0.5, 1.645


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://``, A-Z lower-cased, and the path; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def registered_domain(host: Column) -> Column:
    """The last two labels, or three under a second-level suffix of a country; addresses stay whole."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    country = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(*SECOND)
    last = F.when(country, 3).otherwise(2)
    return F.when((n <= 2) | host.rlike(r"^[0-9.]+$"), host).otherwise(F.array_join(F.slice(parts, -last, last), "."))


def suffix_of(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.substring_index(domain, ".", -1)).otherwise("")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equally long rules one that blocks."""
    rule = verdict = None
    for kind, top, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(start)
        rule = F.when(fits, top + start).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, kind).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return rule, verdict


def _shrunk(level: DataFrame, name: str) -> DataFrame:
    """Adds the mean of each group's posterior; ``level`` has ``n, good`` and the parent's mean ``prior``."""
    p = F.col("prior")
    excess = F.sum(F.pow(F.col("good") - F.col("n") * p, 2) / (p * (1 - p))) - F.sum("n")
    pairs = F.sum(F.col("n") * (F.col("n") - 1))
    spread = level.agg(F.try_divide(excess, pairs).alias("s")).select(F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce("s", F.lit(0.001)))).alias("s"))
    return (
        level.crossJoin(F.broadcast(spread))  # one row
        .withColumn("strength", (1 - F.col("s")) / F.col("s"))
        .withColumn(name, (F.col("good") + F.col("strength") * p) / (F.col("n") + F.col("strength")))
        .drop("s")
    )


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, upper``: an upper bound of the share of good pages, from ``page_id, host`` and ``page_id, good, n``."""
    hosts = (
        pages.join(labels, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
        .withColumn("domain", registered_domain(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("domain")))
    )
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("prior"))
    of_suffix = _shrunk(suffixes.crossJoin(F.broadcast(whole)), "of_suffix").select("suffix", F.col("of_suffix").alias("prior"))
    of_domain = _shrunk(domains.join(of_suffix, "suffix"), "of_domain").select("domain", F.col("of_domain").alias("prior"))
    of_host = _shrunk(hosts.join(of_domain, "domain"), "mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return of_host.select("host", (F.col("mean") + DEVIATIONS * deviation).alias("upper"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, cut: float = CUT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per page.

    ``labels`` has ``doc_id, quality``: an outcome of the page with that id. Without any label of its
    host a page is judged by its domain, suffix and all pages. Null urls, or ones without ``://``, have an
    empty host and path. Null page ids have no label, null labels do not count, repeated rows count as often as they occur.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    outcome = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("page_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quality").cast("long")).alias("good"))
    )
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    upper = reputation(seen.select("page_id", "host"), outcome)
    learned = F.when(F.col("upper") < cut, "block").otherwise("allow")
    return seen.join(upper, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"))
