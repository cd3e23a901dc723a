"""Host reputation by empirical Bayes and explicit url rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.rows import stored

TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "co.in", "co.za", "com.cn")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; null or without ``://`` both are empty."""
    rest = F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([\s\S]*)$", 1), F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def suffix_of(host: Column) -> Column:
    """Public suffix: one of TWO_PART_SUFFIXES or the last label. Domain: suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def shrink(groups: DataFrame, parent_mean: Column) -> DataFrame:
    """Beta-binomial shrinkage of (n, bad) towards ``parent_mean``.

    The prior's strength k is fitted to the level by moments: rho is the share of variance between groups beyond the binomial
    one and k = 1 / rho - 1, kept within 1 and 9,999. Adds ``mean`` and ``strength`` (k + n). The fit is one aggregated row, the
    only thing that reaches the driver. No groups: no rows.
    """
    g = groups.withColumn("_p", parent_mean)
    pq = F.col("_p") * (1 - F.col("_p"))
    fit = g.agg(
        F.sum((F.col("bad") - F.col("n") * F.col("_p")) * (F.col("bad") - F.col("n") * F.col("_p")) - F.col("n") * pq).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * pq).alias("room"),
    ).first()
    rho = max(1e-4, min(0.5, fit["over"] / fit["room"])) if fit["room"] and fit["room"] > 0 else 0.5
    k = F.lit(1 / rho - 1)
    return g.withColumn("mean", (F.col("bad") + k * F.col("_p")) / (F.col("n") + k)).withColumn("strength", F.col("n") + k).drop("_p")


def host_reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posterior bad rates of hosts, domains, suffixes and overall from ``outcomes`` (host, bad 0 / 1; null outcomes do not count).

    The suffix shrinks towards the overall rate, the domain towards its suffix, the host towards its domain. Every step is a
    grouped count with map-side combine over the step before, so a host with a third of all rows costs one row per task.
    """
    host = (
        outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    )
    host = stored(host, "hosts")  # counted once, fitted level by level
    domain = host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffix.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("overall")).first()["overall"]
    suffix = shrink(suffix, F.lit(overall)).select("suffix", F.col("mean").alias("suffix_mean"), F.col("strength").alias("suffix_strength"))
    domain = shrink(domain.join(suffix, "suffix"), F.col("suffix_mean")).select("domain", F.col("mean").alias("domain_mean"), F.col("strength").alias("domain_strength"))
    host = shrink(host.join(domain, "domain"), F.col("domain_mean"))
    return host.select("host", F.col("mean").alias("host_mean"), F.col("strength").alias("host_strength")), domain, suffix, overall


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Longest fitting rule as struct (rule, verdict) or null. A rule ``host/path`` fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = 0.5, z: float = 1.645,
               page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict per page: the longest rule's, else ``block`` where the lower posterior bound of the host's bad rate exceeds ``limit``.

    ``outcomes``: (page_id, bad) of labelled pages; several labels of a page all count. A host without labelled pages takes its
    domain's posterior, then its suffix's, then the overall one. Bound: mean - z * sqrt(mean * (1 - mean) / (strength + 1)).
    Null url or one without ``://``: empty host and path, no rule, judged as host ''. Rows are kept one for one, repeated and
    null page ids too (these have no outcome). Empty tables: no rows, or every page judged by the prior.
    """
    host, path = url_parts(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    labelled = p.where(F.col("page_id").isNotNull()).join(outcomes.select(F.col("page_id"), F.col("bad")), "page_id")
    hosts, domains, suffixes, overall = host_reputation(labelled.select("host", "bad"))
    seen = p.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    rated = (
        seen.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
        .select("host", F.coalesce("host_mean", "domain_mean", "suffix_mean", F.lit(overall)).alias("m"),
                F.coalesce("host_strength", "domain_strength", "suffix_strength", F.lit(1.0)).alias("s"))
        .select("host", F.round("m", 6).alias("bad_rate"), F.round(F.col("m") - z * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("s") + 1)), 6).alias("lower_bound"))
    )
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return p.join(rated, "host").withColumn("_rule", rule).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("lower_bound") > limit, "block").otherwise("allow")).alias("verdict"),
        "bad_rate", "lower_bound",
    )
