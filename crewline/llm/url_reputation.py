"""URL filters: fixed rules first, then empirical-Bayes host reputation (DataFrame functions only).

Every url is cut into ``host`` (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased) and ``path`` (from there up to ``?``, ``#`` or the end); a null url or one without ``://``
has both empty. A rule (host, path) fits a url when the url's host is the rule's host or one of its
subdomains and the url's path starts with the rule's path; of the rules that fit, the longest rule string
``host + path`` wins, and of two equally long ones ``block`` wins. The winning rule gives the verdict.

Pages without a fitting rule are judged by the method. The labelled outcomes are the pages that a rule
decides (1 for block, 0 for allow). Their counts are shrunk through three levels: a host's rate towards
its registered domain (the last two labels), the domain's towards its suffix (the last label), the
suffix's towards the rate of all labelled pages. Each level's prior is a beta distribution whose mean is
the parent's posterior mean and whose strength is estimated from the data by the method of moments on
the spread of the children's rates around their parents (beta-binomial: E[n (r - m)^2] = m (1 - m)
(1 + (n - 1) rho), strength = 1 / rho - 1), clamped to [``STRENGTH_MIN``, ``STRENGTH_MAX``], and
``STRENGTH_DEFAULT`` where the spread tells nothing, and never above the parent's posterior strength
(its prior strength plus its labelled pages; all labelled pages plus two at the top), so that a host
without labels is no surer than its domain. A page is blocked when the lower bound of its host's
posterior bad rate, mean - ``Z`` * sd, reaches ``BOUND``.

Nulls and edge cases: a null url judges like a url without ``://`` (empty host, no rule, the global
posterior); an empty table gives an empty result; repeated rows are judged each and counted each as a
labelled outcome; very long urls are cut by the same functions; extra columns are ignored (only
``page_id`` and ``url`` are read). The five rules are expressions of each row; the reputation is one grouping
by host with partial aggregation; hosts are few against pages, and the host table is joined back
salted by ``SALT`` buckets, so a host with a third of all pages is spread over that many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crewline.llm.common import materialize

# Fixed values of the contract: the rules (verdict, host, path), in the order given.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

Z = 1.645
BOUND = 0.5
STRENGTH_DEFAULT = 10.0
STRENGTH_MIN = 1.0
STRENGTH_MAX = 1000.0
SALT = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path`` as the module docstring defines them."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.expr(f"substr(coalesce(`{url}`, ''), locate('://', coalesce(`{url}`, '')) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", host).withColumn("path", path)


def ruled(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path, rule, rule_verdict`` (both null where no rule fits); one row per input row.

    The rules are a fixed list, so they are expressions of each row: no join and no shuffle.
    """
    split = split_url(pages.select("page_id", "url"))
    host, path = F.col("host"), F.col("path")
    fitting = [
        F.when(
            ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path),
            F.struct(
                F.lit(len(rule_host + rule_path)).alias("size"),
                F.lit(verdict == "block").alias("block"),
                F.lit(rule_host + rule_path).alias("rule"),
                F.lit(verdict).alias("verdict"),
            ),
        )
        for verdict, rule_host, rule_path in RULES
    ]
    best = F.array_max(F.filter(F.array(*fitting), lambda r: r.isNotNull()))
    return split.withColumn("best", best).select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def _labels(host: Column) -> tuple[Column, Column]:
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    domain = F.when(n >= 2, F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2), ".")).otherwise(host)
    suffix = F.element_at(parts, -1)
    return domain, suffix


def _strength(children: DataFrame, n: str, bad: str, mean: str) -> float:
    """Prior strength of a level from its children's spread (method of moments), clamped."""
    rate = F.col(bad) / F.col(n)
    var = F.col(mean) * (1 - F.col(mean))
    row = (
        children.where(F.col(n) > 0)
        .agg(
            F.sum(F.col(n) * (rate - F.col(mean)) ** 2).alias("s"),
            F.sum(var).alias("v"),
            F.sum(var * (F.col(n) - 1)).alias("w"),
        )
        .first()
    )
    s, v, w = (row["s"], row["v"], row["w"]) if row else (None, None, None)
    if not w or s is None:
        return STRENGTH_DEFAULT
    rho = (s - v) / w
    if rho <= 0:
        return STRENGTH_MAX
    return float(min(STRENGTH_MAX, max(STRENGTH_MIN, 1.0 / rho - 1.0)))


def reputations(judged: DataFrame) -> DataFrame:
    """Per host: labelled counts, prior mean and strength, posterior mean, sd and lower bound."""
    domain, suffix = _labels(F.col("host"))
    hosts = judged.groupBy("host").agg(
        F.count("rule_verdict").cast("double").alias("n"),
        F.sum(F.when(F.col("rule_verdict") == "block", 1).otherwise(0)).cast("double").alias("bad"),
    )
    # One row per host, written once: the level tables and their strengths are read from it.
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n_all, bad_all = (total["n"] or 0.0), (total["bad"] or 0.0)
    top = (bad_all + 1.0) / (n_all + 2.0)

    # A prior is never surer than its parent's posterior: strengths are capped by the parent's, plus counts.
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("mean", F.lit(top))
    k = _strength(suffixes, "n", "bad", "mean")
    sure = F.least(F.lit(k), F.lit(n_all + 2.0))
    suffixes = suffixes.select("suffix", ((F.lit(top) * sure + F.col("bad")) / (sure + F.col("n"))).alias("suffix_mean"), (sure + F.col("n")).alias("suffix_sure"))

    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    k = _strength(domains.withColumn("mean", F.col("suffix_mean")), "n", "bad", "mean")
    sure = F.least(F.lit(k), F.col("suffix_sure"))
    domains = domains.select("domain", "suffix", ((F.col("suffix_mean") * sure + F.col("bad")) / (sure + F.col("n"))).alias("domain_mean"), (sure + F.col("n")).alias("domain_sure"))

    hosts = hosts.join(domains, ["domain", "suffix"])
    k = _strength(hosts.withColumn("mean", F.col("domain_mean")), "n", "bad", "mean")
    sure = F.least(F.lit(k), F.col("domain_sure"))
    alpha = F.col("domain_mean") * sure + F.col("bad")
    beta = (1 - F.col("domain_mean")) * sure + F.col("n") - F.col("bad")
    total = alpha + beta
    mean = alpha / total
    sd = F.sqrt(alpha * beta / (total * total * (total + 1)))
    return hosts.select("host", "n", "bad", F.col("domain_mean").alias("prior_mean"), sure.alias("strength"), mean.alias("bad_rate"), (mean - Z * sd).alias("lower"))


def judge(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, bad_rate, lower``: one row per input row."""
    judged = ruled(pages)
    hosts = reputations(judged)
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT))
    spread = hosts.select("host", "bad_rate", "lower", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    out = judged.withColumn("salt", salt).join(spread, ["host", "salt"], "left")
    method = F.when(F.col("lower") >= BOUND, "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "bad_rate", "lower")
