"""URL filters: rules first, else an empirical-Bayes reputation of hosts, with DataFrame functions only.

Pages that a rule judges are the labelled outcomes (block is 1). Block rates are shrunk from suffix to registered domain to
host: at each level a group's rate is a beta-binomial posterior whose prior has the mean of the level above, and a strength
that the ANOVA estimate of the level's intra-class correlation gives. A page without a rule is blocked when the lower
posterior bound of its host's rate (mean less z standard deviations) is over 1/2, else allowed.

Null urls and those without :// have host and path "" and, without labels there, get the corpus-wide prior. Repeated pages
count each. No pages give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
Z, LEAST_RHO = 1.645, 0.01
TWO_LEVEL = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages' page_id with host, path, rule and the rule's verdict (null: no rule fits)."""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p) for h, p, _ in ordered]

    def first(values):
        return F.coalesce(*(F.when(fit, F.lit(v)) for fit, v in zip(fits, values, strict=True))) if fits else F.lit(None).cast("string")

    return rows.withColumn("rule", first([h + p for h, p, _ in ordered])).withColumn("ruled", first([v for _, _, v in ordered]))


def levels(host):
    """(registered domain, suffix) of a host."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*TWO_LEVEL)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def strength(groups: DataFrame) -> float:
    """Pseudo-counts of the prior over groups (n, b): 1 / rho - 1, with rho's ANOVA estimate kept in [LEAST_RHO, 1 - LEAST_RHO]."""
    r = groups.where("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("b") * F.col("b") / F.col("n")).alias("bbn"),
    ).first()
    rho = LEAST_RHO
    if r.g > 1 and r.n > r.g:
        between = (r.bbn - r.b * r.b / r.n) / (r.g - 1)
        inside = (r.b - r.bbn) / (r.n - r.g)
        size = (r.n - r.nn / r.n) / (r.g - 1)
        if (below := between + (size - 1) * inside) > 0:
            rho = (between - inside) / below
    return 1 / min(max(rho, LEAST_RHO), 1 - LEAST_RHO) - 1


def reputations(marked: DataFrame, z: float = Z) -> DataFrame:
    """(host, bound): the lower posterior bound of each host's block rate."""
    domain, suffix = levels(F.col("host"))
    hosts = cut(
        marked.groupBy("host").agg(F.count("ruled").cast("double").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).cast("double").alias("b"))
        .withColumn("domain", domain).withColumn("suffix", suffix)
    )
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    domains = total(hosts, "domain", "suffix")
    suffixes = total(domains, "suffix")
    everything = hosts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    mean = ((everything.b or 0) + 0.5) / ((everything.n or 0) + 1)
    of_suffix, of_domain, of_host = map(strength, (suffixes, domains, hosts))
    shrunk = lambda k, prior: (F.col("b") + k * prior) / (F.col("n") + k)
    by_suffix = suffixes.select("suffix", shrunk(of_suffix, F.lit(mean)).alias("above"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", shrunk(of_domain, F.col("above")).alias("prior"))
    alpha = F.col("b") + of_host * F.col("prior")
    beta = F.col("n") - F.col("b") + of_host * (1 - F.col("prior"))
    both = alpha + beta
    bound = alpha / both - z * F.sqrt(alpha * beta / (both * both * (both + 1)))
    return hosts.join(by_domain, ["domain", "suffix"]).select("host", bound.alias("bound"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; the verdict is the rule's, else that of the host's bound."""
    marked = judged(pages, rules)
    method = F.when(F.col("bound") > 0.5, "block").otherwise("allow")
    return marked.join(reputations(marked), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


def op5_url_reputation(spark, sf_dir: str) -> DataFrame:
    """A verdict on every page."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in ordered) + " END"
    longs = ", ".join(f"'{x}'" for x in TWO_LEVEL)
    strong = lambda t: f"""(SELECT 1 / least(greatest(CASE WHEN g > 1 AND n > g AND below > 0 THEN (between_ - inside) / below ELSE {LEAST_RHO} END, {LEAST_RHO}), 1 - {LEAST_RHO}) - 1
  FROM (SELECT *, between_ + (size - 1) * inside AS below FROM (SELECT g, n, (bbn - b * b / n) / nullif(g - 1, 0) AS between_, (b - bbn) / nullif(n - g, 0) AS inside, (n - nn / n) / nullif(g - 1, 0) AS size
  FROM (SELECT count(*)::DOUBLE AS g, sum(n) AS n, sum(b) AS b, sum(n * n) AS nn, sum(b * b / n) AS bbn FROM {t} WHERE n > 0))))"""  # noqa: E731
    return f"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
marked AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS ruled FROM parts),
counted AS (SELECT host, count(ruled)::DOUBLE AS n, count(CASE WHEN ruled = 'block' THEN 1 END)::DOUBLE AS b, string_split(host, '.') AS l FROM marked GROUP BY host),
hosts AS (SELECT host, n, b, CASE WHEN two IN ({longs}) THEN array_to_string(l[-3:], '.') ELSE two END AS domain, CASE WHEN two IN ({longs}) THEN two ELSE l[-1] END AS suffix FROM (SELECT *, array_to_string(l[-2:], '.') AS two FROM counted)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY ALL),
k AS (SELECT {strong('suffixes')} AS ks, {strong('domains')} AS kd, {strong('hosts')} AS kh, (SELECT (sum(b) + 0.5) / (sum(n) + 1) FROM hosts) AS mean),
by_suffix AS (SELECT suffix, (b + ks * mean) / (n + ks) AS above FROM suffixes, k),
by_domain AS (SELECT domain, suffix, (b + kd * above) / (n + kd) AS prior FROM domains JOIN by_suffix USING (suffix), k),
ab AS (SELECT host, b + kh * prior AS a, n - b + kh * (1 - prior) AS z FROM hosts JOIN by_domain USING (domain, suffix), k),
bounds AS (SELECT host, a / (a + z) - {Z} * sqrt(a * z / ((a + z) * (a + z) * (a + z + 1))) AS bound FROM ab)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM marked LEFT JOIN bounds USING (host)"""


OP5_SQL = _oracle()
