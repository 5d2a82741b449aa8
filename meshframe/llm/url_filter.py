"""URL filters: empirical-Bayes reputation of hosts, and fixed rules.

Labelled page outcomes (good or bad) are counted by host, registered domain and
suffix. Each level's beta prior has the mean of the level above and a strength
fitted by moments, so a host with few labels is shrunk to its domain, a domain to
its suffix, and a suffix to the whole table. A host without labels takes the posterior
of its domain, else of its suffix, else of the whole table. A page is blocked when the
posterior of its host says with confidence ``SURE`` that the rate of bad pages exceeds
``max_bad``, that is, when the beta posterior's lower quantile lies above it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Fixed values: (host, path, verdict); the longest fitting rule wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Public suffixes of more than one label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.cn", "co.in", "co.za", "com.mx")

#: How sure a posterior must be that a host is bad.
SURE = 0.95
#: Cells of the integral of a posterior, on each side of the threshold.
CELLS = 400


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without `://` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def registered_domain(host: Column, long_suffixes=LONG_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host. Suffixes have one label, but for
    ``long_suffixes`` (of two), which may be the whole of a public list."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last2 = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), 2))
    long = last2.isin(*long_suffixes) if long_suffixes else F.lit(False)
    suffix = F.when(long, last2).otherwise(F.element_at(labels, -1))
    keep = F.when(long, 3).otherwise(2)
    domain = F.concat_ws(".", F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), keep))
    return domain, suffix


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text (host and path) and its verdict, else null.

    Rules are literals: one expression a row and no join. A host of a rule fits
    itself and every subdomain."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _strength(counts: DataFrame, prior: Column) -> Column:
    """Strength of the beta prior by moments: what the spread of the groups' rates
    about the prior leaves after binomial noise; between 1 and 1000."""
    rate, n = F.col("bad") / F.col("n"), F.col("n")
    p = prior
    between = F.sum(n * (rate - p) * (rate - p)) - F.sum(p * (1 - p))
    within = F.sum((n - 1) * p * (1 - p))
    rho = F.when(within > 0, between / within)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.01)), F.lit(0.001)), F.lit(0.5))
    return 1 / rho - 1


def above(a: Column, b: Column, rate: float) -> Column:
    """Probability that a beta variable with parameters a and b exceeds ``rate``: its
    density over the log odds, summed at the middles of equal cells on either side."""
    cut = math.log(rate / (1 - rate))
    # the density's tails fall as exp(-a |u|) and exp(-b |u|) from its mode on
    mode = F.log(a / b)
    width = F.sqrt(1 / a + 1 / b)

    def log_density(u: Column) -> Column:
        bend = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
        return -a * bend(-u) - b * bend(u)

    top = log_density(mode)

    def side(reach: Column, sign: int) -> Column:
        step = reach / CELLS
        each = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.exp(log_density(cut + sign * step * (k + 0.5)) - top))
        return F.aggregate(each, F.lit(0.0), lambda t, x: t + x) * step

    low = side(F.greatest(cut - mode, F.lit(0.0)) + 9 * width + 30 / F.greatest(a, F.lit(1.0)) + F.when(a < 1, 30 / a).otherwise(0.0), -1)
    high = side(F.greatest(mode - cut, F.lit(0.0)) + 9 * width + 30 / F.greatest(b, F.lit(1.0)) + F.when(b < 1, 30 / b).otherwise(0.0), 1)
    return high / (low + high)


def reputations(outcomes: DataFrame, others: DataFrame | None = None, long_suffixes=LONG_SUFFIXES) -> DataFrame:
    """outcomes: host, bad (0/1), a row per labelled page. Returns a row per labelled
    host (host, domain, suffix, a, b): the beta posterior of its rate of bad pages; and
    one per further host of ``others`` (host): that of its domain, else of its suffix,
    else of the whole table, null when nothing is labelled.

    Counts combine before each shuffle, so one host with a third of all pages is a
    few rows. Rows with a null host or outcome count for nothing."""
    domain, suffix = registered_domain(F.col("host"), long_suffixes)
    hosts = stored(
        outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull())
        .groupBy("host").agg(F.sum(F.col("bad").cast("double")).alias("bad"), F.count("*").cast("double").alias("n"))
        .withColumn("domain", domain).withColumn("suffix", suffix)
    )
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    whole = suffixes.agg((F.sum("bad") + 0.5).alias("wbad"), (F.sum("n") + 1).alias("wn")).withColumn("p0", F.col("wbad") / F.col("wn"))

    def shrink(level: DataFrame, prior: DataFrame, on: list[str], name: str) -> DataFrame:
        """Posterior mean of each group of a level under its parent's mean."""
        joined = level.join(prior, on) if on else level.join(F.broadcast(prior))  # one row
        s = joined.agg(_strength(joined, F.col("p0")).alias("s")).select(F.coalesce("s", F.lit(1.0)).alias("s"))
        out = joined.join(F.broadcast(s))  # one row
        a, b = F.col("p0") * F.col("s") + F.col("bad"), (1 - F.col("p0")) * F.col("s") + F.col("n") - F.col("bad")
        return out.withColumn("a", a).withColumn("b", b).withColumn(name, a / (a + b))

    top = shrink(suffixes, whole.select("p0"), [], "p").select("suffix", F.col("p").alias("p0"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    mid = shrink(domains, top.select("suffix", "p0"), ["suffix"], "p").select("domain", "suffix", F.col("p").alias("p0"), F.col("a").alias("da"), F.col("b").alias("db"))
    labelled = shrink(hosts, mid.select("domain", "suffix", "p0"), ["domain", "suffix"], "p").select("host", "domain", "suffix", "a", "b")
    if others is None:
        return labelled
    rest = others.select("host").where("host is not null").distinct().join(hosts.select("host"), "host", "left_anti").withColumn("domain", domain).withColumn("suffix", suffix)
    above = rest.join(mid.drop("p0"), ["domain", "suffix"], "left").join(top.drop("p0"), "suffix", "left").join(F.broadcast(whole))  # one row
    a, b = F.coalesce("da", "sa", "wbad"), F.coalesce("db", "sb", F.col("wn") - F.col("wbad"))
    return labelled.unionByName(above.select("host", "domain", "suffix", a.alias("a"), b.alias("b")))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = 0.5, sure: float = SURE, long_suffixes=LONG_SUFFIXES) -> DataFrame:
    """pages: page_id, url. outcomes: page_id, bad (0/1). A row per page: page_id, host,
    path, rule (or null), verdict, bad_rate (posterior mean) and p_bad (probability that the
    rate exceeds ``max_bad``); both null for the empty host without labels.

    Repeated pages stay repeated rows; null and malformed urls have empty host and
    path, and are allowed unless their labels say otherwise: the empty host has no domain
    to judge it by. Other columns are dropped."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    one = outcomes.select("page_id", "bad").where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    table = reputations(seen.dropDuplicates(["page_id"]).join(one, "page_id").select("host", "bad"), seen.where("host <> ''"), long_suffixes)
    table = stored(table.select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"), above(F.col("a"), F.col("b"), max_bad).alias("p_bad")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("p_bad") > sure, "block").otherwise("allow")
    return seen.join(table, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "bad_rate", "p_bad"
    )
