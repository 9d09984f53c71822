"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Reputation shrinks labelled page outcomes through nested beta-binomial priors: the corpus is the
prior of a suffix, a suffix that of a registered domain, a domain that of a host. A prior's mean
leaves out the outcomes of the very suffix, domain or host that it is for. Its strength, in
pseudo-outcomes, is estimated at each level by the method of moments: the spread of the observed
rates about their priors beyond what binomial noise explains gives the correlation rho of a
level, and 1 / rho - 1 is the strength. A host's posterior is a beta distribution; the host is
blocked where its rate of bad outcomes exceeds LIMIT with probability CONFIDENCE, that is where
the lower posterior quantile lies above LIMIT.

Only native expressions. Pages are pre-aggregated to one row a host before any join; the join back
is a left join on the host that adaptive execution splits where one host holds most pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import ascii_lower

#: Strengths stay within these; USUAL stands in where no level's outcomes tell one.
LEAST, MOST, USUAL = 1.0, 1000.0, 20.0
LIMIT = 0.5
CONFIDENCE = 0.95
#: The posterior is integrated in steps of STEP standard deviations of the log-odds, REACH steps a side.
STEP, REACH = 0.25, 160
#: Second-level labels that make a two-label suffix under a country code.
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "ac", "edu")

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Of equally
    long rules the one listed first counts.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def site_parts(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without user, port and trailing dots.

    The suffix is the last label, or the last two where the last is a two-letter code and the one
    before is in SECOND_LEVEL. A host with no label before its suffix, or an IPv4 address, is its
    own domain.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*)?\.*$", "")
    suffix = F.regexp_extract(bare, r"((?:(?<=\.|^)(?:%s)\.[a-z]{2})|[^.]*)$" % "|".join(SECOND_LEVEL), 1)
    number = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    domain = F.regexp_extract(bare, r"([^.]+\.(?:(?:%s)\.[a-z]{2}|[^.]+))$" % "|".join(SECOND_LEVEL), 1)
    return F.when(number | (domain == ""), bare).otherwise(domain), F.when(number, F.lit("")).otherwise(suffix)


def strength(children: DataFrame, n: str, bad: str, prior: str, name: str) -> DataFrame:
    """One row: the strength of the priors of children, by moments."""
    mean, size = F.col(prior), F.col(n).cast("double")
    noise = mean * (1 - mean)
    spread = size * (F.col(bad) / size - mean) * (F.col(bad) / size - mean)
    sums = children.where(F.col(n) > 0).agg(F.sum(spread - noise).alias("over"), F.sum(noise * (size - 1)).alias("room"))
    rho = F.when(F.col("room") > 0, F.greatest(F.lit(1 / (MOST + 1)), F.least(F.col("over") / F.col("room"), F.lit(1 / (LEAST + 1)))))
    return sums.select(F.coalesce(1 / rho - 1, F.lit(USUAL)).alias(name))


def exceeds(a: Column, b: Column, limit: float = LIMIT) -> Column:
    """Probability that a Beta(a, b) variable exceeds limit, by Simpson's rule on its log-odds.

    Steps follow the standard deviation of the log-odds, from the limit to both sides; where the
    limit lies over 8 deviations from the mode, the answer is 1 or 0.
    """
    cut = F.log(F.lit(limit / (1 - limit)))
    mode, deviation = F.log(a / b), F.sqrt(1 / a + 1 / b)
    soft = lambda t: F.greatest(t, F.lit(0.0)) + F.log(1 + F.exp(-F.abs(t)))  # noqa: E731  ln(1 + e^t)

    def side(sign: int) -> Column:
        def step(total: Column, k: Column) -> Column:
            t = cut + deviation * (sign * STEP) * k
            weight = F.when((k == 0) | (k == REACH), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
            return total + weight * F.exp(a * (t - mode) - (a + b) * (soft(t) - soft(mode)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(REACH)), F.lit(0.0), step)

    z = (cut - mode) / deviation
    above, below = side(1), side(-1)
    return F.when(z < -8, 1.0).when(z > 8, 0.0).otherwise(above / (above + below))


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, bad, rate, over, blocked: one row for each host of pages(page_id, host).

    outcomes: page_id, bad (0 or 1); null ids or values are ignored, and of repeated ids the worst
    outcome counts. A host without outcomes has its domain's prior. over: the posterior
    probability that its rate exceeds LIMIT.
    """
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    domain, suffix = site_parts(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    whole = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("wn"), F.coalesce(F.sum("sb"), F.lit(0)).alias("wb"))
    # `whole` and the strengths are single rows, so each is a broadcast of one or two numbers.
    one = lambda df, row: df.crossJoin(F.broadcast(row))
    suffixes = one(suffixes, whole).withColumn("s_prior", (F.col("wb") - F.col("sb") + 0.5) / (F.col("wn") - F.col("sn") + 1.0))
    suffixes = one(suffixes, strength(suffixes, "sn", "sb", "s_prior", "s_strength"))
    shrunk = lambda bad, own_bad, n, own_n, k, prior: (F.col(bad) - F.col(own_bad) + F.col(k) * F.col(prior)) / (F.col(n) - F.col(own_n) + F.col(k))
    domains = domains.join(suffixes, "suffix").withColumn("d_prior", shrunk("sb", "db", "sn", "dn", "s_strength", "s_prior"))
    domains = one(domains, strength(domains, "dn", "db", "d_prior", "d_strength")).select("domain", "suffix", "dn", "db", "d_prior", "d_strength")
    hosts = hosts.join(domains, ["domain", "suffix"]).withColumn("h_prior", shrunk("db", "bad", "dn", "n", "d_strength", "d_prior"))
    hosts = one(hosts, strength(hosts, "n", "bad", "h_prior", "h_strength"))
    # Half an outcome of each kind more keeps the integral away from the ends.
    hosts = hosts.withColumns({"a": F.col("bad") + F.col("h_strength") * F.col("h_prior") + 0.5, "b": F.col("n") - F.col("bad") + F.col("h_strength") * (1 - F.col("h_prior")) + 0.5})
    over = exceeds(F.col("a"), F.col("b"))
    return hosts.select("host", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), over.alias("over")).withColumn("blocked", F.col("over") >= CONFIDENCE)


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url).

    Null urls and urls without :// have empty host and path; an empty host is never blocked by
    reputation. Repeated rows, and rows with a null page_id (which have no outcome), each get their
    verdict; an empty table gives no row. Of equally long rules the first counts. Other columns
    are not read.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    blocked = host_reputation(parts.select("page_id", "host"), outcomes).where("blocked and host <> ''").select("host", F.lit(True).alias("blocked"))
    out = parts.join(blocked, "host", "left")
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
