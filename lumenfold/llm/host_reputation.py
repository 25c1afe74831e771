"""Empirical-Bayes host reputation (operator 6), DataFrame functions only.

A page's outcome is bad where its label says low quality or toxic. Bad shares of hosts
are shrunk through beta-binomial priors: the whole corpus to the suffix, the suffix to
the registered domain, the domain to the host. The strength of the prior on each level
comes from the spread of the shares of that level (method of moments). A host is blocked
where even the lower bound of its posterior share exceeds a threshold.

Explicit rules (host, path) come first; the longest rule that fits wins. A null url, or
one without `://`, has an empty host and path; it is judged like any host, by the prior.
Labels with null values don't count; repeated labels of a page count each, and repeated
pages are judged each. Without any label the corpus prior decides; with no pages the result
is empty. Other columns, whatever their names, aren't looked at.

Counts by host are made once and written; all levels and strengths come from that table. A
host with more than `CROWD` pages is joined back in `SALTS` parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, flag, lower_ascii, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


#: Second-level labels under which names are registered.
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac")
#: Strengths outside these bounds say that the shares of a level are too alike, or too few, to tell.
WEAKEST, STRONGEST = 1.0, 1000.0
Z, LIMIT = 1.645, 0.5
CROWD, SALTS = 1 << 18, 64


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host and path of url."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return pages.withColumns({"host": lower_ascii(host), "path": path})


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where the second to last is a registry's (co.uk)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    return F.when(two, F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1))).otherwise(F.get(labels, n - 1))


def domain_of(host: Column) -> Column:
    """The suffix with the label before it; the host itself where it has no more."""
    labels, suffix = F.split(host, r"\."), suffix_of(host)
    n, k = F.size(labels), F.size(F.split(suffix, r"\."))
    return F.when(n > k, F.concat_ws(".", F.get(labels, n - k - 1), suffix)).otherwise(host)


def _strength(groups: DataFrame) -> Column:
    """How many observations the prior over these groups is worth, as a scalar subquery."""
    mean = F.try_divide(F.sum("bad"), F.sum("n"))
    got = groups.filter("n > 0").agg(mean.alias("mu"), F.count("*").alias("g"), F.sum("n").alias("total"), F.sum((F.col("bad") / F.col("n")) * F.col("bad")).alias("ss"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
    # between-group variance by moments of the weighted shares
    within = F.col("mu") * (1 - F.col("mu"))
    between = F.try_divide(F.col("ss") - F.col("total") * F.col("mu") * F.col("mu") - (F.col("g") - 1) * within, F.col("total") - F.try_divide(F.col("nn"), F.col("total")) - (F.col("g") - 1))
    k = F.when(between > 0, F.try_divide(within, between) - 1).otherwise(F.lit(STRONGEST))
    return got.select(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.coalesce(k, F.lit(STRONGEST))))).scalar()


def host_posteriors(hosts: DataFrame) -> DataFrame:
    """hosts (host, n, bad; one row a host) -> host, share, bound.

    share: posterior mean of the bad share; bound: its lower bound at Z deviations.
    """
    named = hosts.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    p0 = suffixes.agg((F.sum("bad") + F.lit(1.0)) / (F.sum("n") + F.lit(2.0))).scalar()
    shrink = lambda strength, prior: (F.col("bad") + F.col(strength) * prior) / (F.col("n") + F.col(strength))
    s = suffixes.withColumn("k", _strength(suffixes)).select("suffix", shrink("k", p0).alias("ps"))
    d = domains.withColumn("k", _strength(domains)).join(s, "suffix").select("domain", shrink("k", F.col("ps")).alias("pd"))
    h = named.withColumn("k", _strength(named)).join(d, "domain")
    h = h.select("host", (F.col("bad") + F.col("k") * F.col("pd")).alias("a"), (F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("pd"))).alias("b"))
    total = F.col("a") + F.col("b")
    share = F.col("a") / total
    return h.select("host", share.alias("share"), (share - Z * F.sqrt(share * (1 - share) / (total + 1))).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], limit: float = LIMIT) -> DataFrame:
    """pages (page_id, url, ...), labels (page_id, bad boolean) ->
    page_id, url, host, path, rule, share, bound, verdict; row for row."""
    base = with_host_path(pages.select("page_id", "url"))
    # outcomes are summed by page first: the join is on the page, and a hot host is
    # summed on the map side
    per_page = labels.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    hosts = base.join(per_page, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pages"))
    hosts = written(hosts, "hosts")
    crowds = bit_filter(hosts.filter(F.col("pages") > CROWD), F.xxhash64("host"))
    dealt = lambda rows, salt: flag(rows, F.xxhash64("host"), crowds, "crowd").withColumn("salt", salt).drop("crowd")
    mine = dealt(base, F.when(F.col("crowd"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(0).cast("int"))
    known = dealt(host_posteriors(hosts), F.explode(F.when(F.col("crowd"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    scored = mine.join(known, ["host", "salt"])
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("bound") > limit, "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # a longer rule covers a shorter one
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith("/" + r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return scored.select("page_id", "url", "host", "path", rule.alias("rule"), "share", "bound", verdict.alias("verdict"))
