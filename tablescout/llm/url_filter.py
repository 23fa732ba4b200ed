"""URL filter: rules first, then the reputation of the host, shrunk through registered domain and suffix.

Labelled pages are good or bad.  Each host has a beta-binomial share of bad pages whose prior mean is the posterior
mean of its registered domain; the domain's prior is its suffix, the suffix's all pages together, and theirs is
uniform.  How strongly a level follows the one above (the concentration of its prior) is estimated from the data by
moments, pooled over all parents of the level.  A page without a rule is blocked if the lower bound of its host's
posterior share of bad pages is above ``LIMIT``.

Expressions, aggregates and joins only.  Outcomes are summed per host before they are shuffled, so a host with a
third of all pages is a row per task; three rows of sums reach the driver.

Defined cases: a null url or one without ``://`` has an empty host and path and is judged by the reputation of the
empty host.  Rows are judged one by one: repeated rows and null ids stay, and a labelled page counts as often as it
occurs.  Labels without an id or an outcome are left out; a page labelled both ways is bad.  Columns other than those
named are not read.  Of rules that fit, the longest text wins, then the longer host, then the earlier one.  Without
any labelled page every host has the uniform prior, which blocks nothing.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Registries below a country's label (fixed values); their names are registered one label further left.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp",
                      "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.za")
#: Width of the bound in standard deviations, and the share of bad pages that it must be above.
WIDTH, LIMIT = 1.645, 0.5
#: Concentration where the data cannot tell (no parent has two labelled children), and the range of estimates.
UNKNOWN, WEAKEST, STRONGEST = 10.0, 0.01, 1000.0

Rule = tuple[str, str, str]


def split_url(pages: DataFrame) -> DataFrame:
    """``page_id``, lower-cased ``host`` and ``path`` of every row."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select("page_id", F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"),
                        F.regexp_extract(url, pattern, 2).alias("path"))


def fits(host: str, path: str) -> Column:
    """The rule's host or a subdomain of it, and a path that starts like the rule's."""
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def with_rule(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule`` and ``action`` of the longest fitting rule, null where none fits; rules are ``(action, host, path)``.

    The list is configuration and becomes one expression; it is not meant for millions of entries.
    """
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in reversed(sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))):
        text = F.when(fits(host, path), F.lit(host + path)).otherwise(text)
        action = F.when(fits(host, path), F.lit(kind)).otherwise(action)
    return urls.withColumns({"rule": text, "action": action})


def with_domain(hosts: DataFrame) -> DataFrame:
    """``domain`` (registered) and ``suffix`` of each host, without user and port; an address is its own domain."""
    bare = F.regexp_replace(F.regexp_replace("host", r"(?s)^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    width = F.when(two.isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)
    last = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n))
    address = bare.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")
    return hosts.withColumns({"suffix": F.when(address, "").otherwise(last(width)), "domain": F.when(address, bare).otherwise(last(width + 1))})


def _spread(children: DataFrame, up: str, level: int) -> DataFrame:
    """Sums of the moment estimate over all parents ``up``: spread of the shares beyond chance, and what weights it."""
    per = children.where("n > 0").groupBy(up).agg(
        F.sum("n").alias("pn"), F.sum("k").alias("pk"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q"),
        F.sum((F.col("n") * F.col("n")).cast("double")).alias("n2"), (F.count(F.lit(1)) - 1).alias("more"))
    share = F.col("pk") / F.col("pn")
    chance = share * (1 - share)
    return per.agg(F.lit(level).alias("level"), F.sum("pn").alias("n"), F.sum("pk").alias("k"),
                   F.sum(F.col("q") - F.col("pk") * share - chance * F.col("more")).alias("beyond"),
                   F.sum(chance * (F.col("pn") - F.col("n2") / F.col("pn") - F.col("more"))).alias("weight"))


def concentration(beyond: float | None, weight: float | None) -> float:
    """Concentration of the prior of a level from the correlation of its outcomes within parents."""
    if not weight or weight <= 1e-9:
        return UNKNOWN
    correlation = beyond / weight
    if correlation <= 0:
        return STRONGEST
    return min(max(1 / correlation - 1, WEAKEST), STRONGEST)


def reputation(hosts: DataFrame) -> DataFrame:
    """``mean`` and lower ``bound`` of the posterior share of bad pages for every row of ``host, n, k``.

    ``n`` counts a host's labelled pages and ``k`` the bad ones among them; a host without any follows its domain.
    """
    named = with_domain(hosts)
    domains = named.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("top", F.lit(""))
    sums = _spread(suffixes, "top", 0).unionByName(_spread(domains, "suffix", 1)).unionByName(_spread(named, "domain", 2))
    found = {r.level: r for r in sums.collect()}
    strong = [concentration(found[i].beyond, found[i].weight) for i in range(3)]
    every = ((found[0].k or 0) + 1) / ((found[0].n or 0) + 2)

    def posterior(strength: float, prior: Column) -> Column:
        return (F.col("k") + prior * strength) / (F.col("n") + strength)

    by_suffix = suffixes.select("suffix", posterior(strong[0], F.lit(every)).alias("of_suffix"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", posterior(strong[1], F.col("of_suffix")).alias("of_domain"))
    mean = posterior(strong[2], F.col("of_domain"))
    out = named.join(by_domain, "domain").select("host", mean.alias("mean"), (F.col("n") + strong[2] + 1).alias("size"))
    return out.select("host", "mean", (F.col("mean") - WIDTH * F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("size"))).alias("bound"))


def host_counts(urls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, n, k``: labelled pages and bad ones among them for every host that occurs; ``outcomes`` has ``page_id, bad``."""
    labels = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    found = urls.join(labels, "page_id").select("host", F.lit(1).alias("n"), F.col("bad").alias("k"))
    return found.unionByName(urls.select("host", F.lit(0).alias("n"), F.lit(0).alias("k"))).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row, with the host's ``reputation`` and its ``bound``."""
    urls = split_url(pages)
    known = reputation(durable(host_counts(urls, outcomes)))
    method = F.when(F.col("bound") > LIMIT, "block").otherwise("allow")
    return with_rule(urls, rules).join(known, "host").select("page_id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"),
                                                             F.col("mean").alias("reputation"), "bound")
