"""Judging pages by rules and by the reputation of their host."""

import math

import pytest
from pyspark.sql import functions as F

from tablescout.llm import url_filter
from tablescout.llm.queries import URL_RULES

URL = "page_id long, url string, host string, `n` string, k int"


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:end]


def brute_rule(host, path, rules):
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    return (None, None) if best is None else (best[1] + best[2], best[0])


def brute_domain(host):
    bare = host.rsplit("@", 1)[-1]
    head, colon, port = bare.rpartition(":")
    bare = head if colon and (port == "" or port.isdigit()) else bare
    labels = bare.split(".")
    if len(labels) == 4 and all(x.isdigit() for x in labels):
        return "", bare
    width = 2 if ".".join(labels[-2:]) in url_filter.TWO_LABEL_SUFFIXES else 1
    return ".".join(labels[-width:]), ".".join(labels[-width - 1:])


def brute_strength(children):
    """``children``: parent to its children's (n, k)."""
    beyond = weight = 0.0
    for rows in children.values():
        rows = [r for r in rows if r[0]]
        if not rows:
            continue
        n, k = sum(r[0] for r in rows), sum(r[1] for r in rows)
        p = k / n
        beyond += sum(a * (b / a - p) ** 2 for a, b in rows) - p * (1 - p) * (len(rows) - 1)
        weight += p * (1 - p) * (n - sum(a * a for a, _ in rows) / n - (len(rows) - 1))
    return url_filter.concentration(beyond, weight)


def brute_judge(pages, labels, rules):
    bad = {}
    for i, b in labels:
        if i is not None and b is not None:
            bad[i] = max(bad.get(i, 0), int(b))
    hosts = {}
    for i, url in pages:
        n, k = hosts.get(brute_split(url)[0], (0, 0))
        hosts[brute_split(url)[0]] = (n + (i in bad), k + bad.get(i, 0))
    levels = [{}, {}, {}]
    for h, (n, k) in hosts.items():
        suffix, domain = brute_domain(h)
        levels[2].setdefault(domain, []).append((n, k))
        levels[1].setdefault((suffix, domain), []).append((n, k))
    total = lambda rows: (sum(r[0] for r in rows), sum(r[1] for r in rows))
    domains = {key: total(rows) for key, rows in levels[1].items()}
    suffixes = {}
    for (suffix, _), x in domains.items():
        suffixes.setdefault(suffix, []).append(x)
    strong = [brute_strength({"": [total(r) for r in suffixes.values()]}), brute_strength(suffixes), brute_strength(levels[2])]
    n, k = total(domains.values())
    every = (k + 1) / (n + 2)
    out = []
    for i, url in pages:
        host, path = brute_split(url)
        mean = every
        suffix, domain = brute_domain(host)
        for s, (n, k) in zip(strong, (total(suffixes[suffix]), domains[suffix, domain], hosts[host])):
            mean = (k + s * mean) / (n + s)
        bound = mean - url_filter.WIDTH * math.sqrt(mean * (1 - mean) / (n + strong[2] + 1))
        rule, action = brute_rule(host, path, rules)
        out.append((i, host, path, rule, action or ("block" if bound > url_filter.LIMIT else "allow"), mean, bound))
    return out


def agree(spark, pages, labels, rules):
    df = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in pages], URL)
    seen = spark.createDataFrame([(i, None if b is None else bool(b), 3) for i, b in labels], "page_id long, bad boolean, host int")
    rows = url_filter.judge(df, seen, rules).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    expected = sorted(brute_judge(pages, labels, rules), key=key)
    got = sorted(map(tuple, rows), key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert all(math.isclose(g[i], e[i], abs_tol=1e-9) for g, e in zip(got, expected) for i in (5, 6))
    return got


ODD = [(0, None), (1, ""), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Example.COM"), (5, "http://example.com/en/x?y#z"), (6, "http://www.example.com/en/"),
       (7, "http://x.www.example.com/en/a"), (8, "http://badexample.com/en/"), (9, "http://a.net/es/?q"), (10, "http://a.net/de/"), (11, "http://u@b.co.uk:80/x"),
       (12, "http://10.0.0.1:8080/"), (13, "a://b://c.org/d"), (14, "http://ÄÖ.org/É"), (15, "http://c.org?x=/en/"), (None, "http://c.org/"), (4, "http://a.net/fr/"),
       (4, "http://a.net/fr/"), (16, "http://" + "a." * 3000 + "org/" + "x" * 50_000), (17, "x\n://d.org/a\nb"), (18, "http://.net/es/"), (19, "http://net/es/")]


def test_urls_rules_and_posteriors_against_plain_python(spark):
    agree(spark, ODD, [(4, 1), (4, 0), (10, 1), (None, 1), (11, None), (13, 0), (15, 1), (99, 1)], URL_RULES)
    agree(spark, ODD, [], URL_RULES)
    agree(spark, [], [(1, 1)], URL_RULES)


def test_a_bad_host_is_blocked_and_clean_ones_are_not(spark):
    pages = [(i, f"http://spam.bad.org/{i}") for i in range(60)] + [(100 + i, f"http://h{i % 20}.good.org/{i}") for i in range(400)]
    pages += [(1000, "http://new.bad.org/"), (1001, "http://new.good.org/"), (1002, "http://other.org/")]
    labels = [(i, 1) for i in range(0, 60, 2)] + [(100 + i, i % 29 == 0) for i in range(0, 400, 3)]
    verdicts = {r[1]: r[4] for r in agree(spark, pages, labels, [])}
    assert verdicts["spam.bad.org"] == "block" and verdicts["new.bad.org"] == "block"
    assert {v for h, v in verdicts.items() if h.endswith("good.org") or h == "other.org"} == {"allow"}


@pytest.mark.parametrize("rules", [[("block", "b.com", "/en/x"), ("allow", "a.b.com", "/en")], [("allow", "org", "")]])
def test_longest_rule_wins_then_the_longer_host(spark, rules):
    df = spark.createDataFrame([(1, "http://a.b.com/en/xy"), (2, "http://c.org")], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.with_rule(url_filter.split_url(df), rules).collect()}
    assert got == ({1: "a.b.com/en", 2: None} if rules[0][0] == "block" else {1: None, 2: "org"})


def test_no_python_in_the_plan(spark, sf_dir):
    from tablescout.llm.queries import QUERIES

    plan = QUERIES["op11_url_filter"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert QUERIES["op11_url_filter"](spark, sf_dir).where(F.col("rule") == "net/es/").count() > 0
