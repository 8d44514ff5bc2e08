import random
import re
from collections import Counter

import pytest

from thicket.llm import op1_urls as op


def slow(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(-len(h + p), h + p, -ord(v[0]), v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    best = min(fit)
    return host, path, best[1], best[3]


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "https://Example.COM/en/x?y#z", "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://example.com/en", "http://notexample.com/en/1", "http://x.net/es/", "http://net/fr/q", "http://x.net/ES/",
    "ftp://a..com/", "http://.com/", "http://com./", "http://example.com?/en/", "http://example.com#/en/", "http://é.com/ü", "http://a.com:80/", "x http://b.net/es/ http://c.com/", "http://Ä.net/fr/\n", "http://" + "a." * 3000 + "com/" + "p" * 50_000,
]


def run(spark, urls, rules):
    df = spark.createDataFrame([(i if i % 5 else None, u, "own") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    out = op.filter_urls(df, op.rule_table(spark, rules))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())


def want(urls, rules):
    return Counter((i if i % 5 else None, *slow(u, rules)) for i, u in enumerate(urls))


def test_the_rules_of_the_query(spark):
    urls = URLS + ["http://a.net/es/1"] * 50
    assert run(spark, urls, op.RULES) == want(urls, op.RULES)


@pytest.mark.parametrize("seed", [0, 1])
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice("/x") for _ in range(rng.randint(0, 4)))
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(40)]
    urls = [f"http://{host()}/{path()}" for _ in range(400)]
    assert run(spark, urls, rules) == want(urls, rules)


def test_empty(spark):
    assert run(spark, [], op.RULES) == Counter()
    assert run(spark, URLS[:8], []) == want(URLS[:8], [])
