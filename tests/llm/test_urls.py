import math
from collections import Counter

from hanok.llm import urls


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


ODD = [
    None, "", "no scheme", "://", "http://", "http://A.Example.COM/en/x", "http://www.example.com/en/1", "http://a.www.example.com/en/1", "http://wwwexample.com/en/", "http://example.com/en",
    "http://com", "http://com/", "http://x.net/es/1?q=://y.com/", "http://x.net/fr/#f", "http://x.net/de/", "http://x.net?/es/", "a://b://c.com/d", "http://é.net/es/ü", "x" * 5000 + "://q.org/" + "z" * 5000, "http://a.com\n/en/",
]


def table(spark, found, extra=True):
    return spark.createDataFrame([(i, u, "host") for i, u in enumerate(found)], "page_id bigint, url string, host string")


def test_rules_equal_brute_force(spark):
    pages = [f"http://{s}.example.{d}/{p}/{i}?a={i}" for i, (s, d, p) in enumerate((s, d, p) for s in ("www", "m", "spam-1") for d in ("com", "net", "org") for p in ("en", "es", "fr"))]
    found = pages + ODD + ["http://x.net/es/1"] * 3
    got = urls.judge(table(spark, found)).collect()
    assert len(got) == len(found)
    for r in got:
        host, path, rule, verdict = brute(found[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block") and 0 <= r.block_score <= 1


def test_trees_learn_what_the_rules_block(spark):
    # blocked: net/es with digits in the host; allowed: plain com. Unruled org urls that look like either follow them
    labelled = [f"http://spam{i}77{i}.example.net/es/{i}/{i}?id={i}&x={i}" for i in range(150)] + [f"http://plain.site.com/about/{'abcdefgh'[i % 8]}" for i in range(150)]
    unruled = [f"http://spam{i}88{i}.example.org/es/{i}/{i}?id={i}&x={i}" for i in range(10)] + [f"http://plain.site.org/about/{'abcdefgh'[i % 8]}" for i in range(8)]
    got = {r.page_id: r.verdict for r in urls.judge(table(spark, labelled + unruled)).collect()}
    assert [got[300 + i] for i in range(18)] == ["block"] * 10 + ["allow"] * 8


def test_one_label_none_and_empty(spark):
    assert {r.verdict for r in urls.judge(table(spark, ["http://a.net/es/", "http://b.org/"])).collect()} == {"block"}
    assert {r.verdict for r in urls.judge(table(spark, ["http://b.org/", None])).collect()} == {"allow"}
    assert urls.judge(table(spark, ["x"]).limit(0)).count() == 0


def test_lexical_features(spark):
    url = "http://a.b-c.org/x1/y22?p=1&q=2#f"
    r = urls.lexical(urls.ruled(urls.located(table(spark, [url])))).first()
    n, counts = len(url), Counter(url)
    assert math.isclose(r.entropy, -sum(c / n * math.log2(c / n) for c in counts.values()), rel_tol=1e-9)
    assert (r.length, r.depth, r.labels, r.params, r.hyphens, r.suffix) == (n, 2, 3, 2, 1, "org")
    assert math.isclose(r.digits, sum(c.isdigit() for c in url) / n)
