import random

from gridloom.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.net", "/", "allow"), ("b.net", "/es/x", "block"), ("A.org", "/", "allow"), ("a.org", "/", "block"), ("", "/", "block"), ("c.org", None, "block")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + (p or "/")), h.lower() + (p or "/"), v) for h, p, v in RULES if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "/")]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_against_brute_force(spark):
    urls = ["http://www.EXAMPLE.com/en/1", "https://example.com/en/", "http://example.com/en", "http://x.www.example.com/en/?q", "http://com/", "http://com", "http://acom/", "ftp://b.net/es/xy#z", "http://a.b.net/es/", "http://net/es/", "http://x.net/fr", "http://a.org/a", "no scheme", "", None, "://", "http://?x", "http://c.org/y", "http://É.com/ü?", "http://example.com:80/en/", "http://..com/"]
    rows = [(i, u, "clash") for i, u in enumerate(urls * 2)] + [(None, urls[0], "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.judge_urls(df, rules).collect()), key=str)
    assert got == sorted([(i, *brute(u)) for i, u, _ in rows], key=str)
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, rules.limit(0), "block").collect()} == {"block"}


def test_many_nested_paths_on_one_host(spark):
    """The sweep's blocks begin and end within nested rules, and one url is in many rows."""
    r = random.Random(3)
    rules = [(r.choice(["a.com", "x.a.com", "com", "b.a.com"]), "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 6))), r.choice(["allow", "block"])) for _ in range(300)]
    urls = [f"http://{r.choice(['a.com', 'x.a.com', 'y.x.a.com', 'b.a.com', 'c.com'])}/{''.join(r.choice('ab/') for _ in range(r.randint(0, 9)))}" for _ in range(400)] + ["http://a.com/ab/" + "b" * 50_000] + ["http://x.a.com/ab/ab"] * 200
    want = []
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)[0], "/" + u[7:].split("/", 1)[1]
        last = {(h, p): v for h, p, v in sorted(rules, key=lambda x: x[2])}
        fits = [(len(h + p), h + p, v) for (h, p), v in last.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i, host, path, *(max(fits)[1:] if fits else (None, "allow"))))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    got = url_filter.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
