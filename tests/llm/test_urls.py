import itertools

from pyspark.sql import functions as F

from ledgerline.llm import urls
from ledgerline.llm.queries import URL_RULES

from .helpers import with_clashing_columns

URLS = [
    None, "", "no scheme/x", "http://Example.ORG/es/1", "https://a.example.org/en/12?x=1", "http://example.org/en/2#f",
    "http://example.org", "http://notexample.org/es/", "x://site.com/fr/9.html", "http://SITE.com:80/fr/", "http://com/de/",
    "http://a.b.com/de/x://y", "http://net/a?b=/fr/", "http://?q", "://h/p", "http://é.com/de/1",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    stop = next((i for i, c in enumerate(rest) if i >= end and c in "?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:stop]


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) + [(3, URLS[3]), (None, URLS[3])]
    pages = with_clashing_columns(spark.createDataFrame(rows, "page_id long, url string"))
    none = urls.mine(spark.createDataFrame([], "url string, bad boolean"), "url", "bad")
    got = urls.judge(pages, none, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parts(URLS[r.page_id if r.page_id is not None else 3])
        fits = [x for x in URL_RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (best[1] + best[2] if best else None) and r.verdict == (best[0] if best else "allow")
    assert urls.judge(pages.filter("false"), none, URL_RULES).collect() == []


def test_mined_rules_are_those_of_brute_force(spark):
    rows = [(f"http://{h}.net/{p}/{i}", h == "spam" and p == "x" or h == "bad") for i, (h, p) in
            enumerate(itertools.product(["spam", "bad", "good", "fine"], ["x", "y"] * 10))]
    df = spark.createDataFrame(rows + [(None, True), ("http://a.net/", None)], "url string, bad boolean")
    rules = urls.mine(df, "url", "bad", support=0.05, confidence=0.9, least=5).collect()
    tokens = df.filter("url is not null and bad is not null").select(urls.tokens_of(F.col("url")).alias("t"), "bad").collect()
    seen, hit = {}, {}
    for r in tokens:
        for n in range(1, len(r.t) + 1):
            for c in itertools.combinations(sorted(r.t), n):
                seen[c], hit[c] = seen.get(c, 0) + 1, hit.get(c, 0) + r.bad
    want = {c for c, n in seen.items() if hit[c] >= 0.05 * len(tokens) and hit[c] / n >= 0.9}
    least = {c for c in want if not any(set(d) < set(c) for d in want)}
    assert {tuple(r.antecedent) for r in rules} == least == {("host:bad",), ("host:spam", "path:x")}
    for r in rules:
        c = tuple(r.antecedent)
        assert abs(r.confidence - hit[c] / seen[c]) < 1e-9 and abs(r.support - hit[c] / len(tokens)) < 1e-9
    freq = {c[0]: n for c, n in seen.items() if len(c) == 1}
    assert all(freq[r.key] == min(freq[t] for t in r.antecedent) for r in rules)

    mined = urls.mine(df, "url", "bad", support=0.05, confidence=0.9, least=5)
    pages = df.select(F.monotonically_increasing_id().alias("page_id"), "url")
    got = {(r.page_id, r.verdict) for r in urls.judge(pages, mined, []).collect()}
    for r in pages.collect():
        mine = set(spark.createDataFrame([(r.url,)], "u string").select(urls.tokens_of(F.col("u"))).first()[0] or []) if r.url else set()
        assert (r.page_id, "block" if any(set(c) <= mine for c in want) else "allow") in got


def test_too_few_rows_give_no_rules(spark):
    df = spark.createDataFrame([("http://spam.net/x", True)] * 19, "url string, bad boolean")
    assert urls.mine(df, "url", "bad").collect() == []


def test_long_urls_have_few_rules(many_chunks):
    """Equal and nearly equal long URLs, on their own and among good ones, don't make a rule of each subset."""
    long = "/".join(f"s{chr(97 + k)}" for k in range(20))
    shared = "/".join(f"t{chr(97 + k)}" for k in range(25))
    near = [f"u{chr(97 + k)}" for k in range(25)]
    rows = [(f"http://bad.net/{long}", True)] * 30
    rows += [(f"http://{'spam' if i % 2 else 'fine'}.net/{shared}/{'x' if i % 4 > 1 else 'y'}", i % 4 == 3) for i in range(120)]
    rows += [(f"http://odd.net/{'/'.join(near[:i % 25] + near[i % 25 + 1:])}", i % 3 == 0) for i in range(300)]
    rows += [(f"http://good.net/{long.replace('s', 'v')}", False)] * 200
    df = many_chunks.createDataFrame(rows, "url string, bad boolean")
    rules = {tuple(r.antecedent) for r in urls.mine(df, "url", "bad").collect()}
    assert len(rules) <= 30 and {("host:spam", "path:x"), ("host:bad",), ("path:sa",)} <= rules
    assert all(len(r) <= 2 for r in rules)
    pages = df.select(F.monotonically_increasing_id().alias("page_id"), "url", "bad")
    got = urls.judge(pages, urls.mine(df, "url", "bad"), []).join(pages.select("page_id", "url", "bad"), "page_id").collect()
    assert all((r.verdict == "block") == (r.bad and r.host != "odd.net") for r in got)
