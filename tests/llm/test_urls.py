from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from assayer.llm import urls
from assayer.llm.queries import QUERIES


def plain(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if url and at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = path[:end]
    best = None
    for verdict, rule in urls.STATED:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, best


def learned(labelled, wanted, support, confidence):
    """Verdicts of token sets by trying every combination."""
    seen, hits, n = {}, {}, len(labelled)
    for items, verdict in labelled:
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                seen[c] = seen.get(c, 0) + 1
                hits[c, verdict] = hits.get((c, verdict), 0) + 1
    rules = [(h / seen[c], h / n, -len(c), v, c) for (c, v), h in hits.items()
             if h >= support * n and h / seen[c] >= confidence]
    out = {}
    for items in wanted:
        fits = [r for r in rules if set(r[4]) <= set(items)]
        out[items] = max(fits)[3] if fits else "allow"
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    sets = {r.page_id: tuple(r.t) for r in df.select("page_id", "url").select(
        "page_id", urls.tokens(*urls.host_and_path(F.coalesce("url", F.lit("")))).alias("t")).collect()}
    parsed = {i: plain(u) for i, u, *_ in rows}
    labelled = [(sets[i], p[2][1]) for i, p in parsed.items() if p[2]]
    open_sets = {sets[i] for i, p in parsed.items() if not p[2]}
    verdicts = learned(labelled, open_sets, urls.MIN_SUPPORT, urls.MIN_CONFIDENCE)
    assert got == {i: (h, p, b[0] if b else None, b[1] if b else verdicts[sets[i]]) for i, (h, p, b) in parsed.items()}


def test_odd_urls(spark):
    found = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "https://a.example.org/en/12?x#y", "://org/", "x://notorg/",
             "http://a.com/fr/", "http://a.com/FR/", "http://a.com/de/1#/fr/", "http://ÄB.com/de/", "http://com?/de/", "http://org",
             "http://..com//de/", "http://u:p@h.net:80/" + "s/" * 20_000, "http://a.com/de/1#/fr/", "http://x.org/../es/\n", "a://b://c/d"]
    check(spark, [(i, u, "clash", 1) for i, u in enumerate(found)])
    df = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(df).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (None, None), (1, "http://a.net/x")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(df).collect()] == ["allow"] * 3


def test_query_against_all_combinations(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, "", 0) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    check(spark, rows)
    assert QUERIES["op8_url_rules"](spark, sf).count() == len(rows)
