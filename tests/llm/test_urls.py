import re

import duckdb
import pytest

from corpusmill.llm import urls as U

SF = "/root/testdata/sf0.01"
ODD = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "http://a.org/x", "https://Example.ORG/es/1?q=/en/", "http://x.example.org/es", "http://example.org/en/199", "http://example.org/en/2",
    "http://example.com/fr/1", "http://com/de/", "http://notcom/de/", "http://a.com:80/de/", "http://a.com?x=/de/", "http://a.com#/de/", "http://a.net/x://b.org/de/", "://a.com/de/z", "http://m.ads-track.example.net/q",
    "http://x.net/LOGIN/", "http://x.net/login.html", "http://x.net/loginx", "http://ads.x.net", "http://wikipedia.net/cart/", "http://x.net/É/casino", "http://x.net/a.zip", "http://x.net/session/ab12", "http://x.com/fr/" + "a" * 100_000,
]


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for r in U.HOST_RULES:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or r.length > best.length):
            best = r
    hits = {v: sorted(f.name for f in U.FAMILIES if f.verdict == v and re.search(f.whole(), (host + path).lower())) for v in ("block", "allow")}
    verdict = best.verdict if best else "block" if hits["block"] and not hits["allow"] else "allow"
    return host, path, best and best.name, verdict, ([*hits["allow"], *hits["block"]] or [None])[0]


@pytest.mark.parametrize("broadcast", [U.BROADCAST_RULES, 1])
def test_matches_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(U, "BROADCAST_RULES", broadcast)
    rows = [*enumerate(ODD), (5, ODD[5]), (None, ODD[6])]
    df = spark.createDataFrame([(i, u, "z") for i, u in rows], "page_id long, url string, host string")
    got = [tuple(r) for r in U.judged(df).collect()]
    assert sorted(got, key=repr) == sorted(((i, *brute(u)) for i, u in rows), key=repr)
    assert U.judged(df.limit(0)).count() == 0


def generated():
    """URLs that each rule's own words make, as matches and near misses, one after the other."""
    out = []
    for k, r in enumerate(U.PATTERN_RULES):
        words = list(r.tokens)
        joined = ("-", "_", ".", "/")[k % 4].join(words)
        out += [f"http://{joined}.example.net/", f"http://x.{joined}.net/a", f"http://x.net/{joined}", f"http://x.net/a/{joined}/ab12", f"https://x.net/{joined.upper()}.html", f"http://x.net/file.{joined}"]
        out += [f"http://x.net/{joined}s2", f"http://x{joined}.net/", f"http://x.net/{joined}/2024/01/02", f"http://x.net/{joined}/z/page/3", f"http://x.net/{joined[:-1]}", f"http://x.net/{joined}É"]
    return out


def test_every_match_has_its_tokens():
    assert len(U.PATTERN_RULES) > 200
    matched = set()
    for u in [*ODD, *generated()]:
        host, path, *_ = brute(u)
        own = set(U.tokens_of(host + path))
        for r in U.PATTERN_RULES + U.HOST_RULES:
            if re.search(r.regex, host + path if r.kind == "host" else (host + path).lower()):
                matched.add(r)
                assert r.tokens and set(r.tokens) <= own, (r, u)
    assert matched >= set(U.PATTERN_RULES)  # every branch of every family has a URL here


def test_index_loses_no_match(spark):
    """The index gives what the families' whole expressions give; a URL's verdict does not depend on the other rows."""
    urls = generated()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.pattern) for r in U.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i] for i in range(len(urls))] == [brute(u) for u in urls]
    for u in ("http://adserver.x.net/a", "http://banners.x.net/a", "http://x.net/ad-tracking/a", "http://x.net/ad-track/a", "http://x.net/ads-tracker/a"):
        alone = U.judged(spark.createDataFrame([(1, u)], "page_id long, url string")).first()
        assert alone.verdict == "block" and alone.pattern == brute(u)[4]


def test_rules_whose_words_are_not_whole_tokens_are_refused():
    for bad in ({"words": (("a-b",),)}, {"words": ()}, {"words": ((),)}, {"words": (("a",),), "before": ""}, {"words": (("a",),), "after": "[a-z]*"}):
        with pytest.raises(ValueError):
            U.Family("bad", "block", **bad)


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = db.execute(U.ORACLE["op7_url_rules"]).fetchall()
    got = U.op7_url_rules(spark, SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
