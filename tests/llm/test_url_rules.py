from notelode.llm.url_rules import LISTED, judge, mine

SCHEMA = "page_id long, url string, tokens string, verdict string"


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for stop in "/?#":
            host = host.split(stop)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in LISTED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [
    "http://A.Net/x", "https://www.example.net/en/1", "http://example.net/en", "http://example.net/en/", "http://xexample.net/en/1",
    "http://example.com/de/1?q=/fr/", "http://sub.example.com/de", "http://a.org/fr/#x", "http://org/fr/", "http://a.org?/fr/",
    "http://a.net", "http://a.net?x", "no scheme/net/", "", None, "ftp://ÄÖ.net/ä", "http://a.net/x://b.org/fr/", "://net/", "http:///net/",
    "http://a.org/fr/\n2", "http://x.com/" + "y" * 100_000,
]


def test_listed_rules_equal_the_plain_reading(frame):
    rows = [(i, u, "t", "v") for i, u in enumerate(URLS)] + [(0, URLS[0], "", ""), (None, URLS[0], "", "")]
    got = judge(frame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = plain(URLS[r.page_id or 0])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_mined_combinations_block_what_no_rule_lists(frame):
    bad = [(i, f"http://cheap-pills.shop{i % 7}.net/buy/{i}") for i in range(60)]
    plain_ = [(100 + i, f"http://site{i % 9}.com/news/{i}") for i in range(60)]
    new = [(500, "http://cheap-pills.new.com/buy/9"), (501, "http://site3.com/buy/9"), (502, "http://site3.com/")]
    got = {r.page_id: r.verdict for r in judge(frame([(*r, "", "") for r in bad + plain_ + new], SCHEMA), support=0.05).collect()}
    assert got[500] == "block" and got[501] == "block" and got[502] == "allow"
    assert all(got[i] == "allow" for i, _ in plain_)


def test_mined_rules_equal_brute_force(frame):
    rows = [(["a", "b"], True)] * 8 + [(["a"], False)] * 8 + [(["b", "c"], False)] * 2 + [(["d"], True)] * 5 + [(["d", "a"], True)] * 2
    got = {tuple(r.antecedent): round(r.confidence, 6) for r in mine(frame(rows, "tokens array<string>, block boolean"), 0.05, 0.75).collect()}
    # {d}: 7 of 7; {a, b}: 8 of 8; {b}: 8 of 10; {a, d} is as sure as {d} and left out.
    assert got == {("d",): 1.0, ("a", "b"): 1.0, ("b",): 0.8}


def test_empty_table_and_no_blocked_page(frame):
    assert judge(frame([], SCHEMA)).count() == 0
    assert judge(frame([(1, "http://a.com/", "", "")], SCHEMA).limit(1)).first().verdict == "allow"


def test_long_urls_on_many_pages_end_soon(frame):
    names = "&".join(f"name{i}={i}" for i in range(200))
    rows = [(i, f"http://shop.net/list?{names}") for i in range(40)] + [(100 + i, f"http://news{i % 5}.com/a/{i}") for i in range(40)]
    rows += [(200, f"http://other.com/list?{names}"), (201, "http://other.com/list?page=1")]
    got = {r.page_id: r.verdict for r in judge(frame([(*r, "", "") for r in rows], SCHEMA), support=0.05).collect()}
    assert all(got[i] == "block" for i in range(40)) and all(got[100 + i] == "allow" for i in range(40))
    assert got[200] == "block" and got[201] == "block"
