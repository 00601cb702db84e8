"""URL rules and archive revisits against plain Python."""

import random

import pytest

from tessera.llm import queries, revisits, url_filters
from tests.helpers import duck, rows
from tests.llm.helpers import frame

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/71?x#y", "http://example.com/en/", "http://www.example.com/en/7", "http://notexample.com/en/7", "http://example.comx/en/", "ftp://a.b.example.net/de/8/z", "http://example.net/de/9", "http://net/de/",
    "http://org", "http://org/es/", "http://x.org?/es/", "http://x.org#/es/", "http://user@x.org/es/", "http://x.org:80/es/", "http://É.org/es/ß", "a://b://c.com/en/", "http://com./en/", "http://.com/en/", "http:///en/", "://com/en/",
]


def brute(url, rules, default="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = lambda s, signs: s[: min([s.find(c) for c in signs if c in s], default=len(s))]
    given = cut(rest, "/?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in given)
    path = cut(rest[len(given) :], "?#")
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def check(spark, urls, rules, given=None, cells=None):
    pages = frame(spark, [(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, key int")
    found = url_filters.judge(pages, given if given is not None else rules, cells=cells).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert len(found) == len(urls)


def many(n: int) -> tuple[list[str], list[tuple]]:
    r = random.Random(n)
    name = lambda: ".".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "/".join(r.choice("xy") for _ in range(r.randint(0, 3)))
    rules = {(name(), path()): r.choice(["block", "allow"]) for _ in range(40)}
    return [f"http://{name()}{path()}" for _ in range(n)] + URLS, [(v, h, p) for (h, p), v in rules.items()]


def test_contract_rules(spark):
    check(spark, URLS, RULES)


def test_nested_rules(spark):
    urls, rules = many(400)
    check(spark, urls, rules)


def test_one_host_has_most_urls(spark):
    check(spark, ["http://hot.example.com/en/" + str(i) for i in range(300)] + URLS, RULES)


@pytest.mark.parametrize("cells", [1, 2, 7, 60])
def test_rule_tables(spark, cells):
    """The same from a table of rules, however many cells there are."""
    urls, rules = many(200)
    urls += ["http://a.b.c/x/y"] * 100
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    check(spark, urls, rules, table, cells)
    check(spark, urls, rules, None, cells)


def test_contradicting_rules(spark):
    """One order of ties, whatever comes first and however many rules there are; rules without host or verdict say nothing."""
    urls = ["http://a.com/x", "http://b.a.com/x/y", "http://z.org/"]
    some = [("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("block", "b.a.com", "/x"), ("allow", "b.a.com", "/x")]
    for rules in (some, some[::-1]):
        check(spark, urls, rules)
        more = rules + [("allow", f"h{i}.a.com", "/x") for i in range(3000)]
        check(spark, urls, more, spark.createDataFrame(more, "verdict string, host string, path string"), 9)
        assert not url_filters._bounds(spark.createDataFrame([], "at string"), 9)
    nulls = spark.createDataFrame([*some, (None, "z.org", "/"), ("block", None, "/"), ("block", "z.org", None)], "verdict string, host string, path string")
    check(spark, urls, [*some, ("block", "z.org", "")], nulls)


def test_repeated_rows_and_empty(spark):
    pages = frame(spark, [(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, "http://a.org/es/")], "page_id long, url string")
    assert sorted(r["verdict"] for r in url_filters.judge(pages, RULES).collect()) == ["block"] * 3
    assert url_filters.judge(frame(spark, [], "page_id long, url string"), RULES).count() == 0
    assert [r["verdict"] for r in url_filters.judge(pages, []).collect()] == ["allow"] * 3


@pytest.mark.parametrize("name", ["op3_embedding_dedup", "op5_revisits", "op6_url_filters", "op10_quality_rules"])
def test_second_engine(spark, small, name):
    own, other = queries.QUERIES[name](spark, small).toPandas(), duck(small).execute(queries.ORACLE_SQL[name]).df()
    for c in own.columns:
        if own[c].dtype.kind == "f" or other[c].dtype.kind == "f":
            own[c], other[c] = own[c].astype(float), other[c].astype(float)
    assert rows(own) == rows(other)


# Operator 5
SCHEMA = "record_id long, url string, captured_at long, kind string, status int, headers map<string,string>, payload string, verdict string"


def resolved(spark, records):
    return {r["record_id"]: r for r in revisits.resolve(frame(spark, [(*r, "x") for r in records], SCHEMA)).collect()}


def response(i, url, at, payload="body", status=200, **headers):
    return (i, url, at, "response", status, {k.replace("_", "-"): v for k, v in headers.items()}, payload)


def again(i, url, at, **headers):
    return (i, url, at, "revisit", 304, {k.replace("_", "-"): v for k, v in headers.items()}, None)


def test_verdicts_and_merged_headers(spark):
    found = resolved(spark, [
        response(1, "http://A.com/x/", 10, "old", ETag='"1"', Content_Type="text/html", Date="then"),
        response(2, "https://a.com:443/x?utm_source=q", 20, "new", ETag='W/"2"', Content_Type="text/plain", Date="then"),
        response(3, "http://a.com/x", 25, "gone", status=404, ETag='"3"'),
        response(4, "http://a.com/x", 26, None, ETag='"4"'),
        again(5, "http://a.com/x#top", 30, etag='"2"', Date="now", Content_Type="image/png", Set_Cookie="c"),
        again(6, "http://a.com/x", 30, ETag='"1"'),
        again(7, "http://a.com/x", 5, ETag='"1"'),
        again(8, "http://a.com/x", 40),
        again(9, None, 50, ETag='"1"'),
        again(10, "http://a.com/x", 10, ETag='"1"'),
        response(11, "http://b.com/?b=2&a=1", 1, "dated", Last_Modified="day"),
        again(12, "http://b.com?a=1&b=2", 2, Last_Modified="day"),
        again(13, "http://b.com?a=1&b=2", 2, Last_Modified="other"),
        again(14, "http://b.com?a=1&b=2", 2, ETag='"x"'),
    ])
    assert {i: (r["verdict"], r["response_id"]) for i, r in found.items() if r["kind"] == "revisit"} == {5: ("resolved", 2), 6: ("mismatch", None), 7: ("no_response", None), 8: ("no_validator", None), 9: ("no_response", None), 10: ("resolved", 1), 12: ("resolved", 11), 13: ("mismatch", None), 14: ("no_validator", None)}
    assert found[5]["payload"] == "new" and found[5]["headers"] == {"etag": '"2"', "content-type": "text/plain", "date": "now"}
    assert found[2]["payload"] == "new" and found[2]["verdict"] is None
    assert len(found) == 14


def test_as_of_against_brute_force(spark):
    r = random.Random(5)
    records = []
    for i in range(300):
        url = "http://hot.com/" if r.random() < 0.4 else f"http://h{r.randrange(12)}.com/{r.randrange(3)}"
        at = r.choice([None, *range(60)])
        records.append(response(i, url, at, f"p{i}", ETag=f'"{r.randrange(3)}"') if r.random() < 0.4 else again(i, url, at, **({"ETag": f'"{r.randrange(3)}"'} if r.random() < 0.8 else {})))
    found = resolved(spark, records)
    place = lambda x: (x[2] is not None, x[2] or 0, x[0])
    for x in records:
        if x[3] == "revisit":
            before = [y for y in records if y[3] == "response" and y[1] == x[1] and place(y) < place(x)]
            last = max(before, key=place, default=None)
            tag = x[5].get("ETag")
            verdict = "no_response" if last is None else "no_validator" if tag is None else "resolved" if tag == last[5]["ETag"] else "mismatch"
            got = found[x[0]]
            assert (got["verdict"], got["response_id"], got["payload"]) == ((verdict, last[0], last[6]) if verdict == "resolved" else (verdict, None, None))


def test_repeated_records(spark):
    rows = revisits.resolve(frame(spark, [(*r, "x") for r in [response(1, "http://a.com", 1, "b"), response(1, "http://a.com", 1, "a"), again(2, "http://a.com", 2), again(2, "http://a.com", 2), (3, "http://a.com", 3, None, None, None, None)]], SCHEMA)).collect()
    assert sorted((r["record_id"], str(r["verdict"])) for r in rows) == [(1, "None"), (1, "None"), (2, "no_validator"), (2, "no_validator"), (3, "None")]


def test_no_records(spark):
    assert revisits.resolve(frame(spark, [], SCHEMA)).count() == 0
