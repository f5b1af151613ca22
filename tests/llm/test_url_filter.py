from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.queries import URL_RULES
from quillspark.llm.url_filter import url_verdicts

RULES = "host string, path string, verdict string"


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def run(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_verdicts(df, spark.createDataFrame(rules, RULES)).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}


URLS = [None, "", "x", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net/de/", "http://net", "http://net/", "ftp://a.org/fr/1", "http://org/en/", "http://x.example.com/de/5", "http://notexample.com/de/", "http://a.net?b/c", "http://a.net#/x", "://a.net/x://y", "http://a.net:80/", "http://..net/", "http://é.NET/É", "http://a.net/" + "p/" * 9000, "http://" + "s." * 5000 + "net/", "http://a.net/\n/x"]


def test_cases(spark):
    got = run(spark, [*URLS, *URLS], URL_RULES)
    assert [got[i] for i in range(len(URLS) * 2)] == [brute(u, URL_RULES) for u in [*URLS, *URLS]]


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.text(alphabet="ab./?#:", max_size=14).map(lambda s: "h://" + s), min_size=1, max_size=60),
    st.lists(st.tuples(st.sampled_from(["a", "b", "a.b", "b.a", "a.a"]), st.sampled_from(["", "/", "/a", "/a/", "/b/a"]), st.sampled_from(["allow", "block"])), min_size=1, max_size=8),
)
def test_any(spark, urls, rules):
    got = run(spark, urls, rules)
    assert [got[i] for i in range(len(urls))] == [brute(u, rules) for u in urls]


def test_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [r.verdict for r in url_verdicts(df, none).collect()] == ["allow"]
    assert url_verdicts(df.limit(0), spark.createDataFrame(URL_RULES, RULES)).collect() == []
