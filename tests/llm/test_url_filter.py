import re

import pytest

from plumbline.llm import url_filter as U
from plumbline.llm.queries import URL_RULES

URLS = [
    "http://example.com/en/1", "http://WWW.Example.com/en/1?x=1", "https://www.example.com/EN/1", "http://a.b.example.net/fr/x#y",
    "http://example.net/es", "http://example.net/es/", "http://notexample.com/en/", "http://com", "http://com/", "http://com?x=/en/",
    None, "", "example.com/en/", "://net/fr/z", "http://user@www.example.com/en/", "http://example.com:80/en/", "http://x.org/login",
    "http://x.org/a.zip", "http://x.com/login", "a://b://net/es/", "http://éx.com/en/", "http://www.example.com/en/ü", "http://exam\nple.com/en/",
    "http://examplexcom/en/", "http://net/fr/", "http://net/fr/", "http://.com/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = []
    for text, verdict in URL_RULES:
        h, _, p = text.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(text), text, verdict))
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


@pytest.mark.parametrize("most", [50_000, 0])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(U, "BROADCAST_RULES", most)
    pages = spark.createDataFrame([(i, u, "t", 0) for i, u in enumerate(URLS)] + [(None, "http://x.com/", "t", 0)], "page_id long, url string, token string, rule int")
    rules = [U.host_rule(*r) for r in URL_RULES] + U.pattern_rules()
    got = U.judge(pages, rules).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[r.page_id] if r.page_id is not None else "http://x.com/"
        host, path, rule, verdict = brute(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or ("block" if r.pattern_rule else "allow"))
    blocked = {URLS[r.page_id] for r in got if r.pattern_rule}
    assert blocked == {"http://x.org/login", "http://x.org/a.zip"}


def test_no_rows_and_no_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages, [U.host_rule("com/", "allow")]).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in U.judge(one, []).collect()] == ["allow"]


def test_open_end_is_no_token():
    assert U.host_rule("example.com/en", "block").tokens == ("example", "com")
    assert U.host_rule("example.com/en/", "block").tokens == ("example", "com", "en")
