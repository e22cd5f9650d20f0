"""Every rule stands under a literal token, and only URLs that hold the token run its expression."""

import re

import pytest

from plumbline.llm import url_filter as U
from plumbline.llm.queries import URL_RULES

RULES = [U.host_rule(*r) for r in URL_RULES] + U.pattern_rules()
URLS = ["http://x.org/login", "http://x.org/LOGIN", "http://x.org/a/signin/b", "http://x.org/signins", "http://x.org/cart", "http://x.org/checkout/", "http://x.org/a.exe", "http://x.org/exe",
        "http://x.org/a.iso/b", "http://x.org/b.iso", "http://login.org/", "http://x.org/a.zip?x", "http://www.example.com/en/login", None, "http://x.org/login", "http://x.org/login"]


def test_no_rule_bypasses_the_index(spark):
    assert all(r.tokens for r in RULES)
    urls = spark.createDataFrame([(["", "a"],)], "tokens array<string>")
    assert U.index_rules(spark, urls, RULES).filter("token = ''").count() == 0


def test_only_fetched_rules_run(spark):
    """A rule whose expression fits every URL, but whose token is in few, decides those few alone."""
    rule = U.Rule("any", "block", ".", ("rare",), 5)
    pages = spark.createDataFrame([(1, "http://a.com/rare/x"), (2, "http://a.com/rarely"), (3, "http://a.com/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(pages, [rule]).collect()} == {1: "block", 2: "allow", 3: "allow"}


@pytest.mark.parametrize("limits", [(64, 50_000), (0, 50_000), (0, 0)])
def test_all_ways_agree_with_plain_patterns(spark, monkeypatch, limits):
    monkeypatch.setattr(U, "FEW_RULES", limits[0])
    monkeypatch.setattr(U, "BROADCAST_RULES", limits[1])
    pages = spark.createDataFrame([(7 if u == "http://x.org/login" else i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, found string, one int")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in U.judge(pages, RULES).collect())
    want = []
    for i, u in enumerate(URLS):
        m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u or "")
        host, path = m.groups() if m else ("", "")
        bad = re.search(r"/(login|signin|cart|checkout)(/|$)|\.(exe|zip|iso)$", path)
        rule = "www.example.com/en/" if host == "www.example.com" else None
        want.append((str(7 if u == "http://x.org/login" else i), host, path, str(rule), "allow" if rule or not bad else "block"))
    assert got == sorted(want)


def test_small_index_needs_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").write.parquet(f"{tmp_path}/p")
    plan = U.judge(spark.read.parquet(f"{tmp_path}/p"), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
