"""Recall of near-duplicate links on a whole table, against an exact join by prefix filtering."""

import math
import os
from collections import Counter, defaultdict

import pytest

from plumbline.llm import near_dedup as N
from test_near_dedup import shingles

TABLE = "/root/testdata/sf0.01/documents.parquet"


def exact_links(sets, percent):
    """All pairs of sets of a similarity of percent or more: such a pair shares one of the rarest
    n - ceil(percent * n) + 1 members of either set."""
    often = Counter(x for s in sets.values() for x in s)
    index, links = defaultdict(list), []
    for i, s in sets.items():
        head = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(percent / 100 * len(s)) + 1]
        met = {j for x in head for j in index[x]}
        links += [(i, j) for j in met if 100 * len(s & sets[j]) >= percent * len(s | sets[j])]
        for x in head:
            index[x].append(i)
    return links


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.skipif(not os.path.exists(TABLE), reason="needs the test tables")
@pytest.mark.parametrize("percent", [85, 80])
def test_every_link_of_the_table_is_found(spark, percent):
    docs = spark.read.parquet(TABLE).select("doc_id", "text")
    sets = {r.doc_id: s for r in docs.collect() if (s := shingles(r.text))}
    links = exact_links(sets, percent)
    assert len(links) > 20
    want = groups(sets, links)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs, percent=percent).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert found == len(links)  # recall 1.0
    assert {i: got[i] for i in sets} == want
