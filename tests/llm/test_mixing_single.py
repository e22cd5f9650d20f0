"""Documents of a single source go through the flow as all others do."""

import random

from plumbline.llm import mixing as M


def test_single_sources_are_searched(monkeypatch):
    seen, real = [], M._search
    monkeypatch.setattr(M, "_search", lambda patterns, *a: (seen.append(sorted(patterns)), real(patterns, *a))[1])
    r = random.Random(0)
    patterns = [(frozenset([f"s{i}"]), r.randint(0, 9) * 10**r.randint(0, 12)) for i in range(60)]
    quotas = {f"s{i}": r.randint(0, 9) * 10**r.randint(0, 12) for i in range(55)}
    for most in (1, 2, 3):
        seen.clear()
        got = M.flow(patterns, quotas, most)
        assert got == [min(most * size, quotas.get(next(iter(s)), 0)) for s, size in patterns]
        assert sorted(x for part in seen for x in part) == [i for i, (_, size) in enumerate(patterns) if size]
