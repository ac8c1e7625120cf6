import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from motifmill.llm import mixing as M
from motifmill.llm import queries as Q


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute(df, levels, weights, share, epochs, seed):
    rows = df.select(F.col("doc_id").alias("i"), "text", *(c.cast("string").alias(f"l{k}") for k, (_, c) in enumerate(levels))).collect()
    leaves = defaultdict(list)
    for r in rows:
        leaves[tuple(r[f"l{k}"] for k in range(len(levels)))].append((r.i, words(r.text)))
    totals = {p: sum(n for _, n in v) * epochs for p, v in leaves.items()}
    given = M.allocate(totals, int(sum(totals.values()) // epochs * share), weights)
    out = []
    for path, docs in leaves.items():
        before = 0
        for e in range(epochs):
            key = lambda d, e=e: (hashlib.md5(f"{seed}:{e}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] is not None, d[0] or 0, d[1])
            for i, n in sorted(docs, key=key):
                if before + n <= given[path]:
                    out.append((i, *path, e, n, given[path], before))
                before += n
    return sorted(out, key=repr)


@pytest.mark.parametrize("share,epochs", [(0.5, 1), (0.9, 1), (0.8, 2), (1.0, 1), (0.0, 1)])
def test_matches_brute_force(edge, sample, share, epochs):
    for df in (edge, sample):
        got = M.mix(df, Q.levels(), Q.weights, share, epochs, 3).drop("row_key")
        assert sorted(map(tuple, got.collect()), key=repr) == brute(df, Q.levels(), Q.weights, share, epochs, 3)


def test_shortage_goes_to_siblings_before_ancestors():
    totals = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000}
    even = lambda path: 1.0
    got = M.allocate(totals, 400, even)
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}
    totals[("a", "y")] = 50  # the domain runs out: the rest goes to its sibling
    assert M.allocate(totals, 400, even) == {("a", "x"): 10, ("a", "y"): 50, ("b", "x"): 340}
    assert sum(M.allocate(totals, 10_000, even).values()) == 1060


def test_weight_zero_leaves_out():
    got = M.allocate({("a",): 100, ("b",): 100}, 150, lambda p: 0.0 if p == ("a",) else 1.0)
    assert got == {("a",): 0, ("b",): 100}


def water(budget, wants, have):
    """Shares by raising the water level a token at a time: the next one goes to the open node furthest below its weight's share."""
    got = [0] * len(have)
    open_ = [k for k in range(len(have)) if wants[k] > 0]
    for _ in range(min(budget, sum(have[k] for k in open_))):
        k = min((k for k in open_ if got[k] < have[k]), key=lambda k: ((got[k] + 1) / wants[k], k))
        got[k] += 1
    return got


@pytest.mark.parametrize("seed", range(30))
def test_shares_are_water_levels(seed):
    """Within one token of a level that rises alike for all siblings, by weight, until each is full; nothing is left that a sibling could take."""
    rng = random.Random(seed)
    n = rng.randint(1, 6)
    wants, have = [rng.choice([0, 0.5, 1, 2, 3]) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)]
    budget = rng.randint(0, 150)
    got = M.share_out(budget, wants, have)
    assert sum(got) == min(budget, sum(h for h, w in zip(have, wants, strict=True) if w))
    assert all(abs(g - w) <= n and g <= h for g, w, h in zip(got, water(budget, wants, have), have, strict=True))


@pytest.mark.parametrize("share", [0.0, 0.7])
def test_level_by_level_is_the_same(edge, sample, share):
    weights = lambda p: 0.0 if p[-1] in ("fr", "src3") else Q.weights(p)
    for df, w in ((edge, weights), (sample, Q.weights if share else weights)):
        one, two = (sorted(map(tuple, M.mix(df, Q.levels(), w, share, 2, 3, most_leaves=n).collect()), key=repr) for n in (M.LEAVES, 0))
        assert one == two


def test_more_slices_change_nothing(sample, monkeypatch):
    one = sorted(map(tuple, M.mix(sample, Q.levels(), Q.weights, 0.6, 2, 3).collect()))
    monkeypatch.setattr(M, "SLICE_ROWS", 0.001)
    monkeypatch.setattr(M, "ORDER_DIGITS", 1)
    assert sorted(map(tuple, M.mix(sample, Q.levels(), Q.weights, 0.6, 2, 3).collect())) == one


def test_empty(empty):
    assert M.mix(empty, Q.levels(), Q.weights, 0.5).count() == 0
