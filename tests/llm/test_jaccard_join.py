import re

import numpy as np
import pytest

from motifmill.llm import jaccard_join as J

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def brute(rows, m):
    sets = {i: shingles(t, m.n) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if m.den * inter >= m.num * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(df, m):
    got = J.jaccard_join(df, measure=m).collect()
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], m)
    assert {r.id: (r.n_shingles, r.component_id) for r in got if r.id is not None} == want
    assert len(got) == df.count()


@pytest.mark.parametrize("m", [J.Measure(4, 85, 100), J.Measure()])
def test_edge_rows(edge, m):
    check(edge, m)


def family(spark, copies, edits, seed, words=80):
    """Copies of one text with a few words changed each, so that links form chains."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(copies):
        w = list(base)
        for k in rng.choice(words, rng.integers(0, edits), replace=False):
            w[k] = f"v{rng.integers(1000)}"
        rows.append((int(i), " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("edits", [3, 6])
@pytest.mark.parametrize("words", [12, 30, 80, 400])
def test_families_of_near_copies(spark, edits, words):
    check(family(spark, 60, edits, words + edits, words), J.Measure(4, 85, 100))


def test_sample(sample):
    check(sample, J.Measure(4, 85, 100))


def test_near_sets_share_a_signature():
    rng = np.random.default_rng(3)
    m = J.Measure(4, 85, 100)
    ends, bound = m.bands(4000)
    linked = 0
    frequent = J.frequent_bits(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64))
    for _ in range(400):
        n = int(rng.integers(3, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, n // 8) + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 10) + 1)), dtype=np.uint64)]))
        if m.linked(a, b) and not np.array_equal(a, b):
            linked += 1
            assert np.intersect1d(J.signatures(a, ends, bound, frequent), J.signatures(b, ends, bound, frequent)).size
            w = min(len(J.sketch(a)), len(J.sketch(b)))
            assert np.bitwise_count(J.fold(J.sketch(a), w) ^ J.fold(J.sketch(b), w)).sum() <= m.reach(len(a), len(b))
    assert linked > 100


def test_empty(empty):
    assert J.jaccard_join(empty).count() == 0


def test_components_on_chains(spark):
    from motifmill.llm.components import components

    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


def test_provisional_joins_keep_a_signature_alive():
    """A-X and X-B are proposed before {A, B, C} is seen; if they fail, A-B has only that signature."""
    m = J.Measure(4, 85, 100)
    words = lambda name, at: [f"{name}{k}" if k in at else f"w{k}" for k in range(203)]
    text = {
        "A": " ".join(words("a", range(16))),
        "X": " ".join(words("x", range(187, 203))),
        "B": " ".join(words("b", range(3))),
        "C": " ".join(words("c", range(203))),
    }
    sets = dict(zip(text, J.shingle_sets([t.encode() for t in text.values()], m.n), strict=True))
    linked = lambda a, b: m.linked(sets[a], sets[b])
    assert linked("A", "B") and not linked("A", "X") and not linked("X", "C") and not linked("B", "C")
    ids = {"A": 1, "B": 2, "C": 3, "X": 4}
    forest = J.Forest(m, None)
    forest.parent = {ids["A"]: ids["X"], ids["X"]: ids["X"], ids["B"]: ids["X"]}  # what earlier signatures proposed
    names = ("A", "B", "C")
    node = [ids[k] for k in names]
    forest.add(7, node, node, np.array([len(sets[k]) for k in names]), [J.sketch(sets[k]).tobytes() for k in names], [None] * 3)
    assert forest.out == {}
    assert forest.alive == [7]
