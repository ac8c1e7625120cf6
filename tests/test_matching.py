import itertools

import numpy as np
import pytest

from motifmill.operators import matching as M


@pytest.mark.parametrize("n,m", [(1, 1), (3, 3), (4, 6), (6, 6)])
def test_best_assignment_is_the_first_best_permutation(n, m):
    for seed in range(10):
        s = np.random.default_rng(seed).integers(0, 4, (n, m)).astype(float)  # many ties
        best = max(itertools.permutations(range(m), n), key=lambda p: sum(s[k, c] for k, c in enumerate(p)))
        assert M.best_assignment(s) == list(best)


def subset_search(score):
    """Largest sums over subsets of columns, then the first columns that reach it."""
    n, m = score.shape
    best = {}

    def tail(row, mask):
        if row == n:
            return 0
        if (row, mask) not in best:
            best[row, mask] = max(score[row, c] + tail(row + 1, mask | 1 << c) for c in range(m) if not mask >> c & 1)
        return best[row, mask]

    out, mask = [], 0
    for row in range(n):
        c = next(c for c in range(m) if not mask >> c & 1 and score[row, c] + tail(row + 1, mask | 1 << c) == tail(row, mask))
        out.append(c)
        mask |= 1 << c
    return out


@pytest.mark.parametrize("n,m", [(2, 9), (7, 7), (8, 9), (9, 9)])
def test_best_assignment_equals_subset_search(n, m):
    for seed in range(12):
        s = np.random.default_rng([seed, n, m]).integers(0, (2, 3, 50)[seed % 3], (n, m))
        assert M.best_assignment(s) == subset_search(s)


@pytest.mark.parametrize("n", [15, 50, 200])
def test_best_assignment_of_any_size(n):
    rng = np.random.default_rng(n)
    # Known by construction: one cell of each row beats what any other assignment can gain.
    hidden = rng.permutation(n)
    s = rng.uniform(0, 1, (n, n))
    s[np.arange(n), hidden] += 1.0
    assert M.best_assignment(s) == hidden.tolist()
    # No bound from potentials of its own: sums of rows and columns bound every assignment.
    s = rng.integers(0, 30, (n, n)).astype(float)
    to = M.best_assignment(s)
    _, u, v = M._shortest_paths(-s)
    assert sorted(to) == list(range(n)) and (-s - u[:, None] - v >= -1e-9).all()
    assert s[np.arange(n), to].sum() == pytest.approx(-(u.sum() + v.sum()))
    assert s[np.arange(n), to].sum() >= s[np.arange(n), M.greedy_assignment(s)].sum()
    assert M.best_assignment(np.zeros((n, n))) == list(range(n))  # all equal: the first one


def test_optimal_is_not_greedy_beyond_fourteen():
    s = np.full((15, 15), 0.0)
    s[np.arange(15), np.arange(15)] = 2.0
    s[0, 1], s[1, 0] = 3.0, 0.0
    assert sum(s[k, c] for k, c in enumerate(M.greedy_assignment(s))) < sum(s[k, c] for k, c in enumerate(M.best_assignment(s))) == 30


def test_rectangular_leaves_the_surplus_unmatched():
    true = np.eye(3) + 0.01
    m = M.match_rectangular(np.vstack([true[2], true[0], true[1], true[0] * 0.9 + 0.1]), true)
    assert m.learned_to_true[:3] == [3, 1, 2] and m.learned_to_true[3] is None
    with pytest.raises(ValueError):
        M.match_factors(np.ones((2, 3)), np.ones((3, 3)))


def test_cluster_accuracy(spark):
    rows = [(i, z, g) for i, (z, g) in enumerate([(5, 1)] * 4 + [(5, 2)] * 3 + [(9, 1)] * 3 + [(7, 3), (None, 1)])]
    df = spark.createDataFrame(rows, "i long, z int, grp int")
    assert M.cluster_accuracy(df) == pytest.approx(7 / 11)
    assert M.cluster_accuracy(df, "greedy") == pytest.approx(5 / 11)
    assert M.cluster_accuracy(df.limit(0)) == 0.0


def test_permutation_match_agrees(spark):
    rng = np.random.default_rng(3)
    a, b = rng.gamma(1, 1, (4, 9)), rng.gamma(1, 1, (4, 9))
    m = M.match_factors(a, b)
    got = M.permutation_match(M.similarity_frame(spark, m.similarity), 4).orderBy("k").collect()
    assert [r.true_k for r in got] == m.learned_to_true
    assert m.table(spark).count() == 4


def test_cluster_queries_have_every_customer(spark):
    from motifmill import catalogue as Q

    sf = "/root/testdata/sf0.001"
    table = Q.QUERIES["contingency_table"](spark, sf).toPandas()
    n = np.zeros((3, 4))
    n[table.z - 1, table.grp - 1] = table.n
    assert n.sum() == Q.posterior(spark, sf).truth.count() and (n.sum(0) > 0).all()
    best = max(sum(n[k, g] for k, g in enumerate(p)) for p in itertools.permutations(range(4), 3))
    assert Q.QUERIES["cluster_accuracy"](spark, sf).first().accuracy == pytest.approx(best / n.sum(), abs=1e-6)
    left, greedy = n.copy(), 0
    for _ in range(3):
        z, g = np.unravel_index(np.argmax(left), left.shape)
        greedy += left[z, g]
        left[z], left[:, g] = -1, -1
    assert Q.QUERIES["cluster_accuracy_greedy"](spark, sf).first().accuracy == pytest.approx(greedy / n.sum())
