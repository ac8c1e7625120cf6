"""Packing in order of samples, the bytes of a pass, and clusters by columns."""

import numpy as np
import pyarrow as pa

from motifmill.operators import batch as B
from motifmill.operators import cluster, fits
from motifmill.plans import sweep as S
from motifmill.sources import counts as C


def test_rows_of_cells_across_batches():
    rng = np.random.default_rng(3)
    i = np.sort(rng.integers(0, 12, 60))
    m, y = np.arange(60, dtype=np.int32), rng.random(60)
    want = [(k, m[i == k].tolist(), y[i == k].tolist()) for k in np.unique(i)]
    for size in (1, 2, 7, 60):
        cells = pa.RecordBatch.from_arrays([pa.array(i), pa.array(m), pa.array(y)], names=["i", "m", "y"])
        parts = [cells.slice(k, size) for k in range(0, 60, size)]
        rows = [r for b in C._rows_of_cells(iter(parts)) for r in b.to_pylist()]
        assert [(r["i"], r["mi"], r["y"]) for r in rows] == want
        assert np.allclose([r["total"] for r in rows], [sum(w[2]) for w in want])


def test_bytes_and_arrays_give_the_same_batch():
    mi, y = [[1, 4], [], [2], [3, 5, 6]], [[1.0, 2.0], [], [3.0], [4.0, 5.0, 6.0]]
    arrays = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(mi, pa.list_(pa.int32())), pa.array(y, pa.list_(pa.float64())), pa.array([3.0, 0.0, 3.0, 15.0])], names=["i", "mi", "y", "total"])
    written = S.with_state(arrays, np.zeros((4, 2)))
    for lo, n in ((0, 4), (1, 3), (1, 1), (2, 2), (4, 0)):
        a, b = S.batch_of(arrays.slice(lo, n)), S.batch_of(written.slice(lo, n))
        assert a.m.tolist() == b.m.tolist() == [x - 1 for r in mi[lo : lo + n] for x in r]
        assert a.row.tolist() == b.row.tolist() and a.y.tolist() == b.y.tolist() == [x for r in y[lo : lo + n] for x in r]
    again = S.with_state(written.slice(1, 3), np.ones((3, 1)))
    assert S.batch_of(again).y.tolist() == [3.0, 4.0, 5.0, 6.0]


def test_nearest_centres_and_draws_against_all_pairs():
    rng = np.random.default_rng(4)
    x, c = rng.random((500, 3)).round(1), rng.random((7, 3)).round(1)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    z, least = cluster.assign(np.asfortranarray(x), c)
    assert z.tolist() == d.argmin(1).tolist() and np.array_equal(least, d.min(1))
    i = np.arange(500)
    key = np.log(cluster._uniform(i, 5, 0, 7)) / np.where(d.min(1) > 0, d.min(1), np.nan)
    want = sorted(np.flatnonzero(d.min(1) > 0), key=lambda k: (-key[k], k))[:9]
    assert [t[2] for t in cluster._drawn(i, x, [c], 9, 5)] == want
    sums = cluster._sums(x, c[None])[0]
    assert np.allclose(sums[:, :3], [x[z == s].sum(0) for s in range(7)]) and sums[:, 3].tolist() == np.bincount(z, minlength=7).tolist()


def test_cell_matrices_lie_by_column():
    """Along short rows numpy takes several times as long."""
    rng = np.random.default_rng(5)
    b = B.Batch(3, np.array([0, 0, 1, 2]), np.array([0, 3, 1, 2]), np.ones(4), np.array([2.0, 1.0, 1.0]))
    p = B.Motifs(rng.random((2, 3, 4)), np.ones((2, 3)), np.zeros((2, 3)), np.ones((2, 3)), np.ones((2, 3)), np.ones((2, 3)))
    xi, elf, _ = B.slot_shares(b, np.ones((3, 3)), p, 1)
    assert xi.flags.f_contiguous and elf.flags.f_contiguous
    e = fits.random_effects(np.arange(3), 2, 5, 1, np.ones(5), 1.0, 1.0)
    xi, elf = B.effect_shares(b, e, np.log(rng.random((5, 4)) + 0.1))
    assert xi.flags.f_contiguous and elf.flags.f_contiguous


def test_full_mixtures_pack_their_cells_once(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id % 20 as i", "cast(id * id % 7 as string) as name")
    packs = []
    packed = C.Counts.packed
    monkeypatch.setattr(C.Counts, "packed", lambda self: packs.append(1) or packed(self))
    for fit in (fits.soft_mixture, fits.hard_mixture):
        packs.clear()
        fit(C.counts_from(rows, "i", "name"), 2, 2, 2, 1, 1, 1, 1, seed=1)
        assert len(packs) == 1
