"""Score a stream of packed samples with fixed factors or a fixed mixture: each sample is scored by itself, so no state is kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators import batch as B
from ..operators.fits import EffectsFit, MixtureFit, _hard_params, _soft_params, random_effects
from ..plans.schedule import damping
from ..plans.ship import ship
from ..plans.sweep import ROWS, batch_of

PACKED = "i long, mi array<int>, y array<double>, total double"


def _rows(stream: DataFrame, score, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                columns = score(b["i"].to_numpy(), batch_of(b))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))

    ship(stream.sparkSession)
    return stream.select("i", "mi", "y", "total").mapInArrow(run, schema)


def score_effects(stream: DataFrame, fit: EffectsFit, iters: int = 50, seed: int = 0, prior_shape: float = 1.0, prior_rate: float = 1.0) -> DataFrame:
    """i, k, score of each streamed (or batch) sample under fitted factors."""
    F, D = fit.factors, fit.D
    K, log_f, f_sum = len(F), np.log(F), F.sum(1)

    def score(ids, b):
        e = random_effects(ids, D, K, seed, f_sum, prior_shape, prior_rate)
        for it in range(1, iters + 1):
            B.effects_sweep(b, e, log_f, f_sum, damping(0.1, 50, it), True)
        s = (e.gamma * e.alpha / e.rate).sum(1)
        return {"i": np.repeat(ids, K), "k": np.tile(np.arange(1, K + 1, dtype=np.int32), len(ids)), "score": s.ravel()}

    return _rows(stream, score, "i long, k int, score double")


def score_mixture(stream: DataFrame, fit: MixtureFit, inner: int = 8) -> DataFrame:
    """i, s, w, z_hat of each streamed (or batch) sample under a fitted hard or soft mixture."""
    S, D, pi = fit.S, fit.D, fit.pi
    hard = fit.motifs is not None
    p = _hard_params(fit.factors, fit.motifs, fit.alpha0, fit.rate0) if hard else _soft_params(fit.factors, fit.gamma, fit.alpha0, fit.rate0, fit.scale)

    def score(ids, b):
        if hard:
            _, bound, _ = B.hard_components(b, p, inner)
        else:
            start = p.alpha0 + np.tile((b.total / D)[:, None, None], (1, S, D))
            _, bound, _ = B.soft_components(b, start, p, inner)
        w = B.softmax(bound + np.log(np.maximum(pi, B.EPS)))
        z = np.argmax(w, 1).astype(np.int32) + 1
        return {"i": np.repeat(ids, S), "s": np.tile(np.arange(1, S + 1, dtype=np.int32), len(ids)), "w": w.ravel(), "z_hat": np.repeat(z, S)}

    return _rows(stream, score, "i long, s int, w double, z_hat int")
