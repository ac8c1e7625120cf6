"""Damping and early stopping of iterative fits."""

from __future__ import annotations

from dataclasses import dataclass


def damping(init: float, ramp: int, it: int) -> float:
    """Step size of 1-based iteration it: from init to 1 over ramp iterations."""
    return min(1.0, init + (1 - init) * (it - 1) / max(ramp - 1, 1))


@dataclass
class Stopper:
    """Stops after ``patience`` evaluations in a row, from min_iters on, with a relative gain below tol. A loss counts as a small gain."""

    tol: float | None
    min_iters: int
    patience: int
    last: float | None = None
    small: int = 0

    def __call__(self, it: int, value: float) -> bool:
        stop = False
        if self.tol is not None and self.last is not None:
            gain = (value - self.last) / (abs(self.last) + 1)
            self.small = self.small + 1 if it >= self.min_iters and gain < self.tol else 0
            stop = it >= self.min_iters and self.small >= self.patience
        self.last = value
        return stop
