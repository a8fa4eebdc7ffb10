"""Fits of what was known at many times, from blocks of a series that merge.

A block of rows is summed up by its count, its means and the triangular factor of its centred columns. Two blocks merge by
one small decomposition of both factors and the distance of the means, which loses no more digits than the rows themselves
would. So a series is cut into blocks of bounded size: blocks are summed up wherever they lie, their summaries are chained
in order, and each block then starts from what all blocks before it come to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal ``keys``, one frame per run, from batches sorted by them."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        changed = np.zeros(len(frame), dtype=bool)
        for key in keys:
            column = frame[key].to_numpy()
            changed[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), len(frame)]
        for begin, end in zip(starts, starts[1:], strict=False):
            part = frame.iloc[begin:end]
            this = tuple(part[key].iloc[0] for key in keys)
            if held and this != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            last = this
    if held:
        yield pd.concat(held, ignore_index=True)


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of some rows, square whatever their number."""
    width = rows.shape[1]
    factor = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, width))
    return np.vstack((factor, np.zeros((width - len(factor), width)))) if len(factor) < width else factor


@dataclass
class Moments:
    """Count, means and centred factor of rows; the last column is the target."""

    n: int
    mean: np.ndarray
    factor: np.ndarray

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(0, np.zeros(width), np.zeros((width, width)))

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        if not len(rows):
            return cls.none(rows.shape[1])
        mean = rows.mean(axis=0)
        return cls(len(rows), mean, _factor(rows - mean))

    def stacked(self, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Count and means with some more rows, and centred rows that have the same products as all of them."""
        if not len(rows):
            return self.n, self.mean, self.factor
        mean = rows.mean(axis=0)
        if not self.n:
            return len(rows), mean, rows - mean
        n = self.n + len(rows)
        apart = np.sqrt(self.n * (len(rows) / n)) * (mean - self.mean)
        return n, self.mean + (mean - self.mean) * (len(rows) / n), np.vstack((self.factor, rows - mean, apart))

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n = self.n + other.n
        apart = np.sqrt(self.n * (other.n / n)) * (other.mean - self.mean)
        mean = self.mean + (other.mean - self.mean) * (other.n / n)
        return Moments(n, mean, _factor(np.vstack((self.factor, other.factor, apart))))

    def packed(self) -> list[float]:
        return [float(self.n), *self.mean.tolist(), *self.factor.ravel().tolist()]

    @classmethod
    def unpacked(cls, values: Sequence[float], width: int) -> Moments:
        values = np.asarray(values, dtype="float64")
        return cls(int(values[0]), values[1 : 1 + width], values[1 + width :].reshape(width, width))


def damped_fit(n: int, mean: np.ndarray, rows: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and slopes of ``n`` observations from their means and centred rows (or rows with the same products).

    The singular directions are each damped by the penalty; directions without spread get no slope, which is the smallest
    solution among equals. A penalty of zero damps nothing, so every penalty takes the same way.
    """
    width = rows.shape[1] - 1
    left, spread, right = np.linalg.svd(rows[:, :width], full_matrices=False)
    told = spread > np.finfo(float).eps * max(n, width) * max(spread.max(initial=0.0), np.abs(mean[:width]).max(initial=0.0))
    gain = np.divide(spread, spread**2 + penalty, out=np.zeros_like(spread), where=told)
    slopes = right.T @ (gain * (left.T @ rows[:, width]))
    return float(mean[width] - mean[:width] @ slopes), slopes


class Running:
    """Sums of a block's rows about the mean of the blocks before it, after each of its rows (place 0: none yet)."""

    def __init__(self, before: Moments, rows: np.ndarray):
        self.before, self.rows = before, rows
        self.shift = before.mean if before.n or not len(rows) else rows[0]
        apart = np.vstack((np.zeros((1, rows.shape[1])), rows - self.shift))
        self.n = before.n + np.arange(len(rows) + 1)
        self.sums = np.cumsum(apart, axis=0)
        self.products = np.cumsum(apart[:, :, None] * apart[:, None, :], axis=0) + before.factor.T @ before.factor

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts, means from the shift, centred products and plain products of the rows known at each place."""
        n, sums, products = self.n[places].astype("float64"), self.sums[places], self.products[places]
        counted = np.maximum(n, 1.0)
        mean = sums / counted[:, None]
        return n, mean, products - counted[:, None, None] * mean[:, :, None] * mean[:, None, :], products


def smoothed(y: np.ndarray, decay: float, before: float | None) -> np.ndarray:
    """The smoothed value before the first and after each of some observations, from the value before them (if any)."""
    if not len(y):
        return np.array([np.nan if before is None else before])
    started = pd.Series(y).ewm(alpha=1.0 - decay, adjust=False).mean().to_numpy()
    if before is not None:
        started = started + decay ** np.arange(1, len(y) + 1) * (before - y[0])
    return np.concatenate(([np.nan if before is None else before], started))
