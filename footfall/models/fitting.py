"""Maximum likelihood by Newton steps, with every data pass a Spark job.

A kernel gives weighted sums of log-likelihood, slope and curvature for many
parameter vectors at once. One job folds the kernel over all partitions into one
partial sum per task and vector; only those sums reach the driver. Problems that
differ in their penalty advance together, so a whole penalty grid costs little
more passes than one fit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (columns, weights, vectors) to a row per vector: log-likelihood, the k slopes, and
#: the k (k + 1) / 2 second derivatives of the upper triangle, row by row.
Kernel = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]

_STEPS = (8.0, 1.0, 0.25)
_MAX_MOVE = 8.0
_CHUNK_CELLS = 200_000
_ROWS_PER_PARTITION, _LEAST_ROWS = 50_000, 5_000
# Of a long row of penalties every so many-th is fitted first; the others begin
# between their neighbours.
_ANCHOR_EVERY = 11
# Curvature per customer, in log-parameters, below which data say nothing.
_FLAT = 1e-7
# Least parameter value; one that the data push towards zero is held there.
LEAST = 1e-12
_LOWEST = float(np.log(LEAST))
# Objectives nearer than this, and slopes below the other, are rounding.
_NOISE, _NO_SLOPE = 1e-11, 1e-12


@dataclass(frozen=True)
class Fit:
    """Natural-scale parameters of one penalised fit."""

    params: tuple[float, ...]
    penalty: float
    objective: float
    converged: bool
    passes: int
    customers: float = float("nan")
    curvature: tuple[tuple[float, ...], ...] = ()


@dataclass(frozen=True)
class Identified:
    """Standard errors by parameter, and the parameters that no data pin down."""

    errors: dict[str, float]
    flat: tuple[str, ...]


def identified(fit: Fit, names: Sequence[str]) -> Identified:
    """Standard errors from the observed information, the inverse curvature.

    The curvature is that of the penalised objective in log-parameters, so errors
    are relative ones times the value. Directions without curvature are left out of
    the inverse; a parameter that lies along one of them is flat and has no error.
    """
    values, vectors = np.linalg.eigh(np.array(fit.curvature))
    seen = values > _FLAT
    lost = (vectors[:, ~seen] ** 2).sum(axis=1) > 0.01
    spread = (vectors[:, seen] ** 2 / values[seen]).sum(axis=1) / fit.customers
    errors = np.where(lost, np.nan, np.array(fit.params) * np.sqrt(spread))
    return Identified(
        {n: float(e) for n, e in zip(names, errors, strict=True)},
        tuple(n for n, gone in zip(names, lost, strict=True) if gone),
    )


def spread_out(data: DataFrame) -> DataFrame:
    """Rows dealt evenly: over all cores, but not in smaller parts than a task is worth.

    A fit is heavy on few bytes, and size-based coalescing would leave most
    cores idle; the deal happens once, before the passes.
    """
    rows, cores = data.count(), data.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, rows // _LEAST_ROWS + 1), rows // _ROWS_PER_PARTITION + 1)
    return data.repartition(parts)


def sum_over(
    data: DataFrame, kernel: Kernel, columns: Sequence[str], weight: str, points: np.ndarray
) -> np.ndarray:
    """Kernel sums over all rows, one row per parameter vector."""
    count, size = points.shape
    width = 1 + size + size * (size + 1) // 2
    rows_at_once = max(1, _CHUNK_CELLS // count)

    def fold(batches):
        sums = np.zeros((count, width))
        for batch in batches:
            arrays = {
                name: batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                for i, name in enumerate([*columns, weight])
            }
            for start in range(0, batch.num_rows, rows_at_once):
                part = {name: values[start : start + rows_at_once] for name, values in arrays.items()}
                sums += kernel(part, part[weight], points)
        cells = [pa.array(np.arange(count * width)), pa.array(sums.ravel())]
        yield pa.RecordBatch.from_arrays(cells, names=["cell", "total"])

    partial = data.select(*columns, weight).mapInArrow(fold, "cell long, total double")
    found = partial.groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    result = np.zeros(count * width)
    result[found["cell"].to_numpy()] = found["total"].to_numpy()
    return result.reshape(count, width)


def fit_penalised(
    data: DataFrame,
    kernel: Kernel,
    columns: Sequence[str],
    weight: str,
    starts: Sequence[Sequence[float]],
    penalties: Sequence[float],
    max_passes: int = 60,
    tolerance: float = 1e-12,
) -> list[Fit]:
    """Minimise mean(-log L) + penalty * sum(params^2) for each penalty.

    The search runs in log-parameters above `LEAST`. A short list of penalties begins at the best
    of the starts. Of a long one, evenly spread anchors do, and the others continue
    from between the optima of their neighbours, which leaves them a few steps.
    `max_passes` is a safety stop: a problem it cuts short is returned with
    `converged` false, and callers must not use it as an optimum (`settled_only`
    raises).
    """
    total = data.agg(F.sum(weight)).first()[0]
    if not total:
        raise ValueError("no customers to fit")
    search = _Search(data, kernel, columns, weight, float(total), max_passes, tolerance)
    lam = np.asarray(penalties, dtype=float)
    origin = np.log(np.asarray(starts, dtype=float))
    order = np.argsort(lam, kind="stable")
    first = order if len(lam) <= _ANCHOR_EVERY else order[np.unique([*range(0, len(lam), _ANCHOR_EVERY), len(lam) - 1])]
    fits = dict(zip(first.tolist(), search.run(lam[first], [origin] * len(first)), strict=True))
    rest = [i for i in order.tolist() if i not in fits]
    if rest:
        known = np.array([np.log(fits[i].params) for i in first.tolist()])
        place = np.interp(np.argsort(order)[rest], np.argsort(order)[first], np.arange(len(first)))
        low = np.floor(place).astype(int)
        part = (place - low)[:, None]
        between = known[low] * (1.0 - part) + known[np.minimum(low + 1, len(first) - 1)] * part
        fits.update(zip(rest, search.run(lam[rest], [b[None] for b in between]), strict=True))
    return [fits[i] for i in range(len(lam))]


class _Search:
    """Newton steps for many penalties side by side."""

    def __init__(self, data, kernel, columns, weight, total, max_passes, tolerance):
        self.data, self.kernel, self.columns, self.weight = data, kernel, columns, weight
        self.total, self.max_passes, self.tolerance = total, max_passes, tolerance

    def around(self, centres: np.ndarray, lam: np.ndarray):
        """Objective, slope and curvature in log-parameters at each centre, from one pass."""
        size = centres.shape[1]
        params = np.exp(centres)
        sums = sum_over(self.data, self.kernel, self.columns, self.weight, params) / -self.total
        extra = lam[:, None] * params**2
        value = sums[:, 0] + extra.sum(axis=1)
        slope = sums[:, 1 : size + 1] * params + 2.0 * extra
        curve = np.zeros((len(centres), size, size))
        upper = np.triu_indices(size)
        curve[:, upper[0], upper[1]] = sums[:, size + 1 :] * params[:, upper[0]] * params[:, upper[1]]
        curve = np.triu(curve) + np.triu(curve, 1).transpose(0, 2, 1)
        diagonal = np.arange(size)
        curve[:, diagonal, diagonal] += slope + 2.0 * extra
        sound = np.isfinite(value) & np.isfinite(curve).all(axis=(1, 2)) & np.isfinite(slope).all(axis=1)
        return np.where(sound, value, np.inf), slope, curve

    def run(self, lam: np.ndarray, origins: Sequence[np.ndarray]) -> list[Fit]:
        problems = np.arange(len(lam))
        owner = np.repeat(problems, [len(o) for o in origins])
        centres = np.vstack(origins)
        values, slopes, curves = self.around(centres, lam[owner])
        first = [int(np.flatnonzero(owner == i)[np.argmin(values[owner == i])]) for i in problems]
        theta, value, slope, curve = centres[first], values[first], slopes[first], curves[first]
        shrink = np.ones(len(lam))
        settled = _steepness(theta, slope) < self.tolerance
        passes = 1
        while passes < self.max_passes:
            active = problems[~settled & (shrink > 1e-6)]
            if active.size == 0:
                break
            moves = np.stack([_moves(theta[i], slope[i], curve[i], shrink[i]) for i in active])
            centres = (theta[active][:, None, :] + moves).reshape(-1, theta.shape[1])
            centres = np.maximum(centres, _LOWEST)
            values, slopes, curves = self.around(centres, lam[np.repeat(active, len(_STEPS))])
            passes += 1
            for place, i in enumerate(active):
                tried = slice(place * len(_STEPS), (place + 1) * len(_STEPS))
                best = tried.start + int(np.argmin(values[tried]))
                steep = _steepness(centres[tried], slopes[tried])
                before = _steepness(theta[i], slope[i])
                noise = _NOISE * max(1.0, abs(value[i]))
                if value[i] - values[best] <= noise:
                    # Values no longer tell points apart, but slopes still do.
                    level = np.where(values[tried] <= value[i] + noise, steep, np.inf)
                    best = tried.start + int(np.argmin(level))
                    if level.min() >= before:
                        # Flat to the limit of rounding, or else look closer in.
                        settled[i] = before < 1e-9
                        shrink[i] *= 0.01
                        continue
                theta[i], value[i], slope[i], curve[i] = centres[best], values[best], slopes[best], curves[best]
                settled[i] = _steepness(theta[i], slope[i]) < self.tolerance
                shrink[i] = 1.0
        return [
            Fit(
                tuple(map(float, np.exp(theta[i]))), float(lam[i]), float(value[i]), bool(settled[i]),
                passes, self.total, tuple(map(tuple, curve[i].tolist())),
            )
            for i in problems
        ]


def settled_only(fits: Sequence) -> list:
    """The same fits, or an error that names the penalties that did not converge."""
    open_ = [fit.penalty for fit in fits if not fit.converged]
    if open_:
        raise RuntimeError(f"no optimum reached for penalties {open_}")
    return list(fits)


def _held(theta: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Parameters at their least value that would go lower still."""
    return (theta <= _LOWEST) & (slope > 0)


def _steepness(theta: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Largest slope of the parameters that may move."""
    return np.where(_held(theta, slope), 0.0, np.abs(slope)).max(axis=-1)


def _moves(theta: np.ndarray, slope: np.ndarray, curve: np.ndarray, shrink: float) -> np.ndarray:
    """Newton direction, negative curvature turned round, at each step length.

    A length above one covers flat directions, where a parameter drifts
    towards zero; every move is bounded. Curvature is weighed against the slope
    along it, so that a direction that flattens out keeps its Newton step.
    """
    free = ~_held(theta, slope)
    values, vectors = np.linalg.eigh(curve[np.ix_(free, free)])
    along = vectors.T @ slope[free]
    along[np.abs(along) < _NO_SLOPE] = 0.0
    direction = np.zeros(len(theta))
    direction[free] = -vectors @ (along / np.maximum(np.abs(values), np.abs(along) / _MAX_MOVE + 1e-300))
    moves = np.outer(np.asarray(_STEPS) * shrink, direction)
    largest = np.abs(moves).max(axis=1, keepdims=True)
    return moves * np.minimum(1.0, _MAX_MOVE / np.maximum(largest, 1e-300))
