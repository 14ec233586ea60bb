"""Whitening of embeddings by a bidiagonal qd solver.

Rows are centred exactly in whole numbers, blocks of them are reduced to triangles
by QR, triangles are merged in a tree, and the last one, whose size is the
dimension, gives the principal directions (`bidiagonal`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.bidiagonal import leading_directions
from footfall.llm.common import Workspace, whole_groups
from footfall.llm.topk import usable

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
_MERGED_AT_ONCE = 16
_ROWS_AT_ONCE = 4096
_WHOLE = float(2**53)
_LONG = 2**62


def whole_numbers(values: np.ndarray, ids: list, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """floor(scale * x) + offset as int64; a component too large for that raises."""
    scaled = np.floor(scale * values)
    large = np.abs(scaled) >= _WHOLE
    if large.any():
        row = int(np.flatnonzero(large.any(axis=1))[0])
        raise OverflowError(f"vector {ids[row]} has a component beyond 2^53 / {scale}")
    return scaled.astype(np.int64) + offset


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, whole-number rows of one length) of batches of (vec_id, vector)."""
    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            own = batch if (lengths == length).all() else batch.filter(pa.array(lengths == length))
            for start in range(0, own.num_rows, _ROWS_AT_ONCE):
                part = own.slice(start, _ROWS_AT_ONCE)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ids = part.column(0).to_pylist()
                yield ids, whole_numbers(values.reshape(part.num_rows, int(length)), ids)


@dataclass(frozen=True)
class Centre:
    """Count and exact component sums of the vectors of one length."""

    n: int
    sums: tuple[int, ...]

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64 where it fits, else Python's whole numbers."""
        most = self.n * int(np.abs(rows).max()) + max(map(abs, self.sums))
        if most < _LONG:
            return self.n * rows - np.array(self.sums, dtype=np.int64)
        return self.n * rows.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64)

    def squares(self, deviations: np.ndarray) -> pa.Array:
        """Sum of squared deviations of each row, exact, as decimals."""
        largest = int(np.abs(deviations).max())
        if largest * largest * deviations.shape[1] >= _LONG:
            deviations = deviations.astype(object)
        sums = (deviations * deviations).sum(axis=1)
        return pa.array(sums.tolist(), pa.decimal128(38, 0))


def centres_of(vectors: DataFrame) -> dict[int, Centre]:
    """Exact counts and sums by vector length; only these sums reach the driver."""

    def fold(batches: Iterator[pa.RecordBatch]):
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for ids, rows in _blocks(batches):
            length = rows.shape[1]
            # A block's sums fit: at most 4,096 times 2^53 would not, so add in halves of 32 bits.
            low, high = rows & 0xFFFFFFFF, rows >> 32
            block = low.sum(axis=0).astype(object) + (high.sum(axis=0).astype(object) << 32)
            sums[length] = sums[length] + block if length in sums else block
            counts[length] = counts.get(length, 0) + len(ids)
        lengths, places, totals = [], [], []
        for length, total in sums.items():
            lengths += [length] * (length + 1)
            places += range(-1, length)
            totals += [counts[length], *map(int, total)]
        if lengths:
            yield pa.RecordBatch.from_arrays(
                [pa.array(lengths, pa.int32()), pa.array(places, pa.int32()), pa.array(totals, pa.decimal128(38, 0))],
                names=["length", "place", "total"],
            )

    partial = vectors.mapInArrow(fold, "length int, place int, total decimal(38,0)")
    totals = partial.groupBy("length", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    found: dict[int, dict[int, int]] = {}
    for row in totals.collect():
        found.setdefault(row["length"], {})[row["place"]] = int(row["total"])
    return {k: Centre(v[-1], tuple(v[j] for j in range(k))) for k, v in found.items()}


def _triangle(above: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """R of the rows below an earlier R, always square."""
    size = rows.shape[1]
    stacked = rows if above is None else np.vstack([above, rows])
    reduced = np.linalg.qr(stacked, mode="r")
    if reduced.shape[0] < size:
        reduced = np.vstack([reduced, np.zeros((size - reduced.shape[0], size))])
    return reduced


_TRIANGLES = "length int, part long, r binary"


def _triangle_rows(found: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.int32()),
            pa.array([k[1] for k in keys], pa.int64()),
            pa.array([found[k].tobytes() for k in keys], pa.binary()),
        ],
        names=["length", "part", "r"],
    )


def triangles(vectors: DataFrame, centres: dict[int, Centre]) -> dict[int, np.ndarray]:
    """R of the centred rows, by length.

    A task folds its rows block by block into one triangle, and triangles are merged
    16 at a time, each turn written, until one is left; a task never holds more than
    a block or 16 triangles.
    """
    work = Workspace(vectors.sparkSession, "whitening")

    def reduce(batches: Iterator[pa.RecordBatch]):
        part, own = TaskContext.get().partitionId(), {}
        for _, rows in _blocks(batches):
            centre, key = centres[rows.shape[1]], (rows.shape[1], part)
            own[key] = _triangle(own.get(key), centre.centred(centre.deviations(rows)))
        if own:
            yield _triangle_rows(own)

    def merge(batches: Iterator[pa.RecordBatch]):
        for table in whole_groups(batches, 2):
            own: dict[tuple[int, int], np.ndarray] = {}
            for length, part, _, r in zip(*(c.to_pylist() for c in table.columns), strict=True):
                block = np.frombuffer(r).reshape(length, length)
                own[length, part] = _triangle(own.get((length, part)), block)
            yield _triangle_rows(own)

    rows, turn = work.stage(vectors.mapInArrow(reduce, _TRIANGLES), "triangles-0"), 0
    while (rows.agg(F.max("part")).first()[0] or 0) > 0:
        turn += 1
        group = F.floor(F.col("part") / F.lit(_MERGED_AT_ONCE)).cast("long")
        dealt = (
            rows.select("length", group.alias("group"), F.col("part").alias("place"), "r")
            .repartition("length", "group").sortWithinPartitions("length", "group", "place")
        )
        rows = work.stage(dealt.mapInArrow(merge, _TRIANGLES), f"triangles-{turn}")
        work.drop(f"triangles-{turn - 1}")
    last = {r["length"]: np.frombuffer(r["r"]).reshape(r["length"], r["length"]) for r in rows.collect()}
    work.drop(f"triangles-{turn}")
    return last


@dataclass(frozen=True)
class Whitening:
    """Directions of one length: `directions` columns already divided by sqrt(variance)."""

    centre: Centre
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def apply(self, deviations: np.ndarray) -> np.ndarray:
        return self.centre.centred(deviations) @ self.directions


def learn(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Whitening by vector length, from all rows of (vec_id, vector)."""
    centres = centres_of(vectors)
    fitted = {}
    for length, r in triangles(vectors, centres).items():
        squares, directions = leading_directions(r, components)
        variances = squares / centres[length].n
        fitted[length] = Whitening(
            centres[length],
            directions / np.sqrt(variances),
            variances,
            squares / float((r * r).sum()) if len(squares) else squares,
        )
    return fitted


def identity_errors(vectors: DataFrame, fitted: dict[int, Whitening]) -> dict[int, float]:
    """Largest entry of (covariance of the whitened rows - identity), measured on all rows."""

    def fold(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for _, rows in _blocks(batches):
            own = fitted[rows.shape[1]]
            white = own.apply(own.centre.deviations(rows))
            block = np.vstack([white.sum(axis=0), white.T @ white])
            sums[rows.shape[1]] = sums.get(rows.shape[1], 0.0) + block
        for length, total in sums.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(total.size, length), pa.int32()), pa.array(i.ravel(), pa.int32()),
                    pa.array(j.ravel(), pa.int32()), pa.array(total.ravel()),
                ],
                names=["length", "i", "j", "total"],
            )

    partial = vectors.mapInArrow(fold, "length int, i int, j int, total double")
    found = {k: np.zeros((len(w.variances) + 1, len(w.variances))) for k, w in fitted.items()}
    for row in partial.groupBy("length", "i", "j").agg(F.sum("total").alias("total")).collect():
        found[row["length"]][row["i"], row["j"]] = row["total"]
    errors = {}
    for length, total in found.items():
        mean, n = total[0] / fitted[length].centre.n, fitted[length].centre.n
        covariance = total[1:] / n - np.outer(mean, mean)
        errors[length] = float(np.abs(covariance - np.eye(len(mean))).max(initial=0.0))
    return errors


_OUT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
    "explained double, identity_error double"
)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: `vec_id, component, n, deviation, whitened,
    explained, identity_error`.

    `embeddings` needs `vec_id` and `embedding`; other columns are ignored. Null
    vectors and those with null or non-finite entries are dropped; an empty vector
    has no component and so no row. Repeated rows count as often as they occur and
    are all returned; a null id stays null. Vectors of different lengths are fitted
    apart, each length with its own n. A direction without variance cannot be
    whitened: vectors that span fewer than `components` directions get fewer rows,
    and equal vectors, or a single one, none. Equal variances share an arbitrary
    orthonormal basis, the same for all rows. Components beyond 2^53 / 1024 raise.
    An empty table gives no rows.

    The table is read four times (sums, triangles, audit, output) and never
    shuffled; between the passes travel one triangle a task and sums.
    """
    vectors = embeddings.filter(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    fitted = learn(vectors, components)
    errors = identity_errors(vectors, fitted)

    def project(batches: Iterator[pa.RecordBatch]):
        for ids, rows in _blocks(batches):
            own = fitted[rows.shape[1]]
            found, count = len(own.variances), len(ids)
            deviations = own.centre.deviations(rows)
            each = np.repeat(np.arange(count), found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, found + 1), count), pa.int32()),
                    pa.array(np.full(len(each), own.centre.n), pa.int64()),
                    own.centre.squares(deviations).take(pa.array(each)),
                    pa.array(own.apply(deviations).ravel()),
                    pa.array(np.tile(own.explained, count)),
                    pa.array(np.full(len(each), errors[rows.shape[1]])),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project, _OUT)
