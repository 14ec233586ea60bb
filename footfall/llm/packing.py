"""Best-fit packing of documents into sequences under three capacities."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Workspace
from footfall.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = SCHEMA + ", sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold.

    Attention cost is the sum of squared piece lengths. Weights scale the three
    residuals, each as a share of its capacity. `by` selects the bin: `norm`
    takes the bin with the smallest weighted norm of what is left after placing,
    `dot` the one whose residual has the largest weighted dot product with the
    piece. Both obey every capacity.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    by: str = "norm"

    def __post_init__(self):
        if min(self.tokens, self.documents, self.attention) < 1:
            raise ValueError("capacities must be positive")
        if self.attention < self.tokens**2:
            raise ValueError("a whole piece must fit: attention >= tokens squared")
        if self.by not in ("norm", "dot"):
            raise ValueError("by must be 'norm' or 'dot'")


class _Bins:
    """Open bins grouped by what is left in them; equal bins share one row."""

    def __init__(self, capacity: Capacity):
        self.capacity = capacity
        self.left = np.zeros((1024, 3), dtype=np.int64)
        self.bins: list[list[int]] = []
        self.row: dict[tuple[int, int, int], int] = {}
        self.free: list[int] = []
        self.made = 0
        full = (capacity.tokens, capacity.documents, capacity.attention)
        self.scale = np.asarray(capacity.weights) / np.asarray(full, dtype=float)
        self.full = full

    def add(self, left: tuple[int, int, int], numbers: list[int]) -> None:
        if left[0] <= 0 or left[1] <= 0 or left[2] <= 0:
            return  # nothing fits any more
        at = self.row.get(left)
        if at is None:
            if self.free:
                at = self.free.pop()
                self.bins[at] = []
            else:
                at = len(self.bins)
                self.bins.append([])
                if at >= len(self.left):
                    self.left = np.vstack([self.left, np.zeros_like(self.left)])
            self.left[at] = left
            self.row[left] = at
        self.bins[at].extend(numbers)

    def take(self, at: int, count: int) -> list[int]:
        kept = self.bins[at]
        out, self.bins[at] = kept[-count:], kept[:-count]
        if not self.bins[at]:
            del self.row[tuple(self.left[at].tolist())]
            self.left[at] = 0
            self.free.append(at)
        return out

    def scores(self, need: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Lower is better; infinite where a capacity would be passed."""
        after = left - need
        fits = (after >= 0).all(axis=1)
        if self.capacity.by == "norm":
            value = ((after * self.scale) ** 2).sum(axis=1)
        else:
            value = -((left * self.scale) * (need * self.scale)).sum(axis=1)
        return np.where(fits, value, np.inf)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, longest pieces first.

    Pieces of one length are alike, and bins with the same residual are alike, so
    whole groups are placed in one step where that equals placing them singly.
    """
    number = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    bins = _Bins(capacity)
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    edges = np.flatnonzero(np.diff(ordered)) + 1
    for group in np.split(order, edges) if len(order) else []:
        length = int(lengths[group[0]])
        need = np.array([length, 1, length * length], dtype=np.int64)
        done = 0
        while done < len(group):
            rows = len(bins.bins)
            value = bins.scores(need, bins.left[:rows]) if rows else np.array([np.inf])
            at = int(np.argmin(value))
            waiting = len(group) - done
            if np.isfinite(value[at]):
                left = bins.left[at].copy()
                count, best = min(waiting, len(bins.bins[at])), value[at]
            else:
                left, count, best = np.array(bins.full, dtype=np.int64), waiting, np.inf
            after = left - need
            again = bins.scores(need, after[None])[0]
            if again < best:
                # The bin just used would be the best for the next one too.
                count = 1
            if np.isfinite(best):
                chosen = bins.take(at, count)
            else:
                chosen = list(range(bins.made, bins.made + count))
                bins.made += count
            here = group[done : done + count]
            number[here] = chosen
            offset[here] = capacity.tokens - left[0]
            bins.add(tuple(after.tolist()), chosen)
            done += count
    return number, offset


def encoded_pieces(docs: DataFrame, capacity: Capacity, path: str | None = None) -> DataFrame:
    """Pieces of every document: its ids, one closing id 0, cut where too long.

    All pieces but the first of a document have full length.
    """
    path = path or default_path()
    most = capacity.tokens

    def pieces(batches):
        encode = encoder(path).encode
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = memoryview(encode(text) + b"\0\0\0\0")
                total = len(data) // 4
                begin, size, k = 0, (total - 1) % most + 1, 0
                while begin < total:
                    ids.append(doc)
                    piece.append(k)
                    start.append(begin)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * begin : 4 * (begin + size)]))
                    begin, size, k = begin + size, most, k + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, SCHEMA)


def pack(
    pieces: DataFrame, capacity: Capacity = Capacity(), pieces_per_task: int = 60_000
) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces.

    Pieces are dealt evenly over tasks, whatever their documents, so no key can
    be hot; each task packs its pieces by itself and holds three integers per
    piece. The price is at most a few unfilled sequences per task, so a task gets
    many pieces. A task sorts what it was dealt, so a repeated task gives the
    same sequences.
    """
    tasks = max(1, -(-pieces.count() // pieces_per_task))

    def place(batches):
        import pyspark

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows)
        whole = whole.sort_by(
            [(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32")]
        )
        number, offset = best_fit(whole.column("length").to_numpy(), capacity)
        # Partition and number in one long: 2**31 sequences in each of 2**32 tasks.
        base = pyspark.TaskContext.get().partitionId() << 31
        whole = whole.append_column("sequence_id", pa.array(number + base, pa.int64()))
        whole = whole.append_column("offset", pa.array(offset, pa.int64()))
        yield from whole.combine_chunks().to_batches(max_chunksize=20_000)

    return pieces.repartition(tasks).mapInArrow(place, PACKED)


def pack_documents(
    docs: DataFrame, capacity: Capacity = Capacity(), path: str | None = None
) -> DataFrame:
    """Packs whole documents into sequences.

    `docs` needs `doc_id` and `text`; other columns are ignored. A null text is
    empty, and an empty text is the closing id alone. A null `doc_id` stays null,
    repeated rows are each packed, and an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "packing")
    return pack(work.stage(encoded_pieces(docs, capacity, path), "pieces"), capacity)
