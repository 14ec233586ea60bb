"""Text quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted one feature after another, round by round; their
sums are tables looked up by feature bin, so scoring only adds table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import raw_texts, remainder_of

FEATURES = (
    "words", "word_length", "distinct_words", "adjacent_repeats", "commonest_word", "upper",
    "digits", "symbols", "marks", "bars", "symbol_ends", "lines", "distinct_lines", "other_bytes",
    "sentences",
)
_ALPHABET = np.arange(256)
_UPPER = (_ALPHABET >= 65) & (_ALPHABET <= 90)
_LOWER = (_ALPHABET >= 97) & (_ALPHABET <= 122)
_DIGIT = (_ALPHABET >= 48) & (_ALPHABET <= 57)
_SPACE = (_ALPHABET == 32) | ((_ALPHABET >= 9) & (_ALPHABET <= 13))
_OTHER = _ALPHABET >= 128
_POINT = np.isin(_ALPHABET, np.frombuffer(b".,;:?'\"-()", dtype=np.uint8))
_SYMBOL = (_ALPHABET < 128) & ~(_UPPER | _LOWER | _DIGIT | _SPACE | _POINT)
_SYMBOL_BYTES = frozenset(np.flatnonzero(_SYMBOL).tolist())


@dataclass(frozen=True)
class Training:
    """Bounds and steps of the fit; `most_rows` bounds the labelled sample."""

    most_rows: int = 20_000
    bins: int = 48
    pair_bins: int = 12
    rounds: int = 150
    pair_rounds: int = 60
    pairs: int = 6
    rate: float = 0.1
    least_weight: float = 2.0


@dataclass
class Model:
    """Bin edges and lookup tables; the sum of looked-up values is a log-odds."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, values[:, k], side="right")]
        coarse = {
            k: np.searchsorted(self.pair_edges[k], values[:, k], side="right")
            for pair in self.pairs
            for k in pair[:2]
        }
        for a, b, table in self.pairs:
            total += table[coarse[a], coarse[b]]
        return 1.0 / (1.0 + np.exp(-total))


def features(text: bytes | None) -> list[float]:
    """Shape of a whole text; a null text is empty."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    solid = max(1, int(counts[~_SPACE].sum()))
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    lines = [x for x in text.split(b"\n") if x]
    return [
        np.log1p(n),
        solid / n,
        len(tally) / n,
        repeats / n,
        max(tally.values()) / n,
        counts[_UPPER].sum() / letters,
        counts[_DIGIT].sum() / solid,
        counts[_SYMBOL].sum() / solid,
        counts[33] / n,
        counts[124] / n,
        sum(w[-1] in _SYMBOL_BYTES for w in words) / n,
        np.log1p(n / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        counts[_OTHER].sum() / solid,
        counts[46] / n,
    ]


def feature_matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(x) for x in texts], dtype=float).reshape(-1, len(FEATURES))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Best tree of up to three leaves over ordered bins, as a table of steps."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    spans = [(0, len(g))]
    for _ in range(2):
        best, chosen = 1e-9, None
        for low, high in spans:
            left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
            if not len(left_g):
                continue
            all_g, all_h = g[low:high].sum(), h[low:high].sum()
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1)
            gain = np.where((left_h > least) & (right_h > least), gain, -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, chosen = gain[at], (low, low + at + 1, high)
        if chosen is None:
            break
        low, cut, high = chosen
        spans.remove((low, high))
        for a, b in ((low, cut), (cut, high)):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
            spans.append((a, b))
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of a grid into four rectangles: its gain and table of steps."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    all_g, all_h = cg[-1, -1], ch[-1, -1]
    parts = []
    for c, whole in ((cg, all_g), (ch, all_h)):
        near, row, column = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        parts.append((near, row - near, column - near, whole - row - column + near))
    gain = sum(a**2 / (b + 1.0) for a, b in zip(*parts, strict=True)) - all_g**2 / (all_h + 1.0)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    table = np.empty_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            table[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + 1.0)
    return float(gain[i, j]), table


def fit(values: np.ndarray, labels: np.ndarray, training: Training = Training()) -> Model:
    """Cyclic boosting; with one class only, or no rows, a constant model."""
    n, positive = len(labels), float(labels.sum())
    prior = (positive + 1.0) / (n + 2.0)
    model = Model(float(np.log(prior / (1.0 - prior))))
    if n == 0 or positive in (0.0, float(n)):
        return model
    width = values.shape[1]
    model.edges = [_edges(values[:, k], training.bins) for k in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [
        np.searchsorted(e, values[:, k], side="right") for k, e in enumerate(model.edges)
    ]
    total = np.full(n, model.intercept)
    for _ in range(training.rounds):
        for k in range(width):
            p = 1.0 / (1.0 + np.exp(-total))
            size = len(model.tables[k])
            g = np.bincount(binned[k], weights=labels - p, minlength=size)
            h = np.bincount(binned[k], weights=p * (1.0 - p), minlength=size)
            step = training.rate * _step(g, h, training.least_weight)
            model.tables[k] += step
            total += step[binned[k]]
    model.pair_edges = [_edges(values[:, k], training.pair_bins) for k in range(width)]
    coarse = [
        np.searchsorted(e, values[:, k], side="right") for k, e in enumerate(model.pair_edges)
    ]

    def grid(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        rows, columns = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        flat = np.bincount(coarse[a] * columns + coarse[b], weights, rows * columns)
        return flat.reshape(rows, columns)

    p = 1.0 / (1.0 + np.exp(-total))
    ranked = sorted(
        combinations(range(width), 2),
        key=lambda ab: -_quarters(grid(*ab, labels - p), grid(*ab, p * (1.0 - p)))[0],
    )
    model.pairs = [
        (a, b, np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)))
        for a, b in ranked[: training.pairs]
    ]
    for _ in range(training.pair_rounds):
        for a, b, table in model.pairs:
            p = 1.0 / (1.0 + np.exp(-total))
            step = training.rate * _quarters(grid(a, b, labels - p), grid(a, b, p * (1.0 - p)))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, values) of every row."""

    def measure(batches):
        for batch in batches:
            rows = [features(x) for x in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "values"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        measure, "doc_id long, values array<double>"
    )


def learn(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Fits on labelled documents outside the held-out fifth.

    At most `most_rows` labelled ids are drawn, those with the smallest hash, so
    every label is as likely and a rerun draws the same. That bound is also the
    bound of the broadcast, and of what reaches the driver. Labels other than 0
    and 1 and null ids are left out; an id with both labels counts as 1 where
    most of its labels are 1.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .filter(remainder_of(F.col("doc_id"), 5) != 0)
        .groupBy("doc_id")
        .agg(F.rint(F.avg("quality")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(training.most_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = with_features(texts.join(F.broadcast(chosen), "doc_id", "left_semi"))
    one_each = measured.groupBy("doc_id").agg(F.min("values").alias("values"))
    rows = one_each.join(chosen, "doc_id").select("doc_id", "values", "label").toPandas()
    rows = rows.sort_values("doc_id")
    values = np.array(rows["values"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit(values, rows["label"].to_numpy(dtype=float), training)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from its whole text."""

    def score(batches):
        for batch in batches:
            scores = model.score(feature_matrix(raw_texts(batch)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        score, "doc_id long, score double"
    )


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, training: Training = Training()
) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row of `docs`.

    Reads `doc_id` and `text` of the documents, `doc_id` and `quality` of the
    labels; other columns are ignored. Null and empty texts get the score of an
    empty text, a null `doc_id` counts as the text '' for `held_out`, repeated
    rows each get a row, and an empty table gives none.
    """
    scored = score_documents(docs, learn(docs, labels, training))
    return scored.select(
        "doc_id",
        (remainder_of(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
