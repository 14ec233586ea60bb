"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is the sequence of its lower-cased words and one end. It is spelled in its
order, byte by byte, a blank behind every word, each byte as the bits of a prefix code
in which bytes frequent in training have few. For every bit, several predictors look up what followed the same context in training: the
last few bytes, across the blanks, and the word before with what is spelled of the
word so far. Their predictions are combined in the logistic domain by weights that
a gate selects, and the result is refined by a table learnt beside them. Counts,
weights and refinement are learnt from all training texts in their order, and every
bit of every text is predicted where it stands.

The spelling is also mixed with what is known of whole words: a word seen in
training keeps its discounted share, and what the discounts leave is spelled.
That is done for several kinds of documents, found by clustering word
profiles; a text is given by its spelling alone and by all of them together, and as
it goes on, those that predict it well outweigh the others.

Last, the words before a place, looked up where they stood earlier in the text, say
which word may come now. How far that is trusted is a probability gated by the length
of the context and by whether the word before came as told, and it adapts with every
word of the text. All steps are probabilities, so the score is the logarithm of one.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Workspace, mix64, raw_texts, remainder_of, runs, words_of

CHUNK_BYTES = 12_000_000
CHUNKS = (
    "chunk long, words binary, profiles binary, rows binary, sizes binary, ids binary, "
    "told binary, trust array<long>, letters array<long>"
)
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double, bits_per_byte double"
)
# The end of a text, as a word that no text holds.
END = b""
# Contexts in a text: one word, two words, two words after a word that came as told.
FOLLOWED = 3


@dataclass(frozen=True)
class Mixing:
    """Context orders and sizes; the model's memory is bounded by `slot_bits`."""

    orders: tuple[int, ...] = (1, 2, 3, 4, 6)
    slot_bits: int = 20
    block_bits: int = 14
    prior: float = 0.4
    batch_words: int = 8_000
    batch_bytes: int = 1 << 18
    bytes_per_task: int = 1 << 24
    least_steps: int = 24
    refine_prior: float = 20.0
    kinds: int = 12
    profile: int = 512
    most_rounds: int = 25
    drawn_at_once: int = 3
    trust_prior: float = 4.0

    @property
    def gates(self) -> int:
        return 4**3

    @property
    def contexts(self) -> int:
        """Contexts of a bit in a text: the orders, and the word before."""
        return len(self.orders) + 1


# --- words to bits -----------------------------------------------------------


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Code:
    """Bits of every byte, and by byte what `Spelled` looks up for each of them.

    Bits are taken four at a time: `group` names the bits of a byte before its four,
    `inner` the place among the 15 that these four bits can reach.
    """

    def __init__(self, bits: list[str]):
        self.size = np.array([len(b) for b in bits])
        most = int(self.size.max())
        self.value = np.zeros((most, 256), dtype=np.int8)
        self.node = np.zeros((most, 256), dtype=np.int64)
        self.inner = np.zeros((most, 256), dtype=np.int64)
        self.group = np.zeros((-(-most // 4), 256), dtype=np.uint32)
        nodes = _Numbers()
        for k in range(most):
            for byte, b in enumerate(bits):
                if k < len(b):
                    self.value[k, byte] = b[k] == "1"
                    self.node[k, byte] = nodes[b[:k]]
                    self.inner[k, byte] = int("1" + b[k // 4 * 4 : k], 2)
                    self.group[k // 4, byte] = nodes[b[: k // 4 * 4]]

    @classmethod
    def plain(cls) -> Code:
        return cls([f"{byte:08b}" for byte in range(256)])

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Code:
        """Shortest bits on average, by joining the two rarest sets of bytes each time."""
        rare = [(int(c) + 1, byte, [byte]) for byte, c in enumerate(counts)]
        bits = [""] * 256
        heapq.heapify(rare)
        while len(rare) > 1:
            (a, first, left), (b, _, right) = heapq.heappop(rare), heapq.heappop(rare)
            for sign, some in (("0", left), ("1", right)):
                for byte in some:
                    bits[byte] = sign + bits[byte]
            heapq.heappush(rare, (a + b, first, left + right))
        return cls(bits)


class Lexicon:
    """The bytes of distinct words, laid end to end, with what stands before each in its word."""

    # Places looked back at most.
    LEAD = 6

    def __init__(self, words: list[bytes] | bytes, contexts: bool = True):
        """Of listed words, or of words joined by line ends, which need not become objects."""
        if isinstance(words, bytes):
            words += b"\n"
        else:
            words = b"".join(w + b"\n" for w in words)
        self.bytes = np.frombuffer(bytearray(words), dtype=np.uint8)
        last = np.flatnonzero(self.bytes == 10)
        self.size = np.diff(last, prepend=-1)
        self.start = last + 1 - self.size
        # A blank stands behind every word, a line end alone is the end of a text.
        self.bytes[last[self.size > 1]] = 32
        if not contexts:
            return
        self.prefix = np.empty(len(self.bytes), dtype=np.uint32)
        self.before = np.empty(len(self.bytes), dtype=np.uint64)
        with np.errstate(over="ignore"):
            power = np.full(int(self.size.max(initial=1)), 0x9E3779B97F4A7C15, dtype=np.uint64)
            power = np.cumprod(power)
            for at, size in self.blocks():
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                held = self.bytes[at].astype(np.uint64)
                term = (held + np.uint64(1)) * power[place]
                before = np.cumsum(term) - term
                before -= np.repeat(before[np.cumsum(size) - size], size)
                self.prefix[at] = mix64(before) >> np.uint64(32)
                before = np.zeros(len(held), dtype=np.uint64)
                for back in range(1, self.LEAD + 1):
                    near = np.flatnonzero(place >= back)
                    before[near] |= held[near - back] << np.uint64(8 * back - 8)
                self.before[at] = before
        last = self.start + self.size - 1
        # Hash and last bytes of whole words, as seen from the word behind.
        self.hash = self.prefix[last]
        self.tail = self.before[last] << np.uint64(8) | self.bytes[last]

    def blocks(self, many: int = 20_000):
        for first in range(0, len(self.size), many):
            size = self.size[first : first + many]
            yield slice(self.start[first], self.start[first] + size.sum()), size


class Spelled:
    """The bytes of many words, laid end to end, with their contexts.

    Bytes with more bits come first, so those with a bit k are the first `many[k]`. Slots
    lie in groups of 16, so that four bits of a byte in a context are found side by side.
    """

    def __init__(self, words: list[bytes], mixing: Mixing):
        """Each word as a text of its own, of which no word before is known."""
        ids = np.arange(len(words))
        self._lay(Lexicon(words), ids, np.full(len(words), -1), mixing, Code.plain())
        self.hashes.pop()

    @classmethod
    def in_text(cls, lexicon: Lexicon, ids: np.ndarray, last: np.ndarray, mixing: Mixing, code: Code):
        """Words by number, each behind the word `last`, or opening a text if that is -1."""
        self = cls.__new__(cls)
        self._lay(lexicon, ids, last, mixing, code)
        return self

    def _lay(self, lexicon, ids, last, mixing, code):
        self.mixing, self.code, self.words = mixing, code, len(ids)
        size = lexicon.size[ids]
        start = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(start, size)
        at = np.repeat(lexicon.start[ids], size) + place
        self.word = np.repeat(np.arange(self.words), size)
        self.bytes = lexicon.bytes.take(at).astype(np.int64)
        before, prefix = lexicon.before.take(at), lexicon.prefix.take(at)
        size_of = code.size.take(self.bytes)
        self.many = len(self.bytes) - np.cumsum(np.bincount(size_of, minlength=len(code.value) + 1))
        # Behind what is spelled of the word come the last bytes of the word before.
        near = np.flatnonzero(place < lexicon.LEAD)
        tail = np.where(last < 0, np.uint64(0), lexicon.tail[last])
        before[near] |= tail.take(self.word[near]) << (8 * place[near]).astype(np.uint64)
        self.hashes = []
        with np.errstate(over="ignore"):
            for order in mixing.orders:
                key = (before & np.uint64((1 << 8 * order) - 1)) + (np.uint64(order) << np.uint64(56))
                key *= np.uint64(0x9E3779B97F4A7C15)
                self.hashes.append(((key ^ key >> np.uint64(29)) >> np.uint64(24)).astype(np.uint32))
            whole = np.where(last < 0, np.uint32(1), lexicon.hash[last])
            whole = (whole * np.uint32(0x85EBCA6B)) ^ np.uint32(0x5BD1E995)
            self.hashes.append(prefix ^ whole.take(self.word))
        if code.size.min() < code.size.max():
            order = np.argsort((255 - size_of).astype(np.uint8), kind="stable")
            self.bytes, self.word = self.bytes.take(order), self.word.take(order)
            self.hashes = [h.take(order) for h in self.hashes]

    def bits(self, valued: bool = False):
        """Value of each bit, its node, and its slot for each context, of the bytes that have it.

        Slots are worked out one context at a time. They are of the bit alone, or of the bit
        and its value: twice the slot plus the value.
        """
        groups = []
        for k, many in enumerate(self.many[:-1]):
            if not many:
                break
            if k % 4 == 0:
                groups = self._groups(k, many, 4 + valued)
            yield self._bit(k, many, groups, valued)

    def bit(self, k: int) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
        return self._bit(k, self.many[k], self._groups(k, self.many[k]))

    def _groups(self, k: int, many: int, wide: int = 4) -> list[np.ndarray]:
        """First slot of the group that bit k of the first bytes has in each context."""
        shift = np.uint32(36 - self.mixing.slot_bits)
        with np.errstate(over="ignore"):
            key = self.code.group[k // 4].take(self.bytes[:many]) * np.uint32(0x9E3779B1)
            return [
                (((h[:many] ^ key) * np.uint32(0x85EBCA6B)) >> shift).astype(np.int64) << wide
                for h in self.hashes
            ]

    def _bit(self, k, many, groups, valued=False) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
        held = self.bytes[:many]
        value, inner = self.code.value[k].take(held), self.code.inner[k].take(held)
        if valued:
            inner = 2 * inner + value
        return value, self.code.node[k].take(held), (g[:many] + inner for g in groups)


class Model:
    """Counts by context, bit and slot; gated weights; refinement table.

    A gate is made of how often the contexts of three orders were seen, in four
    levels each. Single precision is enough for predictions and halves the time; the
    level of a slot is kept in the last two bits of its stretched prediction.
    """

    def __init__(self, counts: np.ndarray | None, mixing: Mixing, code: Code | None = None):
        self.mixing, self.code = mixing, code
        self.counts = counts  # contexts x 2 x slots, or none where tables made of them are given
        self.inputs = (mixing.contexts if counts is None else len(counts)) + 1
        self.weights = np.full((mixing.gates, self.inputs), 0.35)
        self.weights[:, -1] = 0.0
        self.refine = np.zeros((256, 33, 2))
        orders = len(mixing.orders)
        self.gated = (orders - 1, orders - 2, min(1, orders - 1))
        self._fixed = None

    def _stretched(self, no: np.ndarray, yes: np.ndarray) -> np.ndarray:
        prior = np.float32(self.mixing.prior)
        total = no + yes
        level = (total > 0.5).view(np.uint8) + (total > 4.5) + (total > 50.5)
        out = np.log((yes + prior) / (no + prior)).astype(np.float32)
        held = out.view(np.uint32)
        held &= np.uint32(0xFFFFFFFC)
        held |= level.astype(np.uint32)
        return out

    def training_tables(self) -> np.ndarray:
        """Stretched predictions by context, slot and value of the bit.

        One occurrence of the bit itself is taken out of the counts, so training
        sees what a text not counted would see.
        """
        contexts, _, slots = self.counts.shape
        out = np.empty((contexts, slots, 2), dtype=np.float32)
        for i, (no, yes) in enumerate(self.counts):
            out[i, :, 0] = self._stretched(np.maximum(no - np.float32(1.0), np.float32(0.0)), yes)
            out[i, :, 1] = self._stretched(no, np.maximum(yes - np.float32(1.0), np.float32(0.0)))
        return out.reshape(contexts, -1)

    def gate(self, stretched: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(stretched[0]), dtype=np.uint32)
        for i in self.gated:
            out = out * np.uint32(4) + (stretched[i].view(np.uint32) & np.uint32(3))
        return out.astype(np.int64)

    @staticmethod
    def cell(logit: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(logit, -8.0, 8.0) * 2.0).astype(np.int32) + 16

    def _tables(self):
        """What scoring looks up, worked out once."""
        if self._fixed is None:
            stretch = [self._stretched(no, yes) for no, yes in self.counts]
            total = self.refine.sum(axis=2) + self.mixing.refine_prior
            shift = (0.5 * self.refine[:, :, 1] / total).astype(np.float32).reshape(-1)
            scale = (0.5 + 0.5 * self.mixing.refine_prior / total).astype(np.float32).reshape(-1)
            weights = np.ascontiguousarray(self.weights.T.astype(np.float32))
            self._fixed = stretch, shift, scale, weights
        return self._fixed

    def for_scoring(self) -> Model:
        """The same model without its counts, which only training needs."""
        self._tables()
        self.counts = None
        return self

    def bit_probability(self, node: np.ndarray, slots: Iterable[np.ndarray]) -> np.ndarray:
        """Probability of bit 1: mixed, then refined halfway."""
        stretch, shift, scale, weights = self._tables()
        seen = [stretch[i].take(slot) for i, slot in enumerate(slots)]
        gate = self.gate(seen)
        logit = np.float32(0.3) * weights[-1].take(gate)
        for i, x in enumerate(seen):
            x *= weights[i].take(gate)
            logit += x
        cell = node * 33 + self.cell(logit)
        p = np.float32(1.0) / (np.float32(1.0) + np.exp(-np.clip(logit, -16.0, 16.0)))
        p = shift.take(cell) + scale.take(cell) * p
        return np.clip(p, np.float32(1e-6), np.float32(1.0 - 1e-6))

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word's spelling, as a text of its own."""
        return self.spelling(Spelled(words, self.mixing)) / _LN10

    def spelling(self, spelled: Spelled) -> np.ndarray:
        """Natural log probability of each word, spelled where it stands."""
        total = np.zeros(len(spelled.bytes))
        one = np.float32(1.0)
        p = np.ones(len(spelled.bytes), dtype=np.float32)
        for k, (value, node, slots) in enumerate(spelled.bits()):
            yes = self.bit_probability(node, slots)
            p[: len(yes)] *= np.where(value == 1, yes, one - yes)
            if k % 4 == 3:
                total[: len(yes)] += np.log(p[: len(yes)])
                p[: len(yes)] = one
        total += np.log(p)
        return np.bincount(spelled.word, weights=total, minlength=spelled.words)

    def in_texts(self, words: list[bytes] | bytes, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log probability of every word of texts laid end to end."""
        pairs = Pairs(words, ids, sizes, places=True)
        out = np.empty(len(pairs.ids))
        for some, spelled in pairs.parts(1 << 15, self.mixing, self.code):
            out[some] = self.spelling(spelled)
        return out[pairs.of]


class _Learner:
    """Online second-order updates of the gated weights."""

    def __init__(self, model: Model, tables: np.ndarray | None = None):
        """Of a model with counts, or with the training tables of its counts."""
        self.model = model
        self.tables = model.training_tables() if tables is None else tables
        self.curve = np.zeros((model.mixing.gates, model.inputs, model.inputs))
        self.ridge = np.eye(model.inputs)

    def learn(self, words: list[bytes], times: np.ndarray, refine: bool) -> None:
        """From words that each are a text of their own, so many times."""
        spelled = Spelled(words, self.model.mixing)
        self.learn_spelled(spelled, times[spelled.word].astype(np.float32), refine)

    def learn_spelled(self, spelled: Spelled, much: np.ndarray, refine: bool) -> None:
        model = self.model
        gates, one = model.mixing.gates, np.float32(1.0)
        for value, node, slots in spelled.bits(valued=True):
            seen = [table.take(slot) for table, slot in zip(self.tables, slots, strict=True)]
            gate = model.gate(seen)
            order = np.argsort(gate.astype(np.uint8), kind="stable")
            edges = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=gates))])
            x = np.empty((model.inputs, len(value)), dtype=np.float32)
            for i, column in enumerate(seen):
                column.take(order, out=x[i], mode="clip")
            x[-1] = 0.3
            truth = value.take(order)
            logit = np.empty(len(truth), dtype=np.float32)
            current = model.weights.astype(np.float32)
            filled = np.flatnonzero(np.diff(edges))
            for g in filled:
                at = slice(edges[g], edges[g + 1])
                logit[at] = current[g] @ x[:, at]
            p = one / (one + np.exp(-np.clip(logit, -16.0, 16.0)))
            weight = much[: len(value)].take(order)
            if refine:
                cell = (node.take(order) * 33 + model.cell(logit)) * 2 + truth
                model.refine += np.bincount(cell, weights=weight, minlength=256 * 33 * 2).reshape(256, 33, 2)
            slope, bend = weight * (truth - p), weight * p * (one - p)
            pull = np.zeros((gates, model.inputs))
            for g in filled:
                at = slice(edges[g], edges[g + 1])
                self.curve[g] += (x[:, at] * bend[at]) @ x[:, at].T
                pull[g] = x[:, at] @ slope[at]
            step = np.linalg.solve(self.curve[filled] + self.ridge, pull[filled][:, :, None])
            model.weights[filled] += np.clip(step[:, :, 0], -0.25, 0.25)
        model._fixed = None


class Pairs:
    """The distinct pairs of a word and the word before in texts laid end to end.

    A pair fixes the contexts of its word's bytes, so each is spelled once. Pairs are
    sorted by word, so that slots looked up one after another are often the same.
    """

    def __init__(
        self, words: list[bytes] | bytes, ids: np.ndarray, sizes: np.ndarray, places: bool = False
    ):
        self.lexicon = Lexicon(words)
        many = len(self.lexicon.size)
        last = np.zeros(len(ids), dtype=np.int64)
        last[1:] = ids[:-1]
        last[1:] += 1
        last[np.cumsum(sizes) - sizes] = 0
        last += ids * (many + 1)
        # Numbers of words and places fit 32 bits; half of the memory.
        order = np.argsort(last) if places else None
        if order is None:
            last.sort()
        else:
            last = last[order]
        first = np.ones(len(last), dtype=bool)
        first[1:] = last[1:] != last[:-1]
        key = last[first]
        if places:
            self.of = np.empty(len(last), dtype=np.int32)
            self.of[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
        else:
            self.times = np.diff(np.flatnonzero(first), append=len(last)).astype(np.int32)
        self.ids = (key // (many + 1)).astype(np.int32)
        self.last = (key % (many + 1)).astype(np.int32) - np.int32(1)

    def parts(self, most: int, mixing: Mixing, code: Code, spread: bool = False):
        """Which pairs, and their words as `Spelled`, in parts of about so many bytes.

        Spread parts take every so many-th pair, so each is like the whole.
        """
        ends = np.cumsum(self.lexicon.size[self.ids])
        many = -(-int(ends[-1]) // most)
        edges = np.searchsorted(ends, np.arange(1, many) * most).tolist()
        for first, (start, end) in enumerate(zip([0, *edges], [*edges, len(ends)], strict=True)):
            some = slice(first, None, many) if spread else slice(start, end)
            ids, last = self.ids[some], self.last[some]
            if len(ids):
                yield some, Spelled.in_text(self.lexicon, ids, last, mixing, code)


# --- whole words -------------------------------------------------------------

_LN10 = math.log(10.0)
_KNOWN = np.dtype([("kind", "u1"), ("c", "<u8")])
# What the discounts need to know of a column of counts.
_STATISTICS = {
    "n": lambda c: F.sum(c),
    "v": lambda c: F.sum((F.col(c) > 0).cast("long")),
    "one": lambda c: F.sum((F.col(c) == 1).cast("long")),
    "two": lambda c: F.sum((F.col(c) == 2).cast("long")),
}


@dataclass(frozen=True)
class _Discount:
    """Absolute discounting of a column of word counts.

    The discount follows from the words seen once and twice; what it takes from
    all words goes to the coarser model.
    """

    total: int
    words: int
    once: int
    twice: int

    def mixed(self, c: np.ndarray, coarser: np.ndarray) -> np.ndarray:
        """Natural log probability from counts and the coarser log probability."""
        if not self.total:
            return coarser
        off = self.once / (self.once + 2.0 * self.twice) if self.once else 0.5
        off = min(max(off, 0.1), 0.9)
        left = off * self.words / self.total
        out = coarser + math.log(left)
        own = np.maximum(c - off, 0.0) / self.total
        # Where nothing is its own, the sum of the parts may be too small for a double.
        with np.errstate(divide="ignore"):
            np.log(own + np.exp(out), out=out, where=own > 0.0)
        return out


# --- the corpus --------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, byte by byte of each, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _words_packed(words) -> bytes:
    """Words, which hold no white space, in one value."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def _joined_words(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _words_of(data: bytes) -> list[bytes]:
    return _joined_words(data).split(b"\n")


def _rows_packed(doc_id: list, held_out: list, n_bytes: list) -> bytes:
    """Columns of documents in one value: a stream of rows whose lists are mostly null
    takes time quadratic in its batches on the way to Python.
    """
    rows = pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(n_bytes, pa.int64())],
        names=["doc_id", "held_out", "n_bytes"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _rows_of(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _code(word: bytes, width: int) -> int:
    return xxhash.xxh3_64_intdigest(word) % width


def _profiles_of(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Profiles of documents: square roots of the shares of hashed words.

    In 255 steps of the largest; as only directions count, its length is free.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    held = np.bincount(row * width + codes[ids], minlength=len(sizes) * width).reshape(-1, width)
    return np.rint(255.0 * np.sqrt(held / held.max(axis=1, keepdims=True))).astype(np.uint8)


def _rows(data: bytes, width: int, block: int = 2_048):
    """Profiles of a chunk's training documents, some at a time."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    rows = flat.reshape(-1, width)
    for first in range(0, len(rows), block):
        yield rows[first : first + block].astype(np.float32)


def _points(data: bytes, width: int):
    """The same at length 1."""
    for rows in _rows(data, width):
        points = rows.astype(float)
        yield points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre by angle; the length of a row is free."""
    return (rows @ centres.T.astype(np.float32)).argmax(axis=1)


def document_kinds(chunks: DataFrame, mixing: Mixing) -> np.ndarray:
    """Centres of the profiles of all training documents, by k-means.

    Every pass goes over all of them, as written once. The first centres are drawn a
    few at a time, with more weight on documents far from those drawn before: each
    chunk offers the winners of a race. A round adds up one sum per task and centre.
    Centres only say which kind a document counts for, so rounds end at `most_rounds`.
    """
    rows, width = chunks.select("chunk", "profiles"), mixing.profile
    centres = np.zeros((0, width))

    def draw(centres: np.ndarray, many: int) -> list[np.ndarray]:
        def race(batches):
            for batch in batches:
                for chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rng = np.random.default_rng([11, len(centres), chunk])
                    best: list[tuple[float, bytes]] = []
                    for points in _points(data, width):
                        far = np.ones(len(points))
                        if len(centres):
                            far = np.clip(1.0 - (points @ centres.T).max(axis=1), 0.0, None) ** 2
                        far[far < 1e-12] = 0.0
                        with np.errstate(divide="ignore"):
                            key = rng.exponential(size=len(points)) / far
                        first = np.argsort(key, kind="stable")[:many]
                        best += [(float(key[i]), points[i].tobytes()) for i in first if key[i] < math.inf]
                        best = sorted(best)[:many]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k for k, _ in best], pa.float64()),
                            pa.array([x for _, x in best], pa.binary()),
                        ],
                        names=["key", "profile"],
                    )

        offered = rows.mapInArrow(race, "key double, profile binary")
        return [np.frombuffer(r["profile"]) for r in offered.orderBy("key", "profile").limit(many).collect()]

    def moved(centres: np.ndarray) -> np.ndarray:
        def gather(batches):
            total = np.zeros((len(centres), width))
            for batch in batches:
                for data in batch.column(1).to_pylist():
                    for held in _rows(data, width):
                        own = _nearest(held, centres) == np.arange(len(centres))[:, None]
                        size = np.sqrt(np.einsum("ij,ij->i", held, held))
                        total += (own / size).astype(np.float32) @ held
            some = np.flatnonzero(total.any(axis=1))
            yield _sums(some, total[some])

        def add(batches):
            total = np.zeros((len(centres), width))
            for batch in batches:
                for kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    total[kind] += np.frombuffer(data)
            some = np.flatnonzero(total.any(axis=1))
            yield _sums(some, total[some])

        schema = "kind int, total binary"
        new = centres.copy()
        parts = rows.mapInArrow(gather, schema).repartition(len(centres), "kind")
        for row in parts.mapInArrow(add, schema).collect():
            total = np.frombuffer(row["total"])
            new[row["kind"]] = total / np.sqrt(total @ total)
        return new

    while len(centres) < mixing.kinds:
        before = len(centres)
        for point in draw(centres, min(mixing.drawn_at_once, mixing.kinds - before)):
            # Winners of one race may be copies of one another.
            if not len(centres) or 1.0 - (centres @ point).max() >= 1e-6:
                centres = np.vstack([centres, point])
        if len(centres) == before:
            break
    if not len(centres):
        return np.zeros((1, width))
    for _ in range(mixing.most_rounds):
        old, centres = centres, moved(centres)
        if np.abs(centres - old).max() < 1e-3:
            break
    return centres


def _sums(kinds: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array([x.tobytes() for x in totals], pa.binary())],
        names=["kind", "total"],
    )


def _earlier(key: np.ndarray) -> np.ndarray:
    """The last place before each one that holds the same key, or -1.

    Keys are hashes, of which the upper bits stay beside the place: plain sorting
    is many times faster than sorting places by key.
    """
    low = np.uint64(len(key).bit_length())
    both = np.sort((key >> low << low) | np.arange(len(key), dtype=np.uint64))
    place = (both & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    same = np.flatnonzero(both[1:] >> low == both[:-1] >> low)
    out = np.full(len(key), -1, dtype=np.int64)
    out[place[same + 1]] = place[same]
    return out


def follow(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the words before each word tell of it, from the same text so far.

    The last place where the same two words stood, else the same word, names the
    word that came next there. Per word: 0 if there is no such place, else 1 plus
    twice the context (see `FOLLOWED`), plus 1 if the word named is the word.
    """
    flags = np.zeros(len(ids), dtype=np.uint8)
    for docs, some in document_blocks(sizes):
        flags[some] = _followed(ids[some], sizes[docs])
    return flags


def document_blocks(sizes: np.ndarray, most: int = 1 << 16):
    """Slices of documents with about so many words, a longer one alone, and of their words."""
    ends = np.cumsum(sizes)
    first = done = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield slice(first, last), slice(done, int(ends[last - 1]))
        first, done = last, int(ends[last - 1])


def _followed(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    flags = np.zeros(len(ids), dtype=np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
    if not len(one):
        return flags
    key = np.zeros(len(ids), dtype=np.uint64)
    key[one] = row[one].astype(np.uint64) << np.uint64(32) | ids[one - 1].astype(np.uint64)
    named = np.full(len(ids), -1, dtype=np.int64)
    for context, at in enumerate((one, two)):
        if context:
            with np.errstate(over="ignore"):
                seen = mix64(key[at] * np.uint64(0x9E3779B97F4A7C15) + ids[at - 2].astype(np.uint64))
        else:
            seen = mix64(key[at])
        before = _earlier(seen)
        found = before >= 0
        where = at[found]
        named[where] = ids[at[before[found]]]
        flags[where] = 1 + 2 * context
    right = named == ids
    flags += right
    # A word of the context of two words whose own word before came as told.
    runs_on = np.zeros(len(ids), dtype=bool)
    runs_on[one] = right[one - 1] & (flags[one] >= 3)
    flags[runs_on] += 2
    return flags


def _letters(words: list[bytes], many: np.ndarray) -> np.ndarray:
    """How often each byte is spelled in words that occur so often."""
    lexicon = Lexicon(words, contexts=False)
    out = np.zeros(256)
    done = 0
    for at, size in lexicon.blocks():
        times = np.repeat(many[done : done + len(size)], size)
        out += np.bincount(lexicon.bytes[at], weights=times, minlength=256)
        done += len(size)
    return out.astype(np.int64)


def word_chunks(docs: DataFrame, mixing: Mixing, modulus: int = 7, held: int = 2) -> DataFrame:
    """Documents in chunks: distinct words, and each document's words in their order.

    `profiles` are those of the training documents, `told` what `follow` gives, and
    `trust` how often each of its contexts told something, and rightly, in training
    documents; `letters` counts their bytes. A chunk closes at `CHUNK_BYTES`, so its vocabulary is bounded by that
    and one document.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long"), (remainder_of(F.col("doc_id"), modulus) == held).alias("held"),
        "text",
    )
    width = mixing.profile
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def gather(batches):
        import pyspark

        number = pyspark.TaskContext.get().partitionId() << 33
        words, ids = _Numbers(), array("I")
        docs_of, flags, spelled, sizes = [], [], [], []
        held_bytes = 0

        def rows(batch, many=256):
            # Some at a time, so a batch is not held twice.
            for first in range(0, batch.num_rows, many):
                part = batch.slice(first, many)
                yield from zip(
                    part.column(0).to_pylist(), part.column(1).to_pylist(), raw_texts(part), strict=True
                )

        def close():
            tokens, many = np.frombuffer(ids, dtype=np.uint32).astype(np.int64), np.array(sizes)
            codes = np.fromiter((_code(w, width) for w in words), dtype=np.int64, count=len(words))
            learnt = ~np.array(flags)
            squeeze = zstandard.ZstdCompressor(level=1).compressobj(size=int(learnt.sum()) * width)
            profiles = []
            ends = np.cumsum(many)
            for first in range(0, len(many), 2_048):
                some, use = many[first : first + 2_048], learnt[first : first + 2_048]
                if use.any():
                    part = tokens[ends[first] - many[first] : ends[first + len(some) - 1]]
                    held_in = _profiles_of(part[np.repeat(use, some)], some[use], codes, width)
                    profiles.append(squeeze.compress(held_in.tobytes()))
            profiles.append(squeeze.flush())
            told = follow(tokens, many)
            use = np.repeat(learnt, many)
            trust = np.bincount(told[use], minlength=1 + 2 * FOLLOWED)
            seen = np.bincount(tokens[use], minlength=len(words))
            letters = _letters(list(words), seen)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([_words_packed(words)], pa.binary()),
                    pa.array([b"".join(profiles)], pa.binary()),
                    pa.array([_rows_packed(docs_of, flags, spelled)], pa.binary()),
                    pa.array([_packed(many)], pa.binary()), pa.array([_packed(tokens)], pa.binary()),
                    pa.array([zstandard.ZstdCompressor(level=1).compress(told.tobytes())], pa.binary()),
                    pa.array([trust], pa.list_(pa.int64())), pa.array([letters], pa.list_(pa.int64())),
                ],
                names=names,
            )

        for batch in batches:
            for doc, flag, text in rows(batch):
                found = words_of(text)
                found.append(END)
                ids.extend(map(words.__getitem__, found))
                docs_of.append(doc)
                flags.append(flag)
                spelled.append(sum(map(len, found)) + len(found))
                sizes.append(len(found))
                held_bytes += len(text or b"") + 64 + width
                if held_bytes >= CHUNK_BYTES:
                    yield close()
                    number += 1
                    words, ids = _Numbers(), array("I")
                    docs_of, flags, spelled, sizes = [], [], [], []
                    held_bytes = 0
        if docs_of:
            yield close()

    return keyed.mapInArrow(gather, CHUNKS)


def vocabulary(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """(word, c, c_0, c_1, ...): training counts of every word that occurs.

    `c` sums the counts of all kinds; the end is the empty word. A document counts
    for the kind whose centre is nearest. Chunks give one row per word, with zeros
    where only other documents hold it.
    """
    kinds, width = centres.shape
    columns = [f"c_{k}" for k in range(kinds)]

    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                packed, profiles, rows, sizes, ids = (batch.column(k)[i].as_py() for k in range(5))
                words = pa.array(_words_of(packed), pa.binary())
                learnt = ~_rows_of(rows).column(1).to_numpy(zero_copy_only=False)
                kind_of = np.zeros(len(learnt), dtype=np.int64)
                if learnt.any():
                    kind_of[learnt] = np.concatenate(
                        [_nearest(x, centres) for x in _rows(profiles, width)]
                    )
                sizes, ids = _unpacked(sizes), _unpacked(ids)
                use = np.repeat(learnt, sizes)
                at = ids[use] * kinds + np.repeat(kind_of, sizes)[use]
                total = np.bincount(at, minlength=len(words) * kinds).reshape(-1, kinds)
                for start in range(0, len(words), 20_000):
                    part = total[start : start + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [words.slice(start, len(part)), *(pa.array(part[:, k]) for k in range(kinds))],
                        names=["word", *columns],
                    )

    seen = chunks.select("words", "profiles", "rows", "sizes", "ids").mapInArrow(
        count, ", ".join(["word binary", *(f"{c} long" for c in columns)])
    )
    whole = seen.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])
    every = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return whole.select("word", every.alias("c"), *columns)


def _training_texts(batches):
    """Columns of every chunk with training texts, see `_training_pairs`."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = [batch.column(k)[i].as_py() for k in range(4)]
            if not _rows_of(row[1]).column(1).to_numpy(zero_copy_only=False).all():
                yield row


def _training_pairs(words: bytes, rows: bytes, sizes: bytes, ids: bytes) -> Pairs:
    learnt = ~_rows_of(rows).column(1).to_numpy(zero_copy_only=False)
    many = _unpacked(sizes)
    return Pairs(_joined_words(words), _unpacked(ids)[np.repeat(learnt, many)], many[learnt])


def count_tables(texts: DataFrame, mixing: Mixing, code: Code) -> np.ndarray:
    """Bit counts by context and slot, summed over all training texts.

    Tasks give their tables in blocks, which are summed by block; what reaches
    the driver is one table, whose size `slot_bits` fixes.
    """
    slots, block = 1 << mixing.slot_bits, 1 << mixing.block_bits
    contexts = mixing.contexts

    def blocks(tables):
        for i in range(contexts):
            for start in range(0, 2 * slots, 2 * block):
                piece = tables[i, start : start + 2 * block]
                if piece.any():
                    yield _block_row(i, start, _packed(piece))

    def count(batches):
        # By slot and value of the bit; given away before a count could overflow.
        tables, seen = np.zeros((contexts, 2 * slots), dtype=np.int32), 0
        for texts in _training_texts(batches):
            pairs = _training_pairs(*texts)
            for some, spelled in pairs.parts(1 << 15, mixing, code):
                times = pairs.times[some].take(spelled.word)
                most = int(times.sum(dtype=np.int64)) * len(code.value)
                if seen + most >= 2**31:
                    yield from blocks(tables)
                    tables[:], seen = 0, 0
                seen += most
                for _, _, slot in spelled.bits(valued=True):
                    for i, at in enumerate(slot):
                        np.add.at(tables[i], at, times[: len(at)])
        yield from blocks(tables)

    def add(batches):
        at, total = None, None
        for batch in batches:
            for i, start, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece = _unpacked(data)
                if (i, start) != at:
                    if at is not None:
                        yield _block_row(*at, total.astype("<f4").tobytes())
                    at, total = (i, start), np.zeros(len(piece), dtype=np.int64)
                total += piece
        if at is not None:
            yield _block_row(*at, total.astype("<f4").tobytes())

    schema = "part int, start int, data binary"
    partial = texts.mapInArrow(count, schema)
    summed = (
        partial.repartition("part", "start")
        .sortWithinPartitions("part", "start")
        .mapInArrow(add, schema)
    )
    out = np.zeros((contexts, 2 * slots), dtype=np.float32)
    for row in summed.toLocalIterator():
        piece = np.frombuffer(row["data"], dtype="<f4")
        out[row["part"], row["start"] : row["start"] + len(piece)] = piece
    return np.ascontiguousarray(out.reshape(contexts, slots, 2).transpose(0, 2, 1))


def _block_row(part: int, start: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([start], pa.int32()), pa.array([data], pa.binary())],
        names=["part", "start", "data"],
    )


def _summed(chunks: DataFrame, column: str, size: int) -> np.ndarray:
    """Sums of a column of counts, place by place, over all chunks."""
    each = chunks.select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(size)
    for row in each.collect():
        out[row["at"]] = row["n"]
    return out


def train(chunks: DataFrame, mixing: Mixing) -> Model:
    """Counts, then weights and refinement learnt online in every task.

    Each task runs through its texts in their order once or, where they are few,
    several times. The weights of the tasks are averaged by the curvature they have
    seen; refinement counts are summed.
    """
    spark = chunks.sparkSession
    letters = _summed(chunks, "letters", 256)
    code = Code.of_counts(letters)
    # Few tasks, as each holds and gives whole tables.
    tasks = max(1, -(-int(letters.sum()) // mixing.bytes_per_task))
    texts = chunks.select("words", "rows", "sizes", "ids").coalesce(tasks)
    counts = count_tables(texts, mixing, code)
    # Tasks hold the tables made of the counts, not the counts beside them.
    shared = spark.sparkContext.broadcast(Model(counts, mixing, code).training_tables())
    gates, inputs = mixing.gates, mixing.contexts + 1

    def learn_all(learner, texts, refine):
        pairs, steps = _training_pairs(*texts), 0
        for some, spelled in pairs.parts(mixing.batch_bytes, mixing, code, spread=True):
            times = pairs.times[some].astype(np.float32).take(spelled.word)
            learner.learn_spelled(spelled, times, refine)
            steps += 1
        return steps

    def learn(batches):
        model = Model(None, mixing, code)
        learner, steps, kept = None, 0, []
        for texts in _training_texts(batches):
            learner = learner or _Learner(model, shared.value)
            steps += learn_all(learner, texts, True)
            kept = [*kept, texts] if steps < mixing.least_steps else []
        if not steps:
            return
        while kept and steps < mixing.least_steps:
            for texts in kept:
                steps += learn_all(learner, texts, False)
        pull = np.einsum("gij,gj->gi", learner.curve, model.weights)
        flat = np.concatenate([learner.curve.reshape(-1), pull.reshape(-1), model.refine.reshape(-1)])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(flat[some])], names=["at", "value"]
        )

    learnt = texts.mapInArrow(learn, "at int, value double")
    size = gates * inputs * (inputs + 1)
    flat = np.zeros(size + 256 * 33 * 2)
    for row in learnt.groupBy("at").agg(F.sum("value").alias("value")).toLocalIterator():
        flat[row["at"]] = row["value"]
    shared.destroy()
    model = Model(counts, mixing, code)
    curve = flat[: gates * inputs * inputs].reshape(gates, inputs, inputs)
    pull = flat[gates * inputs * inputs : size].reshape(gates, inputs)
    ridge = np.eye(inputs)
    for g in range(gates):
        model.weights[g] = np.linalg.solve(curve[g] + ridge, pull[g] + ridge @ model.weights[g])
    model.refine = flat[size:].reshape(256, 33, 2)
    return model


def score_documents(
    docs: DataFrame, mixing: Mixing = Mixing(), modulus: int = 7, held: int = 2
) -> DataFrame:
    """Base and model scores of every whole text (`SCORES`).

    `docs` needs `doc_id` and `text`; other columns are ignored. Learns from rows
    whose crc32(doc_id) modulo `modulus` is not `held`; a null `doc_id` counts as
    the text '' there and stays null. A null or empty text is the end alone.
    Repeated rows each count and each get a row; an empty table gives none.
    `bits_per_byte` is the model's total over the bytes it spells.

    Words meet their counts once per chunk of documents, not once per document, and
    come back to the chunk in packed pieces of bounded size, its documents behind them.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lm-score")
    chunks = work.stage(word_chunks(docs, mixing, modulus, held), "chunks", "zstd")
    centres = document_kinds(chunks, mixing)
    kinds = len(centres)
    vocab = work.stage(vocabulary(chunks, centres), "vocabulary", "zstd")
    columns = ["c", *[f"c_{k}" for k in range(kinds)]]
    seen = vocab.agg(
        *[
            F.coalesce(f(c), F.lit(0)).alias(f"{name}_{c}")
            for c in columns
            for name, f in _STATISTICS.items()
        ]
    ).first()
    total, distinct = seen["n_c"], seen["v_c"]
    shares = [_Discount(*(seen[f"{name}_{c}"] for name in _STATISTICS)) for c in columns]
    model = train(chunks, mixing)
    shared = spark.sparkContext.broadcast(model.for_scoring())

    def entries(batches):
        for batch in batches:
            counts = np.stack([batch.column(i).to_numpy() for i in range(1, 1 + kinds)], axis=1)
            at, kind = np.nonzero(counts)
            known = np.empty(len(at), dtype=_KNOWN)
            known["kind"], known["c"] = kind, counts[at, kind]
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(counts)))])
            packed = pa.Array.from_buffers(
                pa.binary(), len(counts),
                [
                    None, pa.py_buffer((ends * _KNOWN.itemsize).astype(np.int32).tobytes()),
                    pa.py_buffer(known.tobytes()),
                ],
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["word", "known"])

    def words(batches):
        for batch in batches:
            for chunk, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                listed = pa.array(_words_of(packed), pa.binary())
                for start in range(0, len(listed), 20_000):
                    part = listed.slice(start, 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(part), chunk)),
                            pa.array(np.arange(start, start + len(part), dtype=np.int32)), part,
                        ],
                        names=["chunk", "at", "word"],
                    )

    counted = vocab.filter("c > 0").select("word", *columns[1:]).mapInArrow(
        entries, "word binary, known binary"
    )
    trust = _summed(chunks, "trust", 1 + 2 * FOLLOWED)
    wrong, right = trust[1::2], trust[2::2]
    rates = (right + 0.5) / (right + wrong + 1.0)
    documents = ["words", "rows", "sizes", "ids", "told"]
    used = chunks.select("chunk", "words").mapInArrow(words, "chunk long, at int, word binary")
    pieces = used.join(counted, "word").select("chunk", "at", "known").mapInArrow(
        _pieces, "chunk long, known binary"
    )
    last = chunks.select("chunk", F.lit(True).alias("last"), *documents)
    stream = (
        pieces.withColumn("last", F.lit(False))
        .unionByName(last, allowMissingColumns=True)
        .repartition(max(1, chunks.count()), "chunk")
        .sortWithinPartitions("chunk", "last")
        .select("last", "known", *documents)
    )
    names = [x.split()[0] for x in SCORES.split(", ")]
    unit = math.log10(total + distinct + 1)

    def finish(row, word, found):
        sizes, ids = _unpacked(row["sizes"]), _unpacked(row["ids"])
        doc_id, held_out, n_bytes = _rows_of(row["rows"]).columns
        flags = zstandard.ZstdDecompressor().decompress(row["told"])
        words = _joined_words(row["words"])
        spelled = shared.value.in_texts(words, ids, sizes)
        many = words.count(b"\n") + 1
        flags = np.frombuffer(flags, dtype=np.uint8)
        c = np.bincount(word, weights=found["c"], minlength=many)
        base_of, known_of = np.log10(c + 1.0) - unit, (c > 0).astype(np.int64)
        by_kind = _dense(word, found, many, len(shares) - 1)
        base, score = np.empty(len(sizes)), np.empty(len(sizes))
        known = np.empty(len(sizes), dtype=np.int64)
        for docs, some in document_blocks(sizes):
            own, starts = ids[some], np.cumsum(sizes[docs]) - sizes[docs]
            base[docs] = np.add.reduceat(base_of[own], starts)
            known[docs] = np.add.reduceat(known_of[own], starts)
            sums = _in_order(np.arange(len(own)), sizes[docs], flags[some], rates, mixing.trust_prior)
            score[docs] = _all_kinds(sums, spelled[some], own, c, by_kind, shares)
        score /= _LN10
        return pa.RecordBatch.from_arrays(
            [
                doc_id, held_out, pa.array(sizes), pa.array(known),
                pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(score),
                pa.array(-score / math.log10(2.0) / n_bytes.to_numpy()),
            ],
            names=names,
        )

    def add_up(batches):
        # A chunk's pieces come first, then its documents.
        at, found = [np.empty(0, np.int32)], [np.empty(0, _KNOWN)]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if not row["last"]:
                    for kept, part in zip((at, found), _piece_of(row["known"]), strict=True):
                        kept.append(part)
                    continue
                yield finish(row, np.concatenate(at), np.concatenate(found))
                at, found = at[:1], found[:1]

    return stream.mapInArrow(add_up, SCORES)


def _in_order(ids: np.ndarray, sizes: np.ndarray, flags: np.ndarray, rates: np.ndarray, prior: float):
    """Sums, per document, of log probabilities of words that also heed what was told.

    The word named has the probability that its context tells rightly: the rate of
    the training documents, drawn towards that of the text so far. The rest goes to
    all words as they are priced. Returns a function of the words' log probabilities.
    """
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    trust = np.zeros(len(ids))
    for context in range(FOLLOWED):
        tried, right = (flags + 1) // 2 == context + 1, flags == 2 * context + 2
        before = [np.cumsum(x) - x for x in (tried, right)]
        tries, rights = (x - np.repeat(x[starts], sizes) for x in before)
        own = (rights + prior * rates[context]) / (tries + prior)
        trust[tried] = own[tried]
    left = np.add.reduceat(np.log1p(-trust), starts)
    came = np.flatnonzero((flags > 0) & (flags % 2 == 0))
    gain = np.log(trust[came]) - np.log1p(-trust[came])

    def sums(values: np.ndarray) -> np.ndarray:
        more = np.logaddexp(0.0, gain - values[ids[came]])
        return (
            np.add.reduceat(values[ids], starts)
            + left
            + np.bincount(row[came], weights=more, minlength=len(sizes))
        )

    return sums


def _pieces(batches, most: int = 400_000):
    """Counts of words dealt back to chunks: packed pieces of at most so many words."""
    held, many = [], 0

    def flush():
        chunk, at, known = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        chunk, at = chunk.to_numpy(), at.to_numpy()
        order = np.lexsort((at, chunk))
        many, found = _known(known.take(pa.array(order)))
        at, edges = at[order], np.concatenate([[0], np.cumsum(many)])
        for start, end in runs(chunk[order]):
            some = found[edges[start] : edges[end]]
            columns = [
                at[start:end].astype("<u4").view("u1").reshape(-1, 4).T, many[start:end].astype("u1"),
                some["kind"], some["c"].astype("<u8").view("u1").reshape(-1, 8).T,
            ]
            data = np.array([end - start, len(some)], dtype="<u4").tobytes()
            data += b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk[order[start]]], pa.int64()),
                    pa.array([zstandard.ZstdCompressor(level=1).compress(data)], pa.binary()),
                ],
                names=["chunk", "known"],
            )

    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= most:
            yield from flush()
            held, many = [], 0
    if many:
        yield from flush()


def _piece_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word and entry of every count by kind in a piece."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="u1")
    words, size = (int(x) for x in flat[:8].view("<u4"))
    at, many, kind, c = np.split(flat[8:], np.cumsum([4 * words, words, size]))
    found = np.empty(size, dtype=_KNOWN)
    found["kind"] = kind
    found["c"] = np.ascontiguousarray(c.reshape(8, -1).T).view("<u8").reshape(-1)
    at = np.ascontiguousarray(at.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int32)
    return np.repeat(at, many), found


def _known(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many counts by kind each word has, and their entries."""
    ends = np.frombuffer(packed.buffers()[1], dtype=np.int32)
    ends = ends[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return np.diff(ends) // _KNOWN.itemsize, held[ends[0] : ends[-1]].view(_KNOWN)


def _dense(word: np.ndarray, entries: np.ndarray, words: int, kinds: int) -> list[np.ndarray]:
    """Counts of all words, by kind."""
    out = [np.zeros(words) for _ in range(kinds)]
    for kind, c in enumerate(out):
        own = entries["kind"] == kind
        c[word[own]] = entries["c"][own]
    return out


def _all_kinds(
    sums, spelled: np.ndarray, ids: np.ndarray, total: np.ndarray, by_kind: list[np.ndarray],
    shares: list[_Discount],
) -> np.ndarray:
    """Log probability of each document by spelling alone and under all kinds together.

    `spelled` is that of every word where it stands. Spelling has half of the prior,
    the general model of whole words a quarter; the kinds share the rest as the
    training words. The sum over all of prior times probability is what reweighing
    them after every word would give.
    """
    everything = max(1.0, sum(s.total for s in shares[1:]))
    general = shares[0].mixed(total[ids], spelled)
    out = np.logaddexp(sums(spelled) + math.log(0.5), sums(general) + math.log(0.25))
    for c, share in zip(by_kind, shares[1:], strict=True):
        if not share.total:
            continue
        prior = math.log(0.25 * share.total / everything)
        out = np.logaddexp(out, sums(share.mixed(c[ids], general)) + prior)
    return out
