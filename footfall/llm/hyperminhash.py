"""Near-duplicate documents by HyperMinHash registers.

A document's shingles fall into buckets by their hash; each bucket keeps only
the number of leading zeros of its smallest hash and a few mantissa bits.
Bands of registers propose pairs, the share of equal registers, corrected for
chance collisions, drops the hopeless ones, and full shingle sets decide.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Workspace, mix64, raw_texts, runs, whole_groups, words_of
from footfall.llm.components import connected

_COLUMNS_AT_ONCE = 4096
_SLOTS = 1 << 20
SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, registers binary"


@dataclass(frozen=True)
class Settings:
    """Shingle width, link threshold in percent, and the sketch.

    128 registers in 25 bands of 5: a pair at similarity 0.85 shares no band with
    probability (1 - 0.85**5)**25, about 4e-7.
    """

    width: int = 3
    percent: int = 85
    registers: int = 128
    mantissa_bits: int = 10
    bands: int = 25
    rows: int = 5
    margin: float = 5.0

    def __post_init__(self):
        if self.registers & (self.registers - 1) or self.registers > 256:
            raise ValueError("registers must be a power of two, at most 256")
        if self.bands * self.rows > self.registers:
            raise ValueError("bands * rows must not exceed registers")


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A text with fewer words than `width` has one shingle, all of them; a text
    without words has none.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(width, len(words))
    with np.errstate(over="ignore"):
        hashes = np.full(len(words) - span + 1, np.uint64(span))
        for k in range(span):
            hashes = mix64(hashes + codes[k : k + len(hashes)] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(hashes)


@lru_cache
def _borrow_order(registers: int) -> np.ndarray:
    """For each bucket, the buckets it borrows from while empty, in order."""
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(registers) for _ in range(registers)])


def registers_of(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """uint16 registers of a non-empty shingle set.

    An empty bucket borrows the register of a full one, by an order fixed for the
    bucket, so sparse documents still compare register by register.
    """
    k = settings.registers
    low_bits = 64 - (k.bit_length() - 1)
    bucket = (hashes >> np.uint64(low_bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    # The top 49 bits below the bucket number; exact as a double.
    value = (hashes[first] & np.uint64((1 << low_bits) - 1)) >> np.uint64(low_bits - 49)
    part, exponent = np.frexp(value.astype(np.float64))
    zeros = 49 - exponent
    steps = 1 << settings.mantissa_bits
    mantissa = np.where(value > 0, np.floor((2.0 * part - 1.0) * steps), 0).astype(np.int64)
    found = (np.minimum(zeros, 62) * steps + mantissa).astype(np.uint16)
    out = np.zeros(k, dtype=np.uint16)
    full = np.zeros(k, dtype=bool)
    full[bucket[first]] = True
    out[bucket[first]] = found
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _borrow_order(k)[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def band_keys(registers: np.ndarray, settings: Settings) -> np.ndarray:
    """(documents, bands) keys; equal where all registers of the band agree."""
    keys = np.empty((len(registers), settings.bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(settings.bands):
            key = np.full(len(registers), np.uint64(band + 1))
            for column in range(band * settings.rows, (band + 1) * settings.rows):
                step = registers[:, column].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
                key = mix64(key * np.uint64(31) + step)
            keys[:, band] = key
    return keys.view(np.int64)


@lru_cache
def _chance_table(registers: int, mantissa_bits: int) -> np.ndarray:
    """Chance that a register of two disjoint sets agrees, by log2 of both sizes.

    Sums the product of both minima's probabilities over every leading-zero count
    and 64 steps of the mantissa, each standing for 2**mantissa_bits / 64 cells.
    """
    steps = 64
    zeros = np.arange(1, 50)[:, None]
    cells = np.arange(steps)[None, :]
    low = np.ldexp(1.0 + cells / steps, -zeros) / registers
    high = np.ldexp(1.0 + (cells + 1) / steps, -zeros) / registers
    sizes = np.exp2(np.arange(33))[:, None, None]
    mass = np.exp(sizes * np.log1p(-low)) - np.exp(sizes * np.log1p(-high))
    flat = mass.reshape(len(sizes), -1)
    return flat @ flat.T * (steps / (1 << mantissa_bits))


def estimated_similarity(
    equal: np.ndarray, left: np.ndarray, right: np.ndarray, settings: Settings
) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less chance matches."""
    table = _chance_table(settings.registers, settings.mantissa_bits)
    a = np.clip(np.rint(np.log2(np.maximum(left, 1))), 0, 32).astype(int)
    b = np.clip(np.rint(np.log2(np.maximum(right, 1))), 0, 32).astype(int)
    chance = table[a, b]
    return np.clip((equal / settings.registers - chance) / (1.0 - chance), 0.0, 1.0)


def worth_checking(
    equal: np.ndarray, left: np.ndarray, right: np.ndarray, settings: Settings
) -> np.ndarray:
    """Pairs whose sizes allow a link and whose estimate is not far too low.

    The bound lies `margin` standard errors below the threshold; a small set has
    only as many independent registers as shingles.
    """
    small, large = np.minimum(left, right), np.maximum(left, right)
    goal = settings.percent / 100.0
    error = np.sqrt(goal * (1.0 - goal) / np.minimum(small, settings.registers))
    likely = estimated_similarity(equal, left, right, settings) >= goal - settings.margin * error
    return likely & (100 * small >= settings.percent * large)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """Set size, 128-bit set fingerprint and registers of every document."""

    def sign(batches):
        for batch in batches:
            size, first, second, kept = [], [], [], []
            for text in raw_texts(batch):
                hashes = shingle_set(text, settings.width)
                size.append(len(hashes))
                digest = xxhash.xxh3_128_digest(hashes.tobytes())
                first.append(int.from_bytes(digest[:8], "little", signed=True))
                second.append(int.from_bytes(digest[8:], "little", signed=True))
                kept.append(registers_of(hashes, settings).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(size, pa.int64()), pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()), pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "registers"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, SIGNED)


def _register_matrix(column: pa.ChunkedArray | pa.Array, settings: Settings) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=np.uint16).reshape(-1, settings.registers)


def _banded(classes: DataFrame, settings: Settings) -> DataFrame:
    def band(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = band_keys(_register_matrix(batch.column(1), settings), settings)
            rep = np.repeat(batch.column(0).to_numpy(), settings.bands)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), pa.array(rep)], names=["key", "rep"]
            )

    return classes.select("rep", "registers").mapInArrow(band, "key long, rep long")


def _promising(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (hub, rep) that pass the corrected estimate, with it."""
    side = classes.select("rep", "n_shingles", "registers")
    hubs = side.select(
        F.col("rep").alias("hub"), F.col("n_shingles").alias("hub_n"),
        F.col("registers").alias("hub_registers"),
    )
    joined = pairs.join(side, "rep").join(hubs, "hub").select(
        "hub", "rep", "hub_n", "n_shingles", "hub_registers", "registers"
    )

    def judge(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            equal = (
                _register_matrix(batch.column(4), settings)
                == _register_matrix(batch.column(5), settings)
            ).sum(axis=1)
            left, right = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = worth_checking(equal, left, right, settings)
            score = estimated_similarity(equal, left, right, settings)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)),
                    pa.array(score[keep]),
                ],
                names=["hub", "rep", "estimate"],
            )

    return joined.mapInArrow(judge, "hub long, rep long, estimate double")


def _confirmed(
    pairs: DataFrame, texts: DataFrame, settings: Settings, followers: int = 500
) -> DataFrame:
    """Pairs (hub, rep) whose full shingle sets are similar enough.

    Each pair moves the text of `rep` once; the hub's text moves once per
    `followers` pairs, so a hub with very many pairs is dealt over many groups. A
    task reads the groups one after another and holds one hub's set.
    """
    parts = pairs.groupBy("hub").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(followers)).cast("long").alias("parts")
    )
    dealt = pairs.join(parts, "hub").select(
        "hub", "rep", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part")
    )
    hubs = dealt.select("hub", "part").distinct()
    rows = hubs.join(texts, hubs["hub"] == texts["rep"]).select(
        "hub", "part", F.lit(None).cast("long").alias("rep"), "text"
    )
    rows = rows.unionByName(dealt.join(texts, "rep").select("hub", "part", "rep", "text"))
    # Nulls sort first: a group begins with its hub.
    grouped = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "rep")

    def compare(batches):
        at, held = None, []
        for batch in batches:
            hub, part, rep = (batch.column(i).to_pylist() for i in range(3))
            left, right = [], []
            for h, p, r, text in zip(hub, part, rep, raw_texts(batch), strict=True):
                if (h, p) != at:
                    at, held = (h, p), []
                hashes = shingle_set(text, settings.width)
                if r is None:
                    held.append(hashes)
                elif any(linked(x, hashes, settings.percent) for x in held):
                    left.append(h)
                    right.append(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"]
            )

    return grouped.mapInArrow(compare, "u long, v long")


def _only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among the wanted `rep`s.

    A first sieve drops most others before anything is shuffled: it holds the slots,
    of a fixed number, that wanted keys fall into, so it never has more rows than
    that. Where nearly all slots are taken it sieves little and the join alone decides.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(_SLOTS))
    taken = wanted.select(slot("rep").alias("slot")).distinct()
    sieved = rows.join(F.broadcast(taken), slot(key) == F.col("slot"), "left_semi")
    return sieved.join(wanted.withColumnRenamed("rep", key), key, "left_semi")


SETS = "group long, rep long, component long, n_shingles long, registers binary, shingles array<long>"


def _shingle_sets(rows: DataFrame, settings: Settings) -> DataFrame:
    """(group, rep, component, text) with registers and the whole shingle set."""

    def cut(batches):
        for batch in batches:
            sets = [shingle_set(text, settings.width) for text in raw_texts(batch)]
            # One id may have several texts, some of them empty.
            full = np.array([len(x) > 0 for x in sets], dtype=bool)
            sets = [x for x in sets if len(x)]
            kept = [batch.column(i).filter(pa.array(full)) for i in range(3)]
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *kept, pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([registers_of(x, settings).tobytes() for x in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["group", "rep", "component", "n_shingles", "registers", "shingles"],
            )

    return rows.select("group", "rep", "component", "text").mapInArrow(cut, SETS)


def _with_partners(sets: DataFrame, settings: Settings, block: int) -> DataFrame:
    """Sets that could link with another one of their group.

    A link needs `percent` of a set's shingles in common with its partner, so a set
    whose own shingles, found nowhere else in the group, are too many links with
    none. Such sets, which abound where many texts were changed a lot, leave
    before any pair is formed. Groups that fit one block are not worth the count.
    """
    large = (
        sets.groupBy("group").agg(F.sum("n_shingles").alias("all")).filter(F.col("all") > block).select("group")
    )
    own = (
        sets.join(large, "group", "left_semi")
        .select("group", "rep", F.explode("shingles").alias("shingle"))
        .groupBy("group", "shingle")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("rep").alias("rep"))
        .filter("rows = 1")
        .groupBy("group", "rep")
        .agg(F.count(F.lit(1)).alias("own"))
    )
    counted = sets.join(own, ["group", "rep"], "left")
    common = F.col("n_shingles") - F.coalesce("own", F.lit(0))
    return counted.filter(100 * common >= settings.percent * F.col("n_shingles")).drop("own")


def _common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets on the left with sets on the right.

    Only shingles on both sides count; they are taken some thousand at a time, each
    a column of two indicator matrices whose product adds to the counts.
    """
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    ends = np.append(starts[1:], len(flat))
    # Within a shingle owners ascend, so the first is on the left and the last on the right.
    both = (owner[starts] < len(left)) & (owner[ends - 1] >= len(left))
    column = np.repeat(np.cumsum(both) - 1, ends - starts)
    held = np.repeat(both, ends - starts)
    column, owner = column[held], owner[held]
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, int(both.sum()), _COLUMNS_AT_ONCE):
        low, high = np.searchsorted(column, [first, first + _COLUMNS_AT_ONCE])
        dense = np.zeros((len(left) + len(right), _COLUMNS_AT_ONCE), dtype=np.float32)
        dense[owner[low:high], column[low:high] - first] = 1.0
        counts += dense[: len(left)] @ dense[len(left) :].T
    return counts


def _joining(components: np.ndarray, others: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (i, j) as few as join all components that they join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    i, j = np.nonzero(link)
    _, first = np.unique(np.stack([components[i], others[j]]), axis=1, return_index=True)
    kept = []
    for at in first.tolist():
        a, b = root(int(components[i[at]])), root(int(others[j[at]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((int(i[at]), int(j[at])))
    return kept


def _across(sets: DataFrame, settings: Settings, block: int) -> DataFrame:
    """Links that join different components of a group, found on full sets.

    The largest component of a group need not be compared with itself, so its
    sets meet only those of the others. Sets of the others go to every block of
    the group and all sets have one home block; a block holds sets of about `block`
    shingles together, and a task one block of each side. In a pair of blocks the
    corrected estimates drop sets without a promising partner, the others are
    compared in full, and as few links leave as join what is linked.
    """
    sizes = sets.groupBy("group", "component").agg(F.sum("n_shingles").alias("held"))
    mixed = (
        sizes.groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("components"),
            F.sum("held").alias("all"),
            F.max(F.struct("held", "component")).alias("main"),
        )
        .filter("components > 1")
        .select(
            "group",
            F.col("main.component").alias("main"),
            F.ceil(F.col("all") / block).cast("int").alias("homes"),
            F.ceil((F.col("all") - F.col("main.held")) / block).cast("int").alias("visits"),
        )
    )
    rows = sets.join(mixed, "group")
    carried = ("rep", "component", "n_shingles", "registers", "shingles")
    home = rows.select(
        "group", F.explode(F.sequence(F.lit(0), F.col("visits") - 1)).alias("visit"),
        F.pmod(F.xxhash64("rep"), F.col("homes")).cast("int").alias("home"), F.lit(0).alias("side"), *carried,
    )
    visit = rows.filter("component <> main").select(
        "group", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("visits")).cast("int").alias("visit"),
        F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("home"), F.lit(1).alias("side"), *carried,
    )
    grouped = (
        home.unionByName(visit)
        .repartition("group", "visit", "home")
        .sortWithinPartitions("group", "visit", "home", "side")
    )

    def meet(table: pa.Table, start: int, cut: int, end: int) -> list[tuple[int, int]]:
        rep, comp, size = (table.column(i).to_numpy()[start:end] for i in (4, 5, 6))
        registers = _register_matrix(table.column(7).slice(start, end - start), settings)
        at = cut - start
        promising = np.empty((at, end - cut), dtype=bool)
        for j in range(end - cut):
            equal = (registers[:at] == registers[at + j]).sum(axis=1)
            promising[:, j] = worth_checking(equal, size[:at], np.full(at, size[at + j]), settings)
        promising &= comp[:at, None] != comp[None, at:]
        i, j = np.flatnonzero(promising.any(axis=1)), np.flatnonzero(promising.any(axis=0))
        if not len(i):
            return []
        column = table.column(8).slice(start, end - start).combine_chunks()
        edges = column.offsets.to_numpy()
        values = column.values.to_numpy()
        sets_of = lambda places: [values[edges[k] : edges[k + 1]] for k in places]
        common = _common_counts(sets_of(i), sets_of(at + j))
        union = size[i][:, None] + size[at + j][None, :] - common
        link = (100 * common >= settings.percent * union) & (comp[i][:, None] != comp[at + j][None, :])
        return [
            (int(rep[i[x]]), int(rep[at + j[y]])) for x, y in _joining(comp[i], comp[at + j], link)
        ]

    def search(batches):
        for table in whole_groups(batches, 3):
            group, visit_no, home_no, side = (table.column(i).to_numpy() for i in range(4))
            found: list[tuple[int, int]] = []
            for start, end in runs(group, visit_no, home_no):
                cut = start + int(np.searchsorted(side[start:end], 1))
                if start < cut < end:
                    found += meet(table, start, cut, end)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["u", "v"]
                )

    return grouped.mapInArrow(search, "u long, v long")


def near_duplicates(
    docs: DataFrame, settings: Settings = Settings(), block: int = 100_000
) -> DataFrame:
    """Shingle-set size, component and whether the document stays.

    `docs` needs `doc_id` and `text`; other columns are ignored. Returns
    `doc_id, n_shingles, component_id, kept`, a row per input row.

    1. Documents with the same set are one class, grouped before anything else.
    2. Each band bucket compares its members with its smallest id (linear in the
       bucket), each class with its most similar hub only; links are confirmed
       on full sets and joined to components.
    3. Buckets that share members form a group. Where a group still holds several
       components, sets that share too little with the rest of it leave, and the
       others are compared across components in blocks of about `block` shingles.
       Links inside a component could change nothing, so none is lost, and what
       leaves a task is a few links, however many texts are alike.

    Null and empty texts have no shingles and link with nothing. Rows that share a
    `doc_id` are one node, linked wherever any of their texts is. A null `doc_id`
    has no identity: it links with nothing, has a null component and is kept. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near-duplicates")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = work.stage(signatures(slim, settings), "signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = work.stage(
        usable.groupBy("h1", "h2", "n_shingles", "registers").agg(F.min("doc_id").alias("rep")),
        "classes",
    )
    bands = _banded(classes, settings)
    hubs = (
        bands.groupBy("key")
        .agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members"))
        .filter("members > 1")
        .select("key", "hub")
    )
    near = work.stage(
        bands.join(hubs, "key").filter("hub <> rep").select("hub", "rep").distinct(), "near"
    )
    wanted = work.stage(near.select("rep").union(near.select("hub")).distinct(), "wanted")
    texts = work.stage(_only(slim, "doc_id", wanted).withColumnRenamed("doc_id", "rep"), "texts")
    sides = work.stage(_only(classes, "rep", wanted), "sides")
    nearest = (
        _promising(near, sides, settings).groupBy("rep")
        .agg(F.max(F.struct("estimate", -F.col("hub"))).alias("best"))
        .select((-F.col("best.col2")).alias("hub"), "rep")
    )
    links = work.stage(_confirmed(nearest, texts, settings), "links")
    found = connected(links)
    in_part = wanted.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("component")
    )
    in_part = work.stage(in_part, "in_part")
    # Components that share a bucket, whose members may yet link.
    touching = (
        near.join(in_part.withColumnRenamed("component", "v"), "rep")
        .join(in_part.select(F.col("rep").alias("hub"), F.col("component").alias("u")), "hub")
        .filter("u <> v")
        .select("u", "v")
    )
    groups = connected(touching).select(F.col("node").alias("component"), F.col("component").alias("group"))
    # Several rows of one id may hold the same text.
    open_ = in_part.join(groups, "component").join(texts, "rep")
    sets = work.stage(_shingle_sets(open_, settings), "sets")
    sets = sets.withColumn("code", F.xxhash64("shingles")).dropDuplicates(["group", "rep", "code"]).drop("code")
    more = work.stage(_across(_with_partners(sets, settings, block), settings, block), "more")
    work.drop("near", "wanted", "texts", "sides", "in_part", "sets")
    # A document belongs with its class; one id with several texts joins their classes.
    with_rep = signed.filter("doc_id IS NOT NULL").join(
        classes.select("h1", "h2", "rep"), ["h1", "h2"], "left"
    )
    own = with_rep.filter("rep <> doc_id").select(
        F.col("doc_id").alias("u"), F.col("rep").alias("v")
    )
    labels = work.stage(
        connected(links.unionByName(more).unionByName(own)), "components"
    )
    work.drop("classes")
    return signed.select("doc_id", "n_shingles").join(
        labels.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
