"""Merkle manifest of a dataset with octopus multiproofs.

Leaves are cut into aligned blocks of consecutive ones. A block holds every node
below its top, so all its leaves together lack only the siblings on the way from
its top to the root: it works out those coordinates from counts alone, fetches
them once, derives the shared interior nodes and expands a proof for each leaf.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import Workspace, runs, whole_groups
from footfall.operators.ordering import in_slices, with_position

ARITY = 3
#: A block holds ARITY ** BLOCK_LEVELS leaves at most.
BLOCK_LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = -1


def digest(parts: Iterable[bytes]) -> bytes:
    """SHA-256 of hex digests written one after the other, as hex."""
    return sha256(b"".join(parts)).hexdigest().encode()


def parents(nodes: Sequence[bytes]) -> list[bytes]:
    """Digests of each run of ARITY nodes; the last run may be shorter."""
    return [digest(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def missing_nodes(known: Iterable[int], level: int, leaves: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes lacking to derive the root from the known ones.

    `known` are the nodes held at `level` of a tree with so many leaves. What can be
    derived from held or fetched nodes below is not listed, so the list is minimal.
    """
    size = -(-leaves // ARITY**level)
    held, wanted = set(known), []
    while size > 1:
        above = sorted({i // ARITY for i in held})
        for run in above:
            members = range(ARITY * run, min(ARITY * run + ARITY, size))
            wanted += [(level, i) for i in members if i not in held]
        held, size, level = set(above), -(-size // ARITY), level + 1
    return wanted


def climb(node: bytes, index: int, level: int, leaves: int, fetched: dict) -> tuple[list, bytes]:
    """The steps (place, siblings) from a node to the root, and the root."""
    size, steps = -(-leaves // ARITY**level), []
    while size > 1:
        first = index - index % ARITY
        others = [fetched[level, i] for i in range(first, min(first + ARITY, size)) if i != index]
        steps.append((index - first, others))
        node = digest([*others[: index - first], node, *others[index - first :]])
        index, size, level = index // ARITY, -(-size // ARITY), level + 1
    return steps, node


def fold(node: bytes, steps: Iterable[tuple[int, Sequence[bytes]]]) -> bytes:
    """The root that a leaf and the siblings of its proof lead to."""
    for place, others in steps:
        node = digest([*others[:place], node, *others[place:]])
    return node


def _field(value: Column) -> Column:
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def _leaf(text: Column) -> Column:
    fields = [_field(F.col(f)) for f in FIELDS if f != "text"]
    return F.unhex(F.sha2(F.concat(*fields, _field(text)).cast("binary"), 256))


def leaf_digests(docs: DataFrame, modulus: int = 2) -> DataFrame:
    """`source, doc_id, leaf, altered`: digests of the rows, as bytes.

    `altered` is that of the row without the line feeds of its text, for documents
    whose crc32 of the id is divisible by `modulus`, else null.
    """
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == 0
    return docs.select(
        "source",
        F.col("doc_id").cast("long").alias("doc_id"),
        _leaf(F.col("text")).alias("leaf"),
        F.when(chosen, _leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("altered"),
    )


def in_trees(work: Workspace, leaves: DataFrame) -> tuple[DataFrame, int]:
    """Leaves as `tree, i, n, doc_id, leaf, altered`, and the number of trees.

    A tree is a source: trees are numbered in the order of sources, null first,
    and i counts the n leaves of a tree in the order of doc_id. Ranges of (source,
    doc_id) are sorted apart, so a hot source spans many tasks.
    """
    salted = work.stage(leaves.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    # Rows alike in all but the salt have equal digests: their order is of no matter.
    sliced = in_slices(salted, ["source", "doc_id", "leaf", "salt"])
    held = work.stage(
        sliced.groupBy("source", "_slice").agg(
            F.count(F.lit(1)).alias("rows"), F.min("_place").alias("start")
        ),
        "held",
    )
    trees = work.stage(
        with_position(held.groupBy("source").agg(F.sum("rows").alias("n")), ["source"], "tree"),
        "trees",
    )
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        F.col("source").alias("o_source"),
        F.col("_slice").alias("o_slice"),
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("start")).alias("offset"),
    )
    named = trees.select(F.col("source").alias("t_source"), "tree", "n")
    offsets = offsets.join(named, F.col("t_source").eqNullSafe(F.col("o_source"))).drop("t_source")
    placed = sliced.join(
        offsets, (F.col("o_slice") == F.col("_slice")) & F.col("o_source").eqNullSafe(F.col("source"))
    ).select("tree", (F.col("_place") + F.col("offset")).alias("i"), "n", "doc_id", "leaf", "altered")
    return work.stage(placed, "placed"), trees.count()


def _hexes(column: pa.ChunkedArray) -> list[bytes | None]:
    return [None if v is None else v.hex().encode() for v in column.to_pylist()]


def _blocks(rows: DataFrame) -> DataFrame:
    block = F.floor(F.col("i") / F.lit(ARITY**BLOCK_LEVELS)).cast("long")
    return rows.withColumn("block", block)


def _reduced(rows: DataFrame, every_level: bool) -> DataFrame:
    """`tree, n, level, node, digest` of the blocks' nodes: their tops, or all levels."""

    def reduce(batches: Iterator[pa.RecordBatch]):
        for table in whole_groups(batches, 2):
            tree, block, n = (table.column(i).to_numpy() for i in (0, 1, 3))
            hashes = _hexes(table.column(4))
            out: list[tuple] = []
            for a, b in runs(tree, block):
                nodes, top = hashes[a:b], min(BLOCK_LEVELS, height(int(n[a])))
                first = int(block[a]) * ARITY**BLOCK_LEVELS
                for level in range(top + 1):
                    if every_level or level == top:
                        start = first // ARITY**level
                        out += [(tree[a], n[a], level, start + k, bytes.fromhex(h.decode())) for k, h in enumerate(nodes)]
                    if level < top:
                        nodes = parents(nodes)
            columns = zip(*out, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["tree", "n", "level", "node", "digest"],
            )

    dealt = (
        _blocks(rows).select("tree", "block", "i", "n", "digest")
        .repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    )
    return dealt.mapInArrow(reduce, "tree long, n long, level int, node long, digest binary")


def _height_of(n: Column, most: int) -> Column:
    """`height` as a column, up to `most`."""
    total = F.lit(0)
    for level in range(most):
        total = total + (n > F.lit(ARITY**level)).cast("int")
    return total


def build(work: Workspace, rows: DataFrame, name: str, from_leaves: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes that blocks may ask for, and the roots: (tree, level, node, digest), (tree, root).

    `rows` are `tree, i, n, digest`. Tops of blocks are the leaves of the next turn,
    so a tree of N leaves takes log(N) / log(729) turns. Levels inside the first
    blocks are listed only `from_leaves`.
    """
    base, every, nodes, roots = 0, from_leaves, [], []
    while True:
        turn = work.stage(_reduced(rows, every), f"{name}-{base}")
        whole = _height_of(F.col("n"), BLOCK_LEVELS + 1)
        is_top = F.col("level") == F.least(whole, F.lit(BLOCK_LEVELS))
        nodes.append(
            turn.filter(~is_top).select("tree", (F.col("level") + base).alias("level"), "node", "digest")
        )
        roots.append(turn.filter(is_top & (whole <= BLOCK_LEVELS)).select("tree", F.col("digest").alias("root")))
        rows = turn.filter(is_top & (whole > BLOCK_LEVELS)).select(
            "tree",
            F.col("node").alias("i"),
            F.ceil(F.col("n") / F.lit(ARITY**BLOCK_LEVELS)).cast("long").alias("n"),
            "digest",
        )
        base, every = base + BLOCK_LEVELS, True
        if not rows.take(1):
            break
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    return union(nodes), union(roots)


def wanted_nodes(blocks: DataFrame, trees: int) -> DataFrame:
    """(owner_tree, owner_block, tree, level, node) of all that a block must fetch.

    `blocks` are `tree, block, n`; the tree of trees has the number -1.
    """

    def ask(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for tree, block, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = missing_nodes([block], BLOCK_LEVELS, n)
                out += [(tree, block, tree, level, node) for level, node in own]
                out += [(tree, block, _TOP, level, node) for level, node in missing_nodes([tree], 0, trees)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["owner_tree", "owner_block", "tree", "level", "node"],
            )

    schema = "owner_tree long, owner_block long, tree long, level int, node long"
    return blocks.select("tree", "block", "n").mapInArrow(ask, schema)


_OUT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def _expanded(leaves: DataFrame, fetched: DataFrame, trees: int) -> DataFrame:
    """Proofs of all leaves of a block from its leaves and what it fetched."""

    def expand(batches: Iterator[pa.RecordBatch]):
        for table in whole_groups(batches, 2):
            tree, block, kind = (table.column(i).to_numpy() for i in range(3))
            place, n, level = (table.column(i).to_pylist() for i in (3, 4, 5))
            ids, hashes, altered = table.column(6).to_pylist(), _hexes(table.column(7)), _hexes(table.column(8))
            out: list[tuple] = []
            for a, b in runs(tree, block):
                cut = a + int((kind[a:b] < 2).sum())
                own = {(level[k], place[k]): hashes[k] for k in range(a, cut) if kind[k] == 0}
                top = {(level[k], place[k]): hashes[k] for k in range(a, cut) if kind[k] == 1}
                levels, count = [hashes[cut:b]], n[cut]
                for _ in range(min(BLOCK_LEVELS, height(count))):
                    levels.append(parents(levels[-1]))
                above, subroot = climb(levels[-1][0], int(block[a]), len(levels) - 1, count, own)
                last, root = climb(subroot, int(tree[a]), 0, trees, top)
                shared = [*above, *last]
                for k in range(b - cut):
                    steps, at = [], k
                    for nodes in levels[:-1]:
                        first = at - at % ARITY
                        run = nodes[first : first + ARITY]
                        steps.append((at - first, run[: at - first] + run[at - first + 1 :]))
                        at //= ARITY
                    steps += shared
                    proof = digest(h for _, others in steps for h in others)
                    folded = fold(altered[cut + k] or hashes[cut + k], steps)
                    out.append((ids[cut + k], hashes[cut + k], subroot, root, proof, folded, folded == root))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    *[pa.array(c, pa.binary()).cast(pa.string()) for c in columns[1:6]],
                    pa.array(columns[6]),
                ],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    members = _blocks(leaves).select(
        "tree", "block", F.lit(2).alias("kind"), F.col("i").alias("place"), "n",
        F.lit(0).alias("level"), "doc_id", F.col("leaf").alias("digest"), "altered",
    )
    nodes = fetched.select(
        F.col("owner_tree").alias("tree"), F.col("owner_block").alias("block"),
        F.when(F.col("tree") == _TOP, 1).otherwise(0).alias("kind"), F.col("node").alias("place"),
        F.lit(0).cast("long").alias("n"), "level", F.lit(None).cast("long").alias("doc_id"),
        "digest", F.lit(None).cast("binary").alias("altered"),
    )
    dealt = (
        members.unionByName(nodes)
        .repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "place")
    )
    return dealt.mapInArrow(expand, _OUT)


def proofs(docs: DataFrame, modulus: int = 2) -> DataFrame:
    """Proof digests of all rows and what tampered rows fold to.

    Returns `doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`, one
    row per row of `docs`, which needs doc_id, source, lang, n_chars and text;
    other columns are ignored. A null in any of these is written `-`; a null source
    is a source of its own, first in order; an empty text is `0:`. Null ids come
    first in their source and are never tampered with. Rows that share an id are
    ordered by leaf digest; equal rows are separate leaves. A tampered text without
    a line feed is unchanged and verifies. A lone leaf is its source's subroot, a
    lone subroot the root; a proof without siblings is the digest of nothing. An
    empty table gives no rows.

    Texts are hashed where they are read, in memory of a few times the text, and
    only digests are shuffled.
    """
    work = Workspace(docs.sparkSession, "manifest")
    leaves, trees = in_trees(work, leaf_digests(docs, modulus))
    work.drop("leaves")
    own, subroots = build(work, leaves.withColumnRenamed("leaf", "digest"), "tree", from_leaves=False)
    top, _ = build(
        work,
        subroots.select(
            F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("i"),
            F.lit(trees).cast("long").alias("n"), F.col("root").alias("digest"),
        ),
        "top",
        from_leaves=True,
    )
    blocks = _blocks(leaves).filter(F.col("i") % ARITY**BLOCK_LEVELS == 0)
    fetched = work.stage(
        wanted_nodes(blocks, trees).join(own.unionByName(top), ["tree", "level", "node"]), "fetched"
    )
    return _expanded(leaves, fetched, trees)
