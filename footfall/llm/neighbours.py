"""Near-duplicate vectors by NN-descent with an exact last step.

A neighbour graph starts from random-hyperplane blocks and is refined by letting
every vector's neighbours meet each other. Its strong edges give groups. Vectors whose
list is full of strong neighbours may have more: they search again, among vectors
of other groups only, as long as such lists are full too. Inside a group pairs are
compared in bounded blocks; blocks of a large group whose angles to a pivot differ
too much for a link do not meet. A sample compared with all vectors audits the
recall, by how many links the vectors have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import Workspace, runs, whole_groups
from footfall.llm.components import connected
from footfall.llm.topk import usable


@dataclass(frozen=True)
class Descent:
    """List length, starting tables, and when to stop.

    `slack` is how far below the threshold an edge between vectors rounded to
    bytes may lie and still tie a group; links themselves use double precision.
    Groups above `block` vectors are cut by their angle to a pivot, in cells of the
    `cells`-th part of the angle at the threshold.
    """

    threshold: float = 0.95
    neighbours: int = 8
    tables: int = 8
    start_block: int = 64
    most_rounds: int = 6
    settled: float = 0.001
    slack: float = 0.02
    block: int = 2048
    cells: int = 4
    audited: int = 512
    recall: float = 0.98
    most_enlargements: int = 2


_EDGES = "u long, v long, similarity float"


def _bytes_matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.int8).reshape(len(values), -1).astype(np.float32)


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.float64).reshape(len(values), -1)


def _edge_batch(u: list, v: list, s: list) -> pa.RecordBatch:
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(join(u, "i8")), pa.array(join(v, "i8")), pa.array(join(s, "f4"))],
        names=["u", "v", "similarity"],
    )


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, length, unit, small) of vectors that can be compared.

    `unit` holds doubles of length one, `small` the same rounded to bytes. Null,
    empty and zero vectors and those with null or non-finite components are left
    out. Vectors are scaled by their largest component first, so squares
    neither overflow nor vanish.
    """
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v"),
    )

    def scale(batches):
        for batch in batches:
            ids, length, unit, small = [], [], [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = values.values.to_numpy()
                top = np.abs(x).max()
                if top == 0.0:
                    continue
                x = x / top
                x = x / np.sqrt(x @ x)
                ids.append(vec_id)
                length.append(len(x))
                unit.append(x.tobytes())
                small.append(np.rint(x * 127.0).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(length, pa.int32()),
                    pa.array(unit, pa.binary()), pa.array(small, pa.binary()),
                ],
                names=["vec_id", "length", "unit", "small"],
            )

    return rows.mapInArrow(scale, "vec_id long, length int, unit binary, small binary")


def _top_edges(rows: pa.Table, keep: int) -> pa.RecordBatch:
    """The `keep` best distinct neighbours of each u in a table sorted by u."""
    u, v, s = (rows.column(i).to_numpy() for i in range(3))
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    # The same neighbour may come with slightly different roundings; the first stays.
    pair = np.lexsort((np.arange(len(u)), v, u))
    again = np.zeros(len(u), dtype=bool)
    again[pair[1:]] = (u[pair[1:]] == u[pair[:-1]]) & (v[pair[1:]] == v[pair[:-1]])
    u, v, s = u[~again], v[~again], s[~again]
    start = np.concatenate([[True], u[1:] != u[:-1]])
    place = np.arange(len(u)) - np.maximum.accumulate(np.where(start, np.arange(len(u)), 0))
    best = place < keep
    return _edge_batch([u[best]], [v[best]], [s[best]])


def _combined(parts, keep: int, most: int = 1_000_000):
    """The edges of a task with no more than `keep` of each u among `most` at a time."""
    waiting, size = [], 0
    for part in parts:
        waiting.append(part)
        size += part.num_rows
        if size > most:
            best = _top_edges(pa.Table.from_batches(waiting), keep)
            waiting, size = [best], best.num_rows
            # Lists of too many vectors to wait for what may still come.
            if size > most // 2:
                yield from waiting
                waiting, size = [], 0
    if size:
        yield _top_edges(pa.Table.from_batches(waiting), keep)


def _best_lists(edges: DataFrame, keep: int) -> DataFrame:
    def cut(batches):
        for table in whole_groups(batches, 1):
            yield _top_edges(table, keep)

    return (
        edges.select("u", "v", "similarity")
        .repartition("u")
        .sortWithinPartitions("u")
        .mapInArrow(cut, _EDGES)
    )


def _starting_edges(points: DataFrame, count: int, plan: Descent) -> DataFrame:
    """Best neighbours inside random-hyperplane blocks of several tables.

    A block that many vectors share is dealt into parts of about `start_block`.
    Vectors of the same `own` are no neighbours.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, count / plan.start_block)))))

    def code(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, length = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = batch.column(3).to_numpy()
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                if size not in planes:
                    rng = np.random.default_rng(size)
                    planes[size] = rng.standard_normal((size, plan.tables * max(bits, 1)))
                small = batch.column(2).take(pa.array(at))
                signs = (_bytes_matrix(small) @ planes[size] > 0).reshape(len(at), plan.tables, -1)
                weights = 1 << np.arange(max(bits, 1), dtype=np.int64)
                codes = (signs @ weights if bits else np.zeros((len(at), plan.tables))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(length[at], plan.tables)),
                        pa.array(np.tile(np.arange(plan.tables, dtype=np.int32), len(at))),
                        pa.array(codes.reshape(-1)), pa.array(np.repeat(ids[at], plan.tables)),
                        small.take(pa.array(np.repeat(np.arange(len(at)), plan.tables))),
                        pa.array(np.repeat(own[at], plan.tables)),
                    ],
                    names=["length", "round", "code", "id", "small", "own"],
                )

    coded = points.select("id", "length", "small", "own").mapInArrow(
        code, "length int, round int, code long, id long, small binary, own long"
    )
    sizes = coded.groupBy("length", "round", "code").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(4 * plan.start_block)).alias("parts")
    )
    dealt = (
        coded.join(sizes, ["length", "round", "code"])
        .withColumn("part", F.pmod(F.xxhash64("id", "round"), F.col("parts")))
        .select("length", "round", "code", "part", "id", "small", "own")
        .repartition("length", "round", "code", "part")
        .sortWithinPartitions("length", "round", "code", "part", "id")
    )

    def meet(batches):
        for table in whole_groups(batches, 4):
            keys = [table.column(i).to_numpy() for i in range(4)]
            ids, owns = table.column(4).to_numpy(), table.column(6).to_numpy()
            u, v, s = [], [], []
            for start, end in runs(*keys):
                if end - start < 2:
                    continue
                here, own = ids[start:end], owns[start:end]
                rows = _bytes_matrix(table.column(5).slice(start, end - start))
                like = rows @ rows.T / 16129.0
                like[own[:, None] == own[None, :]] = -2.0
                keep = min(plan.neighbours, end - start - 1)
                best = np.argpartition(-like, keep - 1, axis=1)[:, :keep]
                score = np.take_along_axis(like, best, axis=1).reshape(-1)
                other = score > -1.5
                u.append(np.repeat(here, keep)[other])
                v.append(here[best].reshape(-1)[other])
                s.append(score[other])
            yield _edge_batch(u, v, s)

    return dealt.mapInArrow(meet, _EDGES)


def _proposals(
    graph: DataFrame, points: DataFrame, keep: int, turn: int, paths: DataFrame | None
) -> DataFrame:
    """Better neighbours found where the neighbours of one vector meet.

    Every vector calls its neighbours and a sample of those that name it, as many
    as twice its list; a pair is compared if one of them is new there. Only what
    beats the last place of a list and has another `own` is proposed, and of that no
    more than a list holds leaves a task, however many centres a vector meets in.
    `paths` are further (u, v) whose ends are called, but no edges of the graph.
    """
    order = Window.partitionBy("center").orderBy(F.xxhash64("member", F.lit(turn)), "member")
    callers = (
        graph.select(F.col("v").alias("center"), F.col("u").alias("member"), "fresh")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= 2 * keep)
        .drop("place")
    )
    called = graph.select(F.col("u").alias("center"), F.col("v").alias("member"), "fresh")
    if paths is not None:
        called = called.unionByName(
            paths.select(
                F.col("u").alias("center"), F.col("v").alias("member"), F.lit(False).alias("fresh")
            )
        )
    last = graph.groupBy("u").agg(
        F.when(F.count(F.lit(1)) < keep, F.lit(-2.0)).otherwise(F.min("similarity"))
        .cast("float").alias("low")
    )
    met = (
        called.unionByName(callers)
        .groupBy("center", "member")
        .agg(F.max("fresh").alias("fresh"))
        .join(last.withColumnRenamed("u", "member"), "member", "left")
        .join(points.select(F.col("id").alias("member"), "small", "own"), "member")
        .select(
            "center", "member", F.col("fresh").cast("int").alias("fresh"),
            F.coalesce("low", F.lit(-2.0).cast("float")).alias("low"), "small", "own",
        )
        .repartition("center")
        .sortWithinPartitions("center", "member")
    )

    def compare(batches):
        for table in whole_groups(batches, 1):
            center, member, fresh, low = (table.column(i).to_numpy() for i in range(4))
            rows, owns = _bytes_matrix(table.column(4)), table.column(5).to_numpy()
            u, v, s = [], [], []
            for start, end in runs(center):
                new = fresh[start:end].astype(bool)
                if not new.any():
                    continue
                like = rows[start:end] @ rows[start:end].T / 16129.0
                better = (like > low[start:end][:, None]) & (new[:, None] | new[None, :])
                better &= owns[start:end][:, None] != owns[start:end][None, :]
                a, b = np.nonzero(better)
                u.append(member[start + a])
                v.append(member[start + b])
                s.append(like[a, b])
            yield _edge_batch(u, v, s)

    return met.mapInArrow(lambda batches: _combined(compare(batches), keep), _EDGES)


def neighbour_graph(
    points: DataFrame, count: int, plan: Descent, work: Workspace, label: str,
    paths: DataFrame | None = None,
) -> DataFrame:
    """(u, v, similarity): every vector's list, refined until hardly any changes.

    Lists hold vectors whose `own` differs: with the id any other vector, with a
    group those outside it.
    """
    keep = plan.neighbours
    graph = work.stage(
        _best_lists(_starting_edges(points, count, plan), keep).withColumn("fresh", F.lit(True)),
        f"{label}-0",
    )
    for turn in range(1, plan.most_rounds + 1):
        found = _proposals(graph, points, keep, turn, paths)
        old = graph.select("u", "v", F.lit(False).alias("fresh"))
        lists = _best_lists(graph.drop("fresh").unionByName(found), keep)
        graph = work.stage(
            lists.join(old, ["u", "v"], "left").withColumn(
                "fresh", F.coalesce("fresh", F.lit(True))
            ),
            f"{label}-{turn}",
        )
        work.drop(f"{label}-{turn - 1}")
        if graph.filter("fresh").count() <= plan.settled * keep * count:
            break
    return graph


def _groups(
    points: DataFrame, graph: DataFrame, plan: Descent, work: Workspace, label: str
) -> DataFrame:
    """(node, component): groups between which no strong edge is found.

    A strong edge is in neither list only if both are full of better ones. The
    vectors with such lists are searched again for their best neighbours outside
    their group, along the lists they have; a strong one joins two groups. The same
    holds for the lists so found: only vectors whose list was full of strong ones
    outside can have more, and search again among what is not yet joined. Each turn
    thus asks fewer vectors or ends.
    """
    strong = graph.filter(F.col("similarity") >= plan.threshold - plan.slack).select("u", "v")
    groups = work.stage(connected(strong), f"{label}-0")
    edges, found, asked, paths, turn = strong, strong, points, strong, 0
    while True:
        full = found.groupBy("u").count().filter(F.col("count") >= plan.neighbours)
        full = full.select(F.col("u").alias("id"))
        own = groups.select(F.col("node").alias("id"), F.col("component").alias("own"))
        crowded = work.stage(
            asked.select("id", "length", "small").join(full, "id", "left_semi").join(own, "id"),
            f"{label}-crowded-{turn}",
        )
        count = crowded.count()
        if not count or crowded.select("own").distinct().limit(2).count() < 2:
            return groups
        ends = crowded.select("id")
        paths = work.stage(
            paths.join(ends.withColumnRenamed("id", "u"), "u", "left_semi").join(
                ends.withColumnRenamed("id", "v"), "v", "left_semi"
            ),
            f"{label}-paths-{turn}",
        )
        outside = neighbour_graph(crowded, count, plan, work, f"{label}-outside-{turn}/graph", paths)
        found = work.stage(
            outside.filter(F.col("similarity") >= plan.threshold - plan.slack).select("u", "v"),
            f"{label}-found-{turn}",
        )
        if not found.take(1):
            return groups
        # The components so far stand for the links they came from.
        edges = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
        joined = work.stage(connected(edges.unionByName(found)), f"{label}-{turn + 1}")
        work.drop(f"{label}-{turn}", f"{label}-outside-{turn}", f"{label}-found-{turn - 1}")
        if turn:
            work.drop(f"{label}-crowded-{turn - 1}", f"{label}-paths-{turn - 1}")
        groups, asked, turn = joined, crowded, turn + 1


def _angles(members: DataFrame) -> DataFrame:
    """(node, angle) of rows (node, unit, pivot): between the unit vectors."""

    def measure(batches):
        for batch in batches:
            units, pivots = _by_length(batch.column(1)), _by_length(batch.column(2))
            angle = np.empty(batch.num_rows)
            for at, rows in units:
                other = next(rows for where, rows in pivots if where[0] == at[0])
                angle[at] = np.arccos(np.clip((rows * other).sum(axis=1), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(angle)], names=["node", "angle"])

    return members.select("node", "unit", "pivot").mapInArrow(measure, "node long, angle double")


def _by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the binary vectors of each length."""
    values = column.to_pylist()
    size = np.array([len(x) for x in values])
    out = []
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        rows = np.frombuffer(b"".join(values[i] for i in at), dtype=np.float64)
        out.append((at, rows.reshape(len(at), -1)))
    return out


def _blocks_by_angle(large: DataFrame, points: DataFrame, plan: Descent, work: Workspace) -> DataFrame:
    """Rows of large groups, one for each pair of blocks (low, high) their own is in.

    By the triangle inequality linked vectors' angles to a pivot differ by no more
    than the angle at the threshold, so other blocks need not meet.
    """
    reach = float(np.arccos(plan.threshold)) + 1e-6
    pivots = points.select(F.col("id").alias("component"), F.col("unit").alias("pivot"))
    angles = _angles(large.join(pivots, "component"))
    placed = work.stage(
        large.select("component", "node")
        .join(angles, "node")
        .select(
            "component", "node", F.floor(F.col("angle") * (plan.cells / reach)).cast("int").alias("cell")
        ),
        "cells",
    )
    held = placed.groupBy("component", "cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(plan.block)).cast("int").alias("parts")
    )
    # A block's number holds its cell and part.
    number = lambda cell, part: F.col(cell).cast("long") * F.lit(1 << 31) + part
    # A group has no more cells than fit in half a turn, so its list is short.
    near = held.alias("a").join(held.alias("b"), "component").filter(
        F.abs(F.col("a.cell") - F.col("b.cell")) <= plan.cells
    )
    meetings = near.groupBy("component", F.col("a.cell").alias("cell"), F.col("a.parts").alias("parts")).agg(
        F.flatten(
            F.collect_list(
                F.transform(F.sequence(F.lit(0), F.col("b.parts") - 1), lambda part: number("b.cell", part))
            )
        ).alias("others")
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    return (
        placed.join(meetings, ["component", "cell"])
        .select("component", "node", number("cell", part).alias("own"), F.explode("others").alias("other"))
        .join(points.select(F.col("id").alias("node"), "copies", "unit"), "node")
        .select(
            "component", F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"), "own", "node", "copies", "unit",
        )
    )


def _exact_links(points: DataFrame, groups: DataFrame, plan: Descent, work: Workspace) -> DataFrame:
    """All links inside groups: rows (u, v, linked, forest).

    The rows of a group are dealt into blocks, by their angle to the group's first
    vector where they are more than one block, and two blocks meet once, unless
    angles in them differ by more than that of a link. A meeting gives how many
    rows each row is linked with, not the links, and of the links only a forest that
    connects the same rows, so what leaves it is linear in the rows it read.
    """
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    members = groups.join(sizes, "component").join(
        points.select(F.col("id").alias("node"), "copies", "unit"), "node"
    )
    small = members.filter(F.col("members") <= plan.block).select(
        "component", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("own"),
        "node", "copies", "unit",
    )
    if sizes.filter(F.col("members") > plan.block).take(1):
        large = members.filter(F.col("members") > plan.block)
        small = small.unionByName(_blocks_by_angle(large, points, plan, work))
    grouped = small.repartition("component", "low", "high").sortWithinPartitions(
        "component", "low", "high", "own", "node"
    )

    def link(batches):
        for table in whole_groups(batches, 3):
            keys = [table.column(i).to_numpy() for i in range(3)]
            own, node, copies = (table.column(i).to_numpy() for i in (3, 4, 5))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for start, end in runs(*keys):
                low, high = keys[1][start], keys[2][start]
                cut = end if low == high else start + int(np.searchsorted(own[start:end], high))
                other = start if low == high else cut
                if cut == start or other == end:
                    continue
                a = _doubles(table.column(6).slice(start, cut - start))
                b = a if low == high else _doubles(table.column(6).slice(other, end - other))
                near = a @ b.T >= plan.threshold
                if low == high:
                    np.fill_diagonal(near, False)
                ids_a, ids_b = node[start:cut], node[other:end]
                near &= ids_a[:, None] != ids_b[None, :]
                linked_a = near @ copies[other:end]
                linked_b = copies[start:cut] @ near
                out.append((ids_a, np.full(len(ids_a), -1), linked_a))
                if low != high:
                    out.append((ids_b, np.full(len(ids_b), -1), linked_b))
                left, right = _forest(near, low == high)
                out.append((ids_a[left], ids_b[right], np.zeros(len(left), dtype=np.int64)))
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else (
                [np.empty(0, np.int64)] * 3
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2])],
                names=["u", "v", "linked"],
            )

    return work.stage(grouped.mapInArrow(link, "u long, v long, linked long"), "links")


def _forest(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same rows as `near` does, by breadth-first search."""
    rows, columns = near.shape
    left, right = [], []
    if same:
        waiting = near.any(axis=1)
        while waiting.any():
            queue = [int(np.argmax(waiting))]
            waiting[queue[0]] = False
            while queue:
                at = queue.pop()
                found = np.flatnonzero(near[at] & waiting)
                waiting[found] = False
                left.extend([at] * len(found))
                right.extend(found.tolist())
                queue.extend(found.tolist())
        return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
    rows_left, columns_left = near.any(axis=1), near.any(axis=0)
    while rows_left.any():
        first = int(np.argmax(rows_left))
        rows_left[first] = False
        queue = [(first, True)]
        while queue:
            at, is_row = queue.pop()
            if is_row:
                found = np.flatnonzero(near[at] & columns_left)
                columns_left[found] = False
                left.extend([at] * len(found))
                right.extend(found.tolist())
            else:
                found = np.flatnonzero(near[:, at] & rows_left)
                rows_left[found] = False
                left.extend(found.tolist())
                right.extend([at] * len(found))
            queue.extend((int(x), not is_row) for x in found)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def audit(points: DataFrame, counts: DataFrame, plan: Descent) -> list[tuple[int, int]]:
    """(links found, links there are) of a sample compared with all vectors.

    One entry for vectors with less than 8 links, one for less than 64, and so on,
    so a large group cannot hide what others miss. The sample is the `audited` ids
    with the smallest hash, so its broadcast and the answer are bounded.
    """
    chosen = (
        points.select("id", "length", "unit")
        .orderBy(F.xxhash64("id", F.lit("audit")), "id")
        .limit(plan.audited)
        .collect()
    )
    if not chosen:
        return []
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {r["length"] for r in chosen}:
        rows = [r for r in chosen if r["length"] == size]
        by_length[size] = (
            np.array([r["id"] for r in rows]),
            np.stack([np.frombuffer(r["unit"], dtype=np.float64) for r in rows]),
        )

    def compare(batches):
        for batch in batches:
            ids, length, copies = (batch.column(i).to_numpy() for i in range(3))
            for size, (asked, rows) in by_length.items():
                at = np.flatnonzero(length == size)
                if not len(at):
                    continue
                units = _doubles(batch.column(3).take(pa.array(at)))
                near = (rows @ units.T >= plan.threshold) & (asked[:, None] != ids[at][None, :])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked), pa.array((near @ copies[at]).astype(np.int64))],
                    names=["id", "there"],
                )

    there = (
        points.select("id", "length", "copies", "unit")
        .mapInArrow(compare, "id long, there long")
        .groupBy("id")
        .agg(F.sum("there").alias("there"))
    )
    rows = (
        there.filter("there > 0")
        .join(counts, "id", "left")
        .groupBy(F.floor(F.log2("there") / 3).alias("stratum"))
        .agg(F.sum(F.coalesce("linked", F.lit(0))).alias("found"), F.sum("there").alias("there"))
        .orderBy("stratum")
        .collect()
    )
    return [(r["found"], r["there"]) for r in rows]


def near_vectors(vectors: DataFrame, plan: Descent = Descent()) -> DataFrame:
    """`vec_id, n_links, component_id, kept` of every row.

    `vectors` needs `vec_id` and `embedding`; other columns, labels included, are
    ignored. Links are pairs of vectors with cosine of at least the threshold in
    double precision. Equal vectors are one point with a number of copies.

    Vectors that are null, empty or zero, hold a null or non-finite component, or
    have a null id link with nothing; a null id has a null component and is kept.
    Vectors of different lengths are not compared. Rows that share a `vec_id` are
    one node: each row counts the vectors with other ids its own is linked with,
    and equal rows count once. An empty table gives no rows. If the audited
    recall of vectors with few or with many links stays below its bound after all
    enlargements, the search raises.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "near-vectors")
    units = work.stage(unit_vectors(vectors).distinct(), "units")
    points = work.stage(
        units.groupBy("length", "unit", "small").agg(
            F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")
        ),
        "points",
    )
    count = points.count()
    for attempt in range(plan.most_enlargements + 1):
        wider = Descent(
            **{**plan.__dict__, "neighbours": plan.neighbours << attempt, "tables": plan.tables << attempt}
        )
        lone = points.withColumn("own", F.col("id"))
        graph = neighbour_graph(lone, count, wider, work, f"graph-{attempt}")
        groups = _groups(points, graph, wider, work, f"groups-{attempt}")
        if attempt:
            work.drop("links", "cells")
        links = _exact_links(points, groups, plan, work)
        linked = work.stage(
            links.filter("v < 0").groupBy(F.col("u").alias("id")).agg(
                F.sum("linked").alias("linked")
            ),
            f"linked-{attempt}",
        )
        audited = audit(points, linked, plan)
        if all(found >= plan.recall * there for found, there in audited):
            break
    else:
        raise RuntimeError(f"audit found (found, there) {audited} links by number of links")
    forest = links.filter("v >= 0").select("u", "v")
    member = units.join(points.select("length", "unit", "id", "copies"), ["length", "unit"]).join(
        linked, "id", "left"
    )
    own = member.filter("vec_id <> id").select(F.col("vec_id").alias("u"), F.col("id").alias("v"))
    labels = work.stage(connected(forest.unionByName(own)), "components")
    per_id = (
        member.groupBy("vec_id")
        .agg(F.max(F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .join(labels.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    )
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
        .join(per_id, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )
