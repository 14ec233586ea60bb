"""Top-k search and near vectors against comparing all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from footfall.llm import neighbours, topk

SCHEMA = "vec_id long, embedding array<float>, label int, size int, component long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


ODD = [
    (9000, None), (9020, [1.0, None, 0.0, 0.0]), (9040, [float("nan")] * 4), (9060, [float("inf"), 0.0, 0.0, 0.0]),
    (9080, []), (None, [0.1, 0.2, 0.3, 0.4]), (9100, [0.0, 0.0, 0.0, 0.0]),
]


@pytest.mark.parametrize("blocks", [(16_384, 2_048), (64, 8)])
def test_top_products(spark, blocks):
    rng = np.random.default_rng(1)
    values = np.round(rng.standard_normal((400, 4)), 1).astype("f4").tolist()
    rows = [(i, v) for i, v in enumerate(values)] + ODD + [(401, values[0]), (402, values[0]), (402, values[0])]
    numbers = vectors_of(spark, rows).filter(topk.usable(topk.F.col("embedding"))).select(
        "vec_id", topk.whole_numbers(topk.F.col("embedding")).alias("vector"), "size"
    )
    got = topk.top_products(numbers, 20, 20, *blocks).collect()
    usable = {(i, tuple(v)) for i, v in rows if i is not None and sound(v)}
    ids = np.array([i for i, _ in usable])
    whole = np.floor(64.0 * np.array([np.array(v, dtype="f4").astype(float) for _, v in usable])).astype(int)
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = whole @ whole[q]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]][:20]
        want += [(ids[q], k + 1, ids[j], scores[j]) for k, j in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_products_of_few_and_none(spark):
    got = topk.search_embeddings(vectors_of(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (20, [0.5])])).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64 * 64 + 128 * 64)]
    assert topk.search_embeddings(vectors_of(spark, ODD[:5])).count() == 0
    assert topk.search_embeddings(vectors_of(spark, [])).count() == 0


def test_large_whole_numbers_stay_exact():
    rows = np.array([[2**40, 1], [2**40, 2], [2**40, 3]], dtype=np.int64)
    ids, scores = topk.SortedLists(np.array([5, 6, 7]), rows).top(np.array([2**20, 1]), 5, 2)
    assert ids.tolist() == [7, 6] and scores.tolist() == [2**60 + 3, 2**60 + 2]


def test_reading_stops_by_the_bound_where_few_dimensions_decide():
    rng = np.random.default_rng(9)
    rows = np.floor(1000 * rng.standard_normal((5000, 8)) * (0.2 ** np.arange(8))).astype(np.int64)
    lists = topk.SortedLists(np.arange(5000), rows)
    for q in range(0, 400, 20):
        ids, scores = lists.top(rows[q], q, 20)
        all_scores = rows @ rows[q]
        order = [i for i in np.lexsort((np.arange(5000), -all_scores)) if i != q][:20]
        assert ids.tolist() == order and scores.tolist() == all_scores[order].tolist()
    assert lists.queries == 20 and lists.stopped_by_bound == 20 and lists.rows_met < 20 * 2500
    even = topk.SortedLists(np.arange(300), rng.integers(-50, 50, (300, 64)))
    even.top(even.rows[3], 3, 20)
    assert even.rows_met == 300 and even.stopped_by_bound == 0
    assert topk.SortedLists(np.arange(3), np.ones((3, 2), int)).top(np.zeros(2, int), 1, 5)[0].tolist() == [0, 2]


def test_components_too_large_for_exact_scores_raise(spark):
    with pytest.raises(Exception, match="too large in vector 7"):
        topk.search_embeddings(vectors_of(spark, [(7, [1e30, 1.0]), (20, [1.0, 2.0])])).collect()
    wide = spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 2])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="exceed 64 bits"):
        topk.top_products(wide).collect()


def links_of(rows, threshold=0.95):
    ids = sorted({i for i, v in rows if i is not None})
    units = {i: [] for i in ids}
    for i, v in rows:
        if i is not None and sound(v) and any(v):
            x = np.array(v, dtype="f4").astype(float)
            units[i].append(x / np.sqrt(x @ x))
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = dict.fromkeys(ids, 0)
    for a in ids:
        for b in ids:
            if a != b and any(len(x) == len(y) and x @ y >= threshold for x in units[a] for y in units[b]):
                count[a] += 1
                if root(a) != root(b):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (count[i], root(i)) for i in ids}


def test_near_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((300, 16)).tolist())]
    for group, (size, noise) in enumerate([(2, 0.02), (40, 0.03), (12, 0.08), (5, 0.0)]):
        base = rng.standard_normal(16)
        rows += [
            (1000 * (group + 1) + k, (base + noise * rng.standard_normal(16)).tolist()) for k in range(size)
        ]
    rows += [(i, v) for i, v in ODD if i is not None] + [(7777, rows[0][1]), (8888, [2.0, 1.0]), (8889, [4.0, 2.0])]
    rng.shuffle(rows := [tuple(r) for r in rows])
    plan = neighbours.Descent(block=16, start_block=16)
    got = neighbours.near_vectors(vectors_of(spark, [(int(i), v) for i, v in rows] + [(None, [1.0, 0.0])]), plan)
    want = links_of([(int(i), v) for i, v in rows])
    found = got.collect()
    assert len(found) == len(rows) + 1
    for r in found:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"]) == want[r["vec_id"]]
            assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_full_lists_do_not_hide_links_between_clusters(spark):
    """Three clusters tighter than their distance, each larger than the largest list."""
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((100, 16)).tolist())]
    base, side = rng.standard_normal((2, 16))
    base, side = base / np.sqrt(base @ base), side - base * (side @ base) / (base @ base)
    side /= np.sqrt(side @ side)
    for group, angle in enumerate((0.0, 0.27, 0.54)):
        middle = np.cos(angle) * base + np.sin(angle) * side
        rows += [(1000 * (group + 1) + k, (middle + 0.004 * rng.standard_normal(16)).tolist()) for k in range(40)]
    want = links_of(rows)
    assert want[3039][1] == 1000 and want[2000][0] == 119
    got = neighbours.near_vectors(vectors_of(spark, rows), neighbours.Descent(block=16, start_block=16))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == want


def test_long_groups_meet_only_where_angles_allow(spark, tmp_path):
    """A chain of vectors over half a turn: one group in many blocks, few of which meet."""
    angles = np.linspace(0.0, 3.0, 900)
    rows = [(i, [float(np.cos(a)), float(np.sin(a)), 0.0]) for i, a in enumerate(angles)]
    want = links_of(rows)
    assert want[899][1] == 0
    plan = neighbours.Descent(block=32, start_block=16)
    got = neighbours.near_vectors(vectors_of(spark, rows), plan).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    units = neighbours.unit_vectors(vectors_of(spark, rows))
    points = units.selectExpr("vec_id AS id", "length", "unit", "small", "1L AS copies")
    large = points.selectExpr("0L AS component", "id AS node", "copies", "unit")
    work = neighbours.Workspace(spark, "test-blocks")
    dealt = neighbours._blocks_by_angle(large, points, plan, work).select("low", "high", "node").collect()
    blocks = {r["low"] for r in dealt} | {r["high"] for r in dealt}
    met = {(r["low"], r["high"]) for r in dealt}
    assert len(blocks) > 30 and len(met) < len(blocks) * (len(blocks) + 1) / 4


def test_proposals_of_a_task_are_cut_to_a_list():
    rng = np.random.default_rng(8)
    u, v = rng.integers(0, 20, 5_000), rng.integers(100, 400, 5_000)
    s = (u * 31 + v * 17) % 997 / 997
    parts = [neighbours._edge_batch([u[i : i + 100]], [v[i : i + 100]], [s[i : i + 100]]) for i in range(0, 5_000, 100)]
    whole = neighbours._top_edges(pa.Table.from_batches(parts), 8).to_pylist()
    for most in (10, 200, 1_000):
        cut = list(neighbours._combined(iter(parts), 8, most))
        assert neighbours._top_edges(pa.Table.from_batches(cut), 8).to_pylist() == whole
        # Lists that fill half the room leave at once; others wait for what may come.
        assert most < 1_000 or sum(b.num_rows for b in cut) <= 20 * 8


def test_audit_judges_few_and_many_links_apart(spark):
    rows = [(k, [1.0, 0.001 * k, 0.0]) for k in range(60)] + [(100, [0.0, 0.0, 1.0]), (101, [0.0, 0.01, 1.0])]
    units = neighbours.unit_vectors(vectors_of(spark, rows))
    points = units.selectExpr("vec_id AS id", "length", "unit", "small", "1L AS copies")
    counts = spark.createDataFrame([(k, 59) for k in range(60)], "id long, linked long")
    assert neighbours.audit(points, counts, neighbours.Descent()) == [(0, 2), (60 * 59, 60 * 59)]


def test_no_vectors(spark):
    assert neighbours.near_vectors(vectors_of(spark, [])).count() == 0
    got = neighbours.near_vectors(vectors_of(spark, [(3, None), (3, None)])).collect()
    assert [tuple(r) for r in got] == [(3, 0, 3, True)] * 2
