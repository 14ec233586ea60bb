"""Near duplicates against exact comparison of all shingle sets."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from footfall.llm import hyperminhash as H
from footfall.llm.components import connected


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def expected(rows):
    """Components with rows of one doc_id as one node."""
    rows = [(d, shingles(t)) for d, t, _ in rows if d is not None]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            both = len(x & y)
            if x and y and 100 * both >= 85 * (len(x) + len(y) - both) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d, _ in rows}


def check(rows, got):
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def corpus(seed, groups, copies, words, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, doc = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(*copies)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((doc, " ".join(text), "s"))
            doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,words,edits", [(1, (4, 20), 1), (2, (80, 300), 8), (3, (300, 400), 25)])
def test_equals_comparing_all_pairs(spark, docs_of, seed, words, edits):
    rows = corpus(seed, 40, (1, 6), words, edits)
    check(rows, H.near_duplicates(docs_of(rows)).collect())


def test_large_group_of_near_copies_in_small_blocks(spark, docs_of):
    rows = corpus(4, 1, (150, 150), (200, 200), 9)
    check(rows, H.near_duplicates(docs_of(rows), block=3000).collect())


def test_blocks_alone_find_every_link(spark, docs_of, monkeypatch):
    rows = corpus(5, 2, (40, 40), (200, 200), 9)
    hubs = H._confirmed
    monkeypatch.setattr(H, "_confirmed", lambda *a: hubs(*a).filter("false"))
    check(rows, H.near_duplicates(docs_of(rows), block=1000).collect())


def test_group_of_2000_near_copies_gives_few_candidates(spark, docs_of, monkeypatch):
    """Similar to each other from 0.6 to 0.95, so many pairs lie near the threshold."""
    rows = corpus(6, 1, (2000, 2000), (150, 150), 8)
    counts = {}

    def counted(name):
        inner = getattr(H, name)

        def run(*args):
            out = inner(*args).cache()
            counts[name] = out.count()
            return out

        monkeypatch.setattr(H, name, run)

    for name in ("_promising", "_confirmed", "_across"):
        counted(name)
    got = H.near_duplicates(docs_of(rows)).collect()
    assert counts["_promising"] <= 25 * 2000 and counts["_confirmed"] <= 2000 and counts["_across"] <= 4000
    check(rows, got)


def test_sets_without_a_partner_leave_before_pairs(spark):
    rows = [(1, i, i, 100, b"", list(range(100 * (i < 5))) or [10_000 * i + k for k in range(100)]) for i in range(8)]
    rows.append((1, 9, 9, 100, b"", [*range(84), *range(900_000, 900_016)]))
    rows.append((1, 10, 10, 100, b"", [*range(85), *range(800_000, 800_015)]))
    sets = spark.createDataFrame(rows, H.SETS)
    kept = lambda block: {r["rep"] for r in H._with_partners(sets, H.Settings(), block).collect()}
    assert kept(500) == {0, 1, 2, 3, 4, 10}
    assert kept(5000) == {*range(8), 9, 10}


def test_counts_of_common_shingles():
    rng = np.random.default_rng(8)
    for columns in (3, 4096):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(12)]
        old, H._COLUMNS_AT_ONCE = H._COLUMNS_AT_ONCE, columns
        got = H._common_counts(sets[:5], sets[5:])
        H._COLUMNS_AT_ONCE = old
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert H._common_counts([np.array([1])], [np.array([2])]).tolist() == [[0.0]]


def test_nulls_empties_ties_and_repeats(spark, docs_of):
    same = "one two three four five six seven"
    rows = [
        (5, same, "s"), (2, same.upper(), None), (9, same + " ", "s"), (None, same, "s"), (7, None, "s"),
        (8, "", "s"), (10, " \t\n", "s"), (11, "single", "s"), (12, "SINGLE", "s"), (13, "two words", "s"),
        (14, "two\x0bwords", "s"), (15, "words two", "s"), (2, same, "s"), (20, "é two x", "s"),
        (21, "É two x", "s"), (30, "other text of its own here", "s"), (30, same, "s"),
        (31, "nbsp one word", "s"), (40, "long " * 50_000, "s"), (41, "long " * 60_000, "s"),
    ]
    got = H.near_duplicates(docs_of(rows)).collect()
    check(rows, got)
    sizes = {}
    for r in got:
        sizes.setdefault(r["doc_id"], set()).add(r["n_shingles"])
    assert sizes[7] == sizes[8] == sizes[10] == {0} and sizes[11] == {1} and sizes[40] == {1}
    assert H.near_duplicates(docs_of([])).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    settings = H.Settings()
    for size in (20, 200, 5000):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(size * 0.8), dtype=np.uint64)
            a, b = (
                np.unique(np.concatenate([both, rng.integers(0, 2**63, size - len(both), dtype=np.uint64)]) * np.uint64(2) + np.uint64(1))
                for _ in range(2)
            )
            a, b = (np.unique(H.mix64(x)) for x in (a, b))
            equal = np.array([(H.registers_of(a, settings) == H.registers_of(b, settings)).sum()])
            estimate = H.estimated_similarity(equal, np.array([len(a)]), np.array([len(b)]), settings)
            errors.append(estimate[0] - 0.8 / 1.2)
        assert abs(np.mean(errors)) < 0.05


def test_chance_matches_of_disjoint_sets_are_taken_out():
    rng = np.random.default_rng(4)
    settings = H.Settings(mantissa_bits=2)
    equal = []
    for _ in range(60):
        a, b = (np.unique(rng.integers(0, 2**64 - 1, 4096, dtype=np.uint64)) for _ in range(2))
        equal.append((H.registers_of(a, settings) == H.registers_of(b, settings)).sum())
    share = np.mean(equal) / settings.registers
    chance = H._chance_table(settings.registers, 2)[12, 12]
    assert share > 0.02 and abs(share - chance) < 0.015


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(100, 180)] + [(1, i) for i in range(2, 60)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links + links[:5], "u long, v long")
    got = {r["node"]: r["component"] for r in connected(df).collect()}
    assert got == {i: 100 for i in range(100, 181)} | {i: 1 for i in range(1, 60)}
    assert connected(df.limit(0)).count() == 0


def test_wrong_settings():
    for wrong in (dict(registers=100), dict(bands=40)):
        with pytest.raises(ValueError):
            H.Settings(**wrong)


def test_pipeline_drops_copies_with_an_added_block(spark, docs_of):
    words = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(words[:100]), "a"), (2, " ".join(words), "a"), (3, " ".join(words[60:]), "a")]
    assert {r["kept"] for r in H.near_duplicates(docs_of(rows)).collect()} == {True}
    stay = corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), "")
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 3]


def test_pipeline_keeps_one_row_of_an_id_whatever_its_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, {"a": 1}, 5), (1, text + " more", {"b": 2}, 4), (None, text, None, 3), (None, text, None, 3), (2, "x y", {}, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row map<string,int>, id int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    found = sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in found] == [1, 2, None, None] and found[0]["_row"] == {"b": 2}
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0
