"""Merkle proofs against whole trees held in memory."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from footfall.llm import manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def steps_of(levels, i):
    for nodes in levels[:-1]:
        first = i - i % 3
        yield i - first, [n for j, n in enumerate(nodes[first : first + 3]) if j != i - first]
        i //= 3


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for own in by_source.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
    trees = {s: levels_of([leaf_of(r, r["text"]) for r in by_source[s]]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    for place, s in enumerate(names):
        for i, row in enumerate(by_source[s]):
            steps = [*steps_of(trees[s], i), *steps_of(top, place)]
            node, leaf = trees[s][0][i], trees[s][0][i]
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                node = leaf_of(row, row["text"] and row["text"].replace("\n", ""))
            for at, others in steps:
                node = h("".join([*others[:at], node, *others[at:]]))
            proof = h("".join(n for _, others in steps for n in others))
            root = top[-1][0]
            yield (row["doc_id"], leaf, trees[s][-1][0], root, proof, node, node == root)


def same(spark, docs):
    got = sorted(map(tuple, manifest.proofs(docs).collect()), key=str)
    assert got == sorted(plain(docs.collect()), key=str)
    return got


@pytest.mark.parametrize("block_levels", [1, 2, 6])
def test_proofs_equal_whole_trees(spark, docs_of, monkeypatch, block_levels):
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", block_levels)
    rows = [(7 * i, f"text {i}\nnext" * (i % 3), f"s{i % 2 if i % 5 else i % 11}") for i in range(120)]
    rows += [(1000 + i, "one\ntwo", "hot") for i in range(100)]
    rows += [(2000, None, None), (2002, "", None), (2004, "a\nb", "ünï"), (2004, "a\nb", "ünï"), (2004, "c", "ünï")]
    rows += [(None, "no\nid", "s1"), (None, None, None), (-5, "x\r\ny", ""), (3000, "lone", "z")]
    got = same(spark, docs_of(rows))
    assert {r[-1] for r in got} == {True, False}


def test_nulls_in_every_column_and_very_long_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"
    rows = [(None,) * 7, (1, "x\n" * 2_000_000, None, "a", None, "l", 1), (2, "é\n", "en", "a", 2, None, 2)]
    same(spark, spark.createDataFrame(rows, schema))


def test_lone_leaf_and_none(spark, docs_of):
    (row,) = same(spark, docs_of([(1, "a", "s")]))
    assert row[1] == row[2] == row[3] and row[4] == h("")
    assert manifest.proofs(docs_of([])).count() == 0


def test_a_third_of_all_rows_alike(spark, docs_of):
    same(spark, docs_of([(5, "copy\n", "s")] * 900 + [(i, str(i), f"t{i % 4}") for i in range(1800)]))


def test_missing_nodes_are_minimal():
    levels = levels_of([h(str(i)) for i in range(50)])
    for known in ({0}, {49}, {0, 1, 2}, {3, 4, 30}, set(range(9, 18)), set(range(50))):
        wanted = manifest.missing_nodes(known, 0, 50)
        have = {(0, i): levels[0][i] for i in known} | {(a, i): levels[a][i] for a, i in wanted}

        def derive(have):
            for level in range(len(levels) - 1):
                for i in range(len(levels[level + 1])):
                    run = [have.get((level, j)) for j in range(3 * i, min(3 * i + 3, len(levels[level])))]
                    if None not in run:
                        have[level + 1, i] = h("".join(run))
            return have.get((len(levels) - 1, 0))

        assert derive(dict(have)) == levels[-1][0]
        for node in wanted:
            assert derive({k: v for k, v in have.items() if k != node}) is None


def test_proofs_fold_back_and_catch_changes():
    levels = [[n.encode() for n in nodes] for nodes in levels_of([h(str(i)) for i in range(20)])]
    fetched = {(a, i): n for a, nodes in enumerate(levels) for i, n in enumerate(nodes)}
    for i in range(20):
        steps, root = manifest.climb(levels[0][i], i, 0, 20, fetched)
        assert manifest.fold(levels[0][i], steps) == root == levels[-1][0]
        assert manifest.fold(b"0" * 64, steps) != root


def test_only_digests_are_shuffled(spark, docs_of):
    df = manifest.leaf_digests(docs_of([(1, "a", "s")])).select(F.length("leaf").alias("n"), "altered")
    assert df.first()["n"] == 32
