"""Classifier, source mix and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm import mixing, quality

RNG = random.Random(5)
CLEAN = ["alpha", "beta", "gamma,", "delta", "of", "the", "house.", "river", "walks", "seldom"]


def prose(n):
    return " ".join(RNG.choice(CLEAN) for _ in range(n)) + "."


def junk(n):
    return " ".join(RNG.choice(CLEAN).upper() + "!!" for _ in range(n))


def labelled(n):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        rows.append((i, prose(30 + i % 40) if good else junk(30 + i % 40), f"s{i % 4}"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_documents_are_told_apart(spark, docs_of):
    rows, labels = labelled(300)
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs_of(rows), labels_df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["predicted"] == int(r["doc_id"] % 3 > 0)


def test_held_out_labels_and_other_columns_do_not_matter(spark, docs_of):
    rows, labels = labelled(200)
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, 1) for d, q, _ in labels]
    schema = "doc_id long, quality int, toxic int"
    other = docs_of([(d, t, "elsewhere") for d, t, _ in rows]).withColumn("lang", F.lit("xx"))
    scores = [
        sorted((r["doc_id"], r["score"]) for r in quality.classify(x, spark.createDataFrame(y, schema)).collect())
        for x, y in ((docs_of(rows), labels), (other, turned))
    ]
    assert scores[0] == scores[1]


def test_edge_rows_get_scores(spark, docs_of):
    rows, labels = labelled(60)
    rows += [(None, prose(9), None), (1000, None, "s"), (1001, "", "s"), (1002, "x" * 200_000, "s"), (3, prose(5), "s")]
    labels += [(None, 1, 0), (5, None, 0), (6, 7, 0), (9, 1, 0), (9, 1, 0)]
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs_of(rows), labels_df).collect()
    assert len(got) == len(rows) and all(0.0 <= r["score"] <= 1.0 for r in got)
    assert quality.classify(docs_of([]), labels_df).count() == 0
    alone = quality.classify(docs_of(rows), labels_df.limit(0)).collect()
    assert {r["score"] for r in alone} == {0.5}


def test_boosted_tables_learn_a_pair_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 3) in [p[:2] for p in model.pairs]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


# --- mixing ------------------------------------------------------------------


def targets_by_hand(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            open_.discard(s)
            left -= target[s]


def many(seed, n, sources):
    rng = random.Random(seed)
    return [(i, "w " * rng.randint(0, 60), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("sources", [["a", "b", None, "é"], ["a"] * 30 + ["b", "c", "z"], ["only"]])
def test_targets_and_taken_words(spark, docs_of, sources):
    rows = many(1, 900, sources)
    got = mixing.mix(docs_of(rows)).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = targets_by_hand(sizes)
    by_id = {d: (s, len(t.split())) for d, t, s in rows}
    taken = Counter()
    for r in got:
        source, size = by_id[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, sizes[source])
        assert r["target"] == pytest.approx(want[source])
        assert size * int(r["taken"] // size if size else 0) == r["taken"] <= 3 * size
        taken[source] += r["taken"]
    assert len(got) == len(rows)
    for source, target in want.items():
        assert abs(taken[source] - target) <= 60
    assert sorted(got) == sorted(mixing.mix(docs_of(rows[::-1])).collect())


def test_mixed_rows_are_the_copies(spark, docs_of):
    rows = many(2, 200, ["a", "b", "c"]) + [(None, "x y", "a"), (7, "x y", "a"), (7, "x y", "a"), (8, None, None)]
    docs = docs_of(rows)
    words = Counter()
    for r in mixing.mix(docs).collect():
        words[r["doc_id"]] += r["taken"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    out = Counter()
    for r in mixed.collect():
        out[r["doc_id"]] += len((r["text"] or "").split())
    assert +out == +words


def test_no_documents_and_no_words(spark, docs_of):
    assert mixing.mix(docs_of([])).count() == 0 and mixing.mixed_documents(docs_of([])).count() == 0
    got = mixing.mix(docs_of([(1, None, "a"), (2, "", "b")])).collect()
    assert [(r["taken"], r["target"]) for r in got] == [(0, 0.0), (0, 0.0)]


# --- pipeline ----------------------------------------------------------------


def test_stages_one_by_one(spark, tmp_path, docs_of):
    rows, labels = labelled(240)
    rows += [(900 + i, rows[i * 3 + 1][1] + " end", "s1") for i in range(20)]
    docs = spark.createDataFrame(
        [(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    kept = corpus_pipeline.keep_quality(spark, docs, folder)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, t, _ in rows if "!!" not in t}
    alone = corpus_pipeline.drop_near_duplicates(spark, kept, folder)
    ids = {r["doc_id"] for r in alone.collect()}
    assert not ids & set(range(900, 920)) and alone.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, alone, folder)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= ids
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(
        r["doc_id"] for r in mixed.collect()
    )


def test_one_row_of_a_repeated_id_stays(spark, docs_of):
    rows = [(1, "a b c d", "s"), (1, "a b c d", "s"), (2, "A b c d", "s"), (None, "a b c d", "s"), (3, None, "s")]
    out = corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), "")
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3]
