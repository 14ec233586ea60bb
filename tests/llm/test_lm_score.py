"""Language-model scores: exact counts, probabilities that add up, better fits."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import lm_score as L

SMALL = L.Mixing(slot_bits=14, block_bits=10, batch_words=500)


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower)] + [b""]


def held(doc):
    return zlib.crc32(str(doc if doc is not None else "").encode()) % 7 == 2


def corpus(n):
    rng = random.Random(3)
    parts = ["ta", "ri", "lo", "men", "shu", "vek"]
    kinds = [[f"{''.join(rng.choice(parts) for _ in range(rng.randint(1, 4)))}{k}" for _ in range(150)] for k in "xyz"]
    return [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(1, 80))), "s") for i in range(n)]


def test_counts_and_base_scores(spark, docs_of):
    rows = corpus(200) + [(None, "Ta RI new", "s"), (500, None, "s"), (501, "", "s"), (502, "q" * 50_000, "s"),
                          (503, "tarix\x0btarix é", "s"), (4, "again", "s"), (4, "again", "s")]
    got = L.score_documents(docs_of(rows), SMALL).collect()
    counts = Counter()
    for doc, text, _ in rows:
        if not held(doc):
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for doc, text, _ in rows:
        t = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)
        want[(doc, held(doc), len(t), sum(counts[w] > 0 for w in t), total, round(base, 6))] += 1
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and np.isfinite(r["score"]) and r["bits_per_byte"] > 0 for r in got)
    assert L.score_documents(docs_of([]), SMALL).count() == 0


def test_held_out_texts_fit_better_than_the_base(spark, docs_of):
    got = [r for r in L.score_documents(docs_of(corpus(400)), SMALL).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_a_rare_language_gets_a_kind_of_its_own(spark, docs_of):
    """All training documents are clustered; of 5000, 4 are in other words."""
    rows = [(i, f"common words of all {'ab'[i % 2]}", "s") for i in range(5000)]
    # The ids that a sample of the smallest hashes takes last.
    late = spark.range(5000, 9000).orderBy(F.desc(F.xxhash64("id", F.lit("kind")))).limit(20).collect()
    rare = [r["id"] for r in late if not held(r["id"])][:4]
    rows += [(i, "seldom heard speech", "s") for i in rare]
    chunks = L.word_chunks(docs_of(rows), SMALL).localCheckpoint()
    centres = L.document_kinds(chunks, SMALL)
    assert len(centres) == 3
    found = {bytes(r["word"]): r for r in L.vocabulary(chunks, centres).collect()}
    kinds = [f"c_{k}" for k in range(len(centres))]
    assert sorted(found[b"seldom"][k] for k in kinds) == [0, 0, 4]
    assert [found[b"common"][k] for k in kinds if found[b"seldom"][k]] == [0]


def test_spelled_words_share_one_probability():
    counts = np.random.default_rng(0).integers(0, 9, (5, 2, 1 << 14)).astype("f4")
    model = L.Model(counts, SMALL)
    # All one-byte words, the end, and what goes on from there.
    firsts = [bytes([b]) for b in range(256) if b not in b" \n"]
    whole = 10.0 ** model.log10([b"", *firsts])
    assert 0 < whole.sum() < 1
    spelled = L.Spelled([b"a"], SMALL)
    assert len(spelled.bytes) == 2
    total = 0.0
    for byte in range(256):
        p = 1.0
        text = L.Spelled([b""], SMALL)
        text.bytes[:] = byte
        for k in range(8):
            value, node, slots = text.bit(k)
            one = float(model.bit_probability(node, slots)[0])
            p *= one if value[0] else 1.0 - one
        total += p
    assert total == pytest.approx(1.0, abs=1e-4)


def test_discounted_shares_add_up():
    c = np.array([5, 3, 1, 1, 1, 2, 0, 0])
    share = L._Discount(int(c.sum()), 6, 3, 1)
    coarser = np.log(np.full(8, 1 / 8))
    assert np.exp(share.mixed(c.astype(float), coarser)).sum() == pytest.approx(1.0)
    assert (L._Discount(0, 0, 0, 0).mixed(c.astype(float), coarser) == coarser).all()


def test_weights_learn_to_trust_the_better_order():
    rng = random.Random(1)
    words = ["".join(rng.choice(["ka", "lo", "mi", "tu"]) for _ in range(3)).encode() for _ in range(4000)]
    model = L.Model(np.zeros((5, 2, 1 << 14), dtype="f4"), SMALL)
    spelled = L.Spelled(words[:3000], SMALL)
    for k in range(8):
        value, _, slots = spelled.bit(k)
        for i, slot in enumerate(slots):
            np.add.at(model.counts[i], (value, slot), 1.0)
    before = model.log10(words[3000:]).sum()
    learner = L._Learner(model)
    for start in range(0, 3000, 500):
        learner.learn(words[start : start + 500], np.ones(500), refine=True)
    assert model.log10(words[3000:]).sum() > before


def followed(words):
    """What each word's context tells, word by word: (context, right) or None."""
    out = []
    for i, word in enumerate(words):
        best = None
        for context, back in ((0, 1), (1, 2)):
            if i >= back:
                before = [j for j in range(back, i) if words[j - back : j] == words[i - back : i]]
                if before:
                    best = (context, words[before[-1]] == word)
        if best and best[0] and out[-1] and out[-1][1]:
            best = (2, best[1])
        out.append(best)
    return out


def test_contexts_of_words_against_a_plain_search():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 1 + rng.integers(1, 9), size) for size in (1, 2, 3, 40, 1, 300, 7)] + [np.tile([4, 5, 6, 4, 7], 9)]
    sizes = np.array([len(t) for t in texts])
    ids = np.concatenate(texts)
    want = [0 if x is None else 1 + 2 * x[0] + x[1] for t in texts for x in followed(t.tolist())]
    flags = L.follow(ids, sizes)
    assert flags.tolist() == want and set(want) == set(range(7))
    rates, prior = np.array([0.1, 0.3, 0.8]), 4.0
    log_p = np.log(rng.dirichlet(np.ones(10)))
    got = L._in_order(ids, sizes, flags, rates, prior)(log_p)
    for text, score in zip(texts, got, strict=True):
        total, tries, rights = 0.0, [0] * 3, [0] * 3
        for word, told in zip(text, followed(text.tolist()), strict=True):
            p = math.exp(log_p[word])
            if told:
                context, right = told
                trust = (rights[context] + prior * rates[context]) / (tries[context] + prior)
                p = (1.0 - trust) * p + trust * right
                tries[context] += 1
                rights[context] += right
            total += math.log(p)
        assert score == pytest.approx(total)


def test_the_order_of_the_words_counts(spark, docs_of):
    rng = random.Random(8)
    line = [f"w{rng.randrange(60)}" for _ in range(40)]
    mixed = line * 5
    rng.shuffle(mixed)
    rows = corpus(60) + [(1000, " ".join(line * 5), "s"), (1001, " ".join(mixed), "s")]
    got = {r["doc_id"]: r for r in L.score_documents(docs_of(rows), SMALL).collect()}
    assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])
    assert got[1000]["score"] > got[1001]["score"] + 20


def test_the_word_before_counts_over_the_corpus(spark, docs_of):
    """Pairs that stand together in training are cheaper, in texts that repeat no word."""
    rng = random.Random(4)
    firsts, seconds = ([f"{a}{b}{end}" for a in "bdkl" for b in "aeiou"] for end in ("nt", "rs"))
    pairs = list(zip(firsts, seconds, strict=True))
    rows = []
    for i in range(1, 300):
        rng.shuffle(pairs)
        rows.append((i, " ".join(w for pair in pairs for w in pair), "s"))
    together = " ".join(w for pair in pairs for w in pair)
    apart = " ".join(w for (a, _), (_, b) in zip(pairs, pairs[1:] + pairs[:1], strict=True) for w in (a, b))
    late = [i for i in range(1000, 1100) if held(i)][:2]
    rows += [(late[0], together, "s"), (late[1], apart, "s")]
    got = {r["doc_id"]: r for r in L.score_documents(docs_of(rows), SMALL).collect()}
    assert got[late[0]]["base_score"] == pytest.approx(got[late[1]]["base_score"])
    assert got[late[0]]["score"] > got[late[1]]["score"] + 5


def test_codes_of_bytes_are_whole_and_short():
    counts = np.zeros(256)
    counts[[32, 97, 98, 99]] = 10_000, 5_000, 2_500, 1_200
    code = L.Code.of_counts(counts)
    assert (0.5 ** code.size).sum() == pytest.approx(1.0)
    assert code.size[[32, 97, 98, 99]].tolist() == [1, 2, 3, 4]
    spelled = {"".join(str(code.value[k, b]) for k in range(code.size[b])) for b in range(256)}
    assert len(spelled) == 256
    assert len({(int(code.node[k, b])) for b in range(256) for k in range(code.size[b])}) == 255


def test_texts_cost_their_words_behind_the_words_before():
    rng = np.random.default_rng(2)
    words = [b"", b"a", b"the", b"word", "caf\u00e9s".encode(), b"x" * 40]
    counts = rng.integers(0, 9, (SMALL.contexts, 2, 1 << 14)).astype("f4")
    model = L.Model(counts, SMALL, L.Code.of_counts(rng.integers(0, 1000, 256)))
    texts = [[*rng.integers(1, 6, n).tolist(), 0] for n in (0, 1, 5, 30, 200)]
    sizes = np.array([len(t) for t in texts])
    got = model.in_texts(words, np.concatenate(texts).astype(np.int64), sizes)
    want, lexicon = [], L.Lexicon(words)
    for text in texts:
        for word, last in zip(text, [-1, *text], strict=False):
            one = L.Spelled.in_text(lexicon, np.array([word]), np.array([last]), SMALL, model.code)
            want.append(model.spelling(one)[0])
    assert got == pytest.approx(want, rel=1e-4)
    # Bytes of any length of code, in one context: all words of one byte and what goes on.
    firsts = [bytes([b]) for b in range(256) if b not in b" \n"]
    every = model.in_texts([b"", *firsts], np.arange(255), np.ones(255, dtype=np.int64))
    assert 0 < np.exp(every).sum() < 1


def test_bytes_behind_a_short_word_see_the_word_before():
    lexicon = L.Lexicon([b"ab", b"cb", b"x"])
    spelled = L.Spelled.in_text(lexicon, np.array([2, 2, 2]), np.array([0, 1, -1]), SMALL, L.Code.plain())
    first = [h[[0, 2, 4]] for h in spelled.hashes]
    # One and two bytes back the texts are alike ("b "), three back they are not.
    assert first[0][0] == first[0][1] and first[1][0] == first[1][1]
    assert all(len(set(h.tolist())) == 3 for h in first[2:])


def texts_of(words, sizes, seed):
    rng = np.random.default_rng(seed)
    return np.minimum(rng.geometric(0.02, sum(sizes)) - 1, words - 1).astype(np.int64), np.array(sizes)


def test_documents_in_blocks_tell_the_same():
    ids, sizes = texts_of(200, [1, 70_000, 1, 5, 40_000, 40_000, 3], 6)
    blocks = list(L.document_blocks(sizes))
    assert [(d.start, d.stop) for d, _ in blocks] == [(0, 1), (1, 2), (2, 5), (5, 7)]
    assert [w.start for _, w in blocks[1:]] == [w.stop for _, w in blocks[:-1]]
    assert blocks[0][1].start == 0 and blocks[-1][1].stop == len(ids)
    assert L.follow(ids, sizes).tolist() == L._followed(ids, sizes).tolist()


def test_pairs_count_and_place_every_word():
    ids, sizes = texts_of(90, [1, 4, 300, 2, 1000], 7)
    words = [b"", *(f"w{i}".encode() for i in range(89))]
    before = np.concatenate([[-1], ids[:-1]])
    before[np.cumsum(sizes) - sizes] = -1
    want = Counter(zip(ids.tolist(), before.tolist(), strict=True))
    counted, placed = L.Pairs(words, ids, sizes), L.Pairs(words, ids, sizes, places=True)
    got = zip(counted.ids.tolist(), counted.last.tolist(), counted.times.tolist(), strict=True)
    assert {(a, b): n for a, b, n in got} == want
    assert placed.ids[placed.of].tolist() == ids.tolist()
    assert placed.last[placed.of].tolist() == before.tolist()


def test_slots_of_a_bit_and_its_value():
    spelled = L.Spelled([b"some", b"words", b"here"], SMALL)
    for (value, node, slots), (value_too, node_too, pairs) in zip(spelled.bits(), spelled.bits(valued=True), strict=True):
        assert (value == value_too).all() and (node == node_too).all()
        for slot, pair in zip(slots, pairs, strict=True):
            assert pair.tolist() == (2 * slot + value).tolist()


def test_learning_holds_the_tables_alone():
    """Tasks learn from the tables that the driver made of the counts, without counts beside them."""
    counts = np.random.default_rng(3).integers(0, 30, (SMALL.contexts, 2, 1 << 14)).astype("f4")
    code = L.Code.plain()
    given = L._Learner(L.Model(None, SMALL, code), L.Model(counts, SMALL).training_tables())
    own = L._Learner(L.Model(counts, SMALL, code))
    pairs = L.Pairs([b"", b"some", b"words"], np.array([1, 2, 1, 1, 0]), np.array([5]))
    for learner in (given, own):
        for some, spelled in pairs.parts(1 << 18, SMALL, code, spread=True):
            times = pairs.times[some].astype(np.float32).take(spelled.word)
            learner.learn_spelled(spelled, times, refine=True)
    assert (own.model.weights != 0.35).any()
    assert given.model.counts is None
    assert (given.model.weights == own.model.weights).all()


def test_small_shares_stay_finite():
    """A word without a count of its own keeps its log probability, however small."""
    share = L._Discount(10, 6, 3, 1)
    off = 0.6
    coarser = np.array([-5000.0, -5000.0, -3.0])
    got = share.mixed(np.array([0.0, 2.0, 2.0]), coarser)
    left = off * 6 / 10
    want = [-5000.0 + math.log(left), math.log(1.4 / 10), math.log(1.4 / 10 + left * math.exp(-3.0))]
    assert got == pytest.approx(want)


def test_memory_of_a_chunk_stays_small():
    """What is held beside a chunk's own words does not grow with all of them at 8 bytes many times over."""
    ids, sizes = texts_of(2_000, [500] * 2_000, 10)
    tracemalloc.start()
    try:
        L.follow(ids, sizes)
        assert tracemalloc.get_traced_memory()[1] < 24_000_000
    finally:
        tracemalloc.stop()


def test_joined_words_are_the_listed_words():
    for words in ([b""], [b"a", b"", b"caf\xc3\xa9"], [b"x" * 40, b"y"], [b"", b"\x1c"]):
        listed, joined = L.Lexicon(words), L.Lexicon(b"\n".join(words))
        texts = [w + b" " if w else b"\n" for w in words]
        assert listed.bytes.tobytes() == b"".join(texts) == joined.bytes.tobytes()
        assert listed.size.tolist() == [len(t) for t in texts] == joined.size.tolist()
        assert [int(i) for i in joined.start] == [sum(map(len, texts[:i])) for i in range(len(texts))]
        assert (listed.hash == joined.hash).all() and (listed.tail == joined.tail).all()
    assert len(L.Lexicon([], contexts=False).size) == 0
