"""Token ids, packing and the length histogram against plain Python."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footfall.llm import lengths, packing
from footfall.llm.packing import Capacity, best_fit
from footfall.llm.tokens import default_path, encoder

TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "the cat's  mat\n\nand  so on", "tab\tand\x0bvt", "x\n y", "é ñ ß",
    "日本 語 テキスト", "a b   c", "don't we'll I'm", "<|endoftext|> a <|endoftext|>",
    "word " * 3000, "z" * 20000, " " * 5000 + "x", "\n" * 3000, "12 345 6789 !! ?? ...", "\r\n a\r\n", "emoji 🙂 🙃🙂", "\x00 nul",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizers(plain, text):
    got = np.frombuffer(encoder(default_path()).encode(text), dtype="<u4").tolist()
    assert got == ids_of(plain, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tab1'sé.,-<|>  日🙂"), max_size=40))
def test_ids_equal_for_any_text(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_path())
    got = np.frombuffer(encoder(default_path()).encode(text), dtype="<u4").tolist()
    assert got == ids_of(plain, text)


def check_bins(sizes, capacity):
    number, offset = best_fit(sizes, capacity)
    for b in set(number.tolist()):
        at = np.flatnonzero(number == b)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == np.concatenate([[0], np.cumsum(sizes[at])[:-1]]).tolist()
        assert sizes[at].sum() <= capacity.tokens
        assert len(at) <= capacity.documents
        assert (sizes[at] ** 2).sum() <= capacity.attention
    return len(set(number.tolist()))


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_bins_obey_every_capacity(by):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 2000)
    assert check_bins(sizes, Capacity(100, 3, 10_000, by=by)) >= len(sizes) / 3
    check_bins(sizes, Capacity(100, 100, 10_000, by=by))
    used = check_bins(sizes, Capacity(100, 100, 10_000, (1.0, 0.0, 0.0), by="norm"))
    assert used <= 1.02 * -(-sizes.sum() // 100)


def test_attention_limits_what_shares_a_sequence():
    # Two pieces of 71 squared pass 10,000 together with nothing else.
    assert check_bins(np.array([60, 40, 60, 40]), Capacity(100, 9, 10_000)) == 2
    assert check_bins(np.array([50, 50, 50, 50]), Capacity(100, 9, 10_000)) == 2


def test_few_sequences_for_real_lengths():
    rng = np.random.default_rng(2)
    sizes = np.minimum(2048, rng.lognormal(6.5, 1.0, 30_000).astype(np.int64) + 1)
    used = check_bins(sizes, Capacity())
    assert used <= 1.01 * sizes.sum() / 2048 + 2


def test_empty_and_wrong_capacities():
    assert [len(x) for x in best_fit(np.empty(0, dtype=np.int64), Capacity())] == [0, 0]
    for wrong in (dict(tokens=0), dict(attention=5), dict(by="other")):
        with pytest.raises(ValueError):
            Capacity(**wrong)


def test_packs_every_document_whole(spark, docs_of, plain):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "s"), (90, None, None), (3, " a", "s"), (3, " a", "s")]
    rows.append((91, "long word here " * 4000, "s"))
    got = packing.pack_documents(docs_of(rows)).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["doc_id"], []).append(r)
    for doc, text, _ in rows:
        ids = ids_of(plain, text) + [0]
        pieces = by_key[doc]
        starts = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces})
        at = 0
        for k, (piece, start, length, crc) in enumerate(starts):
            part = np.array(ids[at : at + length], dtype="<u4")
            assert (piece, start) == (k, at) and crc == zlib.crc32(part.tobytes())
            assert length == 2048 or k == 0
            at += length
        assert at == len(ids)
    assert len(by_key[3]) == 3
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_empty_tables(spark, docs_of):
    assert packing.pack_documents(docs_of([])).count() == 0
    assert lengths.token_lengths(docs_of([])).count() == 0


def test_length_histogram_by_brute_force(spark, docs_of, plain):
    texts = [*TEXTS, None, "a", "a"]
    sizes = np.array([len(ids_of(plain, t)) for t in texts])
    histogram = lengths.token_lengths(docs_of([(i, t, "s") for i, t in enumerate(texts)])).cache()
    rows = {r["length"]: r for r in histogram.collect()}
    assert sorted(rows) == sorted(set(sizes.tolist()))
    for size, r in rows.items():
        assert r["documents"] == (sizes == size).sum()
        assert r["documents_at_most"] == (sizes <= size).sum()
        assert r["documents_at_least"] == (sizes >= size).sum()
        assert r["tokens_at_least"] == sizes[sizes >= size].sum()
        assert r["tokens_within"] == np.minimum(sizes, size).sum()
        assert r["tokens_total"] == sizes.sum()
    for limit in (0, 1, 5, 2048, 10**6):
        assert lengths.truncated_total(histogram, limit) == np.minimum(sizes, limit).sum()
    for share in (0.0, 0.3, 0.5, 0.95, 1.0):
        want = next(x for x in sorted(sizes) if (sizes <= x).sum() >= share * len(sizes))
        assert lengths.length_quantile(histogram, share) == want
