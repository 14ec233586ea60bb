"""Licence scan against edit distances of every span of words."""

import random

import pytest

from footfall.llm import licenses
from footfall.llm.licenses import NOTICES, Notice, Scanner, normal_words


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    keep = lambda c: ord(c) >= 0x80 or c.isascii() and (c.isdigit() or "a" <= c <= "z")
    return [w for w in "".join(c if keep(c) else " " for c in low).split(" ") if w]


def base_of(text):
    words = words_of(text)
    found = []
    for n in NOTICES:
        if n.base:
            phrase = n.text.split()
            found += [(i, n.label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    places = [i for i, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(places, default=None), max(places, default=None), labels


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def least_edits(notice, text):
    """Fewest edits of any span of whole words in which the braced words stand unchanged."""
    words, (before, fixed, after) = words_of(text), notice.wording.replace("}", "{").split("{")
    fixed = " " * bool(before) + fixed + " " * bool(after)
    before, after = before.strip(), after.strip()
    best = None
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + len(notice.text.split()) + 3) + 1):
            span = " ".join(words[i:j])
            at = span.find(fixed)
            while at >= 0:
                left, right = span[:at], span[at + len(fixed) :]
                # Nothing may stand beyond a braced word that opens or closes the notice.
                if (before or not left) and (after or not right):
                    cost = distance(before, left) + distance(after, right)
                    best = cost if best is None else min(best, cost)
                at = span.find(fixed, at + 1)
    return best


ODD = [
    (1, None), (2, ""), (3, " \n.,!"), (4, "Under the MIT License"), (5, "under the mit license " * 3),
    (6, "UNDER-THE_MIT/license; Apache License, Version 2.0. CC BY-NC 4.0 ©"), (7, "sunder the mit licenses"),
    (8, "İ ünder the mit license é"), (9, "cc by ncc by nc"), (10, "cc by cc by nc by nc"), (11, "x\x00under\x7fthe mit license"),
    (12, "undr teh MIT licence"), (13, "under the mpl license"), (None, "apache license version 2"), (4, "Under the MIT License"),
    (14, "apache license\n\nversion 2 and, released under the mit\u00a0license"),
]


def test_base_columns_equal_word_by_word_search(spark):
    rng = random.Random(1)
    vocabulary = "under the mit license apache version 2 cc by nc é x".split()
    rows = ODD + [
        (100 + k, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "-", "\n", ". "]) for _ in range(rng.randrange(60))))
        for k in range(300)
    ]
    rows.append((500, "filler words " * 300_000 + "Released under the MIT License." + " tail" * 1000))
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n_words int, labels string")
    got = [
        (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        for r in licenses.scan_documents(docs).collect()
    ]
    assert sorted(got, key=str) == sorted(((i, *base_of(t)) for i, t in rows), key=str)
    for r in licenses.scan_documents(docs).collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0.0 <= r["score"] <= 1.0 and (r["score"] > 0) == bool(r["labels"]) and (r["n_base"] == 0 or r["score"] == 1.0)


@pytest.mark.parametrize("notice", [n for n in NOTICES if n.wording.count("{") == 1 and n.edits], ids=lambda n: n.wording)
def test_edited_notices_are_found_as_by_edit_distance(notice):
    scanner, rng, hits = Scanner([notice]), random.Random(notice.wording), 0
    letters = "abcdeilnrst 2"
    for _ in range(120):
        text = list(notice.text)
        for _ in range(rng.randrange(notice.edits + 3)):
            at, kind = rng.randrange(len(text)), rng.randrange(3)
            if kind == 0:
                text.insert(at, rng.choice(letters))
            elif kind == 1:
                text[at] = rng.choice(letters)
            else:
                del text[at]
        whole = f"some words {''.join(text)} and more"
        best = least_edits(notice, whole)
        spans = scanner.find(normal_words(whole.encode())[0])
        found = min((s.edits for s in spans), default=None)
        assert found == (best if best is not None and best <= notice.edits else None), whole
        hits += found is not None
    assert hits > 20


def test_spans_give_places_and_words(spark):
    docs = spark.createDataFrame([(1, "A b. Released undr the MIT licence, all rights reserved"), (2, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in licenses.spans_of(docs).collect()), key=lambda r: r[2])
    assert rows == [(1, "mit", 3, 4, 2, "undr the mit licence"), (1, "reserved", 7, 3, 0, "all rights reserved")]


def test_marks_that_tell_licences_apart_must_stand():
    scanner = Scanner()
    labels = lambda t: {scanner.notices[s.notice].label for s in scanner.find(normal_words(t.encode())[0])}
    assert labels("under the mpl license") == set()
    assert labels("gnu lesser general public licence") == {"lgpl"}
    assert labels("GNU General Public License, version 3") == {"gpl"}
    assert labels("Apache License, Version 3") == set()


def test_many_places_in_one_text_take_linear_work():
    spans = Scanner().find(normal_words(b"under the mit license undr the mit license " * 5000)[0])
    assert sum(s.edits == 0 for s in spans) == 5000 and sum(s.edits == 1 for s in spans) == 5000


def test_notices_that_leave_no_seed_are_refused():
    with pytest.raises(ValueError, match="leaves no seed"):
        Scanner([Notice("x", "abc", 3)])
    with pytest.raises(ValueError, match="lower-case words"):
        Scanner([Notice("x", "A license", 1)])


def test_no_documents(spark):
    assert licenses.scan_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
