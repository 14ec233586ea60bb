"""Fuzzy search for short licence notices.

A notice with up to k edits is cut into k + 1 seeds, one of which must stand in the
text unchanged. One automaton finds all seeds of all notices; around each hit the
regex library's bounded-error matching verifies the notice and counts its edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import raw_texts

# Bytes that belong to no word become blanks, A-Z become a-z; bytes of characters
# beyond ASCII stay.
_PLAIN = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


@dataclass(frozen=True)
class Notice:
    """Words of a notice, with those that tell it from others in braces.

    Words in braces must stand as whole words, unchanged; the rest may differ by
    `edits` characters in all (inserted, deleted or replaced). `base` notices
    without an edit are the fixed phrases every scan counts.
    """

    label: str
    wording: str
    edits: int
    base: bool = False

    @property
    def text(self) -> str:
        return self.wording.replace("{", "").replace("}", "")

    @cached_property
    def seeds(self) -> list[tuple[int, str]]:
        """(offset, piece): `edits` + 1 pieces of nearly equal length."""
        text, parts = self.text, self.edits + 1
        cuts = [len(text) * i // parts for i in range(parts + 1)]
        return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    @cached_property
    def pattern(self):
        """The notice as whole words with at most `edits` errors in each loose part.

        The parts share one bound, which the caller holds against their sum; the
        best match has the smallest sum.
        """
        loose = lambda s: f"(?:{regex.escape(s, literal_spaces=True)}){{e<={self.edits}}}" if s else ""
        # Blanks beside a brace belong to the words inside: these are whole words.
        parts = re.split(r"( ?\{.*?\} ?)", self.wording)
        body = "".join(
            regex.escape(re.sub("[{}]", "", p), literal_spaces=True) if i % 2 else loose(p)
            for i, p in enumerate(parts)
        )
        return regex.compile(f"(?b) (?:{body}) ")


#: The phrases of the contract, then notices of the scan's own.
NOTICES: tuple[Notice, ...] = (
    Notice("mit", "under the {mit} license", 2, base=True),
    Notice("apache-2", "{apache} license version {2}", 2, base=True),
    Notice("cc-by-nc", "{cc by nc}", 0, base=True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("cc-by-sa", "{cc by sa}", 0),
    Notice("cc-by-nc", "creative commons attribution {noncommercial}", 3),
    Notice("cc-by-sa", "creative commons attribution {sharealike}", 3),
    Notice("gpl", "gnu {general} public license", 2),
    Notice("lgpl", "gnu {lesser} general public license", 2),
    Notice("agpl", "gnu {affero} general public license", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd", "under the {bsd} license", 2),
    Notice("isc", "under the {isc} license", 2),
    Notice("mpl", "{mozilla} public license", 1),
    Notice("epl", "{eclipse} public license", 1),
    Notice("public-domain", "released into the public domain", 2),
    Notice("reserved", "all {rights} reserved", 1),
)


@dataclass(frozen=True)
class Span:
    """A verified place: word positions from 0, and the words themselves."""

    notice: int
    first_word: int
    words: int
    edits: int
    text: str


class Scanner:
    """Finds all notices in one pass over a text, in memory linear in the text."""

    def __init__(self, notices: Sequence[Notice] = NOTICES):
        for n in notices:
            if not n.text or n.text != " ".join(normal_words(n.text.encode())[0].split()):
                raise ValueError(f"a notice is lower-case words with single blanks: {n.wording!r}")
            if len(n.text) <= n.edits:
                raise ValueError(f"{n.wording!r} leaves no seed at {n.edits} edits")
        self.notices = list(notices)
        uses: dict[str, list[tuple[int, int, bool]]] = {}
        for i, n in enumerate(self.notices):
            for k, (offset, piece) in enumerate(n.seeds):
                uses.setdefault(piece, []).append((i, offset, k == 0))
        self.automaton = ahocorasick.Automaton()
        for piece, wants in uses.items():
            self.automaton.add_word(piece, (len(piece), wants))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[Span]:
        """Spans in a text of `normal_words`, in order of place.

        Unedited places are all reported, also where they overlap. Edited ones that
        overlap a place of the same notice with fewer edits are the same notice
        read worse, and left out.
        """
        exact: list[tuple[int, int]] = []
        near: dict[int, list[tuple[int, int]]] = {}
        for last, (length, wants) in self.automaton.iter(text):
            begin = last - length + 1
            for i, offset, leads in wants:
                notice, start = self.notices[i], begin - offset
                whole = notice.text
                if start > 0 and text.startswith(whole, start) and text[start - 1] == " " == text[start + len(whole)]:
                    if leads:
                        exact.append((i, start))
                elif notice.edits:
                    low = max(0, start - notice.edits - 1)
                    high = min(len(text), start + len(whole) + notice.edits + 1)
                    near.setdefault(i, []).append((low, high))
        found = [(i, s, s + len(self.notices[i].text), 0) for i, s in exact]
        for i, windows in near.items():
            found += self._edited(i, text, windows, [(s, e) for j, s, e, _ in found if j == i])
        found.sort(key=lambda f: (f[1], f[2], f[0]))
        spans, words, at = [], 0, 1
        for i, start, end, edits in found:
            words += text.count(" ", at, start)
            at = start
            spans.append(Span(i, words, text.count(" ", start, end) + 1, edits, text[start:end]))
        return spans

    def _edited(self, i: int, text: str, windows: list, exact: list) -> list[tuple[int, int, int, int]]:
        """Best verified match of each window that meets no unedited place."""
        notice, matches = self.notices[i], set()
        for low, high in sorted(set(windows)):
            hit = notice.pattern.search(text[low:high])
            if hit and sum(hit.fuzzy_counts) <= notice.edits:
                matches.add((sum(hit.fuzzy_counts), low + hit.start() + 1, low + hit.end() - 1))
        kept: list[tuple[int, int, int, int]] = []
        taken = _Taken(exact)
        for edits, start, end in sorted(matches):
            if taken.add(start, end):
                kept.append((i, start, end, edits))
        return kept


class _Taken:
    """Places already taken, by the cells of text they touch."""

    _CELL = 256

    def __init__(self, spans: list[tuple[int, int]]):
        self.cells: dict[int, list[tuple[int, int]]] = {}
        for start, end in spans:
            self._put(start, end)

    def _put(self, start: int, end: int) -> None:
        for cell in range(start // self._CELL, end // self._CELL + 1):
            self.cells.setdefault(cell, []).append((start, end))

    def add(self, start: int, end: int) -> bool:
        """Take a place unless it overlaps one taken before."""
        for cell in range(start // self._CELL, end // self._CELL + 1):
            if any(s < end and start < e for s, e in self.cells.get(cell, ())):
                return False
        self._put(start, end)
        return True


def normal_words(text: bytes | None) -> tuple[str, int]:
    """The words of a text, each between single blanks, and their number.

    Words are runs of digits, letters and characters beyond ASCII, A-Z
    lower-cased. A text without words gives one blank.
    """
    words = text.translate(_PLAIN).split() if text else []
    return f" {b' '.join(words).decode('utf-8', 'replace')} " if words else " ", len(words)


def spans_of(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """Every place of a notice: `doc_id, label, first_word, words, edits, exact, text`.

    `docs` needs `doc_id` and `text`; other columns are ignored. A null or empty
    text has no place, repeated rows report theirs each, an empty table gives none.
    """

    def scan(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(notices)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, raw_texts(batch), strict=True):
                spans = scanner.find(normal_words(text)[0])
                if spans:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc_id] * len(spans), batch.schema.field(0).type),
                            pa.array([notices[s.notice].label for s in spans]),
                            pa.array([s.first_word for s in spans], pa.int64()),
                            pa.array([s.words for s in spans], pa.int64()),
                            pa.array([s.edits for s in spans], pa.int32()),
                            pa.array([s.text for s in spans]),
                        ],
                        names=["doc_id", "label", "first_word", "words", "edits", "text"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, label string, first_word long, words long, edits int, text string"
    )


def summary(spans: Sequence[Span], notices: Sequence[Notice]) -> tuple:
    """Base places, their ends, base labels, all labels and the score of one text.

    The score is the share of its letters that the best span kept, so 1 for a
    notice without an edit and 0 for a text without a notice.
    """
    base = [s for s in spans if notices[s.notice].base and not s.edits]
    return (
        len(base),
        min((s.first_word for s in base), default=None),
        max((s.first_word for s in base), default=None),
        ",".join(sorted({notices[s.notice].label for s in base})),
        ",".join(sorted({notices[s.notice].label for s in spans})),
        max((1.0 - s.edits / len(notices[s.notice].text) for s in spans), default=0.0),
    )


def scan_documents(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """One row per document: `doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score`.

    One map over the texts, each read whole; nothing is shuffled, so copies and
    frequent words cost no more than their length. Base columns count the `base`
    notices without an edit; `labels` holds those and what the search with edits
    finds. A null or empty text has no words, no places, empty labels, null word
    positions and score 0. Repeated rows and rows with a null id are scanned each
    by itself; an empty table gives no rows; columns other than `doc_id` and
    `text` are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(notices)
        for batch in batches:
            rows = []
            for text in raw_texts(batch):
                words, count = normal_words(text)
                rows.append((count, *summary(scanner.find(words), scanner.notices)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double",
    )
