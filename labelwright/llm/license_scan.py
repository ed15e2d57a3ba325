"""Licence scan: pigeonhole-split exact seeds find candidate places of short notices, bounded-error regexes verify them.

A notice with an error budget of k is cut into k + 1 pieces; a place within k edits holds one piece unchanged, so one
pass of an Aho-Corasick automaton over all pieces finds every candidate. Only those windows meet the fuzzy regex.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship
from .decontaminate import ends, merged

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices, as lower-case words, and their labels.
NOTICES = {
    "this work is licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "reserved",
}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,errors:int>>"

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lowered (bytes.lower leaves other letters alone), then the runs of digits, a-z and non-ASCII."""
    return text.lower().translate(_TO_SPACE).split()


def cut(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 nearly equal pieces and where each begins."""
    at = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Scanner:
    """The automaton over the pieces of all notices, and a fuzzy regex for each."""

    def __init__(self, notices: dict[str, str], error_rate: float, min_piece: int):
        import ahocorasick
        import regex

        self.notices = [(n, label, max(1, min(int(error_rate * len(n)), len(n) // min_piece - 1))) for n, label in notices.items()]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for at, piece in cut(n, k):
                found.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self.verify = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={k}}}").fullmatch for n, _, k in self.notices]

    def windows(self, norm: str) -> dict[int, list[list[int]]]:
        """Merged candidate windows of each notice."""
        out: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.seeds.iter(norm):
            for i, at in uses:
                n, _, k = self.notices[i]
                a = max(0, end + 1 - size - at - k)
                b = a + len(n) + 2 * k
                out.setdefault(i, []).append((a, b))
        return {i: merged(spans) for i, spans in out.items()}

    def matches(self, norm: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, errors, notice length) of every verified place, without overlaps within a notice.

        A place begins and ends with whole words. One pass of the distance over a window gives the ends that are worth
        the regex, which then matches stretches between words there, each as a whole; exact places need none. So the time
        grows with the text alone, and the errors are the least edits between stretch and notice.
        """
        out = []
        for i, spans in self.windows(norm).items():
            n, label, k = self.notices[i]
            for a, b in spans:
                done = a
                for end, edits in ends(n, norm, a, min(b, len(norm)), k):
                    if not edits and end - len(n) >= done and norm[end - len(n) - 1] == norm[end] == " ":
                        out.append((label, end - len(n), end, 0, len(n)))
                        done = end
                    elif end > done and (best := self.best(i, norm, done, end)):
                        errors, start, done = best
                        out.append((label, start, done, errors, len(n)))
        return out

    def best(self, i: int, norm: str, low: int, end: int) -> tuple[int, int, int] | None:
        """(errors, start, end) of the notice's best place of whole words that ends near there and begins at ``low`` or later."""
        n, _, k = self.notices[i]
        gaps = [p for p in range(max(0, low - 1, end - len(n) - 2 * k - 1), min(len(norm), end + k + 1)) if norm[p] == " "]
        found = []
        for b in (p for p in gaps if p >= end - k):
            for a in (p + 1 for p in gaps if p + 1 >= low and abs(b - p - 1 - len(n)) <= k):
                if m := self.verify[i](norm, a, b):
                    found.append((sum(m.fuzzy_counts), a, b))
        return min(found, default=None)


@functools.lru_cache(4)
def scanner(notices: tuple[tuple[str, str], ...], error_rate: float, min_piece: int) -> Scanner:
    return Scanner(dict(notices), error_rate, min_piece)


def places(norm: str, phrase: str) -> list[int]:
    """Where the phrase's words begin in a text of words with a space on either side."""
    out, at, needle = [], -1, f" {phrase} "
    while (at := norm.find(needle, at + 1)) >= 0:
        out.append(at + 1)
    return out


def scan_text(text: bytes | None, scan: Scanner) -> tuple:
    words = words_of(text or b"")
    norm = f" {b' '.join(words).decode('latin-1')} "
    base = [(at, label) for phrase, label in PHRASES.items() for at in places(norm, phrase)]
    fuzzy = sorted(scan.matches(norm), key=lambda x: x[1:3])
    firsts, spans = [], []
    if base or fuzzy:
        spaces = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), dtype=np.uint8) == 0x20)
        word = lambda at: np.searchsorted(spaces, at) - 1
        firsts = word([at for at, _ in base])
        for (label, _, _, e, _), a, b in zip(fuzzy, word([x[1] for x in fuzzy]).tolist(), word([x[2] for x in fuzzy]).tolist(), strict=True):
            spans.append({"label": label, "first_word": a, "n_words": b - a + 1, "errors": e})
    base_labels = sorted({x for _, x in base})
    score = max([1.0 if base else 0.0, *(1 - e / n for *_, e, n in fuzzy)])
    low, high = (int(firsts.min()), int(firsts.max())) if base else (None, None)
    return len(words), len(base), low, high, ",".join(base_labels), ",".join(sorted({*base_labels, *(x[0] for x in fuzzy)})), score, spans


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES, error_rate: float = 0.12, min_piece: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: words, exact phrase places, labels of phrases and verified notices, score, spans of the notices.

    A null or empty text has no words, no labels, score 0. The score is 1 for an exact phrase, else 1 - errors / length
    of the best notice. A notice begins and ends with whole words; places of one notice do not overlap, and of
    overlapping ones the first that ends wins; different notices may overlap. Whole texts are scanned, in time that grows
    with their length; null ids stay null; repeated rows give repeated results; extra columns are ignored, whatever their
    names; an empty table gives no rows. No row meets another: there is no shuffle.
    """
    ship(docs.sparkSession)
    #: A notice of n characters may differ by error_rate * n edits, one at least; a min_piece over 1 / error_rate lowers that to n / min_piece - 1.
    fixed = tuple(notices.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(fixed, error_rate, min_piece)
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32())]))]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(k, *scan_text(t, scan)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text")).mapInArrow(run, SCHEMA)
