"""License scans: exact base phrases, and fuzzy search for short notices.

Texts are brought to lower-case words with one space between them.  A notice
that may differ by ``e`` edits is cut into ``e + 1`` pieces, one of which must
stand in the text unchanged (pigeonhole).  One Aho-Corasick pass finds all
pieces of all notices; around each, a window no longer than the notice and its
edits goes to the regex library's bounded-error matching, which verifies the
edits and gives the span.  Where verified notices overlap, the one with the
fewest edits (then the longer) is reported.

Cases: a null or empty text has no words, no places, empty labels and score 0;
very long texts are searched whole; repeated rows are searched one by one; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.textblocks import ALNUM, utf8

#: Words that must stand consecutively -> label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices, as normalised words -> label.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: One edit is allowed for so many characters of a notice, and at most MAX_EDITS.
CHARS_PER_EDIT, MAX_EDITS = 12, 4

_SPACED = bytes(b if keep else 0x20 for b, keep in enumerate(ALNUM))
SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))])
REPORT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, " \
         "spans array<struct<label:string,first_word:bigint,n_words:bigint,edits:int>>"


def edits_allowed(notice: str) -> int:
    return min(MAX_EDITS, len(notice) // CHARS_PER_EDIT)


class Finder:
    """Fuzzy search for a set of notices."""

    def __init__(self, notices: tuple[tuple[str, str], ...]):
        self.notices = [(text, label, edits_allowed(text)) for text, label in notices]
        # by the number of edits, so that the first that matches has the fewest
        self.patterns = [[regex.compile(f"(?e)(?:{regex.escape(text)}){{e<={n}}}") for n in range(e + 1)] for text, _, e in self.notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _, e) in enumerate(self.notices):
            cuts = [len(text) * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    @lru_cache(1 << 14)  # noqa: B019 - a finder lives as long as its process
    def verified(self, k: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of the notice in a window; a notice that stands again and again is verified once."""
        m = next((m for p in self.patterns[k] if (m := p.search(window))), None)
        return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, notice) of the reported places, in order; text is normalised."""
        found: dict[tuple[int, int, int], int] = {}
        tried = set()
        for last, (size, uses) in self.seeds.iter(text):
            for k, offset in uses:
                notice, _, e = self.notices[k]
                at = last + 1 - size - offset
                if (k, at) in tried:
                    continue
                tried.add((k, at))
                lo, hi = max(0, at - e), min(len(text), at + len(notice) + e)
                span = self.verified(k, text[lo:hi])
                if span:
                    found[lo + span[0], lo + span[1], k] = span[2]
        taken: list[tuple[int, int, int, int]] = []
        best = sorted((edits, a - b, a, b, k) for (a, b, k), edits in found.items())
        free = _Free()
        for edits, _, a, b, k in best:
            if free.take(a, b):
                taken.append((a, b, edits, k))
        return sorted(taken)


class _Free:
    """Intervals of a line that nothing has taken yet."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, a: int, b: int) -> bool:
        from bisect import bisect_left

        i = bisect_left(self.starts, a)
        if i and self.ends[i - 1] > a or i < len(self.starts) and self.starts[i] < b:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


@lru_cache(8)
def finder(notices: tuple[tuple[str, str], ...]) -> Finder:
    return Finder(notices)


def normalised(raw: bytes) -> str:
    return b" ".join(raw.lower().translate(_SPACED).split()).decode()


def scan_text(text: str, base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> dict:
    """What a normalised text holds."""
    padded, places, base_labels = f" {text} ", [], set()
    for phrase, label in base:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            places.append(at)
            base_labels.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    found = finder(notices).search(text)
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 0x20) if places or found else None
    words_before = lambda i: int(np.searchsorted(blanks, i))
    spans, score = [], 1.0 if places else 0.0
    for a, b, edits, k in found:
        first = words_before(a + (text[a] == " "))
        spans.append({"label": notices[k][1], "first_word": first, "n_words": words_before(b - (text[b - 1] == " ")) - first + 1, "edits": edits})
        score = max(score, 1 - edits / len(notices[k][0]))
    starts = [words_before(p) for p in (min(places), max(places))] if places else [None, None]
    return {"n_words": text.count(" ") + 1 if text else 0, "n_base": len(places), "first_word": starts[0], "last_word": starts[1],
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {s["label"] for s in spans})), "score": score, "spans": spans}


def scan_batch(batch: pa.RecordBatch, base: tuple, notices: tuple) -> pa.RecordBatch:
    data, offsets = utf8(batch.column(1))
    rows = [{"doc_id": d} | scan_text(normalised(data[a:b].tobytes()), base, notices)
            for d, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True)]
    return pa.RecordBatch.from_pylist(rows, SCHEMA)


def license_scan(docs: DataFrame, notices: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row per document: word count, base places, labels, score and the spans of the notices found."""
    notices = tuple((NOTICES if notices is None else notices).items())
    base = tuple((BASE if base is None else base).items())

    def run(batches):
        for batch in batches:
            yield scan_batch(batch, base, notices)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, REPORT)
