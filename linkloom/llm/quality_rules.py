"""Quality rules: base counts of a text, and cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space trimmed and collapsed) and
travel as their XXH64; within a document lines and windows of words are
compared by their bytes.  For every host -- the documents' ``source`` -- the distinct documents
that hold a line are counted, exact copies of a text counting once.  A line
that stands in at least ``min_docs`` documents and in at least ``share`` of
all documents of its host is boilerplate; a document is depleted, and
rejected, when without its boilerplate lines fewer than ``min_words`` words or
less than ``min_left`` of its words are left.

One pass over the texts writes a narrow table (counts, line hashes, words per
line) to the shared checkpoint folder; counting and verdicts use that table
alone.  A line that a third of all documents hold is pre-aggregated before
every shuffle, and the lines of a document meet only the (few) boilerplate
lines of its host.

Cases: a null or empty text has no words and fails the base rules; a null
source is a host of its own; repeated rows are reported one by one and count
as one document; equal counts need no tie-break; an empty table gives an empty
report; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.columns import spare
from linkloom.llm.textblocks import NONSPACE, Block, Words, blocks, mix64, span_codes, spans_index, spans_of
from linkloom.session import materialize

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
LINE_MIN_DOCS, LINE_SHARE = 20, 0.1
MIN_LEFT = 0.3

_SYMBOL = bytes(b in b"#*$%&|<>" for b in range(256))
_NOT_NEWLINE = bytes(b != 0x0A for b in range(256))
_STARTS_CHAR = bytes(b & 0xC0 != 0x80 for b in range(256))

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TABLE = "doc_id bigint, source string, text_key bigint, " + ", ".join(f"{c} bigint" for c in STATS) + ", lines array<bigint>, line_words array<int>"


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _stood_earlier(keys: np.ndarray) -> np.ndarray:
    """Whether the same key has stood at an earlier position."""
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return later


def repeated_windows(codes: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each place in ``at`` stand in the same document once more.  Hashes only order the windows;
    neighbours are compared word by word, and where different windows share a hash all are ordered by their words."""
    def same_as_before(order):
        a, b = at[order[1:]], at[order[:-1]]
        same = doc[a] == doc[b]
        for i in range(n):
            same &= codes[a + i] == codes[b + i]
        return same

    h = doc[at].astype(np.uint64)
    for i in range(n):
        h = mix64(h + codes[at + i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    same = same_as_before(order)
    if (same != (h[order][1:] == h[order][:-1])).any():
        order = np.lexsort((*(codes[at + i] for i in range(n)), doc[at]))
        same = same_as_before(order)
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def line_hashes(lower: np.ndarray, words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XXH64 of each line's words in lower case with one space between them."""
    size = words.ends - words.starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(int(to[-1]), 0x20, dtype=np.uint8)
    joined[np.repeat(to[:-1] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = lower[spans_index(words.starts, size)]
    text = joined.tobytes()
    return np.array([xxhash.xxh64_intdigest(text[a:b]) for a, b in zip(to[first].tolist(), (to[last] - 1).tolist(), strict=True)], dtype=np.uint64).view(np.int64)


def block_stats(b: Block) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Base counts of each document, and the hashes and word counts of its normalised lines."""
    raw = b.data.tobytes()
    flags = lambda table: np.frombuffer(raw.translate(table), dtype=bool)
    words = b.words(b.data, NONSPACE)
    at = words.window_starts(REPEAT_WINDOW)
    twice = repeated_windows(span_codes(b.data, words.starts, words.ends), words.doc, at, REPEAT_WINDOW)
    cover = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
    repeat = _per_doc(np.cumsum(cover[:-1]) > 0, words.first)

    starts, ends = spans_of(flags(_NOT_NEWLINE), b.offsets)  # empty lines have no word and are left out
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    filled = last > first
    starts, ends, first, last = starts[filled], ends[filled], first[filled], last[filled]
    line_doc = np.searchsorted(b.offsets, starts, side="right") - 1
    exact = span_codes(b.data, starts, ends)
    earlier = _stood_earlier(line_doc * (len(exact) + 1) + exact)
    lines = line_hashes(b.lower, words, first, last)
    cuts = np.searchsorted(line_doc, np.arange(1, len(b)))
    stats = {"n_words": words.counts, "word_chars": _per_doc(flags(NONSPACE) & flags(_STARTS_CHAR), b.offsets),
             "n_symbols": _per_doc(flags(_SYMBOL), b.offsets),
             "n_dup_lines": np.bincount(line_doc[earlier], minlength=len(b)), "n_repeat_words": repeat}
    return stats, np.split(lines, cuts), np.split((last - first).astype(np.int32), cuts)


def _ragged(parts: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def _measure(batches):
    for batch in batches:
        ids, source, text, key = (batch.column(i) for i in range(4))
        for b in blocks(text):
            stats, lines, counts = block_stats(b)
            part = slice(b.first, b.first + len(b))
            yield pa.RecordBatch.from_arrays(
                [ids[part], source[part], key[part], *(pa.array(stats[c].astype(np.int64)) for c in STATS),
                 _ragged(lines, pa.int64()), _ragged(counts, pa.int32())],
                ["doc_id", "source", "text_key", *STATS, "lines", "line_words"])


def boilerplate_lines(table: DataFrame, min_docs: int = LINE_MIN_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """(source, line) of the lines that stand in too many distinct documents of their host."""
    hosts = table.select("source", "text_key").distinct().groupBy("source").agg(F.count("*").alias("host_docs"))
    held = table.select("source", "text_key", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    often = held.groupBy("source", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return (often.alias("o").join(hosts.alias("h"), F.col("o.source").eqNullSafe(F.col("h.source")))
            .filter(F.col("n_docs") >= share * F.col("host_docs")).select("o.source", "line", "n_docs"))


def quality_rules(docs: DataFrame, min_docs: int = LINE_MIN_DOCS, share: float = LINE_SHARE,
                  min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: base counts, base_failed, kept, words_left, lines_removed and (source, text_key)."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source"), F.col("text"), F.xxhash64("text").alias("text_key"))
    # the row ids are read back from the written table, so they stay the same whatever is run again later
    table = materialize(narrow.mapInArrow(_measure, TABLE).withColumn("row", F.monotonically_increasing_id()), "quality-lines")
    frequent = boilerplate_lines(table, min_docs, share)
    lines = table.select("row", "source", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", "source", F.col("l.lines").alias("line"), F.col("l.line_words").alias("w"))
    removed = (lines.alias("l").join(frequent.alias("f"), (F.col("l.line") == F.col("f.line")) & F.col("l.source").eqNullSafe(F.col("f.source")))
               .groupBy("row").agg(F.sum("w").alias("removed_words"), F.count("*").alias("lines_removed")))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("removed_words").isNotNull() & ((left < min_words) | (left < min_left * F.col("n_words")))
    return table.join(removed, "row", "left").select(
        "doc_id", *STATS, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        left.alias("words_left"), F.coalesce("lines_removed", F.lit(0)).alias("lines_removed"), "source", "text_key")


def filter_documents(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    bad = quality_rules(docs, **limits).filter("NOT kept").select("doc_id", "source", "text_key").distinct().alias("b")
    (key,) = spare(docs, "__key")
    d = docs.withColumn(key, F.xxhash64("text")).alias("d")
    same = (F.col(f"d.{key}") == F.col("b.text_key")) & F.col("d.source").eqNullSafe(F.col("b.source")) \
        & F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("b.doc_id"))
    return d.join(bad, same, "left_anti").drop(key)
