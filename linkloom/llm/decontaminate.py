"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Each benchmark item gives its windows of ``n`` consecutive words (an item of
fewer words, but not none, is one window).  The sorted window hashes are
broadcast, every document's word windows are looked up in them by binary
search, and each hit is verified word by word before it counts.

The broadcast is bounded: benchmark items are dealt into groups of at most
``GROUP_BYTES`` of text by their running size, and the documents pass through
one scan per group.  A scan carries what earlier scans have found along in a
column, so more benchmark text means more passes, never a larger broadcast
and never a shuffle of documents.

Cases: a null or empty text has no words and is not contaminated; a null or
empty benchmark text has no windows; an empty benchmark contaminates nothing;
items with a null id count as hits but cannot be listed; repeated rows are
judged one by one, each item id counts once; extra columns are ignored by
``contamination`` and kept unread by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.columns import spare
from linkloom.llm.textblocks import ALNUM, Block, Words, blocks

N_WORDS = 13
#: Bytes of benchmark text in one broadcast; its windows take about fifty times that in a worker's memory.
GROUP_BYTES = 2 << 20
#: A document is contaminated when at least one of so many of its words is hit.
WORDS_PER_HIT = 20

REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, " \
         "spans array<struct<first_word:int,n_words:int>>"


class WindowSet:
    """Hashed windows of some benchmark items, by window length."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int = N_WORDS):
        found: dict[int, dict[bytes, set]] = {}
        hashes: dict[int, dict[bytes, int]] = {}
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            b = Block(0, raw, np.array([0, len(raw)]))
            w = b.words(b.lower, ALNUM)
            size = min(n, len(w.starts))
            if not size:
                continue
            at, h = w.windows(size)
            for i, x in zip(at, h, strict=True):
                key = w.joined(i, size)
                found.setdefault(size, {}).setdefault(key, set()).add(item_id)
                hashes.setdefault(size, {})[key] = int(x)
        self.by_size = {}
        for size, windows in found.items():
            keys = sorted(windows, key=lambda k: hashes[size][k])
            self.by_size[size] = (np.array([hashes[size][k] for k in keys], dtype=np.uint64), keys, [windows[k] for k in keys])

    def search(self, words: Words) -> Iterator[tuple[int, int, set]]:
        """(first word, words, item ids) of every verified occurrence."""
        for size, (hashes, keys, ids) in self.by_size.items():
            at, h = words.windows(size)
            lo = np.searchsorted(hashes, h)
            hit = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == h)
            for j in hit:
                i, k = int(at[j]), int(lo[j])
                text = words.joined(i, size)
                while k < len(hashes) and hashes[k] == h[j]:
                    if keys[k] == text:
                        yield i, size, ids[k]
                    k += 1


def _groups(benchmark: DataFrame, n: int, group_bytes: int) -> list:
    """Broadcasts of the benchmark's windows, each of at most group_bytes of text (or of one longer item)."""
    spark = benchmark.sparkSession
    items, size, out = [], 0, []
    distinct = benchmark.select(F.col("item_id"), F.col("text")).filter("text IS NOT NULL").distinct()
    for item_id, text in distinct.toLocalIterator():
        grown = size + 4 * len(text)
        if items and grown > group_bytes:
            out.append(spark.sparkContext.broadcast(WindowSet(items, n)))
            items, grown = [], 4 * len(text)
        items.append((item_id, text))
        size = grown
    return [*out, spark.sparkContext.broadcast(WindowSet(items, n))]


def _scan(words: Words, windows: WindowSet, n_docs: int) -> list[tuple[list, set]]:
    """For each document its hit windows (first word within the document, words) and item ids."""
    out: list[tuple[list, set]] = [([], set()) for _ in range(n_docs)]
    for i, size, ids in windows.search(words):
        d = int(words.doc[i])
        out[d][0].append((i - int(words.first[d]), size))
        out[d][1].update(ids)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the windows."""
    out: list[list[int]] = []
    for a, size in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + size)
        else:
            out.append([a, a + size])
    return [(a, b - a) for a, b in out]


def _report(doc_id, n_words: int, spans: list, ids: set) -> dict:
    spans = _merged(spans)
    hit = sum(b for _, b in spans)
    named = sorted(str(x) for x in ids if x is not None)
    return {"doc_id": doc_id, "n_words": n_words, "n_hit": hit, "n_items": len(named),
            "items_sha256": hashlib.sha256(",".join(named).encode()).hexdigest(),
            "contaminated": hit > 0 and WORDS_PER_HIT * hit >= n_words,
            "spans": [{"first_word": a, "n_words": b} for a, b in spans]}


def _scanner(group, so_far: bool, last: bool, keep: bool, beside: str):
    """A mapInArrow function: look one group's windows up; the last one reports or filters."""

    def run(batches):
        windows = group.value
        for batch in batches:
            found, n_words = [], []
            for b in blocks(batch.column(batch.schema.get_field_index("text"))):
                w = b.words(b.lower, ALNUM)
                found += _scan(w, windows, len(b))
                n_words += w.counts.tolist()
            if so_far:
                for (spans, ids), was in zip(found, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    if was:
                        spans += [(x["a"], x["n"]) for x in was["spans"]]
                        ids.update(was["ids"])
            if not last:
                carried = pa.array([{"spans": [{"a": a, "n": n} for a, n in _merged(s)], "ids": list(i)} for s, i in found],
                                   pa.struct([("spans", pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())]))), ("ids", pa.list_(pa.int64()))]))
                columns = batch.columns[:batch.num_columns - so_far]
                names = batch.schema.names[:len(columns)]
                yield pa.RecordBatch.from_arrays([*columns, carried], [*names, beside])
                continue
            if keep:
                good = [not _report(None, n, s, i)["contaminated"] for n, (s, i) in zip(n_words, found, strict=True)]
                width = batch.num_columns - so_far
                yield batch.select(list(range(width))).filter(pa.array(good, pa.bool_()))
                continue
            rows = [_report(d, n, s, i) for d, n, (s, i) in zip(batch.column(0).to_pylist(), n_words, found, strict=True)]
            span = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                                                              ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", span)]))

    return run


def _through(docs: DataFrame, benchmark: DataFrame, keep: bool, n: int, group_bytes: int) -> DataFrame:
    groups = _groups(benchmark, n, group_bytes)
    schema = docs.schema
    span = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("n", T.IntegerType())])
    found = T.StructType([T.StructField("spans", T.ArrayType(span)), T.StructField("ids", T.ArrayType(T.LongType()))])
    (beside,) = spare(docs, "__found")
    carried = T.StructType([*schema.fields, T.StructField(beside, found)])
    for k, g in enumerate(groups):
        last = k == len(groups) - 1
        docs = docs.mapInArrow(_scanner(g, k > 0, last, keep, beside), (schema if keep else REPORT) if last else carried)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: counts, the items found, the verdict and the hit word spans."""
    return _through(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")), benchmark, False, n, group_bytes)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return _through(docs, benchmark, True, n, group_bytes)
