"""Suffix-array dedup: remove repeats of ``LENGTH`` bytes, all but those of the smallest doc_id.

A string of LENGTH bytes is dealt out by the smallest hash of its runs of
``RUN`` bytes (its minimizer), so all its copies meet in one bucket, and
neighbouring strings, which mostly share their minimizer, travel as one piece
of text.  A bucket is read as one or more shards of bounded bytes.  Each shard
gets a suffix array (Larsson-Sadakane refinement) and common prefixes (Kasai):
neighbours that share LENGTH bytes are one class of equal strings, owned by its
smallest doc_id.  Shards of a bucket are merged by binary search over their
sorted classes.  Strings of other documents in a class are removed.

What would pile up is thinned without loss before it travels or is sorted:
equal pieces of one block of documents are sent once, for the smallest doc_id
(the others are removed on the spot); equal pieces of one document -- a text of
one byte is nothing else -- are sent once, with the places where the others
stand as evenly spaced rows of places; a text longer than a block is cut piece by
piece of the block's size, strings across a cut belonging to the piece in which they start; pieces whose minimizer, with the bytes on
either side that a shared string would need, no other document of the bucket
has cannot match and are not sorted; of a bucket's equal pieces only those of the smallest
doc_id are sorted, the others are removed as they are.  Runs of bytes that very
many documents hold (counted on a sample of documents, which decides only where
strings go) don't become minimizers, so no bucket gathers them; strings that
have no other runs are dealt out one by one by their own hash.

Cases: null text is the empty text and stays as it is, as do texts shorter
than LENGTH; a null doc_id is neither smaller nor larger than another, so
those rows keep all bytes and take none from others; rows of equal doc_id
don't take from each other, and each is reported; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import suffix_array as sa
from linkloom.llm.sampling import few_rows
from linkloom.llm.textblocks import BYTE_CODE, BYTE_POWERS, Block, blocks, equal_codes, kgram_hashes, mix64, prefix_hashes, span_hashes

LENGTH, RUN = 50, 10
#: Text worked on at once when pieces are cut, text of a bucket, and text of a shard.
CUT_BYTES, BUCKET_BYTES, SHARD_BYTES = 3 << 20, 1 << 20, 2 << 20
#: Text of one long document worked on at once.
LONG_BYTES = 1 << 20
#: One document of so many is looked at for common runs of bytes; common is what so many documents would then hold.
SAMPLE_OF, COMMON_DOCS = 512, 100_000
#: Sampled text that pieces are compressed against, from so many documents at most.
DICTIONARY_BYTES, DICTIONARY_DOCS = 256 << 10, 256

#: Bytes of one interval on its way; longer ones are cut.
MAX_SPAN = 1 << 15
_WHOLE = 255  # in place of a minimizer's offset: the piece is one string, dealt out by its own hash
_U = np.uint64


def cut_pieces(b: Block, length: int = LENGTH, run: int = RUN, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one minimizer: first start, number of strings, minimizer's place, minimizer.
    Hashes in ``common`` come after all others."""
    n = len(b.data) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = kgram_hashes(b.data, run)
    # the place in the low bits makes the minimum unique: the leftmost of equal hashes
    m = h & _U(0xFFFFFFFF00000000)
    if common is not None and len(common):
        m[np.isin(h, common)] = _U(0xFFFFFFFF00000000)
    m |= np.arange(len(h), dtype=np.uint64)
    width, size = length - run + 1, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if width > size:
        m = np.minimum(m[:size - width], m[width - size:])
    place = (m & _U(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n, dtype=bool)
    opens = np.ones(n + 1, dtype=bool)
    opens[1:n] = place[1:] != place[:-1]
    sizes = np.diff(b.offsets)
    lo = b.offsets[:-1][sizes >= length]
    hi = b.offsets[1:][sizes >= length] - length + 1
    edge = np.zeros(n + 1, dtype=np.int8)
    edge[lo] += 1
    np.subtract.at(edge, hi, 1)
    valid = np.cumsum(edge[:n], dtype=np.int8) > 0
    opens[lo] = True
    opens[hi] = True
    at = np.flatnonzero(opens)
    count = np.diff(at)
    at = at[:-1]
    good = valid[at]
    at, count = at[good], count[good]
    return at, count, place[at], h[place[at]]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after the other."""
    shift = start - np.concatenate([[0], np.cumsum(size)[:-1]])
    return data[np.repeat(shift, size) + np.arange(int(size.sum()))] if len(start) else data[:0]


def _equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether span a[i] holds the same bytes as span b[i]."""
    same = np.ones(len(a), dtype=bool)
    for t in range(int(size.max()) if len(size) else 0):
        inside = size > t
        same[inside] &= data[a[inside] + t] == data[b[inside] + t]
    return same


class Packer:
    """A bucket's pieces of one block as bytes, and back.

    Numbers are stored as differences; they and the text are compressed apart,
    the text against a sample of the table's text, so small pieces of many
    blocks shrink as a long text would.
    """

    def __init__(self, sample: bytes):
        self.plain, self.undo_plain = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        if sample:
            known = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=5)
            self.text, self.undo_text = zstandard.ZstdCompressor(level=5, dict_data=known), zstandard.ZstdDecompressor(dict_data=known)
        else:
            self.text, self.undo_text = self.plain, self.undo_plain

    def pack(self, doc_id, tag, start, count, offset, text, rows: np.ndarray) -> bytes:
        delta = lambda x: np.diff(x, prepend=x.dtype.type(0))
        parts = [delta(doc_id.astype("<i8")), delta(tag.astype("<i8")), delta(start.astype("<i4")), count.astype("u1"), offset.astype("u1")]
        # byte by byte: the high bytes of small differences stand together
        planes = [np.ascontiguousarray(p.view(np.uint8).reshape(len(p), -1).T).tobytes() for p in parts]
        numbers = self.plain.compress(b"".join(planes))
        more = self.plain.compress(np.ascontiguousarray(rows.astype("<i8").T).tobytes()) if len(rows) else b""
        return np.array([len(start), len(numbers), len(rows), len(more)], "<u4").tobytes() + numbers + more + self.text.compress(text.tobytes())

    def unpack(self, blob: bytes) -> tuple[np.ndarray, ...]:
        """(doc_id, tag, start, count, offset, text, rows of further places: piece, first start, step, number)."""
        n, cut, n_rows, more = np.frombuffer(blob, "<u4", 4).tolist()
        raw, out, at = self.undo_plain.decompress(blob[16:16 + cut]), [], 0
        for kind in ("<i8", "<i8", "<i4", "u1", "u1"):
            width = np.dtype(kind).itemsize
            planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
            values = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
            out.append(values.astype(np.int64) if width == 1 else np.cumsum(values, dtype=np.int64))
            at += n * width
        rows = np.frombuffer(self.undo_plain.decompress(blob[16 + cut:16 + cut + more]), "<i8").reshape(4, n_rows).T if n_rows else np.empty((0, 4), np.int64)
        return *out, np.frombuffer(self.undo_text.decompress(blob[16 + cut + more:]), np.uint8), rows


@lru_cache(2)
def packer(sample: bytes) -> Packer:
    return Packer(sample)


def spaced_rows(piece: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(piece, first start, step, number): sorted places as evenly spaced rows, each place in one."""
    n = len(piece)
    if not n:
        return np.empty((0, 4), np.int64)
    opens = np.ones(n, dtype=bool)
    opens[1:] = piece[1:] != piece[:-1]
    step = np.zeros(n, dtype=np.int64)
    step[1:] = np.where(opens[1:], 0, start[1:] - start[:-1])
    opens[1:] |= (step[1:] != step[:-1]) & ~opens[:-1]  # a row's second place sets its step
    first = np.flatnonzero(opens)
    number = np.diff(np.append(first, n))
    return np.stack([piece[first], start[first], np.where(number > 1, step[np.minimum(first + 1, n - 1)], 0), number], axis=1)


def block_pieces(b: Block, doc_id: np.ndarray, tag: np.ndarray, known: np.ndarray, common: np.ndarray, n_buckets: int,
                 length: int = LENGTH, run: int = RUN, sample: bytes = b"", shift: int = 0) -> tuple[list[tuple[int, bytes]], tuple[np.ndarray, ...]]:
    """(bucket, packed pieces) of a block, and the intervals removed on the spot: doc_id, tag, start, end.
    ``shift``: where the block's text stands in its one document."""
    at, count, place, key = cut_pieces(b, length, run, common)
    doc = np.searchsorted(b.offsets, at, side="right") - 1
    use = known[doc]
    at, count, place, key, doc = at[use], count[use], place[use], key[use], doc[use]
    offset = place - at
    prefix = prefix_hashes(BYTE_CODE[b.data], BYTE_POWERS)
    often = np.isin(key, common)
    if often.any():  # strings that have only common runs go one by one
        one = _gather_starts(at[often], count[often])
        d = np.repeat(doc[often], count[often])
        at, count, doc = np.concatenate([at[~often], one]), np.concatenate([count[~often], np.ones(len(one), np.int64)]), np.concatenate([doc[~often], d])
        offset = np.concatenate([offset[~often], np.full(len(one), _WHOLE)])
        key = np.concatenate([key[~often], span_hashes(prefix, one, one + length, BYTE_POWERS)])
        order = np.argsort(at, kind="stable")
        at, count, doc, offset, key = at[order], count[order], doc[order], offset[order], key[order]
    size = count + length - 1
    # equal pieces: keep those of the smallest doc_id
    content = span_hashes(prefix, at, at + size, BYTE_POWERS)
    ids = doc_id[doc]
    order = np.lexsort((doc, ids, content))
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = content[order][1:] != content[order][:-1]
    first_of = lambda opens: order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))] if len(order) else order
    owner, twin_of = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    owner[order] = first_of(opens)
    copy = np.flatnonzero((ids > ids[owner]) & (size == size[owner]))
    copy = copy[_equal_spans(b.data, at[copy], at[owner[copy]], size[copy])]
    start = at - b.offsets[doc] + shift
    gone = merged_intervals(ids[copy], tag[doc[copy]], start[copy], start[copy] + size[copy])
    send = np.ones(len(at), dtype=bool)
    send[copy] = False
    # equal pieces of one document: the first is sent, with the places of the others
    opens[1:] |= doc[order][1:] != doc[order][:-1]
    twin_of[order] = first_of(opens)
    twin = np.flatnonzero(send & (twin_of != np.arange(len(at))) & send[twin_of] & (size == size[twin_of]))
    twin = twin[_equal_spans(b.data, at[twin], at[twin_of[twin]], size[twin])]
    send[twin] = False
    twin = twin[np.argsort(twin_of[twin], kind="stable")]
    rows = spaced_rows(twin_of[twin], start[twin])
    bucket = (mix64(key) % _U(n_buckets)).astype(np.int64)
    kept = np.flatnonzero(send)
    kept = kept[np.argsort(bucket[kept], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[kept], prepend=-1)) if len(kept) else kept
    out = []
    for part in np.split(kept, cuts[1:]) if len(kept) else []:
        text = _gather(b.data, at[part], size[part])
        mine = rows[np.isin(rows[:, 0], part)] if len(rows) else rows
        mine = np.column_stack([np.searchsorted(part, mine[:, 0]), mine[:, 1:]]) if len(mine) else mine
        out.append((int(bucket[part[0]]), packer(sample).pack(ids[part], tag[doc[part]], start[part], count[part], offset[part], text, mine)))
    return out, gone


def merged_intervals(ids: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same bytes of the same documents in as few intervals as there are, none longer than MAX_SPAN."""
    if not len(ids):
        return ids, tag, start, end
    order = np.lexsort((start, tag, ids))
    ids, tag, start, end = ids[order], tag[order], start[order], end[order]
    opens = np.ones(len(ids), dtype=bool)
    opens[1:] = (ids[1:] != ids[:-1]) | (tag[1:] != tag[:-1])
    # ends only grow within a document once each document is lifted above the one before
    lift = np.cumsum(opens) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    opens[1:] |= start[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(ids)) - 1
    ids, tag, start, end = ids[first], tag[first], start[first], reach[last] - lift[last]
    parts = -(-(end - start) // MAX_SPAN)
    if parts.max() > 1:
        ids, tag, end = (np.repeat(x, parts) for x in (ids, tag, end))
        start = np.repeat(start, parts) + MAX_SPAN * (np.arange(len(ids)) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.minimum(end, start + MAX_SPAN)
    return ids, tag, start, end


def _at_all_places(piece: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of the parts [a, b) of pieces, at their own start and in each row of further places."""
    out = [(piece, start[piece] + a, start[piece] + b)]
    if len(rows):
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        lo, hi = np.searchsorted(rows[:, 0], piece), np.searchsorted(rows[:, 0], piece, side="right")
        of = np.repeat(np.arange(len(piece)), hi - lo)
        p, first, step, number = rows[_gather_starts(lo, hi - lo)].T
        a, b = a[of], b[of]
        dense = step <= b - a  # neighbouring places leave nothing between them
        out.append((p[dense], first[dense] + a[dense], (first + (number - 1) * step + b)[dense]))
        p, first, step, number, a, b = (x[~dense] for x in (p, first, step, number, a, b))
        at = np.repeat(first, number) + np.repeat(step, number) * _gather_starts(np.zeros(len(number), np.int64), number)
        out.append((np.repeat(p, number), at + np.repeat(a, number), at + np.repeat(b, number)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _gather_starts(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(at - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))


def _may_match(ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether another doc_id has a piece of the same key."""
    order = np.argsort(key, kind="stable")
    opens = np.flatnonzero(np.diff(key[order], prepend=~key[order[0]])) if len(key) else order
    if not len(key):
        return np.zeros(0, dtype=bool)
    low, high = np.minimum.reduceat(ids[order], opens), np.maximum.reduceat(ids[order], opens)
    out = np.empty(len(key), dtype=bool)
    out[order] = np.repeat(low < high, np.diff(np.append(opens, len(key))))
    return out


def bucket_repeats(blobs: list[bytes], length: int = LENGTH, run: int = RUN, shard_bytes: int = SHARD_BYTES, sample: bytes = b"") -> tuple[np.ndarray, ...]:
    """Removed intervals of a bucket: doc_id, tag, start, end."""
    parts = [packer(sample).unpack(x) for x in blobs]
    lead = np.cumsum([0, *(len(p[0]) for p in parts)])
    rows = np.concatenate([p[6] + np.array([n, 0, 0, 0]) for p, n in zip(parts, lead, strict=False)])
    ids, tag, start, count, offset, text = (np.concatenate(p) for p in list(zip(*parts, strict=True))[:6])
    size, offset = count + length - 1, offset.astype(np.int64)
    at = np.cumsum(size) - size
    good = np.flatnonzero(_candidates(text, ids, at, size, offset, length, run))
    if not len(good):
        return (np.empty(0, np.int64),) * 4
    text, ids, tag, start, count, size, offset, rows = _only(good, text, ids, tag, start, count, size, offset, rows)
    # equal pieces: those of the smallest doc_id are sorted, the others are removed as they are
    copy = np.flatnonzero(_copies(text, ids, size))
    piece, lo, hi = _at_all_places(copy, start, np.zeros(len(copy), np.int64), size[copy], rows)
    out = [(ids[piece], tag[piece], lo, hi)]
    good = np.ones(len(ids), dtype=bool)
    good[copy] = False
    good = np.flatnonzero(good)
    at = np.cumsum(size) - size
    good = good[_candidates(text, ids[good], at[good], size[good], offset[good], length, run)]
    if not len(good):
        return merged_intervals(*out[0])
    text, ids, tag, start, count, size, offset, rows = _only(good, text, ids, tag, start, count, size, offset, rows)
    at = np.cumsum(size) - size
    shards = []
    cuts = np.flatnonzero(np.diff((at + size - 1) // shard_bytes)) + 1
    for piece in np.split(np.arange(len(at)), cuts):
        lo, hi = at[piece[0]], at[piece[-1]] + size[piece[-1]]
        begins = _gather_starts(at[piece] - lo, count[piece])
        of = np.repeat(piece, count[piece])
        order, opens = sa.classes(text[lo:hi], begins, length)
        least = np.minimum.reduceat(ids[of[order]], opens)
        shards.append([lo, hi, begins, of, order, opens, least])
    if len(shards) > 1:
        strings = [_strings(text[lo:hi], begins[order[opens]], length) for lo, hi, begins, _, order, opens, _ in shards]
        all_strings, all_least = strings[0], shards[0][-1]
        for s, x in zip(strings[1:], shards[1:], strict=True):
            all_strings, all_least = sa.merge_smallest(all_strings, all_least, s, x[-1])
        for s, x in zip(strings, shards, strict=True):
            x[-1] = all_least[np.searchsorted(all_strings, s)]
    for _, _, begins, of, order, opens, least in shards:
        gone = np.empty(len(order), dtype=bool)
        gone[order] = ids[of[order]] > np.repeat(least, np.diff(np.append(opens, len(order))))
        # neighbouring strings of a piece are one interval
        prev = np.zeros(len(gone), dtype=bool)
        prev[1:] = gone[:-1] & (of[1:] == of[:-1])
        nxt = np.zeros(len(gone), dtype=bool)
        nxt[:-1] = gone[1:] & (of[1:] == of[:-1])
        first, last = np.flatnonzero(gone & ~prev), np.flatnonzero(gone & ~nxt)
        where = np.arange(len(of)) - np.searchsorted(of, of)  # the string's number in its piece
        piece, lo, hi = _at_all_places(of[first], start, where[first], where[last] + length, rows)
        out.append((ids[piece], tag[piece], lo, hi))
    return merged_intervals(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _only(good: np.ndarray, text, ids, tag, start, count, size, offset, rows) -> tuple[np.ndarray, ...]:
    """Some of a bucket's pieces, with their text and their further places."""
    rows = rows[np.isin(rows[:, 0], good)]
    rows = np.column_stack([np.searchsorted(good, rows[:, 0]), rows[:, 1:]])
    return _gather(text, (np.cumsum(size) - size)[good], size[good]), ids[good], tag[good], start[good], count[good], size[good], offset[good], rows


def _copies(text: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a piece of a smaller doc_id holds the same bytes; the pieces' texts stand one after the other."""
    code = equal_codes(text, size)
    least = np.full(int(code.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, code, ids)
    return ids > least[code]


def _candidates(text: np.ndarray, ids: np.ndarray, at: np.ndarray, size: np.ndarray, offset: np.ndarray, length: int, run: int) -> np.ndarray:
    """Pieces that may share a string with another doc_id.

    A string holds its minimizer and length - run bytes more, so it reaches at
    least half of these to the left of the minimizer or half to the right: of
    two pieces that share a string, the minimizers agree with that many bytes on
    one side.
    """
    whole, half = offset == _WHOLE, (length - run) // 2
    left = np.flatnonzero(~whole & (offset >= half))
    right = np.flatnonzero(~whole & (size - offset - run >= half))
    alone = np.flatnonzero(whole)
    out = np.zeros(len(ids), dtype=bool)
    for pick, begin, n in ((left, offset[left] - half, run + half), (right, offset[right], run + half), (alone, 0, length)):
        out[pick] |= _may_match(ids[pick], _keys(text, at[pick] + begin, n))
    return out


def _strings(text: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """The strings at some places as fixed-length values."""
    rows = np.lib.stride_tricks.sliding_window_view(text, length)[begins]
    return np.ascontiguousarray(rows).view(f"S{length}").reshape(-1)


def _keys(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes at each place."""
    h = np.zeros(len(at), dtype=np.uint64)
    for t in range(n):
        h = h * _U(0x9E3779B97F4A7C15) + BYTE_CODE[text[at + t]]
    return mix64(h)


def _interval_rows(part: tuple[np.ndarray, ...], names: list[str]) -> pa.RecordBatch:
    """Removed intervals as rows; start and length share a number (an interval is at most MAX_SPAN long)."""
    ids, tag, start, end = (x.astype(np.int64) for x in part)
    columns = {"doc_id": pa.array(ids), "tag": pa.array(tag), "span": pa.array(start << 16 | end - start),
               "bucket": pa.nulls(len(ids), pa.int32()), "body": pa.nulls(len(ids), pa.binary())}
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names)


GONE = ["doc_id", "tag", "span"]
ROWS = [*GONE, "bucket", "body"]
GONE_TYPE = "doc_id bigint, tag bigint, span bigint"
ROWS_TYPE = GONE_TYPE + ", bucket int, body binary"


def _cut_long(b: Block, length: int, limit: int = LONG_BYTES):
    """(place in its document, block): one long document as blocks of bounded bytes, each string in the one it starts in."""
    if len(b) > 1 or len(b.data) <= 2 * limit:
        yield 0, b
        return
    for at in range(0, len(b.data) - length + 1, limit):
        data = b.data[at:at + limit + length - 1]
        yield at, Block(b.first, data, np.array([0, len(data)]))


def _cutter(given, n_buckets: int, length: int, run: int):
    def cut(batches):
        common, sample = given.value
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc_id, tag = ids.fill_null(0).to_numpy(), batch.column(2).to_numpy()
            for b in blocks(batch.column(1), CUT_BYTES):
                part = slice(b.first, b.first + len(b))
                for shift, c in _cut_long(b, length):
                    rows, now = block_pieces(c, doc_id[part], tag[part], known[part], common, n_buckets, length, run, sample, shift)
                    yield _interval_rows(now, ROWS)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 3, pa.array([r[0] for r in rows], pa.int32()),
                                                      pa.array([r[1] for r in rows], pa.binary())], ROWS)

    return cut


def _matcher(given, length: int, run: int, shard_bytes: int):
    """Rows come in order of their bucket; intervals that were removed on the spot pass through."""

    def match(batches):
        now, blobs, sample = None, [], given.value[1]
        for batch in batches:
            bucket = batch.column(3)
            yield batch.filter(bucket.is_null()).select(GONE)
            for k, body in zip(bucket.to_pylist(), batch.column(4), strict=True):
                if k is None:
                    continue
                if k != now and blobs:
                    yield _interval_rows(bucket_repeats(blobs, length, run, shard_bytes, sample), GONE)
                    blobs = []
                now = k
                blobs.append(body.as_py())
        if blobs:
            yield _interval_rows(bucket_repeats(blobs, length, run, shard_bytes, sample), GONE)

    return match


def merged_spans(spans: list[int] | None) -> np.ndarray:
    """Maximal removed runs (start, end) in order."""
    x = np.sort(np.array(spans or [], dtype=np.int64))
    pairs = np.stack([x >> 16, (x >> 16) + (x & 0xFFFF)], axis=1)
    if not len(pairs):
        return pairs
    reach = np.maximum.accumulate(pairs[:, 1])
    opens = np.append(0, np.flatnonzero(pairs[1:, 0] > reach[:-1]) + 1)
    return np.stack([pairs[opens, 0], reach[np.append(opens[1:], len(pairs)) - 1]], axis=1)


def remaining(text: bytes, spans: np.ndarray) -> bytes:
    cuts = [0, *spans.reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _report(batches):
    for batch in batches:
        rows, undo = [], zstandard.ZstdDecompressor()
        for doc_id, n_bytes, packed, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = undo.decompress(packed, max_output_size=n_bytes) if n_bytes else b""
            spans = merged_spans(found)
            rows.append((doc_id, n_bytes, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(remaining(text, spans)).hexdigest(), spans.reshape(-1).tolist()))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def _packed_texts(batches):
    """Texts as they travel to the report: compressed."""
    for batch in batches:
        z = zstandard.ZstdCompressor(level=3)
        texts = [(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) for x in texts], pa.int64()),
                                          pa.array([z.compress(x) if x else b"" for x in texts], pa.binary())], ["doc_id", "tag", "n_bytes", "packed"])


def _runs(run: int):
    """Each run of bytes of a block, with the number of its documents that hold it."""

    def count(batches):
        for batch in batches:
            for b in blocks(batch.column(0)):
                keys = [np.unique(np.concatenate([np.unique(kgram_hashes(b.data[at:min(hi, at + CUT_BYTES + run - 1)], run)) for at in range(lo, max(hi, lo + 1), CUT_BYTES)]))
                        for lo, hi in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True)]
                keys, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return count


def common_runs(docs: DataFrame, run: int = RUN) -> np.ndarray:
    """Hashes of the runs that about COMMON_DOCS documents or more hold, judged by the sampled ones."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_OF)) == 0).select("text")
    found = sample.mapInArrow(_runs(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    # a document has so many runs only: of n documents at most n / COMMON_DOCS times that number are common
    return np.sort(np.array([r[0] for r in found.filter(F.col("n") * SAMPLE_OF >= COMMON_DOCS).collect()], dtype=np.int64).view(np.uint64))


def sample_text(docs: DataFrame) -> bytes:
    """Text of a few documents, of bounded size, to compress pieces against."""
    rows = docs.select("doc_id", F.when(F.octet_length("text") <= DICTIONARY_BYTES // 16, F.col("text")).alias("text"))
    return b"".join((r["text"] or "").encode() for r in few_rows(rows, DICTIONARY_DOCS, "doc_id", "text").collect())[:DICTIONARY_BYTES]


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and a tag that tells rows of one doc_id apart: 0, or the text's hash where the id repeats."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("again"))
    if not repeated.limit(1).count():
        return rows.withColumn("tag", F.lit(0).cast("bigint"))
    own = F.when(F.col("again"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(0)
    return rows.join(repeated, "doc_id", "left").select("doc_id", "text", own.cast("bigint").alias("tag"))


def removed_spans(docs: DataFrame, length: int = LENGTH, run: int = RUN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans (start, end, start, ...)."""
    rows = _tagged(docs)
    given = docs.sparkSession.sparkContext.broadcast((common_runs(rows, run), sample_text(rows)))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(64, n_bytes // BUCKET_BYTES)
    cut = rows.mapInArrow(_cutter(given, n_buckets, length, run), ROWS_TYPE)
    # removed-on-the-spot rows have no bucket; they are spread by their document
    dealt = cut.repartition(F.coalesce(F.col("bucket").cast("bigint"), F.xxhash64("doc_id"))).sortWithinPartitions("bucket")
    gone = dealt.mapInArrow(_matcher(given, length, run, shard_bytes), GONE_TYPE)
    spans = gone.groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans"))  # at most a document's intervals
    texts = rows.mapInArrow(_packed_texts, "doc_id bigint, tag bigint, n_bytes bigint, packed binary")
    joined = texts.join(spans, ["doc_id", "tag"], "left").select("doc_id", "n_bytes", "packed", "spans")
    return joined.mapInArrow(_report, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<bigint>")
