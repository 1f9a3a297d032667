"""Whole texts as numpy byte blocks.

Arrow hands a task its documents as one UTF-8 buffer plus offsets.  The
operators here cut such a batch into blocks of bounded bytes (a block always
holds whole documents), find words with a 256-entry class table and hash them
with prefix sums, so the cost per byte is a few numpy passes and no Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer document is a block of its own.
BLOCK_BYTES = 256 << 10

_U = np.uint64


def _class_table(pred) -> bytes:
    return bytes(bool(pred(b)) for b in range(256))


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] on lower-cased text, as bytes: digits, a-z and every non-ASCII byte.
ALNUM = _class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: [^\x20\x09-\x0D]
NONSPACE = _class_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))

#: A random odd number for each byte; hashes are sums of codes times powers of a base, modulo 2**64.
BYTE_CODE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            m = max(n, 1 << 16)
            self.pos, self.neg = (self._table(b, m) for b in (self.base, pow(self.base, -1, 2**64)))
            self.n = m
        return self.pos[:n], self.neg[:n]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, _U(base), dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


BYTE_POWERS, WORD_POWERS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1B54A32D192ED03)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and odd multiplications), in place where possible."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def prefix_hashes(codes: np.ndarray, powers: _Powers) -> np.ndarray:
    """Running sums of codes[i] * base**i, with a zero in front."""
    pos, _ = powers.upto(len(codes) + 1)
    out = np.empty(len(codes) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(codes * pos[: len(codes)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hash of each span [start, end), independent of where it stands."""
    _, neg = powers.upto(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * neg[starts])


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k bytes."""
    if len(data) < k:
        return np.empty(0, dtype=np.uint64)
    p = prefix_hashes(BYTE_CODE[data], BYTE_POWERS)
    _, neg = BYTE_POWERS.upto(len(p))
    n = len(data) - k + 1
    return mix64((p[k:] - p[:n]) * neg[:n])


@dataclass
class Block:
    """Whole documents as one byte array; document i is data[offsets[i]:offsets[i+1]]."""

    first: int  # row of the batch that document 0 is
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def lower(self) -> np.ndarray:
        """A-Z to a-z, every other byte unchanged."""
        return np.frombuffer(self.data.tobytes().lower(), dtype=np.uint8)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def words(self, data: np.ndarray, kind: bytes) -> Words:
        return Words.of(data, self.offsets, kind)


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a document's end."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.logical_not(inside[:-1], out=edge[1:])
    cuts = offsets[1:-1]
    edge[cuts[(cuts > 0) & (cuts < n)]] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1] = True
    np.logical_not(inside[1:], out=edge[:-1])
    edge[cuts[(cuts > 0) & (cuts < n)] - 1] = True
    return starts, np.flatnonzero(inside & edge) + 1


def spans_index(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the bytes of many spans, one span after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, the same for those of equal bytes only."""
    sizes = ends - starts
    return equal_codes(data[spans_index(starts, sizes)], sizes)


def equal_codes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each of the spans that stand one after the other, the same for those of equal bytes only."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return spans.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Words:
    """Words of a block: byte spans, the first word of each document, and hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(docs) + 1

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, kind: bytes) -> Words:
        starts, ends = spans_of(np.frombuffer(data.tobytes().translate(kind), dtype=bool), offsets)
        return cls(data, starts, ends, np.searchsorted(starts, offsets))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def doc(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @cached_property
    def hashes(self) -> np.ndarray:
        p = prefix_hashes(BYTE_CODE[self.data], BYTE_POWERS)
        return span_hashes(p, self.starts, self.ends, BYTE_POWERS)

    def joined(self, i: int, n: int) -> bytes:
        """Words i .. i+n-1 with one space between them."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:i + n], self.ends[i:i + n], strict=True))

    def window_starts(self, n: int) -> np.ndarray:
        """First words of the windows of n consecutive words of one document."""
        at = np.arange(max(0, len(self.starts) - n + 1))
        return at[at + n <= self.first[1:][self.doc[at]]] if len(at) else at

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of n consecutive words of one document, and the windows' hashes."""
        at = self.window_starts(n)
        return at, span_hashes(self._prefix, at, at + n, WORD_POWERS)

    @cached_property
    def _prefix(self) -> np.ndarray:
        return prefix_hashes(self.hashes, WORD_POWERS)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[o[0]:o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    return raw, o - o[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of whole documents of about ``limit`` bytes."""
    data, offsets = utf8(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield Block(at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
        at = end
