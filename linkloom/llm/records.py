"""Token ids as length-delimited binary records.

A record file is a run of frames.  A frame is: payload length (u64), masked
checksum of those eight bytes (u32), payload, masked checksum of the payload
(u32), all little-endian.  The checksum is CRC-32, masked by a rotation by 15
bits and an addition so that a checksum stored inside a payload doesn't clash
with its own.  A payload is the doc_id (i64), a flag byte (1: the doc_id is
null), the bytes per id (2 if the vocabulary fits, else 4) and the ids.  Next
to each ``.rec`` file an ``.idx`` file holds the frames' offsets (u64), so
records can be read in any order.

Documents are range-partitioned by doc_id (nulls first, equal ids by text), so
the files in order of their number hold the documents in ascending order.  A
task names its files by itself and reports them in a manifest row; the manifest
is a written table, so files of a lost or repeated attempt are never read.

A text is encoded in units that end at a single space or line end between two
characters that are not white space.  A byte-level pre-tokenizer lets a token
take one space in front of it and leaves a line end on its own, so no token
reaches across such a place: new units are encoded by one run of the tokenizer
over all of them and looked up from then on, and the ids are those of the whole
text.  Texts with any other white space, and those that hold the name of a
token added to the vocabulary (the library makes it that token, as in
``<|endoftext|>``), are encoded whole.

Cases: a null or empty text is its end id alone; repeated rows give records of
their own; an empty table gives no files and no rows; extra columns are not
read.
"""

from __future__ import annotations

import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.textblocks import blocks
from linkloom.session import materialize, scratch_dir

END_ID = 2
#: Units of text whose ids a task remembers, and the longest of them.
CACHE_UNITS, CACHE_CHARS = 1 << 20, 64
#: ASCII punctuation but for the apostrophe, which opens contractions.
MARKS = "".join(c for c in string.punctuation if c != "'")

_HEAD = struct.Struct("<QI")
_META = struct.Struct("<qBB")
_SUM = struct.Struct("<I")

MANIFEST = "part int, path string, n_records bigint, n_tokens bigint"
RECORDS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, body: bytes, width: int) -> bytes:
    payload = _META.pack(doc_id or 0, doc_id is None, width) + body
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload))))


class Encoder:
    """Ids of whole texts, as bytes of little-endian numbers."""

    def __init__(self, tokenizer_path: str, names_are_text: bool = True):
        """``names_are_text``: a special token's name in a text is ordinary text; False is the library's own way."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = names_are_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (names_are_text and t.special)]
        # units that are learnt together could make a name with white space in it
        self.by_units = not any(c.isspace() for name in self.added for c in name)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # a byte-level token's name has one character for each of its bytes
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for name, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.n_bytes[number] = len(name)
        self.newline = self._encode(["\n"])[0]
        self.tails: dict[str, bytes] = {}
        self.known: dict[str, dict[str, bytes]] = {" ": {}, "\n": {}}  # units behind a space, and at the start of a line

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _learn(self, lead: str, units: set[str]) -> dict[str, bytes]:
        """Ids of units behind ``lead``, from one run of the tokenizer over all of them."""
        units = list(units)
        if not units:
            return {}
        ids = np.array(self.tokenizer.encode(lead + lead.join(units), add_special_tokens=False).ids, dtype=self.dtype)
        ends = np.cumsum(self.n_bytes[ids])
        size = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        last = np.cumsum(size + 1)
        first = last - size - (lead == " ")  # the space belongs to the unit, the line's end doesn't
        at, to = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, last, side="left") + 1
        width, raw = self.dtype.itemsize, ids.tobytes()
        return {u: raw[a * width:b * width] for u, a, b in zip(units, at.tolist(), to.tolist(), strict=True)}

    def _lookup(self, lead: str, units: list[list[str]]) -> dict[str, bytes]:
        """A table that has all the units; short ones are remembered."""
        known = self.known[lead]
        if len(known) > CACHE_UNITS:
            known.clear()
        missing = set()
        for part in units:
            missing.update(filterfalse(known.__contains__, part))
        # punctuation behind a letter is a token's begin, so a word is learnt once for all its punctuation
        stems = {u: _stem(u) for u in missing}
        new = self._learn(lead, {s for s in stems.values() if s not in known})
        for u, s in stems.items():
            if u != s:
                new[u] = (new[s] if s in new else known[s]) + self._tail(u[len(s):])
        known.update((u, ids) for u, ids in new.items() if len(u) <= CACHE_CHARS)
        return known if all(len(u) <= CACHE_CHARS for u in new) else {**known, **new}

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > CACHE_UNITS:
                self.tails.clear()
            self.tails[marks] = self._encode([marks])[0]
        return self.tails[marks]

    def __call__(self, texts: list[str], end_id: int) -> list[bytes]:
        cut: list[list[list[str]] | None] = [lines_of(t) if self.by_units and not any(name in t for name in self.added) else None for t in texts]
        heads = self._lookup("\n", [[line[0] for line in lines] for lines in cut if lines])
        rest = self._lookup(" ", [line[1:] for lines in cut if lines for line in lines])
        whole = iter(self._encode([t for t, lines in zip(texts, cut, strict=True) if lines is None]))
        end = np.array([end_id], dtype=self.dtype).tobytes()
        out = []
        for lines in cut:
            if lines is None:
                out.append(next(whole) + end)
            else:
                out.append(self.newline.join(heads[line[0]] + b"".join(map(rest.__getitem__, line[1:])) for line in lines) + end)
        return out


def _stem(unit: str) -> str:
    """The unit without the punctuation that stands behind its last letter."""
    s = unit.rstrip(MARKS)
    return s if s and s[-1].isalpha() else unit


def lines_of(text: str) -> list[list[str]] | None:
    """Units of each line; None if white space stands together or at an end, where tokens may reach across."""
    words = text.split()
    if not words:
        return None if text else []
    if sum(map(len, words)) + len(words) - 1 != len(text):
        return None
    return [line.split(" ") for line in text.split("\n")]


@lru_cache(1)
def encoder_of(tokenizer_path: str) -> Encoder:
    """The worker process's encoder; what it has learnt serves its next tasks too."""
    return Encoder(tokenizer_path, names_are_text=False)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _writer(folder: str, tokenizer_path: str, end_id: int):
    def write(batches):
        rec, offsets, at, tokens = None, [], 0, 0
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}"
        for batch in batches:
            for b in blocks(batch.column(1)):
                ids = batch.column(0)[b.first:b.first + len(b)].to_pylist()
                if rec is None:
                    encoder = encoder_of(tokenizer_path)
                    fs, name = _open(path)
                    fs.create_dir(os.path.dirname(name), recursive=True)
                    rec = fs.open_output_stream(name + ".rec")
                out = []
                for doc_id, body in zip(ids, encoder([b.text(i).decode() for i in range(len(b))], end_id), strict=True):
                    out.append(frame(doc_id, body, encoder.dtype.itemsize))
                    offsets.append(at)
                    at += len(out[-1])
                    tokens += len(body) // encoder.dtype.itemsize
                rec.write(b"".join(out))
        if rec is not None:
            rec.close()
            with fs.open_output_stream(name + ".idx") as idx:
                idx.write(np.array(offsets, dtype="<u8").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_records": len(offsets), "n_tokens": tokens}],
                                             pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]))

    return write


def write_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the record and index files; returns the manifest, one row per file with the ids before it."""
    folder = folder or scratch_dir(docs.sparkSession, "records")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    ordered = narrow.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = materialize(ordered.mapInArrow(_writer(folder, tokenizer_path, end_id), MANIFEST), "records-manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)))


class BadRecord(ValueError):
    """A frame whose length or payload doesn't match its checksum."""


def parse_frame(buffer: memoryview, at: int) -> tuple[int | None, np.ndarray, int] | None:
    """doc_id, ids and the next frame's place; None if the frame isn't whole yet."""
    if len(buffer) - at < _HEAD.size:
        return None
    length, check = _HEAD.unpack_from(buffer, at)
    if masked(bytes(buffer[at:at + 8])) != check:
        raise BadRecord(f"length at {at}")
    end = at + _HEAD.size + length
    if len(buffer) < end + _SUM.size:
        return None
    payload = bytes(buffer[at + _HEAD.size:end])
    if masked(payload) != _SUM.unpack_from(buffer, end)[0]:
        raise BadRecord(f"payload at {at}")
    doc_id, none, width = _META.unpack_from(payload)
    return None if none else doc_id, np.frombuffer(payload, dtype=f"<u{width}", offset=_META.size), end + _SUM.size


def scan_file(path: str, chunk: int = 4 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a file in order, in bounded memory."""
    fs, name = _open(path)
    with fs.open_input_stream(name + ".rec") as f:
        rest = b""
        while True:
            more = f.read(chunk)
            view, at = memoryview(rest + more), 0
            while found := parse_frame(view, at):
                yield found[0], found[1]
                at = found[2]
            rest = bytes(view[at:])
            if not more:
                if rest:
                    raise BadRecord(f"{path} ends within a frame")
                return


def read_at(path: str, numbers: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """The numbered records of a file in the given order, through its index."""
    fs, name = _open(path)
    with fs.open_input_file(name + ".idx") as f:
        offsets = np.frombuffer(f.read(), dtype="<u8")
    with fs.open_input_file(name + ".rec") as f:
        ends = np.append(offsets[1:], f.size())
        for i in numbers:
            doc_id, ids, _ = parse_frame(memoryview(f.read_at(int(ends[i] - offsets[i]), int(offsets[i]))), 0)
            yield doc_id, ids


def read_records(manifest: DataFrame) -> DataFrame:
    """What the files hold: doc_id, start, n_tokens and ids_crc32 of every record."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for file in batch.to_pylist():
                start, rows = file["base"], []
                for doc_id, ids in scan_file(file["path"]):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    # a partition for each file, so that files are read side by side
    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, RECORDS)


def encode_and_read(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents as records and return what reading them back gives."""
    return read_records(write_records(docs, tokenizer_path, folder, end_id))
