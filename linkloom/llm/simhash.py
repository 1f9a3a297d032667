"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than differing bits are
allowed: of ``max_bits // 2 + 1`` segments, two fingerprints at ``max_bits``
or fewer differing bits agree on one of them but for at most one bit.  Each
fingerprint is therefore indexed under one key per bit -- its segment with
that bit deleted -- and fingerprints that are equal under any key are compared.

Only distinct fingerprints are indexed, so a group of copies is one entry.  A
key of more than ``BLOCK_ROWS`` fingerprints is cut into blocks by their hash,
and every two of its blocks meet under a key of their own.  The fingerprints under a key meet in one partition, where they are compared in
numpy on sorted runs; what leaves the task is a spanning forest of the verified
links of its runs, never all pairs of a group.  Connected components then join
the forests, each round written to the shared checkpoint folder.

Cases: a null or empty text, or one of white space, has no shingles and
fingerprint zero, linked like any other; a text of fewer words than a shingle
is one shingle; repeated rows have one fingerprint and one component; a null
doc_id is never the smallest unless a component has no other; an empty table
gives an empty result; extra columns are not read by ``near_duplicates`` and
kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.columns import spare
from linkloom.operators.common import sized_broadcast
from linkloom.operators.graph import connected_components
from linkloom.session import materialize

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
BITS = 64
#: Index rows compared at once; a run of equal keys is never cut.
RUN_ROWS = 1 << 20
#: Fingerprints under one key that are compared in one task.
BLOCK_ROWS = 1 << 15


def fingerprint(text: bytes, n: int = SHINGLE_WORDS) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        hashes = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 4096):
        set_bits += np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, fp) of every document; fp is the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", n) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_key"))
    return narrow.mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments."""
    n = max_bits // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variant_keys(fp: str, max_bits: int):
    """One key for each bit: the bit's number above its segment without the bit."""
    bit = lambda x: f"{x - (1 << 64) if x >> 63 else x}L"
    out = []
    for first, width in segments(max_bits):
        for b in range(first, first + width):
            mask = ((1 << width) - 1) << first & ~(1 << b)
            out.append(F.expr(f"shiftleft({b}L, 32) | shiftrightunsigned({fp} & {bit(mask)}, {first})"))
    return F.array(*out)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect: every node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between fingerprints of equal keys; keys are sorted."""
    at, step, a, b, held = np.arange(len(keys) - 1), 1, [], [], 0
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at + step] == keys[at]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits]
        a.append(fps[near])
        b.append(fps[near + step])
        step, held = step + 1, held + len(near)
        if held > 1 << 22:  # shorten what a group of many near copies piles up
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
    return forest(np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def variant_index(distinct: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, fp): fingerprints to compare stand under one key, about 2 * block_rows of them at most."""
    index = distinct.select(F.explode(variant_keys("fp", max_bits)).alias("key"), "fp")
    if distinct.count() <= block_rows:
        return index
    hot = index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)
    hot = materialize(hot.select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("parts")), "simhash-hot")
    if not hot.limit(1).count():
        return index
    both = index.join(sized_broadcast(hot), "key", "left").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    others = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("block")))
    # keys that clash bring more to compare, and every link is verified
    return both.select("key", "fp", "block", F.explode(others).alias("other")).select(
        F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).alias("key"), "fp")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst) links whose components are those of all pairs at max_bits or fewer differing bits."""

    def run(batches):
        keys, fps = [], []

        def flush(upto: int | None):
            nonlocal keys, fps
            k, f = np.concatenate(keys), np.concatenate(fps)
            cut = len(k) if upto is None else int(np.searchsorted(k, k[-1]))
            keys, fps = [k[cut:]], [f[cut:]]
            a, b = _links(k[:cut], f[:cut], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            if sum(map(len, keys)) >= run_rows:
                yield flush(-1)
        if keys:
            yield flush(None)

    return variant_index(distinct, max_bits, block_rows).repartition("key").sortWithinPartitions("key").mapInArrow(run, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_key, fp, comp, component_id): component_id is the smallest doc_id that links reach;
    comp names the component where it has no doc_id too."""
    prints = materialize(fingerprints(docs, n), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    found = materialize(links(distinct, max_bits), "simhash-links")
    comp = connected_components(found).select(F.col("v").alias("fp"), "comp")
    grouped = materialize(distinct.join(comp, "fp", "left").select("fp", "first_id", F.coalesce("comp", "fp").alias("comp")), "simhash-comp")
    first = grouped.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_print = grouped.join(first, "comp").select("fp", "comp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "text_key", "fp", "comp", "component_id")


def keep_one(docs: DataFrame, n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all its columns."""
    rows = near_duplicates(docs, n, max_bits)
    of_id, of_text, n_rows, key = spare(docs, "__id", "__text", "__rows", "__key")
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    copies = rows.groupBy("comp", "doc_id", "text_key").agg(F.count("*").alias("c"))
    kept = materialize(copies.groupBy("comp").agg(F.min_by(F.struct("doc_id", "text_key", "c"), member).alias("m"))
                       .select(F.col("m.doc_id").alias(of_id), F.col("m.text_key").alias(of_text), F.col("m.c").alias(n_rows)), "simhash-kept")
    d = docs.withColumn(key, F.xxhash64("text"))
    mine = d.join(kept, d["doc_id"].cast("bigint").eqNullSafe(kept[of_id]) & (d[key] == kept[of_text]))
    mine = mine.filter(F.col(n_rows) == 1).unionByName(mine.filter(F.col(n_rows) > 1).dropDuplicates([of_id, of_text]))
    return mine.drop(of_id, of_text, n_rows, key)
