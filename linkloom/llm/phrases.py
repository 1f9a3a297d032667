"""Phrase collocation mining by vertical partitioning of suffix trees, in the manner of ERA.

Every position of a piece of text starts a suffix, truncated at four words.
The counts of all phrases are the leaf totals of a truncated suffix tree, far
too large for one task, so it is partitioned vertically: the word prefixes of
the suffixes are grouped until a group's suffixes fill a memory budget, and
each group's subtrees are built on their own.

1. Texts are cut into blocks of whole documents of one language; a block keeps its
   words as numbers of a dictionary of its own.  The dictionaries are summed to
   word counts (f of one word, and n), written once.
2. Words below ``min_count`` can't stand in a candidate: every phrase that holds
   one is rarer still.  They end suffixes.  The others get numbers and, in order
   of their running counts, groups of at most ``budget`` suffixes.
3. A word whose suffixes would take over a quarter of the budget is no prefix by itself:
   it is extended by the next word, such a pair by a third one, and a triple
   by the fourth.  Each extension counts the prefixes once more and only those
   below words (pairs, triples) that need it; their own counts are then known,
   as the part of the tree above its subtrees.  At most four such prefixes per
   group exist, and groups number at most ``MAX_GROUPS``.
4. A block sends each group its suffixes sorted and counted, so what travels is
   bounded by distinct suffixes.  The group's task merges them, and the runs of
   equal 2-, 3- and 4-word prefixes are the tree's nodes, their sums its counts.
5. Phrases at ``min_count`` or above are scored with equi-joins on their parts.

Word numbers replace hashes throughout: two words are one only if their bytes
are equal.  No dictionary is broadcast; a block's words meet their numbers in
a join.

Cases: a null text is empty; a null lang is ``und``; empty and blank texts and
pieces have no words; repeated rows count each time; ties go by phrase in UTF-8
byte order; a text beyond a block's size is a block of its own; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.runs import run_starts
from linkloom.llm.textblocks import blocks, mix64, spans_of
from linkloom.operators.common import sized_broadcast
from linkloom.operators.graph import dense_index
from linkloom.session import materialize

MAX_WORDS = 4
MIN_COUNT = 30
KEEP = 2000
SCALE = 2_000_000
#: A phrase is dropped if a longer one around it has this share of its count.
INSIDE_PERCENT = 80
NO_LANG = "und"
#: Suffixes of one group of prefixes; its task holds some hundred bytes for each.
BUDGET = 1 << 20
#: Above this many groups the budget grows, so that the list of extended prefixes stays below 8 MB.
MAX_GROUPS = 1 << 18
_HOT_PART = 4
#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20

_CUTS = frozenset(b".,;:!?\n\v\f\r")
_CUT = bytes(b in _CUTS for b in range(256))
_WORD = bytes(b not in _CUTS and b not in b" \t" for b in range(256))
_BOTH = np.uint64(32)


# -- blocks of numbered words -----------------------------------------------------------

def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, bytes of equal weight side by side, compressed."""
    parts = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return struct.pack("<q", len(columns[0])) + zstandard.compress(b"".join(parts), 1)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    (n,), raw, at, out = struct.unpack_from("<q", data), zstandard.decompress(data[8:]), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def number_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the block's distinct words, its words in order as places in that list from 1, a zero in front of every piece)."""
    raw = data.tobytes()
    inside = np.frombuffer(raw.translate(_WORD), dtype=bool)
    starts, ends = spans_of(inside, offsets)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    kept = data[inside].tobytes()
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    cuts = np.cumsum(np.frombuffer(raw.translate(_CUT), dtype=np.uint8), dtype=np.int32)
    before = cuts[starts] if len(starts) else cuts[:0]
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = before[1:] != before[:-1]
    first = np.searchsorted(starts, offsets[:-1])
    opens[first[first < len(starts)]] = True
    seq = np.zeros(len(starts) + int(opens.sum()), dtype=np.int32)
    seq[np.arange(len(starts)) + np.cumsum(opens)] = coded.indices.to_numpy(zero_copy_only=False) + 1
    return coded.dictionary.cast(pa.binary()).cast(pa.string()), seq


def _of_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """The batch's texts language by language."""
    lang = batch.column(0).dictionary_encode()
    code = lang.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if len(at):
            yield lang.dictionary[int(code[at[0]])].as_py(), batch.column(1).take(pa.array(at))


def _tokenize(batches, block_bytes):
    for batch in batches:
        for lang, texts in _of_lang(batch):
            for b in blocks(texts, block_bytes):
                words, seq = number_words(b.lower, b.offsets)
                counts = np.bincount(seq, minlength=len(words) + 1)[1:]
                if len(words):
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "words": pa.array([words.to_pylist()], pa.list_(pa.string())),
                                                      "counts": pa.array([counts], pa.list_(pa.int64())), "seq": [pack(seq)]})
        pa.default_memory_pool().release_unused()  # a worker keeps what its pool holds


def token_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, lang, words, counts, seq), written once."""
    narrow = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    rows = narrow.mapInArrow(lambda b: _tokenize(b, block_bytes), "lang string, words array<string>, counts array<bigint>, seq binary")
    return materialize(rows.withColumn("block", F.monotonically_increasing_id()), "phrase-blocks")


# -- prefixes and their groups ------------------------------------------------------------

def word_table(tokens: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""
    rows = tokens.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    return rows.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))


def group_words(words: DataFrame, min_count: int, budget: int) -> DataFrame:
    """(lang, word, f, id, grp): frequent words numbered from 1; grp packs them to the budget, -1 where a word is extended."""
    rows = dense_index(words.filter(F.col("f") >= min_count), out_col="at").withColumn("id", F.col("at") + 1)
    weight = F.when(F.col("f") <= F.lit(hot_count(min_count, budget)), F.col("f")).otherwise(0)
    rows = materialize(rows.withColumn("weight", weight).withColumn("chunk", F.shiftright("at", 16)), "phrase-words")
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("chunk").agg(F.sum("weight").alias("w")).select("chunk", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    running = F.coalesce(F.sum("weight").over(Window.partitionBy("chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("running", running).join(sized_broadcast(chunks), "chunk")
    grp = F.when(F.col("weight") > 0, F.expr(f"(base + running) div {budget}")).otherwise(-1)
    return rows.select("lang", "word", "f", "id", grp.cast("bigint").alias("grp"))


def hot_count(min_count: int, budget: int) -> int:
    """Suffixes above which a prefix is extended."""
    return max(min_count, budget // _HOT_PART)


def numbered_blocks(tokens: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, seq, dict): each block with the numbers and groups of its frequent words."""
    rows = tokens.select("block", "lang", F.posexplode("words").alias("place", "word"))
    known = rows.join(frequent.select("lang", "word", "id", "grp"), ["lang", "word"])
    dicts = known.groupBy("block").agg(F.collect_list(F.struct(F.col("place"), F.col("id"), F.col("grp"))).alias("dict"))
    return tokens.select("block", "lang", "seq").join(dicts, "block").select("lang", "seq", "dict")


def suffixes(seq: bytes, entries: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(group of the first word, of the second, the words' numbers) of every suffix of two words or more; 0 is behind its end."""
    place, number, grp = (entries.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    (codes,) = unpack(seq, "<i4")
    size = max(int(codes.max(initial=0)), int(place.max(initial=-1)) + 1) + 1
    number_of, group_of = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
    number_of[place + 1], group_of[place + 1] = number.astype(np.uint64), grp
    w = np.concatenate([number_of[codes], np.zeros(MAX_WORDS, dtype=np.uint64)])
    at = np.flatnonzero((w[:-1] > 0) & (w[1:] > 0))
    words = [w[at], w[at + 1]]
    for i in range(2, MAX_WORDS):
        words.append(np.where(words[-1] > 0, w[at + i], np.uint64(0)))
    return group_of[codes[at]], group_of[codes[at + 1]], words


class Hot:
    """Prefixes that are extended: sorted pairs, and triples as (place of their pair, third word)."""

    def __init__(self, pairs: np.ndarray | None = None, triples: np.ndarray | None = None):
        self.pairs = np.empty(0, np.uint64) if pairs is None else pairs
        self.triples = np.empty(0, np.uint64) if triples is None else triples

    def find(self, known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``known``, is there) of each key."""
        at = np.searchsorted(known, keys)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == keys[hit]
        return at, hit

    def triple_keys(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Key of each suffix's first three words, and whether it has them below an extended pair."""
        at, hit = self.find(self.pairs, words[0] << _BOTH | words[1])
        return at.astype(np.uint64) << _BOTH | words[2], hit & (words[2] > 0)


def _each_block(batches):
    """(lang, *suffixes) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("lang")[i].as_py(), *suffixes(batch.column("seq")[i].as_py(), batch.column("dict")[i].values)


def _extensions(batches, hot: Hot, level: int):
    """(lang, key, n): prefixes one word longer than those that must be extended, counted block by block.

    A phrase is no more frequent than its parts, so only those are counted of
    which both words, or both pairs, must be extended themselves.
    """
    for lang, grp, following, words in _each_block(batches):
        if level == 2:
            keys = (words[0] << _BOTH | words[1])[(grp < 0) & (following < 0)]
        else:
            keys, below = hot.triple_keys(words)
            keys = keys[below & hot.find(hot.pairs, words[1] << _BOTH | words[2])[1]]
        key, n = np.unique(keys, return_counts=True)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(key), pa.string()), "key": key.view(np.int64), "n": n})


def extend(blocks_: DataFrame, hot: Hot, level: int, least: int) -> list[tuple[str, int, int]]:
    """(lang, key, n) of the extended prefixes that must be extended again: over ``least`` suffixes each."""
    counted = blocks_.mapInArrow(lambda b: _extensions(b, hot, level), "lang string, key bigint, n bigint")
    return [tuple(r) for r in counted.groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("n") > least).orderBy("key").collect()]


# -- subtrees -------------------------------------------------------------------------------

def _mixed(*words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words[0]), dtype=np.uint64)
    for w in words:
        h = mix64(h + w + np.uint64(0x9E3779B97F4A7C15))
    return h


def _route(batches, hot: Hot, groups: int):
    """(grp, depth, lang, suffixes): each block's suffixes sorted and counted, group by group of their prefix."""
    for lang, grp, _, words in _each_block(batches):
        depth = np.ones(len(grp), dtype=np.int64)
        spread = grp < 0
        depth[spread] = 2
        if len(hot.pairs):
            known, has_three = hot.triple_keys(words)
            below = spread & hot.find(hot.pairs, words[0] << _BOTH | words[1])[1]
            depth[below] = 3
            if len(hot.triples):
                depth[below & has_three & hot.find(hot.triples, known)[1]] = 4
        full = np.ones(len(grp), dtype=bool)
        for d in (2, 3, 4):
            here = depth == d
            grp = np.where(here, (_mixed(*words[:d]) % np.uint64(groups)).astype(np.int64), grp) if here.any() else grp
            full &= ~here | (words[d - 1] > 0)  # what ends at its own prefix is counted by that prefix
        lot = (grp << 3 | depth)[full]
        a, b = (words[0] << _BOTH | words[1])[full], (words[2] << _BOTH | words[3])[full]
        order = np.lexsort((b, a, lot))
        lot, a, b = lot[order], a[order], b[order]
        first = run_starts(lot, a, b)
        n = np.diff(np.append(first, len(a))).astype(np.uint32)
        lot, a, b = lot[first], a[first], b[first]
        cuts = run_starts(lot)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(a)), strict=True):
            step = a[lo:hi].copy()
            step[1:] -= a[lo:hi - 1]
            yield pa.RecordBatch.from_pydict({"grp": [int(lot[lo]) >> 3], "depth": pa.array([int(lot[lo]) & 7], pa.int32()), "lang": [lang],
                                              "suffixes": [pack(step, b[lo:hi], n[lo:hi])]})


def subtree(parts: list[bytes], depth: int, min_count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """((words of a node, one column each), counts) of the nodes from two words, and from ``depth`` words, down."""
    columns = [unpack(p, "<u8", "<u8", "<u4") for p in parts]
    a = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in columns])
    b, n = (np.concatenate([c[i] for c in columns]) for i in (1, 2))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order].astype(np.int64)
    for words in range(max(2, depth), MAX_WORDS + 1):
        tail = b >> (_BOTH * np.uint64(MAX_WORDS - words)) if words > 2 else None
        keep = slice(None) if words == 2 else (tail & np.uint64(0xFFFFFFFF)) > 0
        keys = [a[keep]] if words == 2 else [a[keep], tail[keep]]
        if not len(keys[0]):
            continue
        first = run_starts(*keys)
        total = np.add.reduceat(n[keep], first)
        often = total >= min_count
        at = first[often]
        halves = [k[at] for k in keys]
        nodes = [halves[0] >> _BOTH, halves[0] & np.uint64(0xFFFFFFFF)]
        nodes += [] if words == 2 else [halves[1]] if words == 3 else [halves[1] >> _BOTH, halves[1] & np.uint64(0xFFFFFFFF)]
        yield np.stack(nodes, axis=1).astype(np.int64), total[often]


def _build(batches, min_count: int):
    def nodes(key, parts):
        for ids, f in subtree(parts, key[1], min_count):
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * ids.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([key[2]] * len(f), pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.reshape(-1))),
                                              pa.array(f)], ["lang", "ids", "f"])

    key, parts = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if row[:3] != key:
                if parts:
                    yield from nodes(key, parts)
                key, parts = row[:3], []
            parts.append(row[3].as_py())
    if parts:
        yield from nodes(key, parts)


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, budget: int = BUDGET, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((lang, ids, f) of the phrases of 2 to 4 words at ``min_count`` or more, frequent words with their numbers, n per lang)."""
    spark = docs.sparkSession
    tokens = token_blocks(docs, block_bytes)
    words = materialize(word_table(tokens), "phrase-vocabulary")
    langs = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.filter(F.col("f") >= min_count).agg(F.sum("f")).first()[0] or 0
    budget = max(budget, -(-total // MAX_GROUPS))
    least = hot_count(min_count, budget)
    frequent = materialize(group_words(words, min_count, budget), "phrase-words")
    numbered = materialize(numbered_blocks(tokens, frequent), "phrase-numbered")
    groups = max(1, -(-total // budget))
    hot, above = Hot(), []
    if frequent.filter("grp < 0").limit(1).count():
        pairs = extend(numbered, hot, 2, least)
        hot = Hot(np.array([p[1] for p in pairs], dtype=np.int64).view(np.uint64))
        half = lambda key: [key >> 32, key & 0xFFFFFFFF]
        above += [(lang, half(key), n) for lang, key, n in pairs]
        if pairs:
            triples = extend(numbered, hot, 3, least)
            hot = Hot(hot.pairs, np.array([t[1] for t in triples], dtype=np.int64).view(np.uint64))
            above += [(lang, half(pairs[key >> 32][1]) + [key & 0xFFFFFFFF], n) for lang, key, n in triples]
    sent = numbered.mapInArrow(lambda b: _route(b, hot, groups), "grp bigint, depth int, lang string, suffixes binary")
    parts = max(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grouped = sent.repartition(parts, "grp").sortWithinPartitions("grp", "depth", "lang")
    nodes = grouped.mapInArrow(lambda b: _build(b, min_count), "lang string, ids array<bigint>, f bigint")
    if above:
        nodes = nodes.unionByName(spark.createDataFrame(above, "lang string, ids array<bigint>, f bigint"))
    return materialize(nodes, "phrase-nodes"), frequent, langs


# -- scores -----------------------------------------------------------------------------------

def _wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def scored(nodes: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, score) of the candidates that stand in no longer one of nearly their count."""
    longer = nodes.filter(F.size("ids") > 2)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("ids") - n + 1), lambda at: F.slice("ids", at, n))))
    around = longer.select(F.explode(spans).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("around"))
    own = nodes.join(around, "ids", "left").filter(
        F.col("around").isNull() | (_wide(F.col("around")) * 100 < _wide(F.col("f")) * INSIDE_PERCENT))
    cuts = own.select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("slice(ids, 1, k)")).withColumn("rest", F.expr("slice(ids, k + 1, size(ids) - k)"))
    parts = nodes.select("ids", "f").unionByName(frequent.select(F.array("id").alias("ids"), "f"))
    cuts = cuts.join(parts.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first")
    cuts = cuts.join(parts.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr(f"(CAST(a AS decimal(20,0)) * {SCALE}) div (l + r)").cast("bigint")
    best = cuts.groupBy("lang", "ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")


def _first_rows(rows: DataFrame, keep: int, *order) -> DataFrame:
    """The first ``keep`` rows of each language with their rank, cut in 64 lots before a language meets in one task."""
    lot = Window.partitionBy("lang", "lot").orderBy(*order)
    few = rows.withColumn("lot", F.pmod(F.xxhash64("ids"), F.lit(64))).withColumn("rank", F.row_number().over(lot)).filter(F.col("rank") <= keep)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= keep).drop("lot")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, keep: int = KEEP, budget: int = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    nodes, frequent, langs = phrase_counts(docs, min_count, budget, block_bytes)
    rows = materialize(scored(nodes, frequent), "phrase-scored")
    best = (F.col("score").desc(), F.col("a").desc())
    last = _first_rows(rows, keep, *best, "ids").groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    # only what can still be among the first is spelt; equal scores and counts all stay for the phrase to decide
    near = rows.join(sized_broadcast(last), "lang").filter(F.struct("score", "a") >= F.col("last")).drop("last")
    spelt = near.select("ids", F.posexplode("ids").alias("place", "id")).join(frequent.select("id", "word"), "id").groupBy("ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ranked = _first_rows(near.join(spelt, "ids"), keep, *best, "phrase")
    return ranked.join(langs, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
