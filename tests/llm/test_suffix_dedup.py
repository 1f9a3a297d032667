import hashlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import by_id
from linkloom.llm import suffix_array as A
from linkloom.llm import suffix_dedup as D
from linkloom.llm import textblocks as T


def texts(rng, n):
    """Byte strings of few letters with long repeats."""
    x = rng.integers(97, 97 + int(rng.integers(1, 5)), n).astype(np.uint8)
    return np.tile(x[:max(1, n // 3)], 3) if rng.random() < 0.4 else x


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        x, depth = texts(rng, int(rng.integers(1, 300))), int(rng.integers(8, 60))
        sa, opens = A.suffix_array(x, depth)
        b = x.tobytes()
        assert [b[i:i + depth] for i in sa] == sorted(b[i:i + depth] for i in range(len(b)))
        lcp = A.common_prefixes(x, sa, opens, depth)
        for k in range(1, len(b)):
            p, q, m = b[sa[k - 1]:], b[sa[k]:], 0
            while m < min(len(p), len(q), depth) and p[m] == q[m]:
                m += 1
            assert lcp[k] == m and opens[k] == (m < depth)


def covered(docs, length):
    first = {}
    for d, t in docs:
        for i in range(len(t) - length + 1):
            if d is not None:
                first[t[i:i + length]] = min(d, first.get(t[i:i + length], d))
    out = []
    for d, t in docs:
        c = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if d is not None and first[t[i:i + length]] < d:
                c[i:i + length] = True
        out.append(c)
    return out


@pytest.mark.parametrize("common", [False, True])
def test_buckets_shards_and_blocks_find_every_repeat(common):
    rng = np.random.default_rng(int(common))
    for _ in range(60):
        base = [texts(rng, int(rng.integers(1, 150))).tobytes() for _ in range(4)]
        docs = [(None if rng.random() < 0.1 else int(rng.integers(-3, 6)), b"".join(base[int(rng.integers(0, 4))][int(rng.integers(0, 30)):] for _ in range(int(rng.integers(0, 4)))))
                for _ in range(int(rng.integers(1, 12)))]
        length, run = int(rng.choice([12, 20, 50])), int(rng.choice([4, 8, 10]))
        column = pa.array([t.decode() for _, t in docs])
        keys = np.unique(np.concatenate([D.cut_pieces(b, length, run)[3] for b in T.blocks(column)] or [np.empty(0, np.uint64)]))[::2] if common else np.empty(0, np.uint64)
        ids, known = np.array([d or 0 for d, _ in docs]), np.array([d is not None for d, _ in docs])
        buckets, gone = {}, []
        for b in T.blocks(column, int(rng.choice([50, 300, 10**6]))):
            part = slice(b.first, b.first + len(b))
            rows, now = D.block_pieces(b, ids[part], np.arange(len(docs))[part], known[part], keys, 3, length, run, b"sample of text")
            gone.append(now)
            for k, x in rows:
                buckets.setdefault(k, []).append(x)
        gone += [D.bucket_repeats(x, length, run, int(rng.choice([60, 200, 10**6])), b"sample of text") for x in buckets.values()]
        got = [np.zeros(len(t), bool) for _, t in docs]
        for part in gone:
            for i, tag, start, end in zip(*part, strict=True):
                got[tag][start:end] = True
                assert docs[tag][0] == i
        assert all((a == b).all() for a, b in zip(got, covered(docs, length), strict=True))


def test_copies_of_a_piece_are_not_sorted(monkeypatch):
    """Equal pieces of many blocks: all but those of the smallest doc_id go as they are; rows of one doc_id keep theirs."""
    rng = np.random.default_rng(8)
    shared = rng.integers(97, 123, 3000).astype(np.uint8).tobytes()
    docs = [(i, bytes([48 + i]) * 9 + shared) for i in (4, 2, 2, 7, 5, 9)] + [(8, shared[40:100] + b"0123456789" * 6)]
    buckets, out, sorted_bytes, classes = {}, [], [], A.classes
    for tag, (i, t) in enumerate(docs):
        block = T.Block(0, np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        rows, now = D.block_pieces(block, np.array([i]), np.array([tag]), np.array([True]), np.empty(0, np.uint64), 3)
        out.append(now)
        for k, x in rows:
            buckets.setdefault(k, []).append(x)
    monkeypatch.setattr(A, "classes", lambda text, *rest: sorted_bytes.append(len(text)) or classes(text, *rest))
    out += [D.bucket_repeats(x) for x in buckets.values()]
    got = [np.zeros(len(t), bool) for _, t in docs]
    for part in out:
        for _, tag, start, end in zip(*part, strict=True):
            got[tag][start:end] = True
    assert all((a == b).all() for a, b in zip(got, covered(docs, 50), strict=True)) and got[0].sum() == 3000 and not got[1].any()
    assert 0 < sum(sorted_bytes) < 3000  # the pieces at the ends of what is shared


COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def expected(rows):
    docs = [(i, (t or "").encode()) for i, t, *_ in rows]
    out = []
    for (i, t), c in zip(docs, covered(docs, 50), strict=True):
        spans = int((np.diff(np.concatenate([[False], c]).astype(int)) == 1).sum())
        out.append((i, len(t), int(c.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~c].tobytes()).hexdigest()))
    return sorted(out, key=lambda t: [(x is not None, str(type(x)), x if x is not None else 0) for x in t])


def test_odd_rows(odd_docs, odd_rows, no_docs, monkeypatch):
    assert by_id(D.removed_spans(odd_docs), *COLS) == expected(odd_rows)
    monkeypatch.setattr(D, "SAMPLE_OF", 1)  # every run of bytes that three documents hold counts as common
    monkeypatch.setattr(D, "COMMON_DOCS", 3)
    assert by_id(D.removed_spans(odd_docs, shard_bytes=500), *COLS) == expected(odd_rows)
    assert D.removed_spans(no_docs).count() == 0


def test_query_on_the_small_table_equals_brute_force(spark):
    from linkloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert by_id(QUERIES["op2_suffix_dedup"](spark, sf), *COLS) == expected(rows)


@pytest.mark.parametrize("unit", ["a", "=-", "All rights reserved. Licensed under the terms of this notice, which repeats. "])
def test_long_repetitive_texts(spark, unit):
    n = 30_000
    long = unit * (n // len(unit))
    texts = [(1, long), (2, long + "a tail of its own that no other document has, at the end"), (3, "x" * 60 + long[: n // 3]), (4, unit * 3)]
    got = {r.doc_id: r for r in D.removed_spans(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    seen = set()
    for doc_id, text in texts:
        data = text.encode()
        starts = [i for i in range(len(data) - 49) if data[i:i + 50] in seen]
        seen.update(data[i:i + 50] for i in range(len(data) - 49))
        gone = np.zeros(len(data) + 1, dtype=int)
        np.add.at(gone, starts, 1)
        np.add.at(gone, np.array(starts, dtype=int) + 50, -1)
        gone = np.cumsum(gone[:-1]) > 0
        assert got[doc_id].n_removed == gone.sum() and got[doc_id].n_spans == (np.diff(gone.astype(int), prepend=0) == 1).sum()


def test_a_repetitive_text_travels_as_few_pieces_and_long_ones_are_cut():
    data = np.frombuffer(b"a" * 200_000, np.uint8)
    block = T.Block(0, data, np.array([0, len(data)]))
    rows, _ = D.block_pieces(block, np.array([7]), np.array([0]), np.array([True]), np.empty(0, np.uint64), 64)
    assert len(rows) == 1 and len(rows[0][1]) < 1000
    cut = list(D._cut_long(T.Block(0, data, np.array([0, len(data)])), 50, 30_000))
    assert [at for at, _ in cut] == list(range(0, 199_951, 30_000)) and all(len(c.data) <= 30_049 for _, c in cut)


def test_evenly_spaced_rows_and_merged_intervals():
    rng = np.random.default_rng(5)
    for _ in range(100):
        piece = np.sort(rng.integers(0, 4, 40))
        start = np.concatenate([np.sort(rng.choice(60, (piece == p).sum(), replace=False)) for p in range(4)])
        rows = D.spaced_rows(piece, start)
        assert sorted((p, a + i * step) for p, a, step, n in rows.tolist() for i in range(n)) == sorted(zip(piece.tolist(), start.tolist()))
        end = start + rng.integers(1, 9, 40)
        got = D.merged_intervals(piece, piece * 0, start, end)
        cover = lambda p, a, b: {(x, i) for x, lo, hi in zip(p.tolist(), a.tolist(), b.tolist()) for i in range(lo, hi)}
        assert cover(got[0], got[2], got[3]) == cover(piece, start, end) and len(got[0]) <= 40
