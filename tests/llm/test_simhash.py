import random

import numpy as np
import xxhash
from llm_helpers import by_id, prose
from linkloom.llm import simhash as S


def brute_print(text):
    w = [x.encode() for x in (text or "").translate({i: i + 32 for i in range(65, 91)}).split(" ")]
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, bits=4):
    group = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (prints[i] ^ prints[j]).bit_count() <= bits and group[j] > group[i]:
                    group[j], changed = group[i], True
    least = {}
    for i, g in zip(ids, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in group], group


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components_on_odd_rows(odd_docs, odd_rows, no_docs):
    prints = [brute_print(r[1]) for r in odd_rows]
    comp, _ = brute_components([r[0] for r in odd_rows], prints)
    expected = sorted(((r[0], signed(p), c) for r, p, c in zip(odd_rows, prints, comp)), key=lambda t: [(x is not None, str(type(x)), x if x is not None else 0) for x in t])
    assert by_id(S.near_duplicates(odd_docs), "doc_id", "fp", "component_id") == expected
    assert S.near_duplicates(no_docs).count() == 0 and S.keep_one(no_docs).count() == 0


def test_one_of_each_component_stays(odd_docs, odd_rows):
    prints = [brute_print(r[1]) for r in odd_rows]
    _, group = brute_components([r[0] for r in odd_rows], prints)
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert len(rows) == len(set(group))
    least = {}
    for r, g in zip(odd_rows, group):
        least.setdefault(g, []).append(r[0])
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(min((x for x in v if x is not None), default=None)) for v in least.values())


def test_no_link_is_lost_at_the_limit(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = set(seeds) | {0}
    for s in seeds:  # chains and clouds at exactly up to five bits
        x = s
        for _ in range(12):
            flip = rng.sample(range(64), rng.choice([1, 2, 3, 4, 4, 4, 5, 6]))
            y = x
            for b in flip:
                y ^= 1 << b
            prints.add(y)
            x = rng.choice([x, y])
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    for run_rows in (64, 1 << 20):
        found = {(r.src % 2**64, r.dst % 2**64) for r in S.links(df, run_rows=run_rows).collect()}
        a, b = (np.array(x, dtype=np.uint64) for x in zip(*found))
        nodes, roots = S.forest(a, b)
        root = dict(zip(nodes.tolist(), roots.tolist()))
        _, group = brute_components(list(range(len(prints))), prints)
        got = [root.get(p, p) for p in prints]
        assert {tuple(i for i, x in enumerate(got) if x == g) for g in set(got)} == {tuple(i for i, x in enumerate(group) if x == g) for g in set(group)}


def test_common_prose_stays_apart(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, prose(rng, 80)) for i in range(50)], "doc_id bigint, text string")
    assert S.keep_one(df).count() == 50


def test_a_key_of_many_fingerprints_is_cut_into_blocks(spark):
    from linkloom.operators.graph import connected_components

    rng, fps = random.Random(8), set()
    base = rng.getrandbits(64)
    while len(fps) < 300:  # a family that shares most of its keys
        fps.add(base ^ sum(1 << b for b in rng.sample(range(22), 3)))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    most = S.variant_index(df, 4, 20).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert most <= 80 < S.variant_index(df, 4, 1 << 20).groupBy("key").count().agg({"count": "max"}).first()[0]
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                parent[find(a)] = find(b)
    want = {frozenset(y for y in signed if find(y) == r) for r in {find(x) for x in signed}}
    for block in (20, 1 << 20):
        comp = {r["v"]: r["comp"] for r in connected_components(S.links(df, 4, block_rows=block)).collect()}
        assert {frozenset(y for y in signed if comp.get(y, y) == r) for r in {comp.get(x, x) for x in signed}} == want
