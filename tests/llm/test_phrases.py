import random
from collections import Counter

import numpy as np
import pytest
from linkloom.llm import phrases as P

CUTS = ".,;:!?\n\v\f\r"


def pieces(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in CUTS:
        low = low.replace(c, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in low.split("\n")]


def brute(rows, least, keep):
    """Expected rows of (lang, text) pairs, by counting every phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i:i + size])] += 1
    often = {g: c for g, c in f.items() if len(g[1]) > 1 and c >= least}
    out = []
    for (lang, g), a in often.items():
        inside = any(100 * often[lang, h] >= 80 * a for (o, h) in often if o == lang and len(h) > len(g)
                     and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)))
        if inside:
            continue
        cuts = []
        for k in range(1, len(g)):
            left, right = f[lang, g[:k]], f[lang, g[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(g), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:keep]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "naïve", "Ω x", "THE"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n"]) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((i, rng.choice([None, text, text + " the same old phrase again", text]), rng.choice(["en", "en", "en", "fr", None, "und"])))
    return rows + [(n, "hot hot hot " * 500, "en"), (n + 1, "", "en"), (n + 2, " .,", "xx")]


@pytest.mark.parametrize("budget", [P.BUDGET, 400, 80])
def test_phrases_equal_brute_force_at_any_memory_budget(spark, budget):
    rows = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    found = P.collocations(docs, min_count=10, keep=40, budget=budget, block_bytes=3000)
    assert got(found) == brute([(r[2], r[1]) for r in rows], 10, 40)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert got(P.collocations(odd_docs, min_count=3, budget=64, block_bytes=1000)) == brute([(r[2], r[1]) for r in odd_rows], 3, 2000)
    assert P.collocations(no_docs).count() == 0


def test_words_of_a_block():
    text = "A b,c  d\te.\n\nf. A b".lower().encode()
    words, seq = P.number_words(np.frombuffer(text, np.uint8), np.array([0, 3, 3, len(text)]))
    names = [None, *words.to_pylist()]
    assert [names[i] for i in seq] == [None, "a", "b", None, "c", "d", "e", None, "f", None, "a", "b"]
    assert [x.tolist() for x in P.unpack(P.pack(seq, np.arange(len(seq), dtype=np.uint64)), "<i4", "<u8")] == [seq.tolist(), list(range(len(seq)))]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    nodes = spark.createDataFrame([("en", [1, 2], big)], "lang string, ids array<bigint>, f bigint")
    words = spark.createDataFrame([(1, big + 1), (2, big + 7)], "id bigint, f bigint")
    (row,) = P.scored(nodes, words).collect()
    assert row["score"] == 2_000_000 * big // (2 * big + 8)
