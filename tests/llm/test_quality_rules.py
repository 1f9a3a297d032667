import re

import numpy as np
from llm_helpers import by_id
from linkloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = {}
    for x in wins:
        seen[x] = seen.get(x, 0) + 1
    rep = {p for i, x in enumerate(wins) if seen[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))


def test_base_counts_equal_brute_force(spark, odd_docs, odd_rows):
    expected = sorted(((r[0], *base(r[1])) for r in odd_rows), key=lambda t: [(x is not None, str(type(x)), x if x is not None else 0) for x in t])
    assert by_id(Q.quality_rules(odd_docs), *COLS) == expected


def line_rows():
    rows, body = [], " ".join(f"w{i}" for i in range(30))
    for i in range(60):
        own = " ".join(f"own{i}x{j}" for j in range(40))
        rows.append((i, f"Shared LINE of this host\n{own}", "en", "h", 1))
    rows.append((100, "shared  line of this host\n" * 2 + " ".join(f"t{j}" for j in range(10)), "en", "h", 1))  # 10 words left
    rows.append((101, "shared line of this host\n" + body, "en", None, 1))  # another host
    rows += [(200 + i, body + " copy", "en", "h", 1) for i in range(50)]  # exact copies are one document
    return rows


def test_boilerplate_is_counted_per_host_in_distinct_documents(spark):
    docs = spark.createDataFrame(line_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in Q.quality_rules(docs, min_docs=20, share=0.1).collect()}
    assert got[0].kept and got[0].words_left == 40 and got[0].lines_removed == 1
    assert not got[100].kept and got[100].words_left == 10 and got[100].lines_removed == 2
    assert got[101].kept and got[101].lines_removed == 0
    assert all(got[200 + i].kept for i in range(50))
    kept = Q.filter_documents(docs, min_docs=20, share=0.1)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_filter_keeps_columns_and_repeated_rows(spark, odd_docs, no_docs):
    rules = Q.quality_rules(odd_docs)
    kept = Q.filter_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert by_id(kept, "doc_id", "source") == by_id(rules.filter("kept"), "doc_id", "source")
    assert Q.quality_rules(no_docs).count() == 0 and Q.filter_documents(no_docs).count() == 0


def thue_morse(order):
    word = "a"
    for _ in range(order):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_different_lines_that_sums_of_powers_hash_alike(spark):
    for order in (10, 11, 12):
        a, b = thue_morse(order)
        seven = " x y z u v w s"
        rows = [(1, f"{a}\n{b}\n"), (2, f"{a}\n{a}\n"), (3, a + seven + " " + b + seven), (4, a + seven + " " + a + seven)]
        got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in Q.quality_rules(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")).collect()}
        assert got == {1: (0, 0), 2: (1, 0), 3: (0, 0), 4: (0, 16)}


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    rng = np.random.default_rng(2)
    codes, doc = rng.integers(0, 3, 300), np.repeat(np.arange(3), 100)
    at = np.array([i for i in range(293) if doc[i] == doc[i + 7]])
    key = lambda i: (doc[i], *codes[i:i + 8])
    want = [sum(key(i) == key(j) for j in at) > 1 for i in at]
    assert Q.repeated_windows(codes, doc, at, 8).tolist() == want
    monkeypatch.setattr(Q, "mix64", lambda h: h & np.uint64(1))
    assert Q.repeated_windows(codes, doc, at, 8).tolist() == want
