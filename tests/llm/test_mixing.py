import hashlib
import math
import os
import random
import re
import subprocess
import sys

from llm_helpers import by_id, prose
from linkloom.llm import mixing as M
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights=(5, 2, 1), top=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        left, share = total - sum(top * sizes[s] for s in capped), sum(w[s] for s in names if s not in capped)
        target = {s: top * sizes[s] if s in capped else left * w[s] / share for s in names}
        more = {s for s in names if s not in capped and target[s] > top * sizes[s]}
        if not more:
            return target
        capped |= more
        if len(capped) == len(names):
            return {s: top * sizes[s] for s in names}


def size(text):
    return len(WORD.findall(text or ""))


def test_targets_equal_the_stated_resharing(spark):
    rng = random.Random(2)
    for _ in range(6):
        rows = [(i, prose(rng, rng.choice([0, 1, 5, 40, 200])), rng.choice("abcdefg") if rng.random() < 0.9 else None) for i in range(rng.choice([3, 40]))]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + size(t)
        want = water(sizes)
        for r in M.targets(M.sized(df)).collect():
            assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)


def reference_mix(rows, top=3):
    """Fair queueing as a plain loop over all finish times."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target, names = water(sizes), sorted(sizes, key=lambda s: (s is None, s or ""))
    place = lambda i: int(hashlib.md5(f"{M.SEED}-{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    times = []
    for rank, s in enumerate(names):
        sent = 0
        for k in sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (place(rows[k][0]), rows[k][0])):
            sent += size(rows[k][1])
            times += [((e * sizes[s] + sent) / target[s], rank, place(rows[k][0]), e, k) for e in range(top) if target[s]]
    run, n = 0, [0] * len(rows)
    for *_, k in sorted(times):
        run += size(rows[k][1])
        if run > sum(sizes.values()):
            break
        n[k] += 1
    return n


def test_mix_equals_plain_fair_queueing(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["a"] * 9 + ["b", "c", "d", None])) for i in range(700)]
    got = {r.doc_id: r for r in M.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)).collect()}
    times = reference_mix(rows)
    assert [got[i].times for i in range(700)] == times
    taken = {}
    for i, _, s in rows:
        taken[s] = taken.get(s, 0) + got[i].taken
        assert got[i].taken <= 3 * got[i].size
    for i, _, s in rows:
        assert abs(taken[s] - got[i].target) <= 60


def test_odd_rows_and_taken_documents(odd_docs, odd_rows, no_docs):
    mixed = M.mix(odd_docs).collect()
    assert sorted(r.size for r in mixed) == sorted(size(r[1]) for r in odd_rows)
    assert all(r.taken == r.times * r["size"] <= 3 * r["size"] for r in mixed)
    assert sum(r.taken for r in mixed) <= sum(r["size"] for r in mixed)
    taken = M.take(odd_docs)
    assert taken.columns == odd_docs.columns
    assert sum(size(r.text) for r in taken.collect()) == sum(r.taken for r in mixed)
    assert by_id(M.mix(odd_docs), "doc_id", "size", "taken") == by_id(M.mix(odd_docs.repartition(7)), "doc_id", "size", "taken")
    assert M.mix(no_docs).count() == 0 and M.take(no_docs).count() == 0


def test_words_are_counted_between_any_blanks(spark):
    rng = random.Random(8)
    odd = [None, "", " ", "\t\n\v\f\r ", "one", " one", "one ", "a  b", "a\t\tb", "a \t b\n\n\nc", "\x00 \x00", "a\u00a0b\u2028c\x85d\x1ce", "é 日本 😀😀 \n😀", " " * 999 + "x" + "\n " * 999]
    odd += ["".join(rng.choice(" \t\n\v\f\rab\x00\x08\x0eé😀") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string").select("doc_id", M.n_words(F.col("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in rows} == {i: None if t is None else size(t) for i, t in enumerate(odd)}


LONG_TEXT = """
from linkloom.llm.mixing import sized
from linkloom.session import build_session
spark = build_session("local[1]", 2)
print("words", sized(spark.sql("SELECT 1L doc_id, 'a' source, repeat('a ', 10000000) text")).first().size)
"""


def test_a_long_text_is_counted_in_few_times_its_memory():
    env = os.environ | {"LINKLOOM_DRIVER_MEMORY": "600m", "PYTHONPATH": os.path.dirname(os.path.dirname(M.__file__)) + "/.."}
    run = subprocess.run([sys.executable, "-c", LONG_TEXT], env=env, capture_output=True, text=True, timeout=150)
    assert "words 10000000" in run.stdout, run.stderr[-2000:]
