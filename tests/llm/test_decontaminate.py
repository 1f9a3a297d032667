import hashlib
import re

from llm_helpers import by_id
from linkloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, items, n=13):
    out = []
    for doc_id, text in rows:
        w, hit, ids = WORD.findall(lower(text)), set(), set()
        for item_id, item in items:
            v = WORD.findall(lower(item))
            size = min(n, len(v))
            wins = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
            for i in range(len(w) - size + 1):
                if size and tuple(w[i:i + size]) in wins:
                    hit.update(range(i, i + size))
                    if item_id is not None:
                        ids.add(str(item_id))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda t: [(x is not None, str(type(x)), x if x is not None else 0) for x in t])


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def items_of(odd_rows):
    texts = {i: t for i, t, *_ in odd_rows if t}
    w = texts[8].split()
    return [(1, " ".join(w[100:130])), (2, "One, TWO!"), (10, texts[9][:200]), (10, texts[9][:200]), (None, texts[13]), (4, None), (5, "..."), (7, "never seen anywhere")]


def test_report_equals_brute_force_on_odd_rows(spark, odd_docs, odd_rows):
    items = items_of(odd_rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute([r[:2] for r in odd_rows], items)
    assert by_id(D.contamination(odd_docs, bench), *COLS) == expected
    # so small a group that the documents pass once for each item
    assert by_id(D.contamination(odd_docs, bench, group_bytes=1), *COLS) == expected


def test_kept_rows_are_the_clean_ones_with_all_columns(spark, odd_docs, odd_rows):
    items = items_of(odd_rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    clean = [r[0] for r, b in zip(odd_rows, [brute([r[:2]], items)[0] for r in odd_rows]) if not b[-1]]
    for size in (1, 1 << 20):
        kept = D.remove_contaminated(odd_docs, bench, group_bytes=size)
        assert kept.columns == odd_docs.columns
        assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, clean))


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contamination(odd_docs, none).filter("contaminated OR n_hit > 0").count() == 0
    assert D.contamination(no_docs, none).count() == 0
    assert D.remove_contaminated(odd_docs, none).count() == odd_docs.count()
