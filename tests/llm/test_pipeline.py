"""Each stage on its own input, and the whole pipeline on the small table."""

import zlib

import numpy as np
import pytest
from test_decontaminate import brute as brute_hits
from test_mixing import reference_mix, size
from test_quality_rules import base
from test_simhash import brute_components, brute_print

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_order_and_names():
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixture", "token records"]
    assert pipeline.ORACLE_SQL is None


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    from linkloom.session import materialize

    for docs in (odd_docs, no_docs):
        for name, stage in pipeline.STAGES:
            out = materialize(stage(spark, docs, SF), "test-stage")
            if name != "token records":
                assert out.columns == docs.columns
                docs = out
        assert out.count() == docs.count()


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    from linkloom.llm.queries import tokenizer_path

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    # 200 documents over 20 hosts: no line can be in 20 documents of its host, so the base rules decide
    rows = [r for r in rows if not base(r[1])[-1]]
    comp, _ = brute_components([r[0] for r in rows], [brute_print(r[1]) for r in rows])
    rows = [r for r, c in zip(rows, comp, strict=True) if r[0] == c]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute_hits([r[:2] for r in rows], items) if r[-1]}
    rows = [r for r in rows if r[0] not in hit]
    times = reference_mix(rows)
    t = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for (i, text, _), n in sorted(zip(rows, times, strict=True)):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        for _ in range(n):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((tuple(r) for r in pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == want and len(want) > 50 and sum(size(r[1]) for r in rows) > 0
