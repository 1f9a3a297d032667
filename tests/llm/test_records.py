import random
import zlib

import numpy as np
import pytest
from llm_helpers import prose
from linkloom.llm import records as R
from linkloom.llm.queries import tokenizer_path

ODD = ["a  b", " lead", "trail ", "x\n\ny z", "tab\there", "it's we'll I'm", "Ünïcödé façade  nbsp  em", "1234 5678 9", "!!! ??? ...", "<|endoftext|> a <|endoftext|>",
       "a \n b", "", " ", "  ", "\n", "emoji 😀 here", "word\u0085next \x1c y", "中文 分词 test", "x" * 300 + " " + "y" * 100]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_units_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    rng = random.Random(1)
    pieces = list("ab'sé1 \n\t.,! ") + ["  ", " \n", "'ll", "the", " of"]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    for units in (1 << 20, 3):
        monkeypatch.setattr(R, "CACHE_UNITS", units)
        encoder = R.Encoder(tokenizer_path())
        for lo in range(0, len(texts), 50):
            part = texts[lo:lo + 50]
            got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder(part, 2)]
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in part]


def test_files_hold_all_documents_in_order(spark, odd_docs, odd_rows, tokenizer, tmp_path, no_docs):
    manifest = R.write_records(odd_docs, tokenizer_path(), str(tmp_path / "out")).cache()
    want = sorted(((i is not None, i or 0, t or "") for i, t, *_ in odd_rows))
    want = [(i if some else None, tokenizer.encode(t, add_special_tokens=False).ids + [2]) for some, i, t in want]
    files = [r["path"] for r in manifest.orderBy("part").collect()]
    held = [(i, ids.tolist()) for f in files for i, ids in R.scan_file(f, chunk=1000)]
    assert [i for i, _ in held] == [i for i, _ in want]
    assert sorted(map(str, held)) == sorted(map(str, want))
    rows = sorted(R.read_records(manifest).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, ids) in zip(rows, held, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    in_file = [(i, ids.tolist()) for i, ids in R.scan_file(files[0])]
    order = list(range(len(in_file)))[::-1]
    assert [(i, ids.tolist()) for i, ids in R.read_at(files[0], order)] == in_file[::-1]
    assert R.encode_and_read(no_docs, tokenizer_path()).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, prose(random.Random(2), 30))], "doc_id bigint, text string")
    path = R.write_records(df, tokenizer_path(), str(tmp_path)).first()["path"]
    good = open(path + ".rec", "rb").read()
    for at in (0, 9, 20, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        open(path + ".rec", "wb").write(bytes(bad))
        with pytest.raises(R.BadRecord):
            list(R.scan_file(path))
    open(path + ".rec", "wb").write(good[:-1])
    with pytest.raises(R.BadRecord):
        list(R.scan_file(path))


def test_names_of_added_tokens_are_encoded_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\nword <|endoftext|>. <|endoftext", "a b", *ODD]
    want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 2]
    encoder = R.Encoder(tokenizer_path(), names_are_text=False)
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder(texts, 2)] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    rows = sorted(R.encode_and_read(df, tokenizer_path(), str(tmp_path / "out")).collect())
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in want]
    # a name with a space in it, which units could make when they are learnt together
    plain.add_tokens(["b c"])
    path = str(tmp_path / "spaced.json")
    plain.save(path)
    encoder = R.Encoder(path, names_are_text=False)
    texts = ["b x", "c b", "a b c", "b", "c"]
    assert [np.frombuffer(x, encoder.dtype).tolist()[:-1] for x in encoder(texts, 2)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
