"""Quality network and pseudo-likelihood."""

import random
import zlib

import numpy as np
import pyarrow as pa
from llm_helpers import by_id, prose
from linkloom.llm import byte_cnn as B
from linkloom.llm import pseudo_likelihood as P
from linkloom.llm import textblocks as T


def plain_score(net, text):
    """The network on one text, chunk by chunk."""
    p, best = net.p, np.full(B.FILTERS, -np.inf)
    padded = text + b"\0" * B.WIDTH
    for at in range(0, max(1, len(text) - B.WIDTH + B.STEP), B.STEP):
        chunk = padded[at:at + B.WIDTH].ljust(B.WIDTH, b"\0")
        best = np.maximum(best, np.concatenate([p["byte"][c] for c in chunk]) @ p["conv"])
    hidden = np.maximum(np.maximum(best + p["bias"], 0) @ p["w1"] + p["b1"], 0)
    return 1 / (1 + np.exp(-(hidden @ p["w2"] + p["b2"])))


def column(texts):
    return pa.array([t.decode() for t in texts])


def test_blocks_and_runs_don_t_change_scores(monkeypatch):
    rng, net = random.Random(1), B.Network.fresh()
    texts = [prose(rng, n).encode()[:m] for n, m in ((1, 3), (5, 8), (5, 9), (5, 10), (5, 11), (200, 999), (1, 0), (400, 5000), (3, 17))]
    want = [float(plain_score(net, t)[0]) for t in texts]
    for run in (64, 500, B.RUN_BYTES):
        monkeypatch.setattr(B, "RUN_BYTES", run)
        for limit in (1, 400, 1 << 20):
            got = np.concatenate([net.score(b.data, b.offsets) for b in T.blocks(column(texts), limit)])
            np.testing.assert_allclose(got, want, rtol=1e-4)


def test_gradients():
    rng, net = random.Random(2), B.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y = [prose(rng, 12).encode() for _ in range(6)], np.array([0, 1, 1, 0, 1, 0.0])
    g = B._step(net, texts, y)

    def loss():
        p = net.score(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, grad in g.items():
        i = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        was, e = net.p[k][i], 1e-5
        net.p[k][i] = was + e
        up = loss()
        net.p[k][i] = was - e
        slope = (up - loss()) / (2 * e)
        net.p[k][i] = was
        assert abs(slope - grad[i]) < 1e-3 * max(1, abs(grad[i]))


def test_held_out_quality_on_the_tables(spark):
    from linkloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_byte_cnn"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    seen = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, y in seen if y], [s for s, y in seen if not y]
    assert np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_odd_rows_and_labels(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (9, 1, 0), (9, 1, 0), (16, 0, None), (3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = B.classify(odd_docs, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 12 or r.doc_id == 11}) == 1
    assert {r.score for r in B.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in B.classify(odd_docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert B.classify(no_docs, labels).count() == 0


def plain_log_probs(net, numbers):
    """Every word of one document with plain loops."""
    out, p, line = 0.0, net.p, [0] * P.SIDE + numbers + [0] * P.SIDE
    for i, w in enumerate(numbers):
        around = line[i:i + P.SIDE] + line[i + P.SIDE + 1:i + 2 * P.SIDE + 1]
        h = np.tanh(p["bias"] + sum(p["context"][o][c] for o, c in enumerate(around)))
        c, k = divmod(w, P.CLASS_WORDS)
        for z, pick in ((h @ p["class"] + p["class_bias"], c), (h @ p["word"][c] + p["word_bias"][c], k)):
            out += z[pick] - np.log(np.exp(z).sum())
    return out


def test_scores_are_sums_of_conditional_log_probabilities(spark, odd_docs, odd_rows):
    words = P.vocabulary(odd_docs)
    assert len(words.hashes) <= P.VOCABULARY - P.SHARED - 1 and len(set(words.numbers.tolist())) == len(words.numbers)
    net = P.warm_up(odd_docs, words)
    want = []
    for i, text, *_ in odd_rows:
        number, _, _ = P.windows(next(T.blocks(pa.array([text or ""]))), words)
        want.append((i, len(number), plain_log_probs(net, number.tolist())))
    got = sorted(P.score(odd_docs, words, net).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.sum_log_prob))
    want.sort(key=lambda t: (t[0] is None, t[0] or 0, t[2]))
    for r, (i, n, s) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_words) == (i, n) and abs(r.sum_log_prob - s) <= 1e-3 + 1e-4 * abs(s)
        assert r.mean_log_prob is None if not n else abs(r.mean_log_prob - s / n) < 1e-2


def test_gradients_of_the_window_network():
    rng = np.random.default_rng(3)
    net = P.Network({k: v.astype(np.float64) for k, v in P.Network.fresh().p.items()})
    number, context = rng.integers(0, P.VOCABULARY, 60), rng.integers(0, P.VOCABULARY, (60, 2 * P.SIDE))
    for k, grad in net.gradients(number, context).items():
        i = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        was, e = net.p[k][i], 1e-5
        net.p[k][i] = was + e
        up = -net.log_probs(number, context).mean()
        net.p[k][i] = was - e
        slope = (up + net.log_probs(number, context).mean()) / (2 * e)
        net.p[k][i] = was
        assert abs(slope - grad[i]) < 1e-5


def test_training_sees_all_documents_and_beats_unigrams(spark, no_docs):
    rng = random.Random(6)
    ring = [f"w{i}" for i in range(60)]  # each word is told by its neighbours

    def text(n):
        at = rng.randrange(60)
        return " ".join(ring[(at + i) % 60] for i in range(n))

    docs = spark.createDataFrame([(i, text(200)) for i in range(600)], "doc_id bigint, text string").repartition(4)
    words = P.vocabulary(docs)
    assert len(words.hashes) == 60
    rows = P.pseudo_likelihood(docs).collect()
    assert np.mean([r.mean_log_prob for r in rows]) > -np.log(60) / 2
    shuffled = spark.createDataFrame([(1, text(200)), (2, " ".join(rng.choice(ring) for _ in range(200)))], "doc_id bigint, text string")
    net = P.train(docs, words, P.warm_up(docs, words))
    got = {r.doc_id: r.mean_log_prob for r in P.score(shuffled, words, net).collect()}
    assert got[1] > got[2] + 1
    for a, b in zip(by_id(P.score(docs, words, net), "doc_id", "sum_log_prob"), by_id(P.score(docs.repartition(3), words, net), "doc_id", "sum_log_prob"), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-3
    assert P.pseudo_likelihood(no_docs).count() == 0


def test_vocabulary_grows_with_the_counted_corpus(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(2000))) for i in range(40)], "doc_id bigint, text string").repartition(3)
    words = P.vocabulary(docs)
    classes, width = words.shape
    assert len(words.hashes) == 2000 and classes > P.CLASSES and width > P.CLASS_WORDS
    number, _, _ = P.windows(next(T.blocks(pa.array([" ".join(f"w{j}" for j in range(2000))]))), words)
    assert len(set(number.tolist())) == 2000 and number.max() < words.first_length
    rng, net = np.random.default_rng(4), P.Network.fresh(shape=words.shape)
    context = rng.integers(0, classes * width, (1, 2 * P.SIDE))
    every = net.log_probs(np.arange(classes * width), np.repeat(context, classes * width, axis=0))
    assert abs(np.exp(every).sum() - 1) < 1e-3


def test_rare_words_are_spelt(spark):
    known = [f"k{i}" for i in range(P.LEAST_KNOWN)]
    rare = ["".join(a + b for a in "bdfgklmn" for b in "aeiou")[i:i + 6] for i in range(0, 70, 2)]
    rows = [(1, " ".join(known * 3)), (2, " ".join(rare)), (3, "bafefi"), (4, "xqzjvw"), (5, "bafefi"), (6, "y" * 63), (7, "y" * 64), (8, "y" * 65)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = P.vocabulary(docs.filter("doc_id = 1"))
    net = P.train(docs, words, P.warm_up(docs, words))
    got = {r.doc_id: r.sum_log_prob for r in P.score(docs, words, net).collect()}
    assert got[3] == got[5] and got[3] > got[4] + 1 and len({got[i] for i in (6, 7, 8)}) == 3
    # the spellings of one length share its probability
    block = next(T.blocks(pa.array(["".join(f"{chr(c)} " for c in (*range(48, 58), *range(97, 123)))])))
    found = block.words(block.lower, T.ALNUM)
    letters = np.exp(net.spelling.log_probs(found, np.arange(len(found.starts))))
    outside = (net.spelling.counts[:256] + P.SMOOTH) / (net.spelling.counts[:256] + P.SMOOTH).sum()
    assert abs(letters.sum() + outside.sum() - outside[[*range(48, 58), *range(97, 123)]].sum() - 1) < 1e-9


def test_softmaxes_are_taken_on_rows_that_fit_a_cache(monkeypatch):
    """No softmax sees more than TOGETHER words of several classes, and how many are taken at once changes nothing."""
    rng = np.random.default_rng(6)
    number, context = rng.permutation(np.arange(4000) % 512), rng.integers(0, 512, (4000, 2 * P.SIDE))
    net, seen = P.Network.fresh(), []
    for name in ("_log_softmax", "_softmax_error"):
        monkeypatch.setattr(P, name, lambda z, *rest, f=getattr(P, name): seen.append(z.shape) or f(z, *rest))
    scores, steps = net.log_probs(number, context), net.gradients(number, context)
    assert len(seen) < 40 and max(rows for rows, _ in seen) <= P.TOGETHER
    for rows in (1, 10_000):
        monkeypatch.setattr(P, "TOGETHER", rows)
        assert np.allclose(net.log_probs(number, context), scores, rtol=1e-6)
        again = net.gradients(number, context)
        assert all(np.allclose(again[k], steps[k], atol=1e-7) for k in steps)
    trained = []
    for values in (8, 1 << 20):
        monkeypatch.setattr(P, "VALUES_AT_ONCE", values)
        trainer = P.Trainer(P.Network.fresh())
        trainer.see(number, context)
        trained.append(trainer.net.flat())
    assert (trained[0] == trained[1]).all()
