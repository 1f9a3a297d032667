"""Language-model scoring by masked pseudo-likelihood.

A small network in numpy sees the ``SIDE`` words on either side of a masked
word and predicts it: position-wise word vectors are summed and squashed, one
softmax gives the word's class and a second one the word within its class.  A
document's score is the sum of the conditional log-probabilities of all its
words, each predicted from both sides.

All documents take part in training.  One pass counts every word.  Of N words
in all, those counted at least max(2, sqrt(N) / ``RARE``) times have numbers of
their own, and never fewer than the ``LEAST_KNOWN`` most frequent; classes and
words of a class grow with the square root of their number.  Any other word is
predicted by its length in bytes and then spelt: each byte given the one before
it, from the counts of all spelt words of all documents.

The network starts from a short warm-up on at most ``WARM_DOCS`` documents and
is then trained on every word of every partition side by side; the partitions'
parameters are averaged, weighted by their words, in one shuffle of blocks of
parameters.  Sums are of whole numbers, so runs over the same partitions agree
exactly.

Cases: a null or empty text, or one without words, has no words, sum 0 and no
mean; words of any length count once; repeated rows get equal scores; ties in
word counts go by the word's hash; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.sampling import few_rows
from linkloom.llm.textblocks import ALNUM, Block, Words, blocks
from linkloom.session import discard, materialize

SIDE, VECTOR = 2, 16
#: The least classes and words of a class, the numbers they make, and those of them for lengths of spelt words.
CLASSES, CLASS_WORDS = 16, 32
VOCABULARY, SHARED = CLASSES * CLASS_WORDS, 64
LEAST_KNOWN, RARE = VOCABULARY - SHARED - 1, 8
#: Added to the count of each pair of bytes.
SMOOTH = 0.5
BATCH, SCORE_BATCH, RATE, SEED = 4096, 16384, 0.01, 11
#: Words of neighbouring classes whose softmaxes are taken at once; they fit a core's cache.
TOGETHER = 512
#: Parameters of a large array that are moved at once, for the same reason.
VALUES_AT_ONCE = 1 << 14
WARM_DOCS, WARM_BYTES, WARM_PASSES = 512, 1 << 16, 2
#: Exponents up to this size need no care in 32 bits.
MAX_EXPONENT = 80.0
#: Distinct words a task holds before it passes their counts on.
HELD_WORDS = 1 << 20
#: Parameters are averaged as multiples of 2**-FRACTION.
FRACTION = 20
#: Parts of the table that are trained on side by side, at least (as far as it has so many partitions).
LEAST_SHARDS = 32
#: Parameters of one row of the shuffle, and words a task trains on for each parameter it sends.
BLOCK_VALUES, WORDS_PER_VALUE = 1 << 14, 4


def _shapes(classes: int, class_words: int) -> dict[str, tuple[int, ...]]:
    return {"context": (2 * SIDE, classes * class_words, VECTOR), "bias": (VECTOR,), "class": (VECTOR, classes), "class_bias": (classes,),
            "word": (classes, VECTOR, class_words), "word_bias": (classes, class_words)}


@dataclass
class Vocabulary:
    """Number 0 stands behind a document's ends, then come the frequent words; the last ones are the lengths of spelt words."""

    hashes: np.ndarray  # sorted
    numbers: np.ndarray

    @classmethod
    def of(cls, frequent: list[int] | np.ndarray) -> Vocabulary:
        """Hashes of the most frequent words, the most frequent first."""
        h = np.array(frequent, dtype=np.int64).view(np.uint64)
        order = np.argsort(h)
        return cls(h[order], (order + 1).astype(np.int32))

    @property
    def shape(self) -> tuple[int, int]:
        """(classes, words of a class)."""
        n = len(self.hashes) + 1 + SHARED
        width = max(CLASS_WORDS, isqrt(n - 1) + 1)
        return max(CLASSES, -(-n // width)), width

    @property
    def first_length(self) -> int:
        """The number of the length of one byte."""
        classes, width = self.shape
        return classes * width - SHARED

    def __call__(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = (np.minimum(lengths, SHARED) - 1 + self.first_length).astype(np.int32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.numbers[at[known]]
        # short numbers are sorted faster
        return out.astype(np.int16) if self.first_length + SHARED <= 1 << 15 else out


def _windows(words: Words, n_docs: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    number = vocabulary(words.hashes, words.ends - words.starts)
    at = np.arange(len(number)) + SIDE * (words.doc + 1)
    line = np.zeros(len(number) + SIDE * (n_docs + 1), dtype=number.dtype)
    line[at] = number
    return number, np.stack([line[at + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1) if len(at) else np.zeros((0, 2 * SIDE), number.dtype)


def windows(b: Block, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word's number, its context (words x 2 SIDE) and the first word of each document."""
    words = b.words(b.lower, ALNUM)
    return *_windows(words, len(b), vocabulary), words.first


class Spelling:
    """Counts of the pairs of bytes in spelt words, a word's first byte behind byte 0, and of the bytes beyond length SHARED."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros((1 << 16) + 2, np.int64) if counts is None else counts

    @staticmethod
    def _pairs(words: Words, spelt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of all bytes of the spelt words, each word's first pair, and its length."""
        starts, size = words.starts[spelt], words.ends[spelt] - words.starts[spelt]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(starts - first, size)
        pairs = words.data[at].astype(np.int64)
        before = words.data[at - 1].astype(np.int64) << 8
        before[first] = 0
        return pairs + before, first, size

    def see(self, words: Words, spelt: np.ndarray) -> None:
        pairs, _, size = self._pairs(words, spelt)
        self.counts[:-2] += np.bincount(pairs, minlength=1 << 16)
        long = size[size >= SHARED]
        self.counts[-2:] += (long - SHARED).sum(), len(long)

    def log_probs(self, words: Words, spelt: np.ndarray) -> np.ndarray:
        """Log-probability of each spelt word given the number of its length."""
        if not len(spelt):
            return np.zeros(0)
        table = self.counts[:-2].reshape(256, 256) + SMOOTH
        table = np.log(table / table.sum(axis=1, keepdims=True)).reshape(-1)
        pairs, first, size = self._pairs(words, spelt)
        out = np.add.reduceat(table[pairs], first)
        more, ends = self.counts[-2:] + SMOOTH
        return out + np.where(size >= SHARED, (size - SHARED) * np.log(more / (more + ends)) + np.log(ends / (more + ends)), 0.0)


class Network:
    """Parameters and the two passes of the network."""

    def __init__(self, p: dict[str, np.ndarray], spelling: Spelling | None = None):
        self.p, self.spelling = p, spelling or Spelling()

    @classmethod
    def fresh(cls, seed: int = SEED, shape: tuple[int, int] = (CLASSES, CLASS_WORDS)) -> Network:
        r = np.random.default_rng(seed)
        return cls({k: np.zeros(s, np.float32) if "bias" in k else (r.standard_normal(s) * VECTOR ** -0.5).astype(np.float32) for k, s in _shapes(*shape).items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    @classmethod
    def unflat(cls, values: np.ndarray, shape: tuple[int, int], spelling: Spelling | None = None) -> Network:
        out, at = {}, 0
        for k, s in _shapes(*shape).items():
            n = int(np.prod(s))
            out[k] = values[at:at + n].reshape(s).astype(np.float32)
            at += n
        return cls(out, spelling)

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        table = self.p["context"]
        x = table[0].take(context[:, 0], axis=0)
        x += self.p["bias"]
        for o in range(1, context.shape[1]):
            x += table[o].take(context[:, o], axis=0)
        return np.tanh(x, out=x)

    def _within(self, h: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
        """Exponents of the words of each row's class, for the rows of some neighbouring cuts."""
        first, weights, bias = cuts[0][1], self.p["word"], self.p["word_bias"]
        z = np.empty((cuts[-1][2] - first, weights.shape[2]), h.dtype)
        for c, lo, hi in cuts:
            rows = z[lo - first:hi - first]
            np.matmul(h[lo:hi], weights[c], out=rows)
            rows += bias[c]
        return z

    def _small(self) -> bool:
        """Whether no exponent of any context can overflow, so softmaxes needn't look for their greatest one."""
        reach = lambda w, b: float(np.abs(self.p[w]).max()) * VECTOR + float(np.abs(self.p[b]).max())
        return max(reach("word", "word_bias"), reach("class", "class_bias")) < MAX_EXPONENT

    def log_probs(self, number: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Log-probability of each number given its context."""
        p, h, small = self.p, self._hidden(context), self._small()
        kind, place = np.divmod(number, p["word"].shape[2])
        out, every = np.empty(len(number)), h @ p["class"]
        for lo in range(0, len(number), TOGETHER):
            z = every[lo:lo + TOGETHER]
            z += p["class_bias"]
            out[lo:lo + TOGETHER] = _log_softmax(z, kind[lo:lo + TOGETHER], small)
        order, cuts = _by_class(kind, len(p["word"]))
        h, place, within = h.take(order, axis=0), place[order], np.empty(len(order))
        for some in _together(cuts):
            lo, hi = some[0][1], some[-1][2]
            within[lo:hi] = _log_softmax(self._within(h, some), place[lo:hi], small)
        out[order] += within
        return out

    def steps(self, number: np.ndarray, context: np.ndarray) -> Iterator[tuple[str, object, np.ndarray]]:
        """Gradients of the mean negative log-probability: (parameter, rows of it, their gradient); all others are zero."""
        p, h, n, small = self.p, self._hidden(context), np.float32(len(number)), self._small()
        kind, place = np.divmod(number, p["word"].shape[2])
        order, cuts = _by_class(kind, len(p["word"]))
        h, kind, place, context = h.take(order, axis=0), kind[order], place[order], context.take(order, axis=0)
        d = h @ p["class"]
        for lo in range(0, len(d), TOGETHER):
            z = d[lo:lo + TOGETHER]
            z += p["class_bias"]
            _softmax_error(z, kind[lo:lo + TOGETHER], small)
        dh, class_step, class_bias = d @ p["class"].T, h.T @ d, d.sum(axis=0)
        seen = np.array([c for c, _, _ in cuts])
        word, word_bias = (np.empty((len(seen), *p[k].shape[1:]), p[k].dtype) for k in ("word", "word_bias"))
        back = np.empty_like(dh)
        i = 0
        for some in _together(cuts):
            first, end = some[0][1], some[-1][2]
            error = _softmax_error(self._within(h, some), place[first:end], small)
            for c, lo, hi in some:
                d = error[lo - first:hi - first]
                np.matmul(h[lo:hi].T, d, out=word[i])
                np.add.reduce(d, axis=0, out=word_bias[i])
                np.matmul(d, p["word"][c].T, out=back[lo:hi])
                i += 1
        dh += back
        yield "class", ..., class_step / n
        yield "class_bias", ..., class_bias / n
        word /= n
        word_bias /= n
        at = ... if len(seen) == len(p["word"]) else seen
        yield "word", at, word
        yield "word_bias", at, word_bias
        dx = dh * (1 - h * h) / n
        yield "bias", ..., dx.sum(axis=0)
        for o in range(context.shape[1]):
            order = np.argsort(context[:, o], kind="stable")
            ids = context[order, o]
            opens = np.flatnonzero(np.diff(ids, prepend=-1))
            yield "context", (o, ids[opens]), np.add.reduceat(dx.take(order, axis=0), opens, axis=0)

    def gradients(self, number: np.ndarray, context: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log-probability."""
        g = {k: np.zeros(v.shape, np.float32) for k, v in self.p.items()}
        for k, at, step in self.steps(number, context):
            g[k][at] = step
        return g


def _by_class(kind: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by class, and (class, first, end) of those that occur."""
    order = np.argsort(kind, kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(classes + 1)).tolist()
    return order, [(c, lo, hi) for c, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]


def _together(cuts: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Neighbouring cuts of about TOGETHER rows, whose softmaxes are taken at once."""
    some: list[tuple[int, int, int]] = []
    for cut in cuts:
        if some and cut[2] - some[0][1] > TOGETHER:
            yield some
            some = []
        some.append(cut)
    if some:
        yield some


def _picked(z: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Places of one value of each row in the flat values."""
    return np.arange(0, z.size, z.shape[1]) + pick


def _log_softmax(z: np.ndarray, pick: np.ndarray, small: bool) -> np.ndarray:
    if not small:
        z -= z.max(axis=1, keepdims=True)
    chosen = z.reshape(-1).take(_picked(z, pick))
    return chosen.astype(np.float64) - np.log(np.add.reduce(np.exp(z, out=z), axis=1))


def _softmax_error(z: np.ndarray, pick: np.ndarray, small: bool) -> np.ndarray:
    if not small:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= np.add.reduce(z, axis=1, keepdims=True)
    z.reshape(-1)[_picked(z, pick)] -= 1
    return z


class Trainer:
    """Adam over batches of BATCH words; a batch moves only the rows it touches."""

    def __init__(self, net: Network):
        self.net, self.t, self.words = net, 0, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def see(self, number: np.ndarray, context: np.ndarray) -> None:
        for lo in range(0, len(number), BATCH):
            self.t += 1
            self.words += len(number[lo:lo + BATCH])
            fix = np.float32((1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t) * RATE / (1 + self.t / 500) ** 0.5)
            for k, at, g in self.net.steps(number[lo:lo + BATCH], context[lo:lo + BATCH]):
                if at is ...:
                    rows = max(1, VALUES_AT_ONCE * len(g) // g.size)
                    for first in range(0, len(g), rows):
                        part = slice(first, first + rows)
                        self.net.p[k][part] -= self._moved(self.m[k][part], self.v[k][part], g[part], fix)
                else:
                    m, v = self.m[k][at], self.v[k][at]
                    step = self._moved(m, v, g, fix)
                    self.m[k][at], self.v[k][at] = m, v  # what is picked by number is a copy
                    self.net.p[k][at] -= step

    @staticmethod
    def _moved(m: np.ndarray, v: np.ndarray, g: np.ndarray, fix: np.float32) -> np.ndarray:
        """Both moments take in the gradient, in place, and it becomes the step."""
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        v *= np.float32(0.999)
        g *= g
        g *= np.float32(0.001)
        v += g
        np.sqrt(v, out=g)
        g += np.float32(1e-7)
        np.divide(m, g, out=g)
        g *= fix
        return g


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, n) of every word of all documents."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for b in blocks(batch.column(0), 2 << 20):
                held.append(np.unique(b.words(b.lower, ALNUM).hashes, return_counts=True))
                size += len(held[-1][0])
                if size > HELD_WORDS:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > HELD_WORDS // 2:
                        yield _count_rows(held.pop())
                        size = 0
        if held:
            yield _count_rows(_summed(held))

    return docs.select("text").mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    h, n = h[order], n[order]
    opens = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else order
    return h[opens], np.add.reduceat(n, opens) if len(h) else n


def _count_rows(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1], pa.int64())], ["hash", "n"])


def vocabulary(docs: DataFrame) -> Vocabulary:
    return _vocabulary(docs)[0]


def _vocabulary(docs: DataFrame) -> tuple[Vocabulary, int]:
    """The words with numbers of their own, about as many as the square root of all words, and the count of all words."""
    counts = materialize(word_counts(docs), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") >= max(2, isqrt(total) // RARE)).toArrow()
    if len(often) < LEAST_KNOWN:
        often = counts.orderBy(F.desc("n"), "hash").limit(LEAST_KNOWN).toArrow()
    h, n = (often[c].to_numpy() for c in ("hash", "n"))
    discard(counts)
    return Vocabulary.of(h[np.lexsort((h, -n))]), total


def warm_up(docs: DataFrame, words: Vocabulary, seed: int = SEED) -> Network:
    """The common start of all partitions: a few passes over at most WARM_DOCS documents."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(F.octet_length("text") <= WARM_BYTES, F.col("text")).alias("text"))
    some = few_rows(rows, WARM_DOCS, "doc_id", "text").collect()
    trainer = Trainer(Network.fresh(seed, words.shape))
    for _ in range(WARM_PASSES):
        for b in blocks(pa.array([r["text"] for r in some], pa.string())):
            number, context, _ = windows(b, words)
            trainer.see(number, context)
    return trainer.net


def train(docs: DataFrame, words: Vocabulary, start: Network, total: int = 0) -> Network:
    """Train on every word of every partition and average the partitions' parameters by their words.

    ``total``, the count of all words if known, bounds what is shuffled to a share of the input: partitions are
    joined so that a task trains on ``WORDS_PER_VALUE`` words for each parameter, but not to fewer than LEAST_SHARDS,
    however many cores there are.
    """
    sc = docs.sparkSession.sparkContext
    given = sc.broadcast((words, start.flat()))  # grows like the vocabulary, with the square root of the words
    texts = docs.select("text")
    if total:
        texts = texts.coalesce(max(LEAST_SHARDS, total // (WORDS_PER_VALUE * len(start.flat()))))
    schema = pa.schema([("block", pa.int32()), ("weight", pa.int64()), ("data", pa.binary())])

    def learn(batches):
        vocab, values = given.value
        trainer, spelling = Trainer(Network.unflat(values, vocab.shape)), Spelling()
        for batch in batches:
            for b in blocks(batch.column(0)):
                found = b.words(b.lower, ALNUM)
                number, context = _windows(found, len(b), vocab)
                trainer.see(number, context)
                spelling.see(found, np.flatnonzero(number >= vocab.first_length))
        if trainer.words:
            weight = trainer.words // 1024 + 1
            flat = np.rint(trainer.net.flat().astype(np.float64) * 2.0**FRACTION).astype(np.int32)
            for k, lo in enumerate(range(0, len(flat), BLOCK_VALUES)):
                yield pa.RecordBatch.from_pylist([{"block": k, "weight": weight, "data": flat[lo:lo + BLOCK_VALUES].tobytes()}], schema)
            for k, lo in enumerate(range(0, len(spelling.counts), BLOCK_VALUES), 1):  # counts are added up
                yield pa.RecordBatch.from_pylist([{"block": -k, "weight": 1, "data": spelling.counts[lo:lo + BLOCK_VALUES].tobytes()}], schema)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, int] = {}
        for batch in batches:
            for r in batch.to_pylist():
                k, values = r["block"], np.frombuffer(r["data"], np.int32 if r["block"] >= 0 else np.int64)
                sums[k] = sums.get(k, 0) + values.astype(np.int64) * r["weight"]
                weights[k] = weights.get(k, 0) + r["weight"]
        for k, v in sums.items():
            mean = (v / weights[k] * 2.0**-FRACTION).astype(np.float32) if k >= 0 else v
            yield pa.RecordBatch.from_pylist([{"block": k, "weight": weights[k], "data": mean.tobytes()}], schema)

    kind = "block int, weight bigint, data binary"
    rows = texts.mapInArrow(learn, kind).repartition("block").mapInArrow(add, kind).collect()
    if not rows:
        return start
    rows.sort(key=lambda r: abs(r["block"]))
    values = np.concatenate([np.frombuffer(r["data"], np.float32) for r in rows if r["block"] >= 0])
    counts = np.concatenate([np.frombuffer(r["data"], np.int64) for r in rows if r["block"] < 0])
    return Network.unflat(values, words.shape, Spelling(counts))


def score(docs: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_words, sum_log_prob, mean_log_prob of every document."""
    given = docs.sparkSession.sparkContext.broadcast((words, net.flat(), net.spelling.counts))

    def run(batches):
        vocab, values, counts = given.value
        model = Network.unflat(values, vocab.shape, Spelling(counts))
        for batch in batches:
            for b in blocks(batch.column(1)):
                yield score_block(b, batch.column(0)[b.first:b.first + len(b)], vocab, model)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n_words bigint, sum_log_prob double, mean_log_prob double")


def score_block(b: Block, ids: pa.Array, words: Vocabulary, net: Network) -> pa.RecordBatch:
    found = b.words(b.lower, ALNUM)
    number, context = _windows(found, len(b), words)
    first = found.first
    each = np.zeros(len(number) + 1)
    for lo in range(0, len(number), SCORE_BATCH):
        hi = min(lo + SCORE_BATCH, len(number))
        each[lo:hi] = net.log_probs(number[lo:hi], context[lo:hi])
    spelt = np.flatnonzero(number >= words.first_length)
    each[spelt] += net.spelling.log_probs(found, spelt)
    n = np.diff(first)
    sums = np.where(n > 0, np.add.reduceat(each, first[:-1]), 0.0)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sums), pa.array(sums / np.maximum(n, 1), mask=n == 0)],
                                      ["doc_id", "n_words", "sum_log_prob", "mean_log_prob"])


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Count, train and score over all documents."""
    words, total = _vocabulary(docs)
    return score(docs, words, train(docs, words, warm_up(docs, words), total))
