"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector; learned filters slide over chunks of
``WIDTH`` bytes that overlap and cover the whole text; each filter keeps its
largest answer in the text, and a small dense layer combines them into one
probability.  Training back-propagates through the chunk that gave the
largest answer, with Adam.

The network is fitted on at most ``max_rows`` labelled texts of at most
``max_bytes`` bytes each, chosen by the hash of their ids among the rows
whose crc32(doc_id) modulo 5 isn't 0; these bounds hold for fitting only.
Scoring reads every text whole, in blocks of bounded bytes (a longer text is
cut into runs of chunks whose largest answers are joined).

Cases: a null or empty text is one chunk of padding and gets a score like any
other; repeated rows get equal scores; without labels of both kinds, every
score is the share of label 1 (0.5 without any); null labels are not used; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.sampling import few_rows
from linkloom.llm.textblocks import blocks

VECTOR, WIDTH, STEP, FILTERS, HIDDEN = 8, 8, 2, 32, 16
MAX_ROWS, MAX_BYTES, EPOCHS, BATCH, RATE, SEED = 4096, 1 << 16, 10, 32, 3e-3, 7
#: Few rows are gone through more often, up to so many steps.
LEAST_STEPS = 800
THRESHOLD = 0.3
HELD_OUT_OF = 5
#: Padded bytes convolved at once.
RUN_BYTES = 128 << 10


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF == 0 if doc_id is not None else False


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte array with each text padded by zeros to whole chunks; first chunk and number of chunks of each text."""
    size = np.diff(offsets)
    chunks = np.maximum(0, -(-(size - WIDTH) // STEP)) + 1
    room = (chunks - 1) * STEP + WIDTH
    start = np.concatenate([[0], np.cumsum(room)[:-1]]) if len(size) else np.zeros(0, np.int64)
    out = np.zeros(int(room.sum()), dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(start - offsets[:-1], size)] = data
    return out, start // STEP, chunks


@dataclass
class Network:
    """Parameters of the classifier."""

    constant: float | None = None
    p: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        g = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return cls(None, {"byte": g(256, VECTOR, scale=0.5), "conv": g(WIDTH * VECTOR, FILTERS, scale=(WIDTH * VECTOR) ** -0.5),
                          "bias": np.zeros(FILTERS, np.float32), "w1": g(FILTERS, HIDDEN, scale=FILTERS ** -0.5), "b1": np.zeros(HIDDEN, np.float32),
                          "w2": g(HIDDEN, scale=HIDDEN ** -0.5), "b2": np.zeros(1, np.float32)})

    def answers(self, data: np.ndarray) -> np.ndarray:
        """Every filter on every chunk of an array of padded texts."""
        x = self.p["byte"][data].reshape(-1)
        n = (len(data) - WIDTH) // STEP + 1
        view = np.lib.stride_tricks.as_strided(x, (n, WIDTH * VECTOR), (STEP * VECTOR * x.itemsize, x.itemsize))
        return np.ascontiguousarray(view) @ self.p["conv"]

    def pooled(self, data: np.ndarray, first: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        """Each text's largest answers; long arrays are convolved in runs."""
        ends, out, step = first + chunks, np.full((len(first), FILTERS), -np.inf, np.float32), RUN_BYTES // STEP
        for lo in range(0, int(ends[-1]) if len(ends) else 0, step):
            a = self.answers(data[lo * STEP:(lo + step - 1) * STEP + WIDTH])
            t0, t1 = np.searchsorted(ends, lo, side="right"), np.searchsorted(first, lo + len(a))
            s, e = np.maximum(first[t0:t1] - lo, 0), np.minimum(ends[t0:t1] - lo, len(a))
            some = e > s
            if some.any():
                cuts = np.stack([s[some], e[some]], axis=1).reshape(-1)
                top = np.maximum.reduceat(a, cuts[:-1] if cuts[-1] == len(a) else cuts, axis=0)[::2]
                rows = np.arange(t0, t1)[some]
                out[rows] = np.maximum(out[rows], top)
        return out

    def combine(self, pooled: np.ndarray) -> np.ndarray:
        p = self.p
        hidden = np.maximum(np.maximum(pooled + p["bias"], 0) @ p["w1"] + p["b1"], 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return self.combine(self.pooled(*padded(data, offsets))).astype(np.float64)


def _step(net: Network, texts: list[bytes], y: np.ndarray) -> dict:
    """Gradients of the mean log loss of a few texts."""
    p = net.p
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    data, first, chunks = padded(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    a = net.answers(data)
    best = np.stack([s + a[s:s + c].argmax(axis=0) for s, c in zip(first, chunks, strict=True)])  # texts x filters
    top = np.take_along_axis(a, best, axis=0) + p["bias"]
    act = np.maximum(top, 0)
    z1 = act @ p["w1"] + p["b1"]
    hidden = np.maximum(z1, 0)
    prob = 1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -30, 30)))
    d = ((prob - y) / len(y)).astype(np.float32)
    dz1 = np.outer(d, p["w2"]) * (z1 > 0)
    dtop = (dz1 @ p["w1"].T) * (top > 0)
    at = best[:, :, None] * STEP + np.arange(WIDTH)  # texts x filters x width
    chunk = data[at]
    x = p["byte"][chunk].reshape(*best.shape, -1)
    dx = dtop[:, :, None] * p["conv"].T[None]
    byte = np.zeros_like(p["byte"])
    np.add.at(byte, chunk.reshape(-1), dx.reshape(-1, VECTOR))
    return {"byte": byte, "conv": np.einsum("bf,bfk->kf", dtop, x), "bias": dtop.sum(axis=0), "w1": act.T @ dz1, "b1": dz1.sum(axis=0),
            "w2": hidden.T @ d, "b2": d.sum(keepdims=True)}


def fit(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network for (text, label) rows; the same rows in the same order give the same network."""
    y = np.array([label for _, label in rows], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return Network(float(y.mean()) if len(y) else 0.5)
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    net.p["b2"][:] = np.log(y.mean() / (1 - y.mean()))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(rows)))
    t, steps = 0, epochs * -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            t += 1
            rate = RATE * (1 - t / (steps + 1))
            for k, g in _step(net, [rows[i][0] for i in pick], y[pick]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                net.p[k] -= (rate / (1 - 0.9**t) * m[k] / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[tuple[bytes, int]]:
    """At most max_rows labelled texts that are not held out, in order of their ids' hashes."""
    crc = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (crc % HELD_OUT_OF != 0)).groupBy("doc_id").agg(F.max("y").alias("y")))
    ids = few_rows(known, max_rows, "doc_id")
    # limit bounds the broadcast: max_rows ids and labels
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.octet_length("text") <= max_bytes)
    # one text of each id, however often it stands in the table
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()
    return [(r["text"].encode(), r["y"]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few tens of kilobytes, whatever it was fitted on

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            parts = [model.value.score(b.data, b.offsets) for b in blocks(batch.column(1))]
            s = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(s, pa.float64()),
                                              pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return narrow.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", **limits) -> DataFrame:
    """Fit on the labels of documents that are not held out, and score all documents."""
    return score(docs, fit(training_rows(docs, labels, label, **limits)))
