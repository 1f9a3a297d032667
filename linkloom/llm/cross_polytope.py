"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-random rotation -- three rounds of random
signs and a fast Hadamard transform -- and hashed to the nearest signed axis.
A table's key joins the axes of one or more rotations, the last of which may
look at fewer dimensions, so the number of keys can follow the number of rows.
Each row stands once in each of ``TABLES`` tables.  A query looks not only
under its own key but under the ``probes`` keys whose axes are nearest to it
(multiprobe); what it finds there is ranked again by the exact cosine.

How fine the keys and how many the probes are is measured, not guessed: up to
``SAMPLE`` queries are compared with every row, and the finest keys are taken
with which ``MAX_PROBES`` probes or fewer find ``TARGET`` of their true
neighbours.  Only these two numbers come from the sample; every row is
indexed and every query searched.  The coarsest keys probe as many axes as it takes,
all of them if need be, so the search turns exact rather than losing recall.

How it is spread: rows and queries meet under (table, key) in one shuffle;
there each query is multiplied with the key's rows, and its best few leave the
task.  Equal vectors are one entry with their smallest ids wherever a batch
holds them, and queries of equal vectors are searched once, so a vector that a
third of all rows share costs little.  A key with more than ``BLOCK_ROWS`` rows
or queries is cut into blocks, and every block of rows meets every block of
queries in a task of its own; no row is left out.

Cases: a vector that is null, empty, zero, or holds a null or non-finite component
takes no part; vectors of other lengths than the query's are no candidates; ties go to the smaller
vec_id, and a null vec_id, which is never a query, comes last; rows equal in
id and vector count once, an id with several vectors asks with each of them and
has the nearest to any, and a query never returns its own id; with fewer
candidates than asked for, all found are returned; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.runs import run_starts, whole_runs
from linkloom.operators.common import sized_broadcast
from linkloom.session import materialize

QUERY_EVERY = 50
NEIGHBORS = 5
TABLES = 3
SEED = 7
#: Queries compared with every row to choose keys and probes, and the share of their neighbours to be found.
SAMPLE, TARGET = 256, 0.96
MAX_PROBES = 64
#: Rows a key has on average, at least.
KEY_ROWS = 64
#: Rows, and queries, of one key that meet in one task.
BLOCK_ROWS = 1 << 13
_QUERY_ROWS = 256
_NO_ID = (1 << 63) - 1
#: Cosines of a matrix product that may be equal to the least one kept are computed again.
_SLACK = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, the largest component near one: no cosine changes and no square overflows."""
    _, e = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -e[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x and y, pair by pair; the same for the same pair wherever it is computed."""
    x, y = scaled(x), scaled(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


@dataclass(frozen=True)
class Keys:
    """The tables' hash functions: per table one rotation for each entry of ``axes``, which look at so many dimensions."""

    dim: int
    axes: tuple[int, ...]
    tables: int = TABLES
    seed: int = SEED

    @property
    def size(self) -> int:
        return 1 << max(0, (self.dim - 1).bit_length())

    @property
    def per_table(self) -> int:
        return int(np.prod([2 * a for a in self.axes], dtype=np.int64))

    def rotated(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """The unit rows turned by each rotation of a table."""
        wide = np.zeros((len(x), self.size))
        wide[:, :x.shape[1]] = x
        out = []
        for i, axes in enumerate(self.axes):
            rng, y = np.random.default_rng((self.seed, table, i)), wide
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], self.size))
            out.append(y[:, :axes])
        return out

    def of(self, x: np.ndarray, table: int) -> np.ndarray:
        """Key of each row: its nearest signed axes."""
        key = np.full(len(x), table, dtype=np.int64)
        for y in self.rotated(x, table):
            axis = np.abs(y).argmax(axis=1)
            key = key * (2 * y.shape[1]) + 2 * axis + (y[np.arange(len(y)), axis] > 0)
        return key

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n keys (all, if fewer) nearest to each row, nearest first."""
        keys, cost = np.full((len(x), 1), table, dtype=np.int64), np.zeros((len(x), 1))
        for y in self.rotated(x, table):
            reach = np.stack([-y, y], axis=2).reshape(len(y), -1)
            gap = (reach.max(axis=1, keepdims=True) - reach) ** 2
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(y), -1)
            keys = (keys[:, :, None] * gap.shape[1] + np.arange(gap.shape[1])).reshape(len(y), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :n]
            cost, keys = np.take_along_axis(cost, best, 1), np.take_along_axis(keys, best, 1)
        return keys


def ladder(dim: int, rows: int) -> list[tuple[int, ...]]:
    """Axes to choose from, the finest keys first, none with fewer than KEY_ROWS rows on average but the coarsest."""
    size = 1 << max(0, (dim - 1).bit_length())
    steps, whole = [(size,)], (size,)
    while len(whole) < 8:
        steps += [whole + (max(1, size // 4),), whole + (size,)]
        whole += (size,)
    fit = [s for s in steps if rows / float(np.prod([2.0 * a for a in s])) >= KEY_ROWS]
    return [*reversed(fit[1:] if fit else []), steps[0]]


# -- vectors in tasks ---------------------------------------------------------------------

def _matrix(batch: pa.RecordBatch, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows) of packed vectors."""
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    raw = b"".join(batch.column("vec").to_pylist())
    return ids, np.frombuffer(raw, dtype=kind).reshape(len(ids), dim)


def _pack(batches, kind: str):
    """(id, dim, vec): vectors that take part, as bytes."""
    for batch in batches:
        ids, vectors = batch.column(0).fill_null(_NO_ID), batch.column(1)
        values, nulls = vectors.flatten(), vectors.is_valid().to_numpy(zero_copy_only=False)
        n = np.where(nulls, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(n)])
        x = values.cast(pa.float64() if kind == "<f8" else pa.float32(), safe=False)
        bad = ~np.isfinite(x.fill_null(np.nan).to_numpy(zero_copy_only=False))
        x = x.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
        nonzero, faults = (np.concatenate([[0], np.cumsum(f, dtype=np.int64)]) for f in (x != 0, bad))
        good = (n > 0) & (nonzero[at[1:]] > nonzero[at[:-1]]) & (faults[at[1:]] == faults[at[:-1]])
        raw, width = x.tobytes(), x.itemsize
        rows = np.flatnonzero(good)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), pa.array(n[rows], pa.int32()), pa.array([raw[width * at[i]:width * at[i + 1]] for i in rows], pa.binary())], ["id", "dim", "vec"])


def _distinct(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows without those of which ``keep`` equal vectors have smaller ids, nor equal rows."""
    cells = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).reshape(-1)
    _, same = np.unique(cells, return_inverse=True)
    order = np.lexsort((ids, same))
    ids, same = ids[order], same[order]
    first = np.append(True, (ids[1:] != ids[:-1]) | (same[1:] != same[:-1])) if len(ids) else np.empty(0, bool)
    order, same = order[first], same[first]
    starts = run_starts(same)
    rank = np.arange(len(same)) - np.repeat(starts, np.diff(np.append(starts, len(same))))
    rows = order[rank < keep]
    return rows, x[rows]


def _index(batches, keys: Keys, kind: str, keep: int, probes: int = 0, bare: bool = False):
    """(key, id, vec) of rows, or of queries under each key that they probe; ``bare``: (key, rows) counts only."""
    for batch in batches:
        ids, x = _matrix(batch, keys.dim, kind)
        if not probes:
            rows, x = _distinct(ids, x, keep)
            ids = ids[rows]
        u, vec = unit(x.astype(np.float64)), [r.tobytes() for r in x] if not bare else None
        for t in range(keys.tables):
            found = keys.probes(u, t, probes) if probes else keys.of(u, t)[:, None]
            if bare:
                key, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                continue
            which = np.repeat(np.arange(len(ids)), found.shape[1])
            for lo in range(0, len(which), 1 << 15):
                part = which[lo:lo + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)[lo:lo + (1 << 15)]), pa.array(ids[part]),
                                                  pa.array([vec[i] for i in part], pa.binary())], ["key", "id", "vec"])


def best_rows(q: np.ndarray, ids: np.ndarray, x: np.ndarray, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places in x, exact cosines) of each query's ``keep`` nearest rows; ties to the smaller id."""
    near = unit(q) @ unit(x).T
    least = np.partition(near, -keep, axis=1)[:, -keep] if near.shape[1] > keep else np.full(len(q), -np.inf)
    i, j = np.nonzero(near >= least[:, None] - _SLACK)
    score = cosine(q[i], x[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    cuts = np.searchsorted(i, np.arange(len(q) + 1))
    return [(j[a:min(b, a + keep)], score[a:min(b, a + keep)]) for a, b in zip(cuts, cuts[1:])]


def _search(batches, dim: int, kind: str, keep: int):
    """(query, id, score): each query's best rows of the key's block."""
    for rows in whole_runs(batches, 3, 1 << 14):
        key, block, other = (rows.column(i).to_numpy() for i in range(3))
        asks, table = rows.column("asks").to_numpy(zero_copy_only=False), rows.combine_chunks().to_batches()[0]
        ids, x = _matrix(table, dim, kind)
        starts = run_starts(key, block, other)
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(key)), strict=True):
            cut = a + int(np.searchsorted(asks[a:b], True))
            if cut == a or cut == b:
                continue
            own, c = ids[a:cut], x[a:cut].astype(np.float64)
            for lo in range(cut, b, _QUERY_ROWS):
                q = slice(lo, min(b, lo + _QUERY_ROWS))
                for query, (at, score) in zip(ids[q], best_rows(x[q].astype(np.float64), own, c, keep), strict=True):
                    out.append((np.full(len(at), query), own[at], score))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "id", "score"])


def _compare(batches, asked: list[tuple[int, bytes]], dim: int, kind: str, keep: int):
    """(query, id, score, vec): best rows of each batch for the sampled queries."""
    q = np.frombuffer(b"".join(v for _, v in asked), dtype=kind).reshape(len(asked), dim).astype(np.float64)
    for batch in batches:
        if batch.num_rows:
            ids, x = _matrix(batch, dim, kind)
            rows, x = _distinct(ids, x, keep)
            ids = ids[rows]
            found = best_rows(q, ids, x.astype(np.float64), keep)
            at = np.concatenate([f[0] for f in found])
            query = np.repeat([a for a, _ in asked], [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids[at]), pa.array(np.concatenate([f[1] for f in found])),
                                              pa.array([x[i].tobytes() for i in at], pa.binary())], ["query", "id", "score", "vec"])


# -- the search -----------------------------------------------------------------------------

def packed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, str]:
    """((id, dim, vec) of the vectors that take part, kind of their numbers)."""
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    return rows.mapInArrow(lambda b: _pack(b, kind), "id bigint, dim int, vec binary"), kind


def _nearest(found: DataFrame, keep: int, *more: str) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    one = found if more else found.groupBy("query", "id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep).select("query", "id", "score", "rank", *more)


def tune(rows: DataFrame, classes: DataFrame, dim: int, kind: str, n: int, k: int, sample: int = SAMPLE, target: float = TARGET) -> tuple[Keys, int, float]:
    """(keys, probes, the sample's recall): the finest keys that reach the target with MAX_PROBES probes, else the coarsest with as many as it takes."""
    first = classes.orderBy(F.xxhash64("vec"), "own").limit(sample).collect()
    asked, own = [(r["id"], bytes(r["vec"])) for r in first], {r["id"]: r["own"] for r in first}
    found = rows.mapInArrow(lambda b: _compare(b, asked, dim, kind, k + 1), "query bigint, id bigint, score double, vec binary")
    near = [r for r in _nearest(found, k + 1, "vec").collect() if r["id"] != own[r["query"]]]
    place = {q: i for i, (q, _) in enumerate(asked)}
    of = np.array([place[r["query"]] for r in near], dtype=np.int64)
    matrix = lambda parts: unit(np.frombuffer(b"".join(parts), dtype=kind).reshape(-1, dim).astype(np.float64))
    q, x = matrix([v for _, v in asked]), matrix([bytes(r["vec"]) for r in near])
    for axes in ladder(dim, n):
        keys = Keys(dim, axes)
        most = MAX_PROBES if len(axes) > 1 else keys.per_table
        reach = np.full(len(near), most, dtype=np.int64)  # probes before a neighbour's key, in the table where it is nearest
        for t in range(keys.tables):
            tried, key = keys.probes(q, t, most), keys.of(x, t)
            hit = tried[of] == key[:, None]
            reach = np.minimum(reach, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
        recall = np.cumsum(np.bincount(reach, minlength=most + 1)[:most]) / max(1, len(near))
        enough = np.flatnonzero(recall >= target) if len(near) else np.array([0])
        if len(enough):
            return keys, int(enough[0]) + 1, float(recall[enough[0]]) if len(near) else 1.0
    raise AssertionError("all axes probed find every neighbour")


def _blocks(index: DataFrame, asks: DataFrame, rows: DataFrame, queries: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (block, other): a key's block of rows and its block of queries, every pair of which meets once."""
    counts = rows.select("key", "n", F.lit(0).alias("q")).unionByName(queries.select("key", F.lit(0).alias("n"), F.col("n").alias("q")))
    hot = counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).filter((F.col("q") > 0) & ((F.col("n") > block_rows) | (F.col("q") > block_rows)))
    hot = materialize(hot.select("key", *(F.ceil(F.col(c) / block_rows).cast("int").alias(c) for c in ("n", "q"))), "ann-hot")
    if not hot.limit(1).count():
        return (d.withColumns({"block": F.lit(0), "other": F.lit(0)}) for d in (index, asks))
    hot, one, out = sized_broadcast(hot), F.lit(1), []
    for df, own, across in ((index, "block", "other"), (asks, "other", "block")):
        parts = {"block": F.coalesce("n", one), "other": F.coalesce("q", one)}
        cut = df.join(hot, "key", "left").withColumn(own, F.pmod(F.xxhash64("id"), parts[own]).cast("int"))
        out.append(cut.withColumn(across, F.explode(F.sequence(F.lit(0), parts[across] - 1))).drop("n", "q"))
    return tuple(out)


def _of_length(rows: DataFrame, dim: int, kind: str, k: int, every: int, block_rows: int) -> DataFrame:
    """(query, id, score, rank) of the vectors of one length."""
    asked = rows.filter((F.col("id") % every == 0) & (F.col("id") != _NO_ID)).select("id", "vec").distinct()
    asked = materialize(asked, "ann-queries")
    classes = asked.groupBy("vec").agg(F.min("id").alias("own")).withColumn("id", F.monotonically_increasing_id())
    classes = materialize(classes, "ann-classes")  # their numbers are read back from the written table
    n = rows.count()
    keys, probes, _ = tune(rows, classes, dim, kind, n, k)
    schema = "key bigint, id bigint, vec binary"
    side = lambda df, p, bare=False: df.mapInArrow(lambda b: _index(b, keys, kind, k + 1, p, bare), "key bigint, n bigint" if bare else schema)
    index, asks = _blocks(side(rows, 0), side(classes, probes), side(rows, 0, True), side(classes, probes, True), block_rows)
    both = index.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True)))
    met = both.select("key", "block", "other", "asks", "id", "vec").repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "asks")
    found = met.mapInArrow(lambda b: _search(b, dim, kind, k + 1), "query bigint, id bigint, score double")
    best = materialize(_nearest(found, k + 1), "ann-found")
    # queries of one vector share its neighbours; each leaves out itself
    lots = F.lit(16)
    member = asked.withColumn("lot", F.pmod(F.xxhash64("id"), lots)).join(
        classes.select("vec", F.col("id").alias("query"), F.explode(F.sequence(F.lit(0).cast("bigint"), (lots - 1).cast("bigint"))).alias("lot")), ["vec", "lot"])
    own = member.select(F.col("id").alias("own"), "query").join(best.drop("rank"), "query").filter("id <> own")
    return _nearest(own.select(F.col("own").alias("query"), "id", "score"), k)


def search(vectors: DataFrame, k: int = NEIGHBORS, every: int = QUERY_EVERY, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id ``every`` divides."""
    rows, kind = packed(vectors, id_col, vec_col)
    rows = materialize(rows, "ann-vectors")
    out = None
    for (dim,) in sorted(tuple(r) for r in rows.select("dim").distinct().collect()):
        part = _of_length(rows.filter(F.col("dim") == dim).select("id", "vec"), dim, kind, k, every, block_rows)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query bigint, id bigint, score double, rank int")
    return out.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                      F.when(F.col("id") != _NO_ID, F.col("id")).alias("vec_id"), "score")
