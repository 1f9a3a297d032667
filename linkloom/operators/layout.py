"""Dimension reduction and graph layout (ML3-ML6).

* ``pca`` -- Spark ML PCA (d x d covariance aggregated on executors, eigen
  solve of the small d x d matrix on the driver) on z-scored vectors, with a
  deterministic sign (largest-magnitude loading positive).
* ``fuzzy_graph`` -- the fuzzy neighbour graph: rho = nearest positive
  distance, sigma by bisection so that sum(exp(-(d - rho)+ / sigma)) = log2(k),
  membership w = exp(-(d - rho)+ / sigma), symmetrised with a + b - a b.
  The bisection is a fixed-step ``aggregate`` over the k neighbour distances
  of each row (bounded by k), so it runs in the JVM.
* ``layout`` -- full-batch epochs: attractive gradients along graph edges,
  repulsive gradients against random negative samples, clipped to +-4,
  learning rate decaying 1 -> 0.  Points are dealt to blocks of at most
  ``BLOCK_POINTS`` rows (at least ``LEAST_BLOCKS`` blocks, whatever the size), near
  starts to the same block, and the edges once to the block of their first end.  A
  block's task runs ``EXCHANGE_EPOCHS`` epochs on its rows and then sends other
  blocks the positions of just those rows that their edges end in, so an
  exchange is one cogroup, one shuffle of positions (edges stay dealt by block), and one written table (the
  table before is deleted; a lost executor repeats one exchange).  **Staleness:**
  between exchanges ends in other blocks stand where the last exchange left
  them, at most ``EXCHANGE_EPOCHS`` - 1 epochs behind; ends in the own block
  move on.  Negatives are drawn from ``NEGATIVE_ROWS`` rows of the own block and of
  each of ``NEGATIVE_BLOCKS`` others, which change with every exchange.
  Deterministic for a seed; coordinates differ from sequential SGD by design.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.graph import dense_index
from linkloom.operators.knn import EXACT_ROWS, neighbors
from linkloom.operators.vectors import zscore
from linkloom.session import discard, ensure_checkpoint_dir, materialize

PCA_COMPONENTS = 30
CLUSTER_DIMS, CLUSTER_NEIGHBORS, CLUSTER_MIN_DIST = 10, 30, 0.0
VIEW_DIMS, VIEW_NEIGHBORS, VIEW_MIN_DIST = 2, 15, 0.1
NEGATIVE_SAMPLES = 5
SEED = 42
#: Points of a block, blocks at least, and epochs between two exchanges of positions.
BLOCK_POINTS, LEAST_BLOCKS, EXCHANGE_EPOCHS = 4096, 8, 10
#: Other blocks that negatives come from in one exchange, and rows of each.
NEGATIVE_BLOCKS, NEGATIVE_ROWS = 16, 256
#: Numbers of an array that an epoch works on at once, few enough for a core's cache.
_VALUES_AT_ONCE = 1 << 15


# -- PCA ---------------------------------------------------------------------------

def pca(df: DataFrame, k: int = PCA_COMPONENTS, vec_col: str = "embedding", out_col: str = "pca",
        standardize: bool = True) -> tuple[DataFrame, list[float]]:
    """ML3 + ML4: (df + ``out_col`` ARRAY<DOUBLE>, explained variance ratios)."""
    src = zscore(df, vec_col, "_z") if standardize else df.withColumn("_z", F.col(vec_col).cast("array<double>"))
    dim = len(src.select("_z").first()[0])
    k = min(k, dim)
    vec = src.withColumn("_zv", array_to_vector("_z"))
    model = PCA(k=k, inputCol="_zv", outputCol="_pv").fit(vec)
    pc = model.pc.toArray()                      # d x k
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), range(k)])
    signs[signs == 0] = 1.0
    out = model.transform(vec).withColumn("_pa", vector_to_array("_pv"))
    sarr = F.array(*[F.lit(float(s)) for s in signs])
    out = out.withColumn(out_col, F.zip_with("_pa", sarr, lambda x, s: x * s)).drop("_z", "_zv", "_pv", "_pa")
    return out, [float(v) for v in model.explainedVariance.toArray()]


# -- fuzzy graph ---------------------------------------------------------------------

def _psum(ds: Column, rho: Column, sigma: Column) -> Column:
    return F.aggregate(ds, F.lit(0.0), lambda acc, d: acc + F.when(d - rho > 0, F.exp(-(d - rho) / sigma))
                       .otherwise(F.lit(1.0)))


def smooth_knn(neigh: DataFrame, k: int, n_iter: int = 64, tol: float = 1e-5) -> DataFrame:
    """(id, ds ARRAY<DOUBLE> of the k-1 non-self distances) -> + rho, sigma."""
    target = math.log2(k)
    ds = F.col("ds")
    rho = F.coalesce(F.array_min(F.filter(ds, lambda d: d > 0)), F.lit(0.0))
    x = neigh.withColumn("rho", rho)
    init = F.struct(F.lit(0.0).alias("lo"), F.lit(-1.0).alias("hi"), F.lit(1.0).alias("mid"),
                    F.lit(False).alias("done"))

    def step(s, _i):
        # the sum is taken once a step: a lambda's argument is a value, other uses of an expression are evaluated each on their own
        p = F.when(~s["done"], _psum(ds, F.col("rho"), s["mid"]))
        return F.element_at(F.transform(F.array(p), lambda v: moved(s, v)), 1)

    def moved(s, p):
        close = F.abs(p - F.lit(target)) < tol
        hi_new = F.when(p > target, s["mid"]).otherwise(s["hi"])
        lo_new = F.when(p > target, s["lo"]).otherwise(s["mid"])
        mid_new = F.when(p > target, (s["lo"] + s["mid"]) / 2).otherwise(
            F.when(s["hi"] < 0, s["mid"] * 2).otherwise((s["mid"] + s["hi"]) / 2))
        return F.when(s["done"] | close, F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"),
                                                   s["mid"].alias("mid"), F.lit(True).alias("done"))) \
            .otherwise(F.struct(lo_new.alias("lo"), hi_new.alias("hi"), mid_new.alias("mid"),
                                F.lit(False).alias("done")))

    sig = F.aggregate(F.sequence(F.lit(1), F.lit(n_iter)), init, step)["mid"]
    mean_d = F.aggregate(ds, F.lit(0.0), lambda a, d: a + d) / F.greatest(F.size(ds), F.lit(1))
    return x.withColumn("sigma", F.greatest(sig, F.lit(1e-3) * mean_d))


def fuzzy_graph(points: DataFrame, n_neighbors: int = VIEW_NEIGHBORS, id_col: str = "id",
                vec_col: str = "v", metric: str = "cosine", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """ML5: undirected fuzzy edges (a, b, w) with a < b and 0 < w <= 1.  Above ``exact_rows`` points the neighbours come from neighbour descent."""
    src = points.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        src = src.withColumn("v", F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-12))))
        nn = neighbors(src, n_neighbors - 1, "id", "v", "cosine", exact_rows).withColumn(
            "d", F.greatest(F.lit(0.0), 1.0 - F.col("score")))
    else:
        nn = neighbors(src, n_neighbors - 1, "id", "v", "euclidean", exact_rows).withColumn("d", -F.col("score"))
    rows = nn.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "nbr", "d"))).alias("nb"))
    rows = rows.withColumn("ds", F.transform("nb", lambda e: e["d"]))
    sm = smooth_knn(rows, n_neighbors)
    e = sm.select("id", "rho", "sigma", F.explode("nb").alias("e")).select(
        F.col("id").alias("i"), F.col("e.nbr").alias("j"),
        F.when((F.col("e.d") - F.col("rho") <= 0) | (F.col("sigma") == 0), F.lit(1.0))
        .otherwise(F.exp(-(F.col("e.d") - F.col("rho")) / F.col("sigma"))).alias("w"))
    und = e.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "w")
    g = und.groupBy("a", "b").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("c"),
                                  F.min("w").alias("mn"), F.max("w").alias("mx"))
    return g.select("a", "b", F.when(F.col("c") == 2, F.col("s") - F.col("mn") * F.col("mx"))
                    .otherwise(F.col("s")).alias("w")).filter(F.col("w") > 0)


# -- layout ----------------------------------------------------------------------------

def curve_params(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """Fit a, b of 1 / (1 + a d^(2b)) to the target membership curve (least squares)."""
    x = np.linspace(0, spread * 3, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    best, best_err = (1.0, 1.0), float("inf")
    a_grid = np.linspace(0.5, 3.0, 126)
    b_grid = np.linspace(0.5, 1.5, 101)
    for b in b_grid:
        xb = x ** (2 * b)
        for a in a_grid:
            err = float(((1.0 / (1.0 + a * xb) - y) ** 2).sum())
            if err < best_err:
                best, best_err = (a, b), err
    a0, b0 = best  # refine locally
    for _ in range(3):
        a_grid = np.linspace(a0 - 0.02, a0 + 0.02, 41)
        b_grid = np.linspace(b0 - 0.01, b0 + 0.01, 41)
        for b in b_grid:
            xb = x ** (2 * b)
            for a in a_grid:
                err = float(((1.0 / (1.0 + a * xb) - y) ** 2).sum())
                if err < best_err:
                    best, best_err = (a, b), err
        a0, b0 = best
    return float(a0), float(b0)


def _payload(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order by non-negative keys, the first one first; by one number where it holds them all."""
    spans = [int(k.max()) + 1 if len(k) else 1 for k in keys]
    if math.prod(spans) >= 1 << 63:
        return np.lexsort(keys[::-1])
    one = keys[0]
    for k, span in zip(keys[1:], spans[1:], strict=True):
        one = one * span + k
    return np.argsort(one, kind="stable")


class BlockEdges:
    """A block's edges: own rows, and the ends as own rows or as rows received from other blocks."""

    def __init__(self, table: pa.Table, block: int, rows: int):
        li, bj, lj, w = (table.column(c).to_numpy() for c in ("li", "bj", "lj", "w"))
        order = _order(li, bj, lj)
        self.li, bj, lj, self.w = li[order], bj[order], lj[order], w[order]
        away = bj != block
        keys, place = np.unique(bj[away] << 32 | lj[away], return_inverse=True)
        self.source = keys >> 32  # of the received rows, in the order in which they are expected
        self.end = lj.copy()
        self.end[away] = rows + place
        self.starts = np.flatnonzero(np.append(True, self.li[1:] != self.li[:-1])) if len(li) else np.empty(0, np.int64)
        # the graph is undirected, so a block's rows with an edge into t are those that t expects, and in its order
        pairs = np.unique(bj[away] << 32 | self.li[away])
        cuts = np.flatnonzero(np.diff(pairs >> 32)) + 1
        self.sends = {int(some[0] >> 32): some & 0xFFFFFFFF for some in np.split(pairs, cuts) if len(some)}

    def lots(self, edges: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first edge, edge behind the last, starts within the lot, rows): rows with about ``edges`` edges together, or one row."""
        out, bounds = [], np.append(self.starts, len(self.li))
        at = 0
        while at < len(self.starts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + edges, side="right")) - 1)
            starts = self.starts[at:to]
            out.append((int(bounds[at]), int(bounds[to]), starts - bounds[at], self.li[starts]))
            at = to
        return out

    def received(self, halo: dict[int, np.ndarray], dims: int) -> np.ndarray:
        return np.concatenate([halo[int(t)] for t in np.unique(self.source)]) if len(self.source) else np.empty((0, dims))


def run_epochs(x: np.ndarray, e: BlockEdges, halo: np.ndarray, own: np.ndarray, pool: np.ndarray, pool_rows: np.ndarray,
               alphas: np.ndarray, curve: tuple[float, float], negatives: np.ndarray) -> np.ndarray:
    """A block's rows after these epochs; rows of other blocks stay as they were received."""
    a, b = curve
    n, clip = len(x), lambda g: np.clip(g, -4.0, 4.0, out=g)
    ends = np.concatenate([x, halo])
    x = ends[:n]  # moves on in place
    cuts = e.lots(max(1, _VALUES_AT_ONCE // x.shape[1]))
    most = max((hi - lo for lo, hi, _, _ in cuts), default=0)
    room, other = np.empty((most, x.shape[1])), np.empty((most, x.shape[1]))
    for alpha, drawn in zip(alphas, negatives, strict=True):
        grad = np.zeros_like(x)
        for lo, hi, starts, rows in cuts:
            diff, own_ends = room[:hi - lo], other[:hi - lo]
            np.take(x, e.li[lo:hi], axis=0, out=diff, mode="clip")
            diff -= np.take(ends, e.end[lo:hi], axis=0, out=own_ends, mode="clip")
            d2 = np.multiply(diff, diff, out=own_ends).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(d2 > 0, -2.0 * a * b * d2 ** (b - 1.0) / (a * d2**b + 1.0), 0.0)
            diff *= pull[:, None]
            grad[rows] = np.add.reduceat(np.multiply(e.w[lo:hi, None], clip(diff), out=diff), starts)
        for lot in drawn.T:
            diff = x - pool[lot]
            d2 = (diff * diff).sum(axis=1)
            push = 2.0 * b / ((0.001 + d2) * (a * d2**b + 1.0))
            grad += np.where(pool_rows[lot] == own, 0.0, 1.0)[:, None] * clip(push[:, None] * diff) / drawn.shape[1]
        x += alpha * clip(grad)
    return x.copy()


_MESSAGE = "block bigint, source bigint, kind int, payload binary"
_OWN, _HALO, _POOL = 0, 1, 2


def _exchange(dims: int, rows: int, blocks: int, first: int, alphas: np.ndarray, curve: tuple[float, float], negative_samples: int, seed: int):
    """One task of an exchange: a block's messages and edges -> its epochs -> its messages."""

    def decode(payload: bytes) -> np.ndarray:
        return np.frombuffer(payload).reshape(-1, dims)

    def run(key: tuple[pa.Scalar, ...], messages: pa.Table, edges: pa.Table) -> pa.Table:
        block = key[0].as_py()
        got = {k: [] for k in (_OWN, _HALO, _POOL)}
        for m in messages.to_pylist():
            got[m["kind"]].append((m["source"], m["payload"]))
        x = decode(got[_OWN][0][1])
        own = block * rows + np.arange(len(x))
        e = BlockEdges(edges, block, len(x))
        if len(alphas):
            halo = e.received({t: decode(p) for t, p in got[_HALO]}, dims)
            parts = [np.frombuffer(p).reshape(-1, dims + 1) for _, p in sorted(got[_POOL])]
            pool = np.concatenate(parts)
            drawn = np.random.default_rng((seed, first, block)).integers(0, len(pool), (len(alphas), len(x), negative_samples))
            x = run_epochs(x, e, halo, own, pool[:, 1:], pool[:, 0].astype(np.int64), alphas, curve, drawn)
        out = [(block, block, _OWN, _payload(x))]
        out += [(t, block, _HALO, _payload(x[at])) for t, at in e.sends.items()]
        some = np.sort(np.random.default_rng((seed, first, block, 1)).permutation(len(x))[:NEGATIVE_ROWS])
        sample = _payload(np.concatenate([own[some, None].astype(np.float64), x[some]], axis=1))
        steps = np.random.default_rng((seed, first)).permutation(blocks - 1)[:NEGATIVE_BLOCKS] + 1 if blocks > 1 else np.empty(0, np.int64)
        out += [((block + int(step)) % blocks, block, _POOL, sample) for step in (0, *steps)]
        b, s, k, p = zip(*out, strict=True)
        return pa.table({"block": pa.array(b, pa.int64()), "source": pa.array(s, pa.int64()), "kind": pa.array(k, pa.int32()), "payload": pa.array(p, pa.binary())})

    return run


def _morton(columns: list[str]) -> Column:
    """Bits of the first three start coordinates (0 to 10), interleaved: near starts get near places."""
    cells = [F.least(F.lit(1023), F.floor(F.col(c) * 102.4)).cast("bigint") for c in columns[:3]]
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1))
    return sum((F.shiftleft(bit(c, i), len(cells) * i + d) for i in range(10) for d, c in enumerate(cells)), F.lit(0).cast("bigint"))


def layout(points: DataFrame, edges: DataFrame, init_col: str, n_components: int = VIEW_DIMS,
           min_dist: float = VIEW_MIN_DIST, n_epochs: int = 50, negative_samples: int = NEGATIVE_SAMPLES,
           seed: int = SEED, id_col: str = "id", exchange_epochs: int = EXCHANGE_EPOCHS) -> DataFrame:
    """ML6: (id, x0..x{D-1}) after ``n_epochs`` full-batch epochs.

    ``init_col`` holds an array whose first ``n_components`` entries start the
    layout (PCA dims); they are rescaled to [0, 10] per dimension.
    """
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    D = n_components
    ys = [f"y{k}" for k in range(D)]
    p = points.select(F.col(id_col).alias("id"), *[F.element_at(init_col, k + 1).cast("double").alias(ys[k])
                                                    for k in range(D)])
    st = p.agg(*[F.min(c).alias(f"mn{c}") for c in ys], *[F.max(c).alias(f"mx{c}") for c in ys], F.count(F.lit(1)).alias("n")).first()
    n = st["n"]
    if not n:
        return p.select(F.col("id").alias(id_col), *[F.col(ys[k]).alias(f"x{k}") for k in range(D)])
    p = p.select("id", *[(F.lit(10.0) * (F.col(c) - st[f"mn{c}"]) /
                          F.lit(max(st[f"mx{c}"] - st[f"mn{c}"], 1e-12))).alias(c) for c in ys])
    blocks = max(-(-n // BLOCK_POINTS), min(n, LEAST_BLOCKS))
    rows = -(-n // blocks)
    blocks = -(-n // rows)
    p = dense_index(p.withColumn("place", F.struct(_morton(ys), F.col("id"))), "place").drop("place")
    p = materialize(p.withColumn("block", F.expr(f"idx div {rows}")).withColumn("row", F.expr(f"idx % {rows}")), "layout-init")
    e = edges.select(F.col("a").alias("i"), F.col("b").alias("j"), "w")
    e = e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    degree = e.groupBy("i").agg(F.sum("w").alias("degree"))
    mine, other = (p.select(F.col("id").alias(end), F.col("block").alias(b), F.col("row").alias(r)) for end, b, r in (("i", "block", "li"), ("j", "bj", "lj")))
    e = e.join(degree, "i").join(mine, "i").join(other, "j")
    e = materialize(e.select("block", "li", "bj", "lj", (F.col("w") / F.col("degree")).alias("w")), "layout-edges")
    # dealt to their blocks once and kept on the executors' disks (a lost part is dealt again from the table): exchanges move positions only
    few = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    e = e.repartition(few, "block").persist(StorageLevel.DISK_ONLY)
    e.count()

    def first_rows(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        x = np.stack([t.column(c).to_numpy() for c in ys], axis=1)
        return pa.table({"block": [key[0].as_py()], "source": [key[0].as_py()], "kind": pa.array([_OWN], pa.int32()), "payload": pa.array([_payload(x)], pa.binary())},
                        schema=pa.schema([("block", pa.int64()), ("source", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())]))

    now = p.select("block", "row", *ys).groupBy("block").applyInArrow(first_rows, _MESSAGE)
    curve = curve_params(min_dist)
    alphas = 1.0 - np.arange(n_epochs) / max(1, n_epochs)
    rounds = [alphas[:0], *(alphas[at:at + exchange_epochs] for at in range(0, n_epochs, exchange_epochs))]
    last = None
    for i, part in enumerate(rounds):  # the first one only sends the start
        step = _exchange(D, rows, blocks, i, part, curve, negative_samples, seed)
        now = materialize(now.groupBy("block").cogroup(e.groupBy("block")).applyInArrow(step, _MESSAGE), "layout-exchange")
        if last is not None:
            discard(last)
        last = now

    def spread(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(payload).reshape(-1, D)
                yield pa.RecordBatch.from_arrays([pa.array(block * rows + np.arange(len(x))), *(pa.array(x[:, k]) for k in range(D))], ["idx", *ys])

    end = now.filter(F.col("kind") == _OWN).select("block", "payload").mapInArrow(spread, "idx bigint, " + ", ".join(f"{c} double" for c in ys))
    out = p.select("id", "idx").join(end, "idx").select(F.col("id").alias(id_col), *[F.col(ys[k]).alias(f"x{k}") for k in range(D)])
    out = materialize(out, "layout")
    e.unpersist()
    return out
