"""Density clustering in the HDBSCAN sense (ML7, AGG12) as DataFrame jobs.

Steps
-----
1. kNN (Euclidean, exact) -> core distance = distance to the ``min_samples``-th
   other neighbour; mutual-reachability weight w = max(core_i, core_j, d_ij).
2. Minimum spanning tree of *all* pairs under w, by Boruvka rounds: every
   component takes its lightest outgoing edge.  Neighbour lists give it unless
   some member's list is too short to tell (its k-th neighbour is no farther
   than the best edge known, or all its neighbours are inside, as when the
   neighbour graph falls apart); only those members are compared with points
   outside.  Points stand in cells around sampled points; a cell's distance, radius and least core
   distance bound from below what any edge into it weighs, and its farthest
   point bounds the lightest edge from above, so an asking point visits only
   the cells that may hold a lighter edge than its component knows.  Asking points are dealt to parts, near ones to the
   same, and a cell's points go once to each part that has a visitor.  So components of the neighbour graph are linked
   by their nearest members, and the tree is that of the full graph.  Copies of
   one point beyond those that lists can show hang on its smallest id by edges of weight 0.
3. The hierarchy, by sorted merges: the tree's edges are merged in order of weight, in bands of at most
   ``band_edges`` edges.  Within a band the components of its own edges are independent of each
   other and are dealt to tasks of about ``band_edges / 16`` edges, where they go through union-find; the state --
   one row per component that the band's edges touch -- comes from a table and goes
   back to one.  Every weight counts; edges of equal weight merge at once.  A
   weight that more edges share than a band holds is contracted by connected
   components and grouped sums, so no task sees all of them.
4. Each component carries its size and the excess of mass of its current
   cluster, so clusters are born, end and are compared with their children
   (the child sum wins only if larger) while merging; the root is never
   selected.  What remains is a table of clusters with parents.
5. A point's label is the topmost winning cluster above the first cluster it
   joined, found by pointer jumping; others are noise (-1).  Labels are
   numbered by smallest member id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.common import sized_broadcast
from linkloom.operators.graph import components, dense_index
from linkloom.operators.knn import _PAIRS_AT_ONCE, _TILE_SHARE, PARTS, Products, Tiles, _near_order, _part_count, _places, kept_type, knn_cells, knn_exact
from linkloom.session import discard, ensure_checkpoint_dir, materialize

MIN_CLUSTER_SIZE = 20
MIN_SAMPLES = 5
NEIGHBORS = 15
#: Edges merged by one task; its state is a few hundred bytes for each.
BAND_EDGES = 1_000_000
BLOCK_ROWS = 4096
#: Rows above which cells are pruned.
ALL_PAIRS_ROWS = 20_000
#: Cells at most; their centres and bounds are handed to every task.
MAX_CELLS = 1 << 16
_BAND_TASKS = 16
_LEAST_WEIGHT = 1e-30


# -- mutual reachability ------------------------------------------------------------

def neighbor_lists(points: DataFrame, min_samples: int = MIN_SAMPLES, k: int | None = None,
                   id_col: str = "id", vec_col: str = "v") -> tuple[DataFrame, DataFrame]:
    """((id, nbr, d), (id, core, reach)): neighbours, and per point the core distance and the distance
    beyond which its list says nothing.  Fewer than ``min_samples`` others: the farthest counts.
    The tree needs exact lists: above ALL_PAIRS_ROWS points cells are pruned by their distance."""
    method = knn_exact if points.limit(ALL_PAIRS_ROWS + 1).count() <= ALL_PAIRS_ROWS else knn_cells
    nn = method(points, max(min_samples, k or NEIGHBORS), id_col, vec_col, metric="euclidean").withColumn("d", -F.col("score"))
    nn = materialize(nn.select("id", "nbr", "rank", "d"), "density-nn")
    core = nn.filter(F.col("rank") <= min_samples).groupBy("id").agg(F.max("d").alias("core"))
    reach = nn.groupBy("id").agg(F.max("d").alias("reach"))
    return nn.select("id", "nbr", "d"), materialize(core.join(reach, "id"), "density-core")


def _weighted(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """(a, b, w) of (id, nbr, d) pairs, undirected with a < b."""
    e = (pairs.join(core.select("id", F.col("core").alias("ca")), "id")
         .join(core.select(F.col("id").alias("nbr"), F.col("core").alias("cb")), "nbr")
         .select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"), F.greatest("d", "ca", "cb").alias("w")))
    return e.groupBy("a", "b").agg(F.min("w").alias("w"))


def mutual_reachability_edges(points: DataFrame, min_samples: int = MIN_SAMPLES, k: int | None = None,
                              id_col: str = "id", vec_col: str = "v") -> tuple[DataFrame, DataFrame]:
    """(edges (a, b, w) of the neighbour graph, undirected with a < b; core (id, core))."""
    pairs, core = neighbor_lists(points, min_samples, k, id_col, vec_col)
    return _weighted(pairs, core), core.select("id", "core")


_PAIR = "comp bigint, a bigint, b bigint, w double"


def without_copies(pts: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """((id, v) with the ``keep`` smallest ids of equal points, weight-0 edges (a, b, w) from the smallest id to all others)."""
    many = pts.groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > keep).select("v", "first")
    many = materialize(many, "density-copies")
    if not many.limit(1).count():
        return pts, pts.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w")).limit(0)
    copies = pts.join(sized_broadcast(many), "v")
    rank = F.row_number().over(Window.partitionBy("first").orderBy("id"))  # tasks send on only the first few of each
    shown = materialize(copies.select("id", "first", rank.alias("r")).filter(F.col("r") <= keep).select("id"), "density-shown")
    hidden = copies.select("id", "first").join(shown, "id", "left_anti")
    hidden = materialize(hidden.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w")), "density-hidden")
    return materialize(pts.join(hidden.select(F.col("b").alias("id")), "id", "left_anti"), "density-distinct"), hidden


class Cells:
    """Blocks of near points: centre, radius, least and greatest core distance, and the components they hold."""

    def __init__(self, rows: list):
        self.block = np.array([r["block"] for r in rows], dtype=np.int64)
        self.centre = np.array([r["centre"] for r in rows], dtype=np.float64)
        self.radius, self.least, self.most = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("radius", "least", "most"))
        self.low, self.high = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("low", "high"))
        self.place = {b: i for i, b in enumerate(self.block.tolist())}

    def only(self, block: int) -> Cells:
        """The one cell of this block."""
        one, at = Cells([]), self.place[block]
        for name in ("block", "centre", "radius", "least", "most", "low", "high"):
            setattr(one, name, getattr(self, name)[at:at + 1])
        return one

    def bounds(self, x: np.ndarray, core: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least weight of any edge into each cell, greatest weight of the lightest one) of each point; inf where all is its own component."""
        d2 = (x * x).sum(1)[:, None] + (self.centre * self.centre).sum(1)[None, :] - 2 * x @ self.centre.T
        # the product errs by some 1e-16 of the squared norms, which counts where distances are small
        slip = 1e-14 * ((x * x).sum(1)[:, None] + (self.centre * self.centre).sum(1)[None, :])
        near, far = np.sqrt(np.maximum(d2 - slip, 0)), np.sqrt(np.maximum(d2 + slip, 0))
        low = np.maximum(np.maximum((near - self.radius) * (1 - 1e-12), core[:, None]), self.least)
        high = np.maximum(np.maximum((far + self.radius) * (1 + 1e-12), core[:, None]), self.most)
        own = (self.low == comp[:, None]) & (self.high == comp[:, None])
        low[own] = high[own] = np.inf
        return low, high


_ROWS_AT_ONCE = 1024


def _slices(df: pd.DataFrame):
    for at in range(0, len(df), _ROWS_AT_ONCE):
        part = df.iloc[at:at + _ROWS_AT_ONCE]
        yield part, np.stack(part["v"].to_numpy()).astype(np.float64), part["core"].to_numpy(), part["comp"].to_numpy()


def _reachable(cells: Cells):
    """(comp, ub): a weight that the component's lightest outgoing edge can't exceed."""

    def run(batches):
        for df in batches:
            for part, x, core, comp in _slices(df):
                yield pd.DataFrame({"comp": comp, "ub": cells.bounds(x, core, comp)[1].min(axis=1)}).groupby("comp", as_index=False).min()

    return run


def _visits(cells: Cells):
    """(part, block, n): how many asking points of a part a block may hold an edge for that is no heavier than the one their component knows of."""

    def run(batches):
        for df in batches:
            for some, x, core, comp in _slices(df):
                low = cells.bounds(x, core, comp)[0]
                i, j = np.nonzero(np.isfinite(low) & (low <= some["bw"].to_numpy()[:, None]))
                visits = pd.DataFrame({"part": some["part"].to_numpy()[i], "block": cells.block[j]})
                yield visits.groupby(["part", "block"]).size().reset_index(name="n")

    return run


class _Asking:
    """A part's asking points and the least weight known of each of their components; candidates come block by block.

    Products in single precision leave out what is too far for a lighter edge,
    by more than they can err; the other pairs are weighed exactly.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, core: np.ndarray, comp: np.ndarray, known: np.ndarray):
        self.ids, self.x, self.core, self.comp = ids, x, core, comp
        self.names, self.of = np.unique(comp, return_inverse=True)
        self.least = np.full(len(self.names), np.inf)
        np.minimum.at(self.least, self.of, known)
        self.products, self.tiles = Products(x, True), Tiles()

    def offer(self, cell: Cells, ids: np.ndarray, y: np.ndarray, core: np.ndarray, comp: np.ndarray):
        """Edges to the candidates, all of one cell, that are no heavier than those known."""
        low = cell.bounds(self.x, self.core, self.comp)[0][:, 0]
        rows = np.flatnonzero(np.isfinite(low) & (low <= self.least[self.of]))
        if not len(rows):
            return
        light = core <= self.least[self.of[rows]].max()
        if not light.all():
            ids, y, core, comp = ids[light], y[light], core[light], comp[light]
        right, y2 = self.products.right(y)
        found = []
        for at in range(0, len(ids), self.tiles.candidates):
            some = slice(at, at + self.tiles.candidates)
            here = {t: r[some] for t, r in right.items()}
            for lo in range(0, len(rows), self.tiles.rows):
                i, j = self._near(rows[lo:lo + self.tiles.rows], here, y2[some].max())
                other = self.comp[i] != comp[some][j]
                i, j = i[other], j[other] + at
                w = np.maximum(self.core[i], core[j])
                near = w <= self.least[self.of[i]]
                i, j, w = i[near], j[near], w[near]
                for part in range(0, len(i), _PAIRS_AT_ONCE):
                    of = slice(part, part + _PAIRS_AT_ONCE)
                    w[of] = np.maximum(np.sqrt(((self.x[i[of]] - y[j[of]]) ** 2).sum(1)), w[of])
                light = w <= self.least[self.of[i]]
                if light.any():
                    i, j, w = i[light], j[light], w[light]
                    found.append(self._lightest(self.of[i], np.minimum(self.ids[i], ids[j]), np.maximum(self.ids[i], ids[j]), w))
                    np.minimum.at(self.least, found[-1][0], found[-1][3])
        if found:
            of, a, b, w = self._lightest(*(np.concatenate(c) for c in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(self.names[of]), pa.array(a), pa.array(b), pa.array(w)], ["comp", "a", "b", "w"])

    def _near(self, rows: np.ndarray, right: dict, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(asking points, candidates) of the pairs that may be no farther than their component's least weight."""
        x2, far = self.products.x2[rows], self.least[self.of[rows]]

        def passing(kind: type) -> np.ndarray:
            s = self.tiles.product(self.products.left[kind][rows], right[kind])
            with np.errstate(over="ignore"):
                return self.tiles.below(s, self.products.limit(far, x2, most, kind)[0].astype(kind))

        kind, n = self.products.kind(x2, most), len(right[np.float64])
        hits = passing(kind)
        if kind is np.float32 and len(hits) > _TILE_SHARE * len(rows) * n:
            hits = passing(np.float64)
        i, j = np.divmod(hits, n)
        return rows[i], j

    @staticmethod
    def _lightest(of: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each component's lightest edge; ties go by (a, b)."""
        order = np.lexsort((b, a, w, of))
        order = order[np.append(True, of[order][1:] != of[order][:-1])]
        return of[order], a[order], b[order], w[order]


def _lightest_of_parts(asking: DataFrame, candidates: DataFrame, parts: int, cells: Cells) -> DataFrame:
    """(comp, a, b, w): edges of which the lightest of a component is that of its asking points to the candidates of their parts.

    ``asking`` (part, block, id, core, comp, bw, v), ``candidates`` (the same
    without bw).  A task holds the asking points of one part and streams
    candidates past them, so a vector travels once for each part that needs it.
    Few parts are held by several tasks each, which share the candidates.
    """
    lots = -(-PARTS // parts)
    lot = F.pmod(F.xxhash64("id"), F.lit(lots))
    asking = asking.withColumn("part", F.explode(F.sequence(F.col("part") * lots, F.col("part") * lots + (lots - 1))))
    candidates = candidates.withColumn("part", (F.col("part") * lots + lot).cast("int"))
    side = lambda df, k, bw: df.select("part", F.lit(k).alias("side"), "block", "id", "core", "comp", bw.alias("bw"), "v")
    sent = side(asking, 0, F.col("bw")).unionByName(side(candidates, 1, F.lit(0.0)))
    sent = sent.repartition(2 * parts * lots, "part").sortWithinPartitions("part", "side", "block")
    given = asking.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        part, held, now = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            p, side, block, ids, core, comp, bw = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(7))
            x = batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
            cuts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (side[1:] != side[:-1]) | (block[1:] != block[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], len(ids)], strict=True):
                if p[a] != part:
                    part, held, now = p[a], [], None
                if side[a] == 0:
                    held.append((ids[a:b], x[a:b], core[a:b], comp[a:b], bw[a:b]))
                    continue
                if held:
                    now, held = _Asking(*(np.concatenate(c) for c in zip(*held, strict=True))), []
                if now is not None:
                    yield from now.offer(given.value.only(int(block[a])), ids[a:b], x[a:b], core[a:b], comp[a:b])

    return sent.mapInArrow(run, _PAIR)


def cells_of(pts: DataFrame, n: int, block_rows: int) -> DataFrame:
    """(id, v, cell, block, centre): every point in the cell of its nearest sampled point; a cell above ``block_rows`` is cut into blocks."""
    n_cells = min(MAX_CELLS, max(1, -(-2 * n // block_rows)))
    centres = np.array([r["v"] for r in pts.orderBy(F.xxhash64("id"), "id").limit(n_cells).collect()], dtype=np.float64)
    half = (centres * centres).sum(1) / 2

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        parts = [(half - np.stack(v.iloc[at:at + _ROWS_AT_ONCE].to_numpy()).astype(np.float64) @ centres.T).argmin(1) for at in range(0, len(v), _ROWS_AT_ONCE)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="int32")

    rows = materialize(pts.withColumn("cell", nearest("v")), "density-cells")
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    block = F.col("cell").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))
    return rows.join(sized_broadcast(parts), "cell").withColumn("block", block).drop("parts", "cell")


def spanning_tree(points: DataFrame, min_samples: int = MIN_SAMPLES, k: int | None = None, id_col: str = "id",
                  vec_col: str = "v", block_rows: int = BLOCK_ROWS, report: list[dict] | None = None) -> DataFrame:
    """(a, b, w): the minimum spanning tree of all pairs under mutual reachability; ties go by (a, b).

    ``report`` receives per round the asking points, the (point, block) pairs
    they visited and the pairs there are.
    """
    kind = kept_type(points, vec_col)
    every = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"))
    pts, hidden = without_copies(every, max(min_samples, k or NEIGHBORS) + 1)
    pairs, core = neighbor_lists(pts, min_samples, k)
    edges = materialize(_weighted(pairs, core), "density-edges")
    n = pts.count()
    if n < 2:
        return edges.unionByName(hidden)
    pts = materialize(cells_of(pts, n, block_rows).join(core, "id"), "density-points")
    middle = pts.groupBy("block").agg(*[F.avg(F.element_at("v", i + 1)).alias(f"c{i}") for i in range(len(pts.select("v").first()[0]))])
    middle = middle.select("block", F.array(*[F.col(c) for c in middle.columns[1:]]).alias("centre"))
    off = F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x))
    shape = pts.join(sized_broadcast(middle), "block").groupBy("block", "centre").agg(F.max(off).alias("radius"), F.min("core").alias("least"), F.max("core").alias("most"))
    shape = materialize(shape, "density-shapes")
    comp = materialize(pts.select("id", F.col("id").alias("comp")), "density-comp")
    tree, found = edges.limit(0), 0
    key = F.struct("w", "a", "b")
    # edges between components only, so each round has fewer of them
    live = materialize(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "density-live")
    while found < n - 1:
        edges_out = live.select(F.col("ca").alias("comp"), key.alias("k")).unionByName(live.select(F.col("cb").alias("comp"), key.alias("k")))
        best = materialize(edges_out.groupBy("comp").agg(F.min("k").alias("k")), "density-best")
        now = pts.select("id", "core", "reach").join(comp, "id").join(best.select("comp", F.col("k.w").alias("bw")), "comp", "left")
        # an edge that no list has weighs at least as much as its ends' core distances and list ends
        unsure = now.filter(F.col("bw").isNull() | (F.greatest("core", "reach") <= F.col("bw")))
        unsure = materialize(unsure.select("id", "comp", "bw"), "density-unsure")
        both, used = best, [best, unsure]
        n_asking = unsure.count()
        if n_asking:  # vectors travel only now
            asking = materialize(pts.select("id", "v", "core", "block").join(sized_broadcast(unsure), "id"), "density-asking")
            held = pts.select("id", "block").join(comp, "id").groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
            cells = Cells(shape.join(held, "block").collect())  # at most about 2 * MAX_CELLS rows
            known = asking.select("comp", F.col("bw").alias("ub")).unionByName(asking.select("v", "core", "comp").mapInPandas(_reachable(cells), "comp bigint, ub double"))
            known = known.groupBy("comp").agg(F.min("ub").alias("bw"))
            sizes = {cells.place[r["block"]]: r["count"] for r in asking.groupBy("block").count().collect()}  # one row a cell
            places, parts = _places(_near_order(cells.centre), sizes, -(-n_asking // _part_count(pts, n_asking, block_rows)))
            place = sized_broadcast(points.sparkSession.createDataFrame([(int(cells.block[c]), first, many) for c, first, many in places], "block bigint, first int, many int"))
            part = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int").alias("part")
            dealt = materialize(asking.drop("bw").join(known, "comp").join(place, "block").select(part, "block", "id", "core", "comp", "bw", "v"), "density-dealt")
            need = dealt.select("part", "v", "core", "comp", "bw").mapInPandas(_visits(cells), "part int, block bigint, n bigint")
            need = materialize(need.groupBy("part", "block").agg(F.sum("n").alias("n")), "density-visits")
            if report is not None:
                report.append({"asking": n_asking, "visits": need.agg(F.sum("n")).first()[0], "all": n_asking * len(cells.block)})
            open_ = pts.select("id", "v", "core", "block").join(sized_broadcast(need.select("block").distinct()), "block").join(comp, "id")
            more = _lightest_of_parts(dealt, open_.join(sized_broadcast(need.select("part", "block")), "block"), parts, cells)
            both = best.unionByName(more.select("comp", key.alias("k")))
            used += [asking, dealt, need]
        picked = materialize(both.groupBy("comp").agg(F.min("k").alias("k")).select("k.a", "k.b", "k.w").distinct(), "density-picked")
        found += picked.count()
        grown = materialize(tree.unionByName(picked), "density-tree")
        ca, cb = (comp.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
        joined = picked.join(ca, "a").join(cb, "b").select(F.col("ca").alias("src"), F.col("cb").alias("dst"))
        merged = materialize(components(joined).select(F.col("v").alias("comp"), F.col("comp").alias("new")), "density-merged")
        later = materialize(comp.join(merged, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")), "density-comp")
        fewer = live
        for end in ("ca", "cb"):
            fewer = fewer.join(merged.select(F.col("comp").alias(end), "new"), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
        fewer = materialize(fewer.filter("ca <> cb"), "density-live")
        for done in (*used, live, merged, tree, comp):
            discard(done)
        tree, comp, live = grown, later, fewer
    return tree.unionByName(hidden)


# -- hierarchy ----------------------------------------------------------------------

class Merger:
    """Components of the points joined so far, with the clusters they stand for.

    A component below ``least`` points lists its members; a larger one has a
    current cluster with the mass ``m`` (sum of 1/w at which points leave it)
    and the value of the best selection below it (None for a leaf).  A cluster has
    the number of one of the edges that made it, which no other cluster has.
    """

    def __init__(self, least: int):
        self.least = least
        self.parent: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.members: dict[int, list[int]] = {}
        self.cluster: dict[int, int] = {}
        self.mass: dict[int, float] = {}
        self.below: dict[int, float | None] = {}
        self.joined: list[tuple[int, int]] = []  # point, first cluster
        self.ended: list[tuple[int, int, bool]] = []  # cluster, parent, wins over its children

    def find(self, x: int) -> int:
        if x not in self.parent:
            self.parent[x], self.size[x], self.members[x] = x, 1, [x]
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def merge(self, edges: list[tuple[int, int, int]], weight: float) -> None:
        """Join along all edges (a, b, number) of one weight at once."""
        roots = {self.find(x) for e in edges for x in e[:2]}
        kin = {r: {r} for r in roots}
        group = {r: r for r in roots}
        for a, b, _ in edges:
            x, y = group[self.find(a)], group[self.find(b)]
            if x != y:
                if len(kin[x]) < len(kin[y]):
                    x, y = y, x
                for r in kin.pop(y):
                    group[r] = x
                    kin[x].add(r)
        number: dict[int, int] = {}
        for a, _, e in edges:
            x = group[self.find(a)]
            number[x] = min(e, number.get(x, e))
        for x, parts in kin.items():
            if len(parts) > 1:
                self._join(sorted(parts), 1.0 / max(weight, _LEAST_WEIGHT), number[x])

    def _join(self, parts: list[int], level: float, number: int) -> None:
        big = [r for r in parts if self.size[r] >= self.least]
        total = sum(self.size[r] for r in parts)
        keep = min(parts)
        loose = [p for r in parts if self.size[r] < self.least for p in self.members.pop(r)]
        if not big and total < self.least:
            self.members[keep] = loose
        elif len(big) == 1:
            c, mass, below = self.cluster.pop(big[0]), self.mass.pop(big[0]), self.below.pop(big[0])
            self.cluster[keep], self.mass[keep], self.below[keep] = c, mass + len(loose) * level, below
            self.joined += [(p, c) for p in loose]
        else:
            c, value = number, 0.0
            for r in big:
                own = self.mass.pop(r) - self.size[r] * level
                below = self.below.pop(r)
                wins = below is None or own >= below
                self.ended.append((self.cluster.pop(r), c, wins))
                value += own if wins else below
            self.cluster[keep], self.mass[keep], self.below[keep] = c, total * level, value if big else None
            self.joined += [(p, c) for p in loose]
        for r in parts:
            self.parent[r] = keep
        self.size[keep] = total

    def run(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, number: np.ndarray | None = None) -> None:
        order = np.lexsort((b, a, w))
        a, b, w, number = a[order], b[order], w[order], (np.arange(len(w)) if number is None else number)[order]
        cuts = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(w)) if len(w) else [], strict=True):
            self.merge(list(zip(a[lo:hi].tolist(), b[lo:hi].tolist(), number[lo:hi].tolist(), strict=True)), float(w[lo]))

    def roots(self) -> list[int]:
        return [x for x, p in self.parent.items() if x == p]


_STATE = "comp bigint, size bigint, members array<bigint>, cluster bigint, mass double, below double"
_OUT = _STATE + ", kind string, old bigint"


def _merge_band(least: int):
    """Edges of some of a band's components with the state of what they touch -> the new state, and what happened."""

    def run(edges: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        m = Merger(least)
        for r in state.itertuples(index=False):
            m.parent[r.comp], m.size[r.comp] = r.comp, int(r.size)
            if r.size < least:
                m.members[r.comp] = [int(x) for x in r.members]
            else:
                m.cluster[r.comp], m.mass[r.comp], m.below[r.comp] = int(r.cluster), r.mass, None if pd.isna(r.below) else r.below
        m.run(*(edges[c].to_numpy() for c in ("a", "b", "w", "number")))
        rows = [(r, m.size[r], m.members.get(r), m.cluster.get(r), m.mass.get(r), m.below.get(r), "state", None) for r in m.roots()]
        rows += [(m.find(x), None, None, None, None, None, "moved", x) for x in list(m.parent) if m.find(x) != x]
        rows += [(p, None, None, c, None, None, "joined", None) for p, c in m.joined]
        rows += [(p, int(wins), None, c, None, None, "ended", None) for c, p, wins in m.ended]
        out = pd.DataFrame(rows, columns=["comp", "size", "members", "cluster", "mass", "below", "kind", "old"])
        return out.astype({"comp": "Int64", "size": "Int64", "cluster": "Int64", "old": "Int64", "mass": "float64", "below": "float64"})

    return run


def _merged_side_by_side(band: DataFrame, n: int, state: DataFrame, least: int, band_edges: int, last: bool) -> DataFrame:
    """What happens along a band's edges: its independent components are dealt to tasks.  The last band's edges hang together, as a tree's do."""
    tasks = 1 if last else -(-n * _BAND_TASKS // band_edges)
    if tasks > 1:
        of = components(band, "a", "b")
        task = lambda end: of.select(F.col("v").alias(end), F.pmod(F.xxhash64("comp"), F.lit(tasks)).alias("g"))
        edges, state = band.join(task("a"), "a"), state.join(task("end"), F.col("comp") == F.col("end")).drop("end")
    else:
        touched = band.select(F.col("a").alias("comp")).union(band.select(F.col("b").alias("comp"))).distinct()
        one = F.lit(0).cast("bigint").alias("g")
        edges, state = band.select("*", one), state.join(touched, "comp", "left_semi").select("*", one)
    run = _merge_band(least)
    return edges.groupBy("g").cogroup(state.groupBy("g")).applyInPandas(lambda e, s: run(e.drop(columns="g"), s.drop(columns="g")), _OUT)


def _contracted(band: DataFrame, weight: float, state: DataFrame, least: int, band_edges: int) -> DataFrame:
    """What happens along edges of one weight, however many: sums over their components in place of union-find."""
    level = 1.0 / max(weight, _LEAST_WEIGHT)
    of = materialize(components(band, "a", "b").select("v", F.col("comp").alias("new")), "band-groups")
    number = band.join(of.withColumnRenamed("v", "a"), "a").groupBy("new").agg(F.min("number").alias("number"))
    parts = of.join(state.withColumnRenamed("comp", "v"), "v", "left").withColumn("members", F.when(F.col("size").isNull(), F.array("v")).otherwise(F.col("members")))
    parts = parts.withColumn("size", F.coalesce("size", F.lit(1).cast("bigint"))).withColumn("big", F.col("size") >= least)
    own = F.col("mass") - F.col("size") * F.lit(level)
    wins = F.col("below").isNull() | (own >= F.col("below"))
    parts = materialize(parts.withColumn("own", own).withColumn("wins", F.col("big") & wins), "band-parts")
    of_big = lambda c: F.max(F.when(F.col("big"), F.col(c)))
    total = parts.groupBy("new").agg(
        F.sum("size").alias("total"), F.count_if("big").alias("n_big"), F.count(F.lit(1)).alias("n_parts"), F.sum(F.when(~F.col("big"), F.col("size")).otherwise(0)).alias("loose"),
        *[of_big(c).alias(f"big_{c}") for c in ("cluster", "mass", "below")], F.sum(F.when(F.col("big"), F.when(F.col("wins"), F.col("own")).otherwise(F.col("below")))).alias("value"))
    total = total.join(number, "new").withColumn("one", F.col("n_big") == 1).withColumn("none", (F.col("n_big") == 0) & (F.col("total") < least))
    total = materialize(total.withColumn("to", F.when(F.col("one"), F.col("big_cluster")).otherwise(F.col("number"))), "band-totals")
    what = total.select("new", "none", "one", "to", "n_parts")
    hot = what.filter(F.col("n_parts") > band_edges)  # one row for more than a band's parts each
    each = parts.join(F.broadcast(hot), "new").unionByName(parts.join(hot.select("new"), "new", "left_anti").join(what, "new"))
    each = materialize(each, "band-each")
    kept = each.filter("none").groupBy("new").agg(F.flatten(F.collect_list("members")).alias("members"))  # fewer than ``least`` each
    null = lambda kind: F.lit(None).cast(kind)
    mass = F.when(F.col("one"), F.col("big_mass") + F.col("loose") * F.lit(level)).otherwise(F.col("total") * F.lit(level))
    below = F.when(F.col("one"), F.col("big_below")).when(F.col("n_big") > 0, F.col("value"))
    now = total.join(kept, "new", "left").select(
        F.col("new").alias("comp"), F.col("total").alias("size"), F.when(F.col("none"), F.col("members")).alias("members"), F.when(~F.col("none"), F.col("to")).alias("cluster"),
        F.when(~F.col("none"), mass).alias("mass"), F.when(~F.col("none"), below).alias("below"), F.lit("state").alias("kind"), null("bigint").alias("old"))
    row = lambda df, comp, size, cluster, kind, old: df.select(
        comp.alias("comp"), size.alias("size"), null("array<bigint>").alias("members"), cluster.alias("cluster"), null("double").alias("mass"), null("double").alias("below"),
        F.lit(kind).alias("kind"), old.alias("old"))
    moved = row(each.filter("v <> new"), F.col("new"), null("bigint"), null("bigint"), "moved", F.col("v"))
    loose = each.filter("NOT none AND NOT big").select(F.explode("members").alias("p"), "to")
    joined = row(loose, F.col("p"), null("bigint"), F.col("to"), "joined", null("bigint"))
    ended = row(each.filter("big AND NOT one"), F.col("to"), F.col("wins").cast("bigint"), F.col("cluster"), "ended", null("bigint"))
    return now.unionByName(moved).unionByName(joined).unionByName(ended)


def hierarchy(tree: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE, band_edges: int = BAND_EDGES) -> tuple[DataFrame, DataFrame]:
    """(point -> first cluster, cluster -> parent and wins) of a spanning tree's edges; the root has no row of its own."""
    spark = tree.sparkSession
    # an edge keeps its number, read back from the written table, while its ends become components
    rest = materialize(tree.select("a", "b", F.col("w").cast("double").alias("w")).withColumn("number", F.monotonically_increasing_id()), "band-edges")
    state = spark.createDataFrame([], _STATE)
    joined = spark.createDataFrame([], "id bigint, cluster bigint")
    ended = spark.createDataFrame([], "cluster bigint, parent bigint, wins boolean")
    while True:
        left = rest.count()
        if not left:
            return joined, ended
        band, n, last = rest, left, True
        if left > band_edges:  # a band never cuts edges of equal weight
            top = rest.orderBy("w").limit(band_edges).agg(F.max("w")).first()[0]
            counts = rest.agg(F.count_if(F.col("w") < F.lit(top)).alias("below"), F.count_if(F.col("w") <= F.lit(top)).alias("upto")).first()
            whole = counts["upto"] <= band_edges or not counts["below"]
            n = counts["upto"] if whole else counts["below"]
            taken = F.col("w") <= F.lit(top) if whole else F.col("w") < F.lit(top)
            band, last = rest.filter(taken), n == left
        what = _merged_side_by_side(band, n, state, min_cluster_size, band_edges, last) if n <= band_edges else _contracted(band, top, state, min_cluster_size, band_edges)
        done = materialize(what, "band-merged")
        joined = materialize(joined.unionByName(done.filter("kind = 'joined'").select(F.col("comp").alias("id"), "cluster")), "band-joined")
        ended = materialize(ended.unionByName(done.filter("kind = 'ended'").select("cluster", F.col("comp").alias("parent"), (F.col("size") == 1).alias("wins"))), "band-ended")
        if last:
            return joined, ended
        touched = band.select(F.col("a").alias("comp")).union(band.select(F.col("b").alias("comp"))).distinct()
        state = materialize(state.join(touched, "comp", "left_anti").unionByName(done.filter("kind = 'state'").drop("kind", "old")), "band-state")
        moved = done.filter("kind = 'moved'").select("old", F.col("comp").alias("new"))
        rest = rest.filter(~taken)
        for end in ("a", "b"):
            rest = rest.join(moved.withColumnRenamed("old", end), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
        rest = materialize(rest.select("a", "b", "w", "number"), "band-edges")


def _topmost_winner(ended: DataFrame) -> DataFrame:
    """(cluster, chosen): the topmost winning cluster at or above each cluster; null if none wins."""
    at = materialize(ended.select("cluster", F.col("parent").alias("up"), F.when(F.col("wins"), F.col("cluster")).alias("best")), "winner")
    while True:
        hop = at.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("best").alias("best2"))
        # a winner farther up hides those below it; the root has no row, so its children stop there
        step = materialize(at.join(hop, "up", "left").select("cluster", F.col("up2").alias("up"), F.coalesce("best2", "best").alias("best")), "winner")
        discard(at)
        at = step
        if not at.filter(F.col("up").isNotNull()).limit(1).count():
            return at.select("cluster", F.col("best").alias("chosen"))


def density_clusters(points: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE,
                     min_samples: int = MIN_SAMPLES, k: int | None = None, id_col: str = "id",
                     vec_col: str = "v", band_edges: int = BAND_EDGES) -> DataFrame:
    """(id, cluster) with cluster -1 for noise."""
    ensure_checkpoint_dir(points.sparkSession)
    ids = points.select(F.col(id_col).cast("long").alias("id"))
    joined, ended = hierarchy(spanning_tree(points, min_samples, k, id_col, vec_col), min_cluster_size, band_edges)
    chosen = _topmost_winner(ended).filter(F.col("chosen").isNotNull())
    members = materialize(joined.join(chosen, "cluster").select("id", "chosen"), "density-members")
    first = members.groupBy("chosen").agg(F.min("id").alias("first_id"))
    labels = dense_index(first, "first_id", "label")
    return (ids.join(members.join(labels, "chosen").select("id", "label"), "id", "left")
            .select("id", F.coalesce("label", F.lit(-1)).cast("int").alias("cluster")))


def cluster_summary(labels: DataFrame) -> DataFrame:
    """AGG12: cluster sizes; the noise row has cluster -1."""
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
