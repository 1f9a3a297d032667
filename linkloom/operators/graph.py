"""Graph building blocks on DataFrames (ML8): dense indexing and connected
components.

Connected components use min-label propagation with pointer jumping: each
round every vertex takes the smallest label among itself and its neighbours,
then the label of its label.  Several independent graphs are processed in one
pass when ``part_cols`` (e.g. a level column) are given.  Lineage is cut with
Parquet tables written to the shared checkpoint folder (never local storage).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.common import sized_broadcast
from linkloom.session import discard, ensure_checkpoint_dir, materialize


#: Edges whose components one task may find.
SMALL_EDGES = 1 << 17


def dense_index(df: DataFrame, order_col: str | None = None, out_col: str = "idx") -> DataFrame:
    """Add a dense 0..n-1 index without a single-partition sort.

    The rows -- range partitioned and sorted by ``order_col`` if given -- are
    written once together with their partition and their place in it; counts
    and index are both taken from that table, so they can't disagree however
    the partitioning would turn out a second time.  Offsets are running counts
    over one row per partition.
    """
    src = df.repartitionByRange(order_col).sortWithinPartitions(order_col) if order_col else df
    place = F.monotonically_increasing_id()  # partition above bit 33, row below
    rows = materialize(src.withColumn("_mid", place), "dense-index")
    pid, at = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (rows.withColumn("_pid", pid).join(sized_broadcast(offsets), "_pid")
            .withColumn(out_col, (F.col("_base") + at).cast("long")).drop("_pid", "_mid", "_base"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         part_cols: list[str] | None = None, vertices: DataFrame | None = None,
                         max_iter: int = 200) -> DataFrame:
    """(vertex, *part_cols, comp) where comp = smallest vertex id of its component.

    ``edges`` are undirected; vertices default to the edge endpoints.  Isolated
    vertices given in ``vertices`` keep their own id.  Rounds go on until no
    label changes; not getting there in ``max_iter`` rounds is an error.
    """
    parts = part_cols or []
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), *parts)
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), *parts)).distinct()
    e = materialize(e, "cc-edges")
    v = e.select(F.col("a").alias("v"), *parts).distinct()
    if vertices is not None:
        v = v.unionByName(vertices.select(F.col(vertices.columns[0]).alias("v"), *parts)).distinct()
    lab = last = materialize(v.withColumn("comp", F.col("v")), "cc-init")
    for it in range(max_iter):
        m = (e.join(lab.withColumnRenamed("v", "a"), ["a", *parts])
             .groupBy(F.col("b").alias("v"), *parts).agg(F.min("comp").alias("m")))
        l1 = (lab.join(m, ["v", *parts], "left")
              .select("v", *parts, F.least("comp", F.coalesce("m", "comp")).alias("c1"), F.col("comp").alias("c0")))
        hop = l1.select(F.col("v").alias("c1"), *parts, F.col("c1").alias("c2"))
        l2 = (l1.join(hop, ["c1", *parts], "left")
              .select("v", *parts, F.least("c1", F.coalesce("c2", "c1")).alias("comp"), "c0"))
        l2 = materialize(l2, "cc-round")
        changed = l2.filter(F.col("comp") != F.col("c0")).limit(1).count()
        discard(last)
        lab, last = l2.drop("c0"), l2
        if changed == 0:
            return lab
    raise RuntimeError(f"components still changed after {max_iter} rounds")


def _picked_forest(e: DataFrame, turn: int) -> DataFrame:
    """(v, up): every vertex with the root of its tree in the forest of the edges that come first at one of their ends.

    Edges have an order of their own in each turn, the same from both ends, so
    picks close no cycles but pairs that picked the same edge, of which the
    smaller vertex is the root.  Trees have two vertices at least and are
    shallow, as the order is a hash's: a few hops reach the roots.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    ends = e.select("a", "b", F.xxhash64(low, high, F.lit(turn)).alias("h"))
    ends = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "h"))
    # the edge's order, seen from one end: by its hash, then by its ends
    pick = ends.groupBy(F.col("a").alias("v")).agg(F.min(F.struct("h", low.alias("low"), high.alias("high"))).alias("k"))
    at = materialize(pick.select("v", F.when(F.col("k.low") == F.col("v"), F.col("k.high")).otherwise(F.col("k.low")).alias("up")), "cc-picked")
    hop = lambda at: at.join(at.select(F.col("v").alias("up"), F.col("up").alias("again")), "up")
    pair = (F.col("again") == F.col("v")) & (F.col("v") < F.col("up"))
    now = materialize(hop(at).select("v", F.when(pair, F.col("v")).otherwise(F.col("up")).alias("up")), "cc-hop")
    while True:
        later = materialize(hop(now).select("v", F.col("again").alias("up"), (F.col("again") != F.col("up")).alias("moved")), "cc-hop")
        moved = later.filter("moved").limit(1).count()
        for done in (at, now):
            discard(done)
        at = now = later.drop("moved")
        now.scratch_path = later.scratch_path
        if not moved:
            return now


def components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL_EDGES) -> DataFrame:
    """(v, comp) like ``connected_components``.

    Edges are contracted along forests that leave half of the vertices at
    most, whatever the paths' lengths; up to ``small`` edges are joined in one task.
    """
    spark = edges.sparkSession
    given = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")), "components")
    e, moves = given, []
    while e.count() > small:
        e = e.filter("a <> b")
        if not e.limit(1).count():
            break
        to = _picked_forest(e, len(moves))
        moves.append(to)
        fewer = e
        for end in ("a", "b"):
            fewer = fewer.join(spark.read.parquet(to.scratch_path).select(F.col("v").alias(end), "up"), end).drop(end).withColumnRenamed("up", end)
        e = materialize(fewer.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components")
    found = _joined_in_one_task(e)
    if not moves:
        return found
    for to in reversed(moves):  # what a vertex became, and where it ended
        last = spark.read.parquet(to.scratch_path).withColumnRenamed("up", "end")
        found = last.join(found.select(F.col("v").alias("end"), "comp"), "end", "left").select("v", F.coalesce("comp", "end").alias("comp"))
    found = materialize(found, "cc-ends")
    first = found.groupBy("comp").agg(F.min("v").alias("first"))
    vertices = given.select(F.col("a").alias("v")).union(given.select(F.col("b").alias("v"))).distinct()
    out = vertices.join(found.join(first, "comp").select("v", "first"), "v", "left").select("v", F.coalesce("first", "v").alias("comp"))
    return materialize(out, "components")


def _joined_in_one_task(e: DataFrame) -> DataFrame:

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = parent.setdefault(x, x)
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for df in batches:
            for a, b in zip(df["a"].tolist(), df["b"].tolist(), strict=True):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)  # the smallest vertex stays the root
        yield pd.DataFrame({"v": list(parent), "comp": [find(v) for v in list(parent)]}, dtype="int64")

    return materialize(e.coalesce(1).mapInPandas(run, "v bigint, comp bigint"), "components")
