"""Spatial chunking, manifest and viewer queries (ML10, SCL20-SCL28, AGG9,
AGG12, AGG13, AGG15, AGG16, FLT7-FLT10, JN4-JN6, WIN7, WIN8, SRC13-SRC15).

Scale notes
-----------
* Bounds are one global aggregate (4 numbers) read back to the driver and
  used as literals -- no one-row cross join.
* Chunks are written with ``partitionBy(grid_x, grid_y)`` straight from the
  producing tasks: a cell that holds a third of all points is spread over
  many files/tasks instead of being collected into one document.
* Range join (points x rectangles) and radius search (probes x points) are
  equi-joins on grid cells plus a residual predicate -- never a cross join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.schemas import POINT_SCHEMA
from linkloom.operators.common import sized_broadcast
from linkloom.operators.graph import dense_index

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
GRID_SIZE = 10            # chunk grid is GRID_SIZE x GRID_SIZE
BOUNDS_PAD = 0.05         # 5 % padding on each side of the point bounds
VIEW_PAD = 0.5            # viewport culling pads 50 % of the view per side
FIT_PADDING = 1.15        # fit-to-view margin factor
HOVER_RADIUS_PX = 10      # nearest-point radius in screen pixels
DOT_FRACTION = 0.22       # dot size as a fraction of the average pixel spacing
DOT_MIN_PX = 1
DOT_MAX_PX = 14
VISIBLE_POINTS_CAP = 350_000
ROWS_PER_FILE = 200_000   # a chunk folder's files hold about so many points
PALETTE = [
    "#e6194B", "#3cb44b", "#ffe119", "#4363d8", "#f58231", "#911eb4", "#42d4f4", "#f032e6",
    "#bfef45", "#fabed4", "#469990", "#dcbeff", "#9A6324", "#fffac8", "#800000", "#aaffc3",
    "#808000", "#ffd8b1", "#000075", "#a9a9a9",
]
NOISE = -1
UNKNOWN_NAME = "Unknown"


# -- bounds and grid ---------------------------------------------------------

def raw_bounds(points: DataFrame) -> dict | None:
    """AGG9: min/max of x and y (None when there are no points)."""
    r = points.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                   F.min("y").alias("y_min"), F.max("y").alias("y_max")).first()
    if r is None or r["x_min"] is None:
        return None
    return {k: float(r[k]) for k in ("x_min", "x_max", "y_min", "y_max")}


def _widened(low: float, high: float, pad: float) -> tuple[float, float]:
    margin = ((high - low) or 1.0) * pad
    return low - margin, high + margin


def pad_bounds(b: dict, pad: float = BOUNDS_PAD) -> dict:
    """SCL23: each axis grows by ``pad`` of its range on both sides; a range of zero counts as 1."""
    (x0, x1), (y0, y1) = (_widened(b[f"{axis}_min"], b[f"{axis}_max"], pad) for axis in "xy")
    return {"x_min": x0, "x_max": x1, "y_min": y0, "y_max": y1}


def cell_index(v: Column, vmin: float, size: float, n: int = GRID_SIZE) -> Column:
    """SCL20: truncate((v - min) / size), clamped to 0..n-1."""
    raw = ((v - F.lit(vmin)) / F.lit(size)).cast("long")  # cast truncates toward zero
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), raw)).cast("int")


def chunk_key(gx: Column, gy: Column) -> Column:
    """SCL21: ``gx_gy``."""
    return F.concat_ws("_", gx.cast("string"), gy.cast("string"))


def chunk_file(gx: Column, gy: Column) -> Column:
    """Chunk location relative to the output folder (partition directories)."""
    return F.concat(F.lit("grid_x="), gx.cast("string"), F.lit("/grid_y="), gy.cast("string"))


def grid_params(points: DataFrame, grid_size: int = GRID_SIZE) -> dict | None:
    """Padded bounds + cell sizes of the non-noise points (None if all noise, Q15)."""
    b = raw_bounds(points.filter(F.col("cluster") != NOISE))
    if b is None:
        return None
    p = pad_bounds(b)
    p["grid_size"] = grid_size
    p["w"] = (p["x_max"] - p["x_min"]) / grid_size
    p["h"] = (p["y_max"] - p["y_min"]) / grid_size
    return p


def assign_cells(points: DataFrame, g: dict) -> DataFrame:
    """FLT7 + SCL20: non-noise points with grid_x, grid_y."""
    n = g["grid_size"]
    return (points.filter(F.col("cluster") != NOISE)
            .withColumn("grid_x", cell_index(F.col("x"), g["x_min"], g["w"], n))
            .withColumn("grid_y", cell_index(F.col("y"), g["y_min"], g["h"], n)))


def cell_bounds(gx: Column, gy: Column, g: dict) -> list[Column]:
    """SCL22: bounds of a cell."""
    return [(F.lit(g["x_min"]) + gx * F.lit(g["w"])).alias("x_min"),
            (F.lit(g["x_min"]) + (gx + 1) * F.lit(g["w"])).alias("x_max"),
            (F.lit(g["y_min"]) + gy * F.lit(g["h"])).alias("y_min"),
            (F.lit(g["y_min"]) + (gy + 1) * F.lit(g["h"])).alias("y_max")]


def chunk_table(cells: DataFrame, g: dict) -> DataFrame:
    """AGG13: one row per non-empty chunk with file, bounds and count."""
    c = cells.groupBy("grid_x", "grid_y").agg(F.count(F.lit(1)).alias("count"))
    return c.select(chunk_key(F.col("grid_x"), F.col("grid_y")).alias("chunk"),
                    chunk_file(F.col("grid_x"), F.col("grid_y")).alias("file"),
                    "grid_x", "grid_y", *cell_bounds(F.col("grid_x"), F.col("grid_y"), g), "count")


def cluster_table(points: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """AGG12 + WIN7: (id, name, count) per non-noise cluster, ordered by id."""
    c = (points.filter(F.col("cluster") != NOISE).groupBy(F.col("cluster").alias("id"))
         .agg(F.count(F.lit(1)).alias("count")))
    if names is not None:
        c = c.join(names.select(F.col("cluster").alias("id"), "name"), "id", "left")
    else:
        c = c.withColumn("name", F.concat(F.lit("cluster "), F.col("id").cast("string")))
    return c.select(F.col("id").cast("int").alias("id"), "name", "count")


def manifest_row(spark: SparkSession, points: DataFrame, names: DataFrame | None = None,
                 grid_size: int = GRID_SIZE) -> DataFrame:
    """SRC14 content: a one-row nested manifest (bounds, grid, totals, clusters, chunks)."""
    g = grid_params(points, grid_size)
    if g is None:
        return spark.createDataFrame([], "bounds struct<x_min:double,x_max:double,y_min:double,y_max:double>, "
                                         "grid_size int, total_points long, num_clusters int, "
                                         "clusters array<struct<id:int,name:string,count:long>>, "
                                         "chunks array<struct<file:string,bounds:struct<x_min:double,"
                                         "x_max:double,y_min:double,y_max:double>,count:long>>")
    cells = assign_cells(points, g)
    chunks = chunk_table(cells, g)
    clusters = cluster_table(points, names)
    # Both sides are single aggregate rows (chunks <= grid_size^2, one entry per
    # cluster); they are zipped by a constant key, not a cross join.
    ch = chunks.groupBy(F.lit(0).alias("k")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("file"), F.struct("x_min", "x_max", "y_min", "y_max").alias("bounds"), F.col("count"))))
        .alias("chunks"), F.sum("count").alias("total_points"))
    cl = clusters.groupBy(F.lit(0).alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("id", "name", "count"))).alias("clusters"),
        F.count(F.lit(1)).alias("num_clusters"))
    return ch.join(cl, "k", "left").select(
        F.struct(*[F.lit(g[k]).alias(k) for k in ("x_min", "x_max", "y_min", "y_max")]).alias("bounds"),
        F.lit(grid_size).alias("grid_size"), F.col("total_points").cast("long").alias("total_points"),
        F.coalesce(F.col("num_clusters"), F.lit(0)).cast("int").alias("num_clusters"),
        F.coalesce(F.col("clusters"), F.array().cast("array<struct<id:int,name:string,count:bigint>>"))
        .alias("clusters"), "chunks")


def write_chunks(points: DataFrame, out_dir: str, names: DataFrame | None = None,
                 grid_size: int = GRID_SIZE) -> dict | None:
    """ML10 + SRC13 + SRC14: partitioned chunk files in a folder of their own run, then the manifest
    that names the folder.  Readers follow the manifest, so they see the old run or the new one and
    never a mixture (Q1).  Rows are dealt out by cell and salt: a cell is a few files, not one from
    every task, and a hot cell is written by many tasks."""
    spark = points.sparkSession
    run = f"run-{uuid.uuid4().hex[:12]}"
    g = grid_params(points, grid_size)
    cells = assign_cells(points, g) if g is not None else points.limit(0).withColumn(
        "grid_x", F.lit(0)).withColumn("grid_y", F.lit(0))
    salts = max(1, cells.count() // ROWS_PER_FILE)
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    (cells.select("id", "title", "cluster", "x", "y", "grid_x", "grid_y").repartition("grid_x", "grid_y", salt)
     .write.mode("overwrite").partitionBy("grid_x", "grid_y").json(f"{out_dir}/{run}"))
    man = manifest_row(spark, points, names, grid_size).withColumn("folder", F.lit(run))
    man.coalesce(1).write.mode("overwrite").json(f"{out_dir}/manifest")
    return g


def read_chunks(spark: SparkSession, out_dir: str) -> DataFrame:
    """SRC15 + SET3: read the manifest and only the chunk folders it lists."""
    man = spark.read.json(f"{out_dir}/manifest")
    if "folder" not in man.columns:  # all points are noise: no chunk, no row
        return spark.createDataFrame([], POINT_SCHEMA)
    # at most grid_size^2 folder names
    files = man.select("folder", F.explode("chunks.file").alias("file")).collect()
    if not files:
        return spark.createDataFrame([], POINT_SCHEMA)
    base = f"{out_dir}/{files[0]['folder']}"
    paths = [f"{base}/{r['file']}" for r in files]
    return (spark.read.option("basePath", base)
            .schema("id long, title string, cluster int, x double, y double").json(paths)
            .select("id", "title", "cluster", "x", "y"))


def chunks_in_view(spark: SparkSession, out_dir: str, view: dict, pad: float = VIEW_PAD) -> tuple[DataFrame, dict]:
    """SRC15 + FLT8 + FLT10: (points inside the padded view, {"read", "within", "listed"} chunk folders).

    The manifest's bounds choose the folders before any file is listed: chunks
    that don't meet the view are never opened, and of those that lie within it
    no point is tested.  Bounds are taken a little wider (narrower for
    "within") than written, as a point on a cell's edge may stand a rounding error outside it.
    """
    w, h = ((view["x_max"] - view["x_min"]) * pad, (view["y_max"] - view["y_min"]) * pad)
    rect = {"x_min": view["x_min"] - w, "x_max": view["x_max"] + w, "y_min": view["y_min"] - h, "y_max": view["y_max"] + h}
    man = spark.read.json(f"{out_dir}/manifest")
    none = spark.createDataFrame([], POINT_SCHEMA), {"read": 0, "within": 0, "listed": 0}
    if "folder" not in man.columns:
        return none
    listed = man.select("folder", "bounds", F.explode("chunks").alias("c")).select("folder", F.col("c.file").alias("file"), *[F.col(f"c.bounds.{b}").alias(b) for b in (
        "x_min", "x_max", "y_min", "y_max")], ((F.col("bounds.x_max") - F.col("bounds.x_min")) * 1e-9).alias("ex"), ((F.col("bounds.y_max") - F.col("bounds.y_min")) * 1e-9).alias("ey"))
    meets = (F.col("x_min") - F.col("ex") <= rect["x_max"]) & (F.col("x_max") + F.col("ex") >= rect["x_min"]) \
        & (F.col("y_min") - F.col("ey") <= rect["y_max"]) & (F.col("y_max") + F.col("ey") >= rect["y_min"])
    wider = [F.col("x_min") - F.col("ex"), F.col("x_max") + F.col("ex"), F.col("y_min") - F.col("ey"), F.col("y_max") + F.col("ey")]
    chunks = listed.select("folder", "file", meets.alias("meets"), rect_contains(rect, wider).alias("within")).collect()  # at most grid_size^2 rows
    if not chunks:
        return none
    base = f"{out_dir}/{chunks[0]['folder']}"
    out = spark.createDataFrame([], POINT_SCHEMA)
    inside = F.col("x").between(rect["x_min"], rect["x_max"]) & F.col("y").between(rect["y_min"], rect["y_max"])
    for within in (True, False):
        paths = [f"{base}/{c['file']}" for c in chunks if c["meets"] and c["within"] == within]
        if paths:
            rows = spark.read.option("basePath", base).schema(POINT_SCHEMA).json(paths).select("id", "title", "cluster", "x", "y")
            out = out.unionByName(rows if within else rows.filter(inside))
    return out, {"read": sum(c["meets"] for c in chunks), "within": sum(c["within"] for c in chunks), "listed": len(chunks)}


# -- viewer queries ------------------------------------------------------------

def rect_contains(a: dict, b_cols: list[Column]) -> Column:
    """FLT10: rectangle ``a`` contains rectangle ``b`` (column form)."""
    bx0, bx1, by0, by1 = b_cols
    return ((F.lit(a["x_min"]) <= bx0) & (F.lit(a["x_max"]) >= bx1) &
            (F.lit(a["y_min"]) <= by0) & (F.lit(a["y_max"]) >= by1))


def pad_rect_cols(df: DataFrame, pad: float = VIEW_PAD) -> DataFrame:
    """FLT8 padding on rectangle rows (x_min, x_max, y_min, y_max)."""
    pw = (F.col("x_max") - F.col("x_min")) * pad
    ph = (F.col("y_max") - F.col("y_min")) * pad
    return df.select("*", (F.col("x_min") - pw).alias("fx_min"), (F.col("x_max") + pw).alias("fx_max"),
                     (F.col("y_min") - ph).alias("fy_min"), (F.col("y_max") + ph).alias("fy_max"))


def range_join(points: DataFrame, rects: DataFrame, origin: tuple[float, float], cell: float,
               rect_cols=("fx_min", "fx_max", "fy_min", "fy_max"), max_cells_per_rect: int = 1 << 16) -> DataFrame:
    """JN6: points x rectangles with inclusive edges via grid buckets.

    Each point falls in exactly one bucket; each rectangle, clamped to the
    points' bounds, is exploded to the buckets it overlaps.  Buckets are made
    coarser, for points and rectangles alike, until no rectangle overlaps more
    than ``max_cells_per_rect`` of them, so no pair is dropped and a zoomed-out
    rectangle stays bounded.  Pairs are found by an equi-join on the bucket and
    the residual ``between`` test.
    """
    bounds = raw_bounds(points)
    if bounds is None:
        return _without_rows(points, rects)
    clamp = lambda c, lo, hi: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
    clamped = [clamp(rect_cols[0], bounds["x_min"], bounds["x_max"]), clamp(rect_cols[1], bounds["x_min"], bounds["x_max"]),
               clamp(rect_cols[2], bounds["y_min"], bounds["y_max"]), clamp(rect_cols[3], bounds["y_min"], bounds["y_max"])]
    area = rects.agg(F.max((clamped[1] - clamped[0]) / cell + 2).alias("w"), F.max((clamped[3] - clamped[2]) / cell + 2).alias("h")).first()
    if area["w"] is None:
        return _without_rows(points, rects)
    while area["w"] * area["h"] > max_cells_per_rect:
        cell *= 2
        area = {"w": area["w"] / 2 + 1, "h": area["h"] / 2 + 1}
    x0, y0 = origin
    rx0, rx1, ry0, ry1 = [F.col(c) for c in rect_cols]
    bx = lambda v: F.floor((v - F.lit(x0)) / F.lit(cell)).cast("long")
    by = lambda v: F.floor((v - F.lit(y0)) / F.lit(cell)).cast("long")
    overlap = (rx0 <= bounds["x_max"]) & (rx1 >= bounds["x_min"]) & (ry0 <= bounds["y_max"]) & (ry1 >= bounds["y_min"]) & (rx0 <= rx1) & (ry0 <= ry1)
    r = rects.filter(overlap).select("*", F.explode(F.sequence(bx(clamped[0]), bx(clamped[1]))).alias("bx")).select(
        "*", F.explode(F.sequence(by(clamped[2]), by(clamped[3]))).alias("by"))
    p = points.select("*", bx(F.col("x")).alias("bx"), by(F.col("y")).alias("by"))
    # rectangles are the small side: broadcast after a check of their size, so a hot bucket of points isn't shuffled
    j = p.join(sized_broadcast(r.drop(*[c for c in points.columns if c in r.columns])), ["bx", "by"], "inner")
    return j.filter(F.col("x").between(rx0, rx1) & F.col("y").between(ry0, ry1)).drop("bx", "by")


def _without_rows(points: DataFrame, rects: DataFrame) -> DataFrame:
    """The columns of a range join without rows."""
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in rects.schema if f.name not in points.columns]
    return points.limit(0).select("*", *more)


def viewport_filter(points: DataFrame, views: DataFrame, cell: float | None = None,
                    selected_cluster: int | None = None) -> DataFrame:
    """FLT8 + FLT9 + JN6: points inside each view padded by 50 % per side."""
    if selected_cluster is not None:
        points = points.filter(F.col("cluster") == selected_cluster)
    padded = pad_rect_cols(views)
    b = raw_bounds(points)
    if b is None:
        return _without_rows(points, padded)
    if cell is None:
        span = max(b["x_max"] - b["x_min"], b["y_max"] - b["y_min"], 1e-12)
        cell = span / 32.0
    return range_join(points, padded, (b["x_min"], b["y_min"]), cell)


#: Bits of the hash by which points are thinned, and bits that one histogram tells apart.
_CAP_BITS, _CAP_STEP = 60, 12


def visible_cap(df: DataFrame, cap: int = VISIBLE_POINTS_CAP, key: str = "id") -> DataFrame:
    """WIN8: stable thinning to exactly ``cap`` rows (all, if fewer): the first in order of the key's MD5, not of arrival.

    The threshold is found on histograms of the hash -- 4 096 counts each, of
    twelve more bits of those rows only that share all bits so far -- so nothing but the
    few rows that share the last bar with the threshold is ever ordered.
    """
    place = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, _CAP_BITS // 4), 16, 10).cast("bigint")
    rows = df.withColumn("_place", place)
    low, need, shift = 0, cap, _CAP_BITS
    while shift > 0:
        shift -= _CAP_STEP
        inside = rows.filter(F.col("_place").between(low, low + (1 << shift + _CAP_STEP) - 1))
        bars = inside.groupBy(F.shiftright("_place", shift).alias("bar")).agg(F.count(F.lit(1)).alias("n")).collect()
        for bar, n in sorted((r["bar"], r["n"]) for r in bars):
            if n > need:
                low = bar << shift
                break
            need -= n
        else:
            return df  # no more rows than the cap
        if n <= 1 << _CAP_STEP:
            break
    under = rows.filter(F.col("_place") < low)
    last = rows.filter(F.col("_place").between(low, low + (1 << shift) - 1)).orderBy("_place", key).limit(need)
    return under.unionByName(last).drop("_place")


def hover_radius(zoom: Column) -> Column:
    """JN5 radius in world units: 10 px / max(1, zoom)."""
    return F.lit(float(HOVER_RADIUS_PX)) / F.greatest(F.lit(1.0), zoom)


def nearest_point(points: DataFrame, probes: DataFrame) -> DataFrame:
    """JN5: for each probe (probe_id, px, py, r) the nearest point with squared
    distance strictly below r^2; ties -> lower id; misses kept with nulls.

    Points are bucketed on cells of side 2^ceil(log2 r) (>= r) per distinct
    level, probes look at their 3 x 3 cell neighbourhood.
    """
    lvl = F.ceil(F.log2(F.col("r"))).cast("int")
    pr = probes.withColumn("lvl", lvl)
    levels = sorted(int(r[0]) for r in pr.select("lvl").distinct().collect())  # few distinct radii
    side = F.pow(F.lit(2.0), F.col("lvl"))
    pts = (points.select("id", "x", "y", F.explode(F.array(*[F.lit(v) for v in levels])).alias("lvl"))
           .withColumn("cx", F.floor(F.col("x") / side).cast("long"))
           .withColumn("cy", F.floor(F.col("y") / side).cast("long")))
    offs = F.array(*[F.lit(o) for o in (-1, 0, 1)])
    pq = (pr.withColumn("dx", F.explode(offs)).withColumn("dy", F.explode(offs))
          .withColumn("cx", F.floor(F.col("px") / side).cast("long") + F.col("dx"))
          .withColumn("cy", F.floor(F.col("py") / side).cast("long") + F.col("dy")))
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + \
         (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    # probes are the small side: broadcast after a check of their size, points stay where they are however few
    # cells they share, and each task sends its nearest point per probe only
    hits = (pts.join(sized_broadcast(pq), ["lvl", "cx", "cy"], "inner")
            .select("probe_id", "id", d2.alias("d2"), "r")
            .filter(F.col("d2") < F.col("r") * F.col("r")))
    best = hits.groupBy("probe_id").agg(F.min_by(F.struct("d2", "id"), F.struct("d2", "id")).alias("b"))
    return (probes.select("probe_id").join(best, "probe_id", "left")
            .select("probe_id", F.col("b.id").alias("id"), F.col("b.d2").alias("d2")))


def fit_view(g: dict, width: int, height: int) -> dict:
    """SCL28: zoom and centre that fit the manifest bounds into a canvas."""
    rx = g["x_max"] - g["x_min"]
    ry = g["y_max"] - g["y_min"]
    zoom = min(width / (rx * FIT_PADDING), height / (ry * FIT_PADDING))
    return {"zoom": zoom, "cx": (g["x_min"] + g["x_max"]) / 2, "cy": (g["y_min"] + g["y_max"]) / 2,
            "width": width, "height": height}


def view_rect(v: dict) -> dict:
    """Viewport in world units of a camera (screenToWorld of the canvas corners)."""
    hw = v["width"] / 2 / v["zoom"]
    hh = v["height"] / 2 / v["zoom"]
    return {"x_min": v["cx"] - hw, "x_max": v["cx"] + hw, "y_min": v["cy"] - hh, "y_max": v["cy"] + hh}


def dot_size(n: Column, area: Column, ppwu: Column) -> Column:
    """AGG16: clamp(round(sqrt(area / max(n,1)) * ppwu * 0.22), 1, 14)."""
    spacing = F.sqrt(area / F.greatest(n, F.lit(1)).cast("double"))
    return F.greatest(F.lit(DOT_MIN_PX), F.least(F.lit(DOT_MAX_PX),
                      F.floor(spacing * ppwu * F.lit(DOT_FRACTION) + F.lit(0.5)).cast("int")))


def density_raster(points: DataFrame, rect: dict, ppwu: float) -> DataFrame:
    """SCL27 + AGG15: pixel cells of a raster over ``rect``; per pixel the
    cluster with most points (ties -> lowest cluster id) and its count."""
    inside = points.filter(F.col("x").between(rect["x_min"], rect["x_max"]) &
                           F.col("y").between(rect["y_min"], rect["y_max"]))
    px, py = world_to_pixel(F.col("x"), rect["x_min"], ppwu), world_to_pixel(F.col("y"), rect["y_min"], ppwu)
    c = inside.groupBy(px.alias("px"), py.alias("py"), "cluster").agg(F.count(F.lit(1)).alias("n"))
    return (c.groupBy("px", "py")
            .agg(F.max_by(F.struct("n", (-F.col("cluster")).alias("nc"), "cluster"),
                          F.struct("n", (-F.col("cluster")).alias("nc"))).alias("b"))
            .select("px", "py", F.col("b.cluster").alias("cluster"), F.col("b.n").alias("n")))


def cluster_lookup(points: DataFrame, clusters: DataFrame, base_url: str = "item?id=") -> DataFrame:
    """JN4 + SCL26: point -> cluster name (``Unknown`` if absent) and permalink."""
    names = clusters.select(F.col("id").alias("cluster"), "name")
    return (points.join(sized_broadcast(names), "cluster", "left")
            .select("id", "cluster", F.coalesce("name", F.lit(UNKNOWN_NAME)).alias("name"),
                    F.concat(F.lit(base_url), F.col("id").cast("string")).alias("link")))


def palette(clusters: DataFrame) -> DataFrame:
    """SCL25: colour = palette[(position in id order) mod 20]."""
    colours = F.array(*[F.lit(c) for c in PALETTE])
    placed = dense_index(clusters.select("id"), "id", "pos")
    return placed.select("id", F.pmod("pos", F.lit(len(PALETTE))).cast("int").alias("color_index")).select(
        "id", "color_index", F.element_at(colours, F.col("color_index") + 1).alias("color"))


def world_to_pixel(v: Column, vmin: float, ppwu: float) -> Column:
    """SCL27: round((v - min) * ppwu) as the page does (half up)."""
    return F.floor((v - F.lit(vmin)) * F.lit(ppwu) + F.lit(0.5)).cast("long")
