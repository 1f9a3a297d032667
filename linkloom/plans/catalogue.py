"""Query catalogue: name -> fn(spark, sf_dir) -> DataFrame.

Each query reads the driver tables (via ``linkloom.sources.tables``) over
their whole extent and returns a DataFrame with explicitly named and typed
columns; doubles are rounded to 6 decimals so an independent SQL engine can
be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import clean_title
from linkloom.functions.urls import suffix_rules_df
from linkloom.functions.vectors import l2_normalize, vec_to_json
from linkloom.operators import blocklist as bl
from linkloom.operators import embed as em
from linkloom.operators import ingest as ig
from linkloom.operators import density as dn
from linkloom.operators import graph as gr
from linkloom.operators import keywords as kw
from linkloom.operators import layout as lo
from linkloom.operators import knn
from linkloom.operators import naming as nm
from linkloom.operators import profiles as pr
from linkloom.operators import spatial as sp
from linkloom.operators import vectors as vc
from linkloom.operators.common import tolerant_int
from linkloom.plans.cluster_map import cluster_space, full_epochs
from linkloom.schemas import POST_COLUMNS
from linkloom.session import materialize, scratch_dir
from linkloom.sources import tables as tb
from linkloom.streaming import commits as co
from linkloom.streaming import ingest as st

ROUND = 6

# ---------------------------------------------------------------------------
# The inline blocklist of the fixture join queries.
# ---------------------------------------------------------------------------
FIXTURE_BLOCKLIST = ["spam-farm.example.org", "cheap-pills.example.com", "example.net"]
# ICANN suffixes of the driver table's hosts; a user passes the public list.
FIXTURE_SUFFIXES = ["com", "net", "org"]


def _r(c):
    return F.round(c.cast("double"), ROUND)


# -- site profiles ----------------------------------------------------------

def host_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.host_ranking(tb.pages_as_posts(spark, sf_dir), bar=0, k=50)


def host_top50_high_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.host_ranking(tb.pages_as_posts(spark, sf_dir), bar=pr.HIGH_SCORE_BAR, k=50)


def domain_label_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.domain_ranking(tb.pages_as_posts(spark, sf_dir), suffix_rules_df(spark, FIXTURE_SUFFIXES), bar=0, k=50)


def blocklist_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bl.blocklist_from_values(spark, FIXTURE_BLOCKLIST)
    out = bl.blocklist_counts(tb.pages_as_posts(spark, sf_dir), b)
    return out.select("total_posts", "blacklisted_posts", "non_blacklisted_posts",
                      _r(F.col("pct_blacklisted")).alias("pct_blacklisted"),
                      _r(F.col("pct_non_blacklisted")).alias("pct_non_blacklisted"))


def blocklist_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bl.blocklist_from_values(spark, FIXTURE_BLOCKLIST)
    out = bl.blocklist_score_summary(tb.pages_as_posts(spark, sf_dir), b)
    return out.select("blacklisted", "n", "min", _r(F.col("q1")).alias("q1"),
                      _r(F.col("median")).alias("median"), _r(F.col("q3")).alias("q3"), "max")


def blocklist_post_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bl.blocklist_from_values(spark, FIXTURE_BLOCKLIST)
    out = bl.flag_posts(tb.pages_as_posts(spark, sf_dir), b)
    return out.select("id", "host", "blacklisted")


# -- score / time profiles --------------------------------------------------

def event_value_five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tb.events_as_timed_posts(spark, sf_dir)
    out = pr.five_number_summary(ev, "score", ["event_type"])
    return out.select("event_type", "n", _r(F.col("min")).alias("min"), _r(F.col("q1")).alias("q1"),
                      _r(F.col("median")).alias("median"), _r(F.col("q3")).alias("q3"),
                      _r(F.col("max")).alias("max"))


def time_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.time_cells(tb.events_as_timed_posts(spark, sf_dir))


def time_pivot_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.time_pivot(tb.events_as_timed_posts(spark, sf_dir), high=True)


def time_pivot_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.time_pivot(tb.events_as_timed_posts(spark, sf_dir), high=False)


# -- keywords ----------------------------------------------------------------

def _doc_posts(spark, sf_dir):
    return tb.documents_as_posts(spark, sf_dir)


def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pr.drop_missing(_doc_posts(spark, sf_dir), ["title"])
    return docs.select("id", "title", clean_title(F.col("title")).alias("clean_title"))


def tokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kw.doc_tokens(kw.keyword_docs(_doc_posts(spark, sf_dir)))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kw.term_stats(kw.doc_term_counts(kw.keyword_docs(_doc_posts(spark, sf_dir))))


def vocab_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(kw.term_stats(kw.doc_term_counts(kw.keyword_docs(_doc_posts(spark, sf_dir)))), "term-stats")
    return kw.cap_vocabulary(stats, kw.MAX_FEATURES)


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = materialize(kw.doc_term_arrays(kw.keyword_docs(_doc_posts(spark, sf_dir))), "term-counts")
    stats = materialize(kw.term_stats(kw.explode_terms(per_doc)), "term-stats")
    return kw.idf_table(kw.cap_vocabulary(stats, kw.MAX_FEATURES), per_doc.count()).select("term", _r(F.col("idf")).alias("idf"))


def keyword_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = kw.keyword_ranking(_doc_posts(spark, sf_dir), k=50)
    return top.select("term", _r(F.col("tfidf")).alias("tfidf"))


# -- vectors ------------------------------------------------------------------

KNN_K = 5
MIN_SAMPLES = 5


def _emb(spark, sf_dir):
    return tb.read_table(spark, sf_dir, "embeddings")


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).select("vec_id", l2_normalize(F.col("embedding")).alias("u"))
    return vc.long_form(e, ["vec_id"], "u").select("vec_id", "dim", _r(F.col("x")).alias("x"))


def _tagged(spark, sf_dir):
    """Every vector tagged with its nearest prototype; the prototypes are the unit
    centroids of the fixture labels, derived from the whole table (one per label,
    size-checked before the broadcast)."""
    e = _emb(spark, sf_dir)
    protos = vc.wide_form(vc.group_centroids(e, "label", "embedding"), "label").select(
        F.col("label").cast("long").alias("tag_idx"), "embedding")
    t = vc.assign_labels(e.select("vec_id", "embedding"), protos, "embedding", "tag_idx")
    return t.withColumn("tag", F.concat(F.lit("tag_"), F.col("tag_idx").cast("string")))


def tag_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("vec_id", "tag_idx", "tag", _r(F.col("sim")).alias("sim"))


def tag_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vc.tag_ranking(_tagged(spark, sf_dir), "tag").select("tag", "count", F.col("rank").cast("int"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vc.group_centroids(_emb(spark, sf_dir), "label", "embedding")
    return c.select(F.col("label").cast("int"), "dim", _r(F.col("x")).alias("x"))


def zscore_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = vc.zscore_stats(_emb(spark, sf_dir), "embedding")
    return z.select("dim", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"))


def zscore_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = vc.zscore(_emb(spark, sf_dir).select("vec_id", "embedding"), "embedding", "z")
    return vc.long_form(z.select("vec_id", "z"), ["vec_id"], "z").select("vec_id", "dim", _r(F.col("x")).alias("z"))


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    nn = knn.knn_exact(_emb(spark, sf_dir), KNN_K, "vec_id", "embedding", metric="cosine")
    return nn.select("id", "rank", "nbr", _r(F.col("score")).alias("score"))


def knn_cells_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell-pruned exact kNN path (for large n) on the same vectors."""
    nn = knn.knn_cells(_emb(spark, sf_dir), KNN_K, "vec_id", "embedding", metric="euclidean",
                       cell_rows=128, block_rows=128)
    return nn.select("id", "rank", "nbr", _r(-F.col("score")).alias("dist"))


def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cd = knn.core_distances(_emb(spark, sf_dir), MIN_SAMPLES, "vec_id", "embedding")
    return cd.select("id", _r(F.col("core_dist")).alias("core_dist"))


def embed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.documents_as_posts(spark, sf_dir)
    return em.hashed_vectors(d, "title", "id").select("id", "dim", _r(F.col("x")).alias("x"))


# -- reduction, graph layout, density clustering -----------------------------------

def _pca(spark, sf_dir, k=lo.PCA_COMPONENTS):
    return lo.pca(_emb(spark, sf_dir).select("vec_id", "embedding"), k, "embedding", "pca")


def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ratios = _pca(spark, sf_dir)
    comps = _emb(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"))
    return comps.select(F.posexplode(F.array(*[F.lit(r) for r in ratios])).alias("component", "ratio"),
                        "n_rows").select((F.col("component") + 1).alias("component"),
                                         _r(F.col("ratio")).alias("explained_variance_ratio"), "n_rows")


def knn_descent_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7: of every vector's 15 exact neighbours (PCA, cosine), those that neighbour descent lists; both paths over the whole table."""
    p, _ = _pca(spark, sf_dir)
    p = materialize(p.select(F.col("vec_id").alias("id"), F.col("pca").alias("v")), "pca")
    k = lo.VIEW_NEIGHBORS
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = p.withColumn("v", F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-12))))
    exact = knn.knn_exact(unit, k).select("id", "nbr", F.lit(1).alias("e"))
    near = knn.knn_descent(unit, k).select("id", "nbr", F.lit(1).alias("d"))
    both = exact.join(near, ["id", "nbr"], "full")
    counts = both.agg(F.count("e").alias("n_exact"), F.count("d").alias("n_descent"), F.count_if(F.col("e").isNotNull() & F.col("d").isNotNull()).alias("hits"))
    return counts.select("n_exact", "n_descent", (F.col("hits") >= 0.9 * F.col("n_exact")).alias("recall_reached"))


def fuzzy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _pca(spark, sf_dir)
    g = lo.fuzzy_graph(p, lo.VIEW_NEIGHBORS, "vec_id", "pca", metric="cosine")
    return g.select("a", "b", _r(F.col("w")).alias("w"))


def layout_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _pca(spark, sf_dir)
    p = materialize(p, "pca")
    g = lo.fuzzy_graph(p, lo.VIEW_NEIGHBORS, "vec_id", "pca", metric="cosine")
    out = lo.layout(p, g, "pca", lo.VIEW_DIMS, lo.VIEW_MIN_DIST, n_epochs=full_epochs(p.count()), id_col="vec_id")
    return out.select("vec_id", _r(F.col("x0")).alias("x"), _r(F.col("x1")).alias("y"))


def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _pca(spark, sf_dir)
    p = materialize(p, "pca")
    space = materialize(cluster_space(p, full_epochs(p.count()), "vec_id"), "cluster-space")
    return dn.density_clusters(space, dn.MIN_CLUSTER_SIZE, dn.MIN_SAMPLES, id_col="vec_id")


def mutual_reachability_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML7 step 1: the neighbour graph's edges under mutual reachability."""
    edges, _ = dn.mutual_reachability_edges(_emb(spark, sf_dir), MIN_SAMPLES, id_col="vec_id", vec_col="embedding")
    return edges.select("a", "b", _r(F.col("w")).alias("w"))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML8: components of the graph that joins every vector with its nearest neighbour."""
    nearest = knn.knn_exact(_emb(spark, sf_dir), 1, "vec_id", "embedding", metric="euclidean")
    return gr.connected_components(nearest, "id", "nbr").select(F.col("v").alias("id"), "comp")


def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML8: the minimum spanning tree of all pairs under mutual reachability."""
    tree = dn.spanning_tree(_emb(spark, sf_dir), MIN_SAMPLES, id_col="vec_id", vec_col="embedding")
    return tree.select("a", "b", _r(F.col("w")).alias("w"))


# -- spatial --------------------------------------------------------------------

#: Views as (left, bottom, share of the grid's sides), and the cap of the fixture's thinning query.
VIEWS = {"corner": (0.0, 0.0, 0.15), "middle": (0.43, 0.41, 0.2), "all": (0.0, 0.0, 1.0)}
CAP = 700
CANVAS = (160, 120)          # canvas of the fixture view queries, pixels
ZOOMS = (1.0, 50.0, 400.0)   # probe zoom levels of the nearest-point query


def _points(spark, sf_dir):
    return tb.embeddings_as_points(spark, sf_dir)


def _grid(spark, sf_dir):
    pts = _points(spark, sf_dir)
    return pts, sp.grid_params(pts)


def grid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts, g = _grid(spark, sf_dir)
    ch = sp.chunk_table(sp.assign_cells(pts, g), g)
    return ch.select("chunk", "file", "grid_x", "grid_y", *[_r(F.col(c)).alias(c) for c in
                                                           ("x_min", "x_max", "y_min", "y_max")], "count")


def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sp.manifest_row(spark, _points(spark, sf_dir))
    return m.select(*[_r(F.col(f"bounds.{c}")).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")],
                    "grid_size", "total_points", "num_clusters", F.size("chunks").alias("n_chunks"),
                    F.aggregate("clusters", F.lit(0).cast("long"), lambda a, c: a + c["count"])
                    .alias("clustered_points"))


def viewport_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13-SRC15 + FLT10: the points of three views read back from chunk folders, of which the manifest's bounds choose
    those that are opened."""
    pts, g = _grid(spark, sf_dir)
    out = scratch_dir(spark, "view-chunks")
    sp.write_chunks(pts, out)
    found = None
    for name, (x, y, share) in VIEWS.items():
        w, h = g["x_max"] - g["x_min"], g["y_max"] - g["y_min"]
        view = {"x_min": g["x_min"] + x * w, "x_max": g["x_min"] + (x + share) * w, "y_min": g["y_min"] + y * h, "y_max": g["y_min"] + (y + share) * h}
        rows, chunks = sp.chunks_in_view(spark, out, view)
        part = rows.select(F.lit(name).alias("view"), "id", "cluster", *[F.lit(chunks[c]).cast("long").alias(f"chunks_{c}") for c in ("read", "within", "listed")])
        found = part if found is None else found.unionByName(part)
    return found


def visible_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8: the points that stay visible under a cap, over all events."""
    e = tb.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id")
    return sp.visible_cap(e, CAP)


def viewport_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts, g = _grid(spark, sf_dir)
    cells = sp.assign_cells(pts, g).select("id", "x", "y", "cluster")
    views = sp.chunk_table(sp.assign_cells(pts, g), g).select(
        F.col("chunk").alias("view"), "x_min", "x_max", "y_min", "y_max")
    return sp.viewport_filter(cells, views).select("view", "id")


def _probes(points):
    nn = points.filter(F.col("cluster") != sp.NOISE)
    c = nn.groupBy("cluster").agg(F.avg("x").alias("px"), F.avg("y").alias("py"))
    z = F.explode(F.array(*[F.struct(F.lit(i).alias("zi"), F.lit(v).alias("zoom")) for i, v in enumerate(ZOOMS)]))
    return c.select("cluster", "px", "py", z.alias("z")).select(
        (F.col("cluster").cast("long") * 10 + F.col("z.zi")).alias("probe_id"), "px", "py",
        sp.hover_radius(F.col("z.zoom")).alias("r"))


def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _points(spark, sf_dir).filter(F.col("cluster") != sp.NOISE)
    out = sp.nearest_point(pts, _probes(pts))
    return out.select("probe_id", "id", _r(F.col("d2")).alias("d2"))


def _raster_view(g):
    v = sp.fit_view(g, *CANVAS)
    r = sp.view_rect(v)
    pw = (r["x_max"] - r["x_min"]) * 0.5
    ph = (r["y_max"] - r["y_min"]) * 0.5
    rect = {"x_min": r["x_min"] - pw, "x_max": r["x_max"] + pw, "y_min": r["y_min"] - ph, "y_max": r["y_max"] + ph}
    return v, rect


def density_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts, g = _grid(spark, sf_dir)
    v, rect = _raster_view(g)
    return sp.density_raster(sp.assign_cells(pts, g), rect, v["zoom"]).select(
        "px", "py", "cluster", "n")


def fit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts, g = _grid(spark, sf_dir)
    v, rect = _raster_view(g)
    inside = sp.assign_cells(pts, g).filter(F.col("x").between(rect["x_min"], rect["x_max"]) &
                                            F.col("y").between(rect["y_min"], rect["y_max"]))
    area = (rect["x_max"] - rect["x_min"]) * (rect["y_max"] - rect["y_min"])
    n = inside.agg(F.count(F.lit(1)).alias("n"))
    return n.select(_r(F.lit(v["zoom"])).alias("zoom"), _r(F.lit(v["cx"])).alias("center_x"),
                    _r(F.lit(v["cy"])).alias("center_y"), F.col("n").alias("n_visible"),
                    sp.dot_size(F.col("n"), F.lit(area), F.lit(v["zoom"])).alias("dot_px"))


def _embedding_cluster_names(pts):
    return nm.longest_title_names(pts.filter(F.col("cluster") != sp.NOISE), "cluster", "title", "id")


def cluster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _points(spark, sf_dir)
    names = _embedding_cluster_names(pts).select(F.col("cluster").alias("id"), "name")
    return sp.cluster_lookup(pts, names)


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dn.cluster_summary(_points(spark, sf_dir).select("id", "cluster"))


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _points(spark, sf_dir)
    return sp.palette(sp.cluster_table(pts))


# -- naming -------------------------------------------------------------------------

def title_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.documents_as_posts(spark, sf_dir)
    return nm.title_sample(d, "lang", "id").select("lang", "id", "title")


def cluster_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL29: the prompt of every language's title sample, as its MD5 and length."""
    p = nm.prompt_text(title_sample(spark, sf_dir), "lang", "title")
    return p.select("lang", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n_chars"))


def longest_title_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.documents_as_posts(spark, sf_dir)
    return nm.longest_title_names(d, "lang", "title", "id")


# -- ingest -------------------------------------------------------------------------

CUTOFF_EPOCH = 1705276800  # 2024-01-15T00:00:00Z, the fixture harvest cut-off


def stories_until_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ig.stories_until_cutoff(tb.events_as_items(spark, sf_dir), CUTOFF_EPOCH)


def id_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = tb.read_table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    b = ig.id_batches(spark, int(start))
    return b.groupBy("batch").agg(F.max_by("id", -F.col("position")).alias("batch_start"), F.max_by("id", "position").alias("batch_end"),
                                  F.count(F.lit(1)).alias("n_ids"))


def dedupe_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return ig.dedupe_ids(d.unionByName(d), "id")


def post_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.read_table(spark, sf_dir, "documents")
    posts = d.select(F.col("doc_id").alias("id"), F.lit("story").alias("type"), F.col("source").alias("by"),
                     F.lit(None).cast("long").alias("time_unix"), F.lit(None).cast("string").alias("time_iso"),
                     F.col("text").alias("title"), F.col("n_chars").alias("score"),
                     F.lit(0).cast("long").alias("descendants"), F.lit("").alias("url"), F.col("text"))
    path = scratch_dir(spark, "posts-csv")
    ig.export_csv(posts, path)
    back = pr.drop_missing(ig.read_posts_csv(spark, path), ["title"])
    return back.select("id", "title", "score", "by", F.length("text").alias("text_len"))


def ingest_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items land as NDJSON files in three steps -- new ids, new ids with replays, a late replay of all --
    with a run of the stream on the same checkpoint after each; the sink is read back."""
    items = tb.events_as_items(spark, sf_dir).select(
        "id", "type", "by", "time", "title", F.col("score_value").cast("long").alias("score"), "descendants",
        "url", "text")
    landing, sink, ckpt = (scratch_dir(spark, n) for n in ("landing", "posts", "ingest-ckpt"))
    third = F.pmod(F.xxhash64("id"), F.lit(3))
    for step in (third == 0, third <= 1, third <= 2):
        items.filter(step).repartition(2, "id").write.mode("append").json(landing)
        co.run_landing(spark, landing, sink, ckpt, max_files_per_trigger=2)
    return co.read_posts(spark, sink)


def _broken_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as lines, of which every 17th is cut short, every 19th has no id and every 23rd no time."""
    i = tb.events_as_items(spark, sf_dir).select("id", "type", "by", "time", F.col("score_value").cast("long").alias("score"))
    fault = F.when(F.col("id") % 17 == 0, "not json").when(F.col("id") % 19 == 0, "no id").when(F.col("id") % 23 == 0, "no time").otherwise("")
    keep = lambda c, name: F.when(fault != name, F.col(c)).alias(c)
    line = F.to_json(F.struct(keep("id", "no id"), "type", "by", keep("time", "no time"), "score"))
    return i.withColumn("line", line).select(F.when(fault == "not json", F.expr("left(line, length(line) - 2)")).otherwise(F.col("line")).alias("value"))


def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2 + SRC5: broken lines land among good ones, a batch fails between its folder and its commit and runs again;
    accepted and rejected lines of each kind add up."""
    landing, sink, ckpt = (scratch_dir(spark, n) for n in ("landing", "posts", "ingest-ckpt"))
    _broken_landing(spark, sf_dir).repartition(4).write.text(landing)

    def fail(number: int) -> None:
        if number == 1:
            raise OSError("lost between folder and commit")

    try:
        co.run_landing(spark, landing, sink, ckpt, before_commit=fail)
    except StreamingQueryException:
        pass
    co.run_landing(spark, landing, sink, ckpt)
    rows = co.read_landed(spark, sink)
    return rows.groupBy("kind", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("id").alias("ids"), F.coalesce(F.sum("score"), F.lit(0)).alias("score"),
        F.count_if(F.col("type") == "story").alias("stories"))


def ingest_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: what a listener observed in all micro-batches, beside what the sink holds."""
    landing, sink, ckpt = (scratch_dir(spark, n) for n in ("landing", "posts", "ingest-ckpt"))
    _broken_landing(spark, sf_dir).repartition(5).write.text(landing)
    meter = co.Meter()
    co.run_landing(spark, landing, sink, ckpt, max_files_per_trigger=2, meter=meter)
    seen = meter.totals()
    landed = co.read_landed(spark, sink).agg(F.count(F.lit(1)).alias("landed"))
    return landed.select(*[F.lit(seen[c]).cast("long").alias(c) for c in ("batches", "lines", "items", "rejected")], "landed")


DIRTY_FILE_ROWS = 20_000  # rows of a written CSV file


def post_csv_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: documents as CSV files with bytes that are not UTF-8 in front of, within and behind every text; the texts come back as they were."""
    d = tb.read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    raw = lambda c: F.regexp_replace(c, '"', '""').cast("binary")
    bad = lambda h: F.unhex(F.lit(h))
    half = F.floor(F.length("text") / 2).cast("int")
    field = F.concat(bad("FF"), raw(F.substring("text", F.lit(1), half)), bad("C0AF"), raw(F.expr("substring(text, int(floor(length(text) / 2)) + 1)")), bad("E282"))
    text = lambda s: F.lit(s).cast("binary")
    rest = [text(f',"{x}"') for x in ("story", "by")]
    line = F.concat(F.col("doc_id").cast("string").cast("binary"), *rest, text(',,,"'), field, text('",'), F.col("n_chars").cast("string").cast("binary"), text(',0,"",""'))
    path = scratch_dir(spark, "dirty-csv")
    files = max(2, -(-d.count() // DIRTY_FILE_ROWS))
    header = spark.range(files).select(F.col("id").alias("file"), F.lit(0).alias("o"), F.lit(",".join(POST_COLUMNS)).alias("value"))  # every file has its header
    rows = d.select(F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("file"), F.lit(1).alias("o"), line.cast("string").alias("value"))
    rows = header.unionByName(rows).repartition("file").sortWithinPartitions("file", "o").select("file", "value")
    rows.write.partitionBy("file").text(path)
    back = ig.read_posts_csv_tolerant(spark, path)
    return back.select(F.col("id").try_cast("bigint").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.col("score").try_cast("bigint").alias("score"))


def stream_time_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: weekday x hour x class counts maintained as streaming state over
    landed items; the counts so far replace a Parquet table after each micro-batch."""
    items = tb.events_as_items(spark, sf_dir).select(
        "id", "type", "by", "time", "title", F.col("score_value").cast("long").alias("score"), "descendants",
        "url", "text")
    landing = scratch_dir(spark, "cells-landing")
    items.repartition(3, "id").write.mode("append").json(landing)
    posts = tb.post_from_item(st.item_stream(spark, landing, max_files_per_trigger=1))
    sink = scratch_dir(spark, "cells")
    st.run_time_cells(posts, sink, scratch_dir(spark, "cells-ckpt"))
    return spark.read.parquet(sink)


def stream_post_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: every landed post of a stream with its blocklist flag, micro-batch by micro-batch."""
    pages = tb.pages_as_posts(spark, sf_dir)
    landing, sink = scratch_dir(spark, "flag-landing"), scratch_dir(spark, "flags")
    pages.select("id", F.lit("story").alias("type"), F.lit(0).cast("long").alias("time"), "score", "url").repartition(3, "id").write.mode("append").json(landing)
    posts = st.stories(st.item_stream(spark, landing, max_files_per_trigger=1)).select("id", "url")
    st.run_flags(posts, bl.blocklist_from_values(spark, FIXTURE_BLOCKLIST), sink, scratch_dir(spark, "flags-ckpt"))
    return spark.read.parquet(sink).select("id", "host", "blacklisted")


# -- I/O round trips and nested content ---------------------------------------------

def embedding_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL12/13, SRC8/10, FLT6: vectors as JSON text in CSV and back; every seventh text is cut short and so skipped."""
    e = _emb(spark, sf_dir).select(F.col("vec_id").alias("id"), F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("title"), "embedding")
    text = vec_to_json(F.col("embedding"))
    bad = F.expr("substring(t, 1, length(t) - 2)")
    e = e.withColumn("t", text).withColumn("embedding", F.when(F.col("id") % 7 == 3, bad).otherwise(F.col("t"))).drop("t")
    path = scratch_dir(spark, "vectors-csv")
    ig.export_csv(e, path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("id string, title string, embedding string").csv(path)
    return vc.long_form(ig.read_embedded_posts(back), ["id"], "embedding").select("id", "dim", _r(F.col("x")).alias("x"))


def embedded_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10/SRC11: embedded posts written as Parquet and as CSV with JSON text, and read back from both."""
    e = _emb(spark, sf_dir).select(F.col("vec_id").alias("id"), F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("title"), "embedding")
    table, text = scratch_dir(spark, "embedded"), scratch_dir(spark, "embedded-csv")
    ig.write_embedded(e, table)
    ig.write_embedded(e, text, csv=True)
    csv = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("id string, title string, embedding string").csv(text)
    a = ig.read_embedded_posts(spark.read.parquet(table)).select("id", "title", F.col("embedding").alias("v"))
    b = ig.read_embedded_posts(csv).select("id", F.col("embedding").alias("w"))
    off = F.aggregate(F.zip_with("v", "w", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda m, d: F.greatest(m, d.cast("double")))
    return a.join(b, "id", "full").select("id", "title", F.size("v").alias("n_dims"), (off <= 1e-6).alias("same"))


def keyword_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12: the keyword ranking as one CSV file, read back."""
    path = scratch_dir(spark, "keywords-csv")
    ig.export_keywords(keyword_top50(spark, sf_dir), path)
    return spark.read.option("header", True).option("escape", '"').schema("term string, tfidf double").csv(path)


def masked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17: the vectors of a label as the tokens of one text; every third token is masked out."""
    tokens = _emb(spark, sf_dir).select("label", F.col("vec_id").alias("token_pos"), F.col("embedding").alias("vec"), (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))
    pooled = vc.masked_mean_pool(tokens, "label")
    return vc.long_form(pooled, ["label"], "pooled").select("label", "dim", _r(F.col("x")).alias("x"))


def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML10, SRC13-15: chunk files written, the manifest read, and the points that its chunks hold."""
    out = scratch_dir(spark, "chunks")
    sp.write_chunks(_points(spark, sf_dir), out)
    back = sp.read_chunks(spark, out)
    return back.select("id", "title", "cluster", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))


def manifest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14 + WIN7: the nested cluster list of the manifest with its order, and the chunk list beside it."""
    m = sp.manifest_row(spark, _points(spark, sf_dir), None)
    clusters = m.select(F.posexplode("clusters").alias("pos", "c")).select(F.lit("cluster").alias("kind"), "pos", F.col("c.id").cast("string").alias("key"), F.col("c.count").alias("count"))
    chunks = m.select(F.posexplode("chunks").alias("pos", "c")).select(F.lit("chunk").alias("kind"), "pos", F.col("c.file").alias("key"), F.col("c.count").alias("count"))
    return clusters.unionByName(chunks)


def tolerant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7 + SCL10: scores written as dirty text, read as text, and cast with what doesn't parse as null."""
    d = tb.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    n = F.col("n_chars").cast("string")
    kind = F.col("id") % 6
    dirty = (F.when(kind == 0, n).when(kind == 1, F.concat(F.lit("  "), n, F.lit(" "))).when(kind == 2, F.concat(n, F.lit(".0")))
             .when(kind == 3, F.lit("x")).when(kind == 4, F.concat(F.lit("-"), n)).otherwise(F.lit("")))
    path = scratch_dir(spark, "dirty-csv")
    blank = [F.lit("").alias(c) for c in ("title", "url")]
    rows = d.select("id", F.lit("story").alias("type"), F.lit("a").alias("by"), F.lit("0").alias("time_unix"), F.lit("").alias("time_iso"), blank[0], dirty.alias("score"),
                    F.lit("0").alias("descendants"), blank[1], F.lit("").alias("text"))
    ig.export_csv(rows, path)
    back = ig.read_posts_csv_tolerant(spark, path)
    return back.select(tolerant_int(F.col("id")).alias("id"), tolerant_int(F.col("score")).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "host_top50": host_top50,
    "host_top50_high_score": host_top50_high_score,
    "domain_label_top50": domain_label_top50,
    "blocklist_flag_counts": blocklist_flag_counts,
    "blocklist_score_summary": blocklist_score_summary,
    "blocklist_post_flags": blocklist_post_flags,
    "event_value_five_numbers": event_value_five_numbers,
    "time_cells": time_cells,
    "time_pivot_high": time_pivot_high,
    "time_pivot_other": time_pivot_other,
    "clean_titles": clean_titles,
    "tokens_per_doc": tokens_per_doc,
    "term_frequencies": term_frequencies,
    "vocab_cap": vocab_cap,
    "idf_table": idf_table,
    "keyword_top50": keyword_top50,
    "keyword_export": keyword_export,
    "unit_vectors": unit_vectors,
    "tag_assign": tag_assign,
    "tag_ranking": tag_ranking,
    "label_centroids": label_centroids,
    "zscore_dims": zscore_dims,
    "zscore_vectors": zscore_vectors,
    "knn_exact": knn_exact,
    "knn_cells_euclidean": knn_cells_euclidean,
    "core_distance": core_distance,
    "embed_titles": embed_titles,
    "pca_variance": pca_variance,
    "fuzzy_edges": fuzzy_edges,
    "knn_descent_recall": knn_descent_recall,
    "layout_2d": layout_2d,
    "density_clusters": density_clusters,
    "grid_chunks": grid_chunks,
    "chunk_manifest": chunk_manifest,
    "viewport_filter": viewport_filter,
    "visible_cap": visible_cap,
    "viewport_chunks": viewport_chunks,
    "nearest_point": nearest_point,
    "density_raster": density_raster,
    "fit_view": fit_view,
    "cluster_lookup": cluster_lookup,
    "palette": palette,
    "cluster_sizes": cluster_sizes,
    "title_sample": title_sample,
    "cluster_prompts": cluster_prompts,
    "longest_title_label": longest_title_label,
    "stories_until_cutoff": stories_until_cutoff,
    "id_batches": id_batches,
    "dedupe_replayed": dedupe_replayed,
    "post_csv_roundtrip": post_csv_roundtrip,
    "post_csv_dirty": post_csv_dirty,
    "ingest_resume": ingest_resume,
    "ingest_meter": ingest_meter,
    "ingest_quarantine": ingest_quarantine,
    "stream_time_cells": stream_time_cells,
    "stream_post_flags": stream_post_flags,
    "embedding_json_roundtrip": embedding_json_roundtrip,
    "masked_pool": masked_pool,
    "embedded_sinks": embedded_sinks,
    "chunk_roundtrip": chunk_roundtrip,
    "manifest_clusters": manifest_clusters,
    "tolerant_scores": tolerant_scores,
    "mutual_reachability_edges": mutual_reachability_edges,
    "graph_components": graph_components,
    "spanning_tree": spanning_tree,
}
