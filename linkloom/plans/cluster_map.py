"""End-to-end cluster map as one function.

embedded posts -> z-score + PCA -> fuzzy graph (k=30, cosine) -> 10-D layout
-> density clusters -> fuzzy graph (k=15) -> 2-D layout -> cluster names ->
chunk files + manifest.  Every intermediate that later steps reuse is written
to the shared checkpoint folder, so a lost executor only repeats one step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import density as dn
from linkloom.operators import layout as lo
from linkloom.operators import naming as nm
from linkloom.operators import spatial as sp
from linkloom.session import materialize, scratch_scope


def full_epochs(n: int) -> int:
    """Layout epochs of the whole job on ``n`` posts."""
    return 500 if n <= 10_000 else 200


def cluster_space(p: DataFrame, n_epochs: int, id_col: str = "id") -> DataFrame:
    """(id_col, v): the layout of the k = 30 cosine graph of the PCA dimensions, in which clusters are found."""
    g10 = materialize(lo.fuzzy_graph(p, lo.CLUSTER_NEIGHBORS, id_col, "pca", "cosine"), "map-graph10")
    y10 = lo.layout(p, g10, "pca", lo.CLUSTER_DIMS, lo.CLUSTER_MIN_DIST, n_epochs=n_epochs, id_col=id_col)
    return y10.select(id_col, F.array(*[F.col(f"x{k}") for k in range(lo.CLUSTER_DIMS)]).alias("v"))


def build_cluster_map(posts: DataFrame, out_dir: str, namer: Callable[[str, list[str]], str] | None = None,
                      id_col: str = "id", title_col: str = "title", emb_col: str = "embedding",
                      n_epochs: int | None = None) -> dict | None:
    """Write a run's chunk folder and ``out_dir/manifest``; returns the grid parameters.

    ``n_epochs`` None: 500 up to 10 000 posts and 200 above.  Its scratch tables are gone when it returns.
    """
    with scratch_scope():
        return _build(posts, out_dir, namer, id_col, title_col, emb_col, n_epochs)


def _build(posts: DataFrame, out_dir: str, namer: Callable[[str, list[str]], str] | None, id_col: str, title_col: str, emb_col: str, n_epochs: int | None) -> dict | None:
    base = posts.select(F.col(id_col).alias("id"), F.col(title_col).alias("title"), F.col(emb_col).alias("emb"))
    base = base.filter(F.col("title").isNotNull() & F.col("emb").isNotNull())  # FLT6, Q10
    p, _ = lo.pca(base, lo.PCA_COMPONENTS, "emb", "pca")
    p = materialize(p.select("id", "title", "pca"), "map-pca")
    if n_epochs is None:
        n_epochs = full_epochs(p.count())
    labels = materialize(dn.density_clusters(cluster_space(p, n_epochs), dn.MIN_CLUSTER_SIZE, dn.MIN_SAMPLES), "map-labels")
    g2 = materialize(lo.fuzzy_graph(p, lo.VIEW_NEIGHBORS, "id", "pca", "cosine"), "map-graph2")
    y2 = lo.layout(p, g2, "pca", lo.VIEW_DIMS, lo.VIEW_MIN_DIST, n_epochs=n_epochs)
    pts = materialize(p.select("id", "title").join(labels, "id").join(y2, "id")
                      .select("id", "title", "cluster", F.col("x0").alias("x"), F.col("x1").alias("y")), "map-points")
    names = nm.name_clusters(pts, namer, "cluster", "title", "id")
    return sp.write_chunks(pts, out_dir, names.filter(F.col("cluster") != sp.NOISE))
