"""Cluster map end to end, embedding, pooling, fetch, resume, streaming flags."""

import numpy as np
import pyarrow as pa

from linkloom.operators import ingest as ig
from linkloom.operators import spatial as sp
from linkloom.operators.embed import embed_texts
from linkloom.operators.vectors import masked_mean_pool
from linkloom.plans.cluster_map import build_cluster_map
from linkloom.session import scratch_dir
from linkloom.streaming.ingest import run_flags


def test_build_cluster_map(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(3, 16)) * 4
    X = np.vstack([rng.normal(c, 0.3, size=(40, 16)) for c in centers])
    rows = [(i, f"topic {i // 40} post number {i}", [float(v) for v in X[i]]) for i in range(len(X))]
    df = spark.createDataFrame(rows, "id long, title string, embedding array<double>")
    out = scratch_dir(spark, "map")
    g = build_cluster_map(df, out, n_epochs=5)
    assert g is not None
    man = spark.read.json(f"{out}/manifest").first()
    pts = sp.read_chunks(spark, out)
    assert man["total_points"] == pts.count() == sum(c["count"] for c in man["chunks"])
    assert man["num_clusters"] == len(man["clusters"]) >= 1
    assert all(c["name"] for c in man["clusters"])


def test_embed_texts_unit_norm_and_deterministic(spark):
    df = spark.createDataFrame([(1, "Rust compilers are fast"), (2, None), (3, "rust compilers")], "id long, title string")
    a = {r["id"]: r["embedding"] for r in embed_texts(df).collect()}
    b = {r["id"]: r["embedding"] for r in embed_texts(df.repartition(2)).collect()}
    assert a == b
    assert abs(np.linalg.norm(a[1]) - 1) < 1e-6 and np.linalg.norm(a[2]) == 0.0
    assert np.dot(a[1], a[3]) > 0.5


def test_masked_mean_pool(spark):
    toks = spark.createDataFrame([(1, 0, 1, [1.0, 3.0]), (1, 1, 1, [3.0, 5.0]), (1, 2, 0, [100.0, 100.0]),
                                  (2, 0, 0, [5.0, 5.0])], "doc long, token_pos int, mask int, vec array<double>")
    got = {r["doc"]: r["pooled"] for r in masked_mean_pool(toks).collect()}
    assert got[1] == [2.0, 4.0] and got[2] == [0.0, 0.0]


def test_partition_fetch_and_resume(spark):
    ids = ig.id_batches(spark, 450)
    assert ids.select("batch").distinct().count() == 3

    def fetch(batch):
        return [None if i % 10 == 0 else {"id": i, "type": "story", "time": 1735689600 + i, "title": f"t{i}"}
                if i % 7 else {"id": i, "type": "story"} for i in batch]
    items = ig.partition_fetch(ids, fetch, partitions=3)
    n = items.count()
    assert n == len([i for i in range(1, 451) if i % 10 and i % 7])

    def failing(batch):
        if any(i % 90 == 1 for i in batch):
            raise OSError("gone")
        return fetch(batch)
    failed = spark.sparkContext.accumulator(0)
    got = {r["id"] for r in ig.partition_fetch(ids, failing, partitions=3, failed=failed).collect()}
    assert got == {i for i in range(1, 451) if i % 10 and i % 7 and i % 90 != 1} and failed.value == 5
    walked = [r["id"] for r in ids.filter("batch = 1").orderBy("position").collect()]
    assert walked == list(range(250, 50, -1))
    sink = scratch_dir(spark, "posts")
    assert ig.resume_bound(spark, sink) is None
    ig.write_posts(ig.stories_until_cutoff(items, 0), sink)
    assert ig.resume_bound(spark, sink) == 1


def test_flag_stream(spark):
    landing = scratch_dir(spark, "flag-land")
    spark.createDataFrame([(1, "http://a.evil.com/x"), (2, "http://good.org")], "id long, url string") \
        .write.json(landing)
    bl = spark.createDataFrame([("evil.com",)], "domain string")
    s = spark.readStream.schema("id long, url string").json(landing)
    sink = scratch_dir(spark, "flags")
    run_flags(s, bl, sink, scratch_dir(spark, "flags-ckpt"))
    got = {r["id"]: (r["host"], r["blacklisted"]) for r in spark.read.parquet(sink).collect()}
    assert got == {1: ("a.evil.com", True), 2: ("good.org", False)}


def trust(high, low, k=15):
    """Trustworthiness of a layout: neighbours in it that aren't near in the cosine of the high dimensions cost their rank."""
    n = len(high)
    unit = high / np.linalg.norm(high, axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    np.fill_diagonal(far, -9)
    rank = np.argsort(np.argsort(far, axis=1), axis=1)
    d2 = ((low[:, None] - low[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, -1)
    near = np.argsort(d2, axis=1)[:, 1:k + 1]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, np.take_along_axis(rank, near, 1) - k).sum()


def test_registered_layout_runs_all_epochs_and_keeps_neighbours(spark):
    from linkloom.plans import catalogue

    sf = "/root/testdata/sf0.001"
    rows = catalogue.layout_2d(spark, sf).orderBy("vec_id").collect()
    reduced, _ = catalogue._pca(spark, sf)
    high = np.array([r["pca"] for r in reduced.orderBy("vec_id").collect()])
    low = np.array([(r["x"], r["y"]) for r in rows])
    assert len(rows) == len(high) == 500 and catalogue.full_epochs(500) == 500
    assert trust(high, low) > trust(high, high[:, :2]) + 0.03


def test_registered_clusters_run_the_whole_job(spark):
    from linkloom.plans import catalogue

    got = {r["id"]: r["cluster"] for r in catalogue.density_clusters(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 500 and set(got.values()) <= set(range(-1, 26))


def test_layout_blocks_exchange_what_edges_need(spark):
    """Exchanges after every epoch and one block give the same attraction; negatives come from all rows then."""
    from linkloom.operators import layout as lo

    rng = np.random.default_rng(3)
    table = pa.table({"li": [0, 0, 1, 2], "bj": [0, 1, 0, 1], "lj": [1, 5, 0, 2], "w": [0.5, 0.5, 1.0, 1.0]})
    e = lo.BlockEdges(table, 0, 3)
    assert e.sends.keys() == {1} and e.sends[1].tolist() == [0, 2] and e.end.tolist() == [1, 4, 0, 3] and e.source.tolist() == [1, 1]
    x, halo = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    pool = rng.normal(size=(4, 2))
    got = lo.run_epochs(x, e, halo, np.arange(3), pool, np.array([0, 9, 9, 9]), np.array([0.5]), (1.5, 0.9), np.array([[[0, 1], [2, 3], [1, 1]]]))
    want = x.copy()
    for i in range(3):
        g = np.zeros(2)
        for li, end, w in zip(e.li, e.end, e.w):
            if li == i:
                diff = x[i] - np.concatenate([x, halo])[end]
                d2 = (diff ** 2).sum()
                g += w * np.clip(-2 * 1.5 * 0.9 * d2 ** -0.1 / (1.5 * d2 ** 0.9 + 1) * diff, -4, 4)
        for k in [[0, 1], [2, 3], [1, 1]][i]:
            diff = x[i] - pool[k]
            d2 = (diff ** 2).sum()
            if not (i == 0 and k == 0):
                g += np.clip(1.8 / ((0.001 + d2) * (1.5 * d2 ** 0.9 + 1)) * diff, -4, 4) / 2
        want[i] += 0.5 * np.clip(g, -4, 4)
    assert np.allclose(got, want)


def test_exchanges_of_the_layout_shuffle_positions_only(spark, monkeypatch):
    from linkloom.operators import layout as lo

    plans, write = [], lo.materialize

    def seen(df, name="step"):
        if name == "layout-exchange":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(lo, "materialize", seen)
    p = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(49)], "id bigint, v array<double>")
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(48)], "a bigint, b bigint, w double")
    assert lo.layout(p, e, "v", 2, 0.1, n_epochs=2, exchange_epochs=1).count() == 49
    assert len(plans) == 3 and all(plan.count("ENSURE_REQUIREMENTS") == 1 for plan in plans[1:])
