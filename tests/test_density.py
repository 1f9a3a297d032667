"""Density clusters against a brute-force hierarchy of the full graph."""

import numpy as np
import pytest

from linkloom.operators import density as D


def reach(x, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(min_samples, len(x) - 1)]
    w = np.maximum(np.maximum(core[:, None], core[None]), d)
    np.fill_diagonal(w, np.inf)
    return w


def parts_below(members, w, limit):
    """Connected components of the points under edges lighter than limit."""
    left, out = set(members), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            i = todo.pop()
            part.append(i)
            near = [j for j in left if w[i, j] < limit]
            left.difference_update(near)
            todo += near
        out.append(sorted(part))
    return out


def brute(x, least, min_samples):
    """Top-down: cut the heaviest weight again and again; excess of mass with the root left out."""
    w = reach(x, min_samples)

    def cluster(members, birth):
        """(stability, value, chosen member lists) of a cluster born at level ``birth``."""
        stability, now = 0.0, members
        while True:
            inside = w[np.ix_(now, now)]
            heaviest = bottleneck(now, w) if len(now) > 1 else None
            if heaviest is None:
                break
            level = 1 / max(heaviest, 1e-30)
            parts = parts_below(now, w, heaviest)
            big = [p for p in parts if len(p) >= least]
            if len(big) == 1:
                stability += (len(now) - len(big[0])) * (level - birth)
                now = big[0]
                continue
            stability += len(now) * (level - birth)
            kids = [cluster(p, level) for p in big]
            below = sum(k[1] for k in kids)
            if kids and below > stability:
                return stability, below, [c for k in kids for c in k[2]]
            return stability, stability, [members]
        return stability, stability, [members]

    def bottleneck(members, w):
        """The heaviest edge of the members' spanning tree."""
        inside, best, top = {members[0]}, {j: w[members[0], j] for j in members[1:]}, 0.0
        while best:
            j = min(best, key=best.get)
            top = max(top, best.pop(j))
            for i in best:
                best[i] = min(best[i], w[j, i])
            inside.add(j)
        return top

    now = list(range(len(x)))
    while len(now) > 1:  # the root and what continues it can't be chosen
        top = bottleneck(now, w)
        big = [p for p in parts_below(now, w, top) if len(p) >= least]
        if len(big) == 1:
            now = big[0]
            continue
        return {tuple(c) for p in big for c in cluster(p, 1 / max(top, 1e-30))[2]}
    return set()


def full_tree(x, min_samples):
    """Prim on all pairs."""
    w = reach(x, min_samples)
    best, source, edges = w[0].copy(), np.zeros(len(x), int), []
    best[0] = np.inf
    out = set(range(1, len(x)))
    while out:
        j = min(out, key=lambda i: best[i])
        edges.append((min(j, source[j]), max(j, source[j]), best[j]))
        out.discard(j)
        for i in out:
            if w[j, i] < best[i]:
                best[i], source[i] = w[j, i], j
    return edges


def sets(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(20, 70))
    kind = seed % 4
    if kind == 0:
        return r.uniform(0, 1, (n, 2))
    if kind == 1:
        return np.concatenate([r.normal(c, r.uniform(0.1, 1), (max(4, n // 4), 2)) for c in r.uniform(-5, 5, (4, 2))])
    if kind == 2:  # far apart: the neighbour graph falls into pieces
        return np.concatenate([r.normal(c, 0.2, (n // 2, 2)) for c in ((0, 0), (50, 50))])
    return r.integers(0, 8, (n, 2)).astype(float)  # many ties and equal points


def merged(x, least, min_samples):
    """The operator's merging on the full tree, in one process."""
    e = full_tree(x, min_samples)
    m = D.Merger(least)
    m.run(*(np.array(c) for c in zip(*e)))
    wins = {c: (p, win) for c, p, win in m.ended}
    out = {}
    for point, c in m.joined:
        top = None
        while c in wins:
            if wins[c][1]:
                top = c
            c = wins[c][0]
        if top is not None:
            out.setdefault(top, []).append(point)
    return {tuple(sorted(v)) for v in out.values()}


@pytest.mark.parametrize("seed", range(80))
def test_merging_equals_the_full_hierarchy(seed):
    x = sets(seed)
    least, min_samples = 4 + seed % 3, 2 + seed % 4
    assert merged(x, least, min_samples) == brute(x, least, min_samples)


@pytest.mark.parametrize("seed", [2, 3])
def test_spark_job_equals_the_full_hierarchy(spark, seed):
    x = sets(seed)
    df = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(x)], "id bigint, v array<double>")
    tree = D.spanning_tree(df, 3, 4, block_rows=16).collect()
    assert len(tree) == len(x) - 1
    assert np.allclose(sorted(r.w for r in tree), sorted(e[2] for e in full_tree(x, 3)))
    got = {}
    for r in D.density_clusters(df, 5, 3, 4, band_edges=10 if seed == 3 else D.BAND_EDGES).collect():
        got.setdefault(r.cluster, []).append(r.id)
    noise = got.pop(-1, [])
    assert {tuple(sorted(v)) for v in got.values()} == brute(x, 5, 3)
    assert len(noise) + sum(map(len, got.values())) == len(x)
    assert [min(got[c]) for c in sorted(got)] == sorted(min(v) for v in got.values())


def job_clusters(spark, x, least, min_samples, k, **kwargs):
    df = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(x)], "id bigint, v array<double>")
    got = {}
    for r in D.density_clusters(df, least, min_samples, k, **kwargs).collect():
        got.setdefault(r.cluster, []).append(r.id)
    got.pop(-1, [])
    return {tuple(sorted(v)) for v in got.values()}


def test_a_third_of_all_points_as_copies(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([np.repeat([[1.0, 1.0]], 40, axis=0), r.normal((5, 5), 0.3, (40, 2)), r.normal((1, 1), 0.2, (40, 2))])
    x = x[r.permutation(len(x))]
    # bands of 20 edges: the copies' 39 edges of weight 0 are more than a band
    assert job_clusters(spark, x, 6, 3, 4, band_edges=20) == brute(x, 6, 3)


def test_grid_points_of_equal_weights_in_small_bands(spark):
    x = np.array([(i % 6, i // 6) for i in range(36)] + [(30 + i % 4, i // 4) for i in range(16)] + [(60, 60), (60, 61)], dtype=float)
    assert job_clusters(spark, x, 5, 3, 4, band_edges=8) == brute(x, 5, 3)


def test_visits_are_pruned_and_the_tree_is_the_same(spark):
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(c, 0.2, (60, 3)) for c in r.uniform(-30, 30, (6, 3))])
    df = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(x)], "id bigint, v array<double>")
    report = []
    tree = D.spanning_tree(df, 3, 4, block_rows=16, report=report).collect()
    want = full_tree(x, 3)
    assert len(tree) == len(x) - 1 and np.allclose(sorted(e.w for e in tree), sorted(e[2] for e in want))
    assert report and sum(p["visits"] for p in report) < 0.25 * sum(p["all"] for p in report)


def test_no_point_and_one_point(spark):
    schema = "id bigint, v array<double>"
    assert D.density_clusters(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in D.density_clusters(spark.createDataFrame([(7, [1.0, 2.0])], schema)).collect()] == [(7, -1)]


def test_streamed_cells_give_every_components_lightest_edge():
    r = np.random.default_rng(4)
    x, y = r.normal(0, 1, (40, 3)), r.normal(0.5, 1, (30, 3))
    core, other_core = r.uniform(0, 1, 40), r.uniform(0, 1, 30)
    comp, other_comp = r.integers(0, 6, 40), r.integers(0, 6, 30)
    centre = y.mean(0)
    shape = {"block": 9, "centre": centre, "radius": np.sqrt(((y - centre) ** 2).sum(1)).max(), "least": other_core.min(), "most": other_core.max(),
             "low": other_comp.min(), "high": other_comp.max()}
    asking = D._Asking(np.arange(40), x, core, comp, np.full(40, np.inf))
    cell, got = D.Cells([shape]).only(9), {}
    for at in range(0, 30, 7):  # batches in any number
        for b in asking.offer(cell, 100 + np.arange(30)[at:at + 7], y[at:at + 7], other_core[at:at + 7], other_comp[at:at + 7]):
            for e in b.to_pylist():
                got[e["comp"]] = min(got.get(e["comp"], (np.inf,)), (e["w"], e["a"], e["b"]))
    w = np.maximum(np.maximum(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)), core[:, None]), other_core[None])
    want = {c: min((w[i, j], i, 100 + j) for i in np.flatnonzero(comp == c) for j in range(30) if other_comp[j] != c) for c in np.unique(comp)}
    assert {c: e[1:] for c, e in got.items()} == {c: e[1:] for c, e in want.items()}
    assert np.allclose([got[c][0] for c in sorted(got)], [want[c][0] for c in sorted(want)])


def test_the_last_band_hangs_together_and_asks_for_no_components(spark, monkeypatch):
    """A tree's components were looked for by passing labels on, in as many rounds as its paths are long."""
    def asked(*_):
        raise AssertionError("components of a tree")

    monkeypatch.setattr(D, "components", asked)
    tree = spark.createDataFrame([(i, i + 1, 1.0 + i % 7) for i in range(90)], "a bigint, b bigint, w double")
    joined, _ = D.hierarchy(tree, 5, band_edges=100)
    assert {r["id"] for r in joined.collect()} == set(range(91))


def test_components_of_a_long_path_take_few_tables(spark, monkeypatch):
    from linkloom.operators import graph

    made, write = [], graph.materialize

    def seen(df, name="step"):
        made.append(name)
        return write(df, name)

    monkeypatch.setattr(graph, "materialize", seen)
    ids = np.random.default_rng(2).permutation(300) * 5 - 200
    rows = [(int(a), int(b)) for a, b in zip(ids[:200], ids[1:201])] + [(int(a), int(b)) for a, b in zip(ids[201:-1], ids[202:])] + [(9999, 9999)]
    got = {r["v"]: r["comp"] for r in graph.components(spark.createDataFrame(rows, "src bigint, dst bigint"), small=100).collect()}
    want = {int(v): int(part.min()) for part in (ids[:201], ids[201:]) for v in part}
    assert got == want | {9999: 9999} and "cc-round" not in made and len(made) < 20


def test_kernels_of_lists_and_tree_keep_to_small_products():
    """Lists far from the origin are those of all pairs, and no product is larger than a tile."""
    import tracemalloc

    from linkloom.operators import knn

    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, 1, (1500, 4)), r.normal(1000, 1e-4, (1500, 4)), np.repeat(r.integers(0, 3, (100, 4)), 5, axis=0)])
    ids = r.permutation(len(x)) * 3
    rows = np.arange(0, len(x), 2)
    asking = knn._Asking(ids[rows], np.zeros(len(rows), int), np.full(len(rows), np.inf), x[rows], 6, "euclidean", True)
    tracemalloc.start()
    asking.offer(np.arange(len(rows)), ids, x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
    found = asking.found()
    got = sorted(zip(found["id"].to_pylist(), found["score"].to_pylist(), found["nbr"].to_pylist()), key=lambda e: (e[0], -e[1], e[2]))
    want = []
    for i in rows:
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        want += [(ids[i], -d[j], ids[j]) for j in sorted(np.flatnonzero(ids != ids[i]), key=lambda j: (d[j], ids[j]))[:6]]
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in sorted(want, key=lambda e: (e[0], -e[1], e[2]))]


def test_an_epoch_of_the_layout_works_on_few_edges_at_once():
    import tracemalloc

    import pyarrow as pa

    from linkloom.operators import layout as lo

    r = np.random.default_rng(8)
    n, degree, dims = 2000, 40, 10
    table = pa.table({"li": np.repeat(np.arange(n), degree), "bj": r.integers(0, 4, n * degree), "lj": r.integers(0, n, n * degree), "w": r.uniform(0, 1, n * degree)})
    e = lo.BlockEdges(table, 0, n)
    x, halo, pool = r.normal(size=(n, dims)), r.normal(size=(len(e.source), dims)), r.normal(size=(50, dims))
    drawn = r.integers(0, 50, (1, n, 5))
    tracemalloc.start()
    got = lo.run_epochs(x, e, halo, np.arange(n), pool, np.arange(50), np.array([1.0]), (1.8, 0.8), drawn)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < (len(x) + len(halo)) * dims * 8 + (4 << 20)
    whole, lots = got, lo._VALUES_AT_ONCE
    try:
        lo._VALUES_AT_ONCE = 1 << 30
        whole = lo.run_epochs(x, e, halo, np.arange(n), pool, np.arange(50), np.array([1.0]), (1.8, 0.8), drawn)
    finally:
        lo._VALUES_AT_ONCE = lots
    assert got.tobytes() == whole.tobytes()
