import math
import random

import numpy as np
from linkloom.llm import cross_polytope as C

SCHEMA = "vec_id bigint, embedding array<{}>, rank int, score string, key int"


def takes_part(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, k=5, every=50):
    """{query id: [(id, score)]}: exact search; equal rows count once."""
    kept = {(i, tuple(v)) for i, v in rows if takes_part(v)}
    out = {}
    for i, v in kept:
        if i is None or i % every:
            continue
        x = np.array(v, dtype=np.float64)
        near = out.setdefault(i, {})
        for j, w in kept:
            if j != i and len(w) == len(v):
                y = np.array(w, dtype=np.float64)
                sx, sy = (z / 2.0 ** np.frexp(np.abs(z).max())[1] for z in (x, y))
                near[j] = max(near.get(j, -2), float((sx * sy).sum() / (np.sqrt((sx * sx).sum()) * np.sqrt((sy * sy).sum()))))
    return {i: sorted(near.items(), key=lambda t: (-round(t[1], 9), t[0] is None, t[0] or 0))[:k] for i, near in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def close(a, b):
    return len(a) == len(b) and all(abs(x[1] - y[1]) < 1e-9 for x, y in zip(a, b))


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA.format(kind)).repartition(3)


def test_recall_on_random_and_grouped_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24)) * 2
    x = np.concatenate([rng.normal(size=(1500, 24)), centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 24))])
    rows = [(i, [float(t) for t in np.float32(v)]) for i, v in enumerate(x)]
    want, have = brute(rows), found(C.search(frame(spark, rows)))
    assert set(want) == set(have) and all(len(v) == 5 for v in have.values())
    share = np.mean([len({i for i, _ in want[q]} & {i for i, _ in have[q]}) / 5 for q in want])
    assert share >= 0.9


def test_odd_vectors(spark):
    rng = random.Random(2)
    v = lambda n=6: [rng.uniform(-1, 1) for _ in range(n)]
    same = v()
    rows = [(50 * i, v()) for i in range(6)] + [(i, same) for i in range(1, 200)] + [(0, same), (300, same), (300, same), (350, v()), (350, v())]
    rows += [(7001, None), (7050, []), (7100, [0.0] * 6), (7150, [1.0, None] + [0.0] * 4), (7200, [math.nan] * 6), (7250, [math.inf] + [1.0] * 5)]
    rows += [(None, same), (None, v()), (8000, v(3)), (8001, v(3)), (8050, [2.0**900] * 6), (8051, [2.0**-900] * 6), (8100, [2.0]), (8101, [-3.0])]
    have = found(C.search(frame(spark, rows, "double"), block_rows=16))
    want = brute(rows)
    assert set(have) == {q for q in want if want[q]}
    many = 0
    for q, near in have.items():
        assert close(near, want[q]), q
        many += [i for i, _ in near] == [i for i, _ in want[q]]
    assert have[300][:5] == [(i, have[300][0][1]) for i in range(5)] and many == len(have)
    assert C.search(frame(spark, [])).count() == 0 and C.search(frame(spark, [(1, None)])).count() == 0


def test_hot_keys_in_blocks_find_the_same(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    x = np.concatenate([centre + 1e-3 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16))])
    rows = [(i, [float(t) for t in v]) for i, v in enumerate(x)]
    df = frame(spark, rows, "double")
    assert found(C.search(df, block_rows=7)) == found(C.search(df))


def test_rotation_keeps_length_and_probes_start_at_the_own_key():
    x = C.unit(np.random.default_rng(1).normal(size=(50, 48)))
    for axes in ((64,), (64, 16), (64, 64)):
        keys = C.Keys(48, axes)
        for y, n in zip(keys.rotated(x, 1), axes):
            assert y.shape == (50, n) and (n < 64 or np.allclose((y * y).sum(1), 1))
        tried = keys.probes(x, 1, 64)
        assert (tried[:, 0] == keys.of(x, 1)).all() and all(len(set(r)) == 64 for r in tried.tolist())


def test_finer_keys_for_more_rows():
    assert C.ladder(64, 500) == [(64,)] and C.ladder(64, 50_000) == [(64,)]
    assert C.ladder(64, 10**6) == [(64, 16), (64,)] and C.ladder(64, 10**8)[0] == (64, 64)
