"""Nearest rows against every pair, and the votes over them."""

import numpy as np

from sievewright.operators import nearest


def brute(rows, k):
    ok = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, a in ok.items():
        near = sorted((-round(float(a @ b), 9), j) for j, b in ok.items() if j != i and len(a) == len(b))[:k]
        out += [(i, p + 1, j, -c) for p, (c, j) in enumerate(near)]
    return sorted(out)


def test_every_row_finds_its_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(160)] + [(200, None), (201, []), (202, [0.0] * 5), (203, [float("nan")] * 5), (204, [1.0, 2.0]), (205, [2.0, 4.0]), (206, [1e300] * 5), (207, [None, 1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    want = brute(rows[:-2] + [(206, [1.0] * 5)], 6)
    for sizes in ((1024, 8192), (30, 40)):
        got = sorted(map(tuple, nearest.nearest(frame, frame, 6, *sizes).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-9)
    assert nearest.nearest(frame, frame.limit(0), 3).count() == nearest.nearest(frame.limit(0), frame, 3).count() == 0


def test_vote_and_shares(spark):
    found = spark.createDataFrame([(1, 1, 10, 1.0), (1, 2, 11, 0.5), (2, 1, 10, 0.8), (2, 2, 11, 0.6), (2, 3, 12, 0.0)], "query_id long, place int, id long, cosine double")
    answers = spark.createDataFrame([(10, 1), (11, 0)], "id long, y int")
    got = {r.query_id: r.proba for r in nearest.vote(found, answers).collect()}
    assert got == {1: 1.0, 2: round((1 / 0.2) / (1 / 0.2 + 1 / 0.4), 6)}
    labels = spark.createDataFrame([(1, 0), (2, 0), (10, 0), (11, 1), (12, 2)], "vec_id long, label int")
    assert sorted(map(tuple, nearest.leakage(found, labels).collect())) == [(1, 0.5, 1), (2, round(2 / 3, 6), 1)]
    assert sorted(map(tuple, nearest.agreement(found, labels).collect())) == [(1, 0.5, 0.6), (2, round(1 / 3, 6), 0.6)]


def test_farthest_first(spark):
    rng = np.random.default_rng(4)
    pool = [(i, rng.normal(size=4).tolist()) for i in range(90)] + [(500, [0.0] * 4), (501, None), (502, [1.0, 2.0, 3.0])]
    known = [(i, rng.normal(size=4).tolist()) for i in range(1000, 1030)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    unit = lambda rows: {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 4 and any(v)}
    for some in (known, []):
        near = {i: max((round(float(u @ e), 9) for e in unit(some).values()), default=-2.0) for i, u in unit(pool).items()}
        want, taken = [], []
        for step in range(5):
            i = min((n, i) for i, n in near.items() if i not in taken)[1]
            want.append((step, i, None if not some and not taken else round(1 - near[i], 6)))
            taken.append(i)
            near = {j: max(n, round(float(unit(pool)[j] @ unit(pool)[i]), 9)) for j, n in near.items()}
        got = list(map(tuple, nearest.kcenter_greedy(frame(pool), frame(some) if some else frame(known).limit(0), 5).collect()))
        assert got == want
