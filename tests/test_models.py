"""Many models in one pass, dealt folds, searches and resampling against plain versions."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from sievewright.functions import vectors as nv
from sievewright.operators import experiments, folds, manymodels, resampling


def labelled(n=500, seed=0, width=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * np.array([1, 50, 0.1, 1, 1])[:width] + np.array([0, 1000, 0, 0, 0])[:width]
    y = (x[:, 0] + (x[:, 1] - 1000) / 40 + rng.normal(size=n) > 0.3).astype(int)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 3] = np.nan
    return x, y


def listed(x):
    return [[None if np.isnan(v) else float(v) for v in row] for row in x]


def plain(train_x, train_y, test_x, c=1.0):
    s = nv.Scaler(train_x)
    return nv.logit_scores(s(test_x), nv.fit_logit(s(train_x), train_y, c))


def test_many_fits_equal_single_fits(spark):
    x, y = labelled()
    at = np.arange(len(y)) % 5
    rows = spark.createDataFrame([(f"c{at[i]}", i, int(y[i]), v) for i, v in enumerate(listed(x))] + [("ones", 900, 1, [1.0] * 5), ("ones", 901, 1, [2.0] * 5)], "cell string, id long, y int, x array<double>")
    packed = manymodels.blocks(rows)
    models = spark.createDataFrame([("all", 1.0, None), ("some", 0.25, [0, 2, 4]), ("one class", 1.0, None), ("no rows", 1.0, None)], "model string, c double, cols array<int>")
    pairs = [("all", f"c{i}") for i in range(3)] + [("some", "c3"), ("some", "c4"), ("one class", "ones")]
    state = manymodels.fit(packed, models, spark.createDataFrame(pairs, "model string, cell string"))
    test = spark.createDataFrame([("all", "c3"), ("all", "c4"), ("some", "c0"), ("one class", "c1")], "model string, cell string")
    got = manymodels.scores(packed, state, test).toPandas()
    for model, train, rest, cols, c in (("all", at < 3, at >= 3, [0, 1, 2, 3, 4], 1.0), ("some", at >= 3, at == 0, [0, 2, 4], 0.25)):
        mine = got[got.model == model].sort_values("id")
        assert mine.id.tolist() == np.flatnonzero(rest).tolist() and mine.y.tolist() == y[rest].tolist()
        assert np.abs(mine.score.to_numpy() - plain(x[train][:, cols], y[train], x[rest][:, cols], c)).max() < 1e-9
    assert got[got.model == "one class"].score.isna().all() and set(got.model) == {"all", "some", "one class"}


def table(spark, n=300, silos=("a", "b"), seed=1):
    x, y = labelled(n, seed)
    rows = [(i, silos[i % len(silos)], f"g{i // 3}", int(y[i]), v, float(y[i] * 0.5 + (i % 10) / 20)) for i, v in enumerate(listed(x))]
    return spark.createDataFrame(rows, "paper_id long, silo string, grp string, y int, x array<double>, floor_score double").repartition(3)


def test_within_silo_scores_come_from_the_other_folds(spark):
    rows = table(spark)
    got = experiments.within_silo_oof(rows, seeds=2).toPandas()
    frame = rows.toPandas().set_index("paper_id")
    assert len(got) == 600 and not got.duplicated(["paper_id", "seed"]).any()
    assert got.merge(frame[["grp"]], left_on="paper_id", right_index=True).groupby(["silo", "seed", "grp"]).fold.nunique().max() == 1
    for (_, _), unit in got.groupby(["silo", "seed"]):
        unit = unit.sort_values("paper_id")
        x, y = np.array(frame.loc[unit.paper_id].x.tolist(), float), unit.y.to_numpy()
        for k in range(5):
            own = (unit.fold == k).to_numpy()
            assert np.abs(unit.score.to_numpy()[own] - plain(x[~own], y[~own], x[own])).max() < 1e-9
    shuffled = experiments.within_silo_oof(rows, seeds=1, shuffled=True).toPandas()
    assert shuffled.groupby("silo").y.sum().to_dict() == frame.groupby("silo").y.sum().to_dict()
    assert (shuffled.set_index("paper_id").y.sort_index() != frame.y.sort_index()).any()


def test_budgets_and_low_label(spark):
    rows = table(spark)
    got = experiments.warm_start(rows, budgets=(10, 40), seeds=2).toPandas()
    assert sorted(zip(got.silo, got.budget)) == [(s, b) for s in "ab" for b in (10, 40)] and (got.n_seeds == 2).all() and (got.auc > 0.7).all()
    got = experiments.label_budgets(rows, (3, 500), (4,), seeds=2).toPandas()
    assert sorted(zip(got.silo, got.n_pos, got.n_neg, got.n_seeds)) == [("a", 3, 4, 2), ("b", 3, 4, 2)]
    got = experiments.induced_low_label(rows, 30, seeds=1).toPandas()
    assert len(got) == 2 and (got.auc > 0.7).all() and got.recall_10.between(0.1, 1).all()
    few = experiments.induced_low_label(rows, 200, seeds=1).toPandas()
    assert len(few) == 2 and few.auc.isna().all()


def test_stack_cuts_and_weights(spark):
    rows = table(spark)
    got = experiments.stacked(rows, sets={"one": [0, 2], "two": [1], "three": [4]}).toPandas()
    assert len(got) == 300 and (got["pred"] == (got["stack"] >= got["cut"])).all()
    assert all(nv.auc(g.y.to_numpy(), g["stack"].to_numpy()) > 0.8 for _, g in got.groupby("silo"))
    assert got.cut.between(0.01, 0.99).all() and got.blend.between(0, 1).all()


def test_calibration_and_stages(spark):
    rows = table(spark)
    got = experiments.calibrated(rows, 25).toPandas()
    assert sorted(zip(got.silo, got.method)) == [(s, m) for s in "ab" for m in ("isotonic", "platt")] and (got.brier_after < got.brier_before).all()
    got = experiments.staged(rows, draws=50).toPandas().set_index(["stage", "silo"])
    assert set(got.index) == {("validate", ""), ("train", ""), ("test", ""), ("test", "a"), ("test", "b")}
    assert got.loc[("test", "")].lo <= got.loc[("test", "")].auc <= got.loc[("test", "")].hi


def test_search_of_equal_budget(spark):
    got = experiments.hparam_search(table(spark, 120, ("a", "b", "c")), budget=6, start=3, batch=3).toPandas()
    assert got.groupby("method").size().to_dict() == {"grid": 6, "random": 6, "parzen": 6}
    for _, g in got.groupby("method"):
        assert sorted(g.place) == list(range(1, 7)) and g.sort_values("place").auc.is_monotonic_decreasing


def test_parzen_proposals_go_where_trials_were_good():
    p = experiments.Parzen({"c": ("uniform", -3.0, 4.0), "n": ("choice", [1, 2, 4])}, 3)
    trials = [({"c": c / 4, "n": n}, -((c / 4 - 2) ** 2) - (n != 2)) for c in range(-12, 17) for n in (1, 2, 4)]
    made = [p.propose(trials) for _ in range(20)]
    assert np.mean([abs(m["c"] - 2) for m in made]) < 1 and sum(m["n"] == 2 for m in made) > 14


# ---- folds


@pytest.mark.parametrize("seed", range(4))
def test_dealing_by_signature_equals_dealing_group_by_group(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(2500)]
    groups = sorted(((rng.randrange(n + 1) if n > 1 else int(rng.random() < 0.2)), n, i) for i, n in enumerate(sizes))
    dealer = folds.Dealer(5, sum(g[0] for g in groups), sum(g[1] - g[0] for g in groups))
    want = {i: dealer.step((p, n - p)) for p, n, i in sorted(groups, key=lambda g: (-abs(2 * g[0] - g[1]), g))}
    members = defaultdict(list)
    for p, n, i in groups:
        members[p, n].append(i)
    got = {}
    for p, n, first, pattern in folds.dealing([(p, n, len(m)) for (p, n), m in members.items()], 5):
        got |= {i: (first[j] if j < len(first) else pattern[(j - len(first)) % len(pattern)]) for j, i in enumerate(members[p, n])}
    assert got == want


def test_dealing_many_groups_takes_few_steps():
    made = folds.dealing([(1, 1, 10**9), (0, 1, 10**10), (3, 5, 10**6)], 5)
    assert sum(len(first) + len(pattern) for _, _, first, pattern in made) < 200


def test_group_folds(spark):
    rows = [(i, f"g{i % 97}", int(i % 7 == 0), "ab"[i % 2]) for i in range(3000)] + [(9999, None, 1, "a"), (9998, None, 0, "a")]
    got = folds.group_folds(spark.createDataFrame(rows, "doc_id long, grp string, y int, silo string"), by=["silo"]).toPandas()
    assert len(got) == len(rows) and got.groupby(["silo", "grp"], dropna=False).fold.nunique().max() == 1
    for _, g in got.groupby("silo"):
        assert g.groupby("fold").y.agg(["sum", "size"]).apply(lambda c: c.max() - c.min()).max() < 40
    assert folds.group_folds(spark.createDataFrame([], "doc_id long, grp string, y int")).count() == 0
    many = spark.range(200000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS grp", "CAST(id % 10 = 0 AS INT) AS y")
    sizes = folds.group_folds(many).groupBy("fold", "y").count().toPandas()
    assert sorted(sizes["count"]) == [4000] * 5 + [36000] * 5


def test_class_folds_and_draws(spark):
    rows = spark.createDataFrame([(i, int(i % 4 == 0), "ab"[i % 2]) for i in range(1000)], "doc_id long, y int, silo string")
    got = folds.class_folds(rows, "doc_id", by=["silo"]).toPandas()
    for _, g in got.groupby(["silo", "y"]):
        assert g.groupby("fold").size().pipe(lambda c: c.max() - c.min()) <= 1
    placed = folds.draw_order(rows, ["silo"], "doc_id", 1).toPandas()
    assert all(sorted(g["at"]) == list(range(len(g))) for _, g in placed.groupby("silo"))
    assert (placed["at"].to_numpy() == folds.draw_order(rows.repartition(5), ["silo"], "doc_id", 1).toPandas().set_index("doc_id").loc[placed.doc_id]["at"].to_numpy()).all()


# ---- resampling


def scored(n=900, seed=0):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"silo": rng.choice(["a", "b", "c"], n), "s": rng.integers(0, 60, n) / 10, "s2": rng.integers(0, 300, n) / 10})
    f["y"] = ((f.s + f.s2 / 10 + rng.normal(size=n) * 3) > 5).astype(int)
    f.loc[f.silo == "c", "y"] = 0
    return f


def drawn(f, statistic, draws=400):
    return np.percentile([statistic(f.sample(len(f), replace=True, random_state=i)) for i in range(draws)], [2.5, 97.5])


def test_auc_intervals(spark):
    f = scored()
    got = resampling.auc_interval(spark.createDataFrame(f).repartition(5)).toPandas().set_index("silo")
    auc = lambda g: nv.auc(g.y.to_numpy(), g.s.to_numpy())
    for k in "ab":
        g = f[f.silo == k]
        assert abs(got.loc[k].auc - auc(g)) < 1e-12 and np.abs(got.loc[k][["lo", "hi"]].to_numpy(float) - drawn(g, auc)).max() < 0.02
    assert np.isnan(got.loc["c"].auc) and np.isnan(got.loc["c"].lo)
    pair = resampling.paired_bootstrap(spark.createDataFrame(f)).toPandas().set_index("silo")
    for k in "ab":
        g = f[f.silo == k]
        delta = lambda g: auc(g) - nv.auc(g.y.to_numpy(), g.s2.to_numpy())
        assert abs(pair.loc[k].delta - delta(g)) < 1e-12 and np.abs(pair.loc[k][["lo", "hi"]].to_numpy(float) - drawn(g, delta)).max() < 0.03


def test_sample_auc_is_what_sql_says(spark):
    import duckdb

    f = scored(400, 3)
    sql = """WITH p AS (SELECT a.silo, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS auc FROM f a JOIN f b ON a.silo = b.silo AND a.y = 1 AND b.y = 0 GROUP BY a.silo)
    SELECT silo, auc FROM p"""
    want = dict(duckdb.sql(sql).fetchall())
    got = {r.silo: r.auc for r in resampling.auc_interval(spark.createDataFrame(f), 20).collect() if r.auc is not None and not np.isnan(r.auc)}
    assert got.keys() == want.keys() and all(abs(got[k] - float(want[k])) < 1e-9 for k in want)


def test_spearman_intervals(spark):
    f = scored()
    got = resampling.spearman_interval(spark.createDataFrame(f).repartition(7)).toPandas().set_index("silo")
    rho = lambda g: np.corrcoef(nv.average_ranks(g.s.to_numpy()), nv.average_ranks(g.s2.to_numpy()))[0, 1]
    for k in "abc":
        g = f[f.silo == k]
        assert abs(got.loc[k].rho - rho(g)) < 1e-9 and np.abs(got.loc[k][["lo", "hi"]].to_numpy(float) - drawn(g, rho)).max() < 0.05


def test_draws_hang_on_cells_alone(spark):
    f = scored(300)
    one = resampling.auc_interval(spark.createDataFrame(f).repartition(2), 30).toPandas()
    two = resampling.auc_interval(spark.createDataFrame(f.iloc[::-1]).repartition(9), 30).toPandas()
    assert one.sort_values("silo").round(12).equals(two.sort_values("silo").round(12).set_index(one.sort_values("silo").index))
    assert (resampling.weights(5, 3, 4000)[1:].mean() - 3) ** 2 < 0.02 and resampling.weights(5, 3, 9)[0] == 3


def test_omnibus_and_empty_tables(spark):
    f = scored()
    r = resampling.bootstrap_omnibus(spark.createDataFrame(f)).first()
    aucs = {k: (len(g), nv.auc(g.y.to_numpy(), g.s.to_numpy())) for k, g in f[f.silo != "c"].groupby("silo")}
    mean = sum(n * a for n, a in aucs.values()) / sum(n for n, _ in aucs.values())
    assert r.n_silos == 2 and abs(r.stat - sum(n * (a - mean) ** 2 for n, a in aucs.values())) < 1e-6 and 0 <= r.p <= 1
    none = spark.createDataFrame([], "silo string, s double, s2 double, y int")
    assert resampling.auc_interval(none).count() == resampling.spearman_interval(none).count() == 0 and resampling.bootstrap_omnibus(none).first().n_silos == 0


def test_plain_pairs_agree_with_ranks():
    assert nv.auc(np.array([1, 0, 1, 0]), np.array([2.0, 1.0, 1.0, 0.0])) == np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product([2.0, 1.0], [1.0, 0.0])])


# ---- ordered boosting


def boosted_plainly(x, y, fold, place, borders, m, trees, depth, rate, penalty):
    """One model row by row: residuals from the largest prefix before a row, prefix models of their own."""
    n, levels = len(y), max(1, int(np.log2(max(1, len(y) - 1))) + 1)
    bins = np.array([[0 if np.isnan(v) else int(np.searchsorted(b, v, side="left")) + 1 for v, b in zip(row, borders)] for row in x])
    train = [i for i in range(n) if fold[i] != m]
    weight = {c: len(train) / (2 * max(1, sum(y[i] == c for i in train))) for c in (0, 1)}
    f = np.zeros((levels + 1, n))
    grad = lambda i, v: (weight[y[i]] * (y[i] - 1 / (1 + np.exp(-v))), weight[y[i]] / (1 + np.exp(-v)) * (1 - 1 / (1 + np.exp(-v))))
    made = []
    for _ in range(trees):
        told = {i: grad(i, f[int(np.log2(place[i])), i] if place[i] else 0.0) for i in train}
        splits = []
        leaf = lambda i: sum(int(bins[i, c] > b) << k for k, (c, b) in enumerate(splits))
        for _ in range(depth):
            gains = {}
            for c in range(x.shape[1]):
                for b in range(len(borders[c]) + 2):
                    sides = defaultdict(lambda: [0.0, 0.0])
                    for i in train:
                        s = sides[leaf(i), bool(bins[i, c] > b)]
                        s[0], s[1] = s[0] + told[i][0], s[1] + told[i][1]
                    gains[c, b] = round(sum(g * g / (h + penalty) for g, h in sides.values()), 9)
            splits.append(max(gains, key=lambda k: (gains[k], -k[0], -k[1])))
        values = np.zeros((levels + 1, 1 << depth))
        for j in range(levels + 1):
            for k in range(1 << depth):
                both = [grad(i, f[j, i]) for i in train if leaf(i) == k and (j == levels or place[i] < 2**j)]
                values[j, k] = sum(g for g, _ in both) / (sum(h for _, h in both) + penalty)
        for i in range(n):
            f[:, i] += rate * values[:, leaf(i)]
        made.append(splits)
    return made, 1 / (1 + np.exp(-f[-1]))


def test_ordered_boosting_equals_a_plain_ordered_fit(spark):
    from sievewright.operators import boosting

    x, y = labelled(200, 4, 4)
    fold = np.arange(200) % 2
    rows = spark.createDataFrame([(i, int(fold[i]), int(y[i]), v) for i, v in enumerate(listed(x))], "id long, fold int, y int, x array<double>").repartition(3)
    model = boosting.OrderedBoosting(2, trees=6, depth=2, bins=8)
    got = model.fit(rows).toPandas().sort_values("id")
    placed = folds.draw_order(rows.selectExpr("*", "0 AS _all"), ["_all"], "id", "ordered", "place").toPandas().sort_values("id")
    borders = model._borders(rows, 4)
    for m in (0, 1):
        splits, scores = boosted_plainly(x, y, fold, placed.place.to_numpy(), borders[m], m, 6, 2, model.rate, model.penalty)
        assert [t.splits[m] for t in model.trees] == splits
        own = fold == m
        assert np.abs(got.score.to_numpy()[own] - scores[own]).max() < 1e-9


def test_a_label_never_enters_its_own_residual():
    from sievewright.operators import boosting

    place = np.arange(70)
    level = boosting.level_of(place)
    assert level[0] == -1 and all(2 ** level[p] <= p < 2 ** (level[p] + 1) for p in range(1, 70))


def test_ordered_boosting_learns_missing_values(spark):
    from sievewright.operators import boosting

    rng = np.random.default_rng(2)
    rows = [(i, i % 5, int(i % 3 == 0), [None if i % 3 == 0 else float(rng.normal()), float(rng.normal())]) for i in range(400)]
    got = boosting.ordered_gbt(spark.createDataFrame(rows, "id long, fold int, y int, x array<double>"), trees=4, depth=1).toPandas()
    assert len(got) == 400 and nv.auc(got.y.to_numpy(), got.score.to_numpy()) == 1.0
    assert boosting.ordered_gbt(spark.createDataFrame([], "id long, fold int, y int, x array<double>")).count() == 0
