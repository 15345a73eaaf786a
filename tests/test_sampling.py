"""Places within groups over ranges against sorting each group."""

import hashlib
import random
from collections import defaultdict

from sievewright.operators import evaluation, sampling


def table(spark, n=400):
    rng = random.Random(3)
    return [(i, rng.choice(["a", "a", "a", "b", None]), int(rng.random() < 0.1), rng.choice([None, *[x / 7 for x in range(9)]])) for i in range(n)] + [(900, "alone", 1, 0.5)]


def test_places(spark):
    rows = table(spark)
    frame = spark.createDataFrame(rows, "paper_id long, silo string, y int, s double").repartition(5)
    got = {r.paper_id: (r.before, r.total) for r in evaluation.places(frame, ["silo"], ["s", "paper_id"]).collect()}
    groups = defaultdict(list)
    for i, silo, _, s in rows:
        groups[silo].append((s is not None, s or 0, i))
    want = {i: (at, len(g)) for g in groups.values() for at, (_, _, i) in enumerate(sorted(g))}
    assert got == want
    ties = {r.paper_id: r.before for r in evaluation.places(frame, ["silo"], ["s"]).collect()}
    assert all(ties[i] == sum(x[:2] < (s is not None, s or 0) for x in groups[silo]) for i, silo, _, s in rows)
    assert evaluation.places(frame.limit(0), ["silo"], ["s"]).count() == 0


def test_samples_and_folds(spark):
    rows = [r for r in table(spark) if r[1]]
    frame = spark.createDataFrame(rows, "paper_id long, silo string, y int, s double").repartition(5)
    order = lambda i: (hashlib.md5(f"42-{i}".encode()).hexdigest(), i)
    got = {r.paper_id: r.w for r in sampling.case_control(frame, 20).collect()}
    for silo in ("a", "b", "alone"):
        mine = [r for r in rows if r[1] == silo]
        controls = sorted((r[0] for r in mine if r[2] == 0), key=order)
        kept = {r[0]: 1.0 for r in mine if r[2] == 1} | {i: round(len(controls) / min(20, len(controls)), 6) for i in controls[:20]}
        assert {i: w for i, w in got.items() if i in {r[0] for r in mine}} == kept
    folds = {r.paper_id: r.fold for r in sampling.class_deal(frame).collect()}
    assert folds[900] is None and all(folds[r[0]] in range(5) for r in rows if r[1] == "a")
    for y in (0, 1):
        ids = sorted(r[0] for r in rows if r[1] == "a" and r[2] == y)
        assert [folds[i] for i in ids] == [k % 5 for k in range(len(ids))]


def test_dealing_cards_and_negatives(spark):
    cards = spark.createDataFrame([(i, "a", float(i % 10)) for i in range(30)] + [(100, "b", 1.0)], "paper_id long, silo string, score double")
    known = spark.createDataFrame([(200 + i, "a", float(i)) for i in range(9)] + [(300, "b", 0.0)], "paper_id long, silo string, score double")
    got = sorted((r.place, r.control, r.paper_id) for r in sampling.dealt_cards(cards, known).where("silo = 'a'").collect())
    assert [g[0] for g in got] == list(range(1, len(got) + 1)) and [g[0] for g in got if g[1]] == [9, 16, 23, 30] and [g[2] for g in got if g[1]] == [200, 201, 202, 203]
    assert [g[2] for g in got if not g[1]] == sorted(range(30), key=lambda i: (-(i % 10), i))
    rows = spark.createDataFrame([(i, "a", 0, i / 50) for i in range(50)] + [(60, "a", 1, 2.0), (61, "a", 0, None)], "paper_id long, silo string, y int, s double")
    by = defaultdict(set)
    for r in sampling.negatives(rows, 4).collect():
        by[r.policy].add(r.paper_id)
    assert by["hard"] == {49, 48, 47, 46} and by["easy"] == {61, 0, 1, 2} and by["mixed"] == {49, 48, 61, 0} and len(by["random"]) == 4


def test_shares_and_shots(spark):
    rows = [r for r in table(spark) if r[1]]
    frame = spark.createDataFrame(rows, "paper_id long, silo string, y int, s double")
    order = lambda seed: lambda i: (hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), i)
    groups = defaultdict(list)
    for i, silo, y, _ in rows:
        groups[silo, y].append(i)
    want = {i for g in groups.values() for i in sorted(g, key=order(42))[:max(1, round(0.1 * len(g)))]}
    assert {r.paper_id for r in sampling.stratified_share(frame).collect()} == want
    shots = {(f, i) for f in range(5) for g in groups.values() for i in sorted((i for i in g if i % 5 != f), key=order(7))[:2]}
    assert {(r.fold, r.paper_id) for r in sampling.few_shots(frame).collect()} == shots
