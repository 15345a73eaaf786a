"""Copies, keys, constants and manifests at the edges; components by distributed products."""

import numpy as np

from sievewright.operators import embedding, records

PAPERS = "paper_id long, silo string, doi string, title string"


def test_copies_within_and_across(spark):
    rows = [(1, "a", "10/x", "One  Title"), (2, "a", "10/x", "Other"), (3, "a", " ", "one title"), (4, "a", None, ""), (5, "a", None, None), (6, "b", "10/x", "ONE TITLE"), (7, "b", None, "alone"), (8, None, "10/y", "t"), (9, None, "10/y", "u")]
    frame = spark.createDataFrame(rows, PAPERS).repartition(3)
    got = {r.paper_id: (r.dup_doi, r.dup_title, r.kept) for r in records.duplicate_flags(frame).collect()}
    assert got == {1: (False, False, True), 2: (True, False, False), 3: (False, True, False), 4: (False, False, True), 5: (False, True, False), 6: (False, False, True), 7: (False, False, True), 8: (False, False, True), 9: (True, False, False)}
    across = {r.paper_id: (r.doi_across, r.title_across) for r in records.shared_across(frame).collect()}
    assert across[6] == (True, True) and across[1] == (False, False) and across[7] == (False, False)
    none = frame.limit(0)
    assert records.duplicate_flags(none).count() == records.shared_across(none).count() == records.key_report(none).count() == 0


def test_keys_and_constants(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b")], "paper_id long, silo string")
    assert sorted(map(tuple, records.key_report(frame).collect())) == [("a", 3, 2, 1, 1), ("b", 2, 2, 0, 1)]
    briefs = spark.createDataFrame([("a", "x", ["p", "q"]), ("a", "x", ["p", "q"]), ("b", None, ["p"]), ("b", "y", None)], "silo string, obj string, must array<string>")
    assert sorted(map(tuple, records.constants(briefs, "silo", ["obj", "must"]).collect())) == [("a", "must", 1, True), ("a", "obj", 1, True), ("b", "must", 2, False), ("b", "obj", 2, False)]


def test_manifest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 0, None), ("a", None, "y"), ("b", 0, "z")], "silo string, y int, doi string")
    facts = records.collection_facts(rows, ["doi"])
    got = {(r.silo, r.field): r.value for r in facts.collect()}
    assert got["a", "rows"] == 3 and got["a", "prevalence"] == 0.33333 and got["a", "coverage.doi"] == 0.6667 and got["b", "positive"] == 0
    manifest = spark.createDataFrame([("a", "rows", 3.0), ("a", "prevalence", 0.3334), ("a", "coverage.doi", 0.667), ("b", "rows", 2.0), ("b", "coverage.doi", 0.99), ("c", "rows", 1.0)], "silo string, field string, value double")
    assert sorted(((r.silo, r.field) for r in records.manifest_problems(facts, manifest).collect())) == [("b", "coverage.doi"), ("b", "rows"), ("c", "rows")]


def test_power_iteration_finds_the_first_components(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6)) * np.array([9, 4, 1, 1, 0.5, 0.1]) + 3
    got = [r.share for r in embedding.power_iteration(spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(4)).orderBy("component").collect()]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    e = np.linalg.eigvalsh((u - u.mean(0)).T @ (u - u.mean(0)))[::-1]
    assert np.allclose(got, e[:2] / e.sum(), atol=1e-4)
    assert embedding.power_iteration(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
