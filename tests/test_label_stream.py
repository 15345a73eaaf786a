"""Labels with undo as a stream, restarted, with late rows, against the table."""

import random
from datetime import datetime, timedelta

from sievewright.streaming import labels

SCHEMA = "key string, seq long, label string, ts timestamp"


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_restarts_and_late_rows_equal_the_table(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(5)}", i, rng.choice(["yes", "no", "maybe", labels.UNDO]), at(i * 3)) for i in range(120)]
    late = [r for i, r in enumerate(rows) if i % 11 == 5]  # come a batch after their time, within the hour
    first, second = [r for r in rows[:60] if r not in late], [r for r in rows[60:] if r not in late]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in (first, [r for r in late if r[1] < 60 and r[1] > 42], second, [r for r in late if r[1] >= 102]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        got = labels.run(spark.readStream.schema(SCHEMA).parquet(source), out, state)  # a query of its own each time, on the same state
    want = {r.key: (r.seq, r.label, r.versions) for r in labels.batch_states(spark.read.parquet(source)).collect()}
    assert {r.key: (r.seq, r.label, r.versions) for r in got.collect()} == want and all(r.dropped == 0 for r in got.collect())


def test_what_comes_after_it_is_settled_is_dropped(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in ([("a", 1, "yes", at(0)), ("a", 3, "no", at(5))], [("b", 9, "x", at(600))], [("b", 10, "y", at(900))], [("a", 2, "maybe", at(895)), ("a", 4, labels.UNDO, at(896))]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        got = labels.run(spark.readStream.schema(SCHEMA).parquet(source), out, state)
    assert {r.key: (r.seq, r.label, r.versions, r.dropped) for r in got.collect()} == {"a": (4, "yes", 2, 1), "b": (10, "y", 2, 0)}


def test_fold():
    assert labels.folded([], [(2, labels.UNDO), (1, "a"), (3, "b"), (4, "c"), (5, labels.UNDO)]) == ["b"] and labels.folded([], [(1, labels.UNDO)]) == []
