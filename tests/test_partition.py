"""The split of silos against every bipartition looked at by itself."""

import itertools
import math
import random
from collections import Counter, defaultdict

from sievewright.operators import partition


def plainly(papers, briefs, most_apart, positives, rows):
    silos = sorted({s for s, _, _ in papers})
    holders, n, p = defaultdict(set), Counter(), Counter()
    for s, k, y in papers:
        holders[k].add(s)
        n[s] += 1
        p[s] += y == 1
    share = Counter(pair for h in holders.values() for pair in itertools.combinations(sorted(h), 2))
    words = {s: Counter(t.split()) for s, t in briefs}
    norm = lambda c: math.sqrt(sum(v * v for v in c.values()))
    topic = {(a, b): sum(words[a][w] * words[b][w] for w in words[a]) / (norm(words[a]) * norm(words[b])) for a, b in itertools.combinations(silos, 2)}
    out = []
    for mask in range(1, 1 << (len(silos) - 1)):
        side = {s: mask >> i & 1 for i, s in enumerate(silos)}
        gap = lambda c: abs(sum(c[s] * (2 * side[s] - 1) for s in silos)) / max(1, sum(c.values()))
        if abs(sum(2 * v - 1 for v in side.values())) <= most_apart and gap(p) <= positives and gap(n) <= rows:
            across = [(a, b) for a, b in itertools.combinations(silos, 2) if side[a] != side[b]]
            out.append((sum(share[x] for x in across), round(sum(topic[x] for x in across), 9), mask))
    return min(out) if out else None


def test_least_leak(spark):
    rng = random.Random(7)
    for seed in range(3):
        papers = [(f"s{rng.randrange(7)}", f"k{rng.randrange(60)}", rng.choice([0, 0, 1, None])) for _ in range(300)]
        briefs = [(f"s{i}", " ".join(rng.choice("abcdefg") * 2 for _ in range(9))) for i in range(7)]
        got = partition.least_leak(spark.createDataFrame(papers, "silo string, identity string, y int").repartition(3), spark.createDataFrame(briefs, "silo string, text string"), 1, 0.4, 0.3).collect()
        want = plainly(papers, briefs, 1, 0.4, 0.3)
        assert [(r.cut, round(r.topic, 5), r["mask"]) for r in got] == [(want[0], round(want[1], 5), want[2])]
    none = spark.createDataFrame([], "silo string, identity string, y int")
    assert partition.least_leak(none, spark.createDataFrame([], "silo string, text string")).count() == 0


def test_identity(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, " 10/X ", "t"), (2, " ", "A-b  c"), (3, None, " "), (4, None, None)], "k long, doi string, title string")
    assert [r[0] for r in frame.orderBy("k").select(partition.identity(F.col("doi"), F.col("title"), F.col("k"))).collect()] == ["doi:10/x", "ttl:a b c", "id:3", "id:4"]
