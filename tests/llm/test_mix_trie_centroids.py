"""Mixing, the prefix trie and centroid clustering against brute force, and their defined results at the edges."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sievewright.llm import annulus, mixing, tries
from sievewright.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, row string, key string, epoch int, taken int"


def table(spark, data, schema):
    return spark.createDataFrame(data, schema).repartition(3)


# ---- mixing


def filled(sizes, weights, most):
    """Targets by handing out the excess until none is above, in fractions of whole numbers."""
    from fractions import Fraction

    total, clamped = sum(sizes.values()), set()
    while True:
        weight = sum(weights[s] for s in sizes if s not in clamped)
        rest = total - sum(most * sizes[s] for s in clamped)
        targets = {s: Fraction(most * sizes[s]) if s in clamped else Fraction(weights[s] * rest, weight) for s in sizes}
        above = {s for s in sizes if targets[s] > most * sizes[s]}
        if not above:
            return {s: float(t) for s, t in targets.items()}
        clamped |= above


def mixed(docs, weights=(1, 2, 3), most=3):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = filled(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, most)
    out = []
    for s in sizes:
        goal, before = math.floor(targets[s] + 0.5), 0
        whole, quota = divmod(goal, sizes[s]) if sizes[s] else (0, 0)
        mine = [(hashlib.md5(f"mix:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), i, len(WORD.findall(t or ""))) for i, t, x in docs if x == s]
        for _, i, n in sorted(mine, key=lambda m: m[0]):
            out.append((i, n, sizes[s], targets[s], whole * n + max(0, min(n, quota - before))))
            before += n
    return sorted(out, key=repr)


def words(n):
    return " ".join(f"w{i}" for i in range(n))


CASES = {
    "capped": [(i, words(10), "a") for i in range(3)] + [(10 + i, words(400), "b") for i in range(6)] + [(30 + i, words(90), "c") for i in range(4)],
    "capped twice": [(1, words(1), "z"), (2, words(2), "y"), (3, words(3), "x"), (4, words(900), "w"), (5, words(30), "v"), (6, words(7), "u")],
    "edges": [(1, None, "s"), (2, "", "s"), (3, " \n\t ", None), (4, words(30000), "s"), (5, "a b", None), (5, "a b", None), (None, "c", "Ä"), (None, "c", "Ä"), (7, "x y z", ""), (8, "ä 漢字 😀", "😀"), (9, "q", "￮")],
    "no words": [(1, None, "a"), (2, "", "b")],
    "one": [(1, words(5), "a")],
}


@pytest.mark.parametrize("name", CASES)
def test_mix(spark, name):
    docs = CASES[name]
    got = mixing.shares(table(spark, [(*d, "r", "k", 1, 2) for d in docs], DOCS))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, got.collect()), key=repr)
    want = mixed(docs)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert all(g[4] <= 3 * g[1] for g in got)


def test_mix_many_documents_and_hot_source(spark):
    rng = random.Random(5)
    docs = [(i, words(rng.randrange(1, 60)), "hot" if i % 3 else f"s{i % 20}") for i in range(3000)]
    frame = table(spark, [(*d, "r", "k", 1, 2) for d in docs], DOCS)
    got = sorted(map(tuple, mixing.shares(frame).collect()), key=repr)
    assert [g[4] for g in got] == [w[4] for w in mixed(docs)]
    assert got == sorted(map(tuple, mixing.shares(frame.repartition(7)).collect()), key=repr)


def test_sample_gives_the_words_taken(spark):
    frame = table(spark, [(*d, "r", "k", 1, 2) for d in CASES["capped"]], DOCS)
    share = {r.doc_id: r for r in mixing.shares(frame).collect()}
    got = defaultdict(int)
    sampled = mixing.sample(frame)
    assert sampled.columns == [*frame.columns, "epoch_"]
    for r in sampled.collect():
        assert words(share[r.doc_id].size).startswith(r.text) and r.row == "r" and r.epoch == 1
        got[r.doc_id] += len(WORD.findall(r.text))
    assert {i: n for i, n in got.items()} == {i: r.taken for i, r in share.items() if r.taken}


def test_mix_of_nothing(spark):
    assert mixing.shares(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.sample(spark.createDataFrame([], DOCS)).count() == 0


def test_sources_are_ranked_over_partitions(spark):
    names = [f"{i:03d}" for i in range(300)] + [None]
    frame = spark.createDataFrame([(n,) for n in random.Random(1).sample(names, len(names))], "source string")
    got = {r.source: r["at"] for r in mixing.ranked_sources(frame, Scratch(spark, "rank")).collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_mix_is_native(spark):
    plan = mixing.shares(table(spark, [(*d, "r", "k", 1, 2) for d in CASES["capped"]], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


# ---- prefix trie


TURNS = "turn long, text string, role string, conv_id long, base long, key string"


def trie(rows):
    convs = defaultdict(list)
    for t, x, r, c in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()), (r, x)))
    convs = {c: [v for _, v in sorted(turns, key=lambda z: z[0])] for c, turns in convs.items()}
    rebuilt = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(convs.get(c - int(math.fmod(c, 100)), [])[:h] + convs[c][h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    ends = lambda k: ",".join(str(c) for c in members[k] if len(rebuilt[c]) == len(k))
    return sorted(
        ((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items()), key=repr
    )


def conversations(rng, ids):
    out = []
    for c in ids:
        for t in range(rng.randrange(1, 9)):
            out.append((t, rng.choice(["hi", "hello there", "", None, "😀 ok", f"own {c}"]), rng.choice(["user", "assistant", None]), c))
    return out


TALKS = {
    "random": conversations(random.Random(1), random.Random(2).sample(range(2000), 400)),
    "deep and wide": [(t, "same", "user", 5) for t in range(700)] + [(t, "same", "user", c) for c in range(100, 9000, 7) for t in range(3)] + conversations(random.Random(3), range(20000, 20120)),
    "edges": [(None, "first", "user", 1), (0, "zero", "user", 1), (0, "tie", "user", 1), (0, "tie", "user", 1), (None, None, None, 100), (3, "x" * 200000, "a", 107), (1, "q", "u", None), (0, "neg", "u", -5), (0, "neg", "u", -205), (0, "z", "u", 0), (2**40, "late", "u", 7)],
    "only short ones": [(0, "a", "u", c) for c in range(300, 420)],
}


@pytest.mark.parametrize("name", TALKS)
def test_trie(spark, name):
    got = tries.prefix_trie(table(spark, [(*r, 1, "k") for r in TALKS[name]], TURNS))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == trie(TALKS[name])


def test_trie_of_nothing(spark):
    assert tries.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert tries.prefix_trie(table(spark, [(1, "a", "u", None, 1, "k")], TURNS)).count() == 0


def test_endings_stream_over_batches():
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([i for _, i in rows])], ["key", "ids"])
    out = [r for b in tries._digests([batch([(b"a", "1,2"), (b"a", "3")]), batch([(b"a", "4"), (b"b", "5")])]) for r in b.to_pylist()]
    assert out == [{"key": b"a", "ends_sha256": hashlib.sha256(b"1,2,3,4").hexdigest()}, {"key": b"b", "ends_sha256": hashlib.sha256(b"5").hexdigest()}]


# ---- centroids


VECTORS = "vec_id long, embedding array<double>, label int, v string, cluster int"


def lloyd(rows, k=16, rounds=3, size=64):
    kept = [(i, [64 * int(x) if abs(x) > 2**60 else math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    raw = {id(w): v for (_, w), v in zip(kept, [v for _, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)])}
    centroids = [w for _, w in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", raw[id(r[1])]))[:k]]
    near = lambda w: min((sum((a - b) ** 2 for a, b in zip(w, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, w in kept:
            groups[near(w)[1]].append(w)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centroids)]
    found = [(i, *near(w)) for i, w in kept]
    most = 2**63 - 1
    inertia = defaultdict(int)
    for _, d, j in found:
        inertia[j] += min(d, most)
    total = min(sum(inertia.values()), most)
    return sorted(((i, j, min(d, most), min(inertia[j], most), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def vectors(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 64)) * spread
    return [(i, (centres[i % 9] * (1 + i % 3) + rng.normal(size=64)).tolist()) for i in range(n)]


CLOUDS = {
    "clouds": vectors(1, 600, 6.0),
    "norms apart": [(i, [float(10 ** (i % 5)) * (1 + (i % 7) / 50)] + [0.01 * (i % 11)] * 63) for i in range(300)],
    "ties": [(i, [float(i % 2)] * 64) for i in range(40)] + [(i, [0.0] * 63 + [-0.001]) for i in range(10)],
    "edges": [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 63 + [float("nan")]), (5, [1.0] * 63 + [float("inf")]), (6, [1.0] * 63 + [None]), (7, [0.5] * 64), (7, [0.25] * 64), (None, [2.0] * 64), (8, [-0.004] * 64)],
    "large": [(i, [float(10**i)] + [0.1] * 63) for i in range(0, 12)] + [(100, [3.0e38] * 64), (101, [-1.7e308] * 64), (102, [1.0] * 64)],
}


@pytest.mark.parametrize("name", CLOUDS)
def test_clusters(spark, name):
    rows = CLOUDS[name]
    got = annulus.clusters(table(spark, [(*r, 1, "v", 2) for r in rows], VECTORS))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(rows)


def test_clusters_of_nothing(spark):
    assert annulus.clusters(spark.createDataFrame([], VECTORS)).count() == 0


def test_annulus_compares_few_and_keeps_border_ties():
    v = annulus.whole(np.array([r[1] for r in CLOUDS["norms apart"]]), 64)
    c = [[int(x) for x in row] for row in v[:40:3]]
    found, best, compared = annulus.nearest(v, c)
    every = ((v[:, None] - np.array(c, float)[None]) ** 2).sum(-1)
    assert (found == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert compared < len(v) * len(c) / 2
    # (3, 0) and (0, 3) are as far from (4, 4): the smaller number wins, whatever its norm's place
    for c in ([[3, 0], [0, 3]], [[0, 3], [3, 0]], [[9, 9], [3, 0], [0, 3]]):
        assert annulus.nearest(np.array([[4.0, 4.0]]), c)[0].tolist() == [len(c) - 2]
