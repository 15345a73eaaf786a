"""Embedding near-dedup by a cover tree's dual traversal.

The upper levels are nested nets with halving radii over a bounded sample (``SAMPLE`` vectors of lowest hash, at most ``MOST_NODES``
centres, farthest-first, so that every prefix is a net). Every vector goes to its nearest centre; a crowded centre's vectors are
salted into blocks of ``LEAF`` rows, and each block grows its own nested nets over all of its rows, down to nodes of ``TWIGS`` vectors on
average or of radius zero: the tree's nodes grow with the rows. Counts and covering radii of all nodes come from all rows.

The dual traversal walks pairs of nodes, on the upper levels to choose pairs of blocks, within a pair of blocks from the blocks'
roots down: a pair whose centres lie farther apart than both radii and the threshold distance is pruned with all below it, a
pair that lies within the threshold as a whole is linked as a whole, and pairs of lowest nodes that are neither are compared
vector by vector in double precision. Every pair at or above the threshold is found: pruning only drops pairs that the triangle
inequality excludes. Where the data have no low intrinsic dimension few pairs of nodes are pruned, and comparisons grow
as the square of the distinct vectors, in bounded blocks.

Equal vectors are compared once and count with their multiplicity. Null, zero, empty or non-finite vectors
link with nothing, nor do vectors of different lengths; a null vec_id keeps its row and
never names a component; rows that repeat a vec_id are vectors of their own and link with each other; ties of distance change which node
holds a vector, never a result; an empty table gives no rows; other columns are ignored; vectors of any length are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

COSINE, LEAF, SAMPLE, MOST_NODES, TWIGS = 0.9, 8192, 4096, 512, 48
#: More than the rounding of a distance between unit vectors, which is computed from their product.
EPS = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nested_nets(sample: np.ndarray, most: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Farthest-first centres, the net each opens (level k holds centres over 2 / 2^k apart) and their rows."""
    if not len(sample):
        return sample, [], []
    order, levels = [0], [0]
    away = np.linalg.norm(sample - sample[0], axis=1)
    while len(order) < min(most, len(sample)):
        i = int(away.argmax())
        if away[i] < 1e-9:
            break
        order.append(i)
        levels.append(max(1, int(np.ceil(np.log2(2 / away[i])))))
        np.minimum(away, np.linalg.norm(sample - sample[i], axis=1), out=away)
    return sample[order], levels, order


def parents(centres: np.ndarray, levels: list[int]) -> list[int]:
    """Each node's nearest node of a coarser net."""
    out = [-1]
    for i in range(1, len(levels)):
        above = [j for j in range(i) if levels[j] < levels[i]]
        out.append(above[int(np.linalg.norm(centres[above] - centres[i], axis=1).argmin())])
    return out


class Tree:
    """A node is a centre with the vectors that lie nearest to it; ``radius`` covers those, ``reach`` also the nodes below."""

    def __init__(self, centres: np.ndarray, levels: list[int], radius: np.ndarray):
        self.centres, self.radius, self.up = centres, radius, parents(centres, levels)
        self.below: list[list[int]] = [[] for _ in self.up]
        self.reach = radius.astype(float).copy()
        for i in range(len(self.up) - 1, 0, -1):
            self.below[self.up[i]].append(i)
            self.reach[self.up[i]] = max(self.reach[self.up[i]], self.reach[i] + np.linalg.norm(centres[i] - centres[self.up[i]]))


def dual_traversal(one: Tree, two: Tree, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of nodes whose own vectors a threshold pair may join, their distances, and how many pairs were never looked at, as a pair above them was pruned.

    A tree against itself gives pairs (a <= b).
    """
    self_join = one is two
    away = np.sqrt(np.maximum(0.0, (one.centres**2).sum(1)[:, None] + (two.centres**2).sum(1)[None] - 2 * one.centres @ two.centres.T))
    seen, out = np.zeros(away.shape, bool), []
    todo, seen[0, 0] = [(0, 0)], True
    while todo:
        a, b = todo.pop()
        d = away[a, b] - EPS
        if d > one.reach[a] + two.reach[b] + limit:
            continue
        if d <= one.radius[a] + two.radius[b] + limit:
            out.append((a, b))
        for x, y in [(a, c) for c in two.below[b]] + [(c, b) for c in one.below[a]]:
            if not seen[x, y]:
                seen[x, y] = True
                todo.append((x, y))
    pairs = {(min(p), max(p)) for p in out} if self_join else out
    pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return pairs, away[pairs[:, 0], pairs[:, 1]], away.size - int(seen.sum())


def _assign(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1))
            cell = (x @ centres.T).argmax(axis=1)
            away = np.linalg.norm(x - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "n", "v")] + [pa.array(cell.astype(np.int32)), pa.array(away)], names=["rep", "n", "v", "cell", "away"])

    return run


def _vectors(table) -> np.ndarray:
    return unit(np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1))


def _grow(twigs: int):
    """Nested nets of one block: each row's node, and the level that a node's centre opens (null for other rows)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        x = _vectors(table)
        centres, levels, rows = nested_nets(x, max(1, -(-len(x) // twigs)))
        node = np.empty(len(x), np.int64)
        for i in range(0, len(x), 1024):
            node[i:i + 1024] = (x[i:i + 1024] @ centres.T).argmax(axis=1)
        node[rows] = np.arange(len(rows))
        level = np.full(len(x), -1)
        level[rows] = levels
        return table.select(["cell", "salt", "rep", "n", "v"]).append_column("node", pa.array(node.astype(np.int32))).append_column("level", pa.array(level.astype(np.int32)))

    return run


class Block:
    """One block's rows in the order of their nodes, and its tree."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("node", "ascending"), ("level", "descending"), ("rep", "ascending")])
        self.rep, self.n, self.x = table.column("rep").to_numpy(), table.column("n").to_numpy(), _vectors(table)
        node = table.column("node").to_numpy()
        self.begin = np.flatnonzero(np.diff(node, prepend=-1))  # a centre comes first of its node
        self.end = np.append(self.begin[1:], len(node))
        away = np.linalg.norm(self.x - np.repeat(self.x[self.begin], self.end - self.begin, axis=0), axis=1)
        self.tree = Tree(self.x[self.begin], table.column("level").to_numpy()[self.begin].tolist(), np.maximum.reduceat(away, self.begin))


class Links:
    """Link counts and spanning edges of one pair of blocks."""

    def __init__(self, one: Block, two: Block):
        self.one, self.two = one, two
        self.count = np.zeros(len(one.rep), np.int64), np.zeros(len(two.rep), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def whole(self, a: slice, b: slice) -> None:
        """Every row of ``a`` links with every row of ``b``."""
        self.count[0][a] += self.two.n[b].sum()
        self.count[1][b] += self.one.n[a].sum()
        ids = np.concatenate((self.one.rep[a], self.two.rep[b]))
        self.edges.append((ids, np.full(len(ids), ids.min())))

    def compared(self, a: slice, b: slice, cosine: float) -> None:
        for i in range(a.start, a.stop, 512):
            part = slice(i, min(i + 512, a.stop))
            near = self.one.x[part] @ self.two.x[b].T >= cosine
            if near.any():
                self.count[0][part] += near @ self.two.n[b]
                self.count[1][b] += near.T @ self.one.n[part]
                self.edges.append(_stars(near, self.one.rep[part], self.two.rep[b]))

    def within(self, a: slice, cosine: float) -> None:
        """Pairs of one node's own rows."""
        near = self.one.x[a] @ self.one.x[a].T >= cosine
        np.fill_diagonal(near, False)
        if near.any():
            self.count[0][a] += near @ self.one.n[a]
            self.edges.append(_stars(near, self.one.rep[a], self.one.rep[a]))


def _stars(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest id of each component of a bipartite block of links."""
    la, lb = a.copy(), b.copy()
    rows, cols = np.nonzero(near)
    while True:
        na, nb = la.copy(), lb.copy()
        np.minimum.at(na, rows, nb[cols])
        np.minimum.at(nb, cols, na[rows])
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return np.concatenate((a, b)), np.concatenate((la, lb))


def compare_blocks(one: Block, two: Block, cosine: float) -> tuple[Links, dict[str, int]]:
    """Links of two blocks (or of one with itself), and how many pairs of nodes there are, were pruned (unseen: with a pair above them), linked whole and compared."""
    links, limit = Links(one, two), float(np.sqrt(2 - 2 * cosine))
    pairs, away, unseen = dual_traversal(one.tree, two.tree, limit)
    every = len(one.begin) * (len(one.begin) + 1) // 2 if one is two else len(one.begin) * len(two.begin)
    did = {"pairs": every, "pruned": every - len(pairs), "unseen": unseen, "whole": 0, "compared": 0}
    spans = lambda block, i: slice(int(block.begin[i]), int(block.end[i]))
    whole = away + one.tree.radius[pairs[:, 0]] + two.tree.radius[pairs[:, 1]] <= limit - EPS
    compared: dict[int, list[int]] = {}
    for (a, b), all_near in zip(pairs.tolist(), whole.tolist(), strict=True):
        if one is two and a == b:
            links.within(spans(one, a), cosine)
            did["compared"] += 1
        elif all_near:
            links.whole(spans(one, a), spans(two, b))
            did["whole"] += 1
        else:
            compared.setdefault(a, []).append(b)
            did["compared"] += 1
    for a, others in compared.items():  # neighbouring nodes of the second block at one go
        cuts = [i for i in range(1, len(others)) if others[i] != others[i - 1] + 1]
        for i, j in zip([0, *cuts], [*cuts, len(others)], strict=True):
            links.compared(spans(one, a), slice(int(two.begin[others[i]]), int(two.end[others[j - 1]])), cosine)
    return links, did


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        side = pa.compute.field("side")
        same = pa.compute.all(pa.compute.equal(table.column("side"), 2)).as_py()
        one = Block(table if same else table.filter(side == 0))
        two = one if same else Block(table.filter(side == 1))
        links, _ = compare_blocks(one, two, cosine)
        vec, count = (one.rep, sum(links.count)) if same else (np.concatenate((one.rep, two.rep)), np.concatenate(links.count))
        some = count > 0
        vec, count = vec[some], count[some]
        cat = lambda k: np.concatenate([e[k] for e in links.edges]).astype(np.int64) if links.edges else np.zeros(0, np.int64)
        s, d = cat(0), cat(1)
        s, d = s[s != d], d[s != d]
        return pa.table({
            "src": pa.concat_arrays([pa.array(vec, pa.int64()), pa.array(s)]), "dst": pa.concat_arrays([pa.nulls(len(vec), pa.int64()), pa.array(d)]),
            "links": pa.concat_arrays([pa.array(count, pa.int64()), pa.nulls(len(s), pa.int64())]),
        })

    return run


def near_vectors(rows: DataFrame, cosine: float = COSINE, leaf: int = LEAF, sample: int = SAMPLE, twigs: int = TWIGS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "covertree")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    distinct = rows.where(valid).groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    distinct = scratch.save(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct")  # ids that null and repeated vec_ids don't touch
    sizes = [r[0] for r in distinct.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]  # vector lengths: one, as a rule
    found = None
    for d in sizes:
        part = _pairs(distinct.where(F.size("v") == d).select("rep", "n", "v"), cosine, leaf, sample, twigs, scratch, d)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "src long, dst long, links long")
    found = scratch.save(found, "found")
    links = found.where("links is not null").groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("others"))
    roots = connected_components(found.where("dst is not null").select("src", "dst"), scratch)
    reps = distinct.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    reps = scratch.save(reps.select("v", "low", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "rep").alias("root")), "reps")
    names = scratch.save(reps.groupBy("root").agg(F.min("low").alias("component_id")), "names")
    reps = reps.join(names, "root").select("v", "links", "component_id")
    out = rows.where(valid).join(reps, "v").select("vec_id", F.col("links").alias("n_links"), "component_id")
    out = out.union(rows.where(~F.coalesce(valid, F.lit(False))).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _pairs(points: DataFrame, cosine: float, leaf: int, sample: int, twigs: int, scratch: Scratch, d: int) -> DataFrame:
    spark = points.sparkSession
    total = points.count()
    few = points.orderBy(F.xxhash64("v"), "v").limit(sample).select("v").toPandas().v
    if not len(few):
        return spark.createDataFrame([], "src long, dst long, links long")
    centres, levels, _ = nested_nets(unit(np.stack(few.to_numpy())), max(1, min(MOST_NODES, -(-total // leaf) * 2)))
    kind = dict(points.dtypes)["v"]
    placed = scratch.save(points.select("rep", "n", "v").mapInArrow(_assign(centres), f"rep long, n long, v {kind}, cell int, away double"), f"placed{d}")
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("c"), F.max("away").alias("r")).collect()}  # a row a node
    radius = np.array([stats[i]["r"] if i in stats else 0.0 for i in range(len(centres))])
    salts = {i: -(-stats[i]["c"] // leaf) for i in stats}
    tree = Tree(centres, levels, radius)
    upper, _, _ = dual_traversal(tree, tree, float(np.sqrt(2 - 2 * cosine)))
    upper = [(a, b) for a, b in upper.tolist() if a in salts and b in salts]  # at most MOST_NODES^2 / 2, whatever the rows
    counts = F.create_map(*[F.lit(x) for kv in salts.items() for x in kv])
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("v"), counts[F.col("cell")]).cast("int"))
    schema = f"cell int, salt int, rep long, n long, v {kind}, node int, level int"
    blocks = scratch.save(salted.select("cell", "salt", "rep", "n", "v").groupBy("cell", "salt").applyInArrow(_grow(twigs), schema), f"blocks{d}")
    # the plan of block pairs, on the executors: a row for each pair of salts of each pair of nodes
    each = lambda c, s: F.explode(F.sequence(F.lit(0), counts[F.col(c)] - 1)).alias(s)
    plan = spark.createDataFrame(upper, "a int, b int").select("a", "b", each("a", "i")).select("*", each("b", "j")).where("a < b or i <= j")
    plan = scratch.save(plan.withColumn("key", F.monotonically_increasing_id()), f"plan{d}")
    same = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    sides = plan.select(F.col("a").alias("cell"), F.col("i").alias("salt"), "key", F.when(same, 2).otherwise(0).alias("side"))
    sides = sides.union(plan.where(~same).select("b", "j", "key", F.lit(1)))
    sent = blocks.join(sides, ["cell", "salt"]).select("key", "side", "rep", "n", "v", "node", "level")
    return sent.groupBy("key").applyInArrow(_compare(cosine), "src long, dst long, links long")
