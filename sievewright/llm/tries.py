"""Prefix trie of rebuilt conversations, families first.

A conversation c is rebuilt from the first h turns of its family's head, c - c % 100, and its own turns after its first h; h is the unsigned CRC-32
of c in decimal modulo 6. Turns go to the workers as digests of role and text with the text's code points, dealt by family, which brings
heads and members together; the members of a family, at most 100, are rebuilt and make one small trie. A node's key is a chained digest of its turns, so
families agree on names without a dictionary. Only families' nodes are shuffled: sums by key give a node's members and smallest member over all.
Each node belongs to the family of its smallest member, whose trie holds its whole path; told which nodes it owns and which of them are childless, a
family adds up its subtrees once more, and sums by key give the subtrees over all, without a round per level.

The digest of a node's endings runs over ids in ascending order: families are ranges of ids, so their lists are joined by blocks of ranges in parallel, and
one pass of bounded memory per node takes the blocks in order (SHA-256 itself cannot be split).

Null turn numbers come first; rows of equal conv_id and turn follow each other by their digest, repeated rows are repeated turns; null role or text
counts as empty; rows without a conv_id belong to no conversation; a rebuilt conversation may have no turns; texts of any length are digested whole, in the JVM;
a family's digests are in memory at once (about 100 bytes a turn); remainders are those of SQL for negative ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FAMILY, MOST_HEAD, BLOCK = 100, 6, 100
ROOT, EMPTY = b"", hashlib.sha256(b"").hexdigest()


def head_length(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % MOST_HEAD


def chained(key: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(key + turn).digest()[:16]


class FamilyTrie:
    """The trie of one family: nodes in the order of their first member, so every parent stands before its children."""

    def __init__(self, conversations: dict[int, list[tuple[bytes, int]]], base: int):
        self.key, self.parent, self.depth, self.chars, self.members, self.low, self.ends = [ROOT], [-1], [0], [0], [0], [None], [[]]
        at = {ROOT: 0}
        for c in sorted(conversations):
            h, own = head_length(c), conversations[c]
            node, key = 0, ROOT
            self._meet(0, c)
            for turn, chars in conversations.get(base, [])[:h] + own[h:]:
                key = chained(key, turn)
                if key not in at:
                    at[key] = len(self.key)
                    for column, value in ((self.key, key), (self.parent, node), (self.depth, self.depth[node] + 1), (self.chars, chars), (self.members, 0), (self.low, None), (self.ends, [])):
                        column.append(value)
                node = at[key]
                self._meet(node, c)
            self.ends[node].append(c)

    def _meet(self, node: int, c: int) -> None:
        self.members[node] += 1
        if self.low[node] is None:
            self.low[node] = c


def _by_family(turns: dict[str, list]) -> dict[int, list[tuple[bytes, int]]]:
    """The conversations of a family's rows, each in order of turn (null first), then digest."""
    out: dict[int, list] = {}
    for c, t, digest, chars in zip(turns["conv_id"], turns["turn"], turns["digest"], turns["chars"]):
        out.setdefault(c, []).append(((t is not None, t or 0, digest), (digest, chars)))
    return {c: [x for _, x in sorted(rows, key=lambda r: r[0])] for c, rows in out.items()}


NODES = pa.schema([("base", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("members", pa.int64()), ("low", pa.int64()), ("at", pa.int32()), ("up", pa.int32()), ("ends", pa.string())])
NODES_SQL = "base long, key binary, parent binary, depth long, chars long, members long, low long, at int, up int, ends string"


def _tries(table: pa.Table) -> pa.Table:
    base = table.column("base")[0].as_py()
    trie = FamilyTrie(_by_family(table.select(["conv_id", "turn", "digest", "chars"]).to_pydict()), base)
    n = len(trie.key)
    parent = [None if p < 0 else trie.key[p] for p in trie.parent]
    ends = [",".join(map(str, e)) if e else None for e in trie.ends]
    return pa.table([pa.array([base] * n, pa.int64()), trie.key, parent, trie.depth, trie.chars, trie.members, trie.low, pa.array(range(n), pa.int32()), pa.array(trie.parent, pa.int32()), ends], schema=NODES)


def _subtrees(_, nodes: pa.Table, owned: pa.Table) -> pa.Table:
    """Sums over each subtree of a family's trie: childless nodes that it owns; text shared by its members, less once for what it owns."""
    nodes = nodes.sort_by("at")
    leaf = dict(zip(owned.column("key").to_pylist(), owned.column("leaf").to_pylist()))
    keys, up = nodes.column("key").to_pylist(), nodes.column("up").to_pylist()
    chars, members = nodes.column("chars").to_pylist(), nodes.column("members").to_pylist()
    leaves = [int(bool(leaf.get(k))) for k in keys]
    saved = [(m - (k in leaf)) * c for k, m, c in zip(keys, members, chars)]
    for i in range(len(keys) - 1, 0, -1):  # children stand after their parents
        leaves[up[i]] += leaves[i]
        saved[up[i]] += saved[i]
    return pa.table([pa.array(keys, pa.binary()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], names=["key", "n_leaves", "saved_tokens"])


def _digests(batches):
    """SHA-256 over each key's blocks in order, as they stream by; a key's rows lie in one partition, sorted."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if state is None or k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for every distinct prefix of the rebuilt conversations of ``conversations`` (conv_id, turn, role, text), the root among them."""
    scratch = Scratch(conversations.sparkSession, "tries")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(conv.isNotNull()).select(conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    turns = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    nodes = scratch.save(turns.groupBy("base").applyInArrow(_tries, NODES_SQL), "nodes")
    merged = nodes.groupBy("key").agg(F.min("low").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.sum("members").alias("n_convs"))
    merged = scratch.save(merged, "merged")
    children = scratch.save(merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "children")
    merged = scratch.save(merged.join(children, "key", "left").fillna(0, ["n_children"]), "counted")
    owned = merged.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "key", (F.col("n_children") == 0).alias("leaf"))
    mine = nodes.select("base", "key", "chars", "members", "at", "up")
    sums = mine.groupBy("base").cogroup(owned.groupBy("base")).applyInArrow(_subtrees, "key binary, n_leaves long, saved_tokens long")
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    # endings: a family's ids as they are, blocks of families joined in parallel, then one stream per key
    ends = nodes.where("ends is not null").select("key", F.floor(F.col("base") / (FAMILY * BLOCK)).alias("block"), "base", "ends")
    blocks = ends.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("base", "ends"))).alias("e"))
    blocks = scratch.save(blocks.select("key", "block", F.array_join(F.transform("e", lambda x: x["ends"]), ",").alias("ids")), "blocks")
    hashed = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")
    full = scratch.save(merged.join(sums, "key").join(hashed, "key", "left"), "full")
    above = scratch.save(merged.join(children.select("key"), "key", "left_semi").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "above")
    full = full.join(above, "parent", "left")  # both sides written: a hub's children can be split
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
