"""SimHash near-dedup by covering locality-sensitive hashing.

Fifteen structured masks cover the radius: every bit position owns a non-zero vector of
{0,1}^4, mask v keeps the positions whose vector has an odd product with v, and three
positions never span {0,1}^4, so some mask misses all bits in which a pair within radius
three differs. A mask keeps about 34 of 64 bits. Buckets of more than ``DIRECT`` distinct
fingerprints are covered again on the bits that their mask dropped, which bounds a bucket
by 2^15 fingerprints whatever the input holds; nothing is capped.

Null or blank texts have fingerprint zero and link like any other; a null ``doc_id`` keeps its row
and never names a component with other ids; repeated rows give repeated rows (``keep_representatives``
keeps one of them, and every row without an id); texts are hashed whole, 8 MB of them at a time or one longer text; an empty
table gives no rows; ties need no rule, as a component is named by its smallest id; other columns are kept by ``keep_representatives``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, connected_components, fresh, slices

RADIUS, SHINGLE, DIRECT = 3, 3, 4096
_ONES = np.uint64(0x0101010101010101)


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions`` such that any ``radius`` of them are missed together by one mask."""
    m = (1 << radius + 1) - 1
    return [sum(1 << p for i, p in enumerate(positions) if bin(v & (1 + i % m)).count("1") & 1) for v in range(1, m + 1)]


MASKS = covering_masks(list(range(64)))
FINER = [[m | x for x in covering_masks([p for p in range(64) if not m >> p & 1])] for m in MASKS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majority bits of ``sizes[i]`` hashes each; counts run bytewise, eight bits to a word."""
    out = np.zeros((len(sizes), 64), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        blocks = -(-sizes // 255)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        cut = begin[owner] + 255 * nth
        first = (np.cumsum(blocks) - blocks)[some]
        for k in range(8):
            part = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, cut).view(np.uint8).reshape(-1, 8)
            out[some, k::8] = np.add.reduceat(part.astype(np.int64), first, axis=0)
    bits = out * 2 > sizes[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()  # bytes: only A-Z, only the ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    flat, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(flat, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    begin = [0, *(gaps[: len(words) - k] + 1).tolist()]
    end = [*gaps[k - 1:].tolist(), len(flat)]
    return np.fromiter((h(flat[s:e], 42) for s, e in zip(begin, end, strict=True)), np.uint64, len(begin))


def _fingerprints(batches):
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for i, j in slices(texts, 8 << 20):
            hashes = [shingle_hashes(t) for t in texts[i:j]]
            sizes = np.array([len(x) for x in hashes])
            fp = fingerprint_bits(np.concatenate(hashes), sizes)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c)[i:j] for c in names], pa.array(fp.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _text_key(text: str = "text") -> F.Column:
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def spanning_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that join whatever is linked within ``fps``: each fingerprint is reached once."""
    left, a, b = fps, [], []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            hit = np.bitwise_count(left ^ x) <= radius
            if hit.any():
                near = left[hit]
                a.append(np.full(len(near), x)), b.append(near)
                stack.extend(near)
                left = left[~hit]
    return a, b


def _bucket_edges(batches):
    for batch in batches:
        a, b = [], []
        for fps in batch.column("fps").to_numpy(zero_copy_only=False):
            x, y = spanning_pairs(np.asarray(fps, np.int64).view(np.uint64))
            a += x
            b += y
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)], names=["src", "dst"])


def linked(fps: DataFrame, scratch: Scratch, direct: int = DIRECT) -> DataFrame:
    """Edges (src, dst) over distinct fingerprints ``fp`` that connect whatever is linked within the radius."""
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(MASKS)]))
    keys = fps.select("fp", table.alias("k")).select("k.t", "k.key", "fp")
    shared = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    hits = scratch.save(keys.join(shared, ["t", "key"]), "hits")
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in FINER])
    again = (
        hits.where(F.col("n") > direct).select("t", "fp", F.posexplode(F.element_at(finer, F.col("t") + 1)).alias("v", "m"))
        .select((F.col("t") * 15 + F.col("v") + 15).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    )
    groups = hits.where(F.col("n") <= direct).select("t", "key", "fp").union(again).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    return groups.where(F.size("fps") > 1).select("fps").mapInArrow(_bucket_edges, "src long, dst long")


def _roots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """fp, low (its smallest doc_id), root (null where nothing is near) of the distinct fingerprints of ``rows``."""
    fps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    roots = connected_components(linked(fps.select("fp"), scratch), scratch)
    return fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "low", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.save(fingerprints(docs), "rows")
    joined = _roots(rows, scratch)
    lows = joined.where("root is not null").groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.where("root is not null").join(lows, "root").select("fp", "component_id").union(joined.where("root is null").select("fp", "low"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per component, the first by (doc_id, fingerprint, text hash), and every row with a null doc_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    known = docs.where("doc_id is not null")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"), "text").mapInArrow(_fingerprints, "doc_id long, key string, fp long")
    rows = scratch.save(rows, "rows")
    # a fingerprint has one best row; a component the best of its fingerprints
    best = rows.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "fp", "key")).alias("best"))
    component = F.coalesce("root", "fp")
    at, key, mine = fresh(docs, "_id", "_key", "_mine")
    kept = best.join(_roots(rows, scratch), "fp").groupBy(component.alias("component")).agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias(at), F.col("best.key").alias(key))
    out = known.withColumn(mine, _text_key()).join(kept, (F.col("doc_id") == F.col(at)) & (F.col(mine) == F.col(key)), "left_semi")
    return out.dropDuplicates(["doc_id", mine]).drop(mine).union(docs.where("doc_id is null"))
