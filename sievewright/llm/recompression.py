"""Substring dedup by recompression.

Each document's word sequence is rewritten in rounds.  A round first names every maximal
run of one symbol, then names every adjacent pair whose left symbol drew "left" and whose
right symbol drew "right".  Names are hashes of what they stand for, so every executor gives
equal substrings equal interior symbols without talking to the others.  Each symbol carries
the *dependency interval* of words that fixes its existence; wherever those words stand,
the symbol stands too.  A window of ``WINDOW`` words is known by the symbols whose
dependency intervals it holds; the few windows that hold none stand for themselves.  Spark
then joins equal symbols across documents, and the windows all of whose symbols are
shared are verified by a 128-bit BLAKE2b digest of their words; symbols' names are hashes that only choose candidates.

Null text counts as empty, a null ``doc_id`` row is passed through untouched (it is neither a
source nor a target), rows that repeat a ``doc_id`` are treated as parts of that document
("smaller doc_id" never holds between them), equal rows give equal rows, an empty table gives none; texts are read whole,
``SLICE_BYTES`` of them at a time or one longer text; other columns are kept by ``dedup_text``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, fresh, slices

WINDOW = 50
#: Rounds after which symbols serve as anchors, the coarsest first.
LEVELS = (5, 4, 3, 2)
#: Rounds that name runs before they name pairs.
RUN_ROUNDS = (1, 4)
#: Bytes that one call of the array code takes at most, unless one text is longer.
SLICE_BYTES = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _ODD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def word_table(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of ``raw`` (``[^\\x20\\x09-\\x0D]+``)."""
    b = np.frombuffer(raw, np.uint8)
    solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    lens = end - start
    longest = int(lens.max())
    inside = np.arange(len(b), dtype=np.int32)
    inside[start[0]:] -= np.repeat(start.astype(np.int32), np.diff(np.append(start, len(b))))
    np.minimum(inside, longest, out=inside)
    value = _BYTE[b]
    value *= powers(0xD6E8FEB86659FD93, longest + 1)[inside]
    value[~solid] = 0
    total = np.add.reduceat(value, start)
    return start, end, mix(total ^ lens.astype(np.uint64))


def window_hashes(names: np.ndarray, width: int) -> np.ndarray:
    """Two 64-bit lanes, one row for each run of ``width`` names: shape (n - width + 1, 2)."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros((0, 2), np.uint64)
    out = np.empty((n, 2), np.uint64)
    for lane, base in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        x = mix(names ^ np.uint64(base))
        # Horner by doubling: h[i] covers `have` names from i on
        acc, pos, have, h = None, 0, 1, x
        mult = pow(base | 1, 1, 1 << 64)
        left = width
        while left:
            if left & 1:
                part = h[pos:pos + n]
                acc = part.copy() if acc is None else acc * np.uint64(mult) + part
                pos += have
            left >>= 1
            if left:
                h = h[:-have] * np.uint64(mult) + h[have:]
                mult = mult * mult & (1 << 64) - 1
                have *= 2
        out[:, lane] = mix(acc)
    return out


def recompress(names: np.ndarray, doc: np.ndarray, levels: tuple[int, ...], run_rounds: tuple[int, ...] = RUN_ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of ``levels`` (rounds): name, dependency start and dependency end of the symbols.

    ``doc`` numbers the document of each word; nothing is joined across documents, and a symbol
    that depends on a document's edge depends on a word outside of it.
    """
    out, n = {}, len(names)
    name, lo, hi, d = names, np.arange(n), np.arange(1, n + 1), doc
    for r in range(1, max(levels) + 1):
        salt = np.uint64(2 * r)
        if r in run_rounds and len(name) > 1:
            differ = (name[1:] != name[:-1]) | (d[1:] != d[:-1])
            first = np.flatnonzero(np.concatenate(([True], differ)))
            last = np.append(first[1:], len(name)) - 1
            size = last - first + 1
            # that a run ends here hangs on both neighbours; at a document's edge on a word outside of it
            edge = d[1:] != d[:-1]
            to_left = np.concatenate(([lo[0] - 1], np.where(edge, lo[1:] - 1, lo[:-1])))[first]
            to_right = np.concatenate((np.where(edge, hi[:-1] + 1, hi[1:]), [hi[-1] + 1]))[last]
            run = size > 1
            name = name[first]
            name[run] = mix(name[run] + mix(size[run].astype(np.uint64) ^ (salt << np.uint64(32))))
            d, lo, hi = d[first], to_left, to_right
        left = (mix(name ^ (salt + np.uint64(1))) & np.uint64(1)).astype(bool)
        adj = d[1:] == d[:-1]
        join = left[:-1] & ~left[1:] & adj
        at = np.flatnonzero(join)
        new_lo, new_hi = lo.copy(), hi.copy()
        # unpaired: a left symbol hangs on the one after it, a right symbol on the one before it
        right_of = np.concatenate((np.where(adj, hi[1:], hi[:-1] + 1), hi[-1:] + 1))
        left_of = np.concatenate((lo[:1] - 1, np.where(adj, lo[:-1], lo[1:] - 1)))
        np.copyto(new_hi, right_of, where=left)
        np.copyto(new_lo, left_of, where=~left)
        new_lo[at], new_hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        np.minimum(new_lo, lo, out=new_lo)
        np.maximum(new_hi, hi, out=new_hi)
        new_name = name.copy()
        new_name[at] = mix(name[at] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(name[at + 1] ^ salt))
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, lo, hi, d = new_name[keep], new_lo[keep], new_hi[keep], d[keep]
        if r in levels:
            out[r] = (mix(name ^ np.uint64(r)), lo, hi)
    return [out[r] for r in levels]


def anchors(names: np.ndarray, doc: np.ndarray, levels: tuple[int, ...] = LEVELS, width: int = WINDOW):
    """Keys by which every window of ``width`` words is known: key, first and last window start, tier; tier of each window.

    Windows are numbered by their first word. A key stands for the windows of its own tier between first and
    last; equal windows have one tier and the same keys at the same offsets.
    """
    n = len(names)
    tier_of = np.full(n, -1, np.int8)
    if n < width:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, tier_of
    edge = np.flatnonzero(np.diff(doc)) + 1
    size = np.diff(np.concatenate(([0], edge, [n])))
    start = np.repeat(np.concatenate(([0], edge)), size)
    stop = np.repeat(np.append(edge, n), size)
    open_ = np.arange(n) + width <= stop  # windows not reached yet
    keys, first, last, tiers, tier = [], [], [], [], 0
    for name, lo, hi in recompress(names, doc, levels):
        at = np.clip(lo, 0, n - 1)
        ok = (hi - lo <= width) & (lo >= start[at]) & (hi <= stop[at])
        name, lo, hi = name[ok], lo[ok], hi[ok]
        a, z = np.maximum(hi - width, start[lo]), np.minimum(lo, stop[lo] - width)
        rank = mix(name ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(62)
        for among in (rank == 0, rank == 1, rank >= 2):  # a few symbols first, more where those leave windows
            among &= a <= z
            total = np.concatenate(([0], np.cumsum(open_)))
            some = np.flatnonzero(among)
            some = some[total[z[some] + 1] > total[a[some]]]
            keys.append(name[some]), first.append(a[some]), last.append(z[some]), tiers.append(np.full(len(some), tier))
            new = open_ & _held(a[some], z[some], n)
            tier_of[new] = tier
            open_ &= ~new
            tier += 1
    rest = np.flatnonzero(open_)
    tier_of[rest] = tier
    keys.append(window_hashes(names, width)[rest, 0]), first.append(rest), last.append(rest), tiers.append(np.full(len(rest), tier))
    return np.concatenate(keys), np.concatenate(first), np.concatenate(last), np.concatenate(tiers), tier_of


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, and start, end, hash and text number of its words."""
    raw = b"\n".join(texts)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    start, end, names = word_table(raw)
    return raw, start, end, names, np.searchsorted(begin, start, side="right") - 1


def _long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


def _scan(batches, width: int = WINDOW):
    """doc_id, text -> tk, counts, digest of the unchanged words, and anchor keys."""
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for i, j in slices(texts, SLICE_BYTES):
            _, _, _, names, doc = _joined(texts[i:j])
            n = np.bincount(doc, minlength=j - i)
            key, first, *_ = anchors(names, doc, width=width)
            owner = doc[first] if len(first) else np.zeros(0, np.int64)
            order = np.argsort(owner, kind="stable")
            sizes = np.bincount(owner, minlength=j - i)
            digest = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts[i:j]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i:j], batch.column("tk")[i:j], pa.array(n), pa.array(digest), _lists(_long(key[order]), sizes)],
                names=["doc_id", "tk", "n_words", "sha", "keys"],
            )


def _windows(batches, width: int = WINDOW):
    """Hashes of each text's windows all of whose keys are among its ``shared`` keys."""
    for batch in batches:
        texts, shared = as_bytes(batch.column("text")), batch.column("shared")
        doc_id, tk = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("tk").to_numpy(zero_copy_only=False)
        for i, j in slices(texts, SLICE_BYTES):
            _, _, _, names, doc = _joined(texts[i:j])
            base = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=j - i))))
            key, first, last, tier, tier_of = anchors(names, doc, width=width)
            part = shared.slice(i, j - i)
            known = part.flatten().to_numpy()
            # a key counts as shared by its own document's list
            owner = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
            mine = np.isin(mix(_long(key).view(np.uint64) ^ doc[first].astype(np.uint64)), mix(known.view(np.uint64) ^ owner.astype(np.uint64)))
            found = np.zeros(len(names), bool)
            for t in np.unique(tier[mine]):
                yes, no = (tier == t) & mine, (tier == t) & ~mine
                found |= (tier_of == t) & _held(first[yes], last[yes], len(names)) & ~_held(first[no], last[no], len(names))
            at = np.flatnonzero(found)
            h, owner = window_digests(texts[i:j], base, at, doc[at], width), doc[at] + i
            yield pa.RecordBatch.from_arrays(
                [pa.array(_long(h[:, 0])), pa.array(_long(h[:, 1])), pa.array(doc_id[owner].astype(np.int64)), pa.array(tk[owner].astype(np.int64)), pa.array((at - base[doc[at]]).astype(np.int32))],
                names=["h1", "h2", "doc_id", "tk", "p"],
            )


def window_digests(texts: list[bytes], base: np.ndarray, at: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Two 64-bit halves of a digest of the words of each window; ``at`` numbers its first word among all texts, ``doc`` its text (rising)."""
    out = np.empty((len(at), 2), np.uint64)
    cut = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
    for a, z in zip(cut, cut[1:]):
        words = texts[doc[a]].split()
        flat = b" ".join(words)
        stop = np.cumsum([len(w) + 1 for w in words])
        first = at[a:z] - base[doc[a]]
        begin, end = np.where(first > 0, stop[first - 1], 0).tolist(), (stop[first + width - 1] - 1).tolist()
        digest = b"".join([hashlib.blake2b(flat[s:e], digest_size=16).digest() for s, e in zip(begin, end, strict=True)])
        out[a:z] = np.frombuffer(digest, np.uint64).reshape(-1, 2)
    return out


def _held(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))[:n] > 0


def _cut(batches, width: int = WINDOW):
    """Texts without the words that the windows starting at ``starts`` cover."""
    for batch in batches:
        out = {k: [] for k in ("n_removed", "kept")}
        for t, starts in zip(as_bytes(batch.column("text")), batch.column("starts").to_pylist(), strict=True):
            words = t.split()
            mark = np.zeros(len(words) + 1, np.int64)
            starts = np.unique(np.asarray(starts, np.int64))
            mark[starts] += 1
            np.subtract.at(mark, starts + width, 1)
            gone = np.cumsum(mark)[:-1] > 0
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tk"), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.binary()).cast(pa.string())],
            names=["doc_id", "tk", "n_removed", "kept"],
        )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tk (a hash of the text: rows that repeat a doc_id stay apart), text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def repeated_words(docs: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows: doc_id, tk, n_words, sha; changed rows: doc_id, tk, n_removed, kept)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "recompression")
    rows = keyed(docs)
    scan = scratch.save(rows.mapInArrow(_scan, "doc_id long, tk long, n_words long, sha string, keys array<long>"), "scan")
    # a document whose whole word sequence starts a smaller document goes whole, and is no source that the smaller one isn't
    first = scan.where(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("sha", "m")
    first = scratch.save(first, "first")  # written, so that the join deals both sides anew and a crowded text's partition can be split
    copies = scan.select("doc_id", "tk", "sha", "n_words").join(first, "sha").where("doc_id > m").select("doc_id", "tk", F.col("n_words").alias("n_removed"))
    copies = scratch.save(copies.dropDuplicates(["doc_id", "tk"]), "copies")
    each = scan.select("doc_id", "tk", "keys").join(copies, ["doc_id", "tk"], "left_anti").where("doc_id is not null").select("doc_id", "tk", F.explode("keys").alias("key"))
    # written, so that both sides of the joins below are dealt anew and a hot key's partition can be split
    shared = scratch.save(each.groupBy("key").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("key"), "shared")
    found = each.join(shared, "key").groupBy("doc_id", "tk").agg(F.collect_set("key").alias("shared"))
    near = rows.join(found, ["doc_id", "tk"])  # copies have no keys here
    windows = scratch.save(near.mapInArrow(_windows, "h1 long, h2 long, doc_id long, tk long, p int"), "windows")
    del near, found
    source = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("h1", "h2", "m")
    source = scratch.save(source, "source")
    later = windows.join(source, ["h1", "h2"]).where("doc_id > m")
    starts = scratch.save(later.groupBy("doc_id", "tk").agg(F.collect_set("p").alias("starts")), "starts")
    del later
    for name in ("shared", "windows", "source"):
        scratch.drop(name)
    changed = scratch.save(rows.join(starts, ["doc_id", "tk"]).mapInArrow(_cut, "doc_id long, tk long, n_removed long, kept string"), "changed")
    changed = changed.dropDuplicates(["doc_id", "tk"]).union(copies.select("doc_id", "tk", "n_removed", F.lit("").alias("kept")))
    return scan.select("doc_id", "tk", "n_words", "sha"), changed


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of ``docs``."""
    every, changed = repeated_words(docs)
    return every.join(changed, ["doc_id", "tk"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.when(F.col("n_removed").isNull(), F.col("sha")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"),
    )


def dedup_text(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; rows without one keep their text as it is."""
    _, changed = repeated_words(docs)
    tk = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    a, b, c = fresh(docs, "_id", "_tk", "_kept")
    found = changed.select(F.col("doc_id").alias(a), F.col("tk").alias(b), F.col("kept").alias(c))
    out = docs.join(found, (F.col("doc_id") == F.col(a)) & (tk == F.col(b)), "left")
    return out.withColumn("text", F.coalesce(c, "text")).drop(a, b, c)
