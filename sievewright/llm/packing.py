"""Packing by power-of-two decomposition.

A document's token ids, closed by the separator, are cut into pieces of ``SEQ_LEN`` and then by the binary digits of
the rest, the longest first. Every piece is a sequence of its own: its length is a power of
two, so it needs no padding, and no sequence crosses documents. Equal lengths form a bucket;
sequence ids count a bucket's pieces without gaps above ``bucket << 48``.

Null text counts as empty (its one separator makes one piece), null and repeated doc_ids are kept, repeated rows
are packed again (each row is a document of its own), other columns are ignored, an empty table gives no pieces; texts of any length, white space
alone included, are packed whole, one text at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices

SEQ_LEN, SEPARATOR = 2048, 1
#: Entries that a worker's table of chunk ids holds before it starts anew.
CACHE = 400_000
#: Characters of one chunk that go through the ranks' recursive pattern; longer ones go through the tokenizer file.
CHUNK = 4096


class ByteBpe:
    """Ids of ``byte_bpe_50k.json`` as little-endian uint32 bytes.

    A text is cut before each single space between two other characters, where the vocabulary's
    pattern always begins a new chunk; ids of chunks met before are looked up. Chunks go
    through the ranks of the same vocabulary; texts that spell a special token go whole through the tokenizer file.
    """

    def __init__(self, directory: str | None = None):
        import base64
        import os

        import tiktoken
        from tokenizers import Tokenizer

        if directory is None:
            import public_tokenizers as tokens

            place, pattern = tokens.path, tokens.PATTERN
        else:
            from public_tokenizers import PATTERN as pattern

            place = lambda name: os.path.join(directory, name)
        self.whole = Tokenizer.from_file(place("byte_bpe_50k.json"))
        with open(place("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > CHUNK:  # the ranks' pattern overflows its stack on very long runs
            return self._pack(self.whole.encode(chunk, add_special_tokens=False).ids)
        return self._pack(self.ranks.encode_ordinary(chunk))

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        parts = text.split(" ")
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            return self._careful(parts)
        get, out = self.cache.get, []
        known = [get(p) for p in parts[1:]]
        if None in known:
            for i, k in enumerate(known):
                if k is None:
                    known[i] = self._learn(parts[i + 1])
        out = [self.__missing__(parts[0]), *known] if parts[0] else known
        return b"".join(out)

    def _learn(self, part: str) -> bytes:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        got = self.cache.get(part)
        if got is None:
            got = self.__missing__(" " + part)
            if len(part) <= 64:
                self.cache[part] = got
        return got

    def _careful(self, parts: list[str]) -> bytes:
        """Chunks end only where the space has a solid character on either side."""
        out, held = [], [parts[0]]
        for before, part in zip(parts, parts[1:], strict=False):
            if before and part and not before[-1].isspace() and not part[0].isspace():
                out.append(self._chunk(held, bool(out)))
                held = [part]
            else:
                held.append(part)
        out.append(self._chunk(held, bool(out)))
        return b"".join(out)

    def _chunk(self, held: list[str], spaced: bool) -> bytes:
        text = " ".join(held)
        return (self._learn(text) if spaced else self.__missing__(text)) if text or spaced else b""


def binary_lengths(n: int, most: int = SEQ_LEN) -> list[int]:
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


_bpe: dict[str | None, ByteBpe] = {}


def packer(directory: str | None, most: int, with_ids: bool):
    def run(batches):
        if directory not in _bpe:  # kept while the Python worker lives
            _bpe[directory] = ByteBpe(directory)
        encode = _bpe[directory]
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            for i, j in slices(texts, 4 << 20):
                rows, start, length, crc, total, each = [], [], [], [], [], []
                for k in range(i, j):
                    got = encode(texts[k]) + SEPARATOR.to_bytes(4, "little")
                    n, at = len(got) // 4, 0
                    for size in binary_lengths(n, most):
                        piece = got[4 * at:4 * (at + size)]
                        rows.append(k), start.append(at), length.append(size), total.append(n), crc.append(zlib.crc32(piece))
                        if with_ids:
                            each.append(np.frombuffer(piece, "<u4").astype(np.int32))
                        at += size
                arrays = [ids.take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(each, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return run


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizers: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids]."""
    if seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    scratch = Scratch(docs.sparkSession, "packing")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packer(tokenizers, seq_len, with_ids), schema)
    # numbered within their task, then written: ids that come later stay as they are if a task runs again
    task = F.monotonically_increasing_id()
    pieces = pieces.withColumn("_at", task).withColumn("_task", F.shiftright("_at", 33))
    pieces = scratch.save(pieces, "pieces")
    counts = pieces.groupBy("_task", "length").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    # a row for each task and each of at most 12 lengths
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_task")) - F.col("_n")
    counts = counts.select("_task", "length", before.alias("_before"))
    order = Window.partitionBy("_task", "length").orderBy("_at")
    numbered = pieces.withColumn("_nth", F.row_number().over(order) - 1).join(counts, ["_task", "length"])
    bucket = F.log2("length").cast("long")
    out = numbered.withColumn("sequence_id", F.shiftleft(bucket, 48) + F.col("_before") + F.col("_nth")).withColumn("offset", F.lit(0).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
