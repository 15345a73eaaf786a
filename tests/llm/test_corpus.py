"""Corpus operators against brute force, and their defined results at the edges."""

import base64
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
import xxhash


from sievewright.llm import covertree, gumbel, linedup, nbsvm, packing, recompression, simhash, warc, webp, wrappers
from sievewright.llm.common import Scratch

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x" for i in range(6000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
EDGE = [
    (1, "Alpha beta gamma. " + PASSAGE + " end one"), (2, PASSAGE), (3, None), (4, ""), (5, "   \n\t "), (6, LONG), (7, LONG + " tail"), (8, "Alpha beta gamma. " + PASSAGE + " end one"),
    (9, "the " * 200), (10, "the " * 180 + "cat"), (11, "naïve — 漢字 😀 " + PASSAGE), (8, "Alpha beta gamma. " + PASSAGE + " end one"), (12, "a  b c\nline two\nline two\n\nshort"), (13, "short\nline two"), (None, PASSAGE), (14, "ab ab " * 60 + PASSAGE), (15, "ab ab " * 70),
]
SCHEMA = "doc_id long, text string, score string, tk int, h int"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def cut_passages(docs, width):
    """(doc_id, words, whether each goes) by looking every window up."""
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p:p + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p:p + width])] < i:
                gone[p:p + width] = [True] * width
        out.append((i, w, gone))
    return out


def passages(docs, width):
    kept = [(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)) for i, w, gone in cut_passages(docs, width)]
    return sorted([(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in kept], key=repr)


def test_substring_dedup(spark, edge, empty):
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(recompression.dedup_digest(edge), *cols) == passages(EDGE, 50)
    assert recompression.dedup_digest(empty).count() == 0
    assert recompression.dedup_text(edge).columns == edge.columns


def test_substring_dedup_reads_the_words(spark):
    a = "a"
    for _ in range(11):  # Thue-Morse words: polynomial hashes modulo 2^64 do not tell them apart
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"q{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert rows(recompression.dedup_digest(df), "doc_id", "n_removed") == [(1, 0), (2, 0)]


def test_clashing_columns(spark):
    names = ["_id", "_tk", "_kept", "_run", "_lines", "_cut", "_key", "_mine", "_runs", "_text_key", "key", "fp"]
    docs = [(1, PASSAGE + "\nx\ny"), (2, "x\ny\n" + PASSAGE), (3, "x\ny"), (2, None)]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in docs], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for f in (linedup.dedup_text, recompression.dedup_text, simhash.keep_representatives):
        got = f(df)
        assert got.columns == df.columns
        assert {tuple(r)[2:] for r in got.collect()} == {tuple(range(len(names)))}


def test_windows_hold_their_keys():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 40, 70).astype(np.uint64)
    for _ in range(60):
        a, b = (np.concatenate((rng.integers(0, 40, rng.integers(0, 90)).astype(np.uint64), common, rng.integers(0, 3, rng.integers(0, 90)).astype(np.uint64))) for _ in range(2))
        known = []
        for x in (a, b):
            key, first, last, tier, tier_of = recompression.anchors(recompression.mix(x), np.zeros(len(x), int))
            h = recompression.window_hashes(recompression.mix(x), 50)
            known.append({tuple(h[p]): frozenset(k for k, f, z, t in zip(key.tolist(), first, last, tier) if f <= p <= z and t == tier_of[p]) for p in range(len(h))})
        for h in known[0].keys() & known[1].keys():
            assert known[0][h] and known[0][h] == known[1][h]


def fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_groups(fps):
    group = {f: {f} for f in fps}
    for a in group:
        for b in group:
            if bin(a ^ b).count("1") <= 3 and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    return group


def test_simhash(edge, empty):
    fps = [(i, fingerprint(t)) for i, t in EDGE]
    group = near_groups(f for _, f in fps)
    want = sorted([(i, f"{f:016x}", min((j for j, g in fps if g in group[f] and j is not None), default=None)) for i, f in fps], key=repr)
    assert rows(simhash.dedup_digest(edge), "doc_id", "fingerprint", "component_id") == want
    assert simhash.dedup_digest(empty).count() == 0
    kept = simhash.keep_representatives(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 8").count() == 0


def test_representatives_without_or_with_repeated_ids(spark):
    words = lambda k: " ".join(f"{k}w{i * i}" for i in range(40))
    docs = [(None, words(f"n{i}")) for i in range(20)] + [(None, words("n3")), (1, words("a")), (2, words("b")), (2, words("a")), (2, words("c")), (2, words("c")), (3, words("c")), (4, None), (5, "")]
    got = sorted(map(tuple, simhash.keep_representatives(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    want = docs[:21] + [(1, words("a")), (2, words("b")), (2, words("c")), (4, None)]
    assert got == sorted(want, key=repr)


def test_covering_and_crowded_buckets(spark):
    rng = np.random.default_rng(5)
    for _ in range(300):
        bits = rng.choice(64, 3, replace=False)
        diff = sum(1 << int(b) for b in bits)
        assert any(not m & diff for m in simhash.MASKS)
        t = next(i for i, m in enumerate(simhash.MASKS) if not m & diff)
        assert any(not m & diff for m in simhash.FINER[t])
    from sievewright.llm.common import Scratch, connected_components

    low = [int(x) for x in np.unique(rng.integers(0, 1 << 12, 600))]
    df = spark.createDataFrame([(x,) for x in low], "fp long")
    scratch = Scratch(spark, "test")
    got = dict(map(tuple, connected_components(simhash.linked(df, scratch, direct=20), scratch).collect()))
    assert set(got.values()) == {low[0]} and len(got) == len(low)


def solid_lines(text):
    return [(j, x) for j, x in enumerate((text or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]


def longest_earlier(docs):
    """(doc_id, text) -> for each solid line the most lines from it on that an earlier place has too."""
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    seqs = sorted({(i, t): [x for _, x in solid_lines(t)] for i, t in docs if i is not None and t}.items(), key=lambda kv: (kv[0][0], signed(kv[0][1])))
    places = [(k, p) for k, (_, s) in enumerate(seqs) for p in range(len(s))]
    out = {}
    for n, (k, p) in enumerate(places):
        best, s = 0, seqs[k][1]
        for m, q in places[:n]:
            r, size = seqs[m][1], 0
            while p + size < len(s) and q + size < len(r) and s[p + size] == r[q + size]:
                size += 1
            best = max(best, size)
        out.setdefault(seqs[k][0], []).append(best)
    return out


def brute_lines(docs, least):
    found, out = longest_earlier(docs), []
    for i, t in docs:
        runs = [(p, n) for p, n in enumerate(found.get((i, t), [])) if n >= least]
        gone = {q for p, n in runs for q in range(p, p + n)}
        places = {solid_lines(t)[q][0] for q in gone}
        kept = t if not gone else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in places)
        out.append((i, len(gone), max((n for _, n in runs), default=0), kept))
    return out


def test_line_dedup(spark, edge, empty):
    rng = np.random.default_rng(4)
    for n in (0, 2):
        docs = list(EDGE) if not n else []
        base = [f"line {rng.integers(0, 5 * n + 1)}" for _ in range(30)]
        for i in range(14 * bool(n)):  # ids in order; texts of one id would be ordered by hash
            a, z = sorted(rng.integers(0, 30, 2))
            docs.append((i, "\n".join([*(f"own {i}" for _ in range(rng.integers(0, 3))), *base[a:z], "", *(f"end {rng.integers(0, 3)}" for _ in range(2))])))
        df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in docs], "doc_id long, text string, _id int, _tk int, _run int, _cut int, tk int")
        for least in (1, 3) if n else (2,):
            want = brute_lines(docs, least)
            if not n:
                got = linedup.dedup_text(df, least)
                assert got.columns == df.columns
                assert rows(got, "doc_id", "text") == sorted([(i, t) for i, _, _, t in want], key=repr)
            digest = rows(linedup.dedup_digest(df, least), "doc_id", "n_removed", "longest_run", "kept_sha256")
            assert digest == sorted([(i, g, n, hashlib.sha256((t or "").encode()).hexdigest()) for i, g, n, t in want], key=repr)
    assert linedup.dedup_digest(empty).count() == 0


def test_line_dedup_repeated_rows_and_long_runs(spark):
    text = "\n".join(f"line {i}" for i in range(100))
    docs = [(1, text), (1, text), (2, text), (3, "x\n" + text), (4, "y\n" * 300), (5, "y\n" * 40 + "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(linedup.dedup_digest(df), "doc_id", "n_removed", "longest_run")
    assert got == [(1, 0, 0), (1, 0, 0), (2, 100, 100), (3, 100, 100), (4, 299, 299), (5, 40, 40)]


def test_packing(edge, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = packing.pack(edge.where("doc_id <> 8")).toPandas()
    for i, t in EDGE:
        if i in (None, 8):
            continue
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        for s, n, c in mine[["start", "length", "ids_crc32"]].itertuples(index=False):
            assert n & (n - 1) == 0 and n <= 2048 and c == zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    assert packing.pack(empty).count() == 0
    e = packing.ByteBpe()
    got = packing.pack(edge).groupBy("doc_id").agg({"length": "sum"}).toPandas().set_index("doc_id")
    ids = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert got.loc[8].item() == 2 * ids(EDGE[7][1]) and got[got.index.isna()].values.item() == ids(PASSAGE)  # repeated rows and a null id
    for x in [" " * 1_000_000, "\n" * 20_000 + "a", "x" * 30_000, " " + "y1" * 9_000 + " z", "a  b", "  a b ", "x \n y", "a  b c", "<|endoftext|> a b", "it's 's a 's", "", "  ", " ", "\ta b\n\n c", "a '　 'll b"]:
        assert np.frombuffer(e(x), "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids


def test_quality(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = nbsvm.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.held_out == (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2))).all()
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.9
    assert nbsvm.quality_scores(edge, labels).count() == len(EDGE)
    assert nbsvm.quality_scores(empty, labels).count() == 0
    none = labels.where("false")
    assert {r.score for r in nbsvm.quality_scores(edge, none).collect()} == {0.5}
    assert nbsvm.keep_good(edge, labels).columns == edge.columns


def test_webp(edge, empty):
    for k in (1, 2, 3, 60, 200, 256):
        for n in (64, 6400, webp.IMAGE_BYTES + 128):
            p = np.random.default_rng(k).integers(0, k, n).astype(np.uint8).tobytes()
            assert b"".join(x.tobytes() for x in webp.images(webp.encode(p))) == p
    got = webp.media_digest(edge).toPandas()
    for i, t in EDGE:
        raw = (t or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[got.doc_id.isna() if i is None else got.doc_id == i].iloc[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert webp.media_digest(empty).count() == 0


class Writer:
    """Bits for hand-made images."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]
        return self

    def one(self, symbol):
        return self.put(0b101, 3).put(symbol, 8)

    def two(self, a, b):
        return self.put(0b111, 3).put(a, 8).put(b, 8)

    def plain(self, g, r, b, a, main=False):
        """A small image of one colour."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        for x in (g, r, b, a, 0):
            self.one(x)
        return self

    def decode(self):
        return webp.decode_stream(np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes())


def head(w, h):
    return Writer().put(0x2F, 8).put(w - 1, 14).put(h - 1, 14).put(1, 1).put(0, 3)


def test_webp_transforms():
    green = head(4, 1).put(1, 1).put(2, 2).put(0, 1).plain(5, 1, 2, 255, main=True).decode()
    assert green[0, 0].tolist() == [5, 6, 7, 255]
    for mode, last in ((1, [9, 9, 9]), (2, [6, 6, 6]), (12, [12, 12, 12])):
        w = head(3, 3).put(1, 1).put(0, 2).put(0, 3).plain(mode, 0, 0, 0).put(0, 1)
        px = w.put(0, 1).put(0, 1).one(3).one(0).one(0).one(0).one(0).decode()
        grid = np.zeros((3, 3), int)
        for y in range(3):
            for x in range(3):
                p = 0 if x == y == 0 else grid[0, x - 1] if y == 0 else grid[y - 1, 0] if x == 0 else {1: grid[y, x - 1], 2: grid[y - 1, x], 12: np.clip(grid[y, x - 1] + grid[y - 1, x] - grid[y - 1, x - 1], 0, 255)}[mode]
                grid[y, x] = (3 + p) & 255
        assert px[..., 0].tolist() == grid.tolist() and (px[..., 3] == 255).all()
    # palette of two colours, eight pixels to a byte
    w = head(8, 1).put(1, 1).put(3, 2).put(1, 8).put(0, 1)
    w.two(10, 20).one(0).one(0).one(255).one(0).put(0, 1).put(1, 1).put(0, 1)
    px = w.plain(0b10100000, 0, 0, 255, main=True).decode()
    assert px[0, :, 0].tolist() == [10, 10, 10, 10, 10, 30, 10, 30]
    # cross colour: red gains green times 32/32
    px = head(2, 1).put(1, 1).put(1, 2).put(0, 3).plain(0, 0, 32, 255).put(0, 1).plain(7, 1, 2, 255, main=True).decode()
    assert px[0, 0].tolist() == [7, 8, 2, 255]


def test_webp_back_reference_and_cache():
    # green codes 65, 66 (literals), 256 + 3 (copy of four) and 280 + 1: lengths 2 each, by a length code over {0, 2}
    w = head(8, 1).put(0, 1).put(1, 1).put(1, 4).put(0, 1)
    g, r, b, a = 65, 0, 0, 255
    slot = (0x1E35A7BD * (a << 24 | r << 16 | g << 8 | b) & 0xFFFFFFFF) >> 31
    used = sorted([65, 66, 256 + 3, 280 + slot])
    w.put(0, 1).put(1, 4).put(0, 3).put(0, 3).put(1, 3).put(0, 3).put(1, 3).put(0, 1)
    for s in range(282):
        w.put(int(s in used), 1)
    w.one(0).one(0).one(255).one(0)  # distance code 1: the pixel a row up
    code = {s: i for i, s in enumerate(used)}
    for s in (65, 66, 280 + slot, 66):
        w.put(code[s] >> 1, 1).put(code[s] & 1, 1)
    w.put(code[259] >> 1, 1).put(code[259] & 1, 1)
    with pytest.raises(ValueError):
        w.decode()  # a row up from the first row
    w = head(1, 8).put(0, 1).put(1, 1).put(1, 4).put(0, 1)
    w.put(0, 1).put(1, 4).put(0, 3).put(0, 3).put(1, 3).put(0, 3).put(1, 3).put(0, 1)
    for s in range(282):
        w.put(int(s in used), 1)
    w.one(0).one(0).one(255).one(0)
    for s in (65, 66, 280 + slot, 66, 259):
        w.put(code[s] >> 1, 1).put(code[s] & 1, 1)
    assert w.decode()[:, 0, 0].tolist() == [65, 66, 65, 66, 66, 66, 66, 66]


def test_warc(spark, tmp_path):
    pages = [(1, "http://a.example/x", "<p>é</p>"), (2, "http://a.example/y", "same\r\n\r\nWARC/1.1"), (3, None, "same\r\n\r\nWARC/1.1"), (4, "u", None), (5, "u", ""), (6, "http://b.example", "z" * 300000), (2, "http://a.example/y", "same\r\n\r\nWARC/1.1"), (None, "n", "alone")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, sha int")
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        later = last[h or ""] > (-1 if i is None else i)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if later else "response", last[h or ""] if later else None))
    assert rows(warc.archive_digest(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.archive_digest(df.where("false")).count() == 0


def brute_links(vectors, cosine):
    ok = {i: np.asarray(v, float) / np.linalg.norm(v) for i, v in vectors if v is not None and len(v) and np.all(np.isfinite(np.array([np.nan if x is None else x for x in v], float))) and np.any(v)}
    near = {i: {j for j in ok if j != i and len(ok[j]) == len(ok[i]) and ok[i] @ ok[j] >= cosine} for i in ok}
    out = {}
    for i, _ in vectors:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(seen))
    return out


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    vectors = [(i, (base[i % 12] + rng.normal(size=16) * 0.18).tolist()) for i in range(150)]
    vectors += [(200, vectors[0][1]), (201, vectors[0][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, []), (206, [1.0, 2.0]), (208, [None, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, label int")
    want = brute_links(vectors, 0.9)
    assert sum(n for n, _ in want.values()) > 100
    for leaf, twigs in ((8192, 4), (20, 48)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(df, leaf=leaf, twigs=twigs).collect()}
        assert got == want
    again = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.01]), (None, None)], "vec_id long, embedding array<double>")
    got = rows(covertree.near_vectors(again), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 0, 1, True), (None, 2, 1, False), (None, 0, None, False)], key=repr)
    assert covertree.near_vectors(df.where("false")).count() == 0


def test_cover_tree_prunes():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    v = np.concatenate([c + rng.normal(size=(25, 12)) * w for c, w in zip(centres, np.tile([0.003, 0.05, 0.2, 0.4], 10), strict=True)])
    table = lambda x, at: pa.table({"cell": [0] * len(x), "salt": [0] * len(x), "rep": np.arange(at, at + len(x)), "n": np.arange(len(x)) % 3 + 1, "v": x.tolist()})
    one, two = (covertree.Block(covertree._grow(6)(table(x, at))) for x, at in ((v[::2], 0), (v[1::2], 10_000)))
    assert len(one.begin) > 60 and len(set(covertree.nested_nets(one.x, 60)[1])) > 2  # several halvings, more nodes for more rows
    for a, b in ((one, two), (one, one)):
        links, did = covertree.compare_blocks(a, b, 0.9)
        near = a.x @ b.x.T >= 0.9
        if a is b:
            np.fill_diagonal(near, False)
            assert (links.count[0] + links.count[1]).tolist() == (near @ b.n).tolist()
        else:
            assert links.count[0].tolist() == (near @ b.n).tolist() and links.count[1].tolist() == (near.T @ a.n).tolist()
        assert did["pruned"] > did["pairs"] / 2 and (a is b or did["unseen"] > 0 and did["whole"] > 0) and did["compared"] + did["whole"] + did["pruned"] == did["pairs"]


def test_html(spark):
    page = '<html><head><title>t</title></head><body><nav>menu</nav><div class="cookie-notice">ok?</div><article><h1>A &amp; B</h1><p>one<b> two</b>\n three<p>four<script>x</script></p><aside>side</aside><section class="comments"><p>me too</p></section></article><footer>f</footer>'
    assert read_host([page]) == ["A & B\none two three\nfour"]
    site = "<body><div class=top>Our site</div><div class=story><h2>{0}</h2><p>{1}</p><p>{2}</p></div><div class=end>Write to us</div></body>"
    pages = [(i, "http://h.example/1", site.format(f"T{i}", f"first text {i} " * 9, f"second {i * i} " * 7)) for i in range(6)] + [(7, None, None), (8, "http://x", ""), (9, "http://x", "<p>only<p>plain")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract_pages(df).collect()}
    assert got[2][0].split("\n") == ["T2", ("first text 2 " * 9).strip(), ("second 4 " * 7).strip()]
    assert got[7] == ("", 0) and got[8] == ("", 0) and got[9] == ("only\nplain", 10)
    # nesting beyond Python's calls, and many children of a period that does not fold
    deep = [(1, "http://d", "<div>" * 5000 + "far <b>down</b>" + "</div>" * 5000), (2, "http://d", "<p>x</p><h2>y</h2><ul><li>z</ul>" * 3000), (3, "http://d", "<p>x</p><h2>y</h2><ul><li>z</ul>" * 2999 + "<p>w")]
    got = {r.page_id: r.text for r in wrappers.extract_pages(spark.createDataFrame(deep, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[1] == "far down" and got[2] == "\n".join("xyz" * 3000) and got[3].endswith("z\nw")


def test_html_raw_tags():
    read = lambda page: read_host([page])[0]
    assert read('<body><svg width="9"/><article><p>one <math/>two</p><p>three</p></article>') == "one two\nthree"
    for tag in ("noscript", "canvas", "object", "select", "template"):
        assert read(f"<article><p>one</p><div><{tag}>away</div><p>two</p></article>") == "one\ntwo"
    assert read("<article><p>one</p><script>x</script><p>two</p><script>y") == "one\ntwo"


def test_html_apart_containers():
    for box in ('div class="layout has-sidebar"', 'div class="no-sidebar"', 'div class="sidebar"', 'div id="social-feed"', "form", "div hidden"):
        got = read_host([f'<body><{box}><article><p>one</p><div class="post-share">two</div><div class="share">no</div></article></{box.split()[0]}>'])
        assert got == (["one\ntwo"] if "hidden" not in box else [""])
    assert read_host(['<article><p>one</p><section class="comments"><article class="comment">no</article></section></article>']) == ["one"]


def read_host(pages):
    w = None
    for x in pages:
        e = wrappers.expression(wrappers.parse(x))
        w = e if w is None else wrappers.merge(w, e)
    return [wrappers.extract(x, wrappers.rules(w)) for x in pages]


def test_html_broken_markup_is_linear():
    for page in ("<a " * 100_000, "<a href='" * 100_001, '<a ">" ' * 100_000, "</i>" * 100_000, "<div>" * 3000 + "</zz>" * 100_000, "<x" + "'" * 99_999, "<svg>" * 50_000):
        wrappers.extract(page, {})
    assert read_host(['<p>one</p><p title="oops>two</p><p>three</p>']) == ["one\ntwo\nthree"]
    labels = [f"p{i * i % 97}" for i in range(30_000)], [f"p{i * i % 89}" for i in range(30_000)]
    assert len(wrappers.matches(*labels)) > 1000


def test_html_alignment_against_brute_force():
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abcde"), rng.integers(0, 7))) for _ in range(2))
        got = wrappers.matches(list(a), list(b))
        assert all(a[i] == b[j] for i, j in got) and all(p < r and q < t for (p, q), (r, t) in zip(got, got[1:]))
        if len(set(a)) == len(a) and len(set(b)) == len(b):  # labels that occur once: a longest common subsequence
            best = max(k for k in range(7) for c in itertools.combinations(a, k) if c in set(itertools.combinations(b, k)))
            assert len(got) == best


def untagged(i, rng):
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    links = "".join(f"<span><a href=/{k}>{words(1)}</a></span>" for k in range(6))
    paras = [words(30) for _ in range(3)]
    page = f"<body><div class=x1>House of text</div><div class=x2>{links}</div><div class=x3><h1>Title {i}</h1>" + "".join(f"<p>{p}</p>" for p in paras) + "</div><div class=x4>Write to us</div></body>"
    return page, "\n".join([f"Title {i}", *paras])


def test_html_copies_and_fixed_lines_of_articles(spark):
    rng = np.random.default_rng(11)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    frame = "<body><nav>{0}</nav><div class=top>House of text</div><article><h1>{1}</h1><p class=by>By Jane Doe</p>{2}<h3>Conclusion</h3><p>{3}</p></article><footer>Write to us</footer></body>"
    made = [(frame.format("home", f"Title {i}", f"<p>{words(30)}</p>", words(20)), i) for i in range(30)]
    odd = frame.format("home", "Odd one", f"<blockquote>{words(25)}</blockquote><pre>{words(9)}</pre>", words(20))
    read = lambda pages: {r.page_id: r.text for r in wrappers.extract_pages(spark.createDataFrame([(i, "http://c.example/x", p) for p, i in pages], "page_id long, url string, html string")).collect()}
    one, four = read([*made, (odd, 100)]), read([*made, *[(odd, 100 + k) for k in range(5)], *[made[3]] * 1])
    assert one[100] == four[100] == four[104] and [len(one[i].split("\n")) for i in (0, 29, 100)] == [5, 5, 6]
    assert all(one[i] == four[i] for i in range(30))  # copies of a page change no other page's text
    assert all(t.split("\n")[1] == "By Jane Doe" and "\nConclusion\n" in t and "House" not in t and "Write" not in t and "home" not in t for t in one.values())
    few = read(made[:3])
    assert all(few[i] == one[i] for i in range(3))  # however many pages a host has


def test_html_generated_class_names_keep_a_wrapper_small():
    rng = np.random.default_rng(12)
    name = lambda: "".join(rng.choice(list("abcdef0123456789"), 6)) + "4a"
    page = lambda i: f"<body><div class='css-{name()} box'><p class='{name()}'>text {i}</p></div><div class=x{name()}-q>Write</div></body>"
    sizes, w = [], None
    for i in range(400):
        e = wrappers.expression(wrappers.parse(page(i)))
        w = e if w is None else wrappers.merge(w, e)
        if i in (20, 399):
            sizes.append(len(json.dumps(w)))
    assert sizes[1] < sizes[0] + 40


def test_html_without_telling_names(spark):
    rng = np.random.default_rng(1)
    made = [untagged(i, rng) for i in range(40)]
    pages, want = [p for p, _ in made], [t for _, t in made]
    assert read_host(pages) == want
    assert all(wrappers.extract(p, {}) != t for p, t in made)  # without the wrapper the template stays
    df = spark.createDataFrame([(i, "http://u.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    one, two = (wrappers.infer(x, Scratch(spark, "test"), 7, 3).collect() for x in (df.repartition(1), df.repartition(7, "page_id")))
    assert one == two and len(one) == 1 and [wrappers.extract(p, json.loads(one[0].rules)) for p in pages] == want
    assert [t for _, t in rows(wrappers.extract_pages(df), "page_id", "text")] == [t for _, t in sorted(enumerate(want), key=repr)]
    assert wrappers.extract_pages(df.where("false")).count() == 0


def test_html_names_are_overruled():
    rng = np.random.default_rng(2)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    card = lambda: f"<article class=card><a href=/>{words(4)}</a> <a href=/>{words(3)}</a></article>"
    texts = [words(60) for _ in range(8)]
    got = read_host([f"<body><article class=story><p>{t}</p></article><div>{card()}{card()}{card()}</div></body>" for t in texts])
    assert got == texts  # cards of links are articles by name only
    got = read_host([f"<body><form><div class=box><p>{t}</p></div></form></body>" for t in texts])
    assert got == texts  # a form around everything
    got = read_host([f"<body><article><p>{t}</p></article><div class=comments><p>{words(200)}</p></div></body>" for t in texts])
    assert got == texts  # comments longer than the text
    got = read_host([f"<body><main>{words(2)}</main><div class=box><p>{t}</p></div></body>" for t in texts])
    assert all(g.endswith(t) for g, t in zip(got, texts))  # a main item that holds next to nothing


def test_html_layouts_without_main_items():
    post = "<body><div class=top>Our site</div><h1>Title {0}</h1><div class=post><p>{1}</p></div></body>"
    other = "<body><div class=top>Our site</div><div class=longread><h2>Long {0}</h2><p>{1}</p></div></body>"
    pages = [post.format(i, f"text {i} " * 200) for i in range(20)] + [other.format(i, f"told {i} " * 9) for i in range(3)]
    got = read_host(pages)
    assert got[3] == "Title 3\n" + ("text 3 " * 200).strip()
    assert got[21] == "Long 1\n" + ("told 1 " * 9).strip()
    box = "<body><div class=social><p>{0}</p></div><p>{1}</p></body>"  # an apart word over most of the text
    assert read_host([box.format(f"word {i} " * 50, f"end {i}") for i in range(5)])[2] == ("word 2 " * 50).strip() + "\nend 2"


def test_html_template_beside_and_within_main_items():
    plain = "<body><div class=top>Our site</div><div class=post><p>text {0}</p></div></body>"
    main = "<body><div class=top>Our site</div><article><p>text {0} of some length</p><div class=hint>Send us mail</div></article></body>"
    got = read_host([plain.format(i) for i in range(6)] + [main.format(i) for i in range(6)])
    assert got[2] == "text 2" and got[8] == "text 2 of some length"
    same = main.format("the same")  # copies of a page keep their text
    assert read_host([same] * 5) == ["text the same of some length\nSend us mail"] * 5


def test_gumbel(spark, edge, empty):
    import itertools
    from collections import Counter

    from public_tokenizers import path

    v = gumbel.Vocabulary(path("piece_bpe_32k.model"))
    store = gumbel.Store(v, 0.5)
    text, n = "the end", 6000
    normal = v.sp.normalize([text])[0]

    def every(s):
        return [[]] if not s else [[v.pieces[s[:k]], *r] for k in range(1, len(s) + 1) if s[:k] in v.pieces for r in every(s[k:])]

    segs = [tuple(sum(x, [])) for x in itertools.product(*[every(c) for c in gumbel._CHUNK.findall(normal)])]
    w = np.array([0.5 * v.weight[list(s)].sum() for s in segs])
    p = np.exp(w - np.logaddexp.reduce(w))
    found = [f for _, f in gumbel.segment([text] * n, np.arange(n), store, 3, 1)]
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    second = Counter(tuple(f[1][0].tolist()) for f in found)
    for i, s in enumerate(segs):
        if p[i] > 0.02:
            assert abs(first[s] / n - p[i]) < 0.025
            q = sum(p[i] * p[j] / (1 - p[j]) for j in range(len(p)) if j != i)
            assert abs(second[s] / n - q) < 0.03
    assert all(len({tuple(x[0].tolist()) for x in f}) == 3 and f[0][2] >= f[1][2] >= f[2][2] for f in found)
    assert abs(np.mean([sum(np.exp(x[1]) / x[3] for x in f) for f in found]) - 1) < 0.03  # inclusion weights are unbiased
    a, b = (rows(gumbel.sample_segmentations(df, with_ids=True), "doc_id", "sample", "ids_crc32", "exact") for df in (edge, edge.repartition(5)))
    assert a == b and sum(not r[3] for r in a) == 0
    assert gumbel.sample_segmentations(empty).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)


def plain_pipeline(docs, model):
    """(doc_id, start, length, ids_crc32, doc_tokens) of the pieces, each stage by brute force."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    features = nbsvm.Indicators()
    docs = [(i, t) for i, t in docs if model.score(features((t or "").encode())) >= 0.7]
    docs = [(i, t) for i, _, _, t in brute_lines(docs, linedup.MIN_LINES)]
    rows_ = [(i, int(np.uint64(fingerprint(t)).astype(np.int64)), hashlib.sha256(t.encode()).hexdigest() if t is not None else "", t) for i, t in docs]
    group = near_groups(np.int64(f).astype(np.uint64).item() for _, f, _, _ in rows_)
    best = {}
    for r in rows_:
        if r[0] is not None:
            g = min(group[np.int64(r[1]).astype(np.uint64).item()])
            best[g] = min(best.get(g, r[:3]), r[:3])
    kept = set(best.values())
    docs = [r for r in rows_ if r[0] is None] + list({r[:3]: r for r in rows_ if r[:3] in kept}.values())
    docs = [(i, t) for i, _, _, t in docs]
    cut = cut_passages(docs, recompression.WINDOW)
    docs = [(i, " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t) for (i, t), (_, w, gone) in zip(docs, cut)]
    tok, out = Tokenizer.from_file(path("byte_bpe_50k.json")), []
    for i, t in docs:
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [1], 0
        for n in [2048] * (len(ids) // 2048) + [1 << k for k in range(10, -1, -1) if len(ids) % 2048 >> k & 1]:
            out.append((i, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), len(ids)))
            at += n
    return sorted(out, key=repr)


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    given = [tuple(r) for r in docs] + [(None if i is None else 10_000 + i, t) for i, t in EDGE] + [tuple(docs[3]), (20_000, docs[3].text), (20_001, docs[5].text + " and one more"), (None, docs[7].text), (20_002, docs[9].text + "\n" + docs[11].text)]
    frame = spark.createDataFrame([(i, t, "xx", "s", len(t or ""), 5, 6) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long, _id int, _run int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    labels.union(labels.limit(3)).union(spark.createDataFrame([(None, 1, 0), (10_006, 1, 0), (10_011, 1, None)], labels.schema)).write.parquet(f"{tmp_path}/labels.parquet")
    model = nbsvm.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = rows(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    want = plain_pipeline(given, model)
    assert len({r[0] for r in want}) > 100 and got == want
    frame.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_model_against_dense_forms():
    texts = [t.encode() for t in ("good words here", "good words there", "fine good text", "bad BAD!! 000", "000 !! bad", "bad bad bad", "", "naïve — 漢字")]
    y = np.array([1, 1, 1, 0, 0, 0, 0, 1.0])
    kind = lambda c: 0 if c == 32 or 9 <= c <= 13 else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c < 128 else 5

    def plain(text):
        b, out = b" " + text + b" ", set()
        for k in range(len(b) - 2):
            out.add(b[k] | b[k + 1] << 8 | b[k + 2] << 16)
        shape = [k for k, _ in __import__("itertools").groupby(map(kind, b))]
        for k in range(max(1, len(shape) - 5)):
            out.add(sum(s << 3 * j for j, s in enumerate(shape[k:k + 6])) | 1 << 25)
        words = text.split()
        n = len(words)
        out.add(1 << 26 | min(15, n.bit_length()) << 8 | (20 * len(set(words)) // n if n else 0))
        out.add(1 << 27 | any(p == q for p, q in zip(words, words[1:])))
        return {c * 2654435761 % (1 << 32) >> 15 for c in out}

    f = nbsvm.Indicators()
    found = [f(t) for t in texts]
    assert [set(x.tolist()) for x in found] == [plain(t) for t in texts] and all(len(set(x.tolist())) == len(x) for x in found)
    model = nbsvm.fit(found, y)
    dense = np.zeros((len(texts), nbsvm.BUCKETS))
    for i, x in enumerate(found):
        dense[i, x] = 1
    p, q = 1 + dense[y == 1].sum(0), 1 + dense[y == 0].sum(0)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    x = dense * ratio / np.sqrt(dense.sum(1, keepdims=True))
    s = 2 * y - 1
    cost = np.where(y > 0, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (1 - y).sum())
    w = np.divide(model.weights, ratio, out=np.zeros_like(ratio), where=ratio != 0)
    slack = np.maximum(0, 1 - s * (x @ w + model.bias))
    # the optimum of 0.5 |w|^2 + 0.5 b^2 + sum of cost * slack^2
    assert np.abs(w - 2 * (cost * s * slack) @ x).max() < 1e-2 and abs(model.bias - 2 * (cost * s * slack).sum()) < 1e-2
    for t, d, row in zip(texts, x, found):
        assert abs(model.score(row) - 1 / (1 + np.exp(-(model.slope * (d @ w + model.bias) + model.offset)))) < 1e-9
