"""Small cases that the third round's review found wrong or unbounded."""

import numpy as np

from sievewright.operators import embedding


def test_words_that_cancel_still_have_length_one():
    got = embedding.HashingEmbedder()(["steel w45", "steel steel w45", "", "...", "w45 steel steel w45"])  # one column, opposite signs
    assert np.allclose(np.linalg.norm(got, axis=1), [1, 1, 0, 0, 1])


class Handle:
    """A state handle in memory that counts its timers."""

    class State(list):
        def __init__(self):
            super().__init__()
            self.reads = 0

        def exists(self):
            return bool(self)

        def get(self):
            self.reads += len(self)
            return list(self)

        def put(self, rows):
            self[:] = rows

        def clear(self):
            self[:] = []

    class Value:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    def __init__(self):
        self.timers, self.made = set(), 0

    def getListState(self, name, schema):
        return self.State()

    def getValueState(self, name, schema):
        return self.Value()

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)
        self.made += 1

    def deleteTimer(self, at):
        self.timers.discard(at)


class Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return min(self.watermark, self.at)


def test_a_key_has_one_timer_and_settles_in_one_reading():
    import pandas as pd

    from sievewright.streaming.labels import History

    handle, history, n = Handle(), History(10), 500
    history.init(handle)
    frame = pd.DataFrame({"seq": range(n), "at": [i * 5 for i in range(n)], "label": ["a"] * n})
    list(history.handleInputRows(("k",), iter([frame]), Times(0)))
    assert len(handle.timers) == 1
    now = Times(5 * (n // 2))
    while due := [t for t in handle.timers if t <= now.watermark]:
        now.at = due[0]
        handle.timers.discard(due[0])
        list(history.handleExpiredTimer(("k",), now, now))
    left = [i for i in range(n) if i * 5 + 10 > now.watermark]
    assert [r[0] for r in history.rows] == left and len(history.stack) == n - len(left) and len(handle.timers) == 1
    assert handle.made <= 3 and history.rows.reads <= 2 * n


def test_factors_of_repeated_ids_empty_and_foreign_texts(spark):
    texts = ["steel steel river", "river stone", "", None, "the of", "steel river stone", "stone"]
    rows = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)], "doc_id long, text string")  # id 0 twice
    got = [r.factors for r in embedding.tfidf_factors(rows, 2).orderBy("doc_id", "factors").collect()]
    names, words = ["river", "steel", "stone"], [[w for w in (t or "").split() if w not in embedding.STOP] for t in texts]
    counts = np.array([[w.count(t) for t in names] for w in words], float)
    x = counts * (np.log(8 / (1 + (counts > 0).sum(0))) + 1)
    x = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=counts.any(1, keepdims=True))
    u, s, _ = np.linalg.svd(x)
    assert np.allclose(sorted(np.abs(np.array(got)[:, 0])), sorted(np.abs(u[:, 0] * s[0])), atol=1e-6)


def test_models_that_share_cells_move_neither_blocks_nor_counts_twice(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sievewright.operators import manymodels

    rng = np.random.default_rng(2)
    rows = [(f"c{i % 3}", i, int(rng.random() < 0.4), [float(rng.normal()), None if i % 4 else float(i)]) for i in range(90)]
    packed = manymodels.blocks(spark.createDataFrame(rows, "cell string, id long, y int, x array<double>"))
    train = spark.createDataFrame([(m, c) for m in ("a", "b") for c in ("c0", "c1")] + [("d", "c2")], "model string, cell string")
    models = train.select("model", F.lit(1.0).alias("c"), F.lit(None).cast("array<int>").alias("cols")).distinct()
    counted = []
    plain = manymodels.running_counts
    monkeypatch.setattr(manymodels, "running_counts", lambda cells, by, *a: counted.append(cells.select(by[0]).distinct().count()) or plain(cells, by, *a))
    state = manymodels.fit(packed, models, train)
    assert counted == [2]  # a and b learn from the same cells
    got = manymodels.scores(packed, state, train)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    wide = {r.model: r.middle[1] for r in state.collect()}
    assert wide["a"] == wide["b"] == np.median([i for i in range(0, 90, 4) if i % 3 < 2]) and got.count() == 150
    monkeypatch.setattr(manymodels, "SHARED_BYTES", 0)
    again = manymodels.scores(packed, manymodels.fit(packed, models, train), train)
    assert {(r.model, r.id): round(r.score, 9) for r in again.collect()} == {(r.model, r.id): round(r.score, 9) for r in got.collect()}


def test_texts_leave_the_reader_in_small_batches():
    import pyarrow as pa

    from sievewright.operators import lexblock

    rows = pa.record_batch({"paper_id": list(range(600)), "silo": ["a", "b"] * 300, "text": ["steel river steel", None, "red stone"] * 200})
    got = list(lexblock._reader({"a": (["steel"], [["red stone"]]), "b": (["river", "steel"], [["red"], ["steel river"]])}, ["paper_id"])([rows]))
    assert max(b.num_rows for b in got) <= 256 and sum(b.num_rows for b in got) == 600
    assert got[0].slice(0, 4).to_pylist() == [
        {"paper_id": 0, "n": 3, "terms": [{"id": 0, "f": 2}], "hits": [0]}, {"paper_id": 1, "n": 0, "terms": [], "hits": [0, 0]},
        {"paper_id": 2, "n": 2, "terms": [], "hits": [1]}, {"paper_id": 3, "n": 3, "terms": [{"id": 0, "f": 1}, {"id": 1, "f": 2}], "hits": [0, 1]},
    ]


def test_query_metrics_by_blocks_equal_the_plans(spark, monkeypatch):
    from sievewright import queries  # noqa: F401  registers the plans
    from sievewright.operators import queried
    from sievewright.plans.catalogue import CATALOGUE

    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(1, 320)]  # ties, some zero vectors
    rows += [(1000, None, [1.0, 0.0, 2.0, 1.0]), (1001, None, [1.0, 1.0, 0.0, 0.0]), (1002, 1, None), (1003, 1, [1.0, None, 1.0, 1.0]), (1004, 2, [1.0, 2.0]), (1100, 0, [0.0] * 4), (1200, 0, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    known = spark.createDataFrame([(r[0], None if r[0] % 17 == 3 else int(r[0] % 5 > 1)) for r in rows if r[0] % 7], "doc_id long, quality int")
    tables = {"embeddings": vectors, "labels": known}
    monkeypatch.setattr(queried, "ROWS", 50)
    monkeypatch.setattr(queried, "PART", 100)
    for name, run, y in (("brief_transfer_auc", queried.transfer_auc, queried.F.col("quality")), ("retrieval_metrics", queried.retrieval, 1 - queried.F.col("quality"))):
        got = run(vectors, known.select(queried.F.col("doc_id").alias("vec_id"), y.alias("y")))
        assert "ArrowPython" in got._jdf.queryExecution().toString() or "MapInArrow" in got._jdf.queryExecution().toString()
        key = lambda r: tuple((x is not None, x) for x in r)
        want = CATALOGUE.run(spark, name, tables.__getitem__).select(*got.columns)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and got.count() > 3


def test_papers_are_taken_apart_once(spark):
    from sievewright import queries  # noqa: F401  registers the plans
    from sievewright.plans.catalogue import CATALOGUE

    docs = spark.createDataFrame([(i, f"glass houses pass the berries term{i % 3}\nred stone", "src1", "en", 9) for i in range(6)] + [(7, None, "src1", "en", 0)], "doc_id long, text string, source string, lang string, n_chars long")
    items = spark.createDataFrame([(1, "glass houses red stone term1 never once")], "item_id long, text string")
    run = lambda name: CATALOGUE.run(spark, name, {"documents": docs, "benchmark": items}.__getitem__)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    hits = run("phrase_match")
    assert "Generate explode(transform(listed" in plan(hits)  # a list beside each paper
    got = {(r.field, r.term): r.hit for r in hits.where("paper_id = 1").collect()}
    assert got["must", "glass"] and got["pair", "glass  houses"] and got["nice", "term1"] and not got["nice", "never"]
    share = run("tfidf_coverage")
    assert "count(distinct" not in plan(share).lower() and share.first().coverage == round(5 / 7, 6)
    stems = run("tfidf_binary")
    assert "LIKE '%s'" in CATALOGUE.sql("tfidf_binary") and {r.stem for r in stems.collect()} == {"term0", "term1", "term2"}


def test_ranks_send_no_table_of_rows_to_the_driver(spark):
    """a written table of rows is small in files and large in memory; it is not broadcast by its size in files."""
    from pyspark.sql import functions as F

    from sievewright.operators.evaluation import places, share_ranks

    rows = spark.range(200).select(F.concat(F.lit("silo"), F.col("id") % 2).alias("unit"), F.col("id").cast("string").alias("row"), (F.col("id") % 7).cast("double").alias("s"))
    ranked = share_ranks(rows.select("unit", "row", "s"), "unit", "row", ["s"])
    placed = places(rows.select("unit", "row", "s"), ["unit"], ["s"])
    for frame in (ranked, placed):
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()
    values = {}
    for r in ranked.collect():
        values.setdefault(r.unit, []).append((r.s, r.rank_s))
    for v in values.values():
        s = [x for x, _ in v]
        assert all(abs(rank - (sum(y < x for y in s) + (s.count(x) + 1) / 2) / len(s)) < 1e-9 for x, rank in v)


def test_cosines_and_arms_by_blocks(spark, monkeypatch):
    """as the plans give them, with null, zero, short and tied vectors and a query of each kind; cosines come out of blocks."""
    from sievewright.operators import queried
    from sievewright.plans.catalogue import CATALOGUE

    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3), [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(1, 420)]
    rows += [(1002, 1, None), (1003, 1, [1.0, None, 1.0, 1.0]), (1004, 2, [1.0, 2.0]), (1100, 0, [0.0] * 4), (1200, 0, [1.0, 1.0]), (1300, None, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    monkeypatch.setattr(queried, "ROWS", 50)
    monkeypatch.setattr(queried, "PART", 100)
    key = lambda r: tuple((x is not None, x) for x in r)
    for name, run in (("cosine_to_brief", queried.cosine_ranks), ("add_cos_brief", queried.cosine_arms)):
        got = run(vectors)
        assert "MapInArrow" in got._jdf.queryExecution().toString() and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = CATALOGUE.run(spark, name, {"embeddings": vectors}.__getitem__).select(*got.columns)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and got.count() == 7 * len(rows)


def test_scores_against_all_briefs_leave_a_task_as_counts():
    import pyarrow as pa

    from sievewright.operators import lexblock

    rows = pa.RecordBatch.from_pydict({"silo": ["a"] * 500 + [None], "y": [1.0] * 500 + [None], "ids": [[0, 2]] * 500 + [[]], "w": [[0.5, 0.25]] * 500 + [[]], "hits": [[1, 0, 0]] * 500 + [[0, 0, 0]]})
    got = list(lexblock._scorer([([0, 2], 2), ([2], 1), ([], 0)], 3)([rows]))
    cells = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert ["at", "silo", "name", "v", "c", "p"] == got[0].schema.names
    assert sorted(cells, key=repr) == sorted([(0, "a", "bm25", 0.75, 500, 500.0), (1, "a", "bm25", 0.25, 500, 500.0), (2, "a", "bm25", 0.0, 500, 500.0), (0, "a", "must", 0.5, 500, 500.0), (1, "a", "must", 0.0, 500, 500.0),
        *[(i, None, "bm25", 0.0, 1, 0.0) for i in range(3)], *[(i, None, "must", 0.0, 1, 0.0) for i in range(2)]], key=repr)


def test_transfer_matrix_keeps_papers_without_a_silo(spark):
    from sievewright.operators import lexblock

    papers = spark.createDataFrame([(i, silo, "red stone " * (i % 3) + "river") for silo in ("a", None) for i in range(20 * (silo is None), 20 + 20 * (silo is None))], "paper_id long, silo string, text string")
    briefs = spark.createDataFrame([(s, 1, obj, obj, obj, [obj], [obj], [obj]) for s, obj in (("a", "red stone"), ("b", "river"))], "silo string, item_id long, obj string, prob string, dom string, must array<string>, nice array<string>, exclude array<string>")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "paper_id long, y int")
    got = {(r.brief, r.silo): (r.auc_bm25_obj, r.auc_overlap_must) for r in lexblock.transfer_matrix(papers, briefs, labels).collect()}
    assert set(got) == {(b, s) for b in "ab" for s in ("a", None)}  # as the SQL: no pool of its own, so no score
    assert got["a", "a"] == (1.0, 1.0) and got["a", None] == (0.5, 1.0) and got["b", "a"][1] == 0.5


def tools_of(media, monkeypatch):
    """What the images of ``media`` use."""
    from sievewright.llm import webp

    seen, read = set(), webp.read_pixels

    def spy(bits, group, w, h, cache_bits):
        seen.update({"cache"} if cache_bits else set(), {"copies"} if ((group[0].symbols >= 256) & (group[0].symbols < 280)).any() else set())
        return read(bits, group, w, h, cache_bits)

    with monkeypatch.context() as m:
        m.setattr(webp, "read_pixels", spy)
        payload = b"".join(px.tobytes() for px in webp.images(media))
    bits = webp.Bits(media[20:])
    bits.take(40)
    if bits.take(1):
        seen.add(("predictor", "cross", "green", "palette")[bits.take(2)])
    return seen, payload


def test_the_image_encoder_uses_each_of_its_tools(monkeypatch):
    from sievewright.llm import webp

    rng = np.random.default_rng(4)
    walk = rng.integers(-2, 3, (4000, 4)).cumsum(axis=0)
    noise = rng.integers(-1, 2, (4000, 4))
    base = rng.integers(0, 256, 4000)
    signed = base.astype(np.uint8).astype(np.int8).astype(int)
    samples = {
        "predictor": walk, "green": np.stack([base, base, base, 0 * base], 1) + noise, "cross": np.stack([base, 100 * signed >> 5, -90 * signed >> 5, 0 * base], 1) + noise,
        "palette": rng.integers(0, 256, (16, 4))[rng.integers(0, 16, 4000)], "cache": rng.integers(0, 256, (700, 4))[rng.integers(0, 700, 4000)], "copies": np.tile(rng.integers(0, 256, (500, 4)), (8, 1)),
    }
    for name, px in samples.items():
        payload = px.astype(np.uint8).tobytes()
        media = webp.encode(payload)
        seen, got = tools_of(media, monkeypatch)
        assert got == payload and name in seen, (name, seen)
        assert len(media) < len(payload)


def test_texts_are_stored_with_back_references_and_cache(monkeypatch):
    import pyarrow.parquet as pq

    from sievewright.llm import webp

    counts, size, stored = {}, 0, 0
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist():
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = webp.encode(payload)
        seen, got = tools_of(media, monkeypatch)
        assert got == payload
        size, stored = size + len(payload), stored + len(media)
        for name in seen:
            counts[name] = counts.get(name, 0) + 1
    assert counts["copies"] > 50 and counts["cache"] > 10
    assert stored < 0.6 * size


def texts_of_the_fixture():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()[:600]
    rng = np.random.default_rng(5)
    odd = [None, "", "a", "ab" * 3000, "\0" * 640, "é" * 77, "".join(map(chr, rng.integers(32, 127, 20000))), "".join(map(chr, rng.integers(97, 99, 4000)))]
    return texts + odd + [t * 40 for t in texts[:3] if t]


def test_images_are_written_and_read_many_at_once(monkeypatch):
    import hashlib

    import pyarrow as pa

    from sievewright.llm import webp

    calls = {"code_lengths": 0, "read_prefix": 0}
    for name in calls:
        def spy(*a, name=name, call=getattr(webp, name)):
            calls[name] += 1
            return call(*a)

        monkeypatch.setattr(webp, name, spy)
    texts = texts_of_the_fixture()
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    stored = list(webp._store([rows]))
    assert calls["code_lengths"] < len(texts)  # nine a text, one by one
    got = pa.Table.from_batches(webp._inspect(pa.Table.from_batches(stored).combine_chunks().to_batches())).to_pylist()
    assert calls["read_prefix"] < 2 * len(texts)  # five a text, one by one
    media = [m for b in stored for m in b.column("media").to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    for text, r, m in zip(texts, got, media, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert m == webp.encode(payload)  # whatever stands beside it


def test_images_in_step_are_read_as_alone():
    import pytest

    from sievewright.llm import webp
    from tests.llm.test_corpus import head

    rng = np.random.default_rng(6)
    payloads = [rng.integers(0, k, 64 * int(n)).astype(np.uint8).tobytes() for k, n in zip(rng.integers(1, 256, 300), rng.integers(1, 40, 300), strict=True)]
    streams = [webp.encode(p)[20:] for p in payloads]
    # of other encoders: a code whose lengths repeat, a slot of the cache that was not filled, a stream with meta prefix codes
    repeats = head(4, 1).put(0, 1).put(0, 1).put(0, 1)
    repeats.put(0, 1).put(12 - 4, 4)
    for s in webp.LENGTH_ORDER[:12]:
        repeats.put({8: 1, 16: 2, 18: 2}.get(s, 0), 3)
    repeats.put(0, 1)
    for _ in range(42):
        repeats.put(0b01, 2).put(3, 2)  # the last length, 8, six times: 252
    repeats.put(0b01, 2).put(1, 2).put(0b11, 2).put(13, 7)  # four times more, and 24 zeros
    repeats.one(1).one(2).one(3).one(0)
    for g in (7, 200, 9, 255):
        for k in range(7, -1, -1):
            repeats.put(g >> k & 1, 1)
    unfilled = head(2, 1).put(0, 1).put(1, 1).put(1, 4).put(0, 1)
    unfilled.put(0, 1).put(1, 4).put(0, 3).put(0, 3).put(1, 3).put(0, 3).put(1, 3).put(0, 1)
    for s in range(282):
        unfilled.put(int(s in (65, 66, 280, 281)), 1)
    unfilled.one(1).one(2).one(3).one(0).put(0b11, 2).put(0b01, 2)  # 281, 280: both still empty
    meta = head(4, 4).put(0, 1).put(0, 1).put(1, 1).put(0, 3).plain(0, 0, 0, 255).one(5).one(6).one(7).one(8).one(0)
    others = [np.packbits(np.array(w.bits, np.uint8), bitorder="little").tobytes() for w in (repeats, unfilled, meta)]
    assert webp.decode_stream(others[0])[..., 0].tolist() == [[7, 200, 9, 255]]
    assert not webp.decode_stream(others[1]).any()
    mixed = others + streams
    for one, px in zip(mixed, webp.decode_all(mixed), strict=True):
        assert np.array_equal(webp.decode_stream(one), px)
    assert [px.tobytes() for px in webp.decode_all(streams)] == payloads
    short = streams[0][: len(streams[0]) // 2]
    with pytest.raises(ValueError):
        webp.decode_all([short, *streams])


def test_edits_of_titles_by_bits():
    """Equal to the plain table on short texts of any characters; a pair of 30,000 characters takes a second, not the square of its length in cells."""
    import random

    from sievewright.operators.pairs import edits_within

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(4)
    for _ in range(3000):
        a = "".join(r.choice("abé ü"[:r.randint(1, 5)]) for _ in range(r.randint(0, 14)))
        b = list(a)
        for _ in range(r.randint(0, 6)):
            i = r.randint(0, len(b))
            b[i:i + r.randint(0, 1)] = r.choice(["", "a", "é", " "])
        b, most = "".join(b), r.randint(0, 6)
        want = plain(a, b)
        assert edits_within(a, b, most) == (want if want <= most else -1), (a, b, most)
    a = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    b = list(a)
    for i in range(5, 30_000, 20):
        b[i] = "#"
    assert edits_within(a, "".join(b), 4500) == 1500 and edits_within(a, "".join(b), 1499) == -1


def test_medians_shuffle_values_about_the_middle_alone(spark, monkeypatch):
    """Exact over cells of many kinds; of each column only the values of the buckets where medians lie are set beside the models. Blocks are bounded in bytes."""
    import pyarrow as pa

    from sievewright.operators import manymodels

    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3)) * [1, 1e-3, 1e6]
    x[rng.random(x.shape) < 0.3] = np.nan
    x[rng.random(x.shape) < 0.05] = -0.0
    x[0:300, 2] = np.nan
    rows = [(f"c{i % 3}", i, i % 2, [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(900)]
    packed = manymodels.blocks(spark.createDataFrame(rows, "cell string, id long, y int, x array<double>"))
    learns = {"a": "01", "b": "012", "c": "2", "d": "01"}
    train = spark.createDataFrame([(m, f"c{c}") for m, cells in learns.items() for c in cells], "model string, cell string")
    counted, plain = [], manymodels.running_counts
    monkeypatch.setattr(manymodels, "running_counts", lambda cells, by, *a: counted.append(cells.count()) or plain(cells, by, *a))
    got = {r.model: r.middle for r in manymodels.medians(packed, train, [0, 1, 2]).collect()}
    for m, cells in learns.items():
        own = np.concatenate([x[int(c)::3] for c in cells])
        assert [got[m][j] for j in range(3)] == [np.nanmedian(own[:, j]) for j in range(3)]
    assert counted and counted[0] < 900  # about 4,000 values by kinds in all
    v = np.sort(np.concatenate([x[~np.isnan(x)], [np.inf, -np.inf, 0.0, -0.0]]))
    assert (np.diff(manymodels._buckets(v)) >= 0).all()
    monkeypatch.setattr(manymodels, "BLOCK_BYTES", 24 * 40)
    batch = pa.RecordBatch.from_pylist([{"cell": r[0], "id": r[1], "y": r[2], "x": r[3]} for r in rows])
    sizes = [len(ids) for out in manymodels._pack([batch]) for ids in out.column("ids").to_pylist()]
    assert max(sizes) == 40 and sum(sizes) == 900


def test_rankings_by_cosine_shuffle_no_pairs(spark, monkeypatch):
    """A block of queries is ranked while the vectors stream past; rows come out by their place in the ranking. Queries that share an id are ranked together, as in the plan."""
    import sievewright.queries  # noqa: F401 (fills the catalogue)
    from sievewright.operators import queried
    from sievewright.plans.catalogue import CATALOGUE

    rng = np.random.default_rng(8)
    rows = [(100 * i if i < 9 else 1000 + i, 0, [float(x) for x in rng.integers(-2, 3, 3 if i % 5 else 2)]) for i in range(1, 160)] + [(None, 0, [1.0, 2.0, 0.0]), (1001, 0, None), (2000, 0, [0.0, 0.0])]
    monkeypatch.setattr(queried, "PAIRS", 2 * len(rows))
    monkeypatch.setattr(queried, "PART", 50)
    key = lambda r: tuple((x is not None, x) for x in r)
    for more, grouped in (([], False), ([(100, 0, [1.0, -1.0, 2.0])], True)):
        vectors = spark.createDataFrame(rows + more, "vec_id long, label int, embedding array<float>")
        got = queried.cosine_ranks(vectors)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("FlatMapGroupsInArrow" in plan) == grouped and ("CartesianProduct" in plan) != grouped
        found = [tuple(r) for r in got.collect()]
        want = CATALOGUE.run(spark, "cosine_to_brief", {"embeddings": vectors}.__getitem__).select(*got.columns)
        assert sorted(found, key=key) == sorted(map(tuple, want.collect()), key=key)


def test_arms_leave_in_order_of_their_cosine(monkeypatch):
    """So that equal values lie together in files; the last query's arm is the first one, in any number of rows at a time."""
    import pyarrow as pa

    from sievewright.operators import queried

    rng = np.random.default_rng(9)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(rng.normal(size=(n, 3)))
    x, q = unit(40), unit(7)
    batch = pa.RecordBatch.from_pylist([{"d": 3, "ids": list(range(40)), "x": x.tobytes(), "q_ids": [100 * i for i in range(7)], "q_x": q.tobytes(), "q_fits": [i != 4 for i in range(7)]}])
    for rows in (1, 130, 1 << 22):
        monkeypatch.setattr(queried, "ARMS", rows)
        out = [b.to_pylist() for b in queried._arms([batch])]
        for part in out:
            told = [r["cos_brief"] for r in part if r["cos_brief"] is not None]
            assert told == sorted(told)
        got = {(r["vec_id"], r["query_id"] // 100): (r["cos_brief"], r["cos_arm"]) for part in out for r in part}
        assert len(got) == sum(map(len, out)) == 280
        for (v, k), found in got.items():
            for own, value in zip((k, (k + 1) % 7), found):
                assert value is None if own == 4 else abs(value - q[own] @ x[v]) < 1e-6
