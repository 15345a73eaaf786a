"""Embedding behind a pluggable embedder, TF-IDF factors, and layouts of small sets.

An embedder is any picklable object with ``model`` (its name), ``dim``, ``prefix`` (by kind of text) and ``__call__(list of texts)`` -> array of rows. ``HashingEmbedder`` needs no network.
"""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import average_linkage, neighbour_layout, stress_layout
from ..plans.catalogue import CATALOGUE as C
from ..plans.held import held

#: English stop-words that carry no topic (a short list).
STOP = tuple("a an and are as at be but by for from has have in is it its not of on or that the their this to was were which with".split())

#: Rows that a step over sparse rows handles at a time.
SLICE = 1024


class Embedder(Protocol):
    model: str
    dim: int
    prefix: dict[str, str]

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashed term counts, square-rooted, of unit length; counts without sign where all of a text's cancel, so only a text without terms is a zero vector."""

    model, prefix = "hashing-64", {"query": "", "passage": ""}

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            hashes = [zlib.crc32(w.encode()) for w in re.findall("[a-z0-9]+", t.lower())]
            for h in hashes:
                out[i, h % self.dim] += 1 - 2 * (h >> 31)
            if hashes and not out[i].any():
                for h in hashes:
                    out[i, h % self.dim] += 1
        out = np.sign(out) * np.sqrt(np.abs(out))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def embed_texts(rows: DataFrame, embedder: Embedder, key: str, text: str = "text", kind: str = "passage", batch: int = 256) -> DataFrame:
    """key, embedding of every row (null text: as empty), in Arrow batches of at most ``batch`` texts a call; written once."""
    prefix, dim = embedder.prefix.get(kind, ""), embedder.dim

    def run(frames):
        for f in frames:
            texts = [prefix + (t or "") for t in f[text]]
            got = [np.asarray(embedder(texts[i:i + batch])) for i in range(0, len(texts), batch)]
            v = np.vstack(got) if got else np.zeros((0, dim))
            if v.shape != (len(texts), dim):
                raise ValueError(f"{embedder.model} gave {v.shape} for {len(texts)} texts of {dim}")
            yield pd.DataFrame({key: f[key], "embedding": list(v.astype(np.float32))})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<float>")


def paper_texts(papers: DataFrame, separator: str = " [SEP] ", limit: int | None = None) -> DataFrame:
    """paper_id, text: title and abstract, one of them alone where the other is blank; rows with neither go. ``limit``: characters of the abstract that an embedder takes."""
    title, abstract = (F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "abstract"))
    text = F.when(abstract == "", title).when(title == "", abstract).otherwise(F.concat(title, F.lit(separator), abstract if limit is None else F.substring(abstract, 1, limit)))
    return papers.select("paper_id", text.alias("text")).where("text <> ''")


def embed_corpus_and_use_case(papers: DataFrame, use_case: str, embedder: Embedder) -> DataFrame:
    """paper_id (null: the use case), kind, embedding: corpus and query in one space."""
    corpus = embed_texts(paper_texts(papers), embedder, "paper_id").withColumn("kind", F.lit("passage"))
    query = papers.sparkSession.createDataFrame([(None, use_case)], "paper_id long, text string")
    return corpus.unionByName(embed_texts(query, embedder, "paper_id", kind="query").withColumn("kind", F.lit("query")))


def use_case_text(rows: DataFrame, override: str | None = None) -> DataFrame:
    """The override, else the first non-null use-case name by paper_id; an error without either."""
    first = F.min_by("use_case_name", F.when(F.col("use_case_name").isNotNull(), F.col("paper_id")))
    return rows.agg(F.coalesce(F.lit(override), first, F.raise_error(F.lit("no use case is named")).cast("string")).alias("use_case"))


def incremental_vectors(wanted: DataFrame, cache: DataFrame, embedder: Embedder, key: str, text: str = "text") -> DataFrame:
    """Vectors of all wanted keys: those of the cache, and the missing ones embedded (``made`` tells which to append)."""
    missing = wanted.join(cache.select(key), key, "left_anti")
    made = held(embed_texts(missing, embedder, key, text), "vectors").withColumn("made", F.lit(True))
    return made.union(cache.join(wanted.select(key), key, "left_semi").select(key, "embedding").withColumn("made", F.lit(False)))


def resolve_vectors(papers: DataFrame, embedder: Embedder) -> DataFrame:
    """Exported vectors if all rows have one, of a single model whose base name is the embedder's; else all are embedded anew. papers: paper_id, text, embedding, embed_model."""
    base = F.lower(F.regexp_extract(F.coalesce("embed_model", F.lit("")), r"([^/]*)$", 1))
    state = papers.agg(F.count("*").alias("n"), F.count("embedding").alias("have"), F.countDistinct(base).alias("models"), F.min(base).alias("model")).first()
    if state["n"] and state["have"] == state["n"] and state["models"] == 1 and state["model"] == embedder.model.rpartition("/")[2].lower():
        return papers.select("paper_id", "embedding", F.lit("export").alias("origin"))
    return embed_texts(papers, embedder, "paper_id").withColumn("origin", F.lit("embedded"))


def tfidf_factors(docs: DataFrame, k: int = 8, most_terms: int = 20_000, rounds: int = 6, seed: int = 1) -> DataFrame:
    """doc_id, factors: ``k`` singular coordinates (U times sigma) of the smoothed, unit-length TF-IDF matrix over the ``most_terms`` most frequent terms.

    Texts become sparse rows once. Subspace iteration: a round is one pass over these that sums X'(XQ) over the executors; the driver holds a basis of ``most_terms`` by k + 8. A factor's largest loading is positive.
    """
    words = held(docs.select("doc_id", F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP)).alias("ws")), "words")
    n = words.count()
    seen = words.select(F.explode("ws").alias("t"), F.lit(0).alias("once")).union(words.select(F.explode(F.array_distinct("ws")), F.lit(1)))
    df = seen.groupBy("t").agg(F.sum("once").alias("df"), F.sum(1 - F.col("once")).alias("all")).orderBy(F.desc("all"), "t").limit(most_terms).orderBy("t").toPandas()  # at most ``most_terms`` rows
    if not len(df):
        return docs.select("doc_id", F.array().cast("array<double>").alias("factors"))
    size = len(df)
    idf = np.log((1 + n) / (1 + df["df"].to_numpy(float))) + 1
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, k + 8))))[0]
    sc = words.sparkSession.sparkContext
    known = sc.broadcast((df["t"].tolist(), idf))

    def sparse(batches):
        names, idf = known.value
        names = pa.array(names, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ws = part.column("ws")
                number = pc.index_in(ws.flatten(), value_set=names)
                there = np.asarray(number.is_valid())
                row = np.repeat(np.arange(len(ws)), np.asarray(ws.value_lengths()))[there]
                cell, c = np.unique(row * size + number.drop_null().to_numpy().astype(np.int64), return_counts=True)
                row, i = cell // size, cell % size
                v = c * idf[i]
                v /= np.sqrt(np.bincount(row, v * v, minlength=len(ws)))[row]
                ends = pa.array(np.append(0, np.bincount(row, minlength=len(ws)).cumsum()), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(i, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(v, pa.float64()))], ["doc_id", "i", "v"])

    rows = held(words.mapInArrow(sparse, f"doc_id {dict(docs.dtypes)['doc_id']}, i array<int>, v array<double>"), "weights")

    def products(batches, basis):
        """doc_id, (row, i, v) of the entries, and the rows' products with the basis, ``SLICE`` rows at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                i, v = (np.asarray(part.column(c).flatten()) for c in ("i", "v"))
                row = np.repeat(np.arange(part.num_rows), np.asarray(part.column("i").value_lengths()))
                xq = np.stack([np.bincount(row, v * basis[i, j], minlength=part.num_rows) for j in range(basis.shape[1])], axis=1)
                yield part.column("doc_id"), row, i, v, xq

    def times(basis):
        def run(batches):
            out = np.zeros(basis.value.shape)
            for _, row, i, v, xq in products(batches, basis.value):
                for j in range(out.shape[1]):
                    out[:, j] += np.bincount(i, v * xq[row, j], minlength=size)
            some = np.flatnonzero(np.abs(out).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some].tolist(), pa.list_(pa.float64()))], ["i", "y"])

        got = rows.mapInArrow(run, "i int, y array<double>").groupBy("i").agg(*[F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(basis.value.shape[1])]).toPandas()
        out = np.zeros(basis.value.shape)
        out[got.i.to_numpy()] = got.drop(columns="i").to_numpy()
        return out

    for _ in range(rounds):
        q = np.linalg.qr(times(sc.broadcast(q)))[0]
    values, turn = np.linalg.eigh(q.T @ times(sc.broadcast(q)))
    load = q @ turn[:, np.argsort(-values)[:k]]
    load *= np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])
    basis = sc.broadcast(load)

    def project(batches):
        for ids, _, _, _, xq in products(batches, basis.value):
            yield pa.RecordBatch.from_arrays([ids, pa.array(xq.tolist(), pa.list_(pa.float64()))], ["doc_id", "factors"])

    return rows.mapInArrow(project, f"doc_id {dict(docs.dtypes)['doc_id']}, factors array<double>")


def spectrum(vectors: DataFrame) -> np.ndarray:
    """Eigenvalues of the covariance of unit vectors, falling: sums and a Gram matrix per task, d rows a task."""
    dim = vectors.select(F.max(F.size("embedding"))).first()[0] or 0

    def run(frames):
        s, g, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for f in frames:
            v = np.array([x for x in f.embedding if x is not None and len(x) == dim], float).reshape(-1, dim)
            size = np.linalg.norm(v, axis=1)
            v = v[size > 0] / size[size > 0, None]
            s, g, n = s + v.sum(0), g + v.T @ v, n + len(v)
        if n:
            yield pd.DataFrame({"i": np.arange(dim), "n": n, "s": s, "g": list(g)})

    parts = vectors.select("embedding").mapInPandas(run, "i int, n long, s double, g array<double>")
    total = parts.select("i", "n", "s", F.posexplode("g").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()  # d x d
    if not len(total):
        return np.zeros(0)
    g = total.pivot(index="i", columns="j", values="c").to_numpy()
    row = total[total.j == 0].sort_values("i")
    n, mean = row.n.iloc[0], row.s.to_numpy() / row.n.iloc[0]
    return np.linalg.eigvalsh(g - n * np.outer(mean, mean))[::-1]


def dispersion(vectors: DataFrame) -> DataFrame:
    """n_dims, participation ratio, share of the first eigenvalue."""
    e = spectrum(vectors)
    total = e.sum()
    row = (len(e), round(float(total**2 / (e**2).sum()), 4), round(float(e[0] / total), 6)) if len(e) and total > 0 else (len(e), None, None)
    return vectors.sparkSession.createDataFrame([row], "n_dims int, participation double, top1 double")


def power_iteration(vectors: DataFrame, k: int = 2, rounds: int = 30, tolerance: float = 1e-9) -> DataFrame:
    """component, share of the spread of unit vectors about their mean: power iteration with deflation from a fixed start.

    Every round is one product of the centred rows' cross-product with a vector, summed over the executors; a vector of d numbers is all the driver holds."""
    dim = vectors.select(F.max(F.size("embedding"))).first()[0] or 0
    rows = held(vectors.where(F.size("embedding") == dim).select("embedding"), "rows")

    def summed(work) -> np.ndarray:
        def run(frames):
            total = 0.0
            for f in frames:
                v = np.array(f.embedding.tolist(), float).reshape(-1, dim)
                size = np.linalg.norm(v, axis=1)
                total = total + work(v[size > 0] / size[size > 0, None])
            if not np.isscalar(total):
                yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        got = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()  # d + 2 rows
        return got.v.to_numpy()

    base = summed(lambda u: np.concatenate([u.sum(0), [len(u)]]))
    if not len(base) or not base[-1]:
        return vectors.sparkSession.createDataFrame([], "component int, share double")
    mean = base[:-1] / base[-1]
    spread, found, out = None, [], []
    for j in range(min(k, dim)):
        v = np.cos(np.arange(dim) + 1.0)
        v, value = v / np.linalg.norm(v), 0.0
        for _ in range(rounds):
            got = summed(lambda u, v=v: np.append((u - mean).T @ ((u - mean) @ v), ((u - mean) ** 2).sum()))
            w, spread = got[:-1], got[-1]
            for x, y in found:
                w = w - y * x * (x @ v)
            size = np.linalg.norm(w)
            if size <= 1e-12:
                break
            moved, v, value = np.abs(w / size - v).max(), w / size, size
            if moved < tolerance:
                break
        found.append((v, value))
        out.append((j + 1, round(float(value / spread), 6) if spread else None))
    return vectors.sparkSession.createDataFrame(out, "component int, share double")


def centroids(vectors: DataFrame) -> tuple[list[int], np.ndarray]:
    """Labels and unit centroids of their unit vectors: a row a label and dimension."""
    f = C.run_frame(vectors.sparkSession, "SELECT label, i, c FROM centroids", lambda t: vectors).toPandas()
    m = f.pivot(index="label", columns="i", values="c").sort_index()
    v = m.to_numpy()
    return [int(x) for x in m.index], v / np.linalg.norm(v, axis=1, keepdims=True)


def linkage(vectors: DataFrame) -> DataFrame:
    """Average linkage of the labels' centroids on one minus cosine: step, a, b, height, size."""
    _, v = centroids(vectors)
    merges = average_linkage(1 - v @ v.T)
    return vectors.sparkSession.createDataFrame([(i, a, b, round(h, 6), n) for i, (a, b, h, n) in enumerate(merges)], "step int, a int, b int, height double, size int")


def layout(vectors: DataFrame, kind: str) -> DataFrame:
    """label, x, y of the labels' centroids, by stress majorisation or by neighbours."""
    names, v = centroids(vectors)
    at = stress_layout(np.maximum(0, 1 - v @ v.T)) if kind == "stress" else neighbour_layout(v)
    return vectors.sparkSession.createDataFrame([(n, round(float(a), 6), round(float(b), 6)) for n, (a, b) in zip(names, at)], "label int, x double, y double")


def whitened(vectors: DataFrame, k: int = 4) -> DataFrame:
    """vec_id and ``k`` principal scores of variance one: centred first, divided by the root of their variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    rows = StandardScaler(withMean=True, withStd=True, inputCol="v", outputCol="c").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(rows)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)])
    rows = held(model.transform(rows).select("vec_id", vector_to_array("p").alias("p")), "scores")
    sd = rows.agg(*[F.stddev_pop(F.col("p")[j]).alias(f"s{j}") for j in range(k)]).first()
    return rows.select("vec_id", *[F.round(F.col("p")[j] * (float(sign[j]) / (sd[j] or 1.0)), 6).alias(f"w{j + 1}") for j in range(k)])


def predictability(vectors: DataFrame) -> DataFrame:
    """n, accuracy and majority share of a multinomial model that tells the label from the vector, on a hashed fifth that it has not seen."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = held(vectors.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), (F.crc32(F.col("vec_id").cast("string").cast("binary")) % 5 == 0).alias("out")), "labelled")
    model = LogisticRegression(family="multinomial", regParam=0.01, maxIter=50).fit(rows.where("not out"))
    got = model.transform(rows.where("out"))
    most = rows.where("not out").groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select(F.col("label").alias("major"))
    return got.crossJoin(F.broadcast(most)).agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"), F.round(F.avg((F.col("label") == F.col("major")).cast("double")), 6).alias("majority"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet")


def _papers(s, d):
    return C.view_frame(s, "papers", lambda t: s.read.parquet(f"{d}/{t}.parquet"))


def _sizes(df: DataFrame, *by: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.select(*by, F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


def _resolved(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").join(_vectors(s, d).withColumnRenamed("vec_id", "doc_id"), "doc_id", "left").select(F.col("doc_id").alias("paper_id"), "text", "embedding", F.lit("org/hashing-64").alias("embed_model"))
    whole = resolve_vectors(rows.where("embedding is not null"), HashingEmbedder())
    holes = rows.withColumn("embedding", F.when(F.col("paper_id") % 2 == 1, F.col("embedding")))
    return whole.union(resolve_vectors(holes, HashingEmbedder())).groupBy("origin").agg(F.count("*").alias("n"))


def _incremental(s, d):
    wanted = C.view_frame(s, "briefs", lambda t: s.read.parquet(f"{d}/{t}.parquet")).select("silo", "text")
    cache = held(embed_texts(wanted.where("length(silo) = 4"), HashingEmbedder(), "silo"), "cache")
    return incremental_vectors(wanted, cache, HashingEmbedder(), "silo").groupBy("made").agg(F.count("*").alias("n"))


QUERIES = {
    "embed_models": lambda s, d: _sizes(embed_texts(s.read.parquet(f"{d}/documents.parquet"), HashingEmbedder(), "doc_id"), "doc_id"),
    "embed_corpus_and_use_case": lambda s, d: _sizes(embed_corpus_and_use_case(_papers(s, d), "a use case in words", HashingEmbedder()), "paper_id", "kind"),
    "resolve_paper_vectors": _resolved, "incremental_theme_vectors": _incremental,
    "tfidf_svd": lambda s, d: tfidf_factors(s.read.parquet(f"{d}/documents.parquet")).select("doc_id", *[F.round(F.col("factors")[i], 4).alias(f"f{i + 1}") for i in range(3)]),
    "participation_ratio_full": lambda s, d: dispersion(_vectors(s, d)).select("participation"), "top1_variance_ratio": lambda s, d: dispersion(_vectors(s, d)).select("n_dims", "top1"),
    "power_iteration": lambda s, d: power_iteration(_vectors(s, d)), "hierarchical_linkage": lambda s, d: linkage(_vectors(s, d)), "smacof_layout": lambda s, d: layout(_vectors(s, d), "stress"),
    "tsne_2d": lambda s, d: layout(_vectors(s, d), "neighbours"), "preprocess_pca": lambda s, d: whitened(_vectors(s, d)), "use_case_predictability": lambda s, d: predictability(_vectors(s, d)),
    "use_case_text": lambda s, d: use_case_text(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") > 2, F.concat("lang", F.lit(" case"))).alias("use_case_name"))),
}


def oracles() -> dict[str, str]:
    tok = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
    norm = lambda x: f"CASE WHEN len({tok.format(x)}) > 0 THEN 1e0 ELSE 0e0 END"
    papers = C.sql_views("papers")
    return {
        "embed_corpus_and_use_case": f"WITH {papers}, t AS (SELECT paper_id, CASE WHEN trim(abstract) = '' THEN trim(title) WHEN trim(title) = '' THEN trim(abstract) ELSE trim(title) || ' sep ' || trim(abstract) END AS b FROM papers) SELECT paper_id, 'passage' AS kind, 64 AS dim, {norm('b')} AS norm FROM t WHERE b <> '' UNION ALL SELECT NULL, 'query', 64, 1e0",
        "resolve_paper_vectors": "SELECT 'export' AS origin, count(*) AS n FROM embeddings JOIN documents ON doc_id = vec_id UNION ALL SELECT 'embedded', count(*) FROM documents",
        "incremental_theme_vectors": f"WITH {C.sql_views('briefs')} SELECT length(silo) <> 4 AS made, count(*) AS n FROM briefs GROUP BY 1",
        "use_case_text": "SELECT lang || ' case' AS use_case FROM documents WHERE doc_id > 2 ORDER BY doc_id LIMIT 1",
    }
