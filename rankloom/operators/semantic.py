"""Similarity of requirement and chunk vectors, calibrated over the pool."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import ENCODER_BAND, PREFERRED_WEIGHT, REQUIRED_WEIGHT, TOP_CHUNKS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, v: s + v)


def similarities(chunks: DataFrame, requirements: DataFrame, block: int = 64) -> DataFrame:
    """(doc, chunk, weight, req_no, kind, sim) for every chunk and every requirement; ``block`` requirements are packed in a row's array, so each chunk is read once a block."""
    from .ranking import ranked

    numbered = ranked(requirements, [F.col("req_no").asc()]).withColumn("_b", F.expr(f"(rank - 1) div {block}"))
    packed = numbered.groupBy("_b").agg(F.collect_list(F.struct("req_no", "kind", "vector")).alias("_reqs")).select("_reqs")
    each = chunks.crossJoin(packed).withColumn("r", F.explode("_reqs"))
    return each.select("doc", "chunk", "weight", F.col("r.req_no").alias("req_no"), F.col("r.kind").alias("kind"), dot(F.col("vector"), F.col("r.vector")).alias("sim"))


def top_k_decay(sims: DataFrame, k: int = TOP_CHUNKS) -> DataFrame:
    """(doc, req_no, kind, agg): the k best chunks by raw similarity, times section weight, with decay 1 / (1 + r / 2)."""
    w = W.partitionBy("doc", "req_no").orderBy(F.col("sim").desc(), "chunk")
    top = sims.withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < k).withColumn("d", 1 / (1 + 0.5 * F.col("r")))
    return top.groupBy("doc", "req_no", "kind").agg((F.sum(F.col("sim") * F.col("weight") * F.col("d")) / F.sum("d")).alias("agg"))


def calibration_band(aggs: DataFrame, encoder: str = "model") -> DataFrame:
    """One row (floor, ceiling): the 15th and 90th percentile of the pool, or the encoder's own band if there are under 8 values or the band is under 0.02 wide."""
    p = aggs.agg(F.percentile("agg", 0.15).alias("lo"), F.percentile("agg", 0.90).alias("hi"), F.count("*").alias("n"))
    own = (F.col("n") < 8) | (F.col("hi") - F.col("lo") < 0.02)
    lo, hi = ENCODER_BAND[encoder]
    return p.select(F.when(own, lo).otherwise(F.col("lo")).alias("floor"), F.when(own, hi).otherwise(F.col("hi")).alias("ceiling"), "n")


def calibrated(aggs: DataFrame, encoder: str = "model") -> DataFrame:
    band = calibration_band(aggs, encoder)
    floor, ceiling = band.select("floor").scalar(), band.select("ceiling").scalar()
    return aggs.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("agg") - floor) / (ceiling - floor))))


def semantic_scores(matched: DataFrame) -> DataFrame:
    """(doc, score, n_weak): weighted mean similarity; weak are required ones under 0.35."""
    w = F.when(F.col("kind") == "required", REQUIRED_WEIGHT).otherwise(PREFERRED_WEIGHT)
    weak = (F.col("kind") == "required") & (F.col("similarity") < 0.35)
    return matched.groupBy("doc").agg(F.round(F.sum(F.col("similarity") * w) / F.sum(w), 4).alias("score"), F.count_if(weak).alias("n_weak"))


def best_and_weak(matched: DataFrame, n: int = 5) -> DataFrame:
    """(doc, best, weak): requirement numbers, best first and weakest first."""
    key = F.round("similarity", 9)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-key).alias("s"), "req_no"))), 1, n)
    weak = F.slice(F.array_sort(F.collect_list(F.when((F.col("kind") == "required") & (F.col("similarity") < 0.35), F.struct(key.alias("s"), F.col("req_no"))))), 1, n)
    return matched.groupBy("doc").agg(F.transform(best, lambda x: x["req_no"]).alias("best"), F.transform(weak, lambda x: x["req_no"]).alias("weak"))


def document_vectors(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the mean of each document's chunk vectors, scaled to length 1; zeros where the mean is 0."""
    means = chunks.select(key, F.posexplode(vector).alias("_p", "_v")).groupBy(key, "_p").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    whole = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"]).alias("m"), F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_n"))
    return whole.select(key, F.transform("m", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)).alias("vector"))


def document_similarity(documents: DataFrame, query: DataFrame, key: str) -> DataFrame:
    """(key, similarity): one dot product of each document's vector with the query document's, clipped to 0..1."""
    both = documents.crossJoin(query.select(F.col("vector").alias("_q")))
    return both.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col("vector"), F.col("_q")))).alias("similarity"))


def encoder_udf(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A column function from text to vector; ``load`` builds the model once a worker."""
    from pyspark.sql.types import ArrayType, FloatType

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for series in texts:
            yield pd.Series(list(model(series.fillna("").tolist())))

    return encode


def lsa(docs: DataFrame, key: str, text: str, components: int = 160, rounds: int = 4, seed: int = 42) -> DataFrame:
    """(key, vector): the latent-semantic encoding used where no model is at hand.

    Sublinear tf-idf over all terms and term pairs found in at most 90 % of
    the texts, projected on the leading singular vectors by subspace iteration
    and scaled to length 1; a text without terms has zeros. A term of one text
    adds only to that text's own diagonal element of the texts' Gram matrix, so
    it counts exactly without a row of its own; the driver holds (terms of
    several texts) x (components + 10) floats. Terms are told apart by 64-bit hashes.
    """
    from ..functions.text import tokens
    from ..session import cut
    from .ranking import ranked

    context = docs.sparkSession.sparkContext
    kind = dict(docs.dtypes)[key]
    t = tokens(F.col(text))
    pair = F.when(F.size(t) > 1, F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    terms = docs.select(F.col(key), F.concat(t, F.filter(F.coalesce(pair, F.array().cast("array<string>")), lambda p: p.isNotNull())).alias("terms"))
    tf = cut(terms.select(key, F.explode(F.transform("terms", lambda x: F.xxhash64(x))).alias("h")).groupBy(key, "h").agg(F.count("*").alias("tf")))
    n = docs.where(F.trim(F.col(text)) != "").count()
    df = tf.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") <= 0.9 * n)
    shared = cut(ranked(df.where("df > 1"), [F.col("h").asc()]).select("h", "df", (F.col("rank") - 1).alias("id")))
    size, single = shared.count(), df.where("df = 1").count()
    k = max(2, min(components, size + single - 1, n - 1))
    width = k + 10

    numbered = shared.unionByName(df.where("df = 1").withColumn("id", F.lit(-1)))
    w = (1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)
    each = tf.join(numbered, "h").groupBy(key).agg(F.collect_list(F.struct("id", w.alias("w"))).alias("x"), F.sqrt(F.sum(w * w)).alias("norm"))
    own = F.aggregate("x", F.lit(0.0), lambda s, e: s + F.when(e["id"] < 0, e["w"] * e["w"]).otherwise(0.0)) / (F.col("norm") * F.col("norm"))
    many = F.filter("x", lambda e: e["id"] >= 0)
    rows = cut(each.select(key, F.transform(many, lambda e: e["id"].cast("int")).alias("ids"), F.transform(many, lambda e: (e["w"] / F.col("norm")).cast("float")).alias("ws"), own.alias("own"), F.xxhash64(key).alias("seed")))

    def sparse(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of the text, the term and the weight of each element."""
        lengths = f["ids"].map(len).to_numpy()
        return np.repeat(np.arange(len(f)), lengths), np.concatenate(f["ids"].to_list()).astype(np.int64), np.concatenate(f["ws"].to_list()).astype(np.float32)

    def summed(to: np.ndarray, at: np.ndarray, ws: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of ``to``, and for each the sum of the rows of ``of`` at ``at``, weighted; a slice of elements at a time."""
        order = np.argsort(to, kind="stable")
        names, first = np.unique(to[order], return_index=True)
        out, step = np.zeros((len(names), of.shape[1]), np.float32), 50_000
        ends = np.append(first, len(to))
        a = 0
        while a < len(names):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + step, "right")) - 1)
            part = order[ends[a] : ends[b]]
            for s in range(0, len(part), step) if b == a + 1 else ():
                out[a] += ws[part[s : s + step]] @ of[at[part[s : s + step]]]
            if b > a + 1:
                out[a:b] = np.add.reduceat(of[at[part]] * ws[part, None], ends[a:b] - ends[a], axis=0)
            a = b
        return names, out

    def times(f: pd.DataFrame, right: np.ndarray, base: np.ndarray) -> np.ndarray:
        i, j, ws = sparse(f)
        names, out = summed(i, j, ws, right)
        base[names] += out
        return base

    def state(f: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(f["y"]), np.float32).reshape(len(f), -1)

    def mapped(frame: DataFrame, right: np.ndarray, mix: np.ndarray | None) -> DataFrame:
        """The texts' next rows: matrix x right, and the own terms' share."""
        sent = context.broadcast(right)

        def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    d = f["own"].to_numpy()[:, None]
                    if mix is None:
                        base = np.sqrt(d) * np.vstack([np.random.default_rng([seed, s & (2**64 - 1)]).standard_normal(width) for s in f["seed"]])
                    else:
                        base = d * (state(f) @ mix)
                    y = times(f, sent.value, base.astype(np.float32))
                    yield f[[key, "ids", "ws", "own", "seed"]].assign(y=[r.tobytes() for r in y])

        got = cut(frame.mapInPandas(step, f"{key} {kind}, ids array<int>, ws array<float>, own double, seed long, y binary"))
        sent.destroy()
        return got

    def gathered(frame: DataFrame, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Y'Y, Y'DY and A'Y."""

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    y = state(f)
                    z = y.astype(np.float64)
                    i, j, ws = sparse(f)
                    names, out = summed(j, i, ws, y)
                    cuts = np.unique(names // 4096)
                    lo, hi = np.searchsorted(names, cuts * 4096), np.searchsorted(names, (cuts + 1) * 4096)
                    yield pd.DataFrame({"block": [-1, -2, *cuts.tolist()], "ids": [b"", b"", *(names[a:b].tobytes() for a, b in zip(lo, hi))], "v": [(z.T @ z).tobytes(), (z.T @ (f["own"].to_numpy()[:, None] * z)).tobytes(), *(out[a:b].tobytes() for a, b in zip(lo, hi))]})

        def total(f: pd.DataFrame) -> pd.DataFrame:
            block = int(f["block"].iloc[0])
            if block < 0:
                return pd.DataFrame({"block": [block], "v": [np.sum([np.frombuffer(v) for v in f["v"]], axis=0).tobytes()]})
            out = np.zeros((min(4096, size - block * 4096), wide), np.float32)
            for ids, v in zip(f["ids"], f["v"]):
                out[np.frombuffer(ids, np.int64) - block * 4096] += np.frombuffer(v, np.float32).reshape(-1, wide)
            return pd.DataFrame({"block": [block], "v": [out.tobytes()]})

        gram, diagonal, back = np.zeros((wide, wide)), np.zeros((wide, wide)), np.zeros((size, wide), np.float32)
        for r in frame.mapInPandas(part, "block int, ids binary, v binary").groupBy("block").applyInPandas(total, "block int, v binary").toLocalIterator():
            if r["block"] == -1:
                gram = np.frombuffer(r["v"]).reshape(wide, wide)
            elif r["block"] == -2:
                diagonal = np.frombuffer(r["v"]).reshape(wide, wide)
            else:
                x = np.frombuffer(r["v"], np.float32).reshape(-1, wide)
                back[r["block"] * 4096 : r["block"] * 4096 + len(x)] = x
        return gram, diagonal, back

    frame, wide = mapped(rows, np.random.default_rng(seed).standard_normal((size, width), np.float32), None), width
    for left in range(rounds, -1, -1):
        gram, diagonal, back = gathered(frame, wide)
        values, vectors = np.linalg.eigh(gram)
        keep = values > max(values[-1], 1e-30) * 1e-10
        white = vectors[:, keep] / np.sqrt(values[keep])  # Y x white has orthonormal columns
        back = back @ white.astype(np.float32)
        if left:
            frame, wide = mapped(frame, back, white), white.shape[1]
    small = back.T.astype(np.float64) @ back if len(back) < 100_000 else sum(b.T.astype(np.float64) @ b for b in np.array_split(back, len(back) // 50_000))
    values, vectors = np.linalg.eigh(small + white.T @ diagonal @ white)
    last = white @ (vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0)))
    last = np.pad(last, ((0, 0), (0, k - last.shape[1])))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                z = state(f) @ last
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({key: f[key], "vector": z.tolist()})

    got = frame.select(key, "y").mapInPandas(project, f"{key} {kind}, vector array<double>")
    return docs.select(key).join(got, key, "left").select(key, F.coalesce("vector", F.array_repeat(F.lit(0.0), k)).alias("vector"))
