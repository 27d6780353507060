"""Problem 6: near-duplicate texts by tiled exclusive-or and bit counts.

1. Each text becomes the set of its 5-word shingles (64-bit hashes). Texts of
   one set are one class, and only the class's first text goes on.
2. Each class gets block keys, each made of ``rows`` min-hashes of independent
   hash orders, and a 128-bit signature, one bit of the least hash of each of
   128 bins. Two sets of similarity s share a key with chance s^rows; there are
   as many keys as let a pair at the threshold miss all of them once in ten
   million (24 for 0.7 and two rows). The signatures of such a pair differ in
   128 (1 - s) / 2 bits on average, so a radius of 40 bits lies five deviations
   above s = 0.7, while unrelated texts come within it once in 60,000.
3. Classes meet in the blocks of equal keys. A block is compared in tiles
   sorted by population count: one numpy exclusive-or and bit count a tile
   pair, and tile pairs whose population counts differ by more than the radius,
   or whose set sizes alone rule the similarity out, are skipped. Pairs leave
   a block as they are found, so no task holds a block's pairs.
4. A block of more than ``block_rows`` classes is cut into bands of set size,
   of which only neighbours can hold similar sets, and each band into salted
   parts; each pair of parts is a task's work of its own, so no task holds more
   than two parts however common a shingle is.
5. The pairs left are verified exactly, on whole texts.

Classes are compared, not copies; pairs of copies come from class membership.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut

SHINGLE = 5
RADIUS = 40
TILE = 512
#: Pairs a task holds before it hands them on.
PAIRS_HELD = 200_000
MOST_ORDERS = 512
_NOT_WORD = re.compile("[^a-z0-9 ]+")
_ODD = np.random.default_rng(20240601).integers(1, 1 << 63, size=(MOST_ORDERS + SHINGLE + 1,), dtype=np.uint64) | np.uint64(1)


def words_of(text: str) -> list[str]:
    """Lower-case words; every run of other characters than a-z, 0-9 and space parts words."""
    return _NOT_WORD.sub(" ", text.lower()).split()


@lru_cache(maxsize=1 << 17)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the runs of five words (of the whole text if it is shorter)."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, np.uint64(min(len(h), SHINGLE)), dtype=np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out = out * _ODD[MOST_ORDERS + i] + h[i : i + n]
    return np.unique(_mix(out))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def keys_for(least: float, rows: int) -> int:
    """As many keys of ``rows`` min-hashes as let a pair of similarity ``least`` miss all of them once in ten million."""
    keys = math.ceil(math.log(1e-7) / math.log(1 - least**rows))
    if keys * rows > MOST_ORDERS:
        raise ValueError("too many hash orders: take fewer rows")
    return keys


def sketch(sets: list[np.ndarray], n_keys: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each (not empty) set its block keys and its 128-bit signature as two words."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keys = np.empty((len(sets), n_keys), dtype=np.uint64)
    for k in range(n_keys):
        key = np.full(len(sets), np.uint64(k + 1))
        for r in range(rows):
            key = key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * _ODD[k * rows + r], starts)
        keys[:, k] = _mix(key)
    # one bit of the least hash of each bin: sorted by (set, bin, hash), the first of each run
    mixed = flat * _ODD[-1]
    owner = np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
    order = np.sort((owner << np.uint64(44)) | (mixed >> np.uint64(20)))
    place = order >> np.uint64(37)  # the set and the 7 bits of the bin
    first = np.ones(len(order), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    least, place = order[first], place[first].astype(np.int64)
    bit = (_mix(least & np.uint64((1 << 44) - 1)) & np.uint64(1)).astype(bool)
    bits = np.zeros((len(sets), 128), dtype=bool)
    bits[place[bit] >> 7, place[bit] & 127] = True
    return keys, np.packbits(bits, axis=1).view(np.uint64)


CLASS_SCHEMA = "id long, h1 long, h2 long, size int, s1 long, s2 long, keys array<long>"


def _classes(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            ids, sets = [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                s = shingles(text)
                if len(s):
                    ids.append(key)
                    sets.append(s)
            if not ids:
                continue
            keys, sig = sketch(sets, n_keys, rows)
            full = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
            long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), long(full[:, 0]), long(full[:, 1]), pa.array([len(s) for s in sets], pa.int32()), long(sig[:, 0]), long(sig[:, 1]),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * n_keys + 1, n_keys), pa.int32()), long(keys.ravel())),
            ], names=["id", "h1", "h2", "size", "s1", "s2", "keys"])


def compare_tiles(left: dict[str, np.ndarray], right: dict[str, np.ndarray] | None, least: float, radius: int = RADIUS, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A tile pair at a time, the index pairs (into left, into right or left again) that the signatures and sizes let pass."""
    same = right is None
    right = left if same else right
    order_l = np.argsort(left["pop"], kind="stable")
    order_r = order_l if same else np.argsort(right["pop"], kind="stable")
    for i in range(0, len(order_l), tile):
        a = order_l[i : i + tile]
        for j in range(i if same else 0, len(order_r), tile):
            b = order_r[j : j + tile]
            if left["pop"][a[0]] - right["pop"][b[-1]] > radius or right["pop"][b[0]] - left["pop"][a[-1]] > radius:
                continue  # a difference in population counts is a lower bound of the distance
            if left["size"][a].max() < least * right["size"][b].min() or right["size"][b].max() < least * left["size"][a].min():
                continue
            far = np.bitwise_count(left["s1"][a][:, None] ^ right["s1"][b]) + np.bitwise_count(left["s2"][a][:, None] ^ right["s2"][b])
            sa, sb = left["size"][a][:, None], right["size"][b]
            near = (far <= radius) & (np.minimum(sa, sb) >= least * np.maximum(sa, sb))
            x, y = np.nonzero(near)
            x, y = a[x], b[y]
            if same:
                keep = (x != y) if i != j else (x < y)
                x, y = x[keep], y[keep]
            if len(x):
                yield x, y


NAMES = ("key", "lo", "hi", "part", "id", "size", "s1", "s2")


def _block_pairs(cols: dict[str, np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of whole blocks, which lie one after another."""
    turn = np.flatnonzero((cols["key"][1:] != cols["key"][:-1]) | (cols["lo"][1:] != cols["lo"][:-1]) | (cols["hi"][1:] != cols["hi"][:-1])) + 1
    starts, ends = np.concatenate([[0], turn]), np.concatenate([turn, [len(cols["id"])]])
    two = (ends - starts == 2) & (cols["lo"][starts] == cols["hi"][starts])
    if two.any():  # most blocks hold two classes; all of these at once
        i = starts[two]
        far = np.bitwise_count(cols["s1"][i] ^ cols["s1"][i + 1]) + np.bitwise_count(cols["s2"][i] ^ cols["s2"][i + 1])
        sa, sb = cols["size"][i], cols["size"][i + 1]
        near = (far <= RADIUS) & (np.minimum(sa, sb) >= least * np.maximum(sa, sb))
        yield cols["id"][i[near]], cols["id"][i[near] + 1]
    many = (ends - starts > 1) & ~two
    for s, e in zip(starts[many].tolist(), ends[many].tolist()):
        part = {k: v[s:e] for k, v in cols.items()}
        if part["lo"][0] == part["hi"][0]:  # both parts are the same: all pairs within
            for x, y in compare_tiles(part, None, least):
                yield part["id"][x], part["id"][y]
            continue
        first = part["part"] == part["lo"][0]
        left, right = ({k: v[m] for k, v in part.items()} for m in (first, ~first))
        if len(left["id"]) and len(right["id"]):
            for x, y in compare_tiles(left, right, least):
                yield left["id"][x], right["id"][y]


def _blocks(least: float):
    """Candidate pairs of a partition that is sorted by block; at most one unfinished block is held."""

    def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held: list[dict[str, np.ndarray]] = []
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            new = None
            if batch is not None:
                new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES}
                new["s1"], new["s2"] = new["s1"].view(np.uint64), new["s2"].view(np.uint64)
                new["pop"] = (np.bitwise_count(new["s1"]) + np.bitwise_count(new["s2"])).astype(np.int64)
                last = tuple(new[n][-1] for n in NAMES[:3])
                same = (new["key"] == last[0]) & (new["lo"] == last[1]) & (new["hi"] == last[2])
                begin = int(np.argmax(same))  # where the last, perhaps unfinished, block begins
                if held and begin == 0 and last == tuple(held[0][n][0] for n in NAMES[:3]):
                    held.append(new)
                    continue
                done = [*held, {n: v[:begin] for n, v in new.items()}]
                held = [{n: v[begin:] for n, v in new.items()}]
            else:
                done, held = held, []
            if done and sum(len(d["id"]) for d in done):
                yield {n: np.concatenate([d[n] for d in done]) for n in done[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0

        def out() -> pa.RecordBatch:
            x, y = np.concatenate(a), np.concatenate(b)
            pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for cols in whole_blocks(batches):
            for x, y in _block_pairs(cols, least):
                a.append(x)
                b.append(y)
                n += len(x)
                if n >= PAIRS_HELD:
                    yield out()
                    a, b, n = [], [], 0
        if n:
            yield out()

    return run


def classes_of(rows: DataFrame, key: str, text: str, n_keys: int, rows_a_key: int) -> DataFrame:
    """One row a text that has words: its class, sketch and set size."""
    return rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), F.col(text)).mapInArrow(lambda batches: _classes(batches, n_keys, rows_a_key), CLASS_SCHEMA)


#: Tables of up to so many rows are broadcast.
SMALL_ROWS = 500_000


def _small(df: DataFrame) -> tuple[DataFrame, int]:
    """The table computed once, marked for broadcast if its rows are counted to be few, and their number."""
    df = cut(df)
    n = df.count()
    return (F.broadcast(df) if n <= SMALL_ROWS else df), n


def _placed(hashed: DataFrame, n_classes: int, n_keys: int, least: float, block_rows: int) -> DataFrame:
    """The work each class takes part in: (key, lo, hi), and its own part, which is lo or hi."""
    # keys are counted in groups of a few first, so that only the keys of full groups need counting one by one
    groups = max(64, n_classes * n_keys // max(1, block_rows // 4))
    grouped = hashed.withColumn("key_group", F.pmod("key", F.lit(groups)))
    full, n_full = _small(grouped.groupBy("key_group").count().where(F.col("count") > block_rows).select("key_group"))
    hot, n_hot = _small(grouped.join(full, "key_group", "left_semi").groupBy("key").count().where(F.col("count") > block_rows).select("key")) if n_full else (None, 0)
    if not n_hot:  # no key of more classes than a block may hold
        zero = F.lit(0).cast("long")
        return hashed.select("key", zero.alias("lo"), zero.alias("hi"), zero.alias("part"), "id", "size", "s1", "s2")
    band = hashed.withColumn("band", F.floor(F.log("size") / F.log(F.lit(1 / least)) + 1e-9).cast("long"))
    bands = band.join(hot, "key", "left_semi").groupBy("key", "band").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("parts"))
    beside = W.partitionBy("key").orderBy("band")  # one row a band of a hot key
    bands, _ = _small(bands.select(
        "key", "band", "parts", F.when(F.lag("band").over(beside) == F.col("band") - 1, F.lag("parts").over(beside)).otherwise(0).alias("below"), F.when(F.lead("band").over(beside) == F.col("band") + 1, F.lead("parts").over(beside)).otherwise(0).alias("above"),
    ))
    node = lambda b, p: F.shiftleft(b, 32) + p
    every = lambda b, n: F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: node(b, i - 1))
    none = F.array().cast("array<bigint>")
    some = lambda b, n: F.when(n > 0, every(b, F.greatest(n, F.lit(1).cast("long")))).otherwise(none)
    tagged = band.join(bands, ["key", "band"], "left")
    part = F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(node(F.col("band"), F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))))
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.concat(some(F.col("band"), F.col("parts")), some(F.col("band") - 1, F.col("below")), some(F.col("band") + 1, F.col("above"))))
    placed = tagged.withColumn("part", part).withColumn("other", F.explode(others))
    return placed.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "size", "s1", "s2")


def near_pairs(rows: DataFrame, key: str, text: str, least: float = 0.8, block_rows: int = 20_000, rows_a_key: int = 2) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) between class representatives, and (id, rep): every text's class.

    Texts without words are in no class. Repeated keys with one text count
    once. ``least`` must be at least 0.7, for which the radius is set. Blocks
    of unrelated texts grow with the corpus; a third min-hash in a key
    (``rows_a_key``) thins them, for more keys.
    """
    if least < 0.7:
        raise ValueError("the radius is set for similarities of 0.7 or more")
    n_keys = keys_for(least, rows_a_key)
    each = cut(classes_of(rows, key, text, n_keys, rows_a_key))
    reps = each.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("keys").alias("keys"))
    reps = cut(reps)
    members = each.select("id", "h1", "h2").join(reps.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"]).select("id", "rep").distinct()
    hashed = reps.select("id", "size", "s1", "s2", F.explode("keys").alias("key"))
    work = _placed(hashed, reps.count(), n_keys, least, block_rows).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = cut(work.mapInArrow(_blocks(least), "a long, b long").distinct())
    verified = verify(pairs, rows, key, text, least)
    return verified, members


def verify(pairs: DataFrame, rows: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """The candidate pairs whose exact similarity on whole texts is at least ``least``."""
    texts = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: dict[str, np.ndarray] = {}

        def of(t: str) -> np.ndarray:
            if t not in recent:
                if len(recent) >= 256:
                    recent.clear()
                recent[t] = shingles(t)
            return recent[t]

        for frame in frames:
            sim = [jaccard(of(x), of(y)) for x, y in zip(frame["ta"], frame["tb"])]
            out = pd.DataFrame({"a": frame["a"], "b": frame["b"], "similarity": sim})
            yield out[out["similarity"] >= least - 1e-12]

    return full.mapInPandas(score, "a long, b long, similarity double").distinct()


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) of all texts, from pairs between representatives plus membership; an id with two texts is no pair of its own."""
    classes = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    shared = members.join(classes, "rep")
    within = shared.alias("x").join(shared.alias("y"), F.expr("x.rep = y.rep and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    left, right = members.select(F.col("id").alias("ia"), F.col("rep").alias("a")), members.select(F.col("id").alias("ib"), F.col("rep").alias("b"))
    between = pairs.select("a", "b").join(left, "a").join(right, "b").where("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return within.unionByName(between).distinct()
