"""Problem 8: mixing sources to target weights, by Pfair scheduling.

Each source's texts are cut, whole, into blocks of about ``block_tokens``. The
k-th block of a source of weight w is released at slot floor(k / w) and due at
ceil((k + 1) / w); earliest deadline first over the released blocks keeps every
source within one block of its due share at all times. Weights are exact
fractions (the targets as they are written, or the blocks a source can give
where it falls short), never rounded, so the bound holds at any length.

A schedule repeats after the weights' common denominator, so it is simulated
for one period, or for the mix if that is shorter: about a second a million
slots on the driver, which sends the state at every 50,000th slot to executors
that write the slots out. Each block then finds its slot by its number alone:
no running state over the corpus exists. For a corpus of over some 10^8 blocks
in weights without a short period, raise ``block_tokens``.

Positions within a source are prefix sums in two levels, by bucket and within
the bucket, so a source that holds a third of all tokens is summed by many
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush
from math import ceil, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import cut


def source_key(source: Column) -> Column:
    """A source without uneven spelling: lower case, words joined by ``_``."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def exact_weights(parts: dict[str, Fraction]) -> dict[str, tuple[int, int]]:
    """Each positive part as (units, period): its weight is units / period, and the periods are one number."""
    whole = sum(parts.values())
    weights = {s: v / whole for s, v in parts.items() if v > 0}
    period = lcm(*(w.denominator for w in weights.values())) if weights else 1
    return {s: (int(w * period), period) for s, w in weights.items()}


class Pfair:
    """Earliest deadline first over blocks that are released at floor(k / w) and due at ceil((k + 1) / w).

    ``weights`` are (units, period) a source and sum to 1; all arithmetic is on
    integers. ``done`` is the number of blocks of each source before slot
    ``at``, so a simulation can go on from any state of an earlier one.
    """

    def __init__(self, weights: list[tuple[int, int]], at: int = 0, done: list[int] | None = None):
        self.weights, self.at, self.done = weights, at, list(done or [0] * len(weights))
        self.ready: list[tuple[int, int, int]] = []
        self.waiting: list[tuple[int, int]] = []
        for i in range(len(weights)):
            self._queue(i)

    def _queue(self, i: int) -> None:
        units, period = self.weights[i]
        heappush(self.waiting, (self.done[i] * period // units, i))

    def slots(self, until: int) -> Iterator[tuple[int, int, int]]:
        """(slot, source, number of its block) from here to ``until``."""
        while self.at < until:
            while self.waiting and self.waiting[0][0] <= self.at:
                _, i = heappop(self.waiting)
                units, period = self.weights[i]
                heappush(self.ready, (-(-(self.done[i] + 1) * period // units), -units, i))
            _, _, i = heappop(self.ready)  # never empty: the weights sum to 1
            yield self.at, i, self.done[i]
            self.done[i] += 1
            self.at += 1
            self._queue(i)


def schedule(spark: SparkSession, plans: dict[str, dict[str, tuple[int, int]]], blocks: dict[str, int], segment: int = 50_000) -> DataFrame:
    """(mix_name, source, number, at): the slot of each block within one period of its mix.

    The driver runs each mix once through one period of its weights (through
    the mix's ``blocks`` if those are fewer) and keeps nothing but the state at
    every ``segment`` slots; executors replay the segments from there.
    """
    states = []
    for name, weights in plans.items():
        if not weights:
            continue
        sources, run = list(weights), Pfair(list(weights.values()))
        end = min(next(iter(weights.values()))[1], blocks[name])
        for at in range(0, end, segment):
            states.append((name, sources, [u for u, _ in weights.values()], weights[sources[0]][1], at, min(end, at + segment), list(run.done)))
            if at + segment < end:
                for _ in run.slots(at + segment):
                    pass
    schema = "mix_name string, sources array<string>, units array<long>, period long, at long, until long, done array<long>"

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = list(Pfair([(u, r["period"]) for u in r["units"]], r["at"], r["done"]).slots(r["until"]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["mix_name"]] * len(rows)), pa.array([r["sources"][i] for _, i, _ in rows]), pa.array([k for _, _, k in rows], pa.int64()), pa.array([t for t, _, _ in rows], pa.int64()),
                ], names=["mix_name", "source", "number", "at"])

    start = spark.createDataFrame(states, schema)
    return (start.repartition(len(states)) if len(states) > 1 else start).mapInArrow(replay, "mix_name string, source string, number long, at long")


def positions(texts: DataFrame, source: str, key: str, tokens: str, bucket_rows: int) -> DataFrame:
    """(source, key, tokens, start): each text's first token in a fixed random order of its source."""
    total = texts.count()
    buckets = max(1, ceil(total / bucket_rows))
    rows = texts.select(F.col(source).alias("source"), F.col(key).alias("key"), F.col(tokens).cast("long").alias("tokens"))
    rows = rows.withColumn("mixed", F.xxhash64("key", F.lit(17))).withColumn("bucket", F.pmod(F.col("mixed"), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    # one row a source and bucket: rows / bucket_rows of them in all
    base = sums.withColumn("base", F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("source", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("mixed", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(base, ["source", "bucket"]).select("source", "key", "tokens", (F.col("base") + F.col("within")).alias("start"))


#: More targets than this are refused: they are read to the driver.
MAX_MIX_SOURCES = 10_000


def mix(
    texts: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", tokens: str = "tokens", total_tokens: int | str | None = None,
    block_tokens: int = 2048, bucket_rows: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """The mix, (mix_name, slot, place, source, key, repeat_no, tokens), and its report, a row a mix and source.

    Without ``total_tokens`` a mix is as large as it can be with every share
    reached: the least, over its sources, of tokens x max_repeats / share. With
    it, a source that can't fill its share even when repeated max_repeats times
    gives all it has, spread over the whole mix, and the report says so;
    ``"all"`` asks for as many tokens as the mix's sources hold. The text that
    crosses a source's share is used if that brings the source nearer to it.
    Sources are compared by ``source_key``; targets of one mix that share a key
    are one source, their shares added up. Texts of no tokens, null sources and
    sources that no target names are in no mix; a target whose source has no
    texts is reported with 0 and doesn't limit the mix. Null keys are left out.
    Order: slot, then place.
    """
    goals = targets.where("mix_name is not null and source is not null and cast(target_share as decimal(38,12)) > 0 and max_repeats > 0")
    goals = goals.select("mix_name", "source", F.col("target_share").cast("decimal(38,12)").alias("share"), "max_repeats").distinct()
    goals = goals.groupBy("mix_name", source_key(F.col("source")).alias("source")).agg(F.min(goals.source).alias("source_name"), F.sum("share").cast("string").alias("share"), F.max("max_repeats").alias("max_repeats"))
    rows = goals.limit(MAX_MIX_SOURCES + 1).collect()
    if len(rows) > MAX_MIX_SOURCES:
        raise ValueError(f"more than {MAX_MIX_SOURCES} targets")
    have = texts.where(F.col(key).isNotNull() & (F.col(tokens) > 0)).withColumn("source", source_key(F.col(source))).join(goals.select("source").distinct(), "source", "left_semi")
    placed = cut(positions(have, "source", key, tokens, bucket_rows))
    supply = {r[0]: r[1] for r in placed.groupBy("source").agg(F.sum("tokens")).collect()}  # at most one row a target
    spark = texts.sparkSession
    plan: dict[str, list[tuple[str, str, Fraction, int]]] = {}
    for r in rows:
        plan.setdefault(r["mix_name"], []).append((r["source"], r["source_name"], Fraction(r["share"]), r["max_repeats"]))
    needs, weights, blocks = [], {}, {}
    for name, parts in sorted(plan.items()):
        parts.sort()
        whole = sum(share for _, _, share, _ in parts)
        live = [p for p in parts if supply.get(p[0], 0) > 0]
        size = sum(supply[k] for k, *_ in live) if total_tokens == "all" else total_tokens if total_tokens is not None else int(min((supply[k] * reps * whole / share for k, _, share, reps in live), default=0))
        due = {k: int(min(supply.get(k, 0) * reps, round(size * share / whole))) for k, _, share, reps in parts}
        short = any(due[k] < round(size * share / whole) for k, _, share, _ in live)
        count = {k: -(-n // block_tokens) for k, n in due.items() if n > 0}
        # where all reach their share the targets are the weights; else the blocks that each source gives
        weights[name] = exact_weights({k: Fraction(n) for k, n in count.items()} if short else {k: share for k, _, share, _ in parts if k in count})
        # the slot after which no source has a block left
        blocks[name] = max((-(-n * weights[name][k][1] // weights[name][k][0]) for k, n in count.items()), default=0)
        for k, shown, share, reps in parts:
            units, period = weights[name].get(k, (0, 1))
            needs.append((name, shown, k, float(share), int(reps), due[k], int(supply.get(k, 0)), units, period))
    need = spark.createDataFrame(needs, "mix_name string, source_name string, source string, target_share double, max_repeats int, need long, supply long, units long, period long")
    timed = schedule(spark, weights, blocks)
    copies = placed.join(need.where("need > 0"), "source")
    passes = F.least(F.col("max_repeats").cast("long"), F.ceil(F.col("need") / F.col("supply")))
    copies = copies.withColumn("repeat_no", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    copies = copies.withColumn("offset", F.col("repeat_no") * F.col("supply") + F.col("start")).where("2 * offset + tokens <= 2 * need")
    copies = copies.withColumn("block", F.expr(f"offset div {block_tokens}"))
    copies = copies.withColumn("number", F.pmod("block", "units"))
    mixed = copies.join(timed, ["mix_name", "source", "number"])
    mixed = mixed.select(
        "mix_name", (F.expr("block div units") * F.col("period") + F.col("at")).alias("slot"), (F.col("offset") - F.col("block") * block_tokens).alias("place"),
        F.col("source_name").alias("source"), F.col("key").alias(key), F.col("repeat_no").cast("int").alias("repeat_no"), F.col("tokens"),
    )
    got = mixed.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"), (F.max("repeat_no") + 1).alias("most_uses"))
    all_of = got.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    report = need.select("mix_name", F.col("source_name").alias("source"), "target_share", "max_repeats", F.col("supply").alias("source_tokens")).join(got, ["mix_name", "source"], "left").join(all_of, "mix_name", "left")
    report = report.select(
        "mix_name", "source", "target_share", "max_repeats", "source_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
    )
    return mixed, report
