"""Problem 3: the N best items of every group, with a hot-cold split.

Exact counts tell heavy groups from light ones. Light groups take an ordinary
window. A heavy group is range-sorted by its score: its own quantiles cut it
into ranges, exact range counts tell which top ranges hold its N best, and the
rows of all others are dropped before any sort. What is left is salted by a
key that differs within ties, a window finds the N best of each (group, range,
salt), and a last one the N best of those. Thus a group of any size is ranked
by many tasks, even if all its scores are equal, and the last window sees at
most N x ranges x salts rows of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut


def latest(rows: DataFrame, keys: list[str], version: list[str], keep: list[str]) -> DataFrame:
    """For each key the row of the highest version; combines before the shuffle."""
    top = rows.groupBy(*keys).agg(F.max(F.struct(*version, *[F.col(c).alias(f"kept_{c}") for c in keep])).alias("top"))
    return top.select(*keys, *[F.col(f"top.kept_{c}").alias(c) for c in keep])


def top_n(rows: DataFrame, group: str, score: str, order: list[Column], n: int, salt_by: str, heavy_rows: int = 20_000, ranges: int = 64, salts: int = 16) -> DataFrame:
    """The n first rows of each group by ``order``, with their ``rank``.

    ``order`` must begin with the falling ``score`` and be total; rows equal in
    all of it are interchangeable. ``salt_by`` is a column that differs among
    rows of one score. Rows of a null group are in no group. A null score ranks
    below all others. An empty input gives an empty result. ``rows`` is read
    several times, so it should be a table or a checkpoint.
    """
    rows = rows.where(F.col(group).isNotNull())
    counts = rows.groupBy(group).agg(F.count("*").alias("rows_of_group"))
    # as many rows as groups of more than heavy_rows rows each; whether it is broadcast is left to its measured size
    heavy = cut(counts.where(F.col("rows_of_group") > heavy_rows).select(F.col(group).alias("hot_group")))
    final = W.partitionBy(group).orderBy(*order)
    pick = lambda df, window: df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
    light = pick(rows.join(heavy, F.col(group) == F.col("hot_group"), "left_anti"), final)
    hot = rows.join(heavy, F.col(group) == F.col("hot_group"), "left_semi")
    cuts = cut(hot.groupBy(group).agg(F.percentile_approx(score, [i / ranges for i in range(1, ranges)], 1000).alias("cuts")).select(F.col(group).alias("hot_group"), "cuts"))
    ranged = hot.join(cuts, F.col(group) == F.col("hot_group")).withColumn("range_no", F.coalesce(F.aggregate(F.coalesce("cuts", F.array().cast("array<double>")), F.lit(0), lambda a, c: a + F.when(F.col(score) > c, 1).otherwise(0)), F.lit(0))).drop("hot_group", "cuts")
    held = ranged.groupBy(group, "range_no").agg(F.count("*").alias("rows_of_range"))  # at most ``ranges`` rows a heavy group
    above = F.coalesce(F.sum("rows_of_range").over(W.partitionBy(group).orderBy(F.col("range_no").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = held.withColumn("above", above).where(F.col("above") < n).select(F.col(group).alias("top_group"), F.col("range_no").alias("top_range"))
    best = ranged.join(top, (F.col(group) == F.col("top_group")) & (F.col("range_no") == F.col("top_range")), "left_semi").withColumn("salt_no", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    part = pick(best, W.partitionBy(group, "range_no", "salt_no").orderBy(*order)).drop("rank", "range_no", "salt_no")
    return light.unionByName(pick(part, final))


def best_resumes(ranked: DataFrame, n: int = 10, **split: int) -> DataFrame:
    """(job_id, resume_id, score, rank): the n best-scored resumes of each job.

    Of each job and resume the row scored last counts alone (of rows scored at
    one time the one loaded last, then the larger ranking_id), and only if its
    score is a number from 0 to 100. Ties: not a duplicate before a duplicate
    (null is no duplicate), then the smaller resume_id.
    """
    rows = ranked.where("job_id is not null and resume_id is not null").select("job_id", F.col("resume_id").cast("long").alias("resume_id"), "score", "is_duplicate", "scored_at", "loaded_at", "ranking_id")
    last = latest(rows, ["job_id", "resume_id"], ["scored_at", "loaded_at", "ranking_id"], ["score", "is_duplicate"])
    valid = cut(last.where("score is not null and not isnan(score) and score between 0 and 100").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False))))
    order = [F.col("score").desc(), F.col("is_duplicate").asc(), F.col("resume_id").asc()]
    return top_n(valid, "job_id", "score", order, n, salt_by="resume_id", **split).select("job_id", "resume_id", "score", "rank")
