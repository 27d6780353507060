"""Dated entries of a text as intervals, and what can be read from them.

Dates are decimal years (year + (month - 1) / 12). ``as_of`` is a parameter:
nothing here looks at the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import sections

# Month names, and what means "until now".
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
PRESENT = "present|current|till date|now|ongoing"
RANGE = (
    r"(?i)(?:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,? +|(0?[1-9]|1[0-2])/)?((?:19|20)[0-9]{2}) *(?:-|–|—|to|until|through) *"
    r"(?:(?:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,? +|(0?[1-9]|1[0-2])/)?((?:19|20)[0-9]{2})|(present|current|till date|now|ongoing))"
)
WORK, STUDY = "work", "study"


def _month(name: Column, number: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name))
    return F.when(F.length(name) > 0, at).when(F.length(number) > 0, number.cast("int")).otherwise(1)


def entries(rows: DataFrame, key: str, text: str, as_of: tuple[int, int]) -> DataFrame:
    """(key, line_no, start, finish, kind, is_present, is_expected, label): the first date range of each line; an end before its start is set to the start; starts outside 1980 .. as_of + 8 are dropped."""
    now = as_of[0] + (as_of[1] - 1) / 12
    body = sections(rows, key, text).where(F.col("line").rlike(RANGE))
    g = lambda i: F.regexp_extract("line", RANGE, i)
    out = body.withColumn("start", g(3).cast("int") + (_month(g(1), g(2)) - 1) / 12).withColumn("is_present", F.length(g(7)) > 0)
    out = out.withColumn("finish", F.when(F.col("is_present"), F.lit(now)).otherwise(F.nullif(g(6), F.lit("")).cast("int") + (_month(g(4), g(5)) - 1) / 12))
    kind = F.when(F.col("section") == "experience", WORK).when(F.col("section") == "education", STUDY).when(F.col("section").isin("projects", "certifications", "achievements"), "side").otherwise("other")
    out = out.where((F.col("start") >= 1980) & (F.col("start") <= as_of[0] + 8))
    return out.select(key, "line_no", F.round("start", 6).alias("start"), F.round(F.greatest("start", "finish"), 6).alias("finish"), kind.alias("kind"), "is_present",
                      F.col("line").rlike(r"(?i)\b(expected|anticipated|graduating)\b").alias("is_expected"), F.left(F.trim("line"), F.lit(160)).alias("label"))


def merged_years(spans: DataFrame, key: str, gap: float = 0.1) -> DataFrame:
    """(key, years): the length of the union of the spans, gaps up to ``gap`` closed (gaps and islands)."""
    w = W.partitionBy(key).orderBy("start", "finish")
    run = spans.withColumn("reach", F.max("finish").over(w.rowsBetween(W.unboundedPreceding, -1)))
    mark = run.withColumn("new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap), 1).otherwise(0))
    island = mark.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    each = island.groupBy(key, "island").agg(F.min("start").alias("s"), F.max("finish").alias("e"))
    return each.groupBy(key).agg(F.round(F.sum(F.col("e") - F.col("s")), 2).alias("years"))


def overlaps(work: DataFrame, key: str, tolerance: float = 1.0) -> DataFrame:
    """(key, a, b, months, contained): pairs of entries of one text that run at the same time for over ``tolerance`` months."""
    a, b = work.alias("a"), work.alias("b")
    j = a.join(b, F.expr(f"a.{key} = b.{key} and a.line_no < b.line_no"))
    months = F.greatest(F.lit(0.0), (F.least("a.finish", "b.finish") - F.greatest("a.start", "b.start")) * 12)
    inside = F.expr("(a.start <= b.start and a.finish >= b.finish) or (b.start <= a.start and b.finish >= a.finish)")
    return j.select(F.col(f"a.{key}").alias(key), F.col("a.line_no").alias("a"), F.col("b.line_no").alias("b"), F.round(months, 1).alias("months"), inside.alias("contained"), months.alias("raw")).where(F.col("raw") > tolerance + 1e-4).drop("raw")


def concurrency(work: DataFrame, key: str) -> DataFrame:
    """(key, point, live): where most entries run at once (start <= point < finish), the first such point."""
    points = work.select(key, F.explode(F.array(F.round("start", 2), F.round("finish", 2))).alias("point")).distinct()
    live = points.join(work.select(key, "start", "finish"), key).where("start <= point and point < finish").groupBy(key, "point").agg(F.count("*").alias("live"))
    return live.groupBy(key).agg(F.max(F.struct("live", (-F.col("point")).alias("p"))).alias("m")).select(key, (-F.col("m.p")).alias("point"), F.col("m.live").alias("live"))


def totals(work: DataFrame, key: str) -> DataFrame:
    return work.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.sum((F.col("finish") - F.col("start")) * 12), 1).alias("months"), F.round((F.max("finish") - F.min("start")) * 12, 1).alias("span"),
        F.min("start").alias("earliest"), F.max("finish").alias("latest"), F.count_distinct(F.bround((F.col("finish") - F.col("start")) * 12)).alias("lengths"))


def timeline_flags(found: DataFrame, key: str, as_of: tuple[int, int]) -> DataFrame:
    """(key, code, severity): overlap, cluster, inflation, precedes education, uniform, future. Gaps are never flagged."""
    now = as_of[0] + (as_of[1] - 1) / 12
    work = found.where((F.col("kind") == WORK) & ((F.col("finish") - F.col("start")) * 12 >= 1 - 1e-4))
    over = overlaps(work, key).groupBy(key).agg(F.max("months").alias("worst"), F.max_by("contained", F.struct("months", "contained")).alias("c"))
    f1 = over.select(key, F.lit("date_overlap").alias("code"), F.when((F.col("worst") >= 3) | F.col("c"), "medium").otherwise("low").alias("severity"))
    f2 = concurrency(work, key).where("live >= 3").select(key, F.lit("overlap_cluster").alias("code"), F.lit("medium").alias("severity"))
    t = totals(work, key)
    f3 = t.where("n >= 2 and span > 0 and months > span * 1.5 + 6").select(key, F.lit("duration_inflation").alias("code"), F.lit("medium").alias("severity"))
    study = found.where(F.col("kind") == STUDY).groupBy(key).agg(F.min("start").alias("s"))
    f4 = t.join(study, key).where("earliest < s - 2").select(key, F.lit("experience_precedes_education").alias("code"), F.lit("low").alias("severity"))
    f5 = t.where("n >= 3 and lengths = 1 and months / n >= 2").select(key, F.lit("suspiciously_uniform").alias("code"), F.lit("low").alias("severity"))
    f6 = found.where((F.col("finish") > now + 1.05) & ~F.col("is_expected") & ~F.col("is_present")).select(key).distinct().select(key, F.lit("future_dated").alias("code"), F.lit("low").alias("severity"))
    out = f1
    for f in (f2, f3, f4, f5, f6):
        out = out.unionByName(f)
    return out
