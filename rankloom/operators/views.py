"""Views over a ranking: filters, matrix, coverage, comparisons, dashboards, texts. None of them re-ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import SEVERITY
from ..functions.text import listed
from .ranking import ranked

#: How a cell of the skill matrix looks.
CELL = {"exact": ("green", "Y", "has it"), "related": ("amber", "~", "related skill"), "semantic": ("amber", "~", "described"), "missing": ("red", "-", "missing")}


def severity_rank(severity: Column) -> Column:
    """0 high .. 3 info; anything else is 3."""
    return reduce(lambda c, kv: c.when(severity == kv[0], kv[1]), SEVERITY.items(), F.when(F.lit(False), 3)).otherwise(3)


def filtered(
    ranking: DataFrame, flags: DataFrame | None = None, have: DataFrame | None = None, min_score=None, min_years=None, max_years=None, min_education=None, min_confidence=None,
    freshers_only=False, hide_flagged=False, max_flag_severity=None, must_have=(), any_of=(), search=None, keys=("job_id", "resume_id"),
) -> DataFrame:
    """Rows that pass every filter given; ranks stay those of the whole pool."""
    c = F.col
    for bound, test in ((min_score, lambda v: c("score") >= v), (min_years, lambda v: c("years") >= v), (max_years, lambda v: c("years") <= v), (min_education, lambda v: c("education") >= v)):
        if bound is not None:
            ranking = ranking.where(test(bound))
    if min_confidence is not None:
        ranking = ranking.where(F.coalesce(c("confidence") >= min_confidence, F.lit(False)))
    if freshers_only:
        ranking = ranking.where(c("fresher"))
    if hide_flagged and flags is not None:
        ranking = ranking.join(flags.select(*keys).distinct(), list(keys), "left_anti")
    if max_flag_severity is not None and flags is not None:
        cap = SEVERITY.get(max_flag_severity, 0)
        ranking = ranking.join(flags.where(severity_rank(c("severity")) <= cap).select(*keys).distinct(), list(keys), "left_anti")
    if must_have and have is not None:
        owners = have.where(c("skill_key").isin(*must_have)).groupBy("resume_id").agg(F.count_distinct("skill_key").alias("n")).where(c("n") == len(set(must_have)))
        ranking = ranking.join(owners.select("resume_id"), "resume_id", "left_semi")
    if any_of and have is not None:
        ranking = ranking.join(have.where(c("skill_key").isin(*any_of)).select("resume_id").distinct(), "resume_id", "left_semi")
    if search:
        ranking = ranking.where(F.lower(F.concat_ws(" ", "name", "doc_id", F.array_join("skills", " "))).contains(search.lower()))
    return ranking


# How each filter is described.
FILTER_TEXT = {
    "min_score": "score >= {}", "min_years": "experience >= {} yrs", "max_years": "experience <= {} yrs", "must_have": "must have: {}", "any_of": "any of: {}", "min_education": "education level >= {}",
    "min_confidence": "confidence >= {}", "hide_flagged": "hide flagged candidates", "max_flag_severity": "hide {}-severity flags", "freshers_only": "freshers / students only", "search": "search '{}'",
}


def describe_filters(**filters) -> list[str]:
    """What the given filters of ``filtered`` ask for, in a fixed order; those that are off say nothing."""
    on = {k: v for k, v in filters.items() if v is not None and v is not False and v != () and v != [] and v != ""}
    return [text.format(", ".join(on[k]) if isinstance(on[k], (tuple, list)) else on[k]) for k, text in FILTER_TEXT.items() if k in on]


def matrix(tiers: DataFrame) -> DataFrame:
    """One cell a candidate and demanded skill."""
    s = F.col("status")
    pick = lambda i: reduce(lambda c, kv: c.when(s == kv[0], kv[1][i]), CELL.items(), F.when(F.lit(False), "")).otherwise(CELL["missing"][i])
    return tiers.select("job_id", "resume_id", "skill_key", "kind", "status", pick(0).alias("colour"), pick(1).alias("symbol"), pick(2).alias("label"))


def pool_coverage(tiers: DataFrame) -> DataFrame:
    """(job_id, skill_key, kind, have, pool, pct): exact holders of each demanded skill."""
    return tiers.groupBy("job_id", "skill_key", "kind").agg(F.count_if(F.col("status") == "exact").alias("have"), F.count("*").alias("pool")).withColumn("pct", F.round(100 * F.col("have") / F.col("pool"), 1))


def rollup(tiers: DataFrame) -> DataFrame:
    req = F.col("kind") == "required"
    return tiers.groupBy("job_id", "resume_id").agg(
        F.count_if(req & (F.col("status") == "exact")).alias("required_met"), F.count_if(req & F.col("status").isin("related", "semantic")).alias("required_partial"), F.count_if(req).alias("required_total"))


def score_distribution(ranking: DataFrame, group: str = "job_id") -> DataFrame:
    """Least, greatest and upper median (the n div 2-th of the sorted scores, from 0)."""
    sizes = ranking.groupBy(group).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"))
    placed = ranked(ranking.select(group, "score", "resume_id"), [F.col("score").asc(), F.col("resume_id").asc()], group, "i")
    middle = placed.join(sizes, group).where(F.col("i") == F.floor(F.col("n") / 2) + 1)
    return middle.select(group, "low", "high", F.col("score").alias("upper_median"), "n")


def pairwise(ranking: DataFrame, tiers: DataFrame, top: int = 3) -> DataFrame:
    """Each pair among the first ``top`` of a job: what only one has, what both have, and the score difference."""
    first = ranking.where(F.col("rank") <= top).select("job_id", "resume_id", "rank", "score")
    owned = tiers.where("status = 'exact'").groupBy("job_id", "resume_id").agg(F.array_sort(F.collect_set("skill_key")).alias("skills"))
    c = first.join(owned, ["job_id", "resume_id"], "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, F.expr("a.job_id = b.job_id and a.rank < b.rank"))
    return j.select(
        F.col("a.job_id").alias("job_id"), F.col("a.resume_id").alias("a"), F.col("b.resume_id").alias("b"), F.round(F.col("a.score") - F.col("b.score"), 2).alias("delta"),
        F.array_sort(F.array_except("a.skills", "b.skills")).alias("only_a"), F.array_sort(F.array_except("b.skills", "a.skills")).alias("only_b"), F.array_sort(F.array_intersect("a.skills", "b.skills")).alias("both"),
    )


def compare_text(name_a: Column, name_b: Column, delta: Column, only_a: Column, only_b: Column) -> Column:
    return F.concat(
        name_a, F.lit(" is "), F.format_number(F.abs(delta), 1), F.lit(" points "), F.when(delta >= 0, "above ").otherwise("below "), name_b,
        F.when(F.size(only_a) > 0, F.concat(F.lit("; only "), name_a, F.lit(" shows "), listed(only_a))).otherwise(""),
        F.when(F.size(only_b) > 0, F.concat(F.lit("; only "), name_b, F.lit(" shows "), listed(only_b))).otherwise(""),
    )


def verdict(score: Column, n_missing: Column) -> Column:
    return F.when((score >= 72) & (n_missing == 0), "strong match").when(score >= 60, "good match").when(score >= 45, "partial match").when(score >= 30, "weak match").otherwise("poor match")


def ui_status(score: Column, worst: Column) -> Column:
    """flagged for a high or medium flag, shortlisted from 70, else review."""
    return F.when(worst.isin("high", "medium"), "flagged").when(score >= 70, "shortlisted").otherwise("review")


def dashboard(ranking: DataFrame, by: str = "job_id") -> DataFrame:
    return ranking.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "shortlisted").alias("shortlisted"), F.count_if(F.col("status") == "flagged").alias("flagged"), (F.sum(F.round(F.col("score") * 100).cast("long")) / F.count("*") / 100).alias("avg_score"))


def cohort(ranking: DataFrame, by: str = "job_id") -> DataFrame:
    """Strengths and weaknesses against the cohort's own mean and best."""
    stats = ranking.groupBy(by).agg(F.avg("score").alias("avg_score"), F.max("score").alias("best"), F.avg("years").alias("avg_years"))
    j = ranking.join(stats, by)
    s, y = F.col("score"), F.col("years")
    return j.select(
        by, "resume_id",
        F.array_compact(F.array(F.when(s >= F.col("best"), "best score of the pool"), F.when(s > F.col("avg_score") + 5, "above the pool's mean"), F.when(y > F.col("avg_years") * 1.25, "more experience than most"))).alias("strengths"),
        F.array_compact(F.array(F.when(s < F.col("avg_score") - 5, "below the pool's mean"), F.when(y < F.col("avg_years") * 0.5, "less experience than most"))).alias("weaknesses"),
    )


def gap_label(pct: Column) -> Column:
    return F.when(pct < 40, "CRITICAL").when(pct < 70, "MODERATE").otherwise("WELL COVERED")


def find(ranking: DataFrame, needle: str) -> DataFrame:
    """(tier, ...) per job: pass 1 in rank order (name or file contains, equals rank, file or stem), pass 2 shares a word of over 2 letters; the first is kept."""
    n = needle.strip().lower()
    words = [w for w in n.split() if len(w) > 2]
    name, file = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("doc_id", F.lit("")))
    one = name.contains(n) | file.contains(n) | (F.col("rank").cast("string") == n) | (F.regexp_replace(file, r"\.[^.]*$", "") == n)
    two = F.arrays_overlap(F.split(name, " +"), F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    tiered = ranking.withColumn("tier", F.when(one, 1).when(two, 2)).where("tier is not null")
    return tiered.groupBy("job_id").agg(F.min(F.struct("tier", "rank", "resume_id")).alias("m")).select("job_id", F.col("m.resume_id").alias("resume_id"), F.col("m.rank").alias("rank"), F.col("m.tier").alias("tier"))
