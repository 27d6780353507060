"""Skills demanded by jobs against skills of resumes: tiers, coverage, experience, fusion, rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import OVERSHOOT_YEARS, RELATED_CREDIT, SEMANTIC_CREDIT, SENIORITY_CEILING, Weights
from .ranking import ranked


def surface_key(name: Column) -> Column:
    """Lower case; blanks, hyphens and underscores are one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\s_-]+", " "))


def surfaces(ontology: DataFrame) -> DataFrame:
    """(surface, skill_key): every way to write an entry; a surface of several entries means the smallest key."""
    names = ontology.select("skill_key", F.explode(F.concat(F.array("canonical", "skill_key"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("s"))
    return names.where("s is not null").groupBy(surface_key(F.col("s")).alias("surface")).agg(F.min("skill_key").alias("skill_key"))


def resolved(rows: DataFrame, value: str, ontology: DataFrame) -> DataFrame:
    """Adds skill_key, null where the value is no surface: as written, without dots, or with ``.js`` closed up."""
    s = surfaces(ontology)
    one, two = s.select(F.col("surface").alias("_a"), F.col("skill_key").alias("_ka")), s.select(F.col("surface").alias("_b"), F.col("skill_key").alias("_kb"))
    flat = surface_key(F.col(value))
    joined = rows.withColumn("_f", flat).join(one, F.col("_f") == F.col("_a"), "left").join(two, F.regexp_replace("_f", "[.]", "") == F.col("_b"), "left")
    return joined.withColumn("skill_key", F.coalesce("_ka", "_kb")).drop("_f", "_a", "_ka", "_b", "_kb")


def related_edges(ontology: DataFrame) -> DataFrame:
    """(skill_key, neighbour), both ways, without loops."""
    out = ontology.select("skill_key", F.explode("related").alias("neighbour")).where("neighbour is not null and neighbour <> skill_key")
    return out.unionByName(out.select(F.col("neighbour").alias("skill_key"), F.col("skill_key").alias("neighbour"))).distinct()


def job_skills(requirements: DataFrame, ontology: DataFrame) -> DataFrame:
    """(job_id, skill_key, kind): demanded skills; one demanded both ways is required."""
    each = resolved(requirements.select("job_id", "kind", F.explode("skills").alias("v")), "v", ontology).where("skill_key is not null")
    return each.groupBy("job_id", "skill_key").agg(F.max("kind").alias("kind"))  # 'required' sorts after 'preferred'


def resume_skills(resumes: DataFrame, ontology: DataFrame) -> DataFrame:
    return resolved(resumes.select("resume_id", F.explode("skills").alias("v")), "v", ontology).where("skill_key is not null").select("resume_id", "skill_key").distinct()


def match_tiers(pairs: DataFrame, demanded: DataFrame, have: DataFrame, ontology: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """(job_id, resume_id, skill_key, kind, status, credit, importance, via) of every demanded skill of every pair.

    Exact, else related (the alphabetically first neighbour the resume has),
    else semantic (a row in ``probes``), else missing. The neighbour join
    starts from what each resume has, so no pair is multiplied by the ontology.
    """
    importance = ontology.select("skill_key", "importance")
    want = pairs.join(demanded, "job_id").join(importance, "skill_key")
    near = have.withColumnRenamed("skill_key", "neighbour").join(related_edges(ontology), "neighbour").groupBy("resume_id", "skill_key").agg(F.min("neighbour").alias("via"))
    out = want.join(have.withColumn("exact", F.lit(True)), ["resume_id", "skill_key"], "left").join(near, ["resume_id", "skill_key"], "left")
    if probes is not None:
        out = out.join(probes.select("job_id", "resume_id", "skill_key").distinct().withColumn("probe", F.lit(True)), ["job_id", "resume_id", "skill_key"], "left")
    else:
        out = out.withColumn("probe", F.lit(None).cast("boolean"))
    status = F.when(F.col("exact"), "exact").when(F.col("via").isNotNull(), "related").when(F.col("probe"), "semantic").otherwise("missing")
    out = out.withColumn("status", status).withColumn("via", F.when(F.col("status") == "related", F.col("via")))
    credit = F.when(F.col("status") == "exact", 1.0).when(F.col("status") == "related", RELATED_CREDIT).when(F.col("status") == "semantic", SEMANTIC_CREDIT).otherwise(0.0)
    return out.select("job_id", "resume_id", "skill_key", "kind", "status", credit.alias("credit"), "importance", "via")


def total(value: Column) -> Column:
    """A sum that does not depend on the order of rows: what adding doubles leaves beyond 12 decimals is cut."""
    return F.round(F.sum(value), 12)


def half_up(value: Column, digits: int) -> Column:
    """Rounded with halves up, also where a division left a half one unit too low in its last place."""
    return F.round(F.round(value, 12), digits)


def coverage(tiers: DataFrame) -> DataFrame:
    """(job_id, resume_id, required, preferred, exact_ratio, n_required): importance-weighted coverage; null where nothing is demanded."""
    part = lambda kind: total(F.when(F.col("kind") == kind, F.col("credit") * F.col("importance"))) / total(F.when(F.col("kind") == kind, F.col("importance")))
    hard = (F.col("kind") == "required") & (F.col("importance") >= 0.9)
    return tiers.groupBy("job_id", "resume_id").agg(
        part("required").alias("required"), part("preferred").alias("preferred"),
        F.count_if(hard).alias("n_hard"), F.count_if(hard & (F.col("status") == "exact")).alias("n_hard_exact"), F.count_if(F.col("kind") == "required").alias("n_required"),
    ).withColumn("exact_ratio", F.when(F.col("n_hard") > 0, F.col("n_hard_exact") / F.col("n_hard")).otherwise(1.0))


def experience_fit(years: Column, need: Column, seniority: Column, education: Column) -> Column:
    """How the years meet the bar, with a malus for overshooting a junior post, and the education level."""
    junior = F.coalesce(seniority.isin("intern", "junior"), F.lit(False))
    base = F.when(need <= 0, 0.62 + 0.38 * F.least(F.lit(1.0), years / 1.5)).when(years >= need, 1.0).otherwise(F.pow(years / need, 0.7))
    fit = F.when(junior & (years > need + OVERSHOOT_YEARS), base * 0.85).otherwise(base)
    target = F.when(F.coalesce(seniority == "intern", F.lit(False)), 1).otherwise(2)
    edu = F.when(education >= target, 1.0).when(education > 0, 0.6).otherwise(0.45)
    return F.round(0.78 * fit + 0.22 * edu, 4)


def fused(required: Column, semantic: Column, lexical: Column, preferred: Column, experience: Column, exact_ratio: Column, weights: Weights = Weights()) -> Column:
    """The weighted score on 0..100; lacking most hard skills dampens it."""
    raw = 100 * (required * weights.required + semantic * weights.semantic + lexical * weights.lexical + preferred * weights.preferred + experience * weights.experience)
    return F.round(F.when(exact_ratio < 0.5, raw * (0.78 + 0.44 * exact_ratio)).otherwise(raw), 2)


def contributions(parts: dict[str, Column], weights: Weights) -> Column:
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.round(v * getattr(weights, k) * 100, 2))])


def keyword_composite(required: Column, preferred: Column, lexical: Column, weights: Weights = Weights()) -> Column:
    total = weights.required + weights.preferred + weights.lexical
    return (required * weights.required + preferred * weights.preferred + lexical * weights.lexical) / total if total > 0 else F.lit(0.0)


def final_rank(rows: DataFrame, group: str | None = "job_id", score: str = "score", duplicate: str = "is_duplicate", name: str = "name", tie: str = "resume_id") -> DataFrame:
    """1..n by falling score, originals before duplicates, then name, then pool order."""
    return ranked(rows, [F.col(score).desc(), F.coalesce(F.col(duplicate), F.lit(False)).asc(), F.coalesce(F.col(name), F.lit("")).asc(), F.col(tie).asc()], group)


def seniority_flag(years: Column, seniority: Column) -> Column:
    ceiling = reduce(lambda c, kv: c.when(seniority == kv[0], kv[1]), SENIORITY_CEILING.items(), F.when(F.lit(False), 40.0)).otherwise(40.0)
    return F.when(years > ceiling + 2, "high").when(years > ceiling, "medium")
