"""Queries of the views over rankings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M, views as V
from ..operators.ranking import ranked
from ..session import cut, table
from .matching import _B, _tiers, have as _have, latest

VALID = "score is not null and not isnan(score) and score between 0 and 100"


def ranking(spark, d):
    people = table(spark, d, "resumes").select("resume_id", "doc_id", "name", "email", F.col("skills"), F.when(F.isnan("years_experience") | ~F.col("years_experience").between(0, 45), 0.0).otherwise(F.coalesce("years_experience", F.lit(0.0))).alias("years"),
                                                F.coalesce("education_level", F.lit(0)).alias("education"), F.coalesce("is_student_or_fresher", F.lit(False)).alias("fresher"), "warnings")
    rows = latest(spark, d).where(VALID).drop("doc_id").join(people, "resume_id")
    order = [F.col("score").desc(), F.coalesce("is_duplicate", F.lit(False)).asc(), F.coalesce("name", F.lit("")).asc(), F.col("resume_id").asc()]
    return ranked(rows, order, "job_id")


def flags(spark, d):
    """(job_id, resume_id, code, severity) of the plain rules."""
    base = ranking(spark, d).join(table(spark, d, "jobs").select("job_id", "seniority"), "job_id")
    sen = M.seniority_flag(F.col("years"), F.col("seniority"))
    all_of = F.array_compact(F.array(
        F.when(sen.isNotNull(), F.struct(F.lit("seniority_mismatch").alias("code"), sen.alias("severity"))),
        F.when(F.coalesce("is_duplicate", F.lit(False)), F.struct(F.lit("duplicate_resume").alias("code"), F.lit("medium").alias("severity"))),
        F.when(F.coalesce(F.size("warnings"), F.lit(0)) > 0, F.struct(F.lit("parse_warning").alias("code"), F.lit("low").alias("severity"))),
        F.when(F.coalesce(F.size("skills"), F.lit(0)) <= 0, F.struct(F.lit("no_skills_found").alias("code"), F.lit("medium").alias("severity"))),
    ))
    return base.select("job_id", "resume_id", F.explode(all_of).alias("f")).select("job_id", "resume_id", "f.code", "f.severity")


def _k(df):
    return df.select("job_id", "resume_id", "rank")


def filter_bounds(spark, d):
    return _k(V.filtered(ranking(spark, d), min_score=40, min_years=1, max_years=10, min_education=2))


def filter_freshers(spark, d):
    return _k(V.filtered(ranking(spark, d), freshers_only=True))


def filter_confidence(spark, d):
    return _k(V.filtered(ranking(spark, d), min_confidence=50))


def filter_must_have(spark, d):
    return _k(V.filtered(ranking(spark, d), have=_have(spark, d), must_have=("laravel", "prometheus")))


def filter_any_of(spark, d):
    return _k(V.filtered(ranking(spark, d), have=_have(spark, d), any_of=("python", "java", "go")))


def filter_hide_flagged(spark, d):
    return _k(V.filtered(ranking(spark, d), flags(spark, d), hide_flagged=True))


def filter_flag_severity(spark, d):
    return _k(V.filtered(ranking(spark, d), flags(spark, d), max_flag_severity="medium"))


def filter_search(spark, d):
    return _k(V.filtered(ranking(spark, d), search="Engineer"))


def flagged_view(spark, d):
    worst = flags(spark, d).groupBy("job_id", "resume_id").agg(F.min(F.struct(V.severity_rank(F.col("severity")).alias("r"), "severity")).alias("w"), F.count("*").alias("n_flags"))
    return ranking(spark, d).join(worst, ["job_id", "resume_id"]).select("job_id", "resume_id", "rank", F.col("w.severity").alias("worst"), "n_flags")


def filter_ui(spark, d):
    """Search over name and e-mail, status, one matched skill and a least experience."""
    return dashboard_rows(spark, d).where((F.col("status") != "flagged") & (F.col("years") >= 2)).where(F.lower(F.concat_ws(" ", "name", "email")).contains("a")).join(_have(spark, d).where("skill_key = 'docker'").select("resume_id"), "resume_id", "left_semi").select("job_id", "resume_id", "status")


def autocomplete(spark, d):
    """Entries whose key, name or an alias contains the text."""
    q = "sc"
    o = table(spark, d, "skill_ontology")
    hit = F.lower("skill_key").contains(q) | F.lower("canonical").contains(q) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(q))
    return o.where(hit).orderBy("canonical").limit(200).select("skill_key", "canonical", F.array_join(F.slice("aliases", 1, 6), "|").alias("aliases"))


def find_candidate(spark, d):
    return V.find(ranking(spark, d), "Sulezo")


def skill_facets(spark, d):
    return table(spark, d, "resumes").select(F.explode("skills").alias("s")).where("s is not null and trim(s) <> ''").groupBy(F.lower(F.trim("s")).alias("skill")).agg(F.count("*").alias("n"))


def skill_matrix(spark, d):
    return V.matrix(_tiers(spark, d))


def pool_coverage(spark, d):
    return V.pool_coverage(_tiers(spark, d))


def scarcest(spark, d):
    """The three scarcest required skills of each job."""
    from pyspark.sql import Window as W

    w = W.partitionBy("job_id").orderBy("pct", "skill_key")
    return V.pool_coverage(_tiers(spark, d)).where("kind = 'required'").withColumn("place", F.row_number().over(w)).where("place <= 3").select("job_id", "skill_key", "pct", "place")


def required_rollup(spark, d):
    return V.rollup(_tiers(spark, d))


def score_distribution(spark, d):
    return V.score_distribution(ranking(spark, d))


def self_test(spark, d):
    """Pool, best score and spread of each job."""
    return ranking(spark, d).groupBy("job_id").agg(F.count("*").alias("pool"), F.max("score").alias("top"), F.round(F.max("score") - F.min("score"), 4).alias("spread"))


def chart_bars(spark, d):
    """The five sub-scores' parts of each of the first 8 of a job."""
    sub = ("required_skills", "preferred_skills", "semantic", "lexical", "experience")
    parts = F.array(*[F.struct(F.lit(s).alias("part"), F.round(100 * F.coalesce(F.col(f"subscores.{s}"), F.lit(0.0)), 3).alias("value")) for s in sub])
    return ranking(spark, d).where("rank <= 8").select("job_id", "resume_id", "rank", F.explode(parts).alias("p")).select("job_id", "resume_id", "rank", "p.part", "p.value")


def chart_radar(spark, d):
    r = ranking(spark, d).where("rank <= 5")
    return r.groupBy("job_id").agg(*[F.round(F.avg(F.coalesce(F.col(f"subscores.{s}"), F.lit(0.0))), 4).alias(s) for s in ("required_skills", "semantic", "experience")])


def chart_scatter(spark, d):
    return ranking(spark, d).select("job_id", "resume_id", F.col("years").alias("x"), F.col("score").alias("y"), F.when(F.col("confidence").isNull(), "unknown").when(F.col("confidence") >= 70, "High").when(F.col("confidence") >= 50, "Moderate").when(F.col("confidence") >= 30, "Low").otherwise("Very low").alias("band"))


def pairwise_compare(spark, d):
    p = V.pairwise(ranking(spark, d), cut(_tiers(spark, d)))
    return p.select("job_id", "a", "b", "delta", *[F.array_join(c, ",").alias(c) for c in ("only_a", "only_b", "both")])


def compare_text(spark, d):
    p = V.pairwise(ranking(spark, d), _tiers(spark, d), 2)
    return p.select("job_id", V.compare_text(F.concat(F.lit("#"), F.col("a").cast("string")), F.concat(F.lit("#"), F.col("b").cast("string")), F.col("delta"), F.col("only_a"), F.col("only_b")).alias("text"))


def movements(spark, d):
    """Rank by first scoring against rank by last scoring, for pairs that were scored again."""
    rows = table(spark, d, "ranked_candidates").where("job_id is not null and resume_id is not null").where(VALID)
    v = F.struct("scored_at", "loaded_at", "ranking_id", "score")
    ends = rows.groupBy("job_id", "resume_id").agg(F.min(v).alias("f"), F.max(v).alias("l")).select("job_id", "resume_id", F.col("f.score").alias("sa"), F.col("l.score").alias("sb"))
    a = ranked(ends, [F.col("sa").desc(), F.col("resume_id").asc()], "job_id", "was").select("job_id", "resume_id", "was")
    b = ranked(ends, [F.col("sb").desc(), F.col("resume_id").asc()], "job_id", "now").select("job_id", "resume_id", "now")
    return a.join(b, ["job_id", "resume_id"]).where("was <> now").select("job_id", "resume_id", "was", "now", F.abs(F.col("was") - F.col("now")).alias("moved"))


def dashboard_rows(spark, d):
    worst = flags(spark, d).where("severity <> 'info'").groupBy("job_id", "resume_id").agg(F.min(F.struct(V.severity_rank(F.col("severity")).alias("r"), "severity")).alias("w"))
    r = ranking(spark, d).join(worst, ["job_id", "resume_id"], "left")
    return r.withColumn("status", V.ui_status(F.col("score"), F.col("w.severity")))


def dashboard(spark, d):
    return V.dashboard(dashboard_rows(spark, d))


def cohort_relative(spark, d):
    return V.cohort(ranking(spark, d)).select("job_id", "resume_id", F.array_join("strengths", "; ").alias("strengths"), F.array_join("weaknesses", "; ").alias("weaknesses"))


def gap_counts(spark, d):
    """The three demanded skills that most of a job's pool lacks."""
    from pyspark.sql import Window as W

    g = _tiers(spark, d).where("status = 'missing'").groupBy("job_id", "skill_key").agg(F.count("*").alias("lack"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("job_id").orderBy(F.col("lack").desc(), "skill_key"))).where("place <= 3")


def skill_gap_report(spark, d):
    c = V.pool_coverage(_tiers(spark, d)).where("kind = 'required'")
    return c.select("job_id", "skill_key", "have", "pool", F.round(100 * F.col("have") / F.col("pool"), 0).alias("pct"), V.gap_label(100 * F.col("have") / F.col("pool")).alias("label"))


def ranked_report(spark, d):
    """Rank list with met / partial / total and the verdict."""
    roll = V.rollup(_tiers(spark, d))
    r = ranking(spark, d).join(roll, ["job_id", "resume_id"], "left").fillna(0, ["required_met", "required_partial", "required_total"])
    lack = F.col("required_total") - F.col("required_met") - F.col("required_partial")
    return r.select("job_id", "resume_id", "rank", "score", "required_met", "required_partial", "required_total", V.verdict(F.col("score"), lack).alias("verdict"))


def top_missing_lists(spark, d):
    """The required skills each of the first three lacks, as a phrase."""
    miss = _tiers(spark, d).where("kind = 'required' and status = 'missing'").groupBy("job_id", "resume_id").agg(F.array_sort(F.collect_list("skill_key")).alias("m"))
    r = ranking(spark, d).where("rank <= 3").join(miss, ["job_id", "resume_id"], "left")
    from ..functions.text import listed

    return r.select("job_id", "resume_id", "rank", listed(F.coalesce("m", F.array().cast("array<string>"))).alias("missing"))


def collapse_renumber(spark, d):
    """The first row of each identity group of a job in rank order, renumbered."""
    from pyspark.sql import Window as W

    r = ranking(spark, d).withColumn("who", F.coalesce(F.nullif(F.trim("identity_group"), F.lit("")), F.concat(F.lit("id "), F.col("resume_id").cast("string"))))
    first = r.withColumn("n", F.row_number().over(W.partitionBy("job_id", "who").orderBy("rank"))).where("n = 1").select("job_id", "resume_id", F.col("rank").alias("was"))
    return ranked(first, [F.col("was").asc()], "job_id")


_R = _B + """, cand AS (
  SELECT l.job_id, l.resume_id, l.score, l.subscores, coalesce(l.is_duplicate, false) AS dup, l.confidence, l.identity_group, r.doc_id, r.name, r.email, r.skills, r.warnings, coalesce(r.is_student_or_fresher, false) AS fresher, coalesce(r.education_level, 0) AS education,
    CASE WHEN r.years_experience IS NULL OR isnan(r.years_experience) OR r.years_experience NOT BETWEEN 0 AND 45 THEN 0.0 ELSE r.years_experience END AS years
  FROM latest l JOIN resumes r USING (resume_id) WHERE l.score IS NOT NULL AND NOT isnan(l.score) AND l.score BETWEEN 0 AND 100),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY score DESC, dup, coalesce(name, ''), resume_id) AS INTEGER) AS rank FROM cand),
fl0 AS (SELECT rk.*, seniority, CASE seniority WHEN 'intern' THEN 2.0 WHEN 'junior' THEN 3.5 WHEN 'mid' THEN 8.0 ELSE 40.0 END AS ceil_y FROM rk JOIN jobs USING (job_id)),
fl AS (
  SELECT job_id, resume_id, CASE WHEN years > ceil_y + 2 THEN 'high' ELSE 'medium' END AS severity FROM fl0 WHERE years > ceil_y
  UNION ALL SELECT job_id, resume_id, 'medium' FROM fl0 WHERE dup
  UNION ALL SELECT job_id, resume_id, 'low' FROM fl0 WHERE len(warnings) > 0
  UNION ALL SELECT job_id, resume_id, 'medium' FROM fl0 WHERE coalesce(len(skills), 0) = 0),
worst AS (SELECT job_id, resume_id, ['high', 'medium', 'low'][min(list_position(['high', 'medium', 'low'], severity))] AS worst, count(*) AS n_flags FROM fl GROUP BY 1, 2),
dash AS (SELECT rk.*, CASE WHEN worst IN ('high', 'medium') THEN 'flagged' WHEN score >= 70 THEN 'shortlisted' ELSE 'review' END AS status FROM rk LEFT JOIN worst USING (job_id, resume_id)),
cover AS (SELECT job_id, skill_key, kind, count(*) FILTER (WHERE status = 'exact') AS have, count(*) AS pool FROM tiers GROUP BY 1, 2, 3),
roll AS (SELECT job_id, resume_id, count(*) FILTER (WHERE kind = 'required' AND status = 'exact') AS required_met, count(*) FILTER (WHERE kind = 'required' AND status IN ('related', 'semantic')) AS required_partial, count(*) FILTER (WHERE kind = 'required') AS required_total FROM tiers GROUP BY 1, 2),
owned AS (SELECT job_id, resume_id, list(DISTINCT skill_key) AS sk FROM tiers WHERE status = 'exact' GROUP BY 1, 2),
"""
_S = _R + "fin AS (SELECT 1) SELECT job_id, resume_id, rank FROM rk "
_P = _R + """pr AS (SELECT a.job_id, a.resume_id AS a, b.resume_id AS b, a.rank AS ra, b.rank AS rb, round(a.score - b.score, 2) AS delta, coalesce(x.sk, []) AS sa, coalesce(y.sk, []) AS sb
  FROM rk a JOIN rk b ON a.job_id = b.job_id AND a.rank < b.rank LEFT JOIN owned x ON x.job_id = a.job_id AND x.resume_id = a.resume_id LEFT JOIN owned y ON y.job_id = b.job_id AND y.resume_id = b.resume_id WHERE b.rank <= 3),
pl AS (SELECT *, list_sort(list_filter(sa, lambda s: NOT list_contains(sb, s))) AS oa, list_sort(list_filter(sb, lambda s: NOT list_contains(sa, s))) AS ob, list_sort(list_filter(sa, lambda s: list_contains(sb, s))) AS bo FROM pr)
"""
_LIST = "CASE WHEN len({0}) = 0 THEN 'none' ELSE (CASE WHEN len({0}) = 1 THEN {0}[1] ELSE array_to_string({0}[1:least(len({0}), 6) - 1], ', ') || ' and ' || {0}[least(len({0}), 6)] END) || CASE WHEN len({0}) > 6 THEN ' (+' || (len({0}) - 6) || ' more)' ELSE '' END END"
SQL = {
    "filter_bounds": _S + "WHERE score >= 40 AND years >= 1 AND years <= 10 AND education >= 2",
    "filter_freshers": _S + "WHERE fresher",
    "filter_confidence": _S + "WHERE confidence >= 50",
    "filter_must_have": _S + "WHERE resume_id IN (SELECT resume_id FROM have WHERE skill_key = 'laravel') AND resume_id IN (SELECT resume_id FROM have WHERE skill_key = 'prometheus')",
    "filter_any_of": _S + "WHERE resume_id IN (SELECT resume_id FROM have WHERE skill_key IN ('python', 'java', 'go'))",
    "filter_hide_flagged": _S + "WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.job_id = rk.job_id AND fl.resume_id = rk.resume_id)",
    "filter_flag_severity": _S + "WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.job_id = rk.job_id AND fl.resume_id = rk.resume_id AND severity IN ('high', 'medium'))",
    "filter_search": _S + "WHERE lower(concat_ws(' ', name, doc_id, array_to_string(skills, ' '))) LIKE '%engineer%'",
    "flagged_view": _R + "fin AS (SELECT 1) SELECT job_id, resume_id, rank, worst, n_flags FROM rk JOIN worst USING (job_id, resume_id)",
    "filter_ui": _R + "fin AS (SELECT 1) SELECT job_id, resume_id, status FROM dash WHERE status <> 'flagged' AND years >= 2 AND lower(concat_ws(' ', name, email)) LIKE '%a%' AND resume_id IN (SELECT resume_id FROM have WHERE skill_key = 'docker')",
    "autocomplete": "SELECT skill_key, canonical, array_to_string(aliases[1:6], '|') AS aliases FROM skill_ontology WHERE lower(skill_key) LIKE '%sc%' OR lower(canonical) LIKE '%sc%' OR len(list_filter(aliases, lambda a: lower(a) LIKE '%sc%')) > 0",
    "find_candidate": _R + """tier AS (SELECT *, CASE WHEN lower(coalesce(name, '')) LIKE '%sulezo%' OR lower(doc_id) LIKE '%sulezo%' THEN 1 WHEN list_contains(string_split(lower(coalesce(name, '')), ' '), 'sulezo') THEN 2 END AS tier FROM rk)
        SELECT job_id, arg_min(resume_id, tier * 1000000 + rank) AS resume_id, CAST(min(tier * 1000000 + rank) % 1000000 AS INTEGER) AS rank, CAST(min(tier) AS INTEGER) AS tier FROM tier WHERE tier IS NOT NULL GROUP BY job_id""",
    "skill_facets": "SELECT lower(trim(s)) AS skill, count(*) AS n FROM (SELECT unnest(skills) AS s FROM resumes) WHERE s IS NOT NULL AND trim(s) <> '' GROUP BY 1",
    "skill_matrix": _B + "SELECT job_id, resume_id, skill_key, kind, status, CASE status WHEN 'exact' THEN 'green' WHEN 'missing' THEN 'red' ELSE 'amber' END AS colour, CASE status WHEN 'exact' THEN 'Y' WHEN 'missing' THEN '-' ELSE '~' END AS symbol, CASE status WHEN 'exact' THEN 'has it' WHEN 'related' THEN 'related skill' WHEN 'semantic' THEN 'described' ELSE 'missing' END AS label FROM tiers",
    "pool_coverage": _R + "fin AS (SELECT 1) SELECT *, round(100 * have / pool, 1) AS pct FROM cover",
    "scarcest": _R + "pl AS (SELECT job_id, skill_key, round(100 * have / pool, 1) AS pct, CAST(row_number() OVER (PARTITION BY job_id ORDER BY round(100 * have / pool, 1), skill_key) AS INTEGER) AS place FROM cover WHERE kind = 'required') SELECT * FROM pl WHERE place <= 3",
    "required_rollup": _R + "fin AS (SELECT 1) SELECT * FROM roll",
    "score_distribution": _R + "fin AS (SELECT 1) SELECT job_id, min(score) AS low, max(score) AS high, list_sort(list(score))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS upper_median, count(*) AS n FROM rk GROUP BY job_id",
    "self_test": _R + "fin AS (SELECT 1) SELECT job_id, count(*) AS pool, max(score) AS top, round(max(score) - min(score), 4) AS spread FROM rk GROUP BY job_id",
    "chart_bars": _R + "fin AS (SELECT 1) " + " UNION ALL ".join(f"SELECT job_id, resume_id, rank, '{s}' AS part, round(100 * coalesce(subscores.{s}, 0.0), 3) AS value FROM rk WHERE rank <= 8" for s in ("required_skills", "preferred_skills", "semantic", "lexical", "experience")),
    "chart_radar": _R + "fin AS (SELECT 1) SELECT job_id, " + ", ".join(f"round(avg(coalesce(subscores.{s}, 0.0)), 4) AS {s}" for s in ("required_skills", "semantic", "experience")) + " FROM rk WHERE rank <= 5 GROUP BY job_id",
    "chart_scatter": _R + "fin AS (SELECT 1) SELECT job_id, resume_id, years AS x, score AS y, CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 70 THEN 'High' WHEN confidence >= 50 THEN 'Moderate' WHEN confidence >= 30 THEN 'Low' ELSE 'Very low' END AS band FROM rk",
    "pairwise_compare": _P + "SELECT job_id, a, b, delta, array_to_string(oa, ',') AS only_a, array_to_string(ob, ',') AS only_b, array_to_string(bo, ',') AS \"both\" FROM pl",
    "compare_text": _P + f"""SELECT job_id, '#' || a || ' is ' || printf('%.1f', abs(delta)) || ' points above #' || b || CASE WHEN len(oa) > 0 THEN '; only #' || a || ' shows ' || {_LIST.format('oa')} ELSE '' END
        || CASE WHEN len(ob) > 0 THEN '; only #' || b || ' shows ' || {_LIST.format('ob')} ELSE '' END AS text FROM pl WHERE rb <= 2""",
    "movements": """WITH v AS (SELECT * FROM ranked_candidates WHERE job_id IS NOT NULL AND resume_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 100),
        n AS (SELECT *, row_number() OVER (PARTITION BY job_id, resume_id ORDER BY scored_at, loaded_at, ranking_id) AS f, row_number() OVER (PARTITION BY job_id, resume_id ORDER BY scored_at DESC, loaded_at DESC, ranking_id DESC) AS l FROM v),
        e AS (SELECT a.job_id, a.resume_id, a.score AS sa, b.score AS sb FROM n a JOIN n b ON a.job_id = b.job_id AND a.resume_id = b.resume_id AND a.f = 1 AND b.l = 1),
        r AS (SELECT job_id, resume_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY sa DESC, resume_id) AS INTEGER) AS was, CAST(row_number() OVER (PARTITION BY job_id ORDER BY sb DESC, resume_id) AS INTEGER) AS now FROM e)
        SELECT *, abs(was - now) AS moved FROM r WHERE was <> now""",
    "dashboard": _R + "fin AS (SELECT 1) SELECT job_id, count(*) AS total, count(*) FILTER (WHERE status = 'shortlisted') AS shortlisted, count(*) FILTER (WHERE status = 'flagged') AS flagged, sum(CAST(round(score * 100) AS BIGINT))::BIGINT / count(*) / 100 AS avg_score FROM dash GROUP BY job_id",
    "cohort_relative": _R + """st AS (SELECT job_id, avg(score) AS m, max(score) AS b, avg(years) AS y FROM rk GROUP BY job_id)
        SELECT job_id, resume_id, concat_ws('; ', CASE WHEN score >= b THEN 'best score of the pool' END, CASE WHEN score > m + 5 THEN 'above the pool''s mean' END, CASE WHEN years > y * 1.25 THEN 'more experience than most' END) AS strengths,
        concat_ws('; ', CASE WHEN score < m - 5 THEN 'below the pool''s mean' END, CASE WHEN years < y * 0.5 THEN 'less experience than most' END) AS weaknesses FROM rk JOIN st USING (job_id)""",
    "gap_counts": _R + "g AS (SELECT job_id, skill_key, count(*) AS lack FROM tiers WHERE status = 'missing' GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY lack DESC, skill_key) AS INTEGER) AS place FROM g) WHERE place <= 3",
    "skill_gap_report": _R + "fin AS (SELECT 1) SELECT job_id, skill_key, have, pool, round(100 * have / pool, 0) AS pct, CASE WHEN 100 * have / pool < 40 THEN 'CRITICAL' WHEN 100 * have / pool < 70 THEN 'MODERATE' ELSE 'WELL COVERED' END AS label FROM cover WHERE kind = 'required'",
    "ranked_report": _R + """j AS (SELECT rk.job_id, rk.resume_id, rank, score, coalesce(required_met, 0) AS required_met, coalesce(required_partial, 0) AS required_partial, coalesce(required_total, 0) AS required_total FROM rk LEFT JOIN roll USING (job_id, resume_id))
        SELECT *, CASE WHEN score >= 72 AND required_total = required_met + required_partial THEN 'strong match' WHEN score >= 60 THEN 'good match' WHEN score >= 45 THEN 'partial match' WHEN score >= 30 THEN 'weak match' ELSE 'poor match' END AS verdict FROM j""",
    "top_missing_lists": _R + f"""ms AS (SELECT job_id, resume_id, list_sort(list(skill_key)) AS m FROM tiers WHERE kind = 'required' AND status = 'missing' GROUP BY 1, 2), j AS (SELECT rk.job_id, rk.resume_id, rank, coalesce(m, []) AS m FROM rk LEFT JOIN ms USING (job_id, resume_id) WHERE rank <= 3)
        SELECT job_id, resume_id, rank, {_LIST.format('m')} AS missing FROM j""",
    "collapse_renumber": _R + """w AS (SELECT *, row_number() OVER (PARTITION BY job_id, coalesce(nullif(trim(identity_group), ''), 'id ' || resume_id) ORDER BY rank) AS n FROM rk)
        SELECT job_id, resume_id, rank AS was, CAST(row_number() OVER (PARTITION BY job_id ORDER BY rank) AS INTEGER) AS rank FROM w WHERE n = 1""",
}
QUERIES = {n: globals()[n] for n in SQL}
