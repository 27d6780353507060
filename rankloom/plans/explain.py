"""Queries of the explaining texts and of the scores that user interfaces derive, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Weights
from ..operators import explain as X, views as V
from ..session import cut, table
from .matching import _features, _tiers
from .views import _LIST, _R, ranking


def _cautions():
    """The plain warnings of a row."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.size("warnings"), F.lit(0)) > 0, "parsing warnings - verify manually"), F.when(F.coalesce(F.size("skills"), F.lit(0)) <= 0, "no recognised skills extracted"), F.when(F.coalesce("chars", F.lit(0)) < 400, "very short / possibly unreadable resume")))


def explained(spark, d, of=None):
    """(job_id, resume_id, rank, explanation) of the rows in ``of`` (by default the first three of each job)."""
    r = ranking(spark, d)
    r = r.where("rank <= 3") if of is None else r.join(of.select("job_id", "resume_id").distinct(), ["job_id", "resume_id"])
    m = X.matches(_tiers(spark, d), table(spark, d, "skill_ontology"), r)
    r = r.join(m, ["job_id", "resume_id"], "left").join(table(spark, d, "jobs").select("job_id", "title"), "job_id").join(table(spark, d, "resumes").select("resume_id", F.length("raw_text").alias("chars")), "resume_id")
    none = F.array().cast(r.schema["m"].dataType)
    c = F.col
    return r.withColumn("m", F.coalesce("m", none)).select("job_id", "resume_id", "rank", X.explanation(c("rank"), c("name"), c("score"), c("title"), c("m"), c("years"), c("subscores"), _cautions()).alias("explanation"))


def explanations(spark, d):
    return explained(spark, d)


def _sides(spark, d, r):
    """The rows of ``r`` as structs that ``comparison`` takes."""
    m = X.matches(_tiers(spark, d), table(spark, d, "skill_ontology"), r)
    r = r.join(m, ["job_id", "resume_id"], "left").withColumn("m", F.coalesce("m", F.array().cast(m.schema["m"].dataType)))
    return r.select("job_id", "resume_id", "rank", F.struct("rank", F.coalesce("name", F.lit("unknown")).alias("name"), "score", "years", "subscores", X.picked(F.col("m"), "required", "exact").alias("owned"), X.picked(F.col("m"), "required", "missing").alias("missing")).alias("x"))


def why_above(spark, d):
    """Why each job's first stands above its second."""
    s = cut(_sides(spark, d, ranking(spark, d).where("rank <= 2")))
    a, b = s.where("rank = 1").select("job_id", F.col("x").alias("a")), s.where("rank = 2").select("job_id", F.col("x").alias("b"))
    return a.join(b, "job_id").select("job_id", X.comparison(F.col("a"), F.col("b")).alias("text"))


def contributions(spark, d):
    """The points of each part of the score, and what the lack of hard skills takes away."""
    w = Weights()
    f = _features(spark, d).select("job_id", "resume_id", "exact_ratio", *[(100 * getattr(w, n) * F.col(n)).alias(n) for _, n in X.PARTS])
    total = sum((F.col(n) for _, n in X.PARTS), F.lit(0.0))
    return f.select("job_id", "resume_id", *[F.round(n, 6).alias(n) for _, n in X.PARTS], F.round(F.when(F.col("exact_ratio") < 0.5, total * (0.78 + 0.44 * F.col("exact_ratio")) - total).otherwise(0.0), 2).alias("dampener"))


def plain_explanations(spark, d):
    r = ranking(spark, d).where("rank <= 3")
    m = X.matches(_tiers(spark, d), table(spark, d, "skill_ontology"), r)
    r = r.join(m, ["job_id", "resume_id"], "left").withColumn("m", F.coalesce("m", F.array().cast(m.schema["m"].dataType)))
    sem = F.coalesce(F.when(~F.isnan("subscores.semantic"), F.col("subscores.semantic")), F.lit(0.0))
    return r.select("job_id", "resume_id", X.plain_explanation(F.col("rank"), F.coalesce("name", F.lit("unknown")), F.col("score"), X.picked(F.col("m"), "required", "exact"), X.picked(F.col("m"), "required", "missing"), sem).alias("text"))


def local_scores(spark, d):
    """The interface's own scorer: matched skills of all demanded, overall with the semantic share, status."""
    t = _tiers(spark, d).groupBy("job_id", "resume_id").agg(F.count_if(F.col("status") == "exact").alias("hit"), F.count("*").alias("n"))
    r = ranking(spark, d).join(t, ["job_id", "resume_id"], "left")
    kw = F.floor(100 * F.coalesce("hit", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) + 0.5)
    sem = F.floor(100 * F.coalesce(F.when(~F.isnan("subscores.semantic"), F.col("subscores.semantic")), F.lit(0.0)) + 0.5)
    scored = r.select("job_id", "resume_id", "is_duplicate", kw.alias("keyword"), sem.alias("semantic")).withColumn("overall", F.floor(F.round(F.col("semantic") * 0.65 + F.col("keyword") * 0.35, 6) + 0.5))
    scored = scored.withColumn("mock", F.floor(F.round(F.col("semantic") * 0.7 + F.col("keyword") * 0.3, 6) + 0.5))
    return scored.select(
        "job_id", "resume_id", "keyword", "overall", F.when(F.col("overall") >= 78, "shortlisted").when(F.col("overall") < 60, "flagged").otherwise("review").alias("status"),
        "mock", F.when(F.coalesce("is_duplicate", F.lit(False)), "flagged").when(F.col("mock") >= 80, "shortlisted").otherwise("review").alias("mock_status"))


def bridge_rows(spark, d):
    """Rows as the interface shows them: initials, rounded scores, skills with their state."""
    t = _tiers(spark, d).where("kind = 'required' or status = 'exact'")
    state = F.when(F.col("status") == "exact", F.when(F.col("kind") == "required", "a+").otherwise("c+")).otherwise("b-")
    sk = t.where("status in ('exact', 'missing')").groupBy("job_id", "resume_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(state, F.lit(" "), "skill_key"))), ",").alias("skills"))
    words = F.filter(F.split(F.trim(F.coalesce("name", F.lit(""))), r"\s+"), lambda w: w != "")
    initials = F.when(F.size(words) == 0, "??").otherwise(F.upper(F.concat_ws("", F.transform(F.slice(words, 1, 2), lambda w: F.left(w, F.lit(1))))))
    r = ranking(spark, d).withColumnRenamed("skills", "listed_skills").join(sk, ["job_id", "resume_id"], "left")
    return r.select("job_id", "resume_id", "rank", initials.alias("initials"), F.floor(F.col("score") + 0.5).alias("overall"), F.floor(F.coalesce("confidence", F.lit(0.0)) + 0.5).alias("confidence"), F.coalesce("skills", F.lit("")).alias("skills"))


def legacy_weights(spark, d):
    """Two knobs to three weights, experience keeping its share."""
    rows = []
    for k, s in ((0.5, 0.5), (0.7, 0.3), (1.0, 0.0), (0.0, 0.0)):
        total = (k + s) or 1.0
        rows.append((k, s, round(0.88 * k / total, 6), round(0.88 * s / total, 6), 0.12))
    return spark.createDataFrame(rows, "keyword_knob double, semantic_knob double, keyword double, semantic double, experience double")


def csv_rows(spark, d):
    """The ranked list with the columns of its CSV form (K7)."""
    r = ranking(spark, d)
    loc = local_scores(spark, d).select("job_id", "resume_id", "keyword", "status")
    coh = V.cohort(r).select("job_id", "resume_id", F.array_join("strengths", "; ").alias("strengths"), F.array_join("weaknesses", "; ").alias("weaknesses"))
    own = _tiers(spark, d).where("status = 'exact'").groupBy("job_id", "resume_id").agg(F.array_join(F.array_sort(F.collect_set("skill_key")), ", ").alias("matched"))
    j = r.join(loc, ["job_id", "resume_id"]).join(coh, ["job_id", "resume_id"]).join(own, ["job_id", "resume_id"], "left").join(table(spark, d, "jobs").select("job_id", "title"), "job_id")
    sem = F.round(100 * F.coalesce(F.when(~F.isnan("subscores.semantic"), F.col("subscores.semantic")), F.lit(0.0)), 2)
    return j.select(
        "job_id", F.col("rank").alias("Rank"), F.coalesce("name", F.lit("")).alias("Candidate Name"), F.coalesce("email", F.lit("")).alias("Email"), F.coalesce("title", F.lit("")).alias("Role"), F.col("years").alias("Years Experience"), F.lit("").alias("Previous Companies"),
        F.col("score").alias("Overall Fit Score (%)"), sem.alias("Semantic Alignment (%)"), F.col("keyword").alias("Keyword Coverage (%)"), F.coalesce("confidence", F.lit(0.0)).alias("Model Confidence (%)"), F.col("status").alias("Status"),
        F.col("strengths").alias("Relative Strengths (vs Cohort)"), F.col("weaknesses").alias("Relative Weaknesses (vs Cohort)"), F.coalesce("matched", F.lit("")).alias("Matched Skills"), F.concat(F.lit("Rank "), F.col("rank").cast("string"), F.lit(" of the pool")).alias("AI Recruiter Summary"))


_one = "printf('%.1f', round(CAST({} AS DOUBLE), 1))".format
_plus = "printf('%+.1f', round(CAST({} AS DOUBLE), 1))".format
_sub = "(CASE WHEN {0}.subscores.{1} IS NULL OR isnan({0}.subscores.{1}) THEN 0.0 ELSE {0}.subscores.{1} END)".format


def _names(expr: str, where: str) -> str:
    return f"list_transform(list_filter({expr}, lambda x: {where}), lambda x: x.canonical)"


def _ls(expr: str, n: int = 6) -> str:
    return f"(SELECT {_LIST.format('v')} FROM (SELECT {expr} AS v))" if n == 6 else f"(SELECT {_LIST.format('v').replace('6', str(n))} FROM (SELECT {expr} AS v))"


_W = Weights()
_VERDICT = "CASE WHEN score >= 72 AND len(ms) = 0 THEN 'Strong fit' WHEN score >= 60 THEN 'Good fit' WHEN score >= 45 THEN 'Partial fit' WHEN score >= 30 THEN 'Weak fit' ELSE 'Poor fit' END"
_BREAK = "array_to_string(list_transform(list_sort([" + ", ".join(f"struct_pack(o := -abs(round(100 * {getattr(_W, w)!r} * {_sub('e', p)}, 4)), p := '{p.replace('_', ' ')}', v := round(100 * {getattr(_W, w)!r} * {_sub('e', p)}, 4))" for p, w in X.PARTS) + f"]), lambda x: x.p || ' ' || {_plus('x.v')}), ', ')"
_X = _R + """xm AS (
  SELECT t.job_id, t.resume_id, list(struct_pack(o := CASE status WHEN 'exact' THEN 0 WHEN 'related' THEN 1 WHEN 'semantic' THEN 2 ELSE 3 END, i := -t.importance, c := -credit, canonical := o.canonical, status := status, kind := kind, via_name := v.canonical)
    ORDER BY CASE status WHEN 'exact' THEN 0 WHEN 'related' THEN 1 WHEN 'semantic' THEN 2 ELSE 3 END, -t.importance, -credit, o.canonical) AS m
  FROM tiers t JOIN skill_ontology o USING (skill_key) LEFT JOIN skill_ontology v ON v.skill_key = t.via GROUP BY 1, 2),
""" + f"""xe AS (SELECT e.*, title, length(raw_text) AS chars, coalesce(m, []) AS m FROM rk e JOIN jobs USING (job_id) JOIN (SELECT resume_id, raw_text FROM resumes) USING (resume_id) LEFT JOIN xm USING (job_id, resume_id)),
xl AS (SELECT *, {_names('m', "x.kind = 'required' AND x.status = 'exact'")} AS ex, {_names('m', "x.kind = 'required' AND x.status = 'missing'")} AS ms, len(list_filter(m, lambda x: x.kind = 'required')) AS nr,
  list_transform(list_filter(m, lambda x: x.kind = 'required' AND x.status = 'related'), lambda x: x.canonical || ' (via ' || x.via_name || ')')[1:3] AS rel3, {_names('m', "x.kind = 'required' AND x.status = 'semantic'")} AS se,
  {_names('m', "x.kind = 'required' AND x.status = 'missing' AND x.i <= -0.9")} AS mh, {_names('m', "x.kind = 'required' AND x.status = 'missing' AND x.i > -0.9")} AS mo,
  {_names('m', "x.kind = 'preferred' AND x.status = 'exact'")} AS pe, {_names('m', "x.kind = 'preferred' AND x.status IN ('related', 'semantic')")} AS pi,
  list_filter([CASE WHEN len(warnings) > 0 THEN 'parsing warnings - verify manually' END, CASE WHEN coalesce(len(skills), 0) = 0 THEN 'no recognised skills extracted' END, CASE WHEN coalesce(chars, 0) < 400 THEN 'very short / possibly unreadable resume' END], lambda x: x IS NOT NULL) AS fs FROM xe)
"""
_EXPL = f"""concat_ws(' ', '#' || rank || ' ' || coalesce(name, 'unknown') || ' - ' || {_one('score')} || '/100 (' || {_VERDICT} || ' for ' || coalesce(title, 'this role') || ').',
  CASE WHEN len(ex) > 0 THEN 'Directly matches ' || len(ex) || ' of ' || nr || ' required skills: ' || {_ls('ex')} || '.' ELSE 'Does not name any of the required skills directly.' END,
  CASE WHEN len(rel3) > 0 THEN 'Partial credit on ' || {_ls('rel3', 3)} || ' - adjacent technology, not the exact one asked for.' END, CASE WHEN len(se) > 0 THEN 'Implied ' || se[1] || ' without naming it.' END,
  CASE WHEN len(mh) > 0 THEN 'Missing / no evidence for: ' || {_ls('mh')} || '.' END, CASE WHEN len(mo) > 0 THEN 'Missing but lower-weight: ' || {_ls('mo', 4)} || '.' END, CASE WHEN len(ms) = 0 THEN 'No required skill is entirely unevidenced.' END,
  CASE WHEN len(pe) > 0 THEN 'Also names preferred skills: ' || {_ls('pe', 5)} || '.' END, CASE WHEN len(pi) > 0 THEN 'Weaker, inferred-only signal on ' || {_ls('pi', 4)} || ' - not named outright, treat as unconfirmed.' END,
  'Experience: ' || {_one('years')} || ' yrs.', 'Score breakdown (points out of 100): ' || {_BREAK} || '.', CASE WHEN len(fs) > 0 THEN 'Caution: ' || array_to_string(fs, '; ') || '.' END)"""
_DELTA = "list_sort(list_filter([" + ", ".join(f"struct_pack(o := -abs(round(100 * {getattr(_W, w)!r} * {_sub('a', p)} - 100 * {getattr(_W, w)!r} * {_sub('b', p)}, 4)), p := '{p.replace('_', ' ')}', v := round(100 * {getattr(_W, w)!r} * {_sub('a', p)} - 100 * {getattr(_W, w)!r} * {_sub('b', p)}, 4))" for p, w in X.PARTS) + "], lambda x: x.o <= -0.5))"
_CMP = f""", xa AS (SELECT * REPLACE (coalesce(name, 'unknown') AS name) FROM xl),
xp AS (SELECT a.job_id, a.rank AS ra, b.rank AS rb, a.resume_id AS ida, b.resume_id AS idb, a.name AS na, b.name AS nb, a.score AS sa, b.score AS sb, a.years AS ya, b.years AS yb, a.ms AS ma, b.ms AS mb, {_DELTA} AS df,
  list_sort(list_filter(a.ex, lambda s: NOT list_contains(b.ex, s))) AS oa, list_sort(list_filter(b.ex, lambda s: NOT list_contains(a.ex, s))) AS ob FROM xa a JOIN xa b ON a.job_id = b.job_id AND a.rank < b.rank AND {{pairs}})
"""
_CTEXT = f"""concat_ws(' ', na || ' ranks #' || ra || ' at ' || {_one('sa')} || ' and ' || nb || ' ranks #' || rb || ' at ' || {_one('sb')} || ' - a gap of ' || {_one('round(sa - sb, 4)')} || ' points.',
  CASE WHEN len(df) > 0 THEN 'The biggest driver is ' || df[1].p || ', worth ' || {_plus('df[1].v')} || ' points to ' || na || '.' END, CASE WHEN len(df) > 1 THEN 'Then ' || array_to_string(list_transform(df[2:4], lambda x: x.p || ' ' || {_plus('x.v')}), ', ') || '.' END,
  CASE WHEN len(oa) > 0 THEN na || ' covers ' || {_ls('oa')} || ' which ' || nb || ' does not.' END, CASE WHEN len(ob) > 0 THEN nb || ' does bring ' || {_ls('ob')} || ', but it was not enough to close the gap.' END,
  CASE WHEN len(mb) > len(ma) THEN nb || ' is missing ' || len(mb) || ' required skills (' || {_ls('mb', 4)} || ') against ' || na || '''s ' || len(ma) || '.' END, CASE WHEN abs(ya - yb) >= 0.5 THEN 'Experience: ' || {_one('ya')} || ' yrs vs ' || {_one('yb')} || ' yrs.' END)"""
_LOC = _R + """lt AS (SELECT job_id, resume_id, count(*) FILTER (WHERE status = 'exact') AS hit, count(*) AS n FROM tiers GROUP BY 1, 2),
l0 AS (SELECT rk.*, CAST(floor(100 * coalesce(hit, 0) / greatest(coalesce(n, 0), 1) + 0.5) AS BIGINT) AS keyword, CAST(floor(100 * CASE WHEN subscores.semantic IS NULL OR isnan(subscores.semantic) THEN 0.0 ELSE subscores.semantic END + 0.5) AS BIGINT) AS sem FROM rk LEFT JOIN lt USING (job_id, resume_id)),
l1 AS (SELECT *, CAST(floor(round(sem * 0.65::DOUBLE + keyword * 0.35::DOUBLE, 6) + 0.5) AS BIGINT) AS overall, CAST(floor(round(sem * 0.7::DOUBLE + keyword * 0.3::DOUBLE, 6) + 0.5) AS BIGINT) AS mock FROM l0),
l2 AS (SELECT *, CASE WHEN overall >= 78 THEN 'shortlisted' WHEN overall < 60 THEN 'flagged' ELSE 'review' END AS status FROM l1)
"""
SQL = {
    "explanations": _X + f"SELECT job_id, resume_id, rank, {_EXPL} AS explanation FROM xl e WHERE rank <= 3",
    "why_above": _X + _CMP.format(pairs="a.rank = 1 AND b.rank = 2") + f"SELECT job_id, {_CTEXT} AS text FROM xp",
    "contributions": _R.removesuffix(",\n") + ", ct AS (SELECT job_id, resume_id, ratio, " + ", ".join(f"100 * {getattr(_W, n)!r} * {n} AS {n}" for _, n in X.PARTS) + " FROM fit) SELECT job_id, resume_id, " + ", ".join(f"round({n}, 6) AS {n}" for _, n in X.PARTS)
        + ", round(CAST(CASE WHEN ratio < 0.5 THEN (0.0 + " + " + ".join(n for _, n in X.PARTS) + ") * (0.78 + 0.44 * ratio) - (0.0 + " + " + ".join(n for _, n in X.PARTS) + ") ELSE 0.0 END AS DOUBLE), 2) AS dampener FROM ct",
    "plain_explanations": _X + f"""SELECT job_id, resume_id, concat_ws(chr(10), 'Rank ' || rank || ': ' || coalesce(name, 'unknown') || ' (score: ' || {_one('score')} || ')', CASE WHEN len(ex) > 0 THEN '  Matched required skills: ' || array_to_string(ex, ', ') ELSE '  Matched required skills: none found' END,
        CASE WHEN len(ms) > 0 THEN '  Missing required skills: ' || array_to_string(ms, ', ') ELSE '  All required skills present' END, CASE WHEN {_sub('e', 'semantic')} >= 0.6 THEN '  Strong overall semantic alignment with the JD''s focus.' WHEN {_sub('e', 'semantic')} >= 0.3 THEN '  Moderate semantic alignment - relevant background, some gaps.' ELSE '  Weak semantic alignment with the JD''s overall focus.' END) AS text FROM xl e WHERE rank <= 3""",
    "local_scores": _LOC + "SELECT job_id, resume_id, keyword, overall, status, mock, CASE WHEN dup THEN 'flagged' WHEN mock >= 80 THEN 'shortlisted' ELSE 'review' END AS mock_status FROM l2",
    "bridge_rows": _R + """bs AS (SELECT job_id, resume_id, array_to_string(list_sort(list(CASE WHEN status = 'exact' THEN CASE WHEN kind = 'required' THEN 'a+' ELSE 'c+' END ELSE 'b-' END || ' ' || skill_key)), ',') AS sk FROM tiers WHERE status IN ('exact', 'missing') AND (kind = 'required' OR status = 'exact') GROUP BY 1, 2),
        bw AS (SELECT *, list_filter(regexp_split_to_array(trim(coalesce(name, '')), '\\s+'), lambda w: w <> '') AS w FROM rk)
        SELECT job_id, resume_id, rank, CASE WHEN len(w) = 0 THEN '??' ELSE upper(array_to_string(list_transform(w[1:2], lambda x: left(x, 1)), '')) END AS initials, CAST(floor(score + 0.5) AS BIGINT) AS overall, CAST(floor(coalesce(confidence, 0.0) + 0.5) AS BIGINT) AS confidence, coalesce(sk, '') AS skills FROM bw LEFT JOIN bs USING (job_id, resume_id)""",
    "legacy_weights": " UNION ALL ".join(f"SELECT {k}::DOUBLE AS keyword_knob, {s}::DOUBLE AS semantic_knob, coalesce(round(0.88 * {k} / nullif({k} + {s}, 0), 6), 0.0)::DOUBLE AS keyword, coalesce(round(0.88 * {s} / nullif({k} + {s}, 0), 6), 0.0)::DOUBLE AS semantic, 0.12::DOUBLE AS experience" for k, s in ((0.5, 0.5), (0.7, 0.3), (1.0, 0.0), (0.0, 0.0))),
    "csv_rows": _LOC + """, c0 AS (SELECT job_id, avg(score) AS m, max(score) AS b, avg(years) AS y FROM rk GROUP BY job_id), c1 AS (SELECT job_id, resume_id, array_to_string(list_sort(sk), ', ') AS matched FROM owned)
        SELECT job_id, rank AS "Rank", coalesce(name, '') AS "Candidate Name", coalesce(email, '') AS "Email", coalesce(title, '') AS "Role", years AS "Years Experience", '' AS "Previous Companies", score AS "Overall Fit Score (%)",
        round(100 * CASE WHEN subscores.semantic IS NULL OR isnan(subscores.semantic) THEN 0.0 ELSE subscores.semantic END, 2) AS "Semantic Alignment (%)", keyword AS "Keyword Coverage (%)", coalesce(confidence, 0.0) AS "Model Confidence (%)", status AS "Status",
        concat_ws('; ', CASE WHEN score >= b THEN 'best score of the pool' END, CASE WHEN score > m + 5 THEN 'above the pool''s mean' END, CASE WHEN years > y * 1.25 THEN 'more experience than most' END) AS "Relative Strengths (vs Cohort)",
        concat_ws('; ', CASE WHEN score < m - 5 THEN 'below the pool''s mean' END, CASE WHEN years < y * 0.5 THEN 'less experience than most' END) AS "Relative Weaknesses (vs Cohort)", coalesce(matched, '') AS "Matched Skills", 'Rank ' || rank || ' of the pool' AS "AI Recruiter Summary"
        FROM l2 JOIN c0 USING (job_id) JOIN (SELECT job_id, title FROM jobs) USING (job_id) LEFT JOIN c1 USING (job_id, resume_id)""",
}
QUERIES = {n: globals()[n] for n in SQL}
