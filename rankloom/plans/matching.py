"""Queries of skill matching, scoring and ranking over the pairs that ranked_candidates lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import Sliders, Weights
from ..operators import lexical, matching as M
from ..operators.skills import SQL_SURFACES
from ..session import cut, table
from . import retrieval, texts


def _t(spark, d):
    return lambda n: table(spark, d, n)


def latest(spark: SparkSession, d: str) -> DataFrame:
    """One row a job and resume: the one scored last."""
    rows = table(spark, d, "ranked_candidates").where("job_id is not null and resume_id is not null")
    v = F.struct("scored_at", "loaded_at", "ranking_id")
    keep = ["score", "subscores", "is_duplicate", "confidence", "doc_id", "identity_group"]
    return rows.groupBy("job_id", "resume_id").agg(F.max(F.struct(v.alias("v"), *[F.struct(*keep).alias("k")])).alias("x")).select("job_id", "resume_id", *[F.col(f"x.k.{c}").alias(c) for c in keep])


def have(spark, d):
    """(resume_id, skill_key): the skills each resume lists or names in its text."""
    listed = M.resume_skills(table(spark, d, "resumes"), table(spark, d, "skill_ontology"))
    return cut(listed.unionByName(texts.text_skills(spark, d).select("resume_id", "skill_key")).distinct())


def _tiers(spark, d, demanded=None, held=None):
    t = _t(spark, d)
    pairs = t("ranked_candidates").where("job_id is not null and resume_id is not null").select("job_id", "resume_id").distinct()
    probes = M.resolved(t("skill_matches").where("status = 'semantic'").select("job_id", "resume_id", "canonical"), "canonical", t("skill_ontology")).where("skill_key is not null")
    return M.match_tiers(pairs, M.job_skills(t("requirements"), t("skill_ontology")) if demanded is None else demanded, have(spark, d) if held is None else held, t("skill_ontology"), probes)


def surface_lookup(spark, d):
    return M.surfaces(table(spark, d, "skill_ontology"))


def resolve_skill_names(spark, d):
    t = _t(spark, d)
    return M.resolved(t("requirements").select("requirement_id", F.explode(F.array_distinct("skills")).alias("v")).where("v is not null"), "v", t("skill_ontology")).select("requirement_id", "v", "skill_key")


def related_edges(spark, d):
    return M.related_edges(table(spark, d, "skill_ontology"))


def job_skills(spark, d):
    return M.job_skills(table(spark, d, "requirements"), table(spark, d, "skill_ontology"))


def skill_match_tiers(spark, d):
    return _tiers(spark, d).select("job_id", "resume_id", "skill_key", "kind", "status", "credit", "via")


def coverage(spark, d):
    c = M.coverage(_tiers(spark, d))
    return c.select("job_id", "resume_id", M.half_up(F.col("required"), 5).alias("required"), M.half_up(F.col("preferred"), 5).alias("preferred"), "n_required")


def hard_ratio(spark, d):
    return M.coverage(_tiers(spark, d)).select("job_id", "resume_id", "n_hard", F.round("exact_ratio", 5).alias("exact_ratio"))


def _years():
    return F.when(F.isnan("years_experience") | ~F.col("years_experience").between(0, 45), 0.0).otherwise(F.coalesce("years_experience", F.lit(0.0)))


def _features(spark, d, demanded=None, held=None):
    t = _t(spark, d)
    people = t("resumes").select("resume_id", "name", _years().alias("years"), F.coalesce("education_level", F.lit(0)).alias("education"))
    jobs = t("jobs").select("job_id", F.coalesce("min_years", F.lit(0.0)).alias("need"), "seniority")
    rows = latest(spark, d).drop("doc_id").join(people, "resume_id").join(jobs, "job_id")
    rows = rows.withColumn("experience", M.experience_fit(F.col("years"), F.col("need"), F.col("seniority"), F.col("education")))
    cover = M.coverage(_tiers(spark, d, demanded, held)).select("job_id", "resume_id", "required", "preferred", "exact_ratio")
    rows = rows.join(cover, ["job_id", "resume_id"], "left")
    sub = lambda n: F.coalesce(F.when(~F.isnan(f"subscores.{n}"), F.col(f"subscores.{n}")), F.lit(0.0))
    return rows.select(
        "job_id", "resume_id", "name", "is_duplicate", "experience", F.coalesce("required", F.lit(0.0)).alias("required"), F.coalesce("preferred", F.lit(0.5)).alias("preferred"),
        F.coalesce("exact_ratio", F.lit(1.0)).alias("exact_ratio"), sub("semantic").alias("semantic"), sub("lexical").alias("lexical"),
    )


def experience_fit(spark, d):
    return _features(spark, d).select("job_id", "resume_id", F.round("experience", 3).alias("experience"))


def _score(w: Weights):
    c = F.col
    return M.fused(c("required"), c("semantic"), c("lexical"), c("preferred"), c("experience"), c("exact_ratio"), w)


def fusion_rank(spark, d):
    scored = _features(spark, d).withColumn("score", F.round(_score(Weights()), 1))
    return M.final_rank(scored).select("job_id", "resume_id", "score", "rank")


def keyword_composite(spark, d):
    c = F.col
    return _features(spark, d).select("job_id", "resume_id", F.round(M.keyword_composite(c("required"), c("preferred"), c("lexical")), 4).alias("keyword"))


def keyword_match_ratio(spark, d):
    """Exactly matched demanded skills over all; 0 for none demanded."""
    t = _tiers(spark, d).groupBy("job_id", "resume_id").agg(F.count_if(F.col("status") == "exact").alias("matched"), F.count("*").alias("n"))
    return t.select("job_id", "resume_id", "matched", F.round(F.coalesce(F.try_divide("matched", "n"), F.lit(0.0)), 5).alias("ratio"))


def slider_weights(spark, d):
    """The five weights for some knob positions."""
    rows = []
    for k, s, e in ((0.62, 0.26, 0.12), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.3, 0.3, 0.3), (0.0, 0.0, 0.0)):
        w = Sliders(k, s, e).weights()
        rows.append((k, s, e, *[round(x, 6) for x in (w.required, w.semantic, w.lexical, w.preferred, w.experience)]))
    return spark.createDataFrame(rows, "keyword double, semantic_knob double, experience_knob double, required double, semantic double, lexical double, preferred double, experience double")


def reweight_movements(spark, d):
    """Rank changes when only the weights move: sub-scores are computed once, fusion and rank twice."""
    base = cut(_features(spark, d))
    a = M.final_rank(base.withColumn("score", F.round(_score(Weights()), 1))).select("job_id", "resume_id", F.col("rank").alias("was"))
    b = M.final_rank(base.withColumn("score", F.round(_score(Sliders(0.2, 0.2, 0.6).weights()), 1))).select("job_id", "resume_id", F.col("rank").alias("now"))
    return a.join(b, ["job_id", "resume_id"]).where("was <> now").select("job_id", "resume_id", "was", "now", (F.col("was") - F.col("now")).alias("delta"))


def _lexical(spark, d, more=None):
    """(job_id, resume_id, normalised, more): BM25 of the ranked pairs over the whole pool, also for other bags if given; computed once."""
    jobs = table(spark, d, "jobs").select("job_id")
    return lexical.bm25_listed(retrieval.pool(spark, d), retrieval.bags(spark, d), retrieval.ranked_pairs(spark, d), "resume_id", "raw_text", "job_id", jobs, more)


def _live(features, lex, column="normalised"):
    """The features with the lexical part scored anew."""
    f = features.drop("lexical").join(lex.select("job_id", "resume_id", F.col(column).alias("lexical")), ["job_id", "resume_id"], "left")
    return f.withColumn("lexical", F.coalesce("lexical", F.lit(0.0))).withColumn("score", F.round(_score(Weights()), 1))


def pipeline_rank(spark, d):
    """Texts to ranks: skills and BM25 from the texts, experience, fusion; the semantic part is that of the stored encoder."""
    return M.final_rank(_live(_features(spark, d), _lexical(spark, d))).select("job_id", "resume_id", F.round("lexical", 4).alias("lexical"), "score", "rank")


def rerank_with(spark, d, skills: list[str]):
    """(job_id, resume_id, was, now, delta): who moves when every job also requires these skills; the BM25 query and the coverage are fitted anew."""
    jobs, base = table(spark, d, "jobs").select("job_id"), M.job_skills(table(spark, d, "requirements"), table(spark, d, "skill_ontology"))
    names = table(spark, d, "skill_ontology").where(F.col("skill_key").isin(*skills)).select("skill_key", "canonical")
    extra = jobs.crossJoin(names).select("job_id", "skill_key", F.lit("required").alias("kind"))  # one row a job and named skill
    merged = base.join(extra.select("job_id", "skill_key"), ["job_id", "skill_key"], "left_anti").unionByName(extra)
    words = lexical.weighted_bag(jobs.crossJoin(names).select("job_id", F.col("canonical").alias("text"), F.lit(3.0).alias("w")), "text", "w", ("job_id",))
    more = retrieval.bags(spark, d).unionByName(words).groupBy("job_id", "term").agg(F.max("weight").alias("weight"))
    lex, held = _lexical(spark, d, more), have(spark, d)
    was = M.final_rank(_live(_features(spark, d, held=held), lex)).select("job_id", "resume_id", F.col("rank").alias("was"))
    now = M.final_rank(_live(_features(spark, d, merged, held), lex, "more")).select("job_id", "resume_id", F.col("rank").alias("now"))
    return was.join(now, ["job_id", "resume_id"]).where("was <> now").select("job_id", "resume_id", "was", "now", (F.col("was") - F.col("now")).alias("delta"))


def extra_requirement_rerank(spark, d):
    return rerank_with(spark, d, ["python"])


def legacy_rank(spark, d):
    """By falling score, then file name, within each job."""
    rows = latest(spark, d).where("score is not null and not isnan(score)")
    from ..operators.ranking import ranked

    return ranked(rows, [F.col("score").desc(), F.coalesce("doc_id", F.lit("")).asc(), F.col("resume_id").asc()], "job_id").select("job_id", "resume_id", "rank")


_SURF = SQL_SURFACES


def _res(src: str, value: str) -> str:
    f = f"trim(regexp_replace(lower({value}), '[\\s_-]+', ' ', 'g'))"
    return f"(SELECT x.*, coalesce(a.skill_key, b.skill_key) AS skill_key FROM ({src}) x LEFT JOIN surf a ON a.surface = {f} LEFT JOIN surf b ON b.surface = replace({f}, '.', ''))"


_L = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, resume_id ORDER BY scored_at DESC NULLS LAST, loaded_at DESC NULLS LAST, ranking_id DESC) AS n
  FROM ranked_candidates WHERE job_id IS NOT NULL AND resume_id IS NOT NULL) WHERE n = 1)
"""
_B = f"""
WITH RECURSIVE {texts.SCAN_CTES}, {_L},
edges AS (SELECT skill_key, unnest(related) AS neighbour FROM skill_ontology),
rel AS (SELECT skill_key, neighbour FROM edges WHERE skill_key <> neighbour UNION SELECT neighbour, skill_key FROM edges WHERE skill_key <> neighbour),
demanded AS (SELECT job_id, skill_key, CASE WHEN bool_or(kind = 'required') THEN 'required' ELSE 'preferred' END AS kind FROM {_res("SELECT job_id, kind, unnest(skills) AS v FROM requirements", "v")} WHERE skill_key IS NOT NULL GROUP BY job_id, skill_key),
have AS MATERIALIZED (SELECT resume_id, skill_key FROM {_res("SELECT resume_id, unnest(skills) AS v FROM resumes", "v")} WHERE skill_key IS NOT NULL UNION SELECT resume_id, skill_key FROM sk_best),
probes AS (SELECT DISTINCT job_id, resume_id, skill_key FROM {_res("SELECT job_id, resume_id, canonical FROM skill_matches WHERE status = 'semantic'", "canonical")} WHERE skill_key IS NOT NULL),
pairs AS (SELECT DISTINCT job_id, resume_id FROM ranked_candidates WHERE job_id IS NOT NULL AND resume_id IS NOT NULL),
near AS (SELECT resume_id, rel.skill_key, min(have.skill_key) AS via FROM have JOIN rel ON rel.neighbour = have.skill_key GROUP BY 1, 2),
tiers0 AS (
  SELECT p.job_id, p.resume_id, d.skill_key, d.kind, o.importance, n.via,
    CASE WHEN h.skill_key IS NOT NULL THEN 'exact' WHEN n.via IS NOT NULL THEN 'related' WHEN q.skill_key IS NOT NULL THEN 'semantic' ELSE 'missing' END AS status
  FROM pairs p JOIN demanded d USING (job_id) JOIN skill_ontology o ON o.skill_key = d.skill_key
  LEFT JOIN have h ON h.resume_id = p.resume_id AND h.skill_key = d.skill_key LEFT JOIN near n ON n.resume_id = p.resume_id AND n.skill_key = d.skill_key
  LEFT JOIN probes q ON q.job_id = p.job_id AND q.resume_id = p.resume_id AND q.skill_key = d.skill_key
),
tiers AS (SELECT job_id, resume_id, skill_key, kind, status, importance, CASE status WHEN 'exact' THEN 1.0::DOUBLE WHEN 'related' THEN 0.55 WHEN 'semantic' THEN 0.35 ELSE 0 END AS credit, CASE WHEN status = 'related' THEN via END AS via FROM tiers0),
cov AS (
  SELECT job_id, resume_id, sum(credit * importance) FILTER (WHERE kind = 'required') / sum(importance) FILTER (WHERE kind = 'required') AS required,
    sum(credit * importance) FILTER (WHERE kind = 'preferred') / sum(importance) FILTER (WHERE kind = 'preferred') AS preferred,
    count(*) FILTER (WHERE kind = 'required' AND importance >= 0.9) AS n_hard, count(*) FILTER (WHERE kind = 'required' AND importance >= 0.9 AND status = 'exact') AS n_hit,
    count(*) FILTER (WHERE kind = 'required') AS n_required
  FROM tiers GROUP BY 1, 2
),
people AS (SELECT resume_id, name, coalesce(education_level, 0) AS education, CASE WHEN years_experience IS NULL OR isnan(years_experience) OR years_experience NOT BETWEEN 0 AND 45 THEN 0.0 ELSE years_experience END AS years FROM resumes),
base AS (
  SELECT l.job_id, l.resume_id, name, coalesce(is_duplicate, false) AS dup, years, education, seniority, coalesce(min_years, 0.0) AS need,
    coalesce(c.required, 0.0) AS required, coalesce(c.preferred, 0.5) AS preferred, CASE WHEN c.n_hard > 0 THEN n_hit / n_hard ELSE 1.0 END AS ratio,
    CASE WHEN l.subscores.semantic IS NULL OR isnan(l.subscores.semantic) THEN 0.0 ELSE l.subscores.semantic END AS semantic,
    CASE WHEN l.subscores.lexical IS NULL OR isnan(l.subscores.lexical) THEN 0.0 ELSE l.subscores.lexical END AS lexical
  FROM latest l JOIN people p USING (resume_id) JOIN jobs j ON j.job_id = l.job_id LEFT JOIN cov c ON c.job_id = l.job_id AND c.resume_id = l.resume_id
),
fit AS (
  SELECT *, round(0.78 * (CASE WHEN need <= 0 THEN 0.62 + 0.38 * least(1.0, years / 1.5) WHEN years >= need THEN 1.0 ELSE pow(years / need, 0.7) END)
    * CASE WHEN coalesce(seniority IN ('intern', 'junior'), false) AND years > need + 2 THEN 0.85 ELSE 1.0 END
    + 0.22 * CASE WHEN education >= CASE WHEN seniority = 'intern' THEN 1 ELSE 2 END THEN 1.0 WHEN education > 0 THEN 0.6 ELSE 0.45 END, 4) AS experience
  FROM base
)
"""


def _fuse(w: Weights, name: str) -> str:
    raw = f"100 * (required * {w.required!r} + semantic * {w.semantic!r} + lexical * {w.lexical!r} + preferred * {w.preferred!r} + experience * {w.experience!r})"
    return f"round(round(CAST(CASE WHEN ratio < 0.5 THEN ({raw}) * (0.78 + 0.44 * ratio) ELSE {raw} END AS DOUBLE), 2), 1) AS {name}"


_RANK = "CAST(row_number() OVER (PARTITION BY job_id ORDER BY {} DESC, dup, coalesce(name, ''), resume_id) AS INTEGER)"
_SL = [(k, s, e, Sliders(k, s, e).weights()) for k, s, e in ((0.62, 0.26, 0.12), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.3, 0.3, 0.3), (0.0, 0.0, 0.0))]


def _renamed(sql: str, names: str) -> str:
    return re.sub(rf"(?<![\w.'])({names})(?=[ .,)\n])", r"\1x", sql)


#: BM25 beside the CTEs above, and both once more for a job that also requires one skill.
_LEX = retrieval.LEX_CTES + """, lx AS (SELECT job_id, resume_id, round(least(1.0, sum(score) / max(sum(score)) OVER (PARTITION BY job_id)), 4) AS lex FROM part_scores GROUP BY job_id, resume_id),
live AS (SELECT f.* REPLACE (coalesce(lex, 0.0) AS lexical) FROM fit f LEFT JOIN lx ON lx.job_id = f.job_id AND lx.resume_id = f.resume_id)
"""
_MORE = ", more AS (SELECT job_id, skill_key, kind FROM demanded WHERE skill_key <> 'python' UNION ALL SELECT job_id, 'python', 'required' FROM jobs),\n" + _renamed(_B[_B.index("tiers0 AS ("):].replace("JOIN demanded d", "JOIN more d"), "tiers0|tiers|cov|people|base|fit") + """,
bagx AS (SELECT job_id, term, max(weight) AS weight FROM (SELECT job_id, term, weight FROM bag UNION ALL SELECT job_id, 'python', 3.0 FROM jobs) GROUP BY 1, 2),
""" + _renamed(retrieval.LEX_CTES[retrieval.LEX_CTES.index("part_scores AS ("):], "part_scores|bag") + _renamed(_LEX[len(retrieval.LEX_CTES):], "lx|live|part_scores|fit")
SQL = {
    "surface_lookup": f"WITH {_SURF} SELECT * FROM surf",
    "resolve_skill_names": f"WITH {_SURF} SELECT requirement_id, v, skill_key FROM {_res('SELECT DISTINCT requirement_id, unnest(skills) AS v FROM requirements', 'v')} WHERE v IS NOT NULL",
    "related_edges": _B + "SELECT skill_key, neighbour FROM rel",
    "job_skills": _B + "SELECT job_id, skill_key, kind FROM demanded",
    "skill_match_tiers": _B + "SELECT job_id, resume_id, skill_key, kind, status, credit, via FROM tiers",
    "coverage": _B + "SELECT job_id, resume_id, round(required, 5) AS required, round(preferred, 5) AS preferred, n_required FROM cov",
    "hard_ratio": _B + "SELECT job_id, resume_id, n_hard, round(CASE WHEN n_hard > 0 THEN n_hit / n_hard ELSE 1.0 END, 5) AS exact_ratio FROM cov",
    "experience_fit": _B + "SELECT job_id, resume_id, round(experience, 3) AS experience FROM fit",
    "fusion_rank": _B + f", s AS (SELECT *, {_fuse(Weights(), 'score')} FROM fit) SELECT job_id, resume_id, score, {_RANK.format('score')} AS rank FROM s",
    "keyword_composite": _B + "SELECT job_id, resume_id, round((required * 0.34 + preferred * 0.12 + lexical * 0.16) / 0.62, 4) AS keyword FROM fit",
    "keyword_match_ratio": _B + "SELECT job_id, resume_id, count(*) FILTER (WHERE status = 'exact') AS matched, round(count(*) FILTER (WHERE status = 'exact') / count(*), 5) AS ratio FROM tiers GROUP BY 1, 2",
    "slider_weights": " UNION ALL ".join(
        f"SELECT {k}::DOUBLE AS keyword, {s}::DOUBLE AS semantic_knob, {e}::DOUBLE AS experience_knob, "
        f"coalesce(round({k} / nullif({k} + {s} + {e}, 0) * 0.34 / 0.62, 6), 0.0)::DOUBLE AS required, coalesce(round({s} / nullif({k} + {s} + {e}, 0), 6), 0.0)::DOUBLE AS semantic, "
        f"coalesce(round({k} / nullif({k} + {s} + {e}, 0) * 0.16 / 0.62, 6), 0.0)::DOUBLE AS lexical, coalesce(round({k} / nullif({k} + {s} + {e}, 0) * 0.12 / 0.62, 6), 0.0)::DOUBLE AS preferred, "
        f"coalesce(round({e} / nullif({k} + {s} + {e}, 0), 6), 0.0)::DOUBLE AS experience" for k, s, e, _ in _SL),
    "reweight_movements": _B + f", s AS (SELECT *, {_fuse(Weights(), 'sa')}, {_fuse(Sliders(0.2, 0.2, 0.6).weights(), 'sb')} FROM fit), r AS (SELECT job_id, resume_id, {_RANK.format('sa')} AS was, {_RANK.format('sb')} AS now FROM s) SELECT *, was - now AS delta FROM r WHERE was <> now",
    "pipeline_rank": _B + ", " + _LEX + f", s AS (SELECT *, {_fuse(Weights(), 'score')} FROM live) SELECT job_id, resume_id, lexical, score, {_RANK.format('score')} AS rank FROM s",
    "extra_requirement_rerank": _B + ", " + _LEX + _MORE + f""", sa AS (SELECT *, {_fuse(Weights(), 'score')} FROM live), sb AS (SELECT *, {_fuse(Weights(), 'score')} FROM livex),
        ra AS (SELECT job_id, resume_id, {_RANK.format('score')} AS was FROM sa), rb AS (SELECT job_id, resume_id, {_RANK.format('score')} AS now FROM sb)
        SELECT job_id, resume_id, was, now, was - now AS delta FROM ra JOIN rb USING (job_id, resume_id) WHERE was <> now""",
    "legacy_rank": f"WITH {_L} SELECT job_id, resume_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY score DESC, coalesce(doc_id, ''), resume_id) AS INTEGER) AS rank FROM latest WHERE score IS NOT NULL AND NOT isnan(score)",
}
QUERIES = {n: globals()[n] for n in SQL}
