"""Answers to the questions of the chat documents about the ranking of their job, one query an intent, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import chat as C, explain as X, skills as S, views as V
from ..session import cut, table
from .explain import _CMP, _CTEXT, _EXPL, _X, _sides, explained
from .matching import _tiers, have
from .texts import _q
from .views import _R, flags, ranking


def questions(spark, d) -> DataFrame:
    """The chat documents of a job, parsed."""
    docs = table(spark, d, "documents").where("doc_kind = 'chat' and text is not null and job_id is not null")
    return C.parsed(docs, "doc_id", "text", table(spark, d, "skill_ontology"), "job_id")


def _asking(spark, d, intent):
    return cut(questions(spark, d).where(F.col("intent") == intent))


def _pool(spark, d):
    return ranking(spark, d).select("job_id", "resume_id", "rank", "score", "years", "fresher", "confidence", "name")


def _owned(spark, d, q):
    """(doc_id, resume_id, matched): of each question's skills how many a resume has, for those that have any."""
    return q.select("doc_id", F.explode("asked").alias("skill_key")).join(have(spark, d), "skill_key").groupBy("doc_id", "resume_id").agg(F.count("*").alias("matched"))


def _first(rows, order, n):
    """The first n rows of each question; one job's pool is what a question ranks."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).where(F.col("place") <= n)


def chat_parse(spark, d):
    return questions(spark, d).select("doc_id", "intent", F.array_join("asked", ",").alias("asked"), "years", "at_most", "beginners", "n")


def chat_who_has(spark, d):
    """Those who name any asked skill, most matches first, then by rank; eight are shown."""
    q = _asking(spark, d, "who_has").where(F.size("asked") > 0)
    rows = q.select("doc_id", "job_id").join(_pool(spark, d), "job_id").join(_owned(spark, d, q), ["doc_id", "resume_id"])
    return _first(rows, [F.col("matched").desc(), "rank"], 8).select("doc_id", "place", "resume_id", "rank", "matched")


def chat_who_lacks(spark, d):
    """Those who don't name all asked skills: how many, and the first ten by rank."""
    q = _asking(spark, d, "who_lacks").where(F.size("asked") > 0)
    rows = q.select("doc_id", "job_id", F.size("asked").alias("k")).join(_pool(spark, d), "job_id").join(_owned(spark, d, q), ["doc_id", "resume_id"], "left").where(F.coalesce("matched", F.lit(0)) < F.col("k"))
    return _first(rows, ["rank"], 10).select("doc_id", "place", "resume_id", "rank")


def chat_filter(spark, d):
    """Those who pass the stated years, beginners only, and all asked skills; ranks are those of the pool."""
    q = _asking(spark, d, "filter").where("years is not null or beginners or size(asked) > 0")
    rows = q.select("doc_id", "job_id", F.col("years").alias("y"), "at_most", "beginners", F.size("asked").alias("k")).join(_pool(spark, d), "job_id").join(_owned(spark, d, q), ["doc_id", "resume_id"], "left")
    bound = F.col("y").isNull() | F.when(F.col("at_most"), F.col("years") <= F.col("y")).otherwise(F.col("years") >= F.col("y"))
    return rows.where(bound & (~F.col("beginners") | F.col("fresher")) & (F.coalesce("matched", F.lit(0)) >= F.col("k"))).select("doc_id", "resume_id", "rank")


def chat_best(spark, d):
    """The first n of the job, as many as the question asks for."""
    q = _asking(spark, d, "best")
    return q.select("doc_id", "job_id", "n").join(_pool(spark, d), "job_id").where("rank <= n").select("doc_id", "resume_id", "rank")


def chat_gaps(spark, d):
    """The eight required skills of the job that fewest name, and which are scarce (C4)."""
    q = _asking(spark, d, "gaps")
    cover = V.pool_coverage(_tiers(spark, d)).where("kind = 'required'")
    rows = q.select("doc_id", "job_id").join(cover, "job_id")
    return _first(rows, ["pct", "skill_key"], 8).select("doc_id", "place", "skill_key", "have", "pool", "pct", (F.col("pct") < C.SCARCE).alias("scarce"))


def chat_flags(spark, d):
    """The first ten flagged candidates of the job with their flags, the worst first."""
    q = _asking(spark, d, "flags")
    f = flags(spark, d).groupBy("job_id", "resume_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(V.severity_rank(F.col("severity")).alias("o"), "code"))), lambda x: x["code"]), ",").alias("codes"))
    rows = q.select("doc_id", "job_id").join(_pool(spark, d), "job_id").join(f, ["job_id", "resume_id"])
    return _first(rows, ["rank"], 10).select("doc_id", "place", "resume_id", "rank", "codes")


def chat_confidence(spark, d):
    """The eight candidates of best evidence, and those of the first five that rank well but are thin."""
    q = _asking(spark, d, "confidence")
    rows = q.select("doc_id", "job_id").join(_pool(spark, d), "job_id")
    sure = _first(rows.where("confidence is not null"), [F.col("confidence").desc(), "rank"], 8).select("doc_id", F.lit("convincing").alias("part"), "resume_id", "rank")
    thin = rows.where((F.col("rank") <= 5) & (F.col("confidence") < C.THIN)).select("doc_id", F.lit("thin").alias("part"), "resume_id", "rank")
    return sure.unionByName(thin)


def chat_explain(spark, d):
    """The explanation of the candidate whose rank a question names."""
    q = _asking(spark, d, "explain").select("doc_id", "job_id", F.try_element_at("refs", F.lit(1)).alias("rank")).where("rank is not null")
    of = q.join(ranking(spark, d).select("job_id", "resume_id", "rank"), ["job_id", "rank"])
    return of.select("doc_id", "job_id", "resume_id").join(explained(spark, d, of), ["job_id", "resume_id"]).select("doc_id", "resume_id", "explanation")


def chat_compare(spark, d):
    """Why the better of the two candidates that a question names by rank stands above the other."""
    q = _asking(spark, d, "compare").where("size(refs) >= 2").select("doc_id", "job_id", F.least(F.col("refs")[0], F.col("refs")[1]).alias("ra"), F.greatest(F.col("refs")[0], F.col("refs")[1]).alias("rb")).where("ra < rb")
    ends = q.select("job_id", F.explode(F.array("ra", "rb")).alias("rank")).distinct()
    s = cut(_sides(spark, d, ranking(spark, d).join(ends, ["job_id", "rank"])))
    a, b = s.select("job_id", F.col("rank").alias("ra"), F.col("x").alias("a")), s.select("job_id", F.col("rank").alias("rb"), F.col("x").alias("b"))
    return q.join(a, ["job_id", "ra"]).join(b, ["job_id", "rb"]).select("doc_id", X.comparison(F.col("a"), F.col("b")).alias("text"))


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(text, '{_q(p)}') THEN '{k}'" for k, p in C.INTENTS) + " ELSE 'unknown' END"
_QS = S.sql_mentions("(SELECT doc_id, 'skills' AS label, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no FROM documents WHERE doc_kind = 'chat' AND text IS NOT NULL AND job_id IS NOT NULL)", "doc_id", "cq") + f""",
asks AS (SELECT DISTINCT doc_id, skill_key FROM cq_hits),
qs AS MATERIALIZED (SELECT doc_id, job_id, {_INTENT} AS intent, TRY_CAST(nullif(regexp_extract(text, '{C.YEARS}', 1), '') AS DOUBLE) AS y, regexp_matches(text, '{C.AT_MOST}') AS at_most, regexp_matches(text, '{C.BEGINNERS}') AS beginners,
  greatest(1, coalesce(TRY_CAST(nullif(regexp_extract(text, '{C.TOP}', 1), '') AS INTEGER), 3)) AS n, list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) < 7), lambda x: CAST(x AS INTEGER)) AS refs,
  (SELECT count(*) FROM asks a WHERE a.doc_id = documents.doc_id) AS k FROM documents WHERE doc_kind = 'chat' AND text IS NOT NULL AND job_id IS NOT NULL),
od AS (SELECT a.doc_id, h.resume_id, count(*) AS matched FROM asks a JOIN have h USING (skill_key) GROUP BY 1, 2)
"""
_CH = _R + _QS.lstrip()
_CX = _X.rstrip() + ", " + _QS.lstrip()
_TOP = "SELECT {} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {}) AS INTEGER) AS place FROM an) WHERE place <= {}".format
SQL = {
    "chat_parse": _CH + "SELECT doc_id, intent, coalesce((SELECT array_to_string(list_sort(list(skill_key)), ',') FROM asks a WHERE a.doc_id = qs.doc_id), '') AS asked, y AS years, at_most, beginners, n FROM qs",
    "chat_who_has": _CH + ", an AS (SELECT q.doc_id, rk.resume_id, rank, matched FROM qs q JOIN rk USING (job_id) JOIN od ON od.doc_id = q.doc_id AND od.resume_id = rk.resume_id WHERE intent = 'who_has') " + _TOP("doc_id, place, resume_id, rank, matched", "matched DESC, rank", 8),
    "chat_who_lacks": _CH + ", an AS (SELECT q.doc_id, rk.resume_id, rank FROM qs q JOIN rk USING (job_id) LEFT JOIN od ON od.doc_id = q.doc_id AND od.resume_id = rk.resume_id WHERE intent = 'who_lacks' AND k > 0 AND coalesce(matched, 0) < k) " + _TOP("doc_id, place, resume_id, rank", "rank", 10),
    "chat_filter": _CH + """SELECT q.doc_id, rk.resume_id, rank FROM qs q JOIN rk USING (job_id) LEFT JOIN od ON od.doc_id = q.doc_id AND od.resume_id = rk.resume_id WHERE intent = 'filter' AND (y IS NOT NULL OR beginners OR k > 0)
        AND (y IS NULL OR CASE WHEN at_most THEN years <= y ELSE years >= y END) AND (NOT beginners OR fresher) AND coalesce(matched, 0) >= k""",
    "chat_best": _CH + "SELECT qs.doc_id, resume_id, rank FROM qs JOIN rk USING (job_id) WHERE intent = 'best' AND rank <= n",
    "chat_gaps": _CH + ", an AS (SELECT doc_id, skill_key, have, pool, round(100 * have / pool, 1) AS pct FROM qs JOIN cover USING (job_id) WHERE intent = 'gaps' AND kind = 'required') " + _TOP(f"doc_id, place, skill_key, have, pool, pct, pct < {C.SCARCE} AS scarce", "pct, skill_key", 8),
    "chat_flags": _CH + """, fc AS (
        SELECT job_id, resume_id, 'seniority_mismatch' AS code, CASE WHEN years > ceil_y + 2 THEN 0 ELSE 1 END AS o FROM fl0 WHERE years > ceil_y UNION ALL SELECT job_id, resume_id, 'duplicate_resume', 1 FROM fl0 WHERE dup
        UNION ALL SELECT job_id, resume_id, 'parse_warning', 2 FROM fl0 WHERE len(warnings) > 0 UNION ALL SELECT job_id, resume_id, 'no_skills_found', 1 FROM fl0 WHERE coalesce(len(skills), 0) = 0),
        fj AS (SELECT job_id, resume_id, array_to_string(list(code ORDER BY o, code), ',') AS codes FROM fc GROUP BY 1, 2),
        an AS (SELECT qs.doc_id, rk.resume_id, rank, codes FROM qs JOIN rk USING (job_id) JOIN fj ON fj.job_id = rk.job_id AND fj.resume_id = rk.resume_id WHERE intent = 'flags') """ + _TOP("doc_id, place, resume_id, rank, codes", "rank", 10),
    "chat_confidence": _CH + ", an AS (SELECT qs.doc_id, resume_id, rank, confidence FROM qs JOIN rk USING (job_id) WHERE intent = 'confidence' AND confidence IS NOT NULL) " + _TOP("doc_id, 'convincing' AS part, resume_id, rank", "confidence DESC, rank", 8) + f" UNION ALL SELECT doc_id, 'thin', resume_id, rank FROM an WHERE rank <= 5 AND confidence < {C.THIN}",
    "chat_explain": _CX + f"SELECT q.doc_id, e.resume_id, {_EXPL} AS explanation FROM qs q JOIN xl e ON e.job_id = q.job_id AND e.rank = q.refs[1] WHERE intent = 'explain'",
    "chat_compare": _CX + _CMP.format(pairs="(a.job_id, a.rank, b.rank) IN (SELECT job_id, least(refs[1], refs[2]), greatest(refs[1], refs[2]) FROM qs WHERE intent = 'compare' AND len(refs) >= 2)") + f"SELECT doc_id, {_CTEXT} AS text FROM qs JOIN xp ON xp.job_id = qs.job_id AND ra = least(refs[1], refs[2]) AND rb = greatest(refs[1], refs[2]) WHERE intent = 'compare' AND len(refs) >= 2",
}
QUERIES = {n: globals()[n] for n in SQL}
