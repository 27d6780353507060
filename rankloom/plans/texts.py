"""Queries of text structure, timelines, rules and the question router, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EVIDENCE_WEIGHT
from ..functions import text as T
from ..operators import chat, jd, quality as Q, skills as S, timeline as L
from ..operators.ranking import ranked
from ..session import cut, spread, table

AS_OF = (2025, 6)


def _res(spark, d, *columns):
    """The resumes on all cores; the columns are stated where a text is moved for that."""
    rows = table(spark, d, "resumes")
    return spread(rows.select("resume_id", *columns)) if columns else rows


def body_lines(sl):
    """The lines of a sectioned text that are no headings, as (line_no, line, label)."""
    return F.transform(F.filter(sl, lambda x: ~x["is_heading"]), lambda x: F.struct(x["line_no"].cast("int").alias("line_no"), x["line"].alias("line"), x["section"].alias("label")))


def with_skills(spark, d, *columns, typos=False):
    """The resumes with the skills their texts name: ``lines``, and ``hits``, each skill with its best evidence."""
    rows = T.sectioned(_res(spark, d, "raw_text", *columns), "resume_id", "raw_text", *(["raw_text", *columns] if columns else []))
    return S.mentions(rows.withColumn("lines", body_lines(F.col("sl"))).drop("sl"), "lines", table(spark, d, "skill_ontology"), typos=typos, best=True)


def text_skills(spark, d):
    return with_skills(spark, d).select("resume_id", F.explode("hits").alias("h")).select("resume_id", "h.skill_key", F.col("h.label").alias("section"), "h.line_no", "h.surface", "h.evidence")


def text_skills_typos(spark, d):
    """Skills that a text names with a likely typing error alone (J4): no SQL, the ratio is none of its functions."""
    hits = with_skills(spark, d, typos=True).select("resume_id", F.explode("hits").alias("h"))
    return hits.where("not h.exact").select("resume_id", "h.skill_key", F.col("h.label").alias("section"), "h.line_no", "h.surface", "h.evidence")


def line_shapes(spark, d):
    ls = T.lines(_res(spark, d, "raw_text"), "resume_id", "raw_text")
    return ls.select("resume_id", "line_no", T.looks_like_heading(F.col("line")).alias("heading"))


def section_carry_forward(spark, d):
    return T.sections(_res(spark, d, "raw_text"), "resume_id", "raw_text").select("resume_id", "line_no", "section", "is_heading")


def section_view(spark, d):
    """The sections of a text and their sizes (P20)."""
    return T.sections(_res(spark, d, "raw_text"), "resume_id", "raw_text").where("not is_heading").groupBy("resume_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def chunk_windows(spark, d):
    return T.chunks(_res(spark, d, "raw_text"), "resume_id", "raw_text")


def contacts(spark, d):
    t = F.coalesce("raw_text", F.lit(""))
    return _res(spark, d).select("resume_id", F.try_element_at(T.found(t, T.EMAIL), F.lit(1)).alias("email"), T.first_phone(t).alias("phone"), F.array_join(T.links_of(t), " ").alias("links"))


def placeholder_email(spark, d):
    return _res(spark, d).where("email is not null").select("resume_id", F.trim(F.lower("email")).rlike(T.PLACEHOLDER_MAIL).alias("placeholder"))


def reliable_name(spark, d):
    return _res(spark, d).select("resume_id", T.reliable_name(F.col("name")).alias("reliable"), T.name_key(F.coalesce("name", F.lit(""))).alias("key"))


def experience_regex(spark, d):
    return _res(spark, d).select("resume_id", F.round(T.stated_years(F.col("raw_text")), 4).alias("years"))


def _work_text(lines):
    return F.array_join(F.transform(F.filter(lines, lambda x: x["label"].isin("experience", "projects")), lambda x: x["line"]), "\n")


def experience_years(spark, d):
    """The years of experience and where they come from."""
    rows = T.sectioned(_res(spark, d, "raw_text"), "resume_id", "raw_text", "raw_text").withColumn("work", _work_text(body_lines(F.col("sl"))))
    return rows.where("raw_text is not null").select("resume_id", T.experience(F.col("raw_text"), F.col("work"), AS_OF).alias("x")).select("resume_id", "x.years", "x.source")


def parsed_record(spark, d):
    """What a text yields, in one row: contacts, experience, education, beginner, skills, sections."""
    t = F.col("raw_text")
    rows = with_skills(spark, d, "warnings").where("raw_text is not null").withColumn("x", T.experience(t, _work_text(F.col("lines")), AS_OF))
    return rows.select(
        "resume_id", F.try_element_at(T.found(t, T.EMAIL), F.lit(1)).alias("email"), T.first_phone(t).alias("phone"), F.col("x.years").alias("years"), F.col("x.source").alias("source"), T.education_level(t).alias("level"),
        (t.rlike(T.STUDENT) | (F.col("x.years") == 0)).alias("fresher"), F.array_join(F.array_sort(F.transform("hits", lambda h: h["skill_key"])), ",").alias("skills"), F.array_join(F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["label"]))), ",").alias("sections"))


def education_level(spark, d):
    return _res(spark, d).select("resume_id", T.education_level(F.coalesce("raw_text", F.lit(""))).alias("level"))


def student_marker(spark, d):
    return _res(spark, d).select("resume_id", F.coalesce(F.col("raw_text"), F.lit("")).rlike(T.STUDENT).alias("student"))


def failed_files(spark, d):
    """Files without text, and why."""
    n = F.length(F.trim(F.coalesce("raw_text", F.lit(""))))
    return _res(spark, d).where(F.coalesce(F.col("raw_text"), F.lit("")).rlike(r"^\s*$")).select("doc_id", F.lit("no text extracted").alias("reason"), F.coalesce(F.size("warnings"), F.lit(0)).alias("n_warnings"))


def parse_issues(spark, d):
    return _res(spark, d).where(F.coalesce(F.size("warnings"), F.lit(0)) > 0).select("doc_id", F.array_join("warnings", "; ").alias("issues"))


def tag_strip(spark, d):
    """Tags to line breaks, as for XML that can't be parsed."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", "<[^>]+>", "\n").alias("salvaged"))


def unique_doc_ids(spark, d):
    """The n-th row of one source gets ``#n``."""
    rows = ranked(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), [F.col("doc_id").asc()], "source", "n")
    return rows.select("doc_id", F.when(F.col("n") == 1, F.col("source")).otherwise(F.concat("source", F.lit("#"), F.col("n").cast("string"))).alias("unique_id"))


def timeline_entries(spark, d):
    return L.entries(_res(spark, d, "raw_text"), "resume_id", "raw_text", AS_OF).select("resume_id", "line_no", F.round("start", 3).alias("start"), F.round("finish", 3).alias("finish"), "kind", "is_present")


def _work(spark, d):
    e = cut(L.entries(_res(spark, d, "raw_text"), "resume_id", "raw_text", AS_OF))
    return e, e.where((F.col("kind") == "work") & ((F.col("finish") - F.col("start")) * 12 >= 1 - 1e-4))


def span_merge_years(spark, d):
    return L.merged_years(_work(spark, d)[1], "resume_id")


def interval_overlaps(spark, d):
    return L.overlaps(_work(spark, d)[1], "resume_id")


def max_concurrency(spark, d):
    return L.concurrency(_work(spark, d)[1], "resume_id").select("resume_id", "live")


def timeline_totals(spark, d):
    return L.totals(_work(spark, d)[1], "resume_id").select("resume_id", "n", "months", "span")


def timeline_flags(spark, d):
    return L.timeline_flags(_work(spark, d)[0], "resume_id", AS_OF)


def worst_flag(spark, d):
    f = L.timeline_flags(_work(spark, d)[0], "resume_id", AS_OF)
    return f.groupBy("resume_id").agg(F.min(F.when(F.col("severity") == "medium", 1).otherwise(2)).alias("worst"))


def _counted(spark, d):
    """The resumes with the number of skills their texts name, and of those shown in work and projects."""
    rows = with_skills(spark, d, "warnings", "links", "years_experience", "experience_source")
    rows = rows.withColumn("x", T.experience(F.col("raw_text"), _work_text(F.col("lines")), AS_OF)).withColumn("dated_years", T.span_years(F.col("raw_text"), AS_OF))
    return rows.withColumn("n_skills", F.size("hits")).withColumn("in_work", F.size(F.filter("hits", lambda h: h["label"].isin("experience", "projects"))))


def integrity_rules(spark, d):
    return Q.integrity(_counted(spark, d), "resume_id", "raw_text", "warnings", "n_skills", "in_work", AS_OF[0], "x", "dated_years")


def confidence_score(spark, d):
    rows = _counted(spark, d).withColumn("secs", F.array_distinct(F.transform("lines", lambda x: x["label"])))
    return Q.confidence(rows, "resume_id", "raw_text", "warnings", "links", "in_work", "n_skills", "secs")


def phrase_audit(spark, d):
    return Q.phrase_audit(table(spark, d, "jobs"), "job_id", "jd_text").select("job_id", "category", "severity", "phrase")


def phrase_audit_counts(spark, d):
    return phrase_audit(spark, d).groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("category").alias("categories"))


def structural_audit(spark, d):
    demand = table(spark, d, "requirements").groupBy("job_id").agg(F.count_if(F.col("kind") == "required").alias("n_required"), F.count_if(F.col("kind") == "preferred").alias("n_preferred"))
    return Q.structural_audit(table(spark, d, "jobs"), demand)


def jd_bullets(spark, d):
    return jd.bullets(table(spark, d, "jobs"), "job_id", "jd_text").select("job_id", "line_no", "heading", "line")


def jd_classified(spark, d):
    return jd.classified(jd.bullets(table(spark, d, "jobs"), "job_id", "jd_text"), "job_id").select("job_id", "line_no", "kind", "kept")


def _jd_mentions(spark, d, rows):
    return S.mentions(rows.withColumn("lines", F.array(F.struct("line_no", "line", F.lit("jd").alias("label")))), "lines", table(spark, d, "skill_ontology"))


def jd_kept(spark, d):
    """The bullets that count as requirements: those that name a skill, or ask for something in four words or more."""
    rows = jd.classified(jd.bullets(table(spark, d, "jobs"), "job_id", "jd_text"), "job_id")
    return _jd_mentions(spark, d, rows).where("kept or size(hits) > 0").select("job_id", "line_no", "kind", F.size("hits").alias("skills"))


def jd_skills(spark, d):
    """The skills a job text demands, each once with its first evidence: required beats preferred; without any in its bullets, those of the whole text."""
    hit = lambda rows, kind: rows.select("job_id", kind.alias("kind"), F.explode("hits").alias("h")).select("job_id", "kind", "h.line_no", "h.place", "h.skill_key")
    listed = cut(hit(_jd_mentions(spark, d, jd.classified(jd.bullets(table(spark, d, "jobs"), "job_id", "jd_text"), "job_id")), F.col("kind")))
    bare = table(spark, d, "jobs").where("job_id is not null").join(listed.select("job_id").distinct(), "job_id", "left_anti")
    whole = hit(_jd_mentions(spark, d, T.lines(bare, "job_id", "jd_text").select("job_id", F.col("line_no").cast("int").alias("line_no"), "line")), F.lit("required"))
    order = F.struct(F.when(F.col("kind") == "required", 0).otherwise(1).alias("k"), "line_no", "place")
    return listed.unionByName(whole).groupBy("job_id", "skill_key").agg(F.min(order).alias("m")).select("job_id", "skill_key", F.when(F.col("m.k") == 0, "required").otherwise("preferred").alias("kind"), F.col("m.line_no").alias("line_no"))


def jd_seniority(spark, d):
    return table(spark, d, "jobs").select("job_id", jd.seniority(F.coalesce("jd_text", F.lit("")), F.coalesce("min_years", F.lit(0.0))).alias("level"))


def jd_experience(spark, d):
    return table(spark, d, "jobs").select("job_id", jd.least_years(F.coalesce("jd_text", F.lit(""))).alias("least_years"))


def jd_responsibilities(spark, d):
    return jd.responsibilities(jd.bullets(table(spark, d, "jobs"), "job_id", "jd_text"), "job_id")


def intent_router(spark, d):
    docs = table(spark, d, "documents").where("doc_kind = 'chat' and text is not null")
    return docs.select("doc_id", chat.intent(F.col("text")).alias("intent"))


_LINES = "ls AS (SELECT resume_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1)::INTEGER AS line_no FROM resumes WHERE raw_text IS NOT NULL)"


def _head(line: str = "line") -> str:
    s = f"regexp_replace({line}, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')"
    w = f"list_filter(regexp_split_to_array(trim({s}), '[ \\t]+'), lambda w: w <> '')"
    n = lambda p: f"len(regexp_extract_all({s}, '{p}'))"
    return (f"(length({s}) > 0 AND length({s}) <= 60 AND len({w}) <= 6 AND NOT regexp_matches({s}, '[.,;]$') AND {n('[A-Za-z]')} > 0 AND "
            f"({n('[A-Z]')} / {n('[A-Za-z]')} > 0.7 OR ends_with({s}, ':') OR len(list_filter({w}, lambda w: regexp_matches(w, '^[a-z]'))) = 0))")


_KEY = "trim(regexp_replace(lower(regexp_replace(trim(line), '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g')), '\\s+', ' ', 'g'))"
_SYN = "syn AS (" + " UNION ALL ".join(f"SELECT unnest({[x for x in v.split('|')]!r}) AS syn, '{k}' AS sec" for k, v in T.SECTION_HEADINGS.items()) + ")"
_SEC_CTES = f"""
{_LINES}, {_SYN},
hd AS (SELECT *, {_head()} AS is_h, {_KEY} AS k FROM ls),
named AS (SELECT h.*, CASE WHEN is_h THEN coalesce((SELECT min(sec) FROM syn WHERE syn = k), (SELECT arg_min(sec, struct_pack(a := -length(syn), b := syn)) FROM syn WHERE contains(k, syn) AND length(syn) >= 6 AND length(k) <= length(syn) + 18)) END AS sec0 FROM hd h),
secs AS (SELECT resume_id, line_no, line, sec0 IS NOT NULL AS is_heading, coalesce(last_value(sec0 IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'other') AS section FROM named)
"""
_SEC = "WITH " + _SEC_CTES
#: CTEs of the sections, the surfaces, and ``sk_best``, each skill a text names with its best evidence.
SCAN_CTES = _SEC_CTES + f""", {S.SQL_SURFACES}, {S.sql_mentions("(SELECT resume_id, line_no, section AS label, line FROM secs WHERE NOT is_heading)", "resume_id")},
sk_best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, skill_key ORDER BY CASE label {' '.join(f"WHEN '{k}' THEN {v}" for k, v in EVIDENCE_WEIGHT.items())} ELSE 0.7 END DESC, line_no, st) AS place FROM sk_hits) WHERE place = 1),
sk_counted AS MATERIALIZED (SELECT r.*, coalesce(n, 0) AS n_skills, coalesce(w, 0) AS in_work FROM resumes r LEFT JOIN (SELECT resume_id, count(*) AS n, count(*) FILTER (WHERE label IN ('experience', 'projects')) AS w FROM sk_best GROUP BY 1) USING (resume_id))
"""
_SCAN = "WITH RECURSIVE " + SCAN_CTES


def _spans(source: str, name: str) -> str:
    """CTEs that end in ``name`` (resume_id, dated): span_years of a relation (resume_id, t)."""
    month = lambda i, none: f"coalesce(nullif(list_position({list(T.MONTHS)!r}, lower(x[{i}])), 0), {none})"
    g = ", ".join(f"regexp_extract_all(t, '{T.SPAN}', {i})" for i in range(1, 6))
    return f"""{name}0 AS (SELECT resume_id, unnest(list_zip({g})) AS x FROM {source}),
{name}1 AS (SELECT resume_id, CAST(x[2] AS INTEGER) + ({month(1, 1)} - 1) / 12 AS s, CASE WHEN x[5] <> '' THEN {AS_OF[0] + AS_OF[1] / 12!r} ELSE TRY_CAST(nullif(x[4], '') AS INTEGER) + {month(3, 12)} / 12 END AS e FROM {name}0),
{name}2 AS (SELECT *, max(e) OVER (PARTITION BY resume_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}1 WHERE s >= 1980 AND s <= {AS_OF[0] + 1} AND s < e AND e <= {AS_OF[0] + 1.5}),
{name} AS (SELECT resume_id, round(sum(CASE WHEN reach IS NULL OR s > reach + 0.1 THEN e - s ELSE greatest(e - reach, 0.0) END), 2) AS dated FROM {name}2 GROUP BY 1)"""


_EXP = f""", wt AS (SELECT r.resume_id, coalesce(w, '') AS w, CASE WHEN coalesce(w, '') = '' THEN raw_text ELSE w END AS t FROM resumes r LEFT JOIN (SELECT resume_id, string_agg(line, chr(10) ORDER BY line_no) AS w FROM secs WHERE NOT is_heading AND section IN ('experience', 'projects') GROUP BY 1) USING (resume_id) WHERE raw_text IS NOT NULL),
{_spans('wt', 'sw')}, {_spans('(SELECT resume_id, raw_text AS t FROM resumes WHERE raw_text IS NOT NULL)', 'sa')},
ex0 AS (SELECT resume_id, list_max(list_filter(list_transform(regexp_extract_all(raw_text, '{T.STATED_YEARS}', 1), lambda v: CAST(v AS DOUBLE)), lambda v: v > 0 AND v <= 45)) AS sy,
  list_max(list_filter(list_transform(regexp_extract_all(raw_text, '{T.STATED_MONTHS}', 1), lambda v: CAST(v AS DOUBLE)), lambda v: v > 0 AND v <= 120)) / 12 AS sm FROM resumes WHERE raw_text IS NOT NULL),
xp AS MATERIALIZED (SELECT resume_id, round(coalesce(sy, sm, sw.dated, 0.0), 2) AS years, CASE WHEN sy IS NOT NULL THEN 'stated in resume text' WHEN sm IS NOT NULL THEN 'stated in months' WHEN sw.dated > 0 THEN 'computed from employment date ranges' ELSE 'no experience signal found (treated as fresher)' END AS source,
  coalesce(sa.dated, 0.0) AS dated FROM ex0 LEFT JOIN sw USING (resume_id) LEFT JOIN sa USING (resume_id))
"""
_NOW = AS_OF[0] + (AS_OF[1] - 1) / 12


def _mon(name: str, num: str) -> str:
    return f"CASE WHEN {name} <> '' THEN list_position({L.MONTHS!r}, lower({name})) WHEN {num} <> '' THEN TRY_CAST({num} AS INTEGER) ELSE 1 END"


_TL = _SEC + f""", g AS (SELECT resume_id, line_no, line, section, regexp_extract(line, '{L.RANGE}', ['a', 'b', 'c', 'd', 'e', 'f', 'g']) AS m FROM secs WHERE regexp_matches(line, '{L.RANGE}')),
ent0 AS (SELECT resume_id, line_no, section, m.g <> '' AS is_present, regexp_matches(line, '(?i)\\b(expected|anticipated|graduating)\\b') AS is_expected, TRY_CAST(m.c AS INTEGER) + (({_mon('m.a', 'm.b')}) - 1) / 12 AS s,
  CASE WHEN m.g <> '' THEN {_NOW!r} ELSE TRY_CAST(m.f AS INTEGER) + (({_mon('m.d', 'm.e')}) - 1) / 12 END AS f FROM g),
ent AS (SELECT resume_id, line_no, is_present, is_expected, round(CAST(s AS DOUBLE), 6) AS start, round(CAST(greatest(s, f) AS DOUBLE), 6) AS finish, CASE WHEN section = 'experience' THEN 'work' WHEN section = 'education' THEN 'study' WHEN section IN ('projects', 'certifications', 'achievements') THEN 'side' ELSE 'other' END AS kind
  FROM ent0 WHERE s >= 1980 AND s <= {AS_OF[0] + 8}),
work AS (SELECT * FROM ent WHERE kind = 'work' AND (finish - start) * 12 >= 1 - 1e-4),
ov AS (SELECT a.resume_id, a.line_no AS a, b.line_no AS b, greatest(0.0, (least(a.finish, b.finish) - greatest(a.start, b.start)) * 12) AS raw,
  (a.start <= b.start AND a.finish >= b.finish) OR (b.start <= a.start AND b.finish >= a.finish) AS contained FROM work a JOIN work b ON a.resume_id = b.resume_id AND a.line_no < b.line_no),
tot AS (SELECT resume_id, count(*) AS n, round(sum((finish - start) * 12), 1) AS months, round((max(finish) - min(start)) * 12, 1) AS span, min(start) AS earliest, count(DISTINCT round_even((finish - start) * 12, 0)) AS lengths FROM work GROUP BY 1),
pts AS (SELECT DISTINCT resume_id, unnest([round(start, 2), round(finish, 2)]) AS point FROM work),
live AS (SELECT p.resume_id, point, count(*) AS live FROM pts p JOIN work w ON w.resume_id = p.resume_id AND start <= point AND point < finish GROUP BY 1, 2),
fl AS (
  SELECT resume_id, 'date_overlap' AS code, CASE WHEN max(round(raw, 1)) >= 3 OR arg_max(contained, struct_pack(a := round(raw, 1), b := contained)) THEN 'medium' ELSE 'low' END AS severity FROM ov WHERE raw > 1 + 1e-4 GROUP BY 1
  UNION ALL SELECT resume_id, 'overlap_cluster', 'medium' FROM live GROUP BY 1 HAVING max(live) >= 3
  UNION ALL SELECT resume_id, 'duration_inflation', 'medium' FROM tot WHERE n >= 2 AND span > 0 AND months > span * 1.5 + 6
  UNION ALL SELECT resume_id, 'experience_precedes_education', 'low' FROM tot JOIN (SELECT resume_id, min(start) AS s FROM ent WHERE kind = 'study' GROUP BY 1) USING (resume_id) WHERE earliest < s - 2
  UNION ALL SELECT resume_id, 'suspiciously_uniform', 'low' FROM tot WHERE n >= 3 AND lengths = 1 AND months / n >= 2
  UNION ALL SELECT DISTINCT resume_id, 'future_dated', 'low' FROM ent WHERE finish > {_NOW!r} + 1.05 AND NOT is_expected AND NOT is_present)
"""


def _q(p: str) -> str:
    return p.replace("'", "''")


def _all(p: str, group: int | None = None) -> str:
    return f"regexp_extract_all(coalesce(raw_text, ''), '{_q(p)}'{'' if group is None else f', {group}'})"


_N = "length(regexp_replace(coalesce(raw_text, ''), '^\\s+|\\s+$', '', 'g'))"
_WORDS = "len(list_filter(regexp_split_to_array(trim(regexp_replace(coalesce(raw_text, ''), '[\\r\\n]+', ' ', 'g')), '[ \\t]+'), lambda w: w <> ''))"
_YR = f"list_filter(list_transform(list_zip({_all(Q.YEAR_RANGE, 1)}, {_all(Q.YEAR_RANGE, 2)}), lambda r: CASE WHEN CAST(r[2] AS INTEGER) < CAST(r[1] AS INTEGER) THEN 'timeline_inconsistent' WHEN CAST(r[2] AS INTEGER) > {AS_OF[0] + 1} THEN 'timeline_future' END), lambda x: x IS NOT NULL)[1]"
_JD = jd.sql_bullets()
_JDS = _JD.replace("WITH l0 AS", "WITH RECURSIVE l0 AS", 1) + f", {S.SQL_SURFACES}, " + S.sql_mentions("(SELECT job_id, line_no, line, 'jd' AS label FROM cls)", "job_id", "jk").lstrip()
SQL = {
    "text_skills": _SCAN + "SELECT resume_id, skill_key, label AS section, line_no, surface, left(trim(line, ' ' || chr(9) || chr(13)), 220) AS evidence FROM sk_best",
    "line_shapes": f"WITH {_LINES} SELECT resume_id, line_no, {_head()} AS heading FROM ls",
    "section_carry_forward": _SEC + "SELECT resume_id, line_no, section, is_heading FROM secs",
    "section_view": _SEC + "SELECT resume_id, section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM secs WHERE NOT is_heading GROUP BY 1, 2",
    "contacts": f"""SELECT resume_id, {_all(T.EMAIL)}[1] AS email, trim(list_filter({_all(T.PHONE)}, lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 13)[1]) AS phone,
        coalesce(array_to_string((SELECT list(l ORDER BY i) FROM (SELECT l, min(i) AS i FROM (SELECT unnest({_all(T.LINK)}) AS l, generate_subscripts({_all(T.LINK)}, 1) AS i) GROUP BY l ORDER BY i LIMIT 5)), ' '), '') AS links FROM resumes""",
    "placeholder_email": f"SELECT resume_id, regexp_matches(trim(lower(email)), '{T.PLACEHOLDER_MAIL}') AS placeholder FROM resumes WHERE email IS NOT NULL",
    "reliable_name": f"""SELECT resume_id, coalesce(length(trim(name)) >= 4 AND NOT regexp_matches(trim(name), '{T.UNRELIABLE_NAME}') AND NOT regexp_matches(name, '[0-9]'), false) AS reliable,
        array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(name, '')), '{T.NAME_NOISE}', ' ', 'g'), '[^a-z ]+', ' ', 'g'), ' +'), lambda w: w <> '')), ' ') AS key FROM resumes""",
    "experience_regex": f"""SELECT resume_id, CASE WHEN raw_text IS NOT NULL THEN round(coalesce(list_max(list_filter(list_transform({_all(T.STATED_YEARS, 1)}, lambda v: CAST(v AS DOUBLE)), lambda v: v > 0 AND v <= 45)),
        list_max(list_filter(list_transform({_all(T.STATED_MONTHS, 1)}, lambda v: CAST(v AS DOUBLE)), lambda v: v > 0 AND v <= 120)) / 12), 4) END AS years FROM resumes""",
    "experience_years": _SEC + _EXP + "SELECT resume_id, years, source FROM xp",
    "parsed_record": _SCAN + _EXP + f"""SELECT resume_id, {_all(T.EMAIL)}[1] AS email, trim(list_filter({_all(T.PHONE)}, lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 13)[1]) AS phone, years, source,
        CAST(CASE {" ".join(f"WHEN regexp_matches(raw_text, '{_q(p)}') THEN {n}" for n, p in T.DEGREES)} ELSE 0 END AS INTEGER) AS level, regexp_matches(raw_text, '{T.STUDENT}') OR years = 0 AS fresher,
        coalesce((SELECT array_to_string(list_sort(list(skill_key)), ',') FROM sk_best b WHERE b.resume_id = r.resume_id), '') AS skills, coalesce((SELECT array_to_string(list_sort(list(DISTINCT section)), ',') FROM secs s WHERE s.resume_id = r.resume_id AND NOT is_heading), '') AS sections
        FROM (SELECT resume_id, raw_text FROM resumes) r JOIN xp USING (resume_id)""",
    "education_level": "SELECT resume_id, CAST(CASE " + " ".join(f"WHEN regexp_matches(coalesce(raw_text, ''), '{_q(p)}') THEN {n}" for n, p in T.DEGREES) + " ELSE 0 END AS INTEGER) AS level FROM resumes",
    "student_marker": f"SELECT resume_id, regexp_matches(coalesce(raw_text, ''), '{T.STUDENT}') AS student FROM resumes",
    "failed_files": "SELECT doc_id, 'no text extracted' AS reason, coalesce(len(warnings), 0)::INTEGER AS n_warnings FROM resumes WHERE regexp_matches(coalesce(raw_text, ''), '^\\s*$')",
    "parse_issues": "SELECT doc_id, array_to_string(warnings, '; ') AS issues FROM resumes WHERE len(warnings) > 0",
    "tag_strip": "SELECT doc_id, regexp_replace(text, '<[^>]+>', chr(10), 'g') AS salvaged FROM documents WHERE text IS NOT NULL",
    "unique_doc_ids": "SELECT doc_id, CASE WHEN n = 1 THEN source ELSE source || '#' || n END AS unique_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL)",
    "timeline_entries": _TL + "SELECT resume_id, line_no, round(start, 3) AS start, round(finish, 3) AS finish, kind, is_present FROM ent",
    "span_merge_years": _TL + """, rn AS (SELECT *, max(finish) OVER (PARTITION BY resume_id ORDER BY start, finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM work),
        mk AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY start, finish ROWS UNBOUNDED PRECEDING) AS island FROM rn)
        SELECT resume_id, round(sum(e - s), 2) AS years FROM (SELECT resume_id, island, min(start) AS s, max(finish) AS e FROM mk GROUP BY 1, 2) GROUP BY 1""",
    "interval_overlaps": _TL + "SELECT resume_id, a, b, round(raw, 1) AS months, contained FROM ov WHERE raw > 1 + 1e-4",
    "max_concurrency": _TL + "SELECT resume_id, max(live) AS live FROM live GROUP BY 1",
    "timeline_totals": _TL + "SELECT resume_id, n, months, span FROM tot",
    "timeline_flags": _TL + "SELECT * FROM fl",
    "worst_flag": _TL + "SELECT resume_id, CAST(min(CASE severity WHEN 'medium' THEN 1 ELSE 2 END) AS INTEGER) AS worst FROM fl GROUP BY 1",
    "integrity_rules": _SCAN + _EXP + " UNION ALL ".join(f"SELECT resume_id, '{c}' AS code, '{s}' AS severity FROM sk_counted WHERE {w}" for c, s, w in (
        ("experience_unsupported", "medium", "resume_id IN (SELECT resume_id FROM xp WHERE source LIKE 'stated%' AND years >= 2 AND dated > 0 AND years > dated * 2 + 1)"), ("keyword_stuffing", "medium", "n_skills >= 22 AND in_work / n_skills < 0.12"), ("skill_density", "low", f"n_skills >= 32 AND in_work / n_skills >= 0.12 AND {_WORDS} < n_skills * 28 * 0.4"),
        ("skill_dump_line", "low", "len(list_filter(string_split(coalesce(raw_text, ''), chr(10)), lambda x: len(regexp_extract_all(x, ',')) >= 14 AND len(list_filter(regexp_split_to_array(trim(x), '[ \\t]+'), lambda w: w <> '')) < len(regexp_extract_all(x, ',')) * 3)) > 0"),
        ("prompt_injection", "high", f"regexp_matches(coalesce(raw_text, ''), '{Q.INJECTION}')"),
        ("timeline_inconsistent", "medium", f"{_YR} = 'timeline_inconsistent'"), ("timeline_future", "low", f"{_YR} = 'timeline_future'"),
        ("unsubstantiated_claims", "low", f"len(list_distinct(list_transform({_all(Q.SUPERLATIVE)}, lambda x: lower(x)))) >= 3 AND NOT regexp_matches(coalesce(raw_text, ''), '{Q.QUANTIFIED}')"),
        ("unreadable", "high", f"{_N} < 250"), ("very_short", "low", f"{_N} >= 250 AND {_N} < 600"), ("parse_warning", "low", f"{_N} >= 600 AND len(warnings) > 0"), ("no_skills_found", "medium", "n_skills = 0"))),
    "confidence_score": _SCAN + f""", fs AS (SELECT resume_id, list(DISTINCT section) AS secs FROM secs WHERE NOT is_heading GROUP BY 1),
        p AS (SELECT r.*, coalesce(secs, []) AS secs FROM sk_counted r LEFT JOIN fs USING (resume_id)),
        s AS (SELECT resume_id, least(1.0, len(list_distinct(list_transform({_all(Q.QUANTIFIED, 0)}, lambda x: lower(x)))) / 5) AS q, len({_all(Q.OWNERSHIP)}) AS own, len({_all(Q.FILLER)}) AS filler,
          least(1.0, in_work / greatest(3.0, greatest(1, n_skills) * 0.4)) AS backed, len(list_filter(secs, lambda x: x IN ('experience', 'projects', 'skills', 'education', 'certifications'))) / 5 AS depth, CASE WHEN len(links) > 0 THEN 1.0 ELSE 0.0 END AS ln,
          CASE WHEN greatest(1, {_WORDS}) < 120 THEN 0.15 WHEN {_WORDS} < 250 THEN 0.55 WHEN {_WORDS} <= 1400 THEN 1.0 ELSE 0.75 END AS sub, CASE WHEN {_N} < 250 THEN 0.35 WHEN {_N} < 600 THEN 0.8 WHEN len(warnings) > 0 THEN 0.85 ELSE 1.0 END AS parse FROM p),
        c AS (SELECT resume_id, round(100 * (q * 0.26::DOUBLE + CASE WHEN own + filler > 0 THEN own / (own + filler) ELSE 0.0 END * 0.20::DOUBLE + backed * 0.22::DOUBLE + depth * 0.12::DOUBLE + ln * 0.08::DOUBLE + sub * 0.12::DOUBLE) * parse::DOUBLE, 3) AS score FROM s)
        SELECT *, CASE WHEN score >= 70 THEN 'High' WHEN score >= 50 THEN 'Moderate' WHEN score >= 30 THEN 'Low' ELSE 'Very low' END AS band FROM c""",
    "phrase_audit": " UNION ALL ".join(f"SELECT DISTINCT job_id, '{c}' AS category, '{s}' AS severity, lower(unnest(regexp_extract_all(coalesce(jd_text, ''), '{_q(p)}'))) AS phrase FROM jobs" for c, s, p in Q.PHRASES),
    "structural_audit": """WITH c AS (SELECT j.*, coalesce(nr, 0) AS nr, coalesce(np, 0) AS np, coalesce(seniority IN ('intern', 'junior'), false) AS jr FROM jobs j LEFT JOIN (SELECT job_id, count(*) FILTER (WHERE kind = 'required') AS nr, count(*) FILTER (WHERE kind = 'preferred') AS np FROM requirements GROUP BY 1) USING (job_id))
        SELECT job_id, 'overloaded' AS rule FROM c WHERE jr AND nr >= 10 UNION ALL SELECT job_id, 'experience-for-entry' FROM c WHERE jr AND min_years >= 2 UNION ALL SELECT job_id, 'all-required' FROM c WHERE np = 0 AND nr >= 6""",
    "jd_bullets": _JD + "SELECT job_id, line_no, heading, line FROM bul",
    "jd_classified": _JD + "SELECT job_id, line_no, kind, kept FROM cls",
    "jd_kept": _JDS + "SELECT job_id, line_no, kind, coalesce(n, 0) AS skills FROM cls LEFT JOIN (SELECT job_id, line_no, count(DISTINCT skill_key) AS n FROM jk_hits GROUP BY 1, 2) USING (job_id, line_no) WHERE kept OR n > 0",
    "jd_skills": _JDS + ", " + S.sql_mentions("(SELECT job_id, line_no, line, 'jd' AS label FROM l0 WHERE job_id NOT IN (SELECT job_id FROM jk_hits))", "job_id", "jw").lstrip() + """, jh AS (SELECT job_id, skill_key, kind, line_no, st FROM jk_hits JOIN (SELECT job_id, line_no, kind FROM cls) USING (job_id, line_no) UNION ALL SELECT job_id, skill_key, 'required', line_no, st FROM jw_hits)
        SELECT job_id, skill_key, kind, line_no FROM (SELECT *, row_number() OVER (PARTITION BY job_id, skill_key ORDER BY CASE kind WHEN 'required' THEN 0 ELSE 1 END, line_no, st) AS n FROM jh) WHERE n = 1""",
    "jd_seniority": "SELECT job_id, CASE " + " ".join(f"WHEN regexp_matches(left(coalesce(jd_text, ''), 1200), '{p}') THEN '{k}'" for k, p in jd.SENIORITY) + " " + " ".join(f"WHEN regexp_matches(coalesce(jd_text, ''), '{p}') THEN '{k}'" for k, p in jd.SENIORITY) + " WHEN coalesce(min_years, 0) >= 6 THEN 'senior' WHEN coalesce(min_years, 0) >= 3 THEN 'mid' ELSE 'junior' END AS level FROM jobs",
    "jd_experience": f"SELECT job_id, coalesce(list_min(list_filter(list_transform(regexp_extract_all(coalesce(jd_text, ''), '{jd.EXPERIENCE}', 1), lambda v: CAST(v AS DOUBLE)), lambda v: v <= 40)), 0.0) AS least_years FROM jobs",
    "jd_responsibilities": _JD + f"SELECT job_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY line_no) AS n FROM cls WHERE regexp_matches(heading, '{_q(jd.DUTIES)}') AND len(list_filter(regexp_split_to_array(trim(line), '[ \\t]+'), lambda w: w <> '')) > 3) WHERE n <= 10",
    "intent_router": "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{_q(p)}') THEN '{k}'" for k, p in chat.INTENTS) + " ELSE 'unknown' END AS intent FROM documents WHERE doc_kind = 'chat' AND text IS NOT NULL",
}
SQL["phrase_audit_counts"] = f"SELECT severity, count(*) AS n, count(DISTINCT category) AS categories FROM ({SQL['phrase_audit']}) GROUP BY severity"
QUERIES = {n: globals()[n] for n in [*SQL, "chunk_windows", "text_skills_typos"]}
