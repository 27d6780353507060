"""Queries of identity resolution, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import NAME_NOISE, PLACEHOLDER_MAIL, UNRELIABLE_NAME
from ..operators import entity as E
from ..session import cut, table


def identity_edges(spark, d):
    return E.identity_edges(table(spark, d, "resumes"))


def _groups(spark, d):
    return cut(E.groups(E.identity_edges(table(spark, d, "resumes"))))


def identity_groups(spark, d):
    return _groups(spark, d).select(F.col("id").alias("resume_id"), "group_id")


def primary_copy(spark, d):
    return E.primary_copy(table(spark, d, "resumes"), _groups(spark, d))


def dedupe_report(spark, d):
    """Files, people, groups of several files, files removed."""
    g = _groups(spark, d)
    rows = table(spark, d, "resumes").select("resume_id").join(g, F.col("resume_id") == F.col("id"), "left").select(F.coalesce("group_id", "resume_id").alias("who"))
    per = rows.groupBy("who").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("files"), F.count("*").alias("people"), F.count_if(F.col("n") > 1).alias("groups"), (F.sum("n") - F.count("*")).alias("removed"))


def shingle_jaccard(spark, d):
    """Similarity of the texts of one trusted name."""
    from ..functions.text import name_key, reliable_name

    rows = table(spark, d, "resumes").where(reliable_name(F.col("name"))).select("resume_id", name_key(F.col("name")).alias("nm"), E.shingle_hashes(F.col("raw_text")).alias("sh")).where("nm <> ''")
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, F.expr("a.nm = b.nm and a.resume_id < b.resume_id")).select(F.col("a.resume_id").alias("a"), F.col("b.resume_id").alias("b"), F.round(E.jaccard(F.col("a.sh"), F.col("b.sh")), 5).alias("jaccard"))


def fingerprint_duplicates(spark, d):
    return E.contained(table(spark, d, "resumes"), "resume_id", "raw_text")


def fuzzy_surface_join(spark, d):
    """Typed skills of six characters or more, in any script, within two edits of a canonical name or an alias: the nearest surface (J4, edit-distance form)."""
    return E.nearest_surface(table(spark, d, "resumes").select(F.explode("skills").alias("s")), "s", table(spark, d, "skill_ontology"))


_P = f"""
WITH RECURSIVE p0 AS (SELECT resume_id AS id, lower(trim(email)) AS m, name, phone, doc_id, raw_text,
  array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(name, '')), '{NAME_NOISE}', ' ', 'g'), '[^a-z ]+', ' ', 'g'), ' +'), lambda w: w <> '')), ' ') AS nk,
  list_filter(string_split(regexp_replace(lower(coalesce(raw_text, '')), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM resumes),
p AS MATERIALIZED (SELECT id, CASE WHEN m <> '' AND contains(m, '@') AND NOT regexp_matches(m, '{PLACEHOLDER_MAIL}') THEN m END AS mail,
  CASE WHEN length(trim(name)) >= 4 AND NOT regexp_matches(trim(name), '{UNRELIABLE_NAME}') AND NOT regexp_matches(name, '[0-9]') AND nk <> '' THEN nk END AS nm,
  CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) END AS ph, lower(regexp_replace(doc_id, '\\.[^.]*$', '')) AS stem,
  CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS sh, lower(coalesce(raw_text, '')) AS low FROM p0),
pairs AS (SELECT DISTINCT a, b FROM (SELECT x.id AS a, y.id AS b FROM p x JOIN p y ON x.nm = y.nm AND x.id < y.id UNION ALL SELECT x.id, y.id FROM p x JOIN p y ON x.ph = y.ph AND x.id < y.id UNION ALL SELECT x.id, y.id FROM p x JOIN p y ON x.stem = y.stem AND x.id < y.id)),
j AS (SELECT a, b, x.nm = y.nm AS named, len(list_filter(x.sh, lambda s: list_contains(y.sh, s))) AS n, len(x.sh) AS na, len(y.sh) AS nb FROM pairs JOIN p x ON x.id = a JOIN p y ON y.id = b WHERE len(x.sh) > 0 AND len(y.sh) > 0),
near AS (SELECT a, b FROM j WHERE n / (na + nb - n) >= 0.92 OR (coalesce(named, false) AND n / (na + nb - n) >= 0.7)),
links AS (SELECT a, b FROM near UNION SELECT x.id, y.id FROM p x JOIN p y ON x.mail = y.mail AND x.id < y.id UNION SELECT x.id, y.id FROM p x JOIN p y ON x.nm = y.nm AND x.ph = y.ph AND x.id < y.id),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
grp AS (SELECT a AS resume_id, least(a, min(b)) AS group_id FROM reach GROUP BY a)
"""
SQL = {
    "identity_groups": _P + "SELECT resume_id, group_id FROM grp",
    "primary_copy": _P + """SELECT group_id, arg_max(r.resume_id, struct_pack(a := coalesce(len(warnings), 0) = 0, b := coalesce(len(skills), 0), c := coalesce(length(raw_text), 0),
        d := CASE extraction_method WHEN 'xml' THEN 5 WHEN 'python-docx' THEN 4 WHEN 'pymupdf' THEN 3 WHEN 'pdfplumber' THEN 3 WHEN 'plaintext' THEN 2 WHEN 'pypdf' THEN 2 ELSE 1 END, e := doc_id)) AS primary, count(*) AS copies FROM grp JOIN resumes r USING (resume_id) GROUP BY group_id""",
    "dedupe_report": _P + "SELECT sum(n)::BIGINT AS files, count(*) AS people, count(*) FILTER (WHERE n > 1) AS groups, (sum(n) - count(*))::BIGINT AS removed FROM (SELECT coalesce(group_id, r.resume_id) AS who, count(*) AS n FROM resumes r LEFT JOIN grp USING (resume_id) GROUP BY 1)",
    "shingle_jaccard": _P + """SELECT x.id AS a, y.id AS b, round(CASE WHEN len(x.sh) = 0 OR len(y.sh) = 0 THEN 0.0 ELSE len(list_filter(x.sh, lambda s: list_contains(y.sh, s))) / (len(x.sh) + len(y.sh) - len(list_filter(x.sh, lambda s: list_contains(y.sh, s)))) END, 5) AS jaccard
        FROM (SELECT p.*, p0.name FROM p JOIN p0 USING (id)) x JOIN p y ON x.nm = y.nm AND x.id < y.id""",
    "fingerprint_duplicates": """WITH f AS (SELECT resume_id, left(regexp_replace(lower(coalesce(raw_text, '')), '[^a-z0-9]+', '', 'g'), 4000) AS fp FROM resumes), g AS (SELECT * FROM f WHERE length(fp) > 300)
        SELECT a.resume_id, min(b.resume_id) AS other FROM g a JOIN g b ON a.resume_id <> b.resume_id AND CASE WHEN length(a.fp) <= length(b.fp) THEN contains(b.fp, left(a.fp, 1500)) ELSE contains(a.fp, left(b.fp, 1500)) END GROUP BY 1""",
}
QUERIES = {n: globals()[n] for n in [*SQL, "identity_edges", "fuzzy_surface_join"]}
