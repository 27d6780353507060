"""SQL for those training-data queries that whole tables allow it for; the others are tested against brute force."""

from __future__ import annotations

from .links import STAND_INS
from .survivors import FORMAT_RANK, NAME_STAND_INS

_MISSING = ", ".join("'" + s + "'" for s in STAND_INS)
_NO_NAME = ", ".join("'" + s + "'" for s in NAME_STAND_INS)

_LINKS = rf"""
files AS (SELECT CAST(resume_id AS BIGINT) AS resume_id, lower(trim(doc_id)) AS file FROM resumes),
named AS (
  SELECT resume_id, duplicate_of AS name FROM ranked_candidates
  UNION ALL SELECT resume_id, unnest(duplicate_files) AS name FROM ranked_candidates
),
cleaned AS (
  SELECT DISTINCT resume_id, lower(trim(regexp_extract(replace(trim(name), '\', '/'), '([^/]*)$', 1))) AS file FROM named
  WHERE name IS NOT NULL AND lower(trim(name)) NOT IN ({_MISSING})
),
labelled AS (
  SELECT DISTINCT job_id, identity_group, resume_id FROM ranked_candidates
  WHERE job_id IS NOT NULL AND identity_group IS NOT NULL AND lower(trim(identity_group)) NOT IN ({_MISSING})
),
links AS (
  SELECT c.resume_id AS a, f.resume_id AS b FROM cleaned c JOIN files f USING (file) WHERE c.resume_id <> f.resume_id
  UNION SELECT resume_id AS a, min(resume_id) OVER (PARTITION BY job_id, identity_group) AS b FROM labelled
),
sym AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
groups AS (SELECT CAST(a AS BIGINT) AS resume_id, CAST(least(a, min(b)) AS BIGINT) AS group_id FROM reach GROUP BY a)
"""

_P1 = rf"""
WITH RECURSIVE {_LINKS},
trusted AS (
  SELECT g.group_id, r.*, row_number() OVER (PARTITION BY g.group_id ORDER BY
    (coalesce(len(warnings), 0) = 0) DESC, coalesce(len(skills), 0) DESC, coalesce(length(raw_text), 0) DESC,
    CASE regexp_replace(lower(trim(extraction_method)), '[\s_]+', '-', 'g') {' '.join(f"WHEN '{k}' THEN {v}" for k, v in FORMAT_RANK.items())} ELSE 1 END DESC,
    doc_id DESC) AS place
  FROM resumes r JOIN groups g ON g.resume_id = r.resume_id
),
usable AS (
  SELECT group_id, 'name' AS field_name, resume_id, place FROM trusted WHERE regexp_matches(name, '\p{{L}}') AND NOT regexp_matches(name, '\p{{N}}') AND lower(trim(name)) NOT IN ({_NO_NAME})
  UNION ALL SELECT group_id, 'email', resume_id, place FROM trusted
    WHERE regexp_matches(trim(email), '^[A-Za-z0-9._%+''-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$')
    AND NOT regexp_matches(lower(trim(email)), '^(dummy|sample|test|example|placeholder|noreply|no-reply|yourname|firstname|lastname|abc|xyz|email|your|candidate|applicant)\b')
    AND NOT regexp_matches(lower(trim(email)), '@(dummy|sample|test|example|placeholder|noreply|no-reply|yourname|firstname|lastname|abc|xyz|email|your|candidate|applicant)\b')
  UNION ALL SELECT group_id, 'phone', resume_id, place FROM trusted
    WHERE length(regexp_replace(phone, '\D', '', 'g')) BETWEEN 10 AND 13 AND length(replace(regexp_replace(phone, '\D', '', 'g'), left(regexp_replace(phone, '\D', '', 'g'), 1), '')) > 0
    AND regexp_replace(phone, '\D', '', 'g') NOT IN ('1234567890', '0123456789')
  UNION ALL SELECT group_id, 'years_experience', resume_id, place FROM trusted WHERE years_experience BETWEEN 0 AND 45 AND NOT isnan(years_experience)
  UNION ALL SELECT group_id, 'raw_text', resume_id, place FROM trusted WHERE regexp_matches(raw_text, '\S') AND lower(trim(raw_text)) NOT IN ({_MISSING})
)
SELECT group_id, field_name, CAST(arg_min(resume_id, place) AS BIGINT) AS resume_id FROM usable GROUP BY group_id, field_name
"""

_P3 = """
WITH last AS (
  SELECT job_id, resume_id, score, coalesce(is_duplicate, false) AS dup,
    row_number() OVER (PARTITION BY job_id, resume_id ORDER BY scored_at DESC NULLS LAST, loaded_at DESC NULLS LAST, ranking_id DESC) AS n
  FROM ranked_candidates WHERE job_id IS NOT NULL AND resume_id IS NOT NULL
),
placed AS (
  SELECT job_id, CAST(resume_id AS BIGINT) AS resume_id, score, CAST(row_number() OVER (PARTITION BY job_id ORDER BY score DESC, dup, resume_id) AS INTEGER) AS rank
  FROM last WHERE n = 1 AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 100
)
SELECT {columns} FROM placed WHERE rank <= 10
"""

_P6 = r"""
WITH words AS (
  SELECT CAST(resume_id AS BIGINT) AS id, list_filter(string_split(regexp_replace(lower(raw_text), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM resumes WHERE raw_text IS NOT NULL
),
sets AS (
  SELECT id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words WHERE len(w) > 0
),
grams AS (SELECT id, unnest(s) AS g FROM sets),
both_of AS (SELECT a.id AS x, b.id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
SELECT x AS resume_a, y AS resume_b FROM both_of JOIN sets p ON p.id = x JOIN sets q ON q.id = y
WHERE n / (len(p.s) + len(q.s) - n) >= 0.7
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p2_found": f"WITH RECURSIVE {_LINKS} SELECT resume_id, group_id FROM groups",
        "p3_found": _P3.format(columns="job_id, resume_id"),
        "p3_ranked": _P3.format(columns="job_id, resume_id, score, rank"),
        "p6_found": _P6,
    }
