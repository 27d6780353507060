"""Job texts: bullets under headings, what they ask for, seniority and experience."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import found, lines, looks_like_heading, words_of

# Heading and wording patterns of job texts.
REQUIRED = r"(?i)\b(requirements?|required\s+skills?|must[\s-]?haves?|qualifications?|minimum\s+qualifications?|what\s+we(?:'re|\s+are)\s+looking\s+for|who\s+you\s+are|skills?\s+(?:&|and)\s+(?:experience|qualifications?)|essential|eligibility|technical\s+requirements?|key\s+skills?|candidate\s+profile)\b"
PREFERRED = r"(?i)\b(nice[\s-]?to[\s-]?haves?|preferred(?:\s+qualifications?|\s+skills?)?|bonus|good\s+to\s+have|desirable|plus(?:es)?|optional|we(?:'d|\s+would)\s+love|additional\s+skills?|advantageous)\b"
DUTIES = r"(?i)\b(responsibilities|what\s+you(?:'ll|\s+will)\s+do|duties|role\s+overview|day\s+to\s+day|key\s+responsibilities|the\s+role)\b"
NOISE = r"(?i)\b(about\s+(?:us|the\s+role|the\s+company)|job\s+description|the\s+opportunity|what\s+we\s+offer|benefits?|perks?|compensation|salary|how\s+to\s+apply|application\s+process|location|duration|stipend|why\s+join|our\s+(?:culture|values|mission)|equal\s+opportunity|disclaimer|company\s+(?:overview|profile))\b"
ASKS = r"(?i)\b(experience|knowledge|understanding|proficien|familiar|exposure|skills?|ability|able\s+to|comfortable|degree|pursuing|graduat|must|should|required?|expected|build|design|implement|develop|write|maintain|work\s+with|participate|debug|test|deploy|manage|hands[\s-]?on)\b"
PREFERRED_INLINE = r"(?i)\b(is\s+a\s+plus|are\s+a\s+plus|a\s+plus\b|nice\s+to\s+have|good\s+to\s+have|preferred|bonus\s+points?|would\s+be\s+(?:a\s+)?(?:plus|advantage|great)|familiarity\s+with|exposure\s+to|awareness\s+of|basic\s+(?:understanding|knowledge)\s+of|desirable|optional|advantageous|ideally|willing(?:ness)?\s+to\s+learn)\b"
REQUIRED_INLINE = r"(?i)\b(must\s+have|must\s+be|required|require[sd]?\b|strong\s+(?:knowledge|command|grasp|understanding|experience|proficiency)|proficien(?:t|cy)\s+in|solid\s+(?:understanding|knowledge|grasp)|hands[\s-]?on\s+experience|demonstrated|essential|mandatory|should\s+have|expected\s+to)\b"
EXPERIENCE = r"(?i)(\d{1,2})\s*(?:\+|plus)?\s*(?:-|–|to)?\s*(\d{1,2})?\s*\+?\s*(?:years?|yrs?)(?:\s+of)?(?:\s+\w+){0,3}?\s*experience"
SENIORITY = (
    ("intern", r"(?i)\b(intern|internship|trainee|apprentice)\b"), ("junior", r"(?i)\b(junior|entry[\s-]?level|fresher|graduate|jr\.?|associate|0[\s-]?2\s+years)\b"),
    ("mid", r"(?i)\b(mid[\s-]?level|intermediate|software\s+engineer\s+ii)\b"), ("senior", r"(?i)\b(senior|sr\.?|lead|principal|staff|architect|head\s+of)\b"),
)
BULLET = r"^\s*(?:[-*•●▪·–—]|\d+[.)])\s+"
EDGE = r"^[ \-*•●▪·\t]+|[ \-*•●▪·\t]+$"


def bullets(jobs: DataFrame, key: str, text: str, noise: str = NOISE) -> DataFrame:
    """(key, line_no, line, heading): list items and sentences with the last heading before them; what stands below a noise heading is dropped."""
    ls = lines(jobs, key, text).withColumn("item", F.col("line").rlike(BULLET)).withColumn("t", F.regexp_replace(F.regexp_replace("line", EDGE, ""), r"^\d+[.)]\s+", "")).where("t <> ''")
    bare = F.regexp_replace("t", "^[ :]+|[ :]+$", "")
    short = (F.size(words_of(bare)) <= 6) & (F.length(bare) <= 55)
    known = F.lit(False)
    for p in (REQUIRED, PREFERRED, DUTIES, noise):
        known = known | bare.rlike(p)
    heading = ~F.col("item") & short & (looks_like_heading(F.col("line")) | known)
    marked = ls.withColumn("h", F.when(heading, bare))
    carry = F.coalesce(F.last("h", ignorenulls=True).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)), F.lit(""))
    out = marked.withColumn("heading", carry).where(F.col("h").isNull()).where(~F.col("heading").rlike(noise))
    return out.select(key, "line_no", F.col("t").alias("line"), "heading")


def classified(found_bullets: DataFrame, key: str) -> DataFrame:
    """Adds kind (wording beats heading; required by default) and kept (asks for something in 4 words or more)."""
    line, head = F.col("line"), F.col("heading")
    kind = F.when(line.rlike(PREFERRED_INLINE), "preferred").when(line.rlike(REQUIRED_INLINE), "required").when(head.rlike(PREFERRED), "preferred").otherwise("required")
    return found_bullets.withColumn("kind", kind).withColumn("kept", (F.size(words_of(line)) >= 4) & line.rlike(ASKS))


def responsibilities(found_bullets: DataFrame, key: str, n: int = 10) -> DataFrame:
    w = W.partitionBy(key).orderBy("line_no")
    return found_bullets.where(F.col("heading").rlike(DUTIES) & (F.size(words_of(F.col("line"))) > 3)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).select(key, "line_no", "line")


def seniority(text: Column, min_years: Column) -> Column:
    head = F.left(text, F.lit(1200))
    c = reduce(lambda c, kv: c.when(head.rlike(kv[1]), kv[0]), SENIORITY, F.when(F.lit(False), ""))
    c = reduce(lambda c, kv: c.when(text.rlike(kv[1]), kv[0]), SENIORITY, c)
    return c.when(min_years >= 6, "senior").when(min_years >= 3, "mid").otherwise("junior")


def least_years(text: Column) -> Column:
    """The smallest stated lower bound of years up to 40; 0 without one."""
    return F.coalesce(F.array_min(F.filter(F.transform(found(text, EXPERIENCE, 1), lambda v: v.cast("double")), lambda v: v <= 40)), F.lit(0.0))


def sql_bullets() -> str:
    """The SQL of ``bullets`` and ``classified``, as the start of a query."""
    q = lambda p: p.replace("'", "''")
    s = "regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')"
    words = lambda x: f"list_filter(regexp_split_to_array(trim({x}), '[ \\t]+'), lambda w: w <> '')"
    n = lambda p: f"len(regexp_extract_all({s}, '{p}'))"
    shape = (f"(length({s}) > 0 AND length({s}) <= 60 AND len({words(s)}) <= 6 AND NOT regexp_matches({s}, '[.,;]$') AND {n('[A-Za-z]')} > 0 AND ({n('[A-Z]')} / {n('[A-Za-z]')} > 0.7 OR ends_with({s}, ':') OR len(list_filter({words(s)}, lambda w: regexp_matches(w, '^[a-z]'))) = 0))")
    known = " OR ".join(f"regexp_matches(bare, '{q(p)}')" for p in (REQUIRED, PREFERRED, DUTIES, NOISE))
    return f"""
WITH l0 AS (SELECT job_id, unnest(string_split(jd_text, chr(10))) AS line, generate_subscripts(string_split(jd_text, chr(10)), 1)::INTEGER AS line_no FROM jobs WHERE jd_text IS NOT NULL),
l1 AS (SELECT *, regexp_matches(line, '{BULLET}') AS item, regexp_replace(regexp_replace(line, '{EDGE}', '', 'g'), '^\\d+[.)]\\s+', '') AS t FROM l0),
l2 AS (SELECT *, regexp_replace(t, '^[ :]+|[ :]+$', '', 'g') AS bare FROM l1 WHERE t <> ''),
l3 AS (SELECT *, CASE WHEN NOT item AND len({words('bare')}) <= 6 AND length(bare) <= 55 AND ({shape} OR {known}) THEN bare END AS h FROM l2),
l4 AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS heading FROM l3),
bul AS (SELECT job_id, line_no, t AS line, heading FROM l4 WHERE h IS NULL AND NOT regexp_matches(heading, '{q(NOISE)}')),
cls AS (SELECT *, CASE WHEN regexp_matches(line, '{q(PREFERRED_INLINE)}') THEN 'preferred' WHEN regexp_matches(line, '{q(REQUIRED_INLINE)}') THEN 'required' WHEN regexp_matches(heading, '{q(PREFERRED)}') THEN 'preferred' ELSE 'required' END AS kind,
  len({words('line')}) >= 4 AND regexp_matches(line, '{q(ASKS)}') AS kept FROM bul)
"""
