"""Questions about a ranking, routed by wording to one of the views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import found
from . import skills

# The wording that calls for each view, in the order in which they are tried.
INTENTS = (
    ("compare", r"(?i)\b(?:why\s+is|why\s+are|compare|difference\s+between|vs\.?|versus)\b.+\b(?:above|over|higher\s+than|better\s+than|ahead\s+of|vs\.?|versus|and)\b"),
    ("flags", r"(?i)\b(?:flag|flagged|suspicious|suspect|fraud|fake|inflated|lying|red\s+flag|concern|worried|trust)\b"),
    ("confidence", r"(?i)\b(?:confiden|convincing|credible|believable|evidence|substantiat|backed\s+up|proof|real\s+work)\b"),
    ("gaps", r"(?i)\b(?:gap|gaps|missing|nobody|no\s+one|weakest|scarce|hard\s+to\s+find|pool\s+(?:is\s+)?(?:missing|lacking|weak))\b"),
    ("add_requirement", r"(?i)\b(?:i\s+(?:want|need|am\s+looking\s+for|'?d\s+like)|we\s+(?:want|need|are\s+looking\s+for)|looking\s+for|must\s+(?:have|be)|should\s+(?:have|be|know)|prioriti[sz]e|care\s+more\s+about|ideal\s+candidate|my\s+ideal)\b"),
    ("who_lacks", r"(?i)\b(?:who|which\s+candidates?)\b.*\b(?:lacks?|missing|without|does\s*n[o']t\s+have|do\s*n[o']t\s+have|no\s+experience)\b"),
    ("who_has", r"(?i)\b(?:who|which\s+candidates?|anyone|any\s+candidate)\b.*\b(?:has|have|knows?|with|worked\s+with|used|experience\s+(?:in|with))\b"),
    ("filter", r"(?i)\b(?:show\s+me|filter|only|at\s+least|more\s+than|less\s+than|minimum|under|over|fresher|freshers?\s+only)\b"),
    ("explain", r"(?i)\b(?:why|explain|tell\s+me\s+about|what\s+about|how\s+did|reason\s+for)\b"),
    ("best", r"(?i)\b(?:who\s+should\s+i|best|top\s*\d*|shortlist|recommend|interview|pick|strongest|front\s*runner)\b"),
)


def intent(question: Column) -> Column:
    """The first view whose wording a question has; ``unknown`` if none."""
    return reduce(lambda c, kv: c.when(question.rlike(kv[1]), kv[0]), INTENTS, F.when(F.lit(False), "")).otherwise("unknown")


# How a question states years, an upper bound, beginners and a number of best ones.
YEARS = r"(?i)(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:years?|yrs?)"
AT_MOST = r"(?i)\b(?:under|less\s+than|below|at\s+most|no\s+more\s+than)\b"
BEGINNERS = r"(?i)\bfresher|student|no\s+experience\b"
TOP = r"(?i)top\s*(\d{1,2})"
THIN, SCARCE = 40, 25


def parsed(questions: DataFrame, key: str, text: str, ontology: DataFrame, *keep: str) -> DataFrame:
    """(key, keep..., intent, asked, years, at_most, beginners, n, refs): what a question asks for and of whom.

    ``asked`` are the skills it names, ``n`` how many best ones it wants (3 if
    it doesn't say), ``refs`` the whole numbers in it, as ranks. A null
    question asks for nothing and is ``unknown``.
    """
    rows = questions.select(key, *keep, F.coalesce(F.col(text), F.lit("")).alias("q"))
    rows = rows.withColumn("lines", F.transform(F.split("q", "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), x.alias("line"), F.lit("skills").alias("label"))))
    q = F.col("q")
    return skills.mentions(rows, "lines", ontology, best=True).select(
        key, *keep, intent(q).alias("intent"), F.array_sort(F.transform("hits", lambda h: h["skill_key"])).alias("asked"), F.nullif(F.regexp_extract(q, YEARS, 1), F.lit("")).cast("double").alias("years"),
        q.rlike(AT_MOST).alias("at_most"), q.rlike(BEGINNERS).alias("beginners"), F.greatest(F.lit(1), F.coalesce(F.nullif(F.regexp_extract(q, TOP, 1), F.lit("")).cast("int"), F.lit(3))).alias("n"),
        F.transform(F.filter(found(q, r"\d+"), lambda x: F.length(x) < 7), lambda x: x.cast("int")).alias("refs"),
    )
