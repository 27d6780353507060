"""Rule-based checks: integrity flags, evidence confidence, phrasing audit of job texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import STUFF_MIN_SKILLS, STUFF_WORDS_PER_SKILL
from ..functions.text import found, words_of

# Patterns of the rules.
INJECTION = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?|disregard\s+(?:all\s+)?(?:previous|prior|the\s+above)|you\s+are\s+(?:an?\s+)?(?:ai|assistant|language\s+model|chatbot)"
    r"|(?:rank|rate|score|select|shortlist)\s+(?:this|me|the)\s+(?:candidate|resume|applicant)?\s*(?:as\s+)?(?:first|top|highest|number\s*1|100)|(?:give|assign)\s+(?:this\s+)?(?:resume|candidate|me)\s+(?:a\s+)?(?:score\s+of\s+)?(?:100|full\s+marks|maximum)"
    r"|system\s*(?:prompt|message)\s*:|<\s*/?\s*(?:system|instruction|prompt)\s*>|as\s+an\s+ai\s+(?:model|assistant)\s*,?\s*you\s+(?:must|should)|this\s+candidate\s+is\s+(?:the\s+)?(?:best|perfect|ideal)\s+(?:match|fit)\s+for"
)
SUPERLATIVE = r"(?i)\b(expert|mastery|master|guru|ninja|rockstar|world[\s-]class|unparalleled|exceptional|outstanding|best[\s-]in[\s-]class|10x\s+(?:developer|engineer))\b"
QUANTIFIED = (
    r"(?i)(\d+(?:\.\d+)?\s*%|\b\d+(?:\.\d+)?\s*[km]\b|\b\d{2,}\+?(?:\s+\w+){0,2}\s+(?:users?|requests?|records?|customers?|students?|downloads?|hours?|seconds?|queries|tests?|bugs?|commits?|problems?|projects?|articles?|"
    r"posts?|clients?|transactions?|rows?|endpoints?|screens?|components?)\b|\b\d+\s*ms\b|\bfrom\s+[\d.]+\s*\w{0,3}\s+to\s+[\d.]+|\b(?:increased|decreased|reduced|improved|cut|raised|grew|saved|optimi[sz]ed|scaled)\b[^.]{0,60}?\b\d)"
)
OWNERSHIP = r"(?i)\b(built|designed|implemented|developed|architected|shipped|deployed|led|owned|created|migrated|refactored|automated|integrated|scaled|debugged|wrote|launched|delivered|maintained)\b"
FILLER = (
    r"(?i)\b(familiar\s+with|exposure\s+to|basic\s+knowledge|good\s+knowledge|knowledge\s+of|aware\s+of|interested\s+in|willing\s+to\s+learn|hard\s?working|punctual|sincere|dedicated|positive\s+attitude|"
    r"team\s+player|quick\s+learner|can\s+work\s+under\s+pressure)\b"
)
YEAR_RANGE = r"((?:19|20)[0-9]{2})\s*(?:-|–|—|to)\s*((?:19|20)[0-9]{2})"
# Category, severity and pattern of wording that narrows who applies.
PHRASES = (
    ("age", "high", r"(?i)\b(young|youthful|energetic\s+young|recent\s+grad(?:uate)?s?\s+only|under\s+\d{2}\s*(?:years|yrs)?\s*(?:of\s*age|old)|digital\s+native|born\s+(?:after|in)\s+(?:19|20)\d{2}|age\s*(?:limit|below|under|max)\s*[:\-]?\s*\d{2}|fresh\s+blood|youngsters?)\b"),
    ("gender", "high", r"(?i)\b(he/she\s+must|salesman|salesmen|manpower|chairman|craftsman|guys\b|men\s+only|women\s+only|male\s+candidates?|female\s+candidates?|preferably\s+(?:male|female)|strong\s+man)\b"),
    ("marital/family", "high", r"(?i)\b(unmarried|married|single\s+candidates?|no\s+family\s+commitments?|not\s+planning\s+(?:a\s+)?(?:family|children)|marital\s+status)\b"),
    ("appearance", "medium", r"(?i)\b(good[\s-]?looking|attractive|presentable\s+(?:appearance|personality)|pleasing\s+personality|well[\s-]?groomed|smart\s+looking|height\s*[:\-]?\s*\d)"),
    ("nationality/language", "medium", r"(?i)\b(native\s+(?:english|hindi)\s+speaker|mother\s+tongue|only\s+(?:indian|local)\s+candidates?|must\s+be\s+a\s+citizen|no\s+visa\s+sponsorship\s+under\s+any)\b"),
    ("ability", "medium", r"(?i)\b(no\s+(?:health\s+issues|disabilit(?:y|ies))|physically\s+fit\s+candidates?\s+only|able[\s-]bodied)\b"),
    ("pedigree", "high", r"(?i)\b(tier[\s-]?(?:1|one|i)\s+(?:colleges?|institutes?|universit(?:y|ies))|iits?|nits?|bits\s+pilani|ivy\s+league|premier\s+institutes?\s+only|top\s+(?:tier|ranked)\s+(?:college|university|institute)s?\s+only|reputed\s+college\s+only)\b"),
    ("academic-cutoff", "medium", r"(?i)\b(cgpa|gpa|percentage|aggregate)\s*(?:of\s*)?(?:>=?|above|minimum|min\.?|not\s+less\s+than)?\s*\d{1,2}(?:\.\d{1,2})?\s*%?\b|no\s+(?:backlogs?|arrears?|standing\s+arrears?)"),
    ("career-gap", "high", r"(?i)\b(no\s+(?:career\s+)?gaps?|continuous\s+employment|unexplained\s+gaps?\s+(?:will\s+be\s+)?(?:not\s+)?(?:accepted|rejected)|must\s+be\s+currently\s+employed)\b"),
    ("over-narrow-version", "low", r"(?i)\b(?:react|angular|node(?:\.js)?|python|java|php|django|spring)\s*(?:v(?:ersion)?\s*)?\d{1,2}(?:\.\d{1,2}){1,2}\b"),
    ("over-narrow-exact-years", "medium", r"(?i)\b(?:exactly|precisely)\s+\d{1,2}\s*(?:years?|yrs?)|\b\d{1,2}\s*(?:years?|yrs?)\s*(?:experience\s*)?(?:only|exactly)\b"),
    ("commitment", "low", r"(?i)\b(work\s+hard,?\s+play\s+hard|rockstar|ninja|guru|wizard|willing\s+to\s+work\s+(?:long|extended)\s+hours|24/7\s+availability|no\s+work[\s-]life\s+balance|like\s+a\s+family|thrive\s+under\s+(?:extreme\s+)?pressure)\b"),
)


def integrity(rows: DataFrame, key: str, text: str, warnings: str, n_skills: str, in_work: str, this_year: int, experience: str, dated_years: str) -> DataFrame:
    """(key, code, severity): one row a rule that fires on a text; ``n_skills`` is the number of skills it names, ``in_work`` of those shown in work, ``experience`` a struct of years and source, ``dated_years`` the years its dates cover."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(F.regexp_replace(t, r"^\s+|\s+$", ""))
    warned = F.coalesce(F.size(warnings), F.lit(0)) > 0
    n_skills, n_words = F.col(n_skills), F.size(words_of(F.regexp_replace(t, r"[\r\n]+", " ")))
    backed = F.when(n_skills > 0, F.col(in_work) / n_skills).otherwise(1.0)
    years = F.transform(F.arrays_zip(found(t, YEAR_RANGE, 1).alias("a"), found(t, YEAR_RANGE, 2).alias("b")), lambda r: F.when(r["b"].cast("int") < r["a"].cast("int"), "timeline_inconsistent").when(r["b"].cast("int") > this_year + 1, "timeline_future"))
    first = F.try_element_at(F.filter(years, lambda x: x.isNotNull()), F.lit(1))
    supers = F.array_distinct(F.transform(found(t, SUPERLATIVE), lambda x: F.lower(x)))
    dump = F.exists(F.split(t, "\n"), lambda x: (F.regexp_count(x, F.lit(",")) >= 14) & (F.size(words_of(x)) < F.regexp_count(x, F.lit(",")) * 3))
    rule = lambda code, severity, when: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    all_of = F.array_compact(F.array(
        rule("keyword_stuffing", "medium", (n_skills >= STUFF_MIN_SKILLS) & (backed < 0.12)),
        rule("skill_density", "low", (n_skills >= STUFF_MIN_SKILLS + 10) & (backed >= 0.12) & (n_words < n_skills * STUFF_WORDS_PER_SKILL * 0.4)),
        rule("experience_unsupported", "medium", F.coalesce(F.col(experience)["source"].startswith("stated") & (F.col(experience)["years"] >= 2) & (F.col(dated_years) > 0) & (F.col(experience)["years"] > F.col(dated_years) * 2 + 1), F.lit(False))),
        rule("skill_dump_line", "low", dump),
        rule("prompt_injection", "high", t.rlike(INJECTION)),
        rule("timeline_inconsistent", "medium", F.coalesce(first == "timeline_inconsistent", F.lit(False))),
        rule("timeline_future", "low", F.coalesce(first == "timeline_future", F.lit(False))),
        rule("unsubstantiated_claims", "low", (F.size(supers) >= 3) & ~t.rlike(QUANTIFIED)),
        rule("unreadable", "high", n < 250), rule("very_short", "low", (n >= 250) & (n < 600)), rule("parse_warning", "low", (n >= 600) & warned),
        rule("no_skills_found", "medium", n_skills == 0),
    ))
    return rows.select(key, F.explode(all_of).alias("f")).select(key, "f.code", "f.severity")


def confidence(rows: DataFrame, key: str, text: str, warnings: str, links: str, in_work: str, n_skills: str, sections_found: str) -> DataFrame:
    """(key, score, band): how well a text's claims are evidenced, 0 to 100."""
    t = F.coalesce(F.col(text), F.lit(""))
    n, words = F.length(F.regexp_replace(t, r"^\s+|\s+$", "")), F.greatest(F.lit(1), F.size(words_of(F.regexp_replace(t, r"[\r\n]+", " "))))
    quantified = F.least(F.lit(1.0), F.size(F.array_distinct(F.transform(found(t, QUANTIFIED), lambda x: F.lower(x)))) / 5)
    own, filler = F.size(found(t, OWNERSHIP)), F.size(found(t, FILLER))
    ownership = F.when(own + filler > 0, own / (own + filler)).otherwise(0.0)
    backed = F.least(F.lit(1.0), F.col(in_work) / F.greatest(F.lit(3.0), F.greatest(F.lit(1), F.col(n_skills)) * 0.4))
    depth = F.size(F.array_intersect(F.col(sections_found), F.array(*[F.lit(s) for s in ("experience", "projects", "skills", "education", "certifications")]))) / 5
    has_links = F.when(F.coalesce(F.size(links), F.lit(0)) > 0, 1.0).otherwise(0.0)
    substance = F.when(words < 120, 0.15).when(words < 250, 0.55).when(words <= 1400, 1.0).otherwise(0.75)
    parse = F.when(n < 250, 0.35).when(n < 600, 0.8).when(F.coalesce(F.size(warnings), F.lit(0)) > 0, 0.85).otherwise(1.0)
    score = 100 * (quantified * 0.26 + ownership * 0.20 + backed * 0.22 + depth * 0.12 + has_links * 0.08 + substance * 0.12) * parse
    out = rows.select(key, F.round(score, 3).alias("score"))
    return out.withColumn("band", F.when(F.col("score") >= 70, "High").when(F.col("score") >= 50, "Moderate").when(F.col("score") >= 30, "Low").otherwise("Very low"))


def phrase_audit(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, category, severity, phrase): each distinct phrase of each rule found in a text."""
    t = F.coalesce(F.col(text), F.lit(""))
    def of(category: str, severity: str, pattern: str):
        phrases = F.array_distinct(F.transform(found(t, pattern), lambda x: F.lower(x)))
        return F.transform(phrases, lambda x: F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), x.alias("phrase")))

    hits = F.flatten(F.array(*[of(*p) for p in PHRASES]))
    return rows.select(key, F.explode(hits).alias("h")).select(key, "h.category", "h.severity", "h.phrase")


def structural_audit(jobs: DataFrame, demand: DataFrame) -> DataFrame:
    """(job_id, rule): junior posts with 10 or more required skills or 2 or more years, and 6 or more required with nothing preferred."""
    j = jobs.join(demand, "job_id", "left").fillna(0, ["n_required", "n_preferred"])
    junior = F.coalesce(F.col("seniority").isin("intern", "junior"), F.lit(False))
    rules = F.array_compact(F.array(F.when(junior & (F.col("n_required") >= 10), "overloaded"), F.when(junior & (F.col("min_years") >= 2), "experience-for-entry"), F.when((F.col("n_preferred") == 0) & (F.col("n_required") >= 6), "all-required")))
    return j.select("job_id", F.explode(rules).alias("rule"))
