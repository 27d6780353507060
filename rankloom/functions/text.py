"""Column builders for text: words, lines, headings, contacts, experience, education.

All are JVM expressions. Patterns are written so that Java and RE2 read them
alike (explicit ASCII classes, no lookaround).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CHUNK_MAX_WORDS, CHUNK_MIN_WORDS

# Words that carry no meaning in a ranking.
STOPWORDS = (
    "a an the and or but if then than so as of in on at to for with by from into about over under is are was were be been being am do does did have has had having will would shall "
    "should can could may might must this that these those it its we our you your they their he she his her i me my who whom which what when where how why all any both each few more "
    "most other some such no nor not only own same too very s t just also well using use used work working years year role team company job position candidate applicant etc including "
    "good strong excellent ability able new across"
).split()

# Headings of a resume, by section.
SECTION_HEADINGS = {
    "summary": "summary|profile|professional summary|career objective|objective|profile summary|about me|career summary|executive summary|personal profile|career profile|professional profile|overview",
    "skills": "skills|technical skills|technical skill|skill set|skillset|core competencies|competencies|technical expertise|technical proficiency|technologies|tech stack|areas of expertise|key skills|it skills|computer skills|technical summary|software skills|tools and technologies|programming skills|expertise|technical knowledge|proficiencies",
    "experience": "experience|work experience|professional experience|employment|employment history|work history|career history|professional background|industry experience|relevant experience|internship|internships|internship experience|work|positions held|organizational experience",
    "projects": "projects|project|academic projects|personal projects|key projects|project undertaken|projects undertaken|project details|project experience|major projects|minor project|project work|selected projects|project profile|notable projects",
    "education": "education|academic|academics|educational qualification|educational qualifications|academic qualification|academic qualifications|educational details|academic details|qualification|qualifications|education and training|academic background|scholastics",
    "certifications": "certifications|certification|certificates|courses|training|trainings|licenses|professional development|workshops|certifications and training|online courses",
    "achievements": "achievements|accomplishments|awards|honors|honours|awards and achievements|achievements and awards|extra curricular activities|extracurricular activities|co-curricular activities|activities|positions of responsibility|publications",
    "personal": "personal details|personal information|personal profile details|declaration|references|hobbies|interest|interests|interest & hobbies|hobbies and interests|languages known|personal attributes|strengths",
}

# Patterns of contacts, stated experience, degrees and student markers.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{3,5}\)?[\s.-]?)?\d{3}[\s.-]?\d{4}\b"
LINK = r"(?i)(?:https?://|www\.)[^\s,;)<>\]]+"
STATED_YEARS = r"(?i)(\d{1,2}(?:\.\d{1,2})?)\s*\+?\s*(?:years?|yrs?)\s*(?:\d+\s*months?\s*)?(?:of\s+)?(?:professional\s+|relevant\s+|hands[\s-]?on\s+|total\s+|overall\s+)?(?:work\s+|industry\s+|it\s+)?(?:experience|exp\b)"
STATED_MONTHS = r"(?i)(\d{1,2})\s*\+?\s*months?\s*(?:of\s+)?(?:experience|exp\b)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SPAN = (
    r"(?i)(?:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*,?\s*)?((?:19|20)[0-9]{2})\s*(?:-|–|—|to|until|through)\s*"
    r"(?:(?:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*,?\s*)?((?:19|20)[0-9]{2})|(present|current|till date|date|now|ongoing))"
)
DEGREES = (
    (4, r"(?i)\b(ph\.?\s?d|doctorate|doctoral)\b"),
    (3, r"(?i)\b(m\.?\s?tech|m\.?\s?e\b|m\.?\s?sc|m\.?\s?c\.?\s?a|mba|master'?s?|post\s?graduat)"),
    (2, r"(?i)\b(b\.?\s?tech|b\.?\s?e\b|b\.?\s?sc|b\.?\s?c\.?\s?a|b\.?\s?com|bachelor'?s?|under\s?graduat|engineering\s+degree)"),
    (1, r"(?i)\b(diploma|polytechnic|12th|higher\s+secondary|intermediate|hsc)\b"),
)
STUDENT = (
    r"(?i)\b(fresher|fresh\s+graduate|final\s+year|pre[\s-]?final\s+year|3rd\s+year|third\s+year|2nd\s+year|second\s+year|pursuing|currently\s+studying|"
    r"undergraduate\s+student|expected\s+graduation|seeking\s+an?\s+internship)\b"
)
PLACEHOLDER_MAIL = (
    r"(?i)(^|@)(dummy|sample|test|example|placeholder|noreply|no-reply|yourname|firstname|lastname|abc|xyz|email|your|candidate|applicant)\b"
    r"|@(example|test|sample|domain|email|mail)\.(com|org|net|in)$"
)
UNRELIABLE_NAME = r"(?i)^(unknown candidate|dummy|candidate\s*\d|applicant\s*\d|resume|cv|n/?a|test user|your name|first ?last)\b"
NAME_NOISE = r"(?i)\b(mr|mrs|ms|dr|prof|resume|cv|curriculum|vitae)\b"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, as an array (empty for null)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """Lower-case terms with technical punctuation; stop words, single characters but c and r, and bare years are dropped."""
    raw = F.transform(found(F.lower(text), "[a-z0-9][a-z0-9+#./_-]*"), lambda t: F.btrim(t, F.lit("./-_")))
    return F.filter(raw, lambda t: ((F.length(t) >= 2) | t.isin("c", "r")) & ~t.isin(*STOPWORDS) & ~((F.length(t) == 4) & t.rlike("^[0-9]{4}$")))


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): the lines of each text, from 1; a null text has none."""
    return rows.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, "\n")).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_no"), "line")


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"[ \t]+"), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used; for use inside lambdas, where no projection can hold it."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def looks_like_heading(line: Column) -> Column:
    """At most 60 characters and 6 words, no closing ``. , ;``, and mostly capitals, a closing colon, or capitalised words."""

    def shape(s: Column) -> Column:
        letters, upper = F.regexp_count(s, F.lit("[A-Za-z]")), F.regexp_count(s, F.lit("[A-Z]"))
        capped = F.forall(words_of(s), lambda w: ~w.rlike("^[a-z]"))
        return (F.length(s) > 0) & (F.length(s) <= 60) & ~s.rlike("[.,;]$") & (F.size(words_of(s)) <= 6) & (letters > 0) & ((upper / letters > 0.7) | s.endswith(":") | capped)

    return bound(F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", ""), shape)


def heading_key(line: Column) -> Column:
    """A heading without edges of signs, in lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.trim(line), r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "")), r"\s+", " "))


def section_of(key: Column) -> Column:
    """The section a heading names: an exact synonym, else the longest contained one (of 6 characters or more, at most 18 shorter)."""
    pairs = sorted(((s, name) for name, all_of in SECTION_HEADINGS.items() for s in all_of.split("|")), key=lambda p: (-len(p[0]), p[0]))
    exact = F.create_map(*[F.lit(x) for name, all_of in SECTION_HEADINGS.items() for syn in all_of.split("|") for x in (syn, name)])
    longest_first = F.array(*[F.struct(F.lit(syn).alias("syn"), F.lit(name).alias("sec")) for syn, name in pairs if len(syn) >= 6])
    within = F.filter(longest_first, lambda p: F.contains(key, p["syn"]) & (F.length(key) <= F.length(p["syn"]) + 18))
    inside = F.when(key.rlike("|".join(syn for syn, _ in pairs if len(syn) >= 6)), within)  # few keys hold any
    return F.coalesce(F.try_element_at(exact, key), F.try_element_at(inside, F.lit(1))["sec"])


def sectioned(rows: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, keep..., sl): each text's lines as an array of (line_no, line, section, is_heading); null for a null text.

    Headings are found first; the stretches between them are then laid out one
    after another, so a text is walked twice and nothing is shuffled.
    """
    ls = rows.select(key, *keep, F.split(text, "\n").alias("_ls"))
    mark = lambda x: F.when(looks_like_heading(x), bound(heading_key(x), section_of))
    found_in = ls.withColumn("_hs", F.filter(F.transform("_ls", lambda x, i: F.struct(i.alias("at"), mark(x).alias("sec"))), lambda h: h["sec"].isNotNull()))
    heads = found_in.withColumn("_hs", F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("other").alias("sec"))), "_hs"))
    cut_up = heads.withColumn("_bs", F.transform("_hs", lambda h, k: F.struct(h["at"].alias("at"), h["sec"].alias("sec"), F.coalesce(F.try_element_at(F.col("_hs"), k + 2)["at"], F.size("_ls")).alias("stop"))))

    def lay(b: Column) -> Column:
        first = F.greatest(b["at"], F.lit(0))
        return F.transform(F.slice("_ls", first + 1, b["stop"] - first), lambda x, j: F.struct((first + j + 1).alias("line_no"), x.alias("line"), b["sec"].alias("section"), ((b["at"] >= 0) & (j == 0)).alias("is_heading")))

    return cut_up.select(key, *keep, F.flatten(F.transform("_bs", lay)).alias("sl"))


def sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, section, is_heading): each line's section, carried forward from the last heading; ``other`` before the first."""
    # the outer form: for the inner one the optimizer infers a filter on the array's size and computes the array twice
    return sectioned(rows.where(F.col(text).isNotNull()), key, text).select(key, F.inline_outer("sl"))


def chunks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, line_no, chunk_no, text): lines, and in the skills section their ``|`` and ``;`` parts, without bullets; shorter than
    4 words only in the skills section; longer than 80 words in windows of 80."""
    body = sections(rows, key, text).where("not is_heading")
    part = F.when(F.col("section") == "skills", F.split("line", "[|;]")).otherwise(F.array("line"))
    cut = body.select(key, "section", "line_no", F.posexplode(part).alias("part_no", "raw"))
    clean = cut.withColumn("t", F.trim(F.regexp_replace(F.trim("raw"), r"^[-*•●▪·–—]+[ \t]*", "")))
    kept = clean.withColumn("w", words_of(F.col("t"))).where(F.when(F.col("section") == "skills", F.length("t") > 2).otherwise(F.size("w") >= CHUNK_MIN_WORDS))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(CHUNK_MAX_WORDS))
    each = kept.select(key, "section", "line_no", "part_no", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i + 1, F.lit(CHUNK_MAX_WORDS)), " "))).alias("window_no", "text"))
    return each


def first_phone(text: Column) -> Column:
    """The first phone pattern with 10 to 13 digits."""
    ok = F.filter(found(text, PHONE), lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(10, 13))
    return F.trim(F.try_element_at(ok, F.lit(1)))


def links_of(text: Column) -> Column:
    return F.slice(F.array_distinct(found(text, LINK)), 1, 5)


def stated_years(text: Column) -> Column:
    """The largest stated number of years (above 0, at most 45), else of months / 12; null if none."""
    years = F.filter(F.transform(found(text, STATED_YEARS, 1), lambda v: v.cast("double")), lambda v: (v > 0) & (v <= 45))
    months = F.filter(F.transform(found(text, STATED_MONTHS, 1), lambda v: v.cast("double")), lambda v: (v > 0) & (v <= 120))
    return F.coalesce(F.array_max(years), F.array_max(months) / 12)


def span_years(text: Column, as_of: tuple[int, int]) -> Column:
    """The years that the dated spans of a text cover, overlaps once and gaps of up to 0.1 closed; 0 without one."""
    g = lambda i: found(text, SPAN, i)
    month = lambda name, none: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)), F.lit(0)), F.lit(none))
    year, now = as_of[0], as_of[0] + as_of[1] / 12
    raw = F.arrays_zip(g(1).alias("sm"), g(2).alias("sy"), g(3).alias("em"), g(4).alias("ey"), g(5).alias("now"))
    span = F.transform(raw, lambda r: F.struct(
        (r["sy"].cast("int") + (month(r["sm"], 1) - 1) / 12).alias("s"), F.when(r["now"] != "", F.lit(now)).otherwise(F.nullif(r["ey"], F.lit("")).cast("int") + month(r["em"], 12) / 12).alias("e")))
    ok = F.array_sort(F.filter(span, lambda r: (r["s"] >= 1980) & (r["s"] <= year + 1) & (r["s"] < r["e"]) & (r["e"] <= year + 1.5)))

    def add(done: Column, r: Column) -> Column:
        joined = r["s"] <= done["reach"] + 0.1
        return F.struct((done["total"] + F.when(joined, F.greatest(r["e"] - done["reach"], F.lit(0.0))).otherwise(r["e"] - r["s"])).alias("total"), F.greatest(r["e"], done["reach"]).alias("reach"))

    return F.round(F.aggregate(ok, F.struct(F.lit(0.0).alias("total"), F.lit(-1.0).cast("double").alias("reach")), add, lambda done: done["total"]), 2)


def experience(text: Column, work: Column, as_of: tuple[int, int]) -> Column:
    """A struct of years and their source: stated years, else stated months, else the spans of the work and project lines (of the whole text without such), else none."""
    years = F.array_max(F.filter(F.transform(found(text, STATED_YEARS, 1), lambda v: v.cast("double")), lambda v: (v > 0) & (v <= 45)))
    months = F.array_max(F.filter(F.transform(found(text, STATED_MONTHS, 1), lambda v: v.cast("double")), lambda v: (v > 0) & (v <= 120)))
    of = lambda value, source: F.struct(F.round(value, 2).alias("years"), F.lit(source).alias("source"))
    spans = bound(span_years(F.when(work == "", text).otherwise(work), as_of), lambda v: F.when(v > 0, of(v, "computed from employment date ranges")).otherwise(of(F.lit(0.0), "no experience signal found (treated as fresher)")))
    return F.when(years.isNotNull(), of(years, "stated in resume text")).when(months.isNotNull(), of(months / 12, "stated in months")).otherwise(spans)


def education_level(text: Column) -> Column:
    return reduce(lambda c, d: c.when(text.rlike(d[1]), d[0]), DEGREES, F.when(F.lit(False), 0)).otherwise(0)


def name_key(name: Column) -> Column:
    """A name's words, sorted, without titles."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), NAME_NOISE, " "), "[^a-z ]+", " ")
    return F.array_join(F.array_sort(F.filter(F.split(bare, " +"), lambda w: w != "")), " ")


def reliable_name(name: Column) -> Column:
    bare = F.trim(name)
    return F.coalesce((F.length(bare) >= 4) & ~bare.rlike(UNRELIABLE_NAME) & ~name.rlike("[0-9]"), F.lit(False))


def phone_key(phone: Column) -> Column:
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def listed(items: Column, limit: int = 6) -> Column:
    """``a, b and c (+n more)``; ``none`` if empty."""
    kept = F.filter(items, lambda i: i.isNotNull() & (i != ""))
    shown = F.slice(kept, 1, limit)
    more = F.size(kept) - F.size(shown)
    body = F.when(F.size(shown) == 1, F.try_element_at(shown, F.lit(1))).otherwise(F.concat(F.array_join(F.slice(shown, F.lit(1), F.greatest(F.size(shown) - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(shown, F.lit(-1))))
    return F.when(F.size(kept) == 0, "none").otherwise(F.concat(body, F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")))
