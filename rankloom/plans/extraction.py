"""Queries of operators that SQL can't express: counted, and tested on fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import normalized, rejoin_wrapped
from ..functions.text import EMAIL, PLACEHOLDER_MAIL, found
from ..session import table
from ..sources import sinks
from . import views


def normalize_nfkc(spark, d):
    return table(spark, d, "documents").select("doc_id", normalized(F.col("text")).alias("text"))


def rejoin_wrapped_lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", rejoin_wrapped(F.col("text")).alias("text"))


def name_guess(spark, d):
    """A labelled name, else the first plausible of the first ten lines, else from the e-mail address."""
    t = F.coalesce("raw_text", F.lit(""))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    labelled = F.filter(F.transform(F.slice(lines, 1, 14), lambda x: F.regexp_extract(x, r"(?i)^(?:name|candidate\s*name|full\s*name)\s*[:\-]\s*(.+)$", 1)), lambda x: x != "")
    part = F.transform(F.slice(lines, 1, 10), lambda x: F.regexp_replace(F.split(x, r"\s{2,}|\s\|\s", 2)[0], r"^[ |,-]+|[ |,-]+$", ""))
    banned = r"(?i)resume|curriculum|vitae|profile|objective|summary|application|contact|mobile|phone|email|address|skills|education|experience|projects|@|http"
    plain = F.filter(part, lambda x: (x != "") & ~x.rlike(banned) & x.rlike(r"^[A-Za-z.'\-]+(?: [A-Za-z.'\-]+){0,4}$") & (F.length(x) <= 45))
    mail = F.try_element_at(found(t, EMAIL), F.lit(1))
    from_mail = F.when(~F.lower(mail).rlike(PLACEHOLDER_MAIL), F.initcap(F.trim(F.regexp_replace(F.split(mail, "@")[0], r"[._\-0-9]+", " "))))
    return table(spark, d, "resumes").select("resume_id", F.coalesce(F.try_element_at(labelled, F.lit(1)), F.try_element_at(plain, F.lit(1)), from_mail, F.lit("Unknown Candidate")).alias("name"))


def json_payload(spark, d):
    return sinks.payload(views.ranked_report(spark, d))


QUERIES = {f.__name__: f for f in (normalize_nfkc, rejoin_wrapped_lines, name_guess, json_payload)}
SQL: dict[str, str] = {}
