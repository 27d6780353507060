"""Problem 1: one surviving record for each group of duplicates.

A latent two-sided quality model (a source's sensitivity: how often it states
what is true of a group it covers; its specificity: how rarely it states what
is not) is fitted by expectation-maximisation over all facts (group, field,
value). Sources are the extraction methods found in the data. Since a fact's
likelihood depends only on which methods cover the group and which of them
state the value, facts are first counted by (field, covering set, stating set):
at most 3^S patterns a field for S sources, whatever the number of rows. The
fit runs over those counts on the driver, and each fact's posterior is then a
sum of literals in a JVM expression, so no model is joined or broadcast.

Values known to be unusable (stand-ins, malformed contacts, impossible years)
are clamped false in the fit and count against their source's specificity.
``judged_survivors`` takes, of the values the model judges true, the one of the
best copy; ``retained_values`` keeps every value of a multi-valued field judged
true. ``survivors`` follows a given order of copies alone, for results that
must not depend on what other copies say.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .links import STAND_INS, is_stand_in

# The trust in an extraction method, the higher the better; anything else is 1.
FORMAT_RANK = {"xml": 5, "python-docx": 4, "pymupdf": 3, "pdfplumber": 3, "plaintext": 2, "pypdf": 2}
#: What stands for null methods and for those beyond the sources told apart.
OTHER = "other"
# What a parser writes when it found no name, and what is nobody's mailbox.
NAME_STAND_INS = ("unknown candidate", "candidate", "applicant", "resume", "cv", "curriculum vitae", "test user", "your name", "first last", "firstname lastname", "dummy", "name", *STAND_INS)
PLACEHOLDER_MAIL = (
    r"(?i)(^|@)(dummy|sample|test|example|placeholder|noreply|no-reply|yourname|firstname|lastname|abc|xyz|email|your|candidate|applicant)\b"
    r"|@(example|test|sample|domain|email|mail)\.(com|org|net|in)$"
)
ONE_ADDRESS = r"(?i)^[a-z0-9._%+'-]+@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$"

SINGLE = ("name", "email", "phone", "years_experience", "raw_text")
MULTI = ("skills", "links")


def method_key(method: Column) -> Column:
    """The extraction method without uneven spelling; null and blank ones are ``other``."""
    flat = F.regexp_replace(F.lower(F.trim(method)), r"[\s_]+", "-")
    return F.when(flat.isNull() | (flat == ""), OTHER).otherwise(flat)


def sources_of(resumes: DataFrame, most: int = 12) -> list[str]:
    """The ``most`` commonest extraction methods of the table and ``other``, for which all further ones count as one source."""
    counted = resumes.groupBy(method_key(F.col("extraction_method")).alias("method")).count().where(F.col("method") != OTHER)
    return sorted(r["method"] for r in counted.orderBy(F.col("count").desc(), "method").limit(most).collect()) + [OTHER]


def usable(field: str) -> Column:
    """Whether a column holds a value of the kind its field asks for."""
    value = F.col(field)
    if field == "years_experience":
        return value.isNotNull() & ~F.isnan(value) & value.between(0, 45)
    if field == "raw_text":
        return ~is_stand_in(value) & value.rlike(r"\S")
    if field == "name":
        bare = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
        return value.isNotNull() & value.rlike(r"\p{L}") & ~value.rlike(r"\p{N}") & ~bare.isin(*NAME_STAND_INS)
    if field == "email":
        return ~is_stand_in(value) & F.trim(value).rlike(ONE_ADDRESS) & ~F.trim(value).rlike(PLACEHOLDER_MAIL)
    digits = F.regexp_replace(value, r"\D", "")
    fake = digits.rlike(r"^(\d)\1+$") | digits.isin("1234567890", "0123456789")
    return ~is_stand_in(value) & F.length(digits).between(10, 13) & ~fake


def value_key(field: str) -> Column:
    """What two copies must share to state the same value, as a 64-bit key."""
    value = F.col(field)
    if field == "phone":
        return F.xxhash64(F.right(F.regexp_replace(value, r"\D", ""), F.lit(10)))
    if field == "years_experience":
        return F.xxhash64(F.round(value, 1))
    if field == "name":
        words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), r"\b(mr|mrs|ms|dr|prof)\b\.?", " "), r"[^\p{L}]+", " ")), " ")
        return F.xxhash64(F.array_join(F.array_sort(words), " "))
    return F.xxhash64(F.lower(F.trim(value)))


@dataclass(frozen=True)
class Quality:
    """The fitted model: per source sensitivity and specificity, per field the prior of truth."""

    sensitivity: dict[str, float]
    specificity: dict[str, float]
    prior: dict[str, float]
    rounds: int

    def posterior(self, field: Column, covered: Column, stated: Column) -> Column:
        """The probability that a fact is true, from its two method sets."""
        start = reduce(lambda c, kv: c.when(field == kv[0], float(np.log(kv[1] / (1 - kv[1])))), self.prior.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
        logit = start
        for bit, name in enumerate(self.sensitivity):
            sens, spec = self.sensitivity[name], self.specificity[name]
            yes, no = float(np.log(sens / (1 - spec))), float(np.log((1 - sens) / spec))
            logit = logit + F.when(stated.bitwiseAND(F.lit(1 << bit)) != 0, yes).when(covered.bitwiseAND(F.lit(1 << bit)) != 0, no).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def facts(claims: DataFrame, sources: list[str]) -> DataFrame:
    """Claims (group_id, field_name, value, ok, method) as one row a fact with its two method sets.

    Both aggregates combine before the shuffle, so a group that holds a third
    of all rows is a few hundred partial rows.
    """
    bit = reduce(lambda c, kv: c.when(F.col("method") == kv[1], F.lit(1 << kv[0]).cast("long")), enumerate(sources), F.when(F.lit(False), F.lit(0).cast("long"))).otherwise(F.lit(1 << (len(sources) - 1)).cast("long"))
    one = claims.groupBy("group_id", "field_name", "value").agg(F.bit_or(bit).alias("stated"), F.max("ok").alias("ok"))
    cover = claims.groupBy("group_id", "field_name").agg(F.bit_or(bit).alias("covered"))
    return one.join(cover, ["group_id", "field_name"])


def fit(found: DataFrame, sources: list[str], max_rounds: int = 50, tolerance: float = 1e-6) -> Quality:
    """Fits the model over all facts, by way of their pattern counts."""
    rows = found.groupBy("field_name", "covered", "stated", "ok").count().collect()  # at most fields x 2 x 3^sources rows, by construction
    if not rows:
        return Quality(dict.fromkeys(sources, 0.7), dict.fromkeys(sources, 0.7), {}, 0)
    names = sorted({r[0] for r in rows})
    at = np.array([names.index(r[0]) for r in rows])
    bits = 1 << np.arange(len(sources))
    covered = (np.array([r[1] for r in rows])[:, None] & bits) != 0
    stated = (np.array([r[2] for r in rows])[:, None] & bits) != 0
    live, n = np.array([bool(r[3]) for r in rows]), np.array([r[4] for r in rows], dtype=float)
    sens, spec, prior = np.full(len(bits), 0.8), np.full(len(bits), 0.7), np.full(len(names), 0.6)
    for step in range(1, max_rounds + 1):
        logit = np.log(prior / (1 - prior))[at]
        logit = logit + np.where(stated, np.log(sens / (1 - spec)), np.where(covered, np.log((1 - sens) / spec), 0.0)).sum(axis=1)
        true = np.where(live, 1 / (1 + np.exp(-np.clip(logit, -500, 500))), 0.0)
        t, f = (n * true)[:, None], (n * (1 - true))[:, None]
        # Beta(2, 1) priors keep a source that is hardly seen near its start
        new_sens = ((t * stated).sum(axis=0) + 2) / ((t * covered).sum(axis=0) + 3)
        new_spec = ((f * (covered & ~stated)).sum(axis=0) + 2) / ((f * covered).sum(axis=0) + 3)
        new_prior = np.array([((n * true)[at == i].sum() + 1) / (n[at == i].sum() + 2) for i in range(len(names))])
        new_sens, new_spec, new_prior = (np.clip(x, 1e-4, 1 - 1e-4) for x in (new_sens, new_spec, new_prior))
        moved = max(np.abs(new_sens - sens).max(), np.abs(new_spec - spec).max(), np.abs(new_prior - prior).max())
        sens, spec, prior = new_sens, new_spec, new_prior
        if moved < tolerance:
            break
    return Quality(dict(zip(sources, sens.tolist())), dict(zip(sources, spec.tolist())), dict(zip(names, prior.tolist())), step)


def copies(resumes: DataFrame, groups: DataFrame) -> DataFrame:
    """One narrow row a copy: for each single-valued field its key and usability, and the copy's order of trust."""
    method = method_key(F.col("extraction_method"))
    rank = reduce(lambda c, kv: c.when(method == kv[0], kv[1]), FORMAT_RANK.items(), F.when(F.lit(False), 1)).otherwise(1)
    order = F.struct(
        (F.coalesce(F.size(F.filter("warnings", lambda w: w.isNotNull())), F.lit(0)) <= 0).alias("clean"),
        F.greatest(F.coalesce(F.size("skills"), F.lit(0)), F.lit(0)).alias("n_skills"),
        F.coalesce(F.length("raw_text"), F.lit(0)).alias("n_chars"),
        rank.alias("format_rank"),
        F.coalesce("doc_id", F.lit("")).alias("doc_id"),
        F.col("resume_id"),
    )
    slim = resumes.select(
        F.col("resume_id").cast("long").alias("resume_id"), method.alias("method"), order.alias("trust"),
        *(F.when(F.col(f).isNotNull(), F.struct(value_key(f).alias("value"), F.coalesce(usable(f), F.lit(False)).alias("ok"))).alias(f) for f in SINGLE),
    )
    return slim.join(groups, "resume_id")


def _claims(members: DataFrame) -> DataFrame:
    each = members.select("group_id", "resume_id", "method", "trust", F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("claim")) for f in SINGLE))).alias("x"))
    return each.select("group_id", "resume_id", "method", "trust", "x.field_name", F.col("x.claim.value").alias("value"), F.col("x.claim.ok").alias("ok")).where("value is not null")


def survivors(members: DataFrame) -> DataFrame:
    """(group_id, field_name, resume_id): the first copy, in the order of trust, that has a usable value for a single-valued field.

    ``members`` is what ``copies`` gives. Fields without a usable value give no
    row. A copy's warnings count only if one of them is not null. An empty
    input gives an empty result.
    """
    win = _claims(members).where("ok").groupBy("group_id", "field_name").agg(F.max("trust").alias("w"))
    return win.select("group_id", "field_name", F.col("w.resume_id").alias("resume_id"))


def judged_survivors(members: DataFrame, sources: list[str], truth_floor: float = 0.5) -> tuple[DataFrame, Quality]:
    """(group_id, field_name, resume_id, posterior): the copy that supplies each single-valued field by the model, and the model.

    Of the usable values that are judged true (a posterior of ``truth_floor``
    or more; where none is, of the most probable ones) the one held by the copy
    of highest trust is taken. Unusable values are clamped false.
    """
    claims = _claims(members)
    found = facts(claims, sources)
    model = fit(found, sources)
    best = claims.where("ok").groupBy("group_id", "field_name", "value").agg(F.max("trust").alias("trust"))
    judged = found.where("ok").select("group_id", "field_name", "value", F.round(model.posterior(F.col("field_name"), F.col("covered"), F.col("stated")), 6).alias("posterior"))
    order = F.struct(F.least("posterior", F.lit(truth_floor)).alias("judged"), "trust", "posterior")
    win = best.join(judged, ["group_id", "field_name", "value"]).groupBy("group_id", "field_name").agg(F.max(order).alias("w"))
    return win.select("group_id", "field_name", F.col("w.trust.resume_id").alias("resume_id"), F.col("w.posterior").alias("posterior")), model


def retained_values(resumes: DataFrame, groups: DataFrame, field: str, sources: list[str], truth_floor: float = 0.5) -> DataFrame:
    """(group_id, field_name, value, posterior): every value of a multi-valued field that is judged true.

    Values are compared without case and outer blanks and come back in that
    form; null, blank and stand-in entries state nothing.
    """
    slim = resumes.select(F.col("resume_id").cast("long").alias("resume_id"), method_key(F.col("extraction_method")).alias("method"), F.explode(field).alias("entry")).where(~is_stand_in(F.col("entry")))
    claims = slim.join(groups, "resume_id").select("group_id", F.lit(field).alias("field_name"), F.lower(F.trim("entry")).alias("value"), F.lit(True).alias("ok"), "method")
    found = cut(facts(claims, sources))
    model = fit(found, sources)
    judged = found.withColumn("posterior", model.posterior(F.col("field_name"), F.col("covered"), F.col("stated")))
    return judged.where(F.col("posterior") >= truth_floor).select("group_id", "field_name", "value", F.round("posterior", 6).alias("posterior"))
