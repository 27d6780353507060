"""Texts that explain a ranking, put together from the values the ranking was made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import STATUS_ORDER, Weights
from ..functions.text import listed

#: The verdicts and the score from which each holds.
VERDICTS = ((72, "Strong fit"), (60, "Good fit"), (45, "Partial fit"), (30, "Weak fit"), (0, "Poor fit"))
#: The parts of the score, as they are stored and as they are weighted.
PARTS = (("required_skills", "required"), ("preferred_skills", "preferred"), ("semantic", "semantic"), ("lexical", "lexical"), ("experience", "experience"))


def verdict(score: Column, n_missing: Column) -> Column:
    """The best one needs that nothing required is missing."""
    c = F.when((score >= VERDICTS[0][0]) & (n_missing == 0), VERDICTS[0][1])
    for least, name in VERDICTS[1:-1]:
        c = c.when(score >= least, name)
    return c.otherwise(VERDICTS[-1][1])


def matches(tiers: DataFrame, ontology: DataFrame, of: DataFrame) -> DataFrame:
    """(job_id, resume_id, m): the demanded skills of the pairs in ``of``, by status, falling importance and credit, then name (L3)."""
    names = ontology.select("skill_key", "canonical")
    via = names.select(F.col("skill_key").alias("via"), F.col("canonical").alias("via_name"))
    order = F.create_map(*[F.lit(x) for kv in STATUS_ORDER.items() for x in kv])
    t = tiers.join(of.select("job_id", "resume_id"), ["job_id", "resume_id"]).join(names, "skill_key").join(via, "via", "left")
    one = F.struct(F.try_element_at(order, F.col("status")).alias("o"), (-F.col("importance")).alias("i"), (-F.col("credit")).alias("c"), "canonical", "status", "kind", "via_name")
    return t.groupBy("job_id", "resume_id").agg(F.array_sort(F.collect_list(one)).alias("m"))


def picked(m: Column, kind: str, *status: str, hard: bool | None = None) -> Column:
    """The names of the matches of a kind and status."""
    def keep(x: Column) -> Column:
        ok = (x["kind"] == kind) & x["status"].isin(*status)
        return ok if hard is None else ok & ((x["i"] <= -0.9) if hard else (x["i"] > -0.9))

    return F.transform(F.filter(m, keep), lambda x: x["canonical"])


def signed(value: Column) -> Column:
    return F.format_string("%+.1f", F.round(value, 1))


def breakdown(subscores: Column, weights: Weights = Weights()) -> Column:
    """``part +points`` of each part of the score, the largest first."""
    value = lambda p, w: F.round(100 * getattr(weights, w) * F.coalesce(F.when(~F.isnan(subscores[p]), subscores[p]), F.lit(0.0)), 4)
    parts = F.array_sort(F.array(*[F.struct((-F.abs(value(p, w))).alias("o"), F.lit(p.replace("_", " ")).alias("p"), value(p, w).alias("v")) for p, w in PARTS]))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["p"], F.lit(" "), signed(x["v"]))), ", ")


def explanation(rank: Column, name: Column, score: Column, title: Column, m: Column, years: Column, subscores: Column, flags: Column) -> Column:
    """Why a candidate stands where they stand: matches, gaps, experience, points and cautions."""
    exact, missing = picked(m, "required", "exact"), picked(m, "required", "missing")
    n_required = F.size(F.filter(m, lambda x: x["kind"] == "required"))
    related = F.transform(F.filter(m, lambda x: (x["kind"] == "required") & (x["status"] == "related")), lambda x: F.concat(x["canonical"], F.lit(" (via "), x["via_name"], F.lit(")")))
    semantic = picked(m, "required", "semantic")
    hard, soft = picked(m, "required", "missing", hard=True), picked(m, "required", "missing", hard=False)
    named, inferred = picked(m, "preferred", "exact"), picked(m, "preferred", "related", "semantic")
    say = lambda when, *parts: F.when(when, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    n = lambda c: c.cast("string")
    return F.concat_ws(
        " ",
        F.concat(F.lit("#"), n(rank), F.lit(" "), F.coalesce(name, F.lit("unknown")), F.lit(" - "), F.format_string("%.1f", F.round(score, 1)), F.lit("/100 ("), verdict(score, F.size(missing)), F.lit(" for "), F.coalesce(title, F.lit("this role")), F.lit(").")),
        F.coalesce(say(F.size(exact) > 0, "Directly matches ", n(F.size(exact)), " of ", n(n_required), " required skills: ", listed(exact), "."), F.lit("Does not name any of the required skills directly.")),
        say(F.size(related) > 0, "Partial credit on ", listed(F.slice(related, 1, 3), 3), " - adjacent technology, not the exact one asked for."),
        say(F.size(semantic) > 0, "Implied ", F.try_element_at(semantic, F.lit(1)), " without naming it."),
        say(F.size(hard) > 0, "Missing / no evidence for: ", listed(hard), "."),
        say(F.size(soft) > 0, "Missing but lower-weight: ", listed(soft, 4), "."),
        say(F.size(missing) == 0, "No required skill is entirely unevidenced."),
        say(F.size(named) > 0, "Also names preferred skills: ", listed(named, 5), "."),
        say(F.size(inferred) > 0, "Weaker, inferred-only signal on ", listed(inferred, 4), " - not named outright, treat as unconfirmed."),
        F.concat(F.lit("Experience: "), F.format_string("%.1f", F.round(years, 1)), F.lit(" yrs.")),
        F.concat(F.lit("Score breakdown (points out of 100): "), breakdown(subscores), F.lit(".")),
        say(F.size(flags) > 0, "Caution: ", F.array_join(flags, "; "), "."),
    )


def comparison(a: Column, b: Column, weights: Weights = Weights()) -> Column:
    """Why the first of two (structs of rank, name, score, years, subscores, owned, missing) stands above the second."""
    val = lambda x, p, w: 100 * getattr(weights, w) * F.coalesce(F.when(~F.isnan(x["subscores"][p]), x["subscores"][p]), F.lit(0.0))
    delta = lambda p, w: F.round(val(a, p, w) - val(b, p, w), 4)
    diffs = F.array_sort(F.filter(F.array(*[F.struct((-F.abs(delta(p, w))).alias("o"), F.lit(p.replace("_", " ")).alias("p"), delta(p, w).alias("v")) for p, w in PARTS]), lambda x: x["o"] <= -0.5))
    only_a, only_b = F.array_sort(F.array_except(a["owned"], b["owned"])), F.array_sort(F.array_except(b["owned"], a["owned"]))
    one = lambda v: F.format_string("%.1f", F.round(v, 1))
    lit = lambda *ps: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in ps])
    first = F.try_element_at(diffs, F.lit(1))
    rest = F.transform(F.slice(diffs, 2, 3), lambda x: F.concat(x["p"], F.lit(" "), signed(x["v"])))
    s = lambda c: c.cast("string")
    return F.concat_ws(
        " ",
        lit(a["name"], " ranks #", s(a["rank"]), " at ", one(a["score"]), " and ", b["name"], " ranks #", s(b["rank"]), " at ", one(b["score"]), " - a gap of ", one(F.round(a["score"] - b["score"], 4)), " points."),
        F.when(F.size(diffs) > 0, lit("The biggest driver is ", first["p"], ", worth ", signed(first["v"]), " points to ", a["name"], ".")),
        F.when(F.size(diffs) > 1, lit("Then ", F.array_join(rest, ", "), ".")),
        F.when(F.size(only_a) > 0, lit(a["name"], " covers ", listed(only_a), " which ", b["name"], " does not.")),
        F.when(F.size(only_b) > 0, lit(b["name"], " does bring ", listed(only_b), ", but it was not enough to close the gap.")),
        F.when(F.size(b["missing"]) > F.size(a["missing"]), lit(b["name"], " is missing ", s(F.size(b["missing"])), " required skills (", listed(b["missing"], 4), ") against ", a["name"], "'s ", s(F.size(a["missing"])), ".")),
        F.when(F.abs(a["years"] - b["years"]) >= 0.5, lit("Experience: ", one(a["years"]), " yrs vs ", one(b["years"]), " yrs.")),
    )


def plain_explanation(rank: Column, name: Column, score: Column, matched: Column, missing: Column, semantic: Column) -> Column:
    """The explanation of a scored row without a trace."""
    join = lambda c, none, lead: F.when(F.size(c) > 0, F.concat(F.lit(lead), F.array_join(c, ", "))).otherwise(none)
    return F.concat_ws(
        "\n", F.concat(F.lit("Rank "), rank.cast("string"), F.lit(": "), name, F.lit(" (score: "), F.format_string("%.1f", F.round(score, 1)), F.lit(")")),
        join(matched, "  Matched required skills: none found", "  Matched required skills: "), join(missing, "  All required skills present", "  Missing required skills: "),
        F.when(semantic >= 0.6, "  Strong overall semantic alignment with the JD's focus.").when(semantic >= 0.3, "  Moderate semantic alignment - relevant background, some gaps.").otherwise("  Weak semantic alignment with the JD's overall focus."),
    )
