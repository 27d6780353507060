"""The queries of the nine training-data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, table
from . import canonical, confusables, links, mixing, neardup, packing, pii, survivors, tokens, topn

#: The key of the pseudonyms in the registered queries; a deployment passes its own.
DEMO_KEY = b"rankloom demonstration key"


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    resumes = table(spark, d, "resumes")
    return resumes, cut(links.identity_groups(table(spark, d, "ranked_candidates"), resumes))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The stated order of copies fixes these rows; the model decides in the other three queries."""
    return survivors.survivors(survivors.copies(*_groups(spark, d)))


def p1_judged(spark: SparkSession, d: str) -> DataFrame:
    """The copy that supplies each field when the model judges which values are true."""
    resumes, groups = _groups(spark, d)
    return survivors.judged_survivors(cut(survivors.copies(resumes, groups)), survivors.sources_of(resumes))[0]


def p1_retained(spark: SparkSession, d: str) -> DataFrame:
    """Every skill and link of a group that the model judges true."""
    resumes, groups = _groups(spark, d)
    sources = survivors.sources_of(resumes)
    out = [survivors.retained_values(resumes, groups, f, sources) for f in survivors.MULTI]
    return out[0].unionByName(out[1])


def p1_record(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group: single values field by field from the first usable copy, and every skill and link judged true."""
    resumes, groups = _groups(spark, d)
    found = survivors.survivors(survivors.copies(resumes, groups))
    wide = found.groupBy("group_id").agg(*(F.max(F.when(F.col("field_name") == f, F.col("resume_id"))).alias(f"from_{f}") for f in survivors.SINGLE))
    for f in survivors.SINGLE:
        wide = wide.join(resumes.select(F.col("resume_id").cast("long").alias(f"from_{f}"), f), f"from_{f}", "left")
    sources = survivors.sources_of(resumes)
    for f in survivors.MULTI:
        # the distinct values of one person
        kept = survivors.retained_values(resumes, groups, f, sources).groupBy("group_id").agg(F.array_sort(F.collect_set("value")).alias(f))
        wide = wide.join(kept, "group_id", "left")
    return wide.select("group_id", *survivors.SINGLE, *survivors.MULTI)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return links.identity_groups(table(spark, d, "ranked_candidates"), table(spark, d, "resumes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_resumes(table(spark, d, "ranked_candidates")).select("job_id", "resume_id")


def p3_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_resumes(table(spark, d, "ranked_candidates"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    values = canonical.entered_skills(table(spark, d, "resumes"), table(spark, d, "requirements"), table(spark, d, "skill_matches"))
    return canonical.mapped_values(values, table(spark, d, "skill_ontology"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values on no entry, with the number of records that hold them."""
    return p4_found(spark, d).where(F.col("skill_key") == canonical.UNMATCHED).groupBy("raw_value").agg(F.count("*").alias("records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii_lines(table(spark, d, "resumes"), "resumes", "resume_id", "raw_text", DEMO_KEY).unionByName(pii.pii_lines(table(spark, d, "skill_matches"), "skill_matches", "match_id", "evidence", DEMO_KEY))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, kind, key, text: table(spark, d, t).select(F.lit(kind).alias("record_kind"), F.col(key).cast("long").alias("record_id"), pii.redacted(F.col(text), DEMO_KEY).alias("redacted"))
    return one("resumes", "resumes", "resume_id", "raw_text").unionByName(one("skill_matches", "skill_matches", "match_id", "evidence"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = neardup.near_pairs(table(spark, d, "resumes"), "resume_id", "raw_text", 0.7)
    return neardup.expand(pairs, members).select(F.col("a").alias("resume_a"), F.col("b").alias("resume_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a resume: its class, its group, and the number of other classes its class is linked to."""
    from .components import connected_components

    pairs, members = neardup.near_pairs(table(spark, d, "resumes"), "resume_id", "raw_text", 0.7)
    pairs = cut(pairs.select("a", "b"))
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("linked_classes"))
    groups = connected_components(pairs).select(F.col("node").alias("rep"), F.col("root").alias("group_id"))
    out = members.join(ends, "rep", "left").join(groups, "rep", "left")
    return out.select(F.col("id").alias("resume_id"), F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("linked_classes", F.lit(0)).alias("linked_classes"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut(table(spark, d, "documents").select("doc_id", "source", tokens.token_count(F.col("text")).alias("tokens")))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d), table(spark, d, "pack_targets"), "doc_id", "tokens")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[0]


def p8_mix_all(spark: SparkSession, d: str) -> DataFrame:
    """The mix as large as all its sources together."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"), total_tokens="all")[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[1]


def p8_shares_all(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached when a mix is to be as large as all its sources together."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"), total_tokens="all")[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_alikes(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", confusables.normalize_column(F.col("text")).alias("canonical_text"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_classes(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p1_found, p1_judged, p1_retained, p1_record, p2_found, p3_found, p3_ranked, p4_found, p4_unmatched, p5_found, p5_redacted, p6_found, p6_groups, p7_pack, p7_fill, p8_mix, p8_mix_all, p8_shares, p8_shares_all, p9_found, p9_classes, p9_canonical)
    return {f.__name__: f for f in fs}
