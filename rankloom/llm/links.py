"""The links between resumes that single rankings state (problem 2's input)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components

# What stands in for a missing value.
STAND_INS = (
    "", "-", "--", ".", "?", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "tbd", "tba", "unknown",
    "unassigned", "not provided", "not available", "not applicable", "missing", "see cv", "undefined",
)


def is_stand_in(value: Column) -> Column:
    """True for null, blank and stand-in values, whatever their case."""
    return value.isNull() | F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))).isin(*STAND_INS)


def file_key(name: Column) -> Column:
    """A file name without folders, outer blanks and case."""
    flat = F.regexp_replace(F.trim(name), r"\\", "/")
    return F.lower(F.trim(F.element_at(F.split(flat, "/"), -1)))


def stated_links(ranked: DataFrame, resumes: DataFrame) -> DataFrame:
    """Edges (a, b) between resumes.

    File names in duplicate_of and duplicate_files link when they are some
    resume's doc_id, whatever their folder, case or outer blanks; all rows of
    one job_id with one identity_group label link to the smallest resume_id of
    that label, so a label that a third of all rows share makes as many edges
    as it has resumes. That id is found by an aggregate that combines before
    its shuffle, and joined back as one row a label.
    """
    rows = ranked.select("job_id", F.col("resume_id").cast("long").alias("resume_id"), "duplicate_of", "duplicate_files", "identity_group").where("resume_id is not null")
    named = rows.select("resume_id", F.explode(F.concat(F.array("duplicate_of"), F.coalesce("duplicate_files", F.array().cast("array<string>")))).alias("name"))
    named = named.where(~is_stand_in(F.col("name"))).select("resume_id", file_key(F.col("name")).alias("file")).distinct()
    files = resumes.where(~is_stand_in(F.col("doc_id"))).select(F.col("resume_id").cast("long").alias("other"), file_key(F.col("doc_id")).alias("file"))
    by_name = named.join(files, "file").where("resume_id <> other").select(F.col("resume_id").alias("a"), F.col("other").alias("b"))
    labelled = rows.where(F.col("job_id").isNotNull() & ~is_stand_in(F.col("identity_group"))).select("job_id", "identity_group", "resume_id").distinct()
    first = labelled.groupBy("job_id", "identity_group").agg(F.min("resume_id").alias("first"))
    by_label = labelled.join(first, ["job_id", "identity_group"]).where("resume_id <> first").select(F.col("resume_id").alias("a"), F.col("first").alias("b"))
    return by_name.unionByName(by_label)


def identity_groups(ranked: DataFrame, resumes: DataFrame, edges_per_partition: int = 500_000) -> DataFrame:
    """(resume_id, group_id) of every resume that is linked to another one.

    group_id is the smallest resume_id of the group. A resume whose label or
    file name no other resume shares is in no group. Null ids, labels, names
    and job ids link nothing; repeated rows change nothing.
    """
    labels = connected_components(stated_links(ranked, resumes), edges_per_partition=edges_per_partition)
    others = labels.where("node <> root")
    roots = others.select(F.col("root").alias("node"), "root").distinct()
    return others.unionByName(roots).select(F.col("node").alias("resume_id"), F.col("root").alias("group_id"))
