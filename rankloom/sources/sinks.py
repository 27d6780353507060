"""Rankings as JSON, CSV and small reports."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; columns whose names begin with ``_`` stay out."""
    df.select(*[c for c in df.columns if not c.startswith("_")]).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every file that has rows, and doubled quotes; arrays are joined by ``; ``. Columns whose names begin with ``_`` stay out."""
    public = [(c, t) for c, t in df.dtypes if not c.startswith("_")]
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in public]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def payload(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def comparison_html(df: DataFrame, columns: list[str], n: int = 3) -> str:
    """The first n rows (at most 10) as a table, a column each."""
    rows = df.limit(max(2, min(n, 10))).collect()
    cells = "".join(f"<tr><th>{html.escape(c)}</th>{''.join(f'<td>{html.escape(str(r[c]))}</td>' for r in rows)}</tr>" for c in columns)
    return f"<table>{cells}</table>"


REPORTS: dict[str, str] = {"ranked": "ranked_report", "gaps": "skill_gap_report", "compare": "pairwise_compare", "coverage": "pool_coverage", "dashboard": "dashboard"}


def report(kind: str, queries: dict[str, Callable], spark, folder: str) -> DataFrame:
    if kind not in REPORTS:
        raise KeyError(f"no such report: {kind}; there are {', '.join(sorted(REPORTS))}")
    return queries[REPORTS[kind]](spark, folder)
