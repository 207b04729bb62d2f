"""Files that runs leave behind: raw rows, a Markdown table, a form for reviewers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_runs(runs: DataFrame, path: str, keep: bool = True) -> bool:
    """Rows as JSON lines; nothing is written where nothing is kept."""
    if keep:
        runs.write.mode("overwrite").json(path)
    return keep


def markdown(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(n, line): a table's lines in order, with a dash for nulls; for aggregates of a few rows."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]
    body = rows.orderBy(*order).select(F.monotonically_increasing_id().alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = rows.sparkSession.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + "---|" * len(columns))], "n long, line string")
    return head.unionByName(body).orderBy("n")


def review_form(answers: DataFrame, key: str, scores: Sequence[str]) -> DataFrame:
    """Answers with empty scores for people to fill in."""
    return answers.select(key, *(c for c in answers.columns if c != key and c not in scores), *(F.lit(None).cast("int").alias(s) for s in scores))
