"""Reports of bounded size: CSV with a mark for spreadsheets, ranked exports, review sheets, dataset cards. A report takes
aggregates or a sample of stated size, never a table; `most` bounds its rows, and more is an error."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files

MOST_ROWS = 100_000
SHEET = ("row_id", "en", "vi", "technical_tags", "translation_error", "technical_error", "notes")
PRIORITY = ("has_path", "has_command")


def bounded(report: DataFrame, most: int = MOST_ROWS) -> list:
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return rows


def _table(header, rows, delimiter=",") -> str:
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=delimiter)
    w.writerow(header)
    w.writerows(["" if c is None else c for c in r] for r in rows)
    return out.getvalue()


def write_csv(report: DataFrame, path: str, mark: bool = True) -> None:
    """One CSV file in the report's order, with a byte order mark."""
    files.write_text(report.sparkSession, path, "﻿" * mark + _table(report.columns, bounded(report)))


def write_json(report: DataFrame, path: str) -> None:
    files.write_text(report.sparkSession, path, json.dumps([r.asDict(True) for r in bounded(report)], ensure_ascii=False, indent=2, default=str))


def write_ranked(ranked: DataFrame, path: str, source: str, by: str, key: str, most: int = 1000) -> None:
    """The first `most` rows by descending `by`, ties by key, as TSV under comment lines that say what it comes from."""
    rows = ranked.orderBy(F.col(by).desc(), F.col(key)).limit(most).collect()
    head = f"# source: {source}\n# rows: {len(rows)}, by {by} descending\n# columns: " + "\t".join(ranked.columns) + "\n"
    files.write_text(ranked.sparkSession, path, head + "".join("\t".join(map(str, r)) + "\n" for r in rows))


def review_rows(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """n tagged rows, those tagged path or command first, then by a seeded hash; fewer tagged rows than n is an error."""
    first = F.arrays_overlap("technical_tags", F.array(*map(F.lit, PRIORITY)))
    tagged = rows.filter(F.size("technical_tags") > 0)
    picked = tagged.orderBy(first.desc(), F.sha2(F.concat(F.lit(f"{seed}:"), "row_id"), 256), "row_id").limit(n)
    if picked.count() < n:
        raise ValueError(f"fewer than {n} tagged rows")
    return picked


def write_review(rows: DataFrame, n: int, seed: str, folder: str) -> None:
    """A sheet with empty labels, and a manifest of the rule and the ids that it holds."""
    spark = rows.sparkSession
    picked = review_rows(rows, n, seed).select("row_id", "en", "vi", F.array_join("technical_tags", ";").alias("technical_tags")).collect()
    files.write_text(spark, f"{folder}/sheet.csv", _table(SHEET, [(*r, "", "", "") for r in picked]))
    rule = f"tagged rows, {' and '.join(PRIORITY)} first, then by SHA-256 of {seed}:row_id"
    files.write_text(spark, f"{folder}/manifest.json", json.dumps({"rows": n, "selection_rule": rule, "row_ids": [r.row_id for r in picked]}, ensure_ascii=False, indent=2))


def card(name: str, counts: dict[str, DataFrame]) -> str:
    """A Markdown card: a title and a table for each report."""
    out = [f"# {name}"]
    for title, report in counts.items():
        rows = bounded(report, 1000)
        out += ["", f"## {title}", "", "| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns)]
        out += ["| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in r) + " |" for r in rows]
    return "\n".join(out) + "\n"
