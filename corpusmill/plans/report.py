"""Reports as ordered rows.

A report is a set of rows ``(repo, section, sort_key, ord, text)``; put in that
order, with a line end after each, they are the text of the report.  No report is
ever one string, so a repository of any size can be written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.functions import text
from corpusmill.operators import filters, ledger, tree

ROW_ORDER = ["repo", "section", "sort_key", "ord"]


def _rows(df: DataFrame, section: int, body: Column, sort_key: Column | None = None, ord_: Column | None = None) -> DataFrame:
    return df.select(
        "repo",
        F.lit(section).cast("bigint").alias("section"),
        (F.lit("") if sort_key is None else sort_key).alias("sort_key"),
        (F.lit(0) if ord_ is None else ord_).cast("bigint").alias("ord"),
        body.alias("text"),
    )


def _file_rows(files: DataFrame, section: int) -> DataFrame:
    block = F.concat(F.lit("File: "), F.col("path"), F.lit("\nContent:\n"), F.col("content"), F.lit("\n"))
    return _rows(files, section, block, F.lit(""), F.col("ord"))


def report_rows(files: DataFrame, readme: DataFrame) -> DataFrame:
    """README, structure and wanted files of every repository in ``readme``."""
    listing = tree.tree_listing(files)
    return (
        _rows(readme, 0, F.concat(F.lit(settings.README_HEADER), F.col("content"), F.lit("\n")))
        .unionByName(_rows(readme, 1, F.lit(settings.STRUCTURE_HEADER.rstrip("\n"))))
        .unionByName(_rows(listing, 2, F.col("line"), F.col("sort_key")))
        .unionByName(_rows(readme, 3, F.lit("")))
        .unionByName(_rows(readme, 4, F.lit(settings.FILES_HEADER.rstrip("\n"))))
        .unionByName(_file_rows(files, 5))
    )


def corpus_report(
    files: DataFrame,
    skip: list[str] | None = None,
    rules: DataFrame | None = None,
    scope: str = "full",
    compat: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Report rows and component ledger of a raw corpus."""
    repos = files.select("repo").distinct()
    wanted = filters.keep_wanted(files, skip)
    if rules is not None:
        wanted = filters.drop_by_rules(wanted, rules, scope, compat)
    readme = ledger.pick_readme(repos, files)
    return report_rows(wanted, readme), ledger.component_ledger(wanted, readme)


def reduced_report_rows(
    reduced: DataFrame, readme: DataFrame, summary: DataFrame, listing: DataFrame
) -> DataFrame:
    """The same with a summary section.  The header and the first line of the
    structure share a line, as in the text form of a reduced report."""
    line = F.col("line")
    first = F.when(F.col("sort_key") == "", F.concat(F.lit("Structure:"), line)).otherwise(line)
    return (
        _rows(readme, 0, F.concat(text.strip(F.concat(F.lit(settings.README_HEADER), F.col("content"))), F.lit("\n")))
        .unionByName(_rows(summary, 1, F.concat(F.lit(settings.SUMMARY_HEADER), F.col("summary"), F.lit("\n"))))
        .unionByName(_rows(listing, 2, first, F.col("sort_key")))
        .unionByName(_rows(readme, 3, F.lit("")))
        .unionByName(_rows(readme, 4, F.lit(settings.FILES_HEADER.rstrip("\n"))))
        .unionByName(_file_rows(reduced, 5))
    )


def rewritten_report_rows(sections: DataFrame, reduced: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows of a finished report (its cut sections) after reduction."""
    nothing = F.lit("Repository contains 0 files with approximately 0 lines of code.")
    told = sections.select("repo").join(summary, "repo", "left").select(
        "repo", F.coalesce("summary", nothing).alias("summary")
    )
    return (
        _rows(sections, 0, F.concat("readme", F.lit("\n")))
        .unionByName(_rows(told, 1, F.concat(F.lit(settings.SUMMARY_HEADER), F.col("summary"), F.lit("\n"))))
        .unionByName(_rows(sections, 2, F.concat("structure", F.lit("\n"))))
        .unionByName(_rows(sections, 3, F.lit(settings.FILES_HEADER.rstrip("\n"))))
        .unionByName(_file_rows(reduced, 4))
    )


def rescanned_report_rows(reports: DataFrame, sections: DataFrame, reduced: DataFrame, summary: DataFrame) -> DataFrame:
    """The same from sections that are rows themselves; a section that a report lacks is an empty line."""
    wanted = reports.withColumn("section", F.explode(F.array(F.lit(0), F.lit(2)).cast("array<bigint>")))
    missing = wanted.join(sections.select("repo", "section").distinct(), ["repo", "section"], "left_anti")
    rows = rewritten_report_rows(reports.withColumns({"readme": F.lit(""), "structure": F.lit("")}), reduced, summary)
    placeholders = rows.where(F.col("section").isin(0, 2)).join(missing, ["repo", "section"], "left_semi")
    found = sections.select("repo", "section", F.lit("").alias("sort_key"), "ord", "text")
    return rows.where(~F.col("section").isin(0, 2)).unionByName(placeholders).unionByName(found)


def report_bytes(rows: DataFrame) -> DataFrame:
    """Size of each report as written."""
    return rows.groupBy("repo").agg((F.sum(F.octet_length("text") + 1)).cast("bigint").alias("n_bytes"))
