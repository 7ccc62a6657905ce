"""Writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.report import ROW_ORDER
from corpusmill.session import stored


def report_names(roots: DataFrame, output: str | None = None, level: str | None = None) -> DataFrame:
    """``(repo, report)``: ``<repo>_analysis``, or the given name, numbered where
    there are several roots; reduced reports end in ``_compressed_<level>``.

    ``roots`` is the small table ``(repo, root_no)`` of what the caller asked for.
    """
    suffix = f"_compressed_{level}" if level else ""
    if output is None:
        name = F.concat(F.col("repo"), F.lit("_analysis" + suffix))
    elif roots.limit(2).count() > 1:
        name = F.concat(F.lit(output + "_"), F.col("root_no").cast("string"), F.lit(suffix))
    else:
        name = F.lit(output + suffix)
    return roots.select("repo", name.alias("report"))


def write_reports(rows: DataFrame, location: str, names: DataFrame | None = None, level: str | None = None) -> None:
    """Write report rows below ``location``, one folder ``report=<name>`` each.

    Range partitioning by the row order splits a large report over many files;
    their names sort in the order of the text.
    """
    if names is None:
        suffix = f"_analysis_compressed_{level}" if level else "_analysis"
        named = rows.withColumn("report", F.concat(F.col("repo"), F.lit(suffix)))
    else:
        named = rows.join(names, "repo")
    # Range partitioning samples its input first: without this the whole job would run twice.
    named = stored(named)
    order = ["report", *ROW_ORDER]
    (
        named.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("report", "text")
        .write.mode("errorifexists")
        .partitionBy("report")
        .text(location)
    )
