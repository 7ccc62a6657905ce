"""Reading finished reports back into a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.functions import text
from corpusmill.functions.joins import meet
from corpusmill.session import settle

# Fixed value: layout of a file block.  `(?d)`: only \n ends a line.  A block can end at a line end only,
# so the text between line ends is passed over at once.
_BLOCK = r"(?d)File: (.*?)\r?\nContent:(?:\r?\n)?((?:[^\r\n]++|(?!(?:\r?\n){2}File: |$)[\r\n])*+)"


def report_sections(reports: DataFrame) -> DataFrame:
    """Cut reports ``(repo, text)`` at the first ``Structure:`` and the first
    ``File Contents:`` after it: ``(repo, readme, structure, blocks)``.

    A text without ``README:`` has no sections.
    """
    whole = F.col("text")
    parts = F.split(whole, r"\QStructure:\E", 2)
    rest = F.split(F.get("parts", F.lit(1)), r"\QFile Contents:\E", 2)
    valid = whole.contains("README:")
    return (
        reports.select("repo", F.when(valid, parts).alias("parts"))
        .select("repo", "parts", rest.alias("rest"))
        .select(
            "repo",
            F.coalesce(text.strip(F.get("parts", F.lit(0))), F.lit("")).alias("readme"),
            F.coalesce(F.concat(F.lit("Structure:"), text.strip(F.get("rest", F.lit(0)))), F.lit("")).alias("structure"),
            F.coalesce(
                F.concat(F.lit("File Contents:"), text.strip(F.get("rest", F.lit(1)))), F.lit("")
            ).alias("blocks"),
        )
    )


def _last_content(blocks: DataFrame) -> DataFrame:
    """A path that comes again keeps its first place and its last content."""
    return blocks.groupBy("repo", "path").agg(
        F.min("ord").alias("ord"), F.max_by("content", "ord").alias("content")
    )


def report_blocks(sections: DataFrame) -> DataFrame:
    """The files of each report: ``(repo, path, ord, content)``."""
    blocks = F.col("blocks")
    pairs = F.arrays_zip(
        F.regexp_extract_all(blocks, F.lit(_BLOCK), 1).alias("path"),
        F.regexp_extract_all(blocks, F.lit(_BLOCK), 2).alias("content"),
    )
    return _last_content(
        sections.select("repo", F.posexplode(pairs).alias("ord", "b")).select(
            "repo",
            text.strip(F.col("b.path")).alias("path"),
            F.col("ord").cast("bigint").alias("ord"),
            text.strip(F.col("b.content")).alias("content"),
        )
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files as ``(repo, text)``, one row each; ``repo`` is the file name
    without ``.txt``."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.txt)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("repo"), F.col("value").alias("text"))


_SEPARATOR = "\n\nFile: "
# Numbers of pieces within a split stay below this.
_PER_SPLIT = 1 << 33


@dataclass(frozen=True)
class ScannedReports:
    """Finished reports of any size as rows; no report is ever one string.

    ``reports``: ``(repo)``, all that were found.
    ``sections``: ``(repo, section, ord, text)``, the readme (0) and the structure (2) in order,
    a row per piece; written with a line end after each row they are the section's text.
    ``files``: ``(repo, path, ord, content)``, a path that comes again at its first place with its last content.
    """

    reports: DataFrame
    sections: DataFrame
    files: DataFrame


def scan_reports(spark: SparkSession, path: str) -> ScannedReports:
    """Report files, or folders of part files as the sink writes them.

    The line separator of the text source is set to the text between two blocks, so one
    report is split over many tasks.  One pass notes, per split, its first piece and the
    pieces that hold a section's title; from these few rows the splits of a report are
    numbered and the ends of its sections found.  With them every piece knows its place by
    itself.  For reports with ``\\n`` line ends whose part files begin at a line.
    A report is named by its folder ``report=<name>``, else by its file without ``.txt``.
    A report without ``README:`` has neither sections nor files.
    """
    source = spark.read.option("lineSep", _SEPARATOR).text(path)
    file_name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.txt)?$", 1)
    named = F.col("report").cast("string") if "report" in source.columns else file_name
    pieces = source.select(
        named.alias("repo"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), "value",
    )
    value = F.col("value")
    second = lambda title: F.get(F.split(value, rf"\Q{title}\E", 2), F.lit(1))
    marks = F.struct(
        "id",
        value.contains("README:").alias("readme"),
        value.contains(settings.STRUCTURE_HEADER.strip()).alias("structure"),
        value.contains(settings.FILES_HEADER.strip()).alias("files"),
        F.coalesce(second("Structure:").contains(settings.FILES_HEADER.strip()), F.lit(False)).alias("files_behind"),
    )
    has_mark = value.contains("README:") | value.contains("Structure:") | value.contains("File Contents:")
    splits = settle(
        pieces.groupBy("repo", "file", "start").agg(
            F.min("id").alias("base"), F.max("id").alias("top"), F.collect_list(F.when(has_mark, marks)).alias("marks")
        )
    )
    in_report = Window.partitionBy("repo").orderBy("file", "start")  # a row per split
    numbered = splits.withColumns(
        {
            "number": F.row_number().over(in_report).cast("bigint"),
            "file_ends": F.coalesce(F.lead("file").over(in_report) != F.col("file"), F.lit(True)),
        }
    )
    place = lambda identity: F.col("number") * _PER_SPLIT + identity - F.col("base")
    marked = numbered.select("repo", F.explode("marks").alias("m"), "number", "base").select("repo", place(F.col("m.id")).alias("ord"), "m.*")
    first_s = marked.groupBy("repo").agg(
        F.min(F.when(F.col("structure"), F.col("ord"))).alias("structure_at"), F.max("readme").alias("valid")
    )
    behind = (F.col("ord") > F.col("structure_at")) & F.col("files") | (F.col("ord") == F.col("structure_at")) & F.col("files_behind")
    first_f = (
        marked.where("files").join(first_s, "repo").where(behind).groupBy("repo").agg(F.min("ord").alias("files_at"))
    )
    bounds = first_s.where("valid").join(first_f, "repo", "left").select("repo", "structure_at", "files_at")
    places = numbered.join(bounds, "repo").drop("marks")
    placed = meet(pieces, places, ["repo", "file", "start"], "inner", spread=["id"]).select(
        "repo", place(F.col("id")).alias("ord"), "structure_at", "files_at", "value",
        ((F.col("start") == 0) & (F.col("id") == F.col("base"))).alias("opens_file"),
        (F.col("file_ends") & (F.col("id") == F.col("top"))).alias("ends_file"),
    )
    return ScannedReports(splits.select("repo").distinct(), _section_rows(placed), _last_wins(_file_blocks(placed)))


def _section_rows(placed: DataFrame) -> DataFrame:
    """Readme and structure, stripped as a whole: white space goes before the first and behind the last piece."""
    value, ord_ = F.col("value"), F.col("ord")
    no_end = F.lit((1 << 63) - 1)
    s, f = F.coalesce("structure_at", no_end), F.coalesce("files_at", no_end)
    split = lambda t, title: F.split(t, rf"\Q{title}\E", 2)
    before = F.when(ord_ == s, F.get(split(value, "Structure:"), F.lit(0))).otherwise(value)
    rest = F.when(ord_ == s, F.get(split(value, "Structure:"), F.lit(1))).otherwise(value)
    within = F.when(ord_ == f, F.get(split(rest, "File Contents:"), F.lit(0))).otherwise(rest)
    kinds = F.array(
        F.when(ord_ <= s, F.struct(F.lit(0).alias("section"), before.alias("text"))),
        F.when((ord_ >= s) & (ord_ <= f), F.struct(F.lit(2).alias("section"), within.alias("text"))),
    )
    rows = placed.where((ord_ <= f) | (ord_ <= s)).select("repo", "ord", "structure_at", "opens_file", "ends_file", F.explode(F.array_compact(kinds)).alias("k"))
    titled_here = (F.col("k.section") == 2) & (ord_ == F.col("structure_at"))
    cut = rows.select(
        "repo", F.col("k.section").alias("section"), "ord", titled_here.alias("titled"), "ends_file",
        # With the line end of the row before it, this is the text between two pieces of a file.
        F.when(F.col("opens_file") | titled_here, F.col("k.text")).otherwise(F.concat(F.lit("\nFile: "), F.col("k.text"))).alias("text"),
    )
    filled = cut.where(F.col("titled") | F.col("text").rlike(rf"[^{text.SPACE}]"))
    ends = filled.groupBy("repo", "section").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    first, last = F.col("ord") == F.col("first"), F.col("ord") == F.col("last")
    body = F.col("text")
    shown = F.when(first, text.lstrip(body)).otherwise(body)
    stripped = F.concat(F.regexp_replace(shown, rf"(?<![{text.SPACE}])[{text.SPACE}]++\z", ""), F.lit("\n"))
    # A part file ends with a line end, which the row brings itself.
    shown = F.when(last, stripped).when(F.col("ends_file"), text.chop_line_end(shown)).otherwise(shown)
    titled = F.when(F.col("titled"), F.concat(F.lit("Structure:"), shown)).otherwise(shown)
    return (
        meet(cut, ends, ["repo", "section"], "inner", spread=["ord"])
        .where((F.col("ord") >= F.col("first")) & (F.col("ord") <= F.col("last")))
        .select("repo", F.col("section").cast("bigint").alias("section"), "ord", titled.alias("text"))
    )


def _file_blocks(placed: DataFrame) -> DataFrame:
    """The file of each piece behind the title of the files, if it has one."""
    value, at = F.col("value"), F.col("files_at")
    remainder = F.get(F.split(F.get(F.split(value, r"\QStructure:\E", 2), F.lit(1)), r"\QFile Contents:\E", 2), F.lit(1))
    later = F.get(F.split(value, r"\QFile Contents:\E", 2), F.lit(1))
    block = (
        F.when((F.col("ord") == at) & (at == F.col("structure_at")), remainder)
        .when(F.col("ord") == at, later)
        .when(F.col("opens_file"), value)
        .otherwise(F.concat(F.lit("File: "), value))
    )
    # What follows the opening lines is the content; only these lines are looked at by regex.
    opening = r"(?d)File: (.*?)\r?\nContent:(?:\r?\n)?"
    parts = F.split("block", opening, 2)
    found = (
        placed.where(F.col("ord") >= at)
        .select("repo", "ord", block.alias("block"))
        .select("repo", "ord", F.regexp_extract("block", opening, 1).alias("path"), F.get(parts, F.lit(1)).alias("content"))
    )
    return found.where(F.col("content").isNotNull()).select(
        "repo", text.strip(F.col("path")).alias("path"), "ord", text.strip(F.col("content")).alias("content")
    )


def _last_wins(blocks: DataFrame) -> DataFrame:
    """A path that comes again keeps its first place and its last content; only such paths are looked up."""
    again = blocks.groupBy("repo", "path").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last")
    return (
        meet(blocks, again, ["repo", "path"], "left")
        .where(F.col("last").isNull() | (F.col("ord") == F.col("last")))
        .select("repo", "path", F.coalesce("first", "ord").alias("ord"), "content")
    )


def read_report_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The files of reports of any size: ``(repo, path, ord, content)``; see :func:`scan_reports`."""
    return scan_reports(spark, path).files
