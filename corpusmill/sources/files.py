"""Source trees on a file system as a corpus table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.operators import filters
from corpusmill.session import settle

def decode_local(content: Column, normalise_newlines: bool = True) -> Column:
    """Text of a file; bytes that are not UTF-8 become a placeholder."""
    as_text = content.cast("string")
    shown = F.regexp_replace(as_text, r"\r\n?", "\n") if normalise_newlines else as_text
    return F.when(F.is_valid_utf8(as_text), shown).otherwise(settings.BINARY_PLACEHOLDER)


def decode_fetched(content: Column, encoding: Column, path: Column) -> Column:
    """Text of a fetched file: UTF-8, else Latin-1, which takes any bytes."""
    as_text = content.cast("string")
    return (
        F.when(filters.has_ignored_suffix(path), settings.BINARY_BY_SUFFIX_PLACEHOLDER)
        .when(encoding.isNull() | (encoding == "none"), settings.MISSING_ENCODING_PLACEHOLDER)
        .when(F.is_valid_utf8(as_text), as_text)
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


# A path below a root: a directory, a file, or a root that is none ("bad"); sizes are those of files.
_ENTRY = "repo string, root string, root_no bigint, path string, kind string, size bigint"
_TASK_BYTES = 128 << 20
_LISTED_ROWS = 10_000


def _file_system(root: str):
    """File system of a root and the root's path on it, within a task."""
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


def _inside(files, path: str):
    """``(name, is_dir, size)`` of what is in a directory; links to directories are left out."""
    import os

    from pyarrow import fs

    if not isinstance(files, fs.LocalFileSystem):
        for info in files.get_file_info(fs.FileSelector(path)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0
        return
    with os.scandir(path) as entries:
        for entry in entries:
            is_dir = entry.is_dir()
            if not (is_dir and entry.is_symlink()):
                yield entry.name, is_dir, entry.stat(follow_symlinks=False).st_size


def _list_directories(batches):
    """One level below each directory; directories that cannot be listed are passed over, but for roots."""
    import pandas as pd

    for batch in batches:
        out: list[tuple] = []
        for repo, root, number, path in zip(batch["repo"], batch["root"], batch["root_no"], batch["path"]):
            files, base = _file_system(root)
            try:
                for name, is_dir, size in _inside(files, f"{base}/{path}" if path else base):
                    out.append((repo, root, number, f"{path}/{name}" if path else name, "dir" if is_dir else "file", size))
                    if len(out) >= _LISTED_ROWS:
                        yield pd.DataFrame(out, columns=_columns(_ENTRY))
                        out = []
            except OSError:
                if not path:
                    out.append((repo, root, number, path, "bad", 0))
        yield pd.DataFrame(out, columns=_columns(_ENTRY))


def _read_files(batches):
    """Content of each file, opened once; one that cannot be read has the error as its content."""
    import pandas as pd

    for batch in batches:
        for repo, root, path, ord_ in zip(batch["repo"], batch["root"], batch["path"], batch["ord"]):
            try:
                files, base = _file_system(root)
                with files.open_input_stream(f"{base}/{path}") as stream:
                    content = stream.read()
            except OSError as problem:
                content = f"Error reading file: {problem}".encode()
            yield pd.DataFrame({"repo": [repo], "path": [path], "ord": [ord_], "content": [content]})


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def list_roots(roots: DataFrame, ignored_dirs: set[str]) -> DataFrame:
    """All files below the roots ``(repo, root, root_no)``, and the roots that are no directory, as entries.

    Breadth first: every round deals the directories of one level to tasks, so a tree
    with one top directory keeps all of them busy from its second level on.  Ignored
    directories are not entered.  There are as many rounds as levels.
    """
    slots = roots.sparkSession.sparkContext.defaultParallelism * 4
    level = roots.select("repo", "root", "root_no", F.lit("").alias("path"))
    found = None
    while True:
        listed = settle(level.repartition(slots, "root", "path").mapInPandas(_list_directories, _ENTRY))
        rest = listed.where("kind <> 'dir'")
        found = rest if found is None else found.unionByName(rest)
        name = F.substring_index("path", "/", -1)
        level = listed.where((F.col("kind") == "dir") & ~name.isin(*ignored_dirs)).select("repo", "root", "root_no", "path")
        if level.isEmpty():
            return found


def _scan(entries: DataFrame, wanted: Column, normalise_newlines: bool) -> DataFrame:
    """The wanted files, numbered by root and path, each read once."""
    ordered = settle(
        entries.where(F.col("kind") == "file").where(wanted).repartitionByRange("root_no", "path").sortWithinPartitions("root_no", "path")
        .select("repo", "root", "path", F.monotonically_increasing_id().alias("ord"), "size")
    )
    total = ordered.agg(F.sum("size").alias("n")).first().n or 0
    tasks = max(entries.sparkSession.sparkContext.defaultParallelism * 4, -(-total // _TASK_BYTES))
    read = ordered.repartition(tasks, "root", "path").mapInPandas(_read_files, "repo string, path string, ord bigint, content binary")
    return settle(read.select("repo", "path", "ord", decode_local(F.col("content"), normalise_newlines).alias("content")))


def _wanted(skip: list[str], keep_readme: bool) -> Column:
    path = F.col("path")
    keep = ~filters.built_in_ignored(path) & ~filters.is_skipped(path, skip)
    return keep | path.isin(*settings.README_NAMES, ".gitignore") if keep_readme else keep


def _roots(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "repo string, root string, root_no bigint")


def scan_tree(
    spark: SparkSession,
    root: str,
    repo: str | None = None,
    skip: list[str] | None = None,
    keep_readme: bool = True,
    normalise_newlines: bool = True,
) -> DataFrame:
    """Read a tree recursively: ``(repo, path, ord, content)``, ordered by path.

    The ignore lists are tested on the paths, so ignored files are listed but not opened.
    README files and ``.gitignore`` at the root come along for the jobs that need them
    (``keep_readme``); :func:`filters.keep_wanted` drops them again.  Only paths are ordered
    and numbered; each file is then opened once.  The result is settled, so ``ord`` stays
    the same in every job that reads it.  A file that cannot be read has the error as its content.
    """
    root = root.rstrip("/")
    entries = list_roots(_roots(spark, [(repo or root.rsplit("/", 1)[-1], root, 1)]), {*settings.IGNORED_DIRS, *(skip or [])})
    if not entries.where("kind = 'bad'").isEmpty():
        raise NotADirectoryError(root)
    return _scan(entries, _wanted(skip or [], keep_readme), normalise_newlines)


def scan_roots(
    spark: SparkSession, base: str, subdirs: list[str], skip: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """One corpus of several roots under ``base``, and the table ``(repo, root, root_no, error)`` of roots.

    All roots are listed and read by the same jobs.  A bad root is reported in the
    table and has no files.
    """
    roots = _roots(spark, [(subdir, f"{base.rstrip('/')}/{subdir}", number) for number, subdir in enumerate(subdirs, 1)])
    entries = list_roots(roots, {*settings.IGNORED_DIRS, *(skip or [])})
    bad = entries.where("kind = 'bad'").select("root_no", F.lit("not a valid directory").alias("error"))
    return _scan(entries, _wanted(skip or [], True), True), roots.join(bad, "root_no", "left").select("repo", "root", "root_no", "error")
