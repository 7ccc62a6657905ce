"""How often the files of a repository are imported by its other files.

File B counts for file A with stem ``s`` once if B holds ``import s`` or
``from s`` (as a substring, so ``import utilities`` also hits ``util``), and once
more if B holds ``import `` and ``from 's``.

A substring join would compare all pairs of files.  Here each file lists, once,
the prefixes of the text after its ``import ``/``from `` mentions that have the
length of some stem.  Counting equal prefixes gives the number of files that
mention a stem; a file's mention of itself is taken off row-locally.  No pair of
files is ever built, so a stem shared by very many files costs no more.

Most prefixes are no stem of their repository.  A Bloom filter of all (repository, stem)
digests, built once and of a fixed size, tells so in the task that read the text: only
prefixes that may be stems are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths
from corpusmill.functions.joins import attach


def _mentions_own_stem(content: Column, stem: Column) -> Column:
    plain = F.contains(content, F.concat(F.lit("import "), stem)) | F.contains(
        content, F.concat(F.lit("from "), stem)
    )
    quoted = F.contains(content, F.lit("import ")) & F.contains(content, F.concat(F.lit("from '"), stem))
    return plain.cast("bigint") + quoted.cast("bigint")


def _prefixes_after(content: Column, keyword: str, limits: Column) -> Column:
    """Distinct prefixes, of the lengths in ``limits``, of what follows a keyword.

    A stem holds no slash, so the text is looked at up to the next slash or the
    longest stem.  The lookahead lets a mention lie inside another one.
    """
    pattern = F.concat(
        F.lit(f"(?:{keyword})(?=([^/]{{0,"), F.array_max(limits).cast("string"), F.lit("}))")
    )
    windows = F.array_distinct(F.regexp_extract_all(content, pattern, 1))
    cut = F.transform(
        windows,
        lambda window: F.transform(
            F.filter(limits, lambda size: size <= F.length(window)),
            lambda size: F.substr(window, F.lit(1), size),
        ),
    )
    return F.array_distinct(F.flatten(cut))


# Words of 64 bits of the filter; its broadcast has a row of 16 bytes for each at most.
FILTER_WORDS = 1 << 20


def _probe() -> tuple[Column, Column]:
    """Word and bits of a row's ``(repo, stem)`` in the filter: three bits of one word."""
    digest = F.xxhash64("repo", "stem")
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, (F.shiftrightunsigned(digest, 20 + 6 * k).bitwiseAND(63)).cast("int")) for k in range(3)]
    return F.pmod(digest, F.lit(FILTER_WORDS)), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def stem_filter(files: DataFrame) -> DataFrame:
    """Bloom filter of the stems of all repositories: ``(word, bits)``, at most ``FILTER_WORDS`` rows."""
    word, bits = _probe()
    return (
        files.select("repo", paths.stem(F.col("path")).alias("stem"))
        .select(word.alias("word"), bits.alias("bits"))
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
    )


def likely_mentions(files: DataFrame) -> DataFrame:
    """``(repo, stem)``, a row per file and prefix that may be a stem of its repository: all true ones and few others."""
    word, bits = _probe()
    probed = listed_mentions(files).select("repo", "stem", word.alias("word"), bits.alias("needed"))
    passing = probed.join(F.broadcast(stem_filter(files)), "word").where(F.col("bits").bitwiseAND(F.col("needed")) == F.col("needed"))
    return passing.select("repo", "stem")


def listed_mentions(files: DataFrame) -> DataFrame:
    """``(repo, stem)``, a row per file and distinct prefix after a keyword, of the lengths that stems have."""
    stem = paths.stem(F.col("path"))
    content = F.col("content")
    # One row, worked out once and handed to the tasks as a constant.
    lengths = files.agg(F.array_sort(F.collect_set(F.length(stem)))).scalar()
    sized = files.where(content.contains("import ") | content.contains("from ")).select(
        "repo", "content", lengths.alias("lengths")
    )
    quoted = F.when(content.contains("import "), _prefixes_after(content, "from '", F.col("lengths")))
    return sized.select(
        "repo",
        F.explode(
            F.concat(
                _prefixes_after(content, "import |from ", F.col("lengths")),
                F.coalesce(quoted, F.array().cast("array<string>")),
            )
        ).alias("stem"),
    )


def stem_mentions(files: DataFrame) -> DataFrame:
    """``(repo, stem, mentions)`` for every stem that is mentioned at all."""
    mentions = likely_mentions(files).select("repo", "stem", F.lit(1).cast("bigint").alias("mentions"), F.lit(0).alias("named"))
    stems = files.select(
        "repo", paths.stem(F.col("path")).alias("stem"), F.lit(0).cast("bigint").alias("mentions"), F.lit(1).alias("named")
    )
    return (
        mentions.unionByName(stems)
        .groupBy("repo", "stem")
        .agg(F.sum("mentions").alias("mentions"), F.max("named").alias("named"))
        .where("named = 1 AND mentions > 0")
        .drop("named")
    )


def with_import_count(files: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """``(repo, path, ord, <measures>, import_count)``; text does not travel."""
    stem = paths.stem(F.col("path"))
    slim = files.select(
        "repo",
        "path",
        "ord",
        stem.alias("stem"),
        _mentions_own_stem(F.col("content"), stem).alias("own"),
        *[column.alias(name) for name, column in measures.items()],
    )
    count = F.coalesce(F.col("mentions"), F.lit(0)) - F.when(F.col("mentions").isNull(), 0).otherwise(F.col("own"))
    return (
        attach(slim, stem_mentions(files), ["repo", "stem"], ["path"])
        .withColumn("import_count", count.cast("bigint"))
        .drop("stem", "own", "mentions")
    )


def reference_count(files: DataFrame) -> DataFrame:
    """Files that are imported by others, with the count."""
    return with_import_count(files, {}).where("import_count > 0").select("repo", "path", "import_count")
