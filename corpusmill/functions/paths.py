"""Column expressions over ``/``-separated paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import settings


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash, ``''`` at the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def extension(path: Column) -> Column:
    """Last dotted suffix of the name; leading dots start no extension."""
    return F.regexp_extract(basename(path), r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def stem(path: Column) -> Column:
    """The name without its extension."""
    name = basename(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(path)))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def parent_names(path: Column) -> Column:
    """Names of all directories above the file."""
    segments = F.split(path, "/")
    return F.slice(segments, F.lit(1), F.size(segments) - 1)


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(settings.LANGUAGE_BY_EXT.items())])
    return F.coalesce(F.element_at(known, extension(F.lower(path))), F.lit("unknown"))
