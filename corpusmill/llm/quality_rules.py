"""Quality rules, line first.

Every line is judged by itself; failing lines are removed, and a document that loses
more than half of its words is rejected, as is one that fails the base rules.

Line rules (words are runs without white space; a line without words never fails):

* repeated: equal to an earlier line of the document;
* navigation: at least 3 bars ``|``, and a bar for every 4 words or fewer;
* symbols: at least 3 words, and a sign of ``#*$%&|<>`` for every 2 words or fewer;
* shouting: at least 5 words, and an exclamation mark for every 2 words or fewer;
* punctuation: at least 40 words without any of ``. , ; : ! ?``;
* boilerplate: holds one of a list of phrases of licences, cookies and site menus.

Base rules: at least 50 words, and at most half of the words in 3-word windows that
occur twice or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shingles import mix, slices, word_hashes

# Fixed phrases, in lower case.
BOILERPLATE = [
    "all rights reserved", "licensed under", "released under the", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "subscribe to our", "sign up for", "click here", "back to top", "skip to content",
]

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 50

_U = np.uint64
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BLANK = b"\t\n\x0b\x0c\r "
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_MARKS = re.compile(rb"[.,;:!?]")
_DROP_SIGNS = bytes(set(range(256)) - set(b"#*$%&|<>"))


def line_fails(line: bytes, n_words: int) -> bool:
    """Whether a line with ``n_words`` words fails one of the rules that need nothing but the line."""
    bars = line.count(b"|")
    return (
        (bars >= 3 and bars * 4 >= n_words)
        or (n_words >= 3 and len(line.translate(None, _DROP_SIGNS)) * 2 >= n_words)
        or (n_words >= 5 and line.count(b"!") * 2 >= n_words)
        or (n_words >= 40 and not _MARKS.search(line))
        or _PHRASES.search(line.lower()) is not None
    )


def judge_lines(raw: bytes) -> tuple[int, int, list[bool]]:
    """Words of the removed lines, number of repeated lines, and for every line whether it stays."""
    seen: set[bytes] = set()
    lost = repeats = 0
    stays = []
    for line in raw.split(b"\n"):
        if not line.strip(_BLANK):
            stays.append(True)
            continue
        n_words = len(line.split())
        repeated = line in seen
        seen.add(line)
        repeats += repeated
        fails = repeated or line_fails(line, n_words)
        lost += n_words if fails else 0
        stays.append(not fails)
    return lost, repeats, stays


def _repeat_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: words within 3-word windows that occur at least twice in the text."""
    n = len(words)
    inside = np.zeros(n + 1, np.int64)
    if n >= 3:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        windows = np.flatnonzero(text[:-2] == text[2:])
        with np.errstate(over="ignore"):
            keys = mix(mix(words[:-2] * _U(3) + words[1:-1]) * _U(5) + words[2:] + mix(text[:-2].astype(_U) + _U(1)))[windows]
        _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = windows[counts[back] > 1]
        for k in range(3):
            inside[again + k] = 1
    sums = np.concatenate(([0], np.cumsum(inside)))
    return sums[first[1:]] - sums[first[:-1]]


def _judged(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = [[] for _ in range(8)]
            for _, raws in slices(batch.column(1).to_pylist()):
                words, _, _, data, first = word_hashes(raws, lower=False)
                begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)))

                def per_text(values: np.ndarray, begins: np.ndarray = begins) -> np.ndarray:
                    sums = np.concatenate(([0], np.cumsum(values)))
                    return sums[begins[1:]] - sums[begins[:-1]]

                n_words = np.diff(first)
                held[0] += n_words.tolist()
                held[1] += per_text(~_SPACES[data] & ((data & 0xC0) != 0x80)).tolist()
                held[2] += per_text(_SYMBOL[data]).tolist()
                repeat_words = _repeat_words(words, first)
                held[4] += repeat_words.tolist()
                for raw, n, again in zip(raws, n_words.tolist(), repeat_words.tolist(), strict=True):
                    lost, repeats, stays = judge_lines(raw)
                    failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
                    held[3].append(repeats)
                    held[5].append(failed)
                    held[6].append(not failed and 100 * lost <= MAX_LOST_PERCENT * n)
                    if with_text:
                        lines = raw.split(b"\n")
                        held[7].append(b"\n".join(x for x, s in zip(lines, stays, strict=True) if s).decode("utf-8", "replace"))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            columns = [pa.array(v, k) for v, k in zip(held, kinds, strict=True)][: 8 if with_text else 7]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=_NAMES[: len(columns) + 1])

    return run


_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, clean_text string"
)
_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]


def judge_documents(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Counts, verdict and (``with_text``) the text without its failing lines, a row per row of ``docs``.

    Null and empty texts have no words and fail.  Rows with repeated or null ids are
    judged each.  Columns besides ``doc_id`` and ``text`` are ignored.
    """
    schema = _SCHEMA if with_text else _SCHEMA.removesuffix(", clean_text string")
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_judged(with_text), schema)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the failing lines taken out of their texts.

    All other columns are as they are.  Null and empty texts fail and go; repeated
    rows and null ids are judged each; an empty table gives an empty one.
    """
    key, at = docs.columns.index("doc_id"), docs.columns.index("text")
    judged = _judged(True)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for verdict in judged(iter([batch.select([key, at])])):
                columns = batch.columns
                columns[at] = verdict.column(8).cast(batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(verdict.column(7))

    return docs.mapInArrow(keep, docs.schema)


# The same verdicts in DuckDB SQL; {table} names the documents.
SQL = r"""
WITH lines AS (
  SELECT doc_id, row_id, i, line, len(w) AS n_words, w,
         row_number() OVER (PARTITION BY row_id, line ORDER BY i) > 1 AS repeated
  FROM (
    SELECT doc_id, row_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
    FROM (
      SELECT doc_id, row_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
      FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {table})
    )
  )
), judged AS (
  SELECT *, n_words > 0 AND (
      repeated
      OR (len(regexp_extract_all(line, '\|')) >= 3 AND len(regexp_extract_all(line, '\|')) * 4 >= n_words)
      OR (n_words >= 3 AND len(regexp_extract_all(line, '[#*$%&|<>]')) * 2 >= n_words)
      OR (n_words >= 5 AND len(regexp_extract_all(line, '!')) * 2 >= n_words)
      OR (n_words >= 40 AND NOT regexp_matches(line, '[.,;:!?]'))
      OR regexp_matches(lower(line), '{phrases}')
    ) AS fails
  FROM lines
), words AS (
  SELECT row_id, unnest(flat) AS word, generate_subscripts(flat, 1) AS k
  FROM (SELECT row_id, flatten(list(w ORDER BY i)) AS flat FROM lines GROUP BY row_id)
), windows AS (
  SELECT row_id, k, count(*) OVER (PARTITION BY row_id, word, second, third) AS times
  FROM (
    SELECT row_id, k, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third
    FROM words WINDOW o AS (PARTITION BY row_id ORDER BY k)
  ) WHERE third IS NOT NULL
), again AS (
  SELECT row_id, count(DISTINCT k + d) AS n
  FROM windows, (VALUES (0), (1), (2)) AS t(d) WHERE times > 1 GROUP BY row_id
), sums AS (
  SELECT any_value(doc_id) AS doc_id, j.row_id,
         sum(n_words)::BIGINT AS n_words, sum(len(array_to_string(w, '')))::BIGINT AS word_chars,
         sum(len(regexp_extract_all(line, '[#*$%&|<>]')))::BIGINT AS n_symbols,
         count(*) FILTER (WHERE n_words > 0 AND repeated) AS n_dup_lines,
         coalesce(any_value(a.n), 0)::BIGINT AS n_repeat_words,
         coalesce(sum(n_words) FILTER (WHERE fails), 0)::BIGINT AS lost
  FROM judged j LEFT JOIN again a ON a.row_id = j.row_id GROUP BY j.row_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * n_words AS kept
FROM sums
""".replace("{phrases}", "|".join(BOILERPLATE))
