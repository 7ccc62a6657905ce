"""Secret scans, in column expressions alone.

Three kinds of secrets are told by their form: values assigned to names like
``token``, access keys, and long runs of lower-case hex digits.  The fourth kind is told
by disorder.  Its candidates are runs of at least ``WINDOW`` letters, digits and
signs ``+ / _ -``.  A window of ``WINDOW`` characters slides over each candidate; the
counts of its characters change by one that enters and one that leaves, and with them the
sum of ``n * log2 n`` that gives Shannon's entropy.  A window's class is the narrowest
alphabet that holds it (hex, letters, letters and digits, all signs), and every class has
its least entropy.  A candidate's span reaches from its first to its last window that is
disordered enough.  Candidates that match the allow-list (placeholders, paths and
slugs, digit groups, UUIDs, integrity sums, embedded images) are suppressed.

Sums are whole multiples of 2**-20 bits, so results do not depend on the order of additions.
Long candidates are scanned in pieces of ``PIECE`` windows, long lists of matches summed in
blocks, so the work grows in proportion to the text.  A text stays in its row, and
nothing is shuffled.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let

# Fixed patterns of the three kinds told by their form: pattern, group measured, least characters of it.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
FORMS = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]++", 0, 20), "hex": (r"[0-9a-f]++", 0, 24)}
# The same test with fewer steps: whether a text holds any match that is long enough to count.
_MAY_HOLD = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16}", "hex": r"(?<![0-9a-f])[0-9a-f]{24}"}
ENTROPY = "entropy"
KINDS = [*FORMS, ENTROPY]

WINDOW = 20
PIECE = 4096
BLOCK = 256
SCALE = 1 << 20
# Hex digits, other letters, signs; a character's code is its place from 1.
_HEX, _OTHER, _SIGNS = string.digits + "abcdefABCDEF", "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", "+/_-"
ALPHABET = _HEX + _OTHER + _SIGNS
LEAST_BITS = {"hex": 2.9, "letters": 4.15, "alnum": 3.7, "signs": 3.85}
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?<!base64,)[A-Za-z0-9+/_-]{{{WINDOW},}}+"
ALLOW = [
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"^[^0-9]*[+/_-][^0-9]*$",
    r"^[0-9+/_-]+$",
    r"^sha(1|224|256|384|512)-",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
]

# n * log2 n by n, and per class the greatest sum over a window with the least entropy.
LOADS = [0, *(round(n * math.log2(n) * SCALE) for n in range(1, WINDOW + 2))]
LIMITS = {kind: round((math.log2(WINDOW) - bits) * WINDOW * SCALE) for kind, bits in LEAST_BITS.items()}


def running_sums(steps: Column) -> Column:
    """Inclusive prefix sums of an array of numbers, block by block."""

    def inner(values: Column, block: Column) -> Column:
        zero = F.array(F.lit(0).cast("bigint"))
        return F.aggregate(
            F.slice(values, block * BLOCK + 1, F.lit(BLOCK)), zero, lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
        )

    def join(blocks: Column) -> Column:
        before = F.aggregate(
            blocks,
            F.array(F.lit(0).cast("bigint")),
            lambda sums, block: F.concat(sums, F.array(F.element_at(sums, -1) + F.element_at(block, -1))),
        )
        shifted = F.zip_with(
            blocks,
            F.slice(before, F.lit(1), F.size(blocks)),
            lambda block, base: F.transform(F.slice(block, 2, BLOCK), lambda x: x + base),
        )
        return F.flatten(shifted)

    def all_of(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda block: inner(values, block)), join)

    return let(steps, lambda values: F.when(F.size(values) > 0, all_of(values)).otherwise(F.array().cast("array<bigint>")))


def matches(content: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: array of ``(start, stop, value, measured)``, places in code points.

    ``measured`` is the length of the given group.
    """

    def place(hits: Column, groups: Column) -> Column:
        steps = F.zip_with(F.split(content, pattern, -1), hits, lambda gap, hit: (F.length(gap) + F.length(hit)).cast("bigint"))
        stops = running_sums(F.filter(steps, lambda step: step.isNotNull()))
        return F.zip_with(
            F.arrays_zip(hits.alias("value"), F.transform(groups, F.length).alias("measured")),
            stops,
            lambda hit, stop: F.struct(
                (stop - F.length(hit["value"])).alias("start"), stop.alias("stop"), hit["value"].alias("value"), hit["measured"].alias("measured")
            ),
        )

    whole = F.regexp_extract_all(content, F.lit(pattern), 0)
    return let(whole, lambda hits: place(hits, hits if group == 0 else F.regexp_extract_all(content, F.lit(pattern), group)))


def disordered(candidate: Column) -> Column:
    """``(first, last)``: start of the first and of the last window of a candidate with enough entropy, else nulls."""
    loads = F.array(*[F.lit(n).cast("bigint") for n in LOADS])
    none = F.lit(None).cast("int")

    def load(n: Column) -> Column:
        return F.get(loads, n)

    def signed(inside: Column, enters: Column, leaves: Column) -> Column:
        return inside + enters.cast("int") - leaves.cast("int")

    def opening(codes: Column, begin: Column) -> Column:
        """Counts of the characters before the last one of the first window."""
        head = F.slice(codes, begin + 1, F.lit(WINDOW - 1))
        counts = F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda code: F.size(F.filter(head, lambda c: c == code)))
        return let(
            counts,
            lambda counts: F.struct(
                counts.alias("counts"),
                F.aggregate(counts, F.lit(0).cast("bigint"), lambda total, n: total + load(n)).alias("load"),
                F.size(F.filter(head, lambda c: c <= 10)).alias("digits"),
                F.size(F.filter(head, lambda c: (c > len(_HEX)) & (c <= len(_HEX + _OTHER)))).alias("others"),
                F.size(F.filter(head, lambda c: c > len(_HEX + _OTHER))).alias("signs"),
                none.alias("first"),
                none.alias("last"),
            ),
        )

    def slide(codes: Column, state: Column, at: Column) -> Column:
        """One character enters, the window is judged, one leaves."""
        enters, leaves = F.get(codes, at + WINDOW - 1), F.get(codes, at)
        counts = state["counts"]
        had = F.get(counts, enters - 1)
        full = state["load"] + load(had + 1) - load(had)
        has = F.get(counts, leaves - 1) + (leaves == enters).cast("int")
        digits = state["digits"] + (enters <= 10).cast("int")
        others = state["others"] + ((enters > len(_HEX)) & (enters <= len(_HEX + _OTHER))).cast("int")
        signs = state["signs"] + (enters > len(_HEX + _OTHER)).cast("int")
        most = (
            F.when(signs > 0, F.lit(LIMITS["signs"]))
            .when(others == 0, F.lit(LIMITS["hex"]))
            .when(digits == 0, F.lit(LIMITS["letters"]))
            .otherwise(F.lit(LIMITS["alnum"]))
        )
        passes = full <= most
        return F.struct(
            F.transform(counts, lambda n, i: signed(n, i == enters - 1, i == leaves - 1)).alias("counts"),
            (full - load(has) + load(has - 1)).alias("load"),
            (digits - (leaves <= 10).cast("int")).alias("digits"),
            (others - ((leaves > len(_HEX)) & (leaves <= len(_HEX + _OTHER))).cast("int")).alias("others"),
            (signs - (leaves > len(_HEX + _OTHER)).cast("int")).alias("signs"),
            F.when(state["first"].isNull() & passes, at).otherwise(state["first"]).alias("first"),
            F.when(passes, at).otherwise(state["last"]).alias("last"),
        )

    def scan(codes: Column) -> Column:
        windows = F.size(codes) - (WINDOW - 1)

        def piece(begin: Column) -> Column:
            here = F.sequence(begin, F.least(begin + PIECE, windows) - 1)
            return F.aggregate(
                here, opening(codes, begin), lambda state, at: slide(codes, state, at),
                lambda state: F.struct(state["first"].alias("first"), state["last"].alias("last")),
            )

        pieces = F.transform(F.sequence(F.lit(0), windows - 1, F.lit(PIECE)), piece)
        return let(
            pieces,
            lambda found: F.struct(
                F.array_min(F.transform(found, lambda p: p["first"])).alias("first"), F.array_max(F.transform(found, lambda p: p["last"])).alias("last")
            ),
        )

    return let(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c)), scan)


def _formed(content: Column, kind: str) -> Column:
    pattern, group, least = FORMS[kind]
    rank = KINDS.index(kind)
    kept = F.filter(matches(content, pattern, group), lambda m: m["measured"] >= least)
    found = F.transform(kept, lambda m: F.struct(m["start"], F.lit(rank).alias("rank"), m["stop"], m["value"]))
    return F.when(content.rlike(_MAY_HOLD[kind]), found).otherwise(_nothing())


def _nothing() -> Column:
    return F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,value:string>>")


def _entropic(content: Column, allow: list[str]) -> Column:
    def judged(match: Column) -> Column:
        first, last = F.lit(None).cast("int"), F.lit(None).cast("int")
        allowed = F.lit(False)
        for pattern in allow:
            allowed = allowed | match["value"].rlike(pattern)
        windows = F.when(allowed, F.struct(first.alias("first"), last.alias("last"))).otherwise(disordered(match["value"]))
        return let(
            windows,
            lambda w: F.struct(
                (match["start"] + w["first"]).alias("start"),
                F.lit(KINDS.index(ENTROPY)).alias("rank"),
                (match["start"] + w["last"] + WINDOW).alias("stop"),
                F.substr(match["value"], w["first"] + 1, w["last"] - w["first"] + WINDOW).alias("value"),
            ),
        )

    found = F.filter(F.transform(matches(content, CANDIDATE), judged), lambda s: s["start"].isNotNull())
    return F.when(content.rlike(CANDIDATE), found).otherwise(_nothing())


def find_secrets(docs: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """``(doc_id, secrets)``: of every row of ``docs`` an array of ``(start, rank, stop, value)``, by start, then kind.

    ``rank`` is the kind's place in ``KINDS``; places are code points, the end is not
    included.  ``allow`` replaces the allow-list.  Null and empty texts have no secrets; rows
    that repeat an id, with whatever text, and rows with a null id are scanned each; texts
    of any length are scanned whole; an empty table gives none; other columns are ignored.
    """
    # One column expression after another, so that a text goes through each test once.
    content = F.coalesce(F.col("text"), F.lit(""))
    kinds = F.concat(*[_formed(F.col("_content"), kind) for kind in FORMS], _entropic(F.col("_content"), ALLOW if allow is None else allow))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), content.alias("_content")).select(
        "doc_id", F.array_sort(kinds).alias("secrets")
    )


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the spans told by their form, and all spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))

    def written(secrets: Column) -> Column:
        return F.array_join(
            F.transform(secrets, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
        )

    def count(kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("bigint").alias(f"n_{kind}")

    formed = F.filter("secrets", lambda s: s["rank"] < len(FORMS))
    return found.select(
        "doc_id", *[count(kind) for kind in FORMS], F.sha2(written(formed), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"), count(ENTROPY),
    )


def _sql_list(values: list[int]) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


# The same rows in DuckDB SQL over ``documents``.
SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS content FROM documents
), patterns(rank, kind, pattern, least) AS (
  VALUES (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
         (1, 'access', 'AKIA[A-Z0-9]+', 20), (2, 'hex', '[0-9a-f]+', 24), (3, 'entropy', '[A-Za-z0-9+/_-]+', {window})
), hits AS (
  SELECT row_id, rank, kind, least, unnest(hit) AS hit, unnest(measured) AS measured, unnest(list_slice(gap, 1, len(hit))) AS gap,
         generate_subscripts(hit, 1) AS k
  FROM (
    SELECT row_id, rank, kind, least,
           CASE rank WHEN 0 THEN regexp_extract_all(content, '{assign}', 0) WHEN 1 THEN regexp_extract_all(content, 'AKIA[A-Z0-9]+', 0)
                WHEN 2 THEN regexp_extract_all(content, '[0-9a-f]+', 0) ELSE regexp_extract_all(content, '[A-Za-z0-9+/_-]+', 0) END AS hit,
           CASE rank WHEN 0 THEN regexp_extract_all(content, '{assign}', 2) ELSE hit END AS measured,
           CASE rank WHEN 0 THEN string_split_regex(content, '{assign}') WHEN 1 THEN string_split_regex(content, 'AKIA[A-Z0-9]+')
                WHEN 2 THEN string_split_regex(content, '[0-9a-f]+') ELSE string_split_regex(content, '[A-Za-z0-9+/_-]+') END AS gap
    FROM texts, patterns
  ) WHERE len(hit) > 0
), placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER o AS stop, lag(hit) OVER o AS before
  FROM hits WINDOW o AS (PARTITION BY row_id, rank ORDER BY k)
), formed AS (
  SELECT row_id, rank, kind, stop - length(hit) AS start, stop FROM placed WHERE rank < 3 AND length(measured) >= least
), candidates AS (
  SELECT row_id, rank, kind, hit, stop - length(hit) AS start FROM placed
  WHERE rank = 3 AND length(hit) >= {window} AND NOT (gap = ',' AND coalesce(ends_with(before, 'base64'), false)) AND NOT ({allow})
), windows AS (
  SELECT row_id, rank, kind, start, i, substr(hit, i + 1, {window}) AS w
  FROM (SELECT *, unnest(range(0, length(hit) - {window} + 1)) AS i FROM candidates)
), entropic AS (
  SELECT row_id, rank, kind, start + min(i) AS start, start + max(i) + {window} AS stop
  FROM windows
  WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: ({loads})[length(w) - length(replace(w, c, '')) + 1]))
        <= CASE WHEN regexp_matches(w, '[+/_-]') THEN {signs} WHEN regexp_matches(w, '^[0-9a-fA-F]+$') THEN {hex}
                WHEN regexp_matches(w, '[0-9]') THEN {alnum} ELSE {letters} END
  GROUP BY row_id, rank, kind, start
), spans AS (
  SELECT row_id, rank, start, concat(kind, ':', start, ':', stop) AS span FROM formed
  UNION ALL SELECT row_id, rank, start, concat(kind, ':', start, ':', stop) FROM entropic
), joined AS (
  SELECT row_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
         count(*) FILTER (WHERE rank = 2) AS n_hex, count(*) FILTER (WHERE rank = 3) AS n_entropy,
         string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM texts LEFT JOIN joined USING (row_id)
"""
for _name, _value in {
    "window": WINDOW, "loads": _sql_list(LOADS), "assign": ASSIGN.replace("*+", "*").replace("'", "''"),
    "allow": " OR ".join(f"regexp_matches(hit, '{pattern}')" for pattern in ALLOW), **LIMITS,
}.items():
    SQL = SQL.replace("{" + _name + "}", str(_value))
