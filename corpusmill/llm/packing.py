"""Packing of tokenized documents into sequences of fixed capacity.

The lengths of all pieces are a histogram of at most ``capacity`` classes, and the
configurations of a sequence (how many pieces of which length) form a linear program:
cover every length's count with as few configurations as possible.  Multiplicative
weights solve it: a price per length that falls as the length is covered, and a
knapsack dynamic program that gives, at these prices, the dearest configuration around
each length.  A round takes the dearest ones, each as often as an even share of its
lengths allows, rounded to whole sequences.  First only full sequences are taken; a round that
finds none lowers the fill asked for.  Rounds go on until no configuration can be made of
what is left, a few hundredths of the pieces at most in the tables tried.  These fill the
open room best-fit, on counts.

The number of rounds follows from the distinct lengths and not from their counts.
Pieces take their places by their number within their length, which is counted in
salted groups, so that no length gathers in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.landing import land
from corpusmill.llm.segments import encoder

CAPACITY = 2048
END_ID = 0
SALTS = 512
SHARE = 0.1  # of a length's count, what a round covers at most
FALL = 4.0  # of prices: by e to this power from uncovered to covered
BEND = 1.2  # of worth over length: above 1, a few long pieces are dearer than many short ones that fill the same room

Configuration = tuple[tuple[int, int], ...]  # (length, pieces), longest first


def _knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest total price within each room, and the length (its place) that it takes last, or -1."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        fit = int(np.searchsorted(lengths, room, "right"))
        values = best[room - lengths[:fit]] + prices[:fit]
        i = int(values.argmax())
        best[room], last[room] = values[i], i
    return best, last


def _around(i: int, last: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest configuration that holds length ``i``: places of lengths and numbers of pieces."""
    used, room = Counter([i]), capacity - int(lengths[i])
    while (j := int(last[room])) >= 0:
        used[j] += 1
        room -= int(lengths[j])
    return used


def configuration_program(counts: dict[int, int], capacity: int, rounds: int | None = None) -> Counter[Configuration]:
    """Whole solution of the covering program by multiplicative weights; no count is covered more than once over.

    ``rounds`` bounds the rounds; without it they go on until none adds anything.
    """
    lengths = np.array(sorted(counts))
    need = np.array([counts[int(n)] for n in lengths])
    left, worth = need.copy(), (lengths / capacity) ** BEND
    amounts: Counter[Configuration] = Counter()
    fill, done = capacity, 0
    while left.any() and (rounds is None or done < rounds):
        done += 1
        live = np.flatnonzero(left)
        sizes, rest = lengths[live], left[live]
        covered = 1 - rest / need[live]
        prices = worth[live] * np.exp(-FALL * (covered - covered.min()))
        best, last = _knapsack(prices, sizes, capacity)
        share = np.minimum(np.maximum(1, np.floor(need[live] * SHARE)).astype(np.int64), rest)
        fullest, added = 0, False
        for i in np.lexsort((-sizes, -(prices + best[capacity - sizes]))):
            if not share[i]:
                continue
            used = _around(int(i), last, sizes, capacity)
            if any(not share[j] or rest[j] < k for j, k in used.items()):
                continue
            size = sum(int(sizes[j]) * k for j, k in used.items())
            if size < fill:
                fullest = max(fullest, size)
                continue
            times = max(1, min(int(share[j]) // k for j, k in used.items()))
            for j, k in used.items():
                share[j] = max(0, share[j] - k * times)
                rest[j] -= k * times
            amounts[tuple(sorted(((int(sizes[j]), k) for j, k in used.items()), reverse=True))] += times
            added = True
        left[live] = rest
        if not added:
            if not fullest:
                break
            fill = min(fullest, capacity - (capacity - fill) * 5 // 4)
    return amounts


def best_fit(counts: dict[int, int], capacity: int, begun: Counter[Configuration]) -> Counter[Configuration]:
    """Best-fit decreasing on counts: all pieces of a length go at once into the fullest open sequences that take them.

    ``begun`` are the sequences that are open at the start.
    """
    rooms: list[int] = []
    open_: dict[int, Counter[Configuration]] = {}

    def put(configuration: Configuration, room: int, times: int) -> None:
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][configuration] += times

    for configuration, times in sorted(begun.items()):
        put(configuration, capacity - sum(n * k for n, k in configuration), times)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(left, capacity // length)
                times = left // each
                put(((length, each),), capacity - each * length, times)
                left -= each * times
                continue
            room = rooms[at]
            configuration, have = open_[room].popitem()
            each = min(left, room // length)
            times = min(have, left // each)
            if have > times:
                open_[room][configuration] = have - times
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            put((*configuration, (length, each)), room - each * length, times)
            left -= each * times
    total: Counter[Configuration] = Counter()
    for configurations in open_.values():
        total.update(configurations)
    return total


def plan_sequences(counts: dict[int, int], capacity: int, rounds: int | None = None) -> list[tuple[Configuration, int]]:
    """Configurations and how many sequences take each; every piece has exactly one place.

    The program's solution, and in its open room and new sequences the pieces that it leaves.
    """
    counts = {n: k for n, k in counts.items() if k > 0}
    if not counts:
        return []
    planned = configuration_program(counts, capacity, rounds)
    left = dict(counts)
    for configuration, times in planned.items():
        for n, k in configuration:
            left[n] -= k * times
    return sorted(best_fit({n: k for n, k in left.items() if k}, capacity, planned).items())


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(encode.encode(text), encode.dtype).astype("<u4"), np.uint32(end_id))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    raw = ids[start : start + capacity].tobytes()
                    rows.append((key, k, start, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_PIECE_NAMES)

    return cut


_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
_PIECE_NAMES = [part.split()[0] for part in _PIECE.split(", ")]


def _places(plan: list[tuple[Configuration, int]]):
    """Sequence and offset of the r-th piece of each length, looked up in the plan's runs of equal sequences."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    seen: Counter[int] = Counter()
    sequence = 0
    for configuration, times in plan:
        offset = 0
        for length, each in configuration:
            runs[length].append((seen[length], sequence, each, offset))
            seen[length] += each * times
            offset += each * length
        sequence += times
    tables = {length: np.array(rows, np.int64).T for length, rows in runs.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            lengths = batch.column(names.index("length")).to_numpy()
            ranks = batch.column(names.index("rank")).to_numpy()
            sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                firsts, numbers, each, begins = tables[int(length)]
                run = np.searchsorted(firsts, ranks[at], "right") - 1
                within = ranks[at] - firsts[run]
                sequences[at] = numbers[run] + within // each[run]
                offsets[at] = begins[run] + within % each[run] * length
            kept = [c for n, c in zip(names, batch.columns, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequences), pa.array(offsets)], names=[*(n for n in names if n != "rank"), "sequence_id", "offset"]
            )

    return place


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``, one row per piece.

    Null and empty texts are the end id alone.  Repeated rows are packed each; rows
    with a null id too.  Only documents longer than the capacity are cut.  Columns
    besides ``doc_id`` and ``text`` are ignored.
    """
    pieces = land(
        docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), _PIECE),
        "pieces",
    )
    if not with_ids:
        pieces = pieces.drop("ids")
    # At most ``capacity`` lengths times SALTS counts; numbers within a length follow from them.
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = land(groups.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    counts = {row.length: row.n for row in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("rank", F.row_number().over(order) - 1)
        .join(groups.select("length", "salt", "first"), ["length", "salt"])
        .withColumn("rank", (F.col("rank") + F.col("first")).cast("bigint"))
        .select(*pieces.columns, "rank")
    )
    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(_places(plan_sequences(counts, capacity)), schema)
