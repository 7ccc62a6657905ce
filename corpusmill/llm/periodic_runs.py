"""Periodic run detection on a Re-Pair grammar of the words.

A run is a stretch of words with smallest period q, at least ``MIN_WORDS`` words and
``MIN_EXPONENT`` periods long, that no neighbouring word extends.

The words of each text are compressed by Re-Pair: pairs of neighbouring symbols that occur
again become nonterminals, the most frequent first; pairs that are locally the most
frequent are replaced in the same round, for all texts of a slice at once.  What remains of a
text is joined by a balanced tree of nodes that occur once.  Every run lies within some
node and crosses the boundary between its two halves, so it is enough to look for runs across
each nonterminal's boundary, once, at its first occurrence: a run of four periods has
two of them on one side, so the word at the boundary returns one period away.  Equal
stretches are compared by prefix sums, and what is found is compared word by word.  Runs of a
nonterminal are then moved to all places where it was written, and intervals of one period
that overlap by a period are merged.

Everything is numpy on slices of about 1 MB of text; a longer text is a slice of its own.
Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shingles import _BASE, _power, mix, slices, word_hashes

MIN_WORDS, MIN_EXPONENT = 6, 4

_U = np.uint64
_BUCKET_BITS = 20
_NONE = np.zeros(0, np.int64)


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers ``begin[k] … begin[k] + count[k] - 1`` of all k in a row, and the k of each."""
    owner = np.repeat(np.arange(len(begin)), count)
    offsets = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return begin[owner] + offsets, owner


class Words:
    """Word names of a slice, with prefix sums that tell unequal stretches apart."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.power = _power(_BASE, len(names) + 1)
        self.sums = np.zeros(len(names) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(names * self.power[:-1], out=self.sums[1:])

    def same(self, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether stretches of ``size`` words at ``left`` and further right look the same."""
        with np.errstate(over="ignore"):
            a = self.sums[left + size] - self.sums[left]
            return a * self.power[right - left] == self.sums[right + size] - self.sums[right]

    def extent(self, at: np.ndarray, period: np.ndarray, room: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``at`` on (backward: before ``at``) equal those one period later, at most ``room``."""
        low, high = np.zeros(len(at), np.int64), room.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            begin = at if forward else at - middle
            good = self.same(begin, begin + period, middle)
            low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
        return low

    def exact(self, start: int, end: int, period: int, lo: int, hi: int) -> tuple[int, int]:
        """The stretch with this period around ``start … start + 2 * period``, word by word, if the sums were mistaken."""
        w = self.names
        if (
            (w[start : end - period] == w[start + period : end]).all()
            and (start == lo or w[start - 1] != w[start - 1 + period])
            and (end == hi or w[end] != w[end - period])
        ):
            return start, end
        differs = np.flatnonzero(w[start : hi - period] != w[start + period : hi])
        end = start + period + (int(differs[0]) if len(differs) else hi - period - start)
        before = np.flatnonzero(w[lo:start] != w[lo + period : start + period])
        return (lo + int(before[-1]) + 1 if len(before) else lo), end


def crossing_runs(words: Words, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, longest: int = MIN_EXPONENT) -> tuple[np.ndarray, ...]:
    """Runs across ``mid`` within ``lo … hi`` of every node: node, start, end, period."""
    w, found = words.names, []
    # A run across mid of MIN_EXPONENT periods has half of them right or left of it, two at least.
    half = max(2, longest // 2)
    for side in (1, -1):
        anchor = mid if side == 1 else mid - 1
        most = ((hi - mid) if side == 1 else (mid - lo)) // half
        most = np.minimum(most, (hi - lo) // longest)
        step, node = _ranges(np.ones(len(mid), np.int64), np.maximum(most, 0))
        keep = w[anchor[node] + side * step] == w[anchor[node]]
        step, node = step[keep], node[keep]
        # The other end of the first period, then all of it.
        at = mid[node] if side == 1 else mid[node] - 2 * step
        keep = w[at + step - 1] == w[at + 2 * step - 1]
        keep[keep] = w[at[keep]] == w[at[keep] + step[keep]]
        keep[keep] = words.same(at[keep], at[keep] + step[keep], step[keep])
        step, node = step[keep], node[keep]
        # Periods from the least on; what lies in a found stretch has no period but multiples of its own.
        while len(node):
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            k, q = node[first], step[first]
            forward = words.extent(mid[k], q, hi[k] - q - mid[k], True) if side == 1 else words.extent(mid[k] - q, q, hi[k] - mid[k], True)
            begin = mid[k] if side == 1 else mid[k] - q
            backward = words.extent(begin, q, begin - lo[k], False)
            start, end = begin - backward, begin + forward + q
            enough = end - start >= np.maximum(MIN_WORDS, longest * q)
            for j in np.flatnonzero(enough):
                s, e = words.exact(int(start[j]), int(end[j]), int(q[j]), int(lo[k[j]]), int(hi[k[j]]))
                start[j], end[j] = s, e
                if e - s >= max(MIN_WORDS, longest * int(q[j])):
                    found.append((int(k[j]), s, e, int(q[j])))
            reach = np.zeros(len(mid), np.int64)
            reach[k] = (end - mid[k]) if side == 1 else (mid[k] - start)
            rest = 2 * step > reach[node]
            rest[first] = False
            step, node = step[rest], node[rest]
    if not found:
        return _NONE, _NONE, _NONE, _NONE
    return tuple(np.array(sorted(set(found)), np.int64).T)


def _repeated_pairs(names: np.ndarray, ends_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs to replace in this round, which do not overlap, and the pairs' names."""
    with np.errstate(over="ignore"):
        pair = mix(names[:-1] * _U(0x2545F4914F6CDD1D) + names[1:])
    # A pair alone in its bucket occurs once.
    bucket = (pair >> _U(64 - _BUCKET_BITS)).astype(np.int64)
    bucket[ends_text[:-1]] = 0
    may = np.flatnonzero((np.bincount(bucket, minlength=1)[bucket] > 1) & ~ends_text[:-1])
    _, back, counts = np.unique(pair[may], return_inverse=True, return_counts=True)
    rank = np.zeros(len(pair), _U)
    rank[may] = np.where(counts[back] > 1, (counts[back].astype(_U) << _U(40)) | (pair[may] >> _U(24)), _U(0))
    # Neighbouring places of one rank are a repeated symbol: every other one of them.
    begin = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
    height = rank[begin]
    before, after = np.concatenate(([_U(0)], height[:-1])), np.concatenate((height[1:], [_U(0)]))
    chosen = (height > 0) & (height > before) & (height > after)
    size = np.diff(np.concatenate((begin, [len(rank)])))
    places, _ = _ranges(begin[chosen], (size[chosen] + 1) // 2)
    firsts = np.repeat(begin[chosen], (size[chosen] + 1) // 2)
    places = firsts + 2 * (places - firsts)
    if not len(places):
        return _NONE, pair[:0]
    _, back, counts = np.unique(pair[places], return_inverse=True, return_counts=True)
    again = counts[back] > 1
    return places[again], pair[places[again]]


def grammar_runs(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows ``(text, start, end, period)`` of all runs, by text, start, period; ``first`` has each text's first word and the end.

    Starts and ends count from the slice's first word.
    """
    n = len(names)
    if n < MIN_WORDS:
        return np.zeros((0, 4), np.int64)
    words = Words(names)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    is_start = np.ones(n, bool)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # Symbols that may still be replaced: name, first word, number of words, text.  Names differ by text.
    with np.errstate(over="ignore"):
        symbol = mix(names + mix(text.astype(_U) + _U(1)))
    start, size, owner = np.arange(n), np.ones(n, np.int64), text
    while len(symbol) > 1:
        places, rules = _repeated_pairs(symbol, np.append(owner[1:] != owner[:-1], True))
        if not len(places):
            break
        order = np.argsort(rules, kind="stable")
        begin = start[places][order]
        middle, end = begin + size[places][order], begin + (size[places] + size[places + 1])[order]
        fresh = np.flatnonzero(np.concatenate(([True], rules[order][1:] != rules[order][:-1])))
        wide = np.flatnonzero(end[fresh] - begin[fresh] >= MIN_WORDS)
        at = fresh[wide]
        node, s, e, q = crossing_runs(words, begin[at], middle[at], end[at])
        if len(node):
            # From the first occurrence of a rule to all of them.
            head = at[node]
            times = np.diff(np.append(fresh, len(begin)))[wide[node]]
            where, which = _ranges(head, times)
            moved = begin[where] - begin[head[which]]
            parts.append((s[which] + moved, e[which] + moved, q[which]))
        is_start[start[places + 1]] = False
        size[places] += size[places + 1]
        symbol = symbol.copy()
        symbol[places] = mix(rules ^ _U(0x9E3779B97F4A7C15))
        stay = np.ones(len(symbol), bool)
        stay[places + 1] = False
        # Texts in which nothing was replaced are done.
        busy = np.zeros(len(first) - 1, bool)
        busy[owner[places]] = True
        stay &= busy[owner]
        symbol, start, size, owner = symbol[stay], start[stay], size[stay], owner[stay]
    # What is left of a text, under a balanced tree.
    left = np.flatnonzero(is_start)
    head = np.searchsorted(left, first)
    place = np.arange(len(left)) - head[text[left]]
    stop = first[text[left] + 1]
    most = int(np.diff(head).max()) if len(left) else 0
    width = 1
    while width < most:
        j = np.flatnonzero((place & (2 * width - 1)) == width)
        after = np.minimum(j + width, head[text[left[j]] + 1])
        hi = np.where(after < head[text[left[j]] + 1], left[np.minimum(after, len(left) - 1)], stop[j])
        lo, mid = left[j - width], left[j]
        wide = hi - lo >= MIN_WORDS
        _, s, e, q = crossing_runs(words, lo[wide], mid[wide], hi[wide])
        parts.append((s, e, q))
        width *= 2
    if not parts:
        return np.zeros((0, 4), np.int64)
    s, e, q = (np.concatenate(column) for column in zip(*parts, strict=True))
    return _maximal(text, s, e, q)


def _maximal(text: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Union of the intervals of one text and period that overlap by a period at least."""
    if not len(s):
        return np.zeros((0, 4), np.int64)
    rows = np.unique(np.stack((text[s], q, s, e), 1), axis=0)
    merged: list[list[int]] = []
    for t, period, start, end in rows.tolist():
        last = merged[-1] if merged else None
        if last and last[0] == t and last[1] == period and start + period <= last[3]:
            last[3] = max(last[3], end)
        else:
            merged.append([t, period, start, end])
    out = np.array(sorted((t, start, period, end) for t, period, start, end in merged), np.int64)
    return out[:, [0, 1, 3, 2]]


def _planted(n: int, key: int) -> tuple[int, int] | None:
    """First word and period of the repeats that the test planting writes into a text of ``n`` words."""
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


_FOUND = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_DIGESTS = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def text_runs(texts: list[str | None], keys: list[int | None] | None = None) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Of each text the number of words, its runs ``(start, length, period)``, and the words that stay, joined by a space.

    With ``keys``, repeats are planted first into the texts that their key selects.
    """
    for position, raws in slices(texts):
        names, _, _, _, first = word_hashes(raws, lower=False)
        written: dict[int, list[bytes]] = {}
        for i, n in enumerate(np.diff(first).tolist()):
            key = keys[position + i] if keys else None
            plan = _planted(n, key) if key is not None else None
            if plan:
                a, p = plan
                places = np.arange(n)
                places[a:] = a + (places[a:] - a) % p
                names[first[i] : first[i + 1]] = names[first[i] : first[i + 1]][places]
                parts = raws[i].split()
                written[i] = [parts[k] for k in places.tolist()]
        found = grammar_runs(names, first)
        edges = np.searchsorted(found[:, 0], np.arange(len(raws) + 1))
        for i, raw in enumerate(raws):
            n, base = int(first[i + 1] - first[i]), int(first[i])
            own = found[edges[i] : edges[i + 1]]
            parts = written[i] if i in written else raw.split()
            if len(own):
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, own[:, 1] + own[:, 3] - base, 1)
                np.add.at(change, own[:, 2] - base, -1)
                parts = [word for word, covered in zip(parts, np.cumsum(change)[:-1].tolist(), strict=True) if not covered]
            yield n, [(s - base, e - s, q) for _, s, e, q in own.tolist()], b" ".join(parts)


def find_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row: its runs by start, then period, and the text without repeats.

    ``collapsed`` joins by one space the words that no run has after its first period.  Null and
    empty texts have no words; repeated rows and null ids are worked on each; texts of any
    length are taken whole; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = list(text_runs(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([n for n, _, _ in held], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for _, runs, _ in held], _RUN),
                    pa.array([kept.decode("utf-8", "replace") for _, _, kept in held], pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _FOUND)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length in periods; of equals the one that starts first, then has the least period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def run_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the runs of every row after planting; see :func:`find_runs`.  A null id plants nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in batches:
            rows = []
            for _, runs, kept in text_runs(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                best = strongest(runs) if runs else (None, None, None)
                milli = 1000 * best[1] // best[2] if runs else None
                listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                rows.append((len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                names=[part.split()[0] for part in _DIGESTS.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _DIGESTS)
