"""Token counts of texts under a unigram vocabulary, by dynamic programming over a trie.

Pre-tokens are the runs of a text without white space, each with a word mark before
it.  The distinct pre-tokens of a batch go into a trie.  The unigram forward score of
a node, the least cost of cutting its prefix into pieces, depends on the prefix alone,
so it is worked out once however many pre-tokens share it; level by level, for all
nodes of a level at once.  A pre-token's terminal node then holds its number of tokens.
Pre-tokens of more than ``MAX_BYTES`` bytes get the same scores position by position.

Costs are integers, so results do not depend on any order of additions; of equal
costs, fewer tokens win.  A character that no piece covers costs one token per byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shingles import mix, slices

MARK = "▁"
SCALE = 1 << 20
TOKEN_BITS = 20
# In the scores of long pre-tokens, which are Python integers and have no bound.
LONG_BITS = 32
LONG_BLOCK = 1 << 16

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def vocabulary(model: str) -> dict[str, int]:
    """Pieces and their costs: a SentencePiece model's normal pieces, by rank, under Zipf's law.

    The cost of the r-th piece is ``-log(1 / ((r + 1) * H))`` in units of 2**-20, where
    H makes the probabilities sum to 1.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    n = library.get_piece_size()
    normal = [i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
    # Rank by the model's own score, then by id.
    normal.sort(key=lambda i: (-library.get_score(i), i))
    whole = math.log(sum(1 / (r + 1) for r in range(len(normal))))
    return {library.id_to_piece(i): round((math.log(r + 1) + whole) * SCALE) for r, i in enumerate(normal)}


class PrefixCounter:
    """Forward scores over tries of byte strings."""

    def __init__(self, pieces: dict[str, int]) -> None:
        raws = {p.encode(): c for p, c in pieces.items()}
        self.longest = max(map(len, raws), default=0)
        # A byte without a piece is dearer than any piece, and one token.
        self.fallback = max(pieces.values(), default=0) + 4 * SCALE
        by_hash: dict[int, tuple[int, bytes]] = {}
        for raw, cost in raws.items():
            key = int(self._hash(raw))
            if key in by_hash:
                raise ValueError("two pieces with one hash")
            by_hash[key] = (cost, raw)
        order = sorted(by_hash)
        # An open hash table in two arrays.
        bits = max(4, (2 * len(order)).bit_length())
        self.mask = _U((1 << bits) - 1)
        self.keys, self.costs = np.zeros(1 << bits, _U), np.zeros(1 << bits, np.int64)
        for key in order:
            at = key & int(self.mask)
            while self.keys[at]:
                at = (at + 1) & int(self.mask)
            self.keys[at], self.costs[at] = key, by_hash[key][0]
        self.lengths = sorted({len(raw) for raw in raws})

    @staticmethod
    def _hash(raw: bytes) -> np.uint64:
        value = np.zeros(1, _U)
        with np.errstate(over="ignore"):
            for byte in raw:
                value = value * _BASE + _BYTE[byte]
            return mix(value)[0] | _U(1)

    def _cost(self, hashes: np.ndarray) -> np.ndarray:
        """Cost of each hashed piece; 0 for none."""
        cost = np.zeros(len(hashes), np.int64)
        at = hashes & self.mask
        left = np.arange(len(hashes))
        while len(left):
            own = self.keys[at[left]]
            hit = own == hashes[left]
            cost[left[hit]] = self.costs[at[left[hit]]]
            left = left[~hit & (own != 0)]
            at[left] = (at[left] + _U(1)) & self.mask
        return cost

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each byte string.

        ``words`` are sorted here, so that a node of the trie is a run of rows: the
        level's nodes are the places where a new prefix begins.
        """
        result = np.zeros(len(words), np.int64)
        order = sorted(range(len(words)), key=words.__getitem__)
        rows = [words[i] for i in order]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.frombuffer(b"".join(rows), np.uint8)
        starts = np.cumsum(sizes) - sizes
        # Of the last levels: for each row its node, and for each node score and running hash.
        alive = np.arange(len(rows))
        node = np.zeros(len(rows), np.int64)
        scores = [np.zeros(1, np.int64)]
        hashes = [np.zeros(1, _U)]
        parents: list[np.ndarray] = []
        answers = np.zeros(len(rows), np.int64)
        powers = np.ones(self.longest + 1, _U)
        with np.errstate(over="ignore"):
            for k in range(1, self.longest + 1):
                powers[k] = powers[k - 1] * _BASE
            depth = 0
            while len(alive):
                depth += 1
                alive = alive[sizes[alive] >= depth]
                if not len(alive):
                    break
                byte = flat[starts[alive] + depth - 1]
                above = node[alive]
                fresh = np.ones(len(alive), bool)
                fresh[1:] = (above[1:] != above[:-1]) | (byte[1:] != byte[:-1])
                number = np.cumsum(fresh) - 1
                parent, last = above[fresh], byte[fresh]
                node[alive] = number
                parents.append(parent)
                running = hashes[-1][parent] * _BASE + _BYTE[last]
                # One byte by itself, then every piece length that ends here.
                best = scores[-1][parent] + (self.fallback << TOKEN_BITS) + 1
                up = np.arange(len(parent))
                for k in range(1, min(depth, self.longest) + 1):
                    up = parents[-k][up]
                    if k not in self.lengths:
                        continue
                    cost = self._cost(mix(running - hashes[-k][up] * powers[k]) | _U(1))
                    hit = np.flatnonzero(cost)
                    best[hit] = np.minimum(best[hit], scores[-k][up[hit]] + (cost[hit] << TOKEN_BITS) + 1)
                scores.append(best)
                hashes.append(running)
                if len(scores) > self.longest:
                    scores.pop(0)
                    hashes.pop(0)
                    parents.pop(0) if len(parents) > self.longest else None
                ended = alive[sizes[alive] == depth]
                answers[ended] = best[node[ended]] & ((1 << TOKEN_BITS) - 1)
        result[order] = answers
        return result

    def _pieces_at(self, flat: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, length, cost)`` of all pieces in ``flat`` that begin before ``size``, by start."""
        # Pieces are whole characters.
        starts = np.flatnonzero((flat[:size] & 0xC0) != 0x80)
        running = np.zeros(len(starts), _U)
        found = [(np.zeros(0, np.int64),) * 3]
        lengths = set(self.lengths)
        with np.errstate(over="ignore"):
            for k in range(1, self.longest + 1):
                room = int(np.searchsorted(starts, len(flat) - k, "right"))
                starts, running = starts[:room], running[:room] * _BASE + _BYTE[flat[starts[:room] + k - 1]]
                if k in lengths:
                    cost = self._cost(mix(running) | _U(1))
                    hit = np.flatnonzero(cost)
                    found.append((starts[hit], np.full(len(hit), k), cost[hit]))
        start, length, cost = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], length[order], cost[order]

    def count_long(self, word: bytes) -> int:
        """Number of tokens of one byte string of any length, by blocks that hand on the scores that pieces reach into the next."""
        flat = np.frombuffer(word, np.uint8)
        single = (self.fallback << LONG_BITS) + 1
        scores = [0]
        for first in range(0, len(word), LONG_BLOCK):
            size = min(LONG_BLOCK, len(word) - first)
            start, length, cost = self._pieces_at(flat[first : first + size + self.longest], size)
            bounds = np.searchsorted(start, np.arange(size), "right").tolist()
            ends, steps = (start + length).tolist(), ((cost << LONG_BITS) + 1).tolist()
            scores += [math.inf] * (size + self.longest + 1 - len(scores))
            k = 0
            for at, bound in enumerate(bounds):
                here = scores[at]
                if here + single < scores[at + 1]:
                    scores[at + 1] = here + single
                while k < bound:
                    if here + steps[k] < scores[ends[k]]:
                        scores[ends[k]] = here + steps[k]
                    k += 1
            scores = scores[size:]
        return scores[0] & ((1 << LONG_BITS) - 1)


_BASE = _U(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))


MEMORY_WORDS = 600_000
_memory: dict[str, dict[bytes, int]] = {}


def _counted(pieces: dict[str, int], name: str):
    prefix = MARK.encode()
    # A pre-token has one mark, at its start.
    usable = {piece: cost for piece, cost in pieces.items() if MARK not in piece[1:]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(usable)
        if name not in _memory:
            _memory.clear()
        # A worker's tasks share what they have counted.
        known = _memory.setdefault(name, {})
        for batch in batches:
            n_words, n_tokens, n_distinct = [], [], []
            for _, raws in slices(batch.column(1).to_pylist()):
                parts = [raw.split() for raw in raws]
                words = set().union(*parts)
                if len(known) + len(words) > MEMORY_WORDS:
                    known.clear()
                words = list(words.difference(known))
                known.update(zip(words, _token_counts(counter, words, prefix), strict=True))
                for own in parts:
                    n_words.append(len(own))
                    n_tokens.append(sum(map(known.__getitem__, own)))
                    n_distinct.append(len(set(own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, pa.int64()) for v in (n_words, n_distinct, n_tokens))],
                names=["doc_id", "n_pretokens", "n_distinct", "n_tokens"],
            )

    return run


#: Longest pre-token, in bytes, that goes into the trie, whose levels are its bytes; longer ones are counted one by one.
MAX_BYTES = 2048


def _token_counts(counter: PrefixCounter, words: list[bytes], prefix: bytes) -> list[int]:
    short = [w for w in words if len(w) <= MAX_BYTES]
    known = dict(zip(short, counter.counts([prefix + w for w in short]).tolist(), strict=True))
    known.update((w, counter.count_long(prefix + w)) for w in words if len(w) > MAX_BYTES)
    return [known[w] for w in words]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_pretokens, n_distinct, n_tokens)`` of every row of ``docs``.

    Null and empty texts have none.  Rows with repeated or null ids are counted each.  Columns besides ``doc_id`` and ``text`` are ignored.  No
    shuffle: a task counts its texts by themselves, slice by slice.
    """
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _counted(vocabulary(model), model), "doc_id bigint, n_pretokens bigint, n_distinct bigint, n_tokens bigint"
    )
