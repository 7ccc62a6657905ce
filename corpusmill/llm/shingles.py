"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Used inside Arrow batches of Spark tasks.  All work is done on slices of about
``SLICE_BYTES`` of text, so memory does not depend on the batch; a single text
longer than that forms its own slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 20
SHINGLE_BYTES = 1 << 18  # shingles are made on smaller slices, whose arrays stay in the cache
WIDTH = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

# White space is \x20 and \x09-\x0D; A-Z count as a-z.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_LOWER_BYTE = _BYTE[_LOWER]


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, SLICE_BYTES + 65536)
        factors = np.full(size, base, _U)
        factors[0] = 1
        _powers[key] = np.cumprod(factors)
    return _powers[key][:n]


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Position of the first text and the texts' bytes, slice by slice; null is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def word_hashes(raws: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word; the joined bytes; first word of every text and the end."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((_LOWER_BYTE if lower else _BYTE)[data] * _power(_BASE, len(data)), out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(_U))
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    return hashes, starts, ends, data, np.searchsorted(starts, begins)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of a text with fewer words, the hash of all of them."""
    with np.errstate(over="ignore"):
        for _, raws in slices(texts, SHINGLE_BYTES):
            words, _, _, _, first = word_hashes(raws)
            n = len(words)
            joined = np.zeros(max(0, n - width + 1), _U)
            for k in range(width):
                joined = joined * _U(0x2545F4914F6CDD1D) + words[k : n - width + 1 + k]
            joined = mix(joined)
            for begin, end in zip(first[:-1], first[1:], strict=True):
                if end - begin >= width:
                    yield _distinct(joined[begin : end - width + 1])
                elif end > begin:
                    whole = _U(end - begin)
                    for word in words[begin:end]:
                        whole = whole * _U(0x2545F4914F6CDD1D) + word
                    yield mix(np.array([whole], _U))
                else:
                    yield words[:0]
