"""Canonical length-limited Huffman coding of id blocks, in numpy.

A block is decoded by table look-up of ``LIMIT`` bits at a time, for all of its
checkpoints at once: every ``INTERVAL`` ids the bit offset is recorded.
"""

from __future__ import annotations

import numpy as np

INTERVAL = 128


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of the limited length")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    # Level by level: the sorted merge of all ids with the pairs of the level below.
    levels, below = [], np.zeros(0, np.int64)
    for _ in range(limit):
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate((weights, pairs))
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        below = merged[order]
    taken = 2 * len(used) - 2
    for is_id in reversed(levels):
        ids = int(is_id[:taken].sum())
        lengths[used[:ids]] += 1
        taken = 2 * (taken - ids)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths.max())
        steps = np.uint64(1) << (top - lengths[order].astype(np.int64)).astype(np.uint64)
        starts = np.concatenate(([0], np.cumsum(steps)[:-1])).astype(np.uint64)
        codes[order] = starts >> (top - lengths[order].astype(np.int64)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next ``limit`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, limit - lengths[order].astype(np.int64))
    ids = np.zeros(1 << limit, np.uint32)
    sizes = np.ones(1 << limit, np.int64)
    filled = int(spans.sum())
    ids[:filled] = np.repeat(order, spans)
    sizes[:filled] = np.repeat(lengths[order], spans)
    return ids, sizes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Checkpoints (little-endian 32-bit bit offsets) and bits of a block; a code has at most 32 bits."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    total = int(ends[-1]) if len(ids) else 0
    if total >= 1 << 32:
        raise ValueError("block too large")
    shifted = codes[ids] << (64 - size - (begins & 31)).astype(np.uint64)
    at = begins >> 5
    n = (total + 31 >> 5) + 1
    # Codes do not overlap, so sums are unions; sums below 2**53 are exact in doubles.
    words = np.bincount(at, (shifted >> np.uint64(32)).astype(float), n) + np.bincount(
        at + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(float), n + 1
    )[:n]
    return begins[::INTERVAL].astype("<u4").tobytes(), words.astype(">u4").tobytes()


def decode_block(n: int, checkpoints: bytes, bits: bytes, table: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    """The block's ids; one step decodes the next id after every checkpoint."""
    ids, sizes = table
    out = np.zeros((-(-n // INTERVAL), INTERVAL), np.uint32)
    words = np.concatenate((np.frombuffer(bits, ">u4"), np.zeros(2, ">u4"))).astype(np.uint64)
    wide = (words[:-1] << np.uint64(32)) | words[1:]
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    mask, base = np.uint64((1 << limit) - 1), 64 - limit
    for step in range(min(n, INTERVAL)):
        # Lanes past the last id of the block read zeros behind it.
        at = np.minimum(at, (len(wide) - 1) << 5)
        window = (wide[at >> 5] >> (base - (at & 31)).astype(np.uint64)) & mask
        out[:, step] = ids[window]
        at = at + sizes[window]
    return out.ravel()[:n]
