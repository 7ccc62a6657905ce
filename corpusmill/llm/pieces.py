"""SentencePiece encoding with the original byte span of every piece, and decoding.

Normalisation is done here, by longest prefix through the model's compiled character
map (a double-array trie whose values point into a pool of replacements), and every
normalised byte keeps the original byte range that it stands for.  The library
segments the normalised text, and each piece is projected back to original bytes.

Where no piece of the vocabulary has a word mark after another sign, no piece can
reach over the start of a run of marks, so normalised texts of more than
``SPAN_CHARS`` are handed over span by span, cut there.  Other models get whole texts.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN_CHARS = 1 << 16
MARK = "▁"


class CharacterMap:
    """A compiled character map: size of the trie, its 32-bit units, then zero-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at`` and its replacement."""
        units = self.units
        if not units:
            return None
        found = None
        node = self._children(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = units[node]
            # A unit carries its label in the low byte, and the mark of a value in bit 31.
            if unit & 0x800000FF != raw[i]:
                break
            node ^= self._children(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i - at + 1, self.pool[start : self.pool.index(b"\0", start)])
        return found

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


def _symbol_length(raw: bytes, at: int) -> int:
    lead = raw[at]
    return min(1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4, len(raw) - at)


class PieceModel:
    """A SentencePiece model with offset-preserving encoding."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy_prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.user_symbols = sorted((p.piece for p in proto.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        # The library sees normalised text through a copy of the model that changes nothing itself.
        bare = sentencepiece_model_pb2.ModelProto()
        bare.CopyFrom(proto)
        bare.normalizer_spec.Clear()
        bare.normalizer_spec.name = "identity"
        bare.normalizer_spec.add_dummy_prefix = False
        bare.normalizer_spec.remove_extra_whitespaces = False
        bare.normalizer_spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.only_spaces = not self.map.units and self.escape and not self.squeeze and not self.user_symbols
        self.marks_first = not proto.trainer_spec.treat_whitespace_as_suffix and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
        self.piece_bytes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes and its end the original byte at which it starts.

        Where the map is empty every byte stands for itself and every space becomes a
        mark, for all bytes at once; otherwise sign by sign.
        """
        raw = text.encode("utf-8", "surrogatepass")
        if self.only_spaces:
            if not raw:
                return "", np.zeros(1, np.int64)
            prefix = MARK if self.dummy_prefix else ""
            wide = np.where(np.frombuffer(raw, np.uint8) == 32, len(MARK.encode()), 1)
            starts = np.concatenate((np.zeros(len(prefix.encode()), np.int64), np.repeat(np.arange(len(raw)), wide), [len(raw)]))
            return prefix + text.replace(" ", MARK), starts
        space = MARK.encode() if self.escape else b" "
        out, starts = bytearray(), []

        def put(part: bytes, at: int) -> None:
            out.extend(part)
            starts.extend([at] * len(part))

        at, end = 0, len(raw)
        symbols: list[tuple[bytes, int, int]] = []
        user = [s.encode() for s in self.user_symbols]
        while at < end:
            own = next((u for u in user if raw.startswith(u, at)), None)
            hit = (len(own), own) if own else self.map.longest(raw, at)
            if hit is None:
                size = _symbol_length(raw, at)
                hit = (size, raw[at : at + size])
            symbols.append((hit[1], at, at + hit[0]))
            at += hit[0]
        if self.squeeze:
            while symbols and symbols[0][0].strip(b" ") == b"" :
                symbols.pop(0)
        if not symbols:
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            put(space, symbols[0][1])
        after_space = self.squeeze
        last_end = symbols[-1][2]
        for part, begin, finish in symbols:
            # Bytes that stay as they are stand for themselves; replacements for the whole symbol.
            same = part == raw[begin:finish]
            skip = len(part) - len(part.lstrip(b" ")) if after_space else 0
            part = part[skip:]
            if part:
                for k, byte in enumerate(part):
                    put(space if byte == 32 else bytes([byte]), begin + (skip + k if same else 0))
                after_space = self.squeeze and part.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                last_end = starts[-len(space)]
                del starts[-len(space) :]
        return out.decode("utf-8", "surrogatepass"), np.array([*starts, last_end], np.int64)

    def spans(self, normal: str) -> Iterator[str]:
        """A normalised text in parts that encode as they do within the whole."""
        at = 0
        while self.marks_first and len(normal) - at > SPAN_CHARS:
            cut = normal.rfind(MARK, at + 1, at + SPAN_CHARS)
            while cut > at and normal[cut - 1] == MARK:
                cut -= 1
            if cut <= at:  # no run of marks begins within the span: the next one that does
                cut = at + SPAN_CHARS
                while cut < len(normal) and (normal[cut] != MARK or normal[cut - 1] == MARK):
                    cut += 1
            yield normal[at:cut]
            at = cut
        if at < len(normal):
            yield normal[at:]

    def encode_spans(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """Ids, and where in the original bytes each piece ends; a piece begins where the one before ends."""
        normal, starts = self.normalise(text or "")
        ids: list[int] = []
        for part in self.spans(normal):
            ids += self.bare.encode(part, num_threads=1)
        if self.byte_fallback:  # without it a run of unknown signs is one piece of unknown length
            return ids, starts[np.cumsum(self.piece_bytes[np.array(ids, np.int64)])]
        pieces = self.bare.id_to_piece(ids)
        ends, at, raw = [], 0, normal.encode("utf-8", "surrogatepass")
        for i, piece in zip(ids, pieces, strict=True):
            if self.bare.is_unknown(i):
                at = self._unknown_end(raw, at, ids, pieces, len(ends))
            else:
                at += len(piece.encode())
            ends.append(starts[min(at, len(starts) - 1)])
        return ids, np.array(ends, np.int64)

    def _unknown_end(self, raw: bytes, at: int, ids: list[int], pieces: list[str], k: int) -> int:
        if k + 1 == len(ids):
            return len(raw)
        found = raw.find(pieces[k + 1].encode(), at + 1)
        return found if found >= 0 else at + _symbol_length(raw, at)

    def encode(self, text: str | None) -> tuple[list[int], str, np.ndarray]:
        """Ids, the decoded text, and the end byte of every piece."""
        ids, ends = self.encode_spans(text)
        return ids, self.library.decode(ids) if ids else "", ends


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models.clear()
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, begins, ends, decoded)``: ids and the original byte span of every piece, and the decoded text.

    Null and empty texts have no pieces.  Rows with repeated or null ids are encoded each;
    texts of any length are encoded whole; an empty table gives none; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model)
        for batch in batches:
            rows = [own.encode(text) for text in batch.column(1).to_pylist()]
            ends = [r[2] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(r[0]) for r in rows], pa.int64()),
                    pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                    pa.array([np.concatenate(([0], e[:-1])) if len(e) else e for e in ends], pa.list_(pa.int64())),
                    pa.array(ends, pa.list_(pa.int64())),
                    pa.array([r[1] for r in rows], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "begins", "ends", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids array<int>, begins array<bigint>, ends array<bigint>, decoded string"
    )


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256)`` of ``encode_pieces``, without shipping the pieces.

    ``spans_sha256`` is that of the pieces' end bytes as little-endian 64-bit numbers.
    Nulls, repeated rows, long texts, empty tables and other columns as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model)
        for batch in batches:
            counts, sums = [], ([], [], [])
            for text in batch.column(1).to_pylist():
                ids, decoded, ends = own.encode(text)
                counts.append(len(ids))
                listed = ",".join(map(str, ids)).encode()
                for held, raw in zip(sums, (listed, decoded.encode("utf-8", "surrogatepass"), ends.astype("<i8").tobytes()), strict=True):
                    held.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), *(pa.array(s, pa.string()) for s in sums)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    )
