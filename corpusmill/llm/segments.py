"""Exact tokenization by segments that a tokenizer never joins, each encoded once and remembered.

The tokenizers library encodes the distinct segments; a text is the concatenation of
its segments' ids.  Workers keep the memory between tasks, up to ``MEMORY_BYTES``; tasks of other work
that the same worker gets later give it back (``forget``).
Texts for which a cut is not provably harmless are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np

MEMORY_BYTES = 420 << 20
_ENTRY_BYTES = 190  # a key, its value and their place in the table, without their content

# Latin letters as ASCII and Latin-1 have them, which no normalizer here changes but for their case.
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

# How byte-level tokenizers write bytes: printable Latin-1 as itself, the others from U+0100 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_LETTERS = [chr(b) if b in _PRINTABLE else chr(256 + _OTHERS.index(b)) for b in range(256)]

# A line feed or space that is neither first nor last in its run of white space, or the last of several at the text's end.
_INNER = re.compile(r"\s[ \n](?:\s|\Z)")


class SegmentEncoder:
    """Ids of texts as little-endian unsigned 16-bit numbers (32-bit for large vocabularies)."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in spec["added_tokens"]]
        self.dtype = np.dtype("<u2" if max([self.tokenizer.get_vocab_size(), *self.tokenizer.get_vocab().values()]) < 65536 else "<u4")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.divider = spec["added_tokens"][0] if special and not spec["added_tokens"][0]["lstrip"] else None
        self.cut = _cut_for(spec)
        self.model = self.tokenizer.model
        self.lower = any(step["type"] == "Lowercase" for step in (spec["normalizer"] or {}).get("normalizers", []))
        self.parts: dict[str, bytes] = {}
        self.memory: dict[bytes, bytes] = {}
        self.used = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token, by the library's model on its bytes as it writes them."""
        raw = "".join(map(_BYTE_LETTERS.__getitem__, part.encode()))
        return array(self.dtype.char, [token.id for token in self.model.tokenize(raw)]).tobytes()

    def _simple(self, word: str) -> bytes | None:
        """Ids of Latin letters with a space or line feed before and punctuation after them; None for others.

        Their pre-tokens are plain: the letters, with the space; the line feed; the
        punctuation.  This spares the library's bookkeeping of offsets, and the letters
        are not encoded again where they are remembered without line feed and punctuation.
        """
        match = _PLAIN.fullmatch(word)
        if match is None:
            return None
        before, letters, after = match.groups()
        spaced = " " + letters if before == " " else letters
        ids = self.memory.get(spaced.encode()) if before == "\n" or after else None
        if ids is None:
            ids = self._part(spaced.lower() if self.lower else spaced)
        known = self.parts
        for part in (before, after):
            if part and part not in known:
                known[part] = self._part(part)
        return (known[before] if before == "\n" else b"") + ids + (known[after] if after else b"")

    def _learn(self, missing: Iterable[bytes]) -> None:
        """Encode segments: plain ones by the model, the others in one call, with a special token between them
        that no text around it can join."""
        words = []
        for word in missing:
            ids = self._simple(word.decode())
            if ids is None:
                words.append(word)
            else:
                self.memory[word] = ids
                self.used += len(word) + len(ids) + _ENTRY_BYTES
        for first in range(0, len(words), 20_000):
            part = words[first : first + 20_000]
            if self.divider is None:
                ids = [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)]
            else:
                text = self.divider["content"].join(w.decode() for w in part)
                flat = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
                ends = np.append(np.flatnonzero(flat == self.divider["id"]), len(flat))
                starts = np.concatenate(([0], ends[:-1] + 1))
                ids = [flat[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            self.memory.update(zip(part, ids, strict=True))
            self.used += sum(map(len, part)) + sum(map(len, ids)) + _ENTRY_BYTES * len(part)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or (self.special and self.special.search(text)):
            return self.whole(text)
        segments = self.cut(text)
        if segments is None:
            return self.whole(text)
        memory = self.memory
        try:
            return b"".join(map(memory.__getitem__, segments))
        except KeyError:
            if self.used > MEMORY_BYTES:
                memory.clear()
                self.used = 0
            self._learn(set(segments).difference(memory))
            return b"".join(map(memory.__getitem__, segments))


def _cut_at_white_space(text: str) -> list[bytes]:
    """Words; for tokenizers that drop white space before they look at words."""
    return text.encode().split()


def _cut_before_white_space(text: str) -> list[bytes] | None:
    """Words with the line feed or space before them; for tokenizers that match a text from left to right, where a
    match ends at a run of white space, or before its last sign.  A run at the text's end is one match."""
    if _INNER.search(text):
        return None
    raw = text.encode()
    if b"\0" in raw:
        return None
    segments = raw.replace(b"\n", b"\0\n").replace(b" ", b"\0 ").split(b"\0")
    return segments if segments[0] else segments[1:]


def _cut_for(spec: dict) -> Callable[[str], list[bytes] | None] | None:
    """The cut that is known to be harmless for a tokenizer's normalizer and pre-tokenizer, if any.

    Byte-level with its own pattern and no prefix space: white space opens a match.
    A normalizer that collapses white space and a pattern whose matches never
    contain any: white space can go.
    """
    normalizer, pre = spec["normalizer"], spec["pre_tokenizer"] or {}
    if normalizer is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return _cut_before_white_space
    if pre.get("type") == "Sequence" and (normalizer or {}).get("type") == "Sequence":
        split, levels = pre["pretokenizers"][0], pre["pretokenizers"][1:]
        steps = [step["type"] for step in normalizer["normalizers"]]
        if (
            split["type"] == "Split"
            and split["behavior"] == "Removed"
            and split["invert"]
            and not re.search(r"\\[sS]|\s", split["pattern"]["Regex"].replace(r"[^\s", "[^"))
            and all(level["type"] == "ByteLevel" and not level["use_regex"] and not level["add_prefix_space"] for level in levels)
            and set(steps) <= {"NFC", "Replace", "Lowercase"}
            and all(s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in normalizer["normalizers"] if s["type"] == "Replace")
        ):
            return _cut_at_white_space
    return None


_encoders: dict[str, SegmentEncoder] = {}


def forget() -> None:
    """Give back the memory of this worker's encoder; for tasks of other work, which hold much themselves."""
    _encoders.clear()


def encoder(path: str) -> SegmentEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = SegmentEncoder(path)
    return _encoders[path]
