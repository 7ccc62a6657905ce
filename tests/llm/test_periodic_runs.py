"""Periodic runs against a plain search of all periods."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from corpusmill.llm import periodic_runs  # noqa: E402


def _brute(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            smaller = any(q % d == 0 and all(words[k] == words[k + d] for k in range(s, s + length - d)) for d in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _random_text(rng):
    some = lambda signs, n: [rng.choice(signs) for _ in range(n)]
    kind = rng.randrange(9)
    if kind < 3:
        words = some(["ab", "abc", [str(n) for n in range(50)]][kind], rng.randrange(80))
    elif kind == 3:
        words = ["a"] * rng.randrange(200)
    elif kind == 4:
        block = some("abcd", rng.randrange(1, 12))
        words = some("abcd", rng.randrange(20)) + block * rng.randrange(1, 9) + block[: rng.randrange(len(block))] + some("abcd", rng.randrange(20))
    elif kind == 5:
        words = (["a"] * rng.randrange(1, 9) + ["b"]) * rng.randrange(1, 12)
    elif kind == 6:
        x, y = "a", "ab"
        for _ in range(rng.randrange(9)):
            x, y = y, y + x
        words = list(y)
    elif kind == 7:
        words = (some("ab", 3) * 5 + ["x"]) * 5
    else:
        block = some("abcdefgh", 40)
        words = (block * 2 + some("xy", 3)) * rng.randrange(1, 5) + block * 5
    return rng.choice([" ", "\n", " \t"]).join(words)


def test_runs_by_brute_force():
    rng = random.Random(11)
    texts = [_random_text(rng) for _ in range(2500)] + ["", None, "  ", "a\x1ca\x1ca", "é é é é é é", "A a A a A a A a"]
    for text, (n, runs, kept) in zip(texts, periodic_runs.text_runs(texts), strict=True):
        words = [w for w in re.split("[ \t-\r]+", text or "") if w]
        assert (n, runs) == (len(words), _brute(words)), text
        assert kept.decode() == _collapsed(words, runs)


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(12)
    texts = [_random_text(rng) for _ in range(200)]
    whole = list(periodic_runs.text_runs(texts))
    assert whole == [r for t in texts for r in periodic_runs.text_runs([t])]


def test_long_texts():
    rng = random.Random(13)
    morse = [0]
    while len(morse) < 1 << 14:
        morse += [1 - x for x in morse]
    # Without cubes there is no run; prefix sums cannot tell some of its halves apart.
    (_, runs, _), = periodic_runs.text_runs([" ".join(map(str, morse))])
    assert runs == []
    block = [f"w{rng.randrange(10**6)}" for _ in range(9000)]
    words = block[:77] + block * 5 + ["end"] + ["a"] * 50_000 + ["x", "y"] * 3000
    (n, runs, kept), = periodic_runs.text_runs([" ".join(words)])
    edge = 77 + 45_000 + 1
    assert n == len(words) and runs == [(77, 45_000, 9000), (edge, 50_000, 1), (edge + 50_000, 6000, 2)]
    assert kept.decode() == " ".join([*block[:77], *block, "end", "a", "x", "y"])


def test_sums_that_collide_are_settled_word_by_word(monkeypatch):
    """With sums that call everything equal, candidates are still compared word by word."""
    monkeypatch.setattr(periodic_runs.Words, "same", lambda self, left, right, size: np.ones(len(left), bool))
    words = ["a", "b"] * 6 + ["c", "a"] + ["d"] * 9
    for _, runs, _ in periodic_runs.text_runs([" ".join(words)]):
        assert set(runs) <= set(_brute(words))


def _digests(key, text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(key).encode())
    g = h // 10
    if key is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(_collapsed(words, runs)))


def test_digests_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    rng = random.Random(14)
    more = spark.createDataFrame([(10_000 + i, _random_text(rng)) for i in range(300)] + [(None, "a " * 9), (0, None), (0, "a " * 9)], "doc_id bigint, text string")
    frame = docs.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit("x") for c in ("start", "runs", "n_words", "period")})
    texts = frame.select("doc_id", "text").collect()
    key = lambda row: tuple((v is not None, v) for v in row)
    got = sorted((tuple(r) for r in periodic_runs.run_digests(frame).collect()), key=key)
    expected = sorted(((r.doc_id, *_digests(r.doc_id, r.text)) for r in texts), key=key)
    assert got == expected and sum(r[1] > 0 for r in got if r[0] and r[0] < 10_000) > 5


@pytest.mark.parametrize("job", [periodic_runs.find_runs, periodic_runs.run_digests])
def test_empty_and_plain_rows(spark, job):
    frame = spark.createDataFrame([(1, "x " + "a b " * 4 + "c"), (1, "x"), (None, None)], "doc_id bigint, text string")
    assert job(frame).count() == 3 and job(frame.limit(0)).count() == 0
    rows = {r.n_words: r for r in periodic_runs.find_runs(frame).collect()}
    assert rows[10].collapsed == "x a b c" and [tuple(r) for r in rows[10].runs] == [(1, 8, 2)] and rows[0].runs == []
