"""The language-model operators against brute force, exact round trips and held-out labels."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from corpusmill.llm import (  # noqa: E402
    embedding_dedup, huffman, ngram_join, packing, pieces, quality_classifier, quality_rules, quotes, segments, shingles, token_counts, toxicity,
)

SMALL, MEDIUM, LARGE = (f"/root/testdata/sf{s}" for s in ("0.001", "0.01", "0.1"))
ODD = [
    "", " ", "a  b", "a   b\n\n c", "x  b  c", " lead", "trail ", "a\n b", "a \nb", "a \n \nb", "<|endoftext|>x y<|endoftext|>",
    "it's don't I'LL", "é é combining", "ΑΣ ΣΑΣ", "a\x1cb #\x1c#", "\x00a b", "tab\tx \t y", "👍🏽 ok", " wide  x", "a\r\nb",
    "12 345,6.7%", " \n", "x▁y ▁ z", "日本 語 テ", "<s> </s> <unk> <0x0A> x", "word " * 3000, "long" * 3000,
]


@pytest.fixture(scope="module")
def session(spark):
    from corpusmill.session import ship_code

    ship_code(spark, entry.ROOT)
    return spark


@pytest.fixture(scope="module")
def odd_docs(session):
    """Odd texts, nulls, a repeated row, and extra columns whose names the operators use themselves."""
    rows = [(i, text) for i, text in enumerate(ODD)] + [(100, None), (None, "no id"), (0, "")]
    frame = session.createDataFrame(rows, "doc_id bigint, text string")
    extras = {c: F.lit("x") for c in ("id", "node", "n", "ids", "score", "length", "part", "sig", "y", "piece", "lang", "source")}
    return frame.withColumns(extras)


@pytest.fixture(scope="module")
def labels(session):
    return session.read.parquet(f"{LARGE}/labels.parquet")


def _texts(session, folder, table="documents"):
    return {r.doc_id: r.text for r in session.read.parquet(f"{folder}/{table}.parquet").select("doc_id", "text").collect()}


def _roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# 1

def test_token_counts_by_brute_force():
    costs = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    counter = token_counts.PrefixCounter(costs)
    raws = {piece.encode(): cost for piece, cost in costs.items()}

    def brute(word):
        best = [(0, 0)]
        for i in range(1, len(word) + 1):
            ways = [(best[i - 1][0] + counter.fallback, best[i - 1][1] + 1)]
            ways += [(best[k][0] + raws[word[k:i]], best[k][1] + 1) for k in range(max(0, i - counter.longest), i) if word[k:i] in raws]
            best.append(min(ways))
        return best[-1][1]

    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("thereandion") for _ in range(rng.randint(1, 20))) for _ in range(400)]
    words = [w.encode() for w in [*words, *words[:9], "▁日本👍", "", "a" * 300]]
    assert counter.counts(words).tolist() == [brute(w) for w in words]


def test_token_counts_rows(odd_docs):
    rows = token_counts.count_tokens(odd_docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(ODD) + 3
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[0].n_tokens, by_id[100].n_tokens) == (0, 0)
    assert by_id[25].n_pretokens == 3000 and by_id[25].n_distinct == 1
    assert token_counts.count_tokens(odd_docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_long_pre_tokens_by_brute_force():
    costs = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    costs = {piece: cost for piece, cost in costs.items() if "▁" not in piece[1:]}
    counter = token_counts.PrefixCounter(costs)
    raws = {piece.encode(): cost for piece, cost in costs.items()}

    def brute(word):
        best = [(0, 0)]
        for i in range(1, len(word) + 1):
            ways = [(best[i - 1][0] + counter.fallback, best[i - 1][1] + 1)]
            ways += [(best[k][0] + raws[word[k:i]], best[k][1] + 1) for k in range(max(0, i - counter.longest), i) if word[k:i] in raws]
            best.append(min(ways))
        return best[-1][1]

    rng, block = random.Random(4), 1 << 16
    kinds = ["日本語中文的是不了人我在有他这", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/", "thereandionfunctionreturn(){};=.,", "ภาษาไทยก👍é"]
    words = []
    for size in (2_049, 3_000, 50_000, block + 5):
        for kind in kinds:
            words.append("".join(rng.choice(kind) for _ in range(size)).encode()[:size].decode(errors="ignore").encode())
    # Lengths at the edges of the blocks; the mark has three bytes.
    words += [(b"international" * 6_000)[: block - 3 + k] for k in (-1, 0, 1)]
    mark = "▁".encode()
    assert token_counts._token_counts(counter, words, mark) == [brute(mark + w) for w in words]
    # More tokens than the 20 low bits of the trie's scores hold.
    assert token_counts._token_counts(counter, [b"\x01" * 1_100_000], mark) == [brute(mark) + 1_100_000]


# 2

def _shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def _brute_components(texts):
    sets = {i: _shingles(t) for i, t in texts.items()}
    where, links = defaultdict(list), []
    for i, own in sets.items():
        for j, common in Counter(j for s in own for j in where[s]).items():
            if 100 * common >= 75 * (len(own) + len(sets[j]) - common):
                links.append((i, j))
        for s in own:
            where[s].append(i)
    return {i: (len(sets[i]), root) for i, root in _roots(sets, links).items()}


def test_ngram_join_by_brute_force(session):
    rng = random.Random(5)
    texts = {2 * i: t for i, t in enumerate(_texts(session, SMALL).values())}
    for group in range(6):
        # Groups of near copies around the threshold, copies, and passages shared by otherwise different texts.
        size = [3, 7, 12, 30, 120, 400][group]
        base = [f"w{rng.randrange(9999)}" for _ in range(size)]
        for k in range(25):
            words = list(base)
            for _ in range(k // 3):
                words[rng.randrange(size)] = f"x{rng.randrange(9999)}"
            texts[100_001 + 100 * group + k] = " ".join(words)
        for k in range(15):
            texts[200_001 + 100 * group + k] = " ".join([*base, *(f"y{rng.randrange(99999)}" for _ in range(size // 2 + 3 * k))])
    texts |= {300_001: "", 300_002: None, 300_003: " \n ", 300_004: "one", 300_005: "ONE ", 300_006: "a a a a a a a a a"}
    frame = session.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("node", F.lit(1))
    rows = ngram_join.ngram_join(frame).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == _brute_components(texts)
    assert len(rows) == len(texts)


def test_ngram_join_odd(odd_docs):
    rows = ngram_join.ngram_join(odd_docs).collect()
    assert sorted(r.doc_id for r in rows) == [*range(len(ODD)), 100]
    assert ngram_join.ngram_join(odd_docs.limit(0)).count() == 0


def test_posts_of_many_sets_at_once():
    """Posts of a group by their definition, set by set and segment by segment; batches that do not follow the input's."""
    rng, mixed = np.random.default_rng(8), lambda n: int(shingles.mix(np.array([n % 2**64], np.uint64))[0])
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (1, 2, 3, 5, 8, 13, 40, 41, 53, 54, 700, 3000)]
    with np.errstate(over="ignore"):
        layout = ngram_join.Layout(sets)
        signatures, tags, of = layout.posts()
        rooms = layout.rooms()
    wanted = []
    for i, u in enumerate(sets):
        own = ngram_join.band_of(len(u))
        for band in [own, own - 1] if own and 4 * int(ngram_join._TOPS[own - 1]) >= 3 * len(u) else [own]:
            m, doubled = ngram_join.plan_of(band)
            cells, room = defaultdict(list), 0
            for x in map(int, u):
                cells[(x >> 20) % m].append(mixed(x + 0x5851F42D4C957F2D))
            for segment, values in cells.items():
                place, tag = mixed((band << 40) + segment + 1), 4 * segment + (band != own)
                room += 1
                wanted.append((mixed(sum(values) + place), tag, i))
                if segment < doubled and len(values) > 1:
                    room += 1
                    wanted += [(mixed(sum(values) - v + place), tag + 2, i) for v in values]
            assert rooms[band != own][i] == room
    assert sorted(zip(map(int, signatures), map(int, tags), map(int, of))) == sorted(wanted)
    texts = [None, "", *(f"a b c d e f{i % 1500}" for i in range(2000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    profiles = list(ngram_join._profiles(iter([batch])))
    assert max(b.num_rows for b in profiles) <= 512 and [i for b in profiles for i in b.column(0).to_pylist()] == [*range(len(texts))]
    assert [b.column(1).to_pylist() for b in profiles][0][:3] == [0, 0, 2] and profiles[0].column(6).to_pylist()[:2] == [None, None]
    posts = list(ngram_join._posts(iter([batch.select([1])])))
    assert len(posts) > 1 and len({n for b in posts for n in b.column(1).to_pylist()}) == 1500


def test_other_work_gives_back_the_encoder():
    """What a worker remembered of a tokenizer's words is not kept beside the join's own memory."""
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["a b c d e f"])], names=["id", "text"])
    for task in (ngram_join._profiles, lambda batches: ngram_join._posts(b.select([1]) for b in batches)):
        segments.encoder(public_tokenizers.path("word_bpe_49k.json")).encode("some words to remember")
        assert len(list(task(iter([batch])))) == 1
        assert not segments._encoders


def test_short_of_room_is_exact(session, monkeypatch):
    """Sets that cannot reach the sum are compared with their whole band."""
    monkeypatch.setattr(ngram_join, "plan_of", lambda band: (1, 0))
    texts = {i: " ".join(f"w{j}" for j in range(i, i + 40)) for i in range(0, 12)}
    frame = session.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = ngram_join.ngram_join(frame).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == _brute_components(texts)


# 3

@pytest.mark.parametrize("n, limit", [(1, 16), (2, 16), (50, 6), (3000, 13)])
def test_huffman_round_trip(n, limit):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.7, n) * 3 + 1).astype(np.int64)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    for size in (1, 127, 128, 129, 5000):
        ids = rng.choice(n, size, p=counts / counts.sum()).astype(np.uint16)
        checkpoints, bits = huffman.encode_block(ids, huffman.canonical_codes(lengths), lengths)
        assert (huffman.decode_block(size, checkpoints, bits, huffman.decode_table(lengths, limit), limit) == ids).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segments_equal_the_library(session, name):
    own = segments.SegmentEncoder(public_tokenizers.path(name))
    library = Tokenizer.from_file(public_tokenizers.path(name))
    for text in ODD + list(_texts(session, SMALL).values())[:100]:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_white_space_at_the_end_equals_the_library(name):
    own = segments.SegmentEncoder(public_tokenizers.path(name))
    library = Tokenizer.from_file(public_tokenizers.path(name))
    signs = ["\n", " ", "\t", "\r", "\xa0"]
    for text in [a + b + c + d for a in ("", "x", "ab cd.", "x\n\ny") for b in ["", *signs] for c in signs for d in signs]:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_letters_are_encoded_once():
    """A word with a line feed or punctuation takes the ids of the same word without them."""
    encode = segments.SegmentEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked, part = [], encode._part
    encode._part = lambda text: asked.append(text) or part(text)
    texts = ["Caña", "\nCaña", "a casa", "a casa,", "b casa; Caña!\ncasa", " casa,\n casa"]
    assert [encode.encode(text) for text in texts] == [encode.whole(text) for text in texts]
    assert asked.count(" casa") == 1 and asked.count("Caña") == 1


def test_token_files(session, odd_docs, tmp_path):
    from corpusmill.llm import token_files

    folder = f"{tmp_path}/ids"
    token_files.write_ids(odd_docs, public_tokenizers.path("byte_bpe_50k.json"), folder, block_ids=500)
    rows = token_files.read_ids(session, folder).orderBy("start").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda k: -1 if k is None else k)
    by_id = {i: t for i, t in enumerate(ODD)} | {100: "", None: "no id"}
    assert len(rows) == len(ODD) + 3
    for r in rows:
        ids = [*library.encode(by_id[r.doc_id], add_special_tokens=False).ids, 2]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids), r.ids_crc32) == (start, len(ids), raw, zlib.crc32(raw))
        start += len(ids)
    empty = f"{tmp_path}/empty"
    token_files.write_ids(odd_docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), empty)
    assert token_files.read_ids(session, empty).count() == 0


# 4

def test_pieces_equal_the_library(session, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + list(_texts(session, SMALL).values())[:100]
    spans = {}
    for size in (pieces.SPAN_CHARS, 300, 7):
        monkeypatch.setattr(pieces, "SPAN_CHARS", size)
        for text in texts:
            ids, decoded, ends = own.encode(text)
            expected = library.encode(text)
            assert ids == expected and decoded == library.decode(expected), (size, text[:80])
            assert not len(ends) or ends[-1] == len(text.encode())
            assert spans.setdefault(text, ends.tolist()) == ends.tolist()
    # Every piece's bytes, with marks for spaces, are the piece.
    for text, ends in spans.items():
        raw, begin = text.encode(), 0
        for i, end in zip(library.encode(text), ends):
            if not library.is_byte(i) and begin:
                assert raw[begin:end].decode().replace(" ", pieces.MARK) == library.id_to_piece(i)
            begin = end


def test_normalising_sign_by_sign_agrees(session):
    """The general way, taken by models with a character map, on a model that changes spaces alone."""
    own = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ODD[:25] + list(_texts(session, SMALL).values())[:5]:
        own.only_spaces = True
        fast, starts = own.normalise(text)
        own.only_spaces = False
        slow, slow_starts = own.normalise(text)
        assert (fast, starts.tolist()) == (slow, slow_starts.tolist())


def test_marks_in_the_text_equal_the_library(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = ["▁ ", " ▁", "▁", "▁▁ a", "a ▁ b"] + ["".join(rng.choices(["▁", " ", "a", "the", "é", "\n", "日"], k=rng.randrange(12))) for _ in range(4000)]
    for size in (1 << 16, 2):
        monkeypatch.setattr(pieces, "SPAN_CHARS", size)
        for text in texts:
            ids, decoded, ends = own.encode(text)
            assert ids == library.encode(text) and decoded == library.decode(ids), repr(text)
            assert not len(ends) or ends[-1] == len(text.encode())


def test_character_map():
    """Longest prefix through a hand-made double array: keys ``a`` to ``x`` and ``ab`` to ``yz``."""
    # Root at 0 with offset 256; a child's unit is at parent offset XOR label, a value at node offset XOR 0.
    units = [0] * 1024
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | (a ^ 512) << 10
    units[512] = 0x80000000
    b = 512 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | (b ^ 768) << 10
    units[768] = 0x80000000 | 2
    blob = (len(units) * 4).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"x\0yz\0"
    table = pieces.CharacterMap(blob)
    assert table.longest(b"abc", 0) == (2, b"yz")
    assert table.longest(b"acb", 0) == (1, b"x")
    assert table.longest(b"cab", 0) is None
    assert pieces.CharacterMap(b"").longest(b"a", 0) is None


def test_piece_tables(odd_docs):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r.doc_id: r for r in pieces.encode_pieces(odd_docs, model).collect()}
    sums = {r.doc_id: r for r in pieces.piece_digests(odd_docs, model).collect()}
    for key, row in rows.items():
        assert sums[key].n_tokens == row.n_tokens == len(row.ids) == len(row.begins) == len(row.ends)
        assert sums[key].ids_sha256 == hashlib.sha256(",".join(map(str, row.ids)).encode()).hexdigest()
        assert sums[key].decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
    assert rows[100].ids == [] and pieces.encode_pieces(odd_docs.limit(0), model).count() == 0


# 5

def test_quality_rules_by_sql(session, odd_docs):
    connection = duckdb.connect()
    lines = ["Good words here, and more.", "Home | About | News | Contact", "!!! BUY!! NOW!! IT!! IS!! HERE!!", "a## b$$ c%%", "All Rights Reserved.", "", "  "]
    rng = random.Random(1)
    texts = [t for t in ODD if "\0" not in t] + ["\n".join(rng.choices(lines, k=rng.randint(1, 40))) for _ in range(60)] + [" ".join(["tok"] * 60), "A b c d. " * 30]
    rows = list(enumerate([*texts, None]))
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    expected = sorted(connection.execute(quality_rules.SQL.replace("{table}", "documents")).fetchall())
    got = quality_rules.judge_documents(session.createDataFrame(rows, "doc_id bigint, text string"), with_text=False)
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert quality_rules.judge_documents(odd_docs).count() == len(ODD) + 3
    assert quality_rules.judge_documents(odd_docs.limit(0)).count() == 0


def test_quality_rules_clean_text(session):
    text = "A line that stays.\nHome | About | News | Contact\nA line that stays.\n\nLast one."
    row = quality_rules.judge_documents(session.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.clean_text == "A line that stays.\n\nLast one." and row.n_dup_lines == 1


# 6 and 8

@pytest.mark.parametrize("score, label, least", [(toxicity.score_toxicity, "toxic", 0.97), (quality_classifier.score_quality, "quality", 0.97)])
def test_held_out_accuracy(session, labels, odd_docs, score, label, least):
    docs = session.read.parquet(f"{LARGE}/documents.parquet")
    rows = {r.doc_id: r for r in score(docs, labels).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect()}
    for key, row in rows.items():
        assert row.held_out == (zlib.crc32(str(key).encode()) % 4 == 2) and 0 <= row.score <= 1
    held = [rows[k].predicted == y for k, y in truth.items() if rows[k].held_out]
    assert sum(held) >= least * len(held)
    # Labels of the held-out fold change nothing.
    held_fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn(label, F.when(held_fold, 1 - F.col(label)).otherwise(F.col(label)))
    few = docs.where("doc_id < 50")
    first, second = ({r.doc_id: r.score for r in score(few, x).collect()} for x in (labels, turned))
    assert first == second
    assert score(odd_docs, labels).count() == len(ODD) + 3
    assert score(odd_docs, labels.limit(0)).count() == len(ODD) + 3
    assert score(odd_docs.limit(0), labels).count() == 0


def _brute_score(text, table, constant):
    """A text's probability from single grams, each hashed by itself."""
    raw, q = (text or "").encode(), quality_classifier
    golden, mixed = 0x9E3779B97F4A7C15, lambda n: int(shingles.mix(np.array([n % 2**64], np.uint64))[0])
    bucket = lambda n, kind: (n % 2**64 >> (64 - q.BUCKET_BITS)) + (kind << q.BUCKET_BITS)
    words = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
    named = [int(shingles.word_hashes([w], lower=False)[0][0]) for w in words]
    pairs = [1 << q.BUCKET_BITS if a == b else bucket(mixed(a * 3 + b), 1) for a, b in zip(named, named[1:])]
    fours = [bucket(mixed(int.from_bytes(raw[i : i + 4], "little")), 2) for i in range(len(raw) - 3)]
    shape = [int(q._SHAPE[c]) for c in raw]
    threes = [bucket((shape[i] << 14 | shape[i + 1] << 7 | shape[i + 2]) * golden, 3) for i in range(len(raw) - 2)]
    mean = sum(sum(int(table[i]) for i in ids) / len(ids) for ids in ([bucket(n, 0) for n in named], pairs, fours, threes) if ids)
    return 1 / (1 + np.exp(-(mean / (q.KINDS * q.SCALE) + constant)))


def test_quality_scores_by_brute_force(session, odd_docs):
    rng = np.random.default_rng(8)
    table, constant = quality_classifier.fixed_point(rng.normal(size=quality_classifier.BUCKETS)), 0.25
    texts = [*ODD[:25], None, "abc", "xyz", *list(_texts(session, SMALL).values())[:20], "", None, "  "]
    expected = [_brute_score(t, table, constant) for t in texts]
    assert np.allclose(quality_classifier._scores(texts, table, constant), expected, rtol=1e-12)
    for blank in ("", None, " \n"):
        for beside in ([blank], [blank, "hello world"], ["hello world", blank], [blank, "x", blank]):
            got = quality_classifier._scores(beside, table, constant)
            assert got.tolist() == [quality_classifier._scores([t], table, constant)[0] for t in beside]


def test_quality_scores_follow_the_text_alone(session):
    docs = session.read.parquet(f"{SMALL}/documents.parquet").unionByName(
        session.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, " ")], "doc_id bigint, text string"), allowMissingColumns=True
    )
    labels = session.read.parquet(f"{SMALL}/labels.parquet")
    one = {r.doc_id: r.score for r in quality_classifier.score_quality(docs.orderBy(F.xxhash64("doc_id")).coalesce(1), labels).collect()}
    many = {r.doc_id: r.score for r in quality_classifier.score_quality(docs.repartition(8, "text"), labels).collect()}
    assert one == many and one[10**6] == one[10**6 + 1]


def test_grammar():
    lexicon = toxicity._base_lexicon()
    weigh = lambda text: next(toxicity.clause_weights([text], lexicon))
    plain, = weigh("that is an idiot thing")
    aimed, = weigh("you idiot")
    negated, = weigh("it is not idiot talk")
    told, = weigh("he said idiot words")
    threat, = weigh("I will kill you")
    assert weigh("he said you idiot")[0] > told and weigh("John said idiot words")[0] == told
    assert aimed > plain > told > 0 and plain > negated > 0 and threat > weigh("I will kill time")[0]
    assert weigh("Nice words. Kind people") == [] and len(weigh("idiot. fine. moron!")) == 2


def _plain_weight(symbols):
    """A clause's weight by looking back from each insult, threat and target."""
    total, t = 0.0, toxicity
    for i, symbol in enumerate(symbols):
        near = lambda kind, reach: kind in symbols[max(0, i - reach) : i]  # noqa: E731, B023
        last = next((k for k in range(i - 1, -1, -1) if symbols[k] in (t.TARGET, t.INSULT, t.THREAT, t.REPORT)), None)
        close = symbols[last] if last is not None and i - last <= 3 else None
        if symbol in (t.INSULT, t.THREAT):
            total += (1.0 if symbol == t.INSULT else 0.2) - 0.4 * near(t.NEGATION, 3) - 0.3 * near(t.REPORT, 5)
        total += 0.3 * (symbol == t.INSULT and close == t.TARGET) + 0.8 * (symbol == t.TARGET and close == t.THREAT)
    return total


def test_grammar_by_brute_force():
    words = {toxicity.INSULT: "idiot", toxicity.THREAT: "kill", toxicity.TARGET: "you", toxicity.NEGATION: "not", toxicity.REPORT: "said", toxicity.OTHER: "thing"}
    lexicon, rng = toxicity._base_lexicon(), random.Random(6)
    clauses = [rng.choices(list(words), [2, 2, 3, 2, 2, 4], k=rng.randrange(1, 14)) for _ in range(800)]
    clauses = [c for c in clauses if toxicity.INSULT in c or toxicity.THREAT in c]
    found = list(toxicity.clause_weights([" ".join(words[s] for s in c) for c in clauses], lexicon))
    assert np.allclose([f[0] for f in found], [_plain_weight(c) for c in clauses])


# 7

def _brute_vectors(rows, cosine=0.95):
    usable = {k: np.array(v, float) for k, v in rows.items() if v is not None and len(v) == 8 and None not in v}
    usable = {k: v / np.sqrt((v * v).sum()) for k, v in usable.items() if np.isfinite(v).all() and v.any()}
    links = [(a, b) for a in usable for b in usable if a < b and float(usable[a] @ usable[b]) >= cosine]
    degree = Counter(x for link in links for x in link)
    return {k: (degree[k], root) for k, root in _roots(rows, links).items()}


@pytest.mark.parametrize("tile_rows", [4096, 7])
def test_embeddings_by_brute_force(session, tile_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = {k: (centres[k % 6] + rng.normal(size=8) * rng.choice([0, 0.1, 0.3, 1.0])).astype(np.float32).tolist() for k in range(150)}
    rows |= {200: None, 201: [0.0] * 8, 202: [1.0] * 7 + [None], 203: [float("nan")] + [1.0] * 7, 204: [1.0, 2.0], 205: [], 206: [float("inf")] * 8}
    frame = session.createDataFrame([(k, v, "x") for k, v in rows.items()], "vec_id bigint, embedding array<float>, node string")
    got = embedding_dedup.link_embeddings(frame, tile_rows=tile_rows).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == _brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(rows)


def test_embeddings_of_several_widths(session):
    rng = np.random.default_rng(3)
    wide, slim = rng.normal(size=8), rng.normal(size=4)
    rows = {k: (wide + rng.normal(size=8) * 0.01).tolist() for k in range(9)}
    # Near pairs, copies and a lone vector of rarer widths; zero vectors of another.
    rows |= {20 + k: (slim + rng.normal(size=4) * 0.01).tolist() for k in range(3)} | {30: [1.0, 2.0], 31: [1.0, 2.0], 32: [3.0], 33: [0.0] * 3, 34: [0.0] * 3}
    frame = session.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_embeddings(frame).collect()}
    expected = {k: (8, 0, k == 0) for k in range(9)} | {k: (2, 20, k == 20) for k in (20, 21, 22)} | {30: (1, 30, True), 31: (1, 30, False)}
    assert got == expected | {k: (0, k, True) for k in (32, 33, 34)}


def test_embeddings_empty(session):
    frame = session.createDataFrame([(1, None), (None, [1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in embedding_dedup.link_embeddings(frame).collect()] == [(1, 0, 1, True)]
    assert embedding_dedup.link_embeddings(frame.limit(0)).count() == 0


# 9

def _check_packing(rows, texts, capacity):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for key, own in by_doc.items():
        ids = np.array([*library.encode(texts[key] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, capacity * k)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + capacity].tobytes()) and r.length == len(ids[r.start : r.start + capacity])
        assert len(own) == -(-len(ids) // capacity)
    for own in by_sequence.values():
        place = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_packing(session, odd_docs):
    docs = session.read.parquet(f"{MEDIUM}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    used, bound = _check_packing(packing.pack(docs, path).collect(), _texts(session, MEDIUM), 2048)
    assert used <= 1.01 * bound + 1
    one_each = odd_docs.where("doc_id > 0")
    _check_packing(packing.pack(one_each, path, capacity=64).collect(), {i: t for i, t in enumerate(ODD) if i} | {100: ""}, 64)
    assert packing.pack(odd_docs, path, with_ids=True).where("ids IS NULL").count() == 0
    assert packing.pack(odd_docs.limit(0), path).count() == 0


def test_plan_covers_every_count():
    rng, block = random.Random(4), 1 << 16
    for capacity in (10, 64, 300):
        counts = {n: rng.randrange(1, 50) for n in rng.sample(range(1, capacity + 1), min(capacity, 40))}
        plan = packing.plan_sequences(counts, capacity, rounds=40)
        covered = Counter()
        for configuration, times in plan:
            assert sum(n * k for n, k in configuration) <= capacity
            for n, k in configuration:
                covered[n] += k * times
        assert covered == counts
    assert packing.plan_sequences({}, 10) == []


def test_program_places_the_pieces(session):
    docs = session.read.parquet(f"{MEDIUM}/documents.parquet")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    real = {row.length: row["count"] for row in pieces.groupBy("length").count().collect()}
    rng = random.Random(5)
    for counts in (real, {n: 1000 * k for n, k in real.items()}, Counter(rng.randrange(200, 1200) for _ in range(3000))):
        program = packing.configuration_program(counts, 2048)
        covered = Counter()
        for configuration, times in program.items():
            for n, k in configuration:
                covered[n] += k * times
        assert all(covered[n] <= counts[n] for n in covered)
        assert covered.total() >= 0.9 * sum(counts.values())
        sequences = sum(times for _, times in packing.plan_sequences(counts, 2048))
        assert sequences <= 1.002 * -(-sum(n * k for n, k in counts.items()) // 2048) + 1
        assert sequences <= sum(packing.best_fit(counts, 2048, Counter()).values())
    # Two lengths that fill a sequence only as three and one: the longest pieces first would need more.
    assert sum(times for _, times in packing.plan_sequences({6: 30, 4: 60, 2: 30}, 10)) == 48


# 10

def test_quotes_by_sql(session):
    rows = [
        (1, 0, "user", "Hello there\nsecond line"), (1, 1, "assistant", "> hello  THERE\nhi"), (1, 2, "user", "> second line\nwhat"),
        (1, 3, "assistant", ">> hello there\n> hi\nyes"), (1, 4, "user", "no quote"), (1, 5, "x", "> what\nok"),
        (1, 6, "x", "> ok\n> > nested what\n >spaced\ndeep"), (2, 0, None, None), (2, 3, "u", "> unknown\n"), (2, 3, "u", "> unknown\n"),
        (None, 1, "a", "b"), (3, None, "a", "b"), (3, 7, "u", "> self\nself"),
        (4, 0, "u", "ok"), (4, 1, "a", "好的\nlong one"), (4, 2, "u", "> ok\nfine"), (4, 3, "a", "> 好的\n>\n> \nsure"), (4, 4, "u", "x" * 70_000 + "\n> ok"),
    ]
    frame = session.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    result = quotes.link_conversations(frame.withColumn("depth", F.lit(1)))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    expected = connection.execute(quotes.SQL)
    assert [c[0] for c in expected.description] == result.columns
    assert sorted(map(repr, (tuple(r) for r in result.collect()))) == sorted(map(repr, expected.fetchall()))
    assert quotes.link_conversations(frame.limit(0)).count() == 0


# pipeline

def _pipeline_by_brute_force(session, docs, folder):
    """Texts by id after each stage but the last, from the operators' rows and from brute force."""
    labels = session.read.parquet(f"{folder}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id: texts[r.doc_id] for r in quality_classifier.score_quality(docs, labels).where("predicted = 1").collect()}
    judged = {r.doc_id: r.clean_text for r in quality_rules.judge_documents(docs).where("kept").collect()}
    clean = {i: judged[i] for i in good if i in judged}
    return [good, clean, {i: clean[i] for i, (_, root) in _brute_components(clean).items() if i == root}]


def test_pipeline_by_brute_force(session):
    docs = session.read.parquet(f"{SMALL}/documents.parquet")
    stage, frames = docs, []
    for _, step in corpus_pipeline.STAGES[:-1]:
        stage = step(session, stage, SMALL)
        assert stage.columns == docs.columns
        rows = stage.collect()
        frames.append({r.doc_id: r.text for r in rows})
        assert all(r.n_chars == len(r.text) for r in rows) or not frames[1:]
    expected = _pipeline_by_brute_force(session, docs, SMALL)
    assert frames == expected and any(text != expected[0][i] for i, text in expected[1].items())
    used, bound = _check_packing(corpus_pipeline.run(session, SMALL).collect(), expected[-1], 2048)
    assert bound <= used <= bound + 2


def test_pipeline_keeps_odd_rows_whole(session, odd_docs):
    """Odd rows beside good ones: nulls, blanks, a text of 3000 words, repeats, rows without an id."""
    good = [t for t in _texts(session, SMALL).values() if len(t.split()) > 80][:20]
    extra = session.createDataFrame([(1000 + i, t) for i, t in enumerate(good)] + [(1000, good[0]), (None, good[1])], "doc_id bigint, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    stage = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(session, odd_docs.limit(0), SMALL).count() == 0
        before = Counter((r.doc_id, r.lang) for r in stage.collect())
        stage = step(session, stage, SMALL)
        rows = stage.collect()
        assert stage.columns == docs.columns, name
        after = Counter((r.doc_id, r.lang) for r in rows)
        assert after <= before, name
    # Both rows of the repeated id share the verdict; the row without an id stays in every stage that its text passes.
    kept = Counter(r.doc_id for r in rows)
    passes = {r.doc_id for r in quality_rules.judge_documents(docs).where("kept").collect()}
    assert set(kept) <= passes and kept.get(1000, 2) == 2
    pieces_ = corpus_pipeline.STAGES[-1][1](session, stage, SMALL).collect()
    assert {r.doc_id for r in pieces_} == set(kept)
