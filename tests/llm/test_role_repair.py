"""Conversation repair against all edit sequences, a plain dynamic program, and SQL."""

import hashlib
import itertools
import os
import random
import re
import sys
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from corpusmill.llm import role_repair  # noqa: E402

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _all_edits(codes):
    """The least (cost, audit, roles) of every way to edit codes, with at most two inserts before, between and after."""
    gaps = [[("I" * n, roles, 5 * n) for n in range(3) for roles in map("".join, itertools.product("ua", repeat=n))]]
    choices = []
    for code in codes:
        extra = 5 if code.isupper() else 0
        own = [("D", "", role_repair.COSTS["D"])]
        if code != "d":
            own += [("K", code.lower(), extra)] + [("R", symbol, 1 + extra) for symbol in "ua"]
        choices += [*gaps, own]
    best = None
    for edits in itertools.product(*choices, *gaps):
        roles = "".join(e[1] for e in edits)
        if LEGAL.fullmatch(roles):
            found = (sum(e[2] for e in edits), "".join(e[0] for e in edits), roles)
            best = found if best is None else min(best, found)
    return best


def _by_chain(codes, cuts):
    own = role_repair.RoleParser(role_repair.GRAMMAR)
    edges = [0, *cuts, len(codes)]
    stretches = [codes[a:b] for a, b in zip(edges, edges[1:])]
    entries = list(range(len(own.stacks)))
    path, spent, tail = own.chain([own.table(s, entries) for s in stretches])
    edits = [e for s, a, b in zip(stretches, path, path[1:]) for e in own.spell(s, a, b)]
    return sum(spent), "".join(e[0] for e in edits) + "I" * len(tail), "".join(e[1] + e[2] for e in edits) + tail


@pytest.mark.parametrize("delete", [2, 9])
def test_parser_by_all_edits(monkeypatch, delete):
    """With the dealt weights no insert is worth its cost; with dear deletes some are."""
    monkeypatch.setitem(role_repair.COSTS, "D", delete)
    used = ""
    rng = random.Random(12)
    for n in (1, 2, 3):
        for codes in itertools.product("dsuaxUAS", repeat=n) if n < 3 else [rng.choices("dsuaxSUAX", k=3) for _ in range(25)]:
            codes = "".join(codes)
            expected = _all_edits(codes)
            for cuts in ([], [1], list(range(1, n))):
                if all(0 < c < n for c in cuts):
                    assert _by_chain(codes, cuts) == expected, (codes, cuts)
            used += expected[1]
    assert ("I" in used) == (delete == 9)


def test_cuts_change_nothing():
    rng = random.Random(13)
    for _ in range(40):
        codes = "".join(rng.choices("dsuaxUASX", k=rng.randrange(20, 300)))
        whole = _by_chain(codes, [])
        for pieces in (2, 5, 15):
            assert _by_chain(codes, sorted(rng.sample(range(1, len(codes)), pieces))) == whole
        assert LEGAL.fullmatch(whole[2]) and len(whole[1]) - whole[1].count("I") == len(codes)


def test_no_fault_costs_nothing():
    assert _by_chain("suaua", []) == (0, "KKKKK", "suaua") and _by_chain("s", []) == (2, "D", "")


def _brute(rows):
    """Result rows by a plain reading of the rules; ties of turn by role, then text."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            shown = [" " if v is None else v for v in (conv, turn, role, text)]
            kind, role, text = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20, shown[2], shown[3]
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in after:
            words = re.findall("[^\x20\x09-\x0d]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {0: (0, "", "")}  # state -> cost, audit, text; states: none, system, user, pair

        def inserted(best):
            moves = {0: [(2, "user")], 1: [(2, "user")], 2: [(3, "assistant")], 3: [(2, "user")]}
            for _ in range(3):
                for s, (cost, audit, said) in list(best.items()):
                    for t, role in moves[s]:
                        new = (cost + 5, audit + "I", said + f"\n{role}:")
                        best[t] = min(best.get(t, new), new, key=lambda b: b[:2])
            return best

        for (_, role, text), fault in zip(after, faults):
            new = {}
            for s, (cost, audit, said) in inserted(best).items():
                ways = [(s, (cost + 2, audit + "D", said))]
                if fault not in ("blank", "duplicate"):
                    for t, symbol, name in {0: [(1, "s", None), (2, "u", "user")], 1: [(2, "u", "user")], 2: [(3, "a", "assistant")], 3: [(2, "u", "user")]}[s]:
                        more = 5 if fault else 0
                        if role[:1] == symbol:
                            ways.append((t, (cost + more, audit + "K", said + f"\n{role}:{text}")))
                        elif name:
                            ways.append((t, (cost + 1 + more, audit + "R", said + f"\n{name}:{text}")))
                for t, way in ways:
                    new[t] = min(new.get(t, way), way, key=lambda b: b[:2])
            best = new
        cost, audit, said = min((b for s, b in inserted(best).items() if s in (0, 3)), key=lambda b: b[:2])
        turns = [t for t, _, _ in after if t is not None]
        initials = [role[:1] for _, role, _ in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said[1:].encode()).hexdigest())
    return out


def _odd_rows():
    rng = random.Random(14)
    roles = ["user", "assistant", "system", "tool", "unit", "", None, " "]
    texts = ["Yes.", "No", "", " \n", None, "Why?", "ok!\t", "日本。", "...", "a.b", "x\x1c", "Wait. \x0b"]
    rows = []
    for conv in range(150):
        rows += [(conv, t, rng.choices(roles, [6, 6, 3, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.randrange(99)}.") for t in sorted(rng.sample(range(40), rng.randrange(1, 12)))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(9)] + [(900, None, "user", "Hm."), (900, None, "assistant", "So."), (900, 4, "user", "Hm.")]
    rows += [(901, 1, "user", "Same."), (901, 1, "user", "Same."), (901, 2, "assistant", "long " * 9000 + "."), (902, None, None, None)]
    return rows


def _got(frame):
    return {r[0]: tuple(r)[1:] for r in role_repair.repair_digests(frame).collect()}


def test_rows_by_brute_force_and_sql(spark):
    rows = _odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("part", "place", "copy", "code", "fault", "edit")})
    got = _got(frame)
    expected = _brute(rows)
    assert got == expected and any(e[0] for e in expected.values())
    connection = duckdb.connect()
    connection.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in connection.execute(role_repair.SQL).fetchall()} == expected


def test_one_conversation_over_many_parts(spark):
    rng = random.Random(15)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"T{t}.", f"T{t}!", f"T{t}"])) for t in range(3000)]
    rows += [(c, t, "ua"[t % 2] + "x", f"T{t}.") for c in (1, 6, 8, 9) for t in range(6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, SCHEMA).repartition(6, "text")
        repair = role_repair.Repair(role_repair.damage(frame))
        assert repair.stretches.where("conv_id = 7").count() > 3
        assert _got(frame) == _brute(rows)
        told = repair.messages().where("conv_id = 7").orderBy("part", "place").collect()
        # Where rows share a place, inserts stand before the row, or after the last one.
        assert sum(r.edit != "I" for r in told) == repair.rows.where("conv_id = 7").count()
        kept = [r for r in told if r.edit in "KR"]
        assert all(r.role is not None for r in kept) and all(r.role is None for r in told if r.edit == "D")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_empty(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert _got(frame) == _brute(rows)


def test_conversation_that_loses_all_rows(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, turn, "user", "Hi."), (6, 0, "user", "Hi.")]
    got = _got(spark.createDataFrame(rows, SCHEMA))
    assert got == _brute(rows) and got[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
