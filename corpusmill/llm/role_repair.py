"""Conversation structure repair by generalised LR parsing of roles.

A conversation's roles should read ``(system? (user assistant)+)?``.  The grammar is
compiled to LR states.  A parse holds a stack of states; stacks that share their lower part are
one graph, and derivations that arrive at an equal top on an equal link are merged by the
least (cost, audit).  Rows are shifted as they are (keep), as another role (rerole), or not
at all (delete), and roles without a row may be shifted (insert); all have weights.

Two facts make this fast and let a conversation of any size be split.  Audits of merged
derivations have consumed the same rows, so none is the beginning of another and their order
is known from the ranks of their beginnings: no audit is spelled out before the end.  And the
frontier of live tops, with costs and ranks taken relatively, has few forms, so a
frontier's reaction to a row is worked out once and remembered.  A stretch of rows then is a
small table of cost and rank by stack before and after it.

Rows are dealt by range of (conversation, turn), so a conversation with a third of all rows is
split over many tasks; each makes the tables of its stretches, one pass per conversation
chains the tables, and every stretch then spells its own edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.landing import land

# Role initials: s(ystem), u(ser), a(ssistant).
GRAMMAR = {"Conversation": ["", "sT", "T"], "T": ["TP", "P"], "P": ["ua"]}
ROLES = {"u": "user", "a": "assistant"}
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
LEGAL = {"su", "ua", "au"}
_BLANKS = " \t\n\x0b\x0c\r"

# A stretch's table has -1 where a stack cannot follow another.
NEVER = -1


class RoleParser:
    """LR states of a grammar, its stacks, and the weighted frontiers over them.

    Symbols are single characters, in upper case those that the grammar derives; ``start``
    is the first symbol.  For grammars whose reduced stacks are finitely many.
    """

    def __init__(self, grammar: dict[str, list[str]]):
        self.start = next(iter(grammar))
        self.grammar = grammar
        self.states: list[frozenset] = [self._closure({(self.start, rule, 0) for rule in grammar[self.start]})]
        self.number = {self.states[0]: 0}
        self.stacks: list[tuple[int, ...]] = [(0,)]
        self.ids = {(0,): 0}
        self.shifts: list[dict[str, list[int]]] = []
        at = 0
        while at < len(self.stacks):  # every stack that any roles lead to
            self.shifts.append({symbol: self._shift(self.stacks[at], symbol) for symbol in "sua"})
            at += 1
        self.accepts = [any(lhs == self.start and dot == len(rule) for lhs, rule, dot in self.states[s[-1]]) for s in self.stacks]
        self.frontiers: dict[tuple, int] = {}
        self.forms: list[tuple] = []
        self.reactions: list[dict[str, tuple[int, int, list]]] = []

    def _closure(self, items: set) -> frozenset:
        held, todo = set(items), list(items)
        while todo:
            _, rule, dot = todo.pop()
            for inner in self.grammar.get(rule[dot : dot + 1], ()):
                item = (rule[dot], inner, 0)
                if item not in held:
                    held.add(item)
                    todo.append(item)
        return frozenset(held)

    def _goto(self, state: int, symbol: str) -> int | None:
        moved = {(lhs, rule, dot + 1) for lhs, rule, dot in self.states[state] if rule[dot : dot + 1] == symbol}
        if not moved:
            return None
        closed = self._closure(moved)
        if closed not in self.number:
            self.number[closed] = len(self.states)
            self.states.append(closed)
        return self.number[closed]

    def _shift(self, stack: tuple[int, ...], symbol: str) -> list[int]:
        """Stacks after shifting a symbol and all reductions that may follow; several where the grammar forks."""
        target = self._goto(stack[-1], symbol)
        todo, found = [] if target is None else [(*stack, target)], []
        while todo:
            top = todo.pop()
            items = self.states[top[-1]]
            for lhs, rule, dot in items:
                if dot == len(rule) and lhs != self.start:
                    below = top[: len(top) - len(rule)]
                    todo.append((*below, self._goto(below[-1], lhs)))
            if any(rule[dot : dot + 1].islower() or (lhs == self.start and dot == len(rule)) for lhs, rule, dot in items):
                if top not in self.ids:
                    self.ids[top] = len(self.stacks)
                    self.stacks.append(top)
                found.append(self.ids[top])
        return found

    def _inserts(self, live: dict[int, tuple]) -> dict[int, tuple]:
        """Stacks after any inserts: ``{stack: (cost, rank, letters, entry, inserted)}``, the least of each."""
        best, todo = dict(live), list(live)
        while todo:
            stack = todo.pop()
            cost, rank, letters, entry, inserted = best[stack]
            for symbol in ROLES:
                for after in self.shifts[stack][symbol]:
                    offer = (cost + COSTS["I"], rank, letters + "I", entry, inserted + symbol)
                    if after not in best or offer < best[after]:
                        best[after] = offer
                        todo.append(after)
        return best

    def frontier(self, entries: dict[int, tuple[int, int]]) -> tuple[int, int]:
        """Number of the frontier ``{stack: (cost, rank)}``, and the least cost, which its form leaves out."""
        least = min(cost for cost, _ in entries.values())
        ranks = {rank: i for i, rank in enumerate(sorted({rank for _, rank in entries.values()}))}
        form = tuple((stack, cost - least, ranks[rank]) for stack, (cost, rank) in sorted(entries.items()))
        if form not in self.frontiers:
            self.frontiers[form] = len(self.forms)
            self.forms.append(form)
            self.reactions.append({})
        return self.frontiers[form], least

    def react(self, frontier: int, code: str) -> tuple[int, int, list]:
        """The next frontier, the cost added, and per entry of it ``(entry before, letters, inserted, shifted)``.

        ``code`` is a role initial, in upper case where the row is truncated; ``d`` where it must go.
        """
        known = self.reactions[frontier].get(code)
        if known:
            return known
        live = {stack: (cost, rank, "", i, "") for i, (stack, cost, rank) in enumerate(self.forms[frontier])}
        # Of each stack the least (cost, rank, letters); what was shifted comes along.
        after: dict[int, tuple] = {}

        def offer(stack: int, cost: int, rank: int, letters: str, entry: int, inserted: str, shifted: str) -> None:
            given = (cost, rank, letters, entry, inserted, shifted)
            if stack not in after or given < after[stack]:
                after[stack] = given

        for stack, (cost, rank, letters, entry, inserted) in self._inserts(live).items():
            offer(stack, cost + COSTS["D"], rank, letters + "D", entry, inserted, "")
            if code == "d":
                continue
            cost += TRUNCATED_COST if code.isupper() else 0
            for symbol in "sua":
                if symbol == code.lower():
                    edit = "K"
                elif symbol in ROLES:
                    edit = "R"
                else:
                    continue
                for top in self.shifts[stack][symbol]:
                    offer(top, cost + COSTS[edit], rank, letters + edit, entry, inserted, symbol)
        order = {key: i for i, key in enumerate(sorted({(g[1], g[2]) for g in after.values()}))}
        number, added = self.frontier({stack: (g[0], order[g[1], g[2]]) for stack, g in after.items()})
        chosen = [after[stack] for stack, _, _ in self.forms[number]]
        moves = [(entry, letters, inserted, shifted) for _, _, letters, entry, inserted, shifted in chosen]
        self.reactions[frontier][code] = (number, added, moves)
        return self.reactions[frontier][code]

    def run(self, stack: int, codes: str) -> tuple[int, int, list[list]]:
        """From one stack over a stretch: the last frontier, the cost it leaves out, and all moves."""
        number, total = self.frontier({stack: (0, 0)})
        moves = []
        for code in codes:
            number, added, move = self.react(number, code)
            total += added
            moves.append(move)
        return number, total, moves

    def table(self, codes: str, entries: list[int]) -> tuple[list[int], list[int]]:
        """Cost and rank of the best edits by stack before (rows) and after (columns) a stretch."""
        n = len(self.stacks)
        costs, ranks = [NEVER] * (n * n), [0] * (n * n)
        for before in entries:
            number, total, _ = self.run(before, codes)
            for after, cost, rank in self.forms[number]:
                costs[before * n + after], ranks[before * n + after] = total + cost, rank
        return costs, ranks

    def spell(self, codes: str, before: int, after: int) -> list[tuple[str, str, str]]:
        """The best edits of a stretch between two stacks: per row ``(letters, inserted, shifted)``."""
        number, _, moves = self.run(before, codes)
        entry = next(i for i, (stack, _, _) in enumerate(self.forms[number]) if stack == after)
        spelled = []
        for move in reversed(moves):
            entry, letters, inserted, shifted = move[entry]
            spelled.append((letters, inserted, shifted))
        return spelled[::-1]

    def chain(self, tables: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int], str]:
        """Stacks before and after every stretch of a conversation, cost of each stretch, inserts at the end."""
        n = len(self.stacks)
        live, steps = {0: (0, 0)}, []
        for costs, ranks in tables:
            after: dict[int, tuple[int, int, int, int]] = {}
            for before, (cost, rank) in live.items():
                for top in range(n):
                    if costs[before * n + top] != NEVER:
                        given = (cost + costs[before * n + top], rank, ranks[before * n + top], before)
                        after[top] = min(after.get(top, given), given)
            order = {key: i for i, key in enumerate(sorted({g[1:3] for g in after.values()}))}
            live = {top: (g[0], order[g[1:3]]) for top, g in after.items()}
            steps.append({top: g[3] for top, g in after.items()})
        ends = self._inserts({stack: (cost, rank, "", stack, "") for stack, (cost, rank) in live.items()})
        _, _, _, last, inserted = min(end for stack, end in ends.items() if self.accepts[stack])
        path = [last]
        for step in reversed(steps):
            path.append(step[path[-1]])
        path.reverse()
        spent = [costs[a * n + b] for (costs, _), a, b in zip(tables, path, path[1:])]
        spent[-1] += COSTS["I"] * len(inserted)
        return path, spent, inserted


@cache
def parser() -> RoleParser:
    """One parser per worker, so that reactions are remembered from batch to batch."""
    return RoleParser(GRAMMAR)


# --- rows -------------------------------------------------------------------


def damage(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults planted by a hash of conversation and turn; nulls become one space.

    Of 20 remainders: 0 drops the row, 1 empties its text, 2 takes its signs ``. ! ?``, 3
    repeats it, 4 gives it the role user.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce(F.col("text"), F.lit(" "))
    hurt = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
        (kind == 0).alias("dropped"),
    )
    return hurt.where(~F.col("dropped")).select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        places = pa.array(range(at, at + batch.num_rows), pa.int64())
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), places], names=[*batch.schema.names, "part", "place"]
        )


_ROWS = "conv_id bigint, turn bigint, role string, text string"


def _placed(messages: DataFrame) -> DataFrame:
    """Rows in order, each with its part and its place in it.

    By conversation and turn (nulls first); equal turns by role, then text (beyond the first
    32 signs by a hash of it), so equal rows are neighbours.
    """
    order = [
        F.col("conv_id"), F.col("turn"), F.left("role", F.lit(32)), F.left("text", F.lit(32)), F.xxhash64("role", "text"),
        F.monotonically_increasing_id(),  # equal rows may be split anywhere
    ]
    names = [f"_k{i}" for i in range(2, len(order))]
    keyed = messages.select("conv_id", "turn", "role", "text", *[c.alias(n) for c, n in zip(order[2:], names, strict=True)])
    dealt = keyed.repartitionByRange("conv_id", "turn", *names).sortWithinPartitions("conv_id", "turn", *names)
    return land(dealt.select("conv_id", "turn", "role", "text").mapInArrow(_numbered, _ROWS + ", part int, place bigint"), "role-rows")


def _coded(rows: DataFrame) -> DataFrame:
    """``(conv_id, part, place, initial, code, fault)`` of every row; no text travels, only its digest."""
    bare: Column = F.rtrim("text", F.lit(_BLANKS))
    initial = F.left("role", F.lit(1))
    slim = rows.select(
        "conv_id", "part", "place",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.sha2(F.to_json(F.struct("role", "text")), 256).alias("digest"),
    )
    # A row is the first of its kind if it has the least place of all; one row per place, so no key is hot.
    firsts = slim.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "place")).alias("at")).select(
        F.col("at.part").alias("part"), F.col("at.place").alias("place"), F.lit(True).alias("first")
    )
    marked = slim.drop("digest").join(firsts, ["part", "place"], "left")
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("open"), "t").otherwise("-")
    told = marked.select("conv_id", "part", "place", "initial", fault.alias("fault"))
    code = F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    return told.withColumn("code", code)


def _stretches(rows: DataFrame) -> DataFrame:
    """Per conversation and part, which is at most one task's rows: initials, codes and faults as strings in order."""
    signs = F.array_sort(F.collect_list(F.struct("place", "initial", "code", "fault")))
    joined = _coded(rows).groupBy("conv_id", "part").agg(signs.alias("signs"))
    string = lambda name: F.array_join(F.col(f"signs.{name}"), "").alias(f"{name}s")
    return land(
        joined.select("conv_id", "part", F.get("signs.place", F.lit(0)).alias("first_place"), string("initial"), string("code"), string("fault")),
        "role-stretches",
    )


_TABLE = "conv_id bigint, part int, initials string, faults string, costs array<bigint>, ranks array<int>"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = parser()
    for batch in batches:
        held: list[list] = [[], []]
        for part, first, codes in zip(*(batch.column(name).to_pylist() for name in ("part", "first_place", "codes")), strict=True):
            # Only the first stretch of a part can go on from an earlier part.
            entries = range(len(own.stacks)) if first == 0 and part > 0 else [0]
            costs, ranks = own.table(codes, list(entries))
            held[0].append(costs)
            held[1].append(ranks)
        yield pa.RecordBatch.from_arrays(
            [batch.column(name) for name in ("conv_id", "part", "initials", "faults")]
            + [pa.array(held[0], pa.list_(pa.int64())), pa.array(held[1], pa.list_(pa.int32()))],
            names=["conv_id", "part", "initials", "faults", "costs", "ranks"],
        )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[dict]]]:
    """Rows of sorted batches by conversation."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != key:
                yield key, held
                held = []
            key = row["conv_id"]
            held.append(row)
    if held:
        yield key, held


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


_CHAINED = "conv_id bigint, part int, before int, after int, tail string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_CHAIN_NAMES = [x.split()[0] for x in _CHAINED.split(", ")]
_CHAIN_TYPES = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[x.split()[1]] for x in _CHAINED.split(", ")]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, out = parser(), []
    for key, stretches in _groups(batches):
        path, spent, tail = own.chain([(s["costs"], s["ranks"]) for s in stretches])
        before = ""
        for i, s in enumerate(stretches):
            last = i == len(stretches) - 1
            counts = [s["faults"].count(sign) for sign in "bdt"]
            out.append((key, s["part"], path[i], path[i + 1], tail if last else "", spent[i], *counts, _illegal(before + s["initials"])))
            before = s["initials"][-1:]
        if len(out) >= 5000:
            yield _batch(out, _CHAIN_NAMES, _CHAIN_TYPES)
            out = []
    yield _batch(out, _CHAIN_NAMES, _CHAIN_TYPES)


class Repair:
    """The repair of all conversations of a table ``(conv_id, turn, role, text)``.

    Null roles and texts count as one space, other columns are ignored.  Rows without a
    conversation form one, rows without a turn come first, repeated rows are duplicates.
    Texts and conversations of any size; an empty table has an empty repair.
    """

    def __init__(self, messages: DataFrame):
        space = F.lit(" ")
        clean = messages.select(
            F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"),
        )
        self.rows = _placed(clean)
        self.stretches = _stretches(self.rows)
        tables = self.stretches.mapInArrow(_tables, _TABLE)
        # A conversation has one small table per part.
        dealt = tables.repartition("conv_id").sortWithinPartitions("conv_id", "part")
        self.chained = land(dealt.mapInArrow(_chained, _CHAINED), "role-chain")

    def facts(self) -> DataFrame:
        """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost)``."""
        turns = self.rows.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps")
        )
        sums = self.chained.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
        return turns.join(sums, turns.conv_id.eqNullSafe(sums.conv_id)).drop(sums.conv_id)

    def _edited(self, keys: list[str]) -> DataFrame:
        """Every stretch's record, then its rows in order, in tasks by ``keys``."""
        told = self.chained.select("conv_id", "part", "before", "after", "tail")
        same = self.stretches.conv_id.eqNullSafe(told.conv_id) & (self.stretches.part == told.part)
        heads = self.stretches.join(told, same).select(
            self.stretches.conv_id, self.stretches.part, F.lit(-1).cast("bigint").alias("place"), "before", "after", "tail", "codes",
            F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        )
        rows = self.rows.select("conv_id", "part", "place", "role", "text")
        return heads.unionByName(rows, allowMissingColumns=True).repartition(*keys).sortWithinPartitions("conv_id", "part", "place")

    def messages(self) -> DataFrame:
        """``(conv_id, part, place, role, text, edit)``: all rows and inserts in order, with their edit; role and text null where deleted."""
        return self._edited(["conv_id", "part"]).mapInArrow(_spelled, _SPELLED)

    def digests(self) -> DataFrame:
        """``(conv_id, audit, repaired_sha256)``: a digest is over a whole conversation in order, so its rows stream through one task."""
        return self._edited(["conv_id"]).mapInArrow(lambda batches: _hashed(_spelled(batches)), "conv_id bigint, audit string, repaired_sha256 string")


_SPELLED = "conv_id bigint, part int, place bigint, role string, text string, edit string"
_SPELLED_NAMES = [x.split()[0] for x in _SPELLED.split(", ")]
_SPELLED_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
_HELD_ROWS = 4096


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, out = parser(), []
    edits: list[tuple[str, str, str]] = []
    at, tail = 0, ""
    for batch in batches:
        for row in batch.to_pylist():
            where = (row["conv_id"], row["part"])
            if row["place"] == -1:
                edits, at, tail = own.spell(row["codes"], row["before"], row["after"]), 0, row["tail"]
                continue
            letters, inserted, shifted = edits[at]
            at += 1
            out += [(*where, row["place"], ROLES[symbol], "", "I") for symbol in inserted]
            edit = letters[-1]
            if edit == "D":
                out.append((*where, row["place"], None, None, edit))
            else:
                out.append((*where, row["place"], ROLES[shifted] if edit == "R" else row["role"], row["text"], edit))
            if at == len(edits):
                out += [(*where, row["place"], ROLES[symbol], "", "I") for symbol in tail]
        if len(out) >= _HELD_ROWS:
            yield _batch(out, _SPELLED_NAMES, _SPELLED_TYPES)
            out = []
    yield _batch(out, _SPELLED_NAMES, _SPELLED_TYPES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["conv_id", "audit", "repaired_sha256"], [pa.int64(), pa.string(), pa.string()]
    key, audit, state, kept, out = None, [], None, 0, []
    for batch in batches:
        for conv_id, role, text, edit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "edit")), strict=True):
            if state is None or conv_id != key:
                if state is not None:
                    out.append((key, "".join(audit), state.hexdigest()))
                key, audit, state, kept = conv_id, [], hashlib.sha256(), 0
            audit.append(edit)
            if edit != "D":
                state.update(f"{chr(10) if kept else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                kept += 1
        yield _batch(out, names, types)
        out = []
    yield _batch([(key, "".join(audit), state.hexdigest())] if state is not None else [], names, types)


def repair_digests(messages: DataFrame) -> DataFrame:
    """Damage, then repair: a row per original conversation.

    ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``; a
    conversation that lost all rows has zeros, an empty audit and the hash of the empty string.
    """
    repair = Repair(damage(messages))
    original = messages.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    facts, digests = repair.facts().withColumnRenamed("conv_id", "_f"), repair.digests().withColumnRenamed("conv_id", "_d")
    joined = original.join(facts, F.col("conv_id").eqNullSafe(F.col("_f")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# The same rows in DuckDB SQL over ``conversations``: states 0 nothing, 1 system, 2 user open, 3 pairs closed.
SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS key
  FROM conversations
), crc_table AS (
  SELECT n, n::BIGINT AS c, 0 AS k FROM range(256) AS t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc_lists AS (
  SELECT list(c ORDER BY n) AS crcs FROM crc_table WHERE k = 8
), keyed AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(key)), lambda i: ascii(substr(decode(key), i + 1, 1))::BIGINT)),
                     lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM bytes, crc_lists
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed
), placed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, left(role, 1) AS initial,
         left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS pair, count(*) OVER (PARTITION BY conv) AS n
  FROM placed
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
  FROM seen
), inserts(s, letters, t, more) AS (
  VALUES (0, '', 0, ''), (0, 'I', 2, chr(10) || 'user:'), (0, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, '', 1, ''), (1, 'I', 2, chr(10) || 'user:'), (1, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, '', 2, ''), (2, 'I', 3, chr(10) || 'assistant:'), (2, 'II', 2, chr(10) || 'assistant:' || chr(10) || 'user:'),
         (3, '', 3, ''), (3, 'I', 2, chr(10) || 'user:'), (3, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:')
), shifts(t, symbol, role, u) AS (
  VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)
), steps AS (
  SELECT conv, i, s, x.letters || 'D' AS letters, 5 * length(x.letters) + 2 AS cost, t AS u, more FROM faulty, inserts x
  UNION ALL
  SELECT conv, i, s, x.letters || CASE WHEN initial = symbol THEN 'K' ELSE 'R' END,
         5 * length(x.letters) + CASE WHEN initial = symbol THEN 0 ELSE 1 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END,
         u, more || chr(10) || CASE WHEN initial = symbol THEN f.role ELSE h.role END || ':' || text
  FROM faulty f, inserts x JOIN shifts h USING (t) WHERE fault IN ('none', 'truncated') AND (initial = symbol OR h.role IS NOT NULL)
), best AS (
  SELECT conv, 0::BIGINT AS i, 0 AS s, struct_pack(cost := 0, audit := '', said := '') AS b FROM (SELECT DISTINCT conv FROM faulty)
  UNION ALL
  SELECT r.conv, r.i + 1, p.u, min(struct_pack(cost := r.b.cost + p.cost, audit := r.b.audit || p.letters, said := r.b.said || p.more))
  FROM best r JOIN steps p ON p.conv = r.conv AND p.i = r.i + 1 AND p.s = r.s GROUP BY r.conv, r.i, p.u
), ended AS (
  SELECT conv, min(struct_pack(cost := b.cost + 5 * length(letters), audit := b.audit || letters, said := b.said || more)) AS b
  FROM best JOIN (SELECT DISTINCT conv, n FROM faulty) USING (conv) JOIN inserts USING (s) WHERE i = n AND t IN (0, 3) GROUP BY conv
), counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id::BIGINT AS conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations) o
LEFT JOIN counted USING (conv) LEFT JOIN ended USING (conv)
"""
