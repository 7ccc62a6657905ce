"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, other.  Four small
transducers rewrite a clause's symbols from left to right, each with a weight per
step: negation weakens insults and threats in its scope, reported speech weakens
those after a word of saying, a target near an insult or after a threat strengthens
it (a target before a word of saying is who speaks and strengthens nothing), and the
last one sums what is left.  They are composed into one automaton, and
only clauses that hold an insult or threat are run through it.  A document's score is
a logistic of its clauses' weights.

Insults are a short list in four languages and what labelled rows add: words and
beginnings of words that occur in toxic texts much more often than in others.  Lexicon, symbol weights aside,
and logistic are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.labelled import held_out, training_sample
from corpusmill.llm.shingles import mix, slices

PER_CLASS = 4000
MAX_LEARNED = 300
MIN_DOCUMENTS, MIN_SHARE, MIN_RATIO = 4, 0.01, 10
STEM_BYTES = (5, 6, 7, 8)
THRESHOLD = 0.3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Fixed word lists, in lower case.
INSULTS = (
    "idiot idiots moron morons stupid scum loser losers pathetic worthless trash clown clowns imbecile dumb fool filth vermin "
    "bastard jerk crétin débile connard abruti imbécile trottel dummkopf abschaum arschloch versager estúpido imbécil basura idiota"
).split()
THREATS = "kill hurt destroy murder beat shoot punish tuer frapper détruire töten umbringen schlagen matar golpear destruir".split()
TARGETS = "you your yours he she they them him her tu toi vous ils elles du dich ihr euch sie tú usted ustedes ellos".split()
NEGATIONS = "not no never nor isn't aren't wasn't don't doesn't ne pas jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says say wrote writes called claimed reported quoted dit disait écrit sagte sagt schrieb dijo dice escribió".split()

_U = np.uint64


class Transducer:
    """Deterministic: ``step(state, symbol) -> (state, symbol, weight)``; states are found from 0 on."""

    def __init__(self, symbols: int, step) -> None:  # noqa: ANN001
        self.symbols, self.arcs = symbols, {}
        todo, seen = [0], {0}
        while todo:
            state = todo.pop()
            for symbol in range(symbols):
                arc = step(state, symbol)
                self.arcs[state, symbol] = arc
                if arc[0] not in seen:
                    seen.add(arc[0])
                    todo.append(arc[0])

    def __matmul__(self, after: Transducer) -> Transducer:
        """Composition: ``after`` reads what this one writes, and weights add up."""
        number: dict[tuple[int, int], int] = {(0, 0): 0}
        pairs = [(0, 0)]

        def step(state: int, symbol: int) -> tuple[int, int, float]:
            one, other = pairs[state]
            next_one, written, weight = self.arcs[one, symbol]
            next_other, out, more = after.arcs[other, written]
            if (next_one, next_other) not in number:
                number[next_one, next_other] = len(pairs)
                pairs.append((next_one, next_other))
            return number[next_one, next_other], out, weight + more

        return Transducer(self.symbols, step)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        n = max(s for s, _ in self.arcs) + 1
        nexts, weights = np.zeros((n, self.symbols), np.int64), np.zeros((n, self.symbols))
        for (state, symbol), (to, _, weight) in self.arcs.items():
            nexts[state, symbol], weights[state, symbol] = to, weight
        return nexts, weights


def _negation(state: int, symbol: int) -> tuple[int, int, float]:
    """A negation reaches over the next three words."""
    if symbol == NEGATION:
        return 3, OTHER, 0.0
    weaker = -0.4 if state and symbol in (INSULT, THREAT) else 0.0
    return max(0, state - 1), symbol, weaker


def _reported(state: int, symbol: int) -> tuple[int, int, float]:
    """A word of saying reaches over the next five words."""
    if symbol == REPORT:
        return 5, REPORT, 0.0
    weaker = -0.3 if state and symbol in (INSULT, THREAT) else 0.0
    return max(0, state - 1), symbol, weaker


def _target(state: int, symbol: int) -> tuple[int, int, float]:
    """States: 0 nothing, 1 to 3 a target so many words ago, 4 to 6 a threat that awaits its target.

    A word of saying ends both: what stands before it is not aimed by what follows.
    """
    if symbol == REPORT:
        return 0, OTHER, 0.0
    if symbol == TARGET:
        return 3, OTHER, (0.8 if state >= 4 else 0.0)
    if symbol == INSULT:
        return 0, INSULT, (0.3 if 1 <= state <= 3 else 0.0)
    if symbol == THREAT:
        return 6, THREAT, 0.0
    return (state - 1 if state not in (0, 4) else 0), symbol, 0.0


def _sum(state: int, symbol: int) -> tuple[int, int, float]:
    return 0, OTHER, 1.0 if symbol == INSULT else 0.2 if symbol == THREAT else 0.0


GRAMMAR = (
    Transducer(6, _negation) @ Transducer(6, _reported) @ Transducer(6, _target) @ Transducer(6, _sum)
).table()

# Letters, digits, apostrophes and all bytes of other signs make words; these end a clause.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_CLAUSE_END = np.zeros(256, np.int64)
_CLAUSE_END[list(b".!?;:\n")] = 1
_BASE = _U(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))


def word_key(word: str) -> int:
    keys = next(_scan([word]))[0][0]
    return int(keys[0]) if len(keys) else 0


def _scan(texts: list[str | None]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Per slice: keys of lower-case words and of their beginnings, the clause of each word, first word of every text and the end.

    Keys of beginnings are 0 where a word is no longer than that.
    """
    for _, raws in slices(texts):
        raws = [raw.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass") for raw in raws]
        data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], _WORD[data], [False])).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        sizes = ends - starts
        padded = np.concatenate((data, np.zeros(max(STEM_BYTES), np.uint8)))
        hashes, stems = np.zeros(len(starts), _U), {}
        with np.errstate(over="ignore"):
            # Words of more than 32 bytes are told apart by their first 32 and their size.
            for k in range(min(32, int(sizes.max(initial=0)))):
                has = np.flatnonzero(sizes > k)
                hashes[has] = hashes[has] * _BASE + _BYTE[padded[starts[has] + k]]
                if k + 1 in STEM_BYTES:
                    stems[k + 1] = np.where(sizes > k + 1, mix(hashes + _U(1000 + k)), _U(0))
            words = mix(hashes + sizes.astype(_U) + _U(5000))
        begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)))
        yield [words, *stems.values()], np.cumsum(_CLAUSE_END[data])[starts], np.searchsorted(starts, begins)


def clause_weights(texts: list[str | None], lexicon: dict[int, int]) -> Iterator[list[float]]:
    """Of every text, the grammar's weights of its clauses that hold an insult or a threat."""
    order = np.array(sorted(lexicon), _U)
    symbols = np.array([lexicon[int(k)] for k in order])
    nexts, weights = GRAMMAR
    for keys, clauses, first in _scan(texts):
        found = np.zeros(len(keys[0]), np.int64)
        for own in keys:
            at = np.minimum(np.searchsorted(order, own), len(order) - 1)
            found = np.where((order[at] == own) & (found == OTHER), symbols[at], found)
        heavy = np.flatnonzero((found == INSULT) | (found == THREAT))
        text_of = np.searchsorted(first, heavy, "right") - 1
        result: list[list[float]] = [[] for _ in range(len(first) - 1)]
        done = -1
        for i, text in zip(heavy.tolist(), text_of.tolist(), strict=True):
            if clauses[i] == done:
                continue
            done = clauses[i]
            begin = max(int(np.searchsorted(clauses, done)), int(first[text]))
            end = min(int(np.searchsorted(clauses, done, "right")), int(first[text + 1]))
            state, total = 0, 0.0
            for symbol in found[begin:end].tolist():
                total += weights[state, symbol]
                state = nexts[state, symbol]
            result[text].append(total)
        yield from result


def summary(clauses: list[float]) -> list[float]:
    """Strongest clause, and the sum of all that are positive, dampened."""
    strong = [max(0.0, w) for w in clauses]
    return [min(2.0, max(strong, default=0.0)), math.log1p(sum(strong))]


def _base_lexicon() -> dict[int, int]:
    lists = ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT))
    return {word_key(word): symbol for words, symbol in lists for word in words}


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(0).to_pylist()
        at, keys, ys = 0, [], []
        for words, _, first in _scan(batch.column(1).to_pylist()):
            for begin, end in zip(first[:-1], first[1:], strict=True):
                own = np.unique(np.concatenate([w[begin:end] for w in words]))
                own = own[own > 0]
                keys.append(own.view(np.int64))
                ys.append(np.full(len(own), labels[at], np.int32))
                at += 1
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ys)), pa.array(np.concatenate(keys))], names=["y", "key"])


def learn_lexicon(sample: DataFrame, have: dict[int, int]) -> dict[int, int]:
    """The lists, and words and beginnings with the most toxic texts: at most ``MAX_LEARNED``.

    What is learned occurs in ``MIN_DOCUMENTS`` and ``MIN_SHARE`` of the sample's toxic
    texts or more, and in a share of them ``MIN_RATIO`` times that among the others.
    """
    lexicon = _base_lexicon()
    if not have.get(0) or not have.get(1):
        return lexicon
    counts = (
        sample.select("y", "text")
        .mapInArrow(_distinct_words, "y int, key bigint")
        .groupBy("key")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
        .where(F.col("toxic") >= max(MIN_DOCUMENTS, MIN_SHARE * have[1]))
        .where(F.col("toxic") / have[1] >= MIN_RATIO * (F.col("clean") + 0.5) / have[0])
        .orderBy(F.desc("toxic"), "key")
        .limit(MAX_LEARNED)
        .collect()
    )
    for row in counts:
        key = row.key % (1 << 64)
        if lexicon.get(key, INSULT) == INSULT:
            lexicon[key] = INSULT
    return lexicon


def fit_logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Coefficients and constant by Newton steps with a small ridge."""
    x = np.column_stack((features, np.ones(len(features))))
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.05] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - ridge @ beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(beta))
        beta = beta + np.linalg.solve(curve, slope)
    return beta


def _features(lexicon: dict[int, int], column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(clause_weights(batch.column(column).to_pylist(), lexicon))
            values = np.array([summary(c) for c in found]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:column], pa.array(values[:, 0]), pa.array(values[:, 1]), pa.array([len(c) for c in found], pa.int64())],
                names=[*batch.schema.names[:column], "strongest", "total", "n_clauses"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[dict[int, int], np.ndarray]:
    """Lexicon and logistic from at most ``per_class`` labelled texts of each class."""
    sample, totals = training_sample(docs, labels, "toxic", per_class)
    sample = sample.persist()
    have = {row.y: row.n for row in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lexicon = learn_lexicon(sample, have)
    rows = sample.select("y", "text").mapInArrow(_features(lexicon, 1), "y int, strongest double, total double, n_clauses bigint").collect()
    sample.unpersist()
    if not have.get(0) or not have.get(1):
        prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return lexicon, np.array([0.0, 0.0, math.log(prior / (1 - prior))])
    rows = sorted((r.y, r.strongest, r.total) for r in rows)
    ys = np.array([r[0] for r in rows], float)
    # Each row stands for as many of its class as the sample left out.
    weights = np.array([totals[int(y)] / have[int(y)] for y in ys])
    return lexicon, fit_logistic(np.array([r[1:] for r in rows]), ys, weights)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_clauses)`` of every row of ``docs``.

    Null and empty texts have no clauses and get the logistic's constant.  Rows with
    repeated or null ids are scored each.  Without labels of both classes all scores
    are the share of toxic rows.  Columns besides ``doc_id`` and ``text`` are ignored.
    """
    lexicon, beta = fit(docs, labels, per_class)
    logit = F.col("strongest") * float(beta[0]) + F.col("total") * float(beta[1]) + float(beta[2])
    scored = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _features(lexicon, 1), "doc_id bigint, strongest double, total double, n_clauses bigint"
    )
    score = 1 / (1 + F.exp(-logit))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "n_clauses"
    )
