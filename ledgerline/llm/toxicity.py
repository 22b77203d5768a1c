"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults (learned, with a weight), threats, targets, negations and verbs or marks of
reported speech (fixed lists). Small transducers read a clause symbol by symbol and are composed: the
composed state says which of them are on, and an insult or threat counts with its weight times the arc
weights of those, so that "you are a moron" can weigh more than "a moron", and "not a moron" or "he said:
moron" less. A document is scored by its matched clauses, not by isolated words: the strongest one,
their sum and their number, through a logistic curve.

Insults are whole words or beginnings of words that are far more frequent in toxic documents. They, the
arc weights and the curve are learned from a bounded sample of labelled documents, those with the least
hash of their id: up to ``TOXIC`` and ``CLEAN`` of them. An arc weight other than 1 (a threat's other than
0) is kept only if the sample's likelihood gains more by it than a parameter costs. Scoring reads each text whole, in one pass without a shuffle;
the model's size is bounded by ``LEXICON``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.sample import least_hashed
from ledgerline.llm.ship import ship
from ledgerline.llm.words import ALNUM, Words, _letters, flat, mix, slices, spans
from ledgerline.session import durable

TOXIC, CLEAN = 4000, 8000
LEXICON = 2000
#: A word feature must be in so many toxic documents, and this much likelier there (natural logarithm).
SUPPORT, LIFT = 5, 2.5
#: Beginnings of words in bytes; 0 is the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10, 12, 0)
CLAUSE_ENDS = b".!?;:\n"

# English, German, French, Spanish.
TARGETS = "you your yours youre u he she they them him her his du dich dir dein deine ihr euch sie er tu toi vous ton ta tes il elle ils usted ustedes tu vosotros el ella ellos"
NEGATIONS = "not no never nobody neither nor isnt arent wasnt dont doesnt didnt without nicht kein keine keinen nie niemals ohne ne pas jamais aucun aucune sans nunca ningun ninguna sin"
REPORTS = "said says say told tells wrote writes called calls claimed quoted quote sagte sagt schrieb nannte behauptet zitat dit disait ecrit ecrivait appelle dijo dice escribio llamo"
THREATS = "kill killing hurt beat destroy burn shoot stab hang punch toten umbringen schlagen verletzen sterben verbrennen tuer frapper mourir bruler matar golpear morir quemar"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_LISTS = {THREAT: THREATS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}
_NAMES = ["strongest", "total", "clauses", "density"]


@dataclass(frozen=True)
class Transducer:
    """A state that counts down from ``reach`` after each of its trigger symbols (or stays, if ``reach`` is
    0, to the end of the clause); the transducer is on while the state is not zero."""

    trigger: int
    reach: int

    def step(self, state: int, symbol: int) -> tuple[int, bool]:
        if symbol == self.trigger:
            return (self.reach or 1 << 30), state > 0
        return max(state - 1, 0), state > 0


#: A target reaches four words, negation three, reported speech the rest of its clause.
GRAMMAR = (Transducer(TARGET, 4), Transducer(NEGATION, 3), Transducer(REPORT, 0))
_STATES = 1 << len(GRAMMAR)
#: Arc weights looked at, for each transducer and for threats.
ARC_CHOICES = (0.1, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0)
THREAT_CHOICES = (0.0, 0.5, 1.0, 2.0, 4.0)
THREAT_WEIGHT = 4.0


@dataclass(frozen=True)
class Arcs:
    """The weight of each transducer of the grammar while it is on, and that of a threat."""

    factors: tuple[float, ...]
    threat: float

    def outputs(self) -> np.ndarray:
        """Weights of the columns of ``clause_marks``: products over the composed state."""
        on = [math.prod(f for i, f in enumerate(self.factors) if state >> i & 1) for state in range(_STATES)]
        return np.array(on + [self.threat * f for f in on])


#: Arc weights of a grammar that nothing was learned for, and those that learning starts from.
GIVEN = Arcs((1.5, 0.3, 0.5), THREAT_WEIGHT)
NEUTRAL = Arcs((1.0,) * len(GRAMMAR), 0.0)


def clause_marks(symbols: list[int], weights: list[float]) -> list[float]:
    """What the composed transducers see in a clause: by composed state, first the weights of insults, then
    the number of threats. They read forwards; a target that follows counts too, by reading targets backwards.
    A threat counts only with a target in reach."""
    states = [0] * len(symbols)
    for bit, machine in enumerate(GRAMMAR):
        ways = [range(len(symbols))]
        if machine.trigger == TARGET:
            ways.append(range(len(symbols) - 1, -1, -1))
        for way in ways:
            state = 0
            for i in way:
                state, on = machine.step(state, symbols[i])
                states[i] |= on << bit
    marks = [0.0] * (2 * _STATES)
    for symbol, weight, state in zip(symbols, weights, states):
        if symbol == INSULT:
            marks[state] += weight
        elif symbol == THREAT and state & 1:
            marks[_STATES + state] += 1.0
    return marks


def clause_weight(symbols: list[int], weights: list[float], arcs: Arcs = GIVEN) -> float:
    """Weight of a clause under the composed transducers."""
    return sum(m * o for m, o in zip(clause_marks(symbols, weights), arcs.outputs().tolist()))


@dataclass
class Model:
    """Hashes of the lexicon in order, their weights, the curve over the clause features, and the arc weights."""

    lexicon: np.ndarray
    weights: np.ndarray
    curve: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    arcs: Arcs = NEUTRAL

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[1:] + self.curve[0], -30, 30)))


def _beginning(letters: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    stop = np.minimum(start + size, end) if size else end
    return mix(spans(letters, start, stop) + np.uint64(size * 0x51ED2701))


def _lists() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the fixed words in order, and their symbols."""
    pairs = {}
    for symbol, text in _LISTS.items():
        for word in text.split():
            pairs.setdefault(word, symbol)
    words = Words(*flat(pa.array(list(pairs))), ALNUM)
    order = np.argsort(words.hash)
    return words.hash[order], np.array(list(pairs.values()))[order]


def _look(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in an ordered table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def matched_clauses(column: pa.Array, lexicon: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The clauses that hold an insult or a threat: row and marks of each; and the words of each text."""
    data, offsets = flat(column)
    words = Words(data, offsets, ALNUM)
    if not len(words.start):
        return np.zeros(0, int), np.zeros((0, 2 * _STATES)), words.count
    _, once, back = np.unique(words.hash, return_index=True, return_inverse=True)
    letters = _letters()[words.bytes]
    best = np.zeros(len(once))
    length = (words.end - words.start)[once]
    for size in BEGINNINGS:
        at = _look(lexicon, _beginning(letters, words.start[once], words.end[once], size))
        hit = (at >= 0) & (length >= size)
        best = np.where(hit, np.maximum(best, weights[at] if len(weights) else 0), best)
    fixed, symbols = _lists()
    at = _look(fixed, words.hash[once])
    kind = np.where(at >= 0, symbols[at], OTHER)
    kind = np.where(best > 0, INSULT, kind)[back]
    weight = best[back]

    ends = np.isin(words.bytes, np.frombuffer(CLAUSE_ENDS, np.uint8))
    passed = np.concatenate([[0], np.cumsum(ends)])[words.start]
    new = np.ones(len(words.start), bool)
    new[1:] = (passed[1:] != passed[:-1]) | (words.row[1:] != words.row[:-1])
    clause = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(words.start))
    found = np.unique(clause[(kind == INSULT) | (kind == THREAT)])
    marks = np.zeros((len(found), 2 * _STATES))
    for i, c in enumerate(found):
        marks[i] = clause_marks(kind[first[c] : last[c]].tolist(), weight[first[c] : last[c]].tolist())
    return words.row[first[found]], marks, words.count


def clause_features(column: pa.Array, lexicon: np.ndarray, weights: np.ndarray, arcs: Arcs = GIVEN) -> np.ndarray:
    """Per text: the strongest clause, the sum of clauses, how many matched, and their sum for the text's length."""
    row, marks, n_words = matched_clauses(column, lexicon, weights)
    value = marks @ arcs.outputs()
    row, value = row[value > 0], value[value > 0]
    out = np.zeros((len(column), len(_NAMES)))
    np.maximum.at(out[:, 0], row, value)
    out[:, 1] = np.bincount(row, value, len(column))
    out[:, 2] = np.bincount(row, minlength=len(column))
    out[:, 3] = out[:, 1] / np.sqrt(n_words + 1.0)
    out[:, 1:3] = np.log1p(out[:, 1:3])
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(*flat(part.column("text")), ALNUM)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False) == 1
            letters = _letters()[words.bytes]
            for size in BEGINNINGS:
                use = np.flatnonzero(words.end - words.start >= max(size, 3))
                key = _beginning(letters, words.start[use], words.end[use], size)
                row = words.row[use]
                order = np.lexsort((row, key))
                key, row = key[order], row[order]
                fresh = np.ones(len(key), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                key, row = key[fresh], row[fresh]
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
                if len(starts):
                    yes = np.add.reduceat(toxic[row].astype(np.int64), starts)
                    n = np.diff(np.append(starts, len(key)))
                    yield pa.record_batch([pa.array(key[starts].view(np.int64)), pa.array(yes), pa.array(n - yes)], ["key", "yes", "no"])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _loss(marks: np.ndarray, y: np.ndarray, arcs: Arcs) -> float:
    """Negative logarithm of the likelihood of the labels by the texts' weights; more weight is never less toxic."""
    x = np.log1p(marks @ arcs.outputs())
    x = (x - x.mean()) / max(x.std(), 1e-6)
    w = _logistic(x[:, None], y)
    if w[1] < 0:
        w = _logistic(np.zeros((len(x), 1)), y)
    z = np.clip(x * w[1] + w[0], -30, 30)
    return float(np.sum(np.logaddexp(0, z) - y * z))


def learn_arcs(marks: np.ndarray, y: np.ndarray) -> Arcs:
    """Arc weights from the texts' summed marks: the choice that gains most is taken, as long as it gains more
    than half the logarithm of the number of texts."""
    arcs, loss = NEUTRAL, _loss(marks, y, NEUTRAL)
    for _ in range(2 * len(GRAMMAR) + 2):
        tries = [Arcs(arcs.factors, t) for t in THREAT_CHOICES if t != arcs.threat]
        for i, factor in enumerate(arcs.factors):
            tries += [Arcs(arcs.factors[:i] + (f,) + arcs.factors[i + 1 :], arcs.threat) for f in ARC_CHOICES if f != factor]
        best, least = min(((t, _loss(marks, y, t)) for t in tries), key=lambda pair: pair[1])
        if loss - least <= np.log(len(y)) / 2:
            break
        arcs, loss = best, least
    return arcs


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    toxic: int = TOXIC,
    clean: int = CLEAN,
) -> Model:
    """Learn from up to ``toxic`` documents labelled 1 and ``clean`` labelled 0.

    Null labels and texts teach nothing. Without a toxic and a clean document the model finds no insult
    and gives every text the same low score.
    """
    ship(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).filter("toxic in (0, 1)").distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text")).filter("text is not null")
    known = rows.select("doc_id").join(marks, "doc_id")
    chosen = least_hashed(known.filter("toxic = 1"), "doc_id", "toxic", toxic).union(
        least_hashed(known.filter("toxic = 0"), "doc_id", "toxic", clean)
    )
    sample = durable(rows.join(chosen, "doc_id").select("text", "toxic"))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([-3.0] + [0.0] * len(_NAMES)), np.zeros(len(_NAMES)), np.ones(len(_NAMES)))
    lift = F.log((F.col("yes") + 0.5) / (size[1] + 1)) - F.log((F.col("no") + 0.5) / (size[0] + 1))
    found = (
        sample.mapInArrow(_word_counts, "key long, yes long, no long")
        .groupBy("key")
        .agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        .filter(F.col("yes") >= SUPPORT)
        .withColumn("lift", lift)
        .filter(F.col("lift") >= LIFT)
        .orderBy(F.desc("lift"), "key")
        .limit(LEXICON)
        .collect()
    )
    lexicon = np.array([r["key"] for r in found], np.int64).view(np.uint64)
    weights = np.array([r["lift"] for r in found], np.float64)
    order = np.argsort(lexicon)
    lexicon, weights = lexicon[order], weights[order]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, marks, _ = matched_clauses(part.column("text"), lexicon, weights)
                total = [pa.array(np.bincount(row, c, part.num_rows).astype(float)) for c in marks.T]
                yield pa.record_batch([*total, part.column("toxic")], columns)

    columns = [*(f"m{i}" for i in range(2 * _STATES)), "toxic"]
    kinds = ", ".join(f"{n} double" for n in columns[:-1])
    got = np.array(sample.mapInArrow(sums, f"{kinds}, toxic int").collect(), np.float64)
    got = got[np.lexsort(got.T)]
    arcs = learn_arcs(got[:, :-1], got[:, -1])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = clause_features(part.column("text"), lexicon, weights, arcs)
                yield pa.record_batch([*(pa.array(c) for c in x.T), part.column("toxic")], [*_NAMES, "toxic"])

    kinds = ", ".join(f"{n} double" for n in _NAMES)
    got = np.array(sample.mapInArrow(features, f"{kinds}, toxic int").collect(), np.float64)
    got = got[np.lexsort(got.T)]
    x, y = got[:, :-1], got[:, -1]
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return Model(lexicon, weights, _logistic((x - mean) / spread, y), mean, spread, arcs)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, clauses, strongest``: the score (0 to 1), how many clauses matched, and the weight
    of the strongest. A null text counts as empty and scores like a text without a match. Repeated rows
    stay repeated; other columns play no part."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                x = clause_features(part.column("text"), m.lexicon, m.weights, m.arcs)
                clauses = np.rint(np.expm1(x[:, 2])).astype(np.int64)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(m.score(x)), pa.array(clauses), pa.array(x[:, 0])],
                    ["doc_id", "score", "clauses", "strongest"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col)).alias("text")).mapInArrow(
        run, "doc_id long, score double, clauses long, strongest double"
    )
