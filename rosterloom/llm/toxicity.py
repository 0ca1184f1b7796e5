"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read a clause word by word: target (is anybody addressed or spoken of), negation, reported speech,
threat (a threatening verb and whom it is aimed at) and insult. Each reads its own marks of a word, so a word may be a
target and an insult at once. Their composition is one machine whose states are tuples of theirs, built once: an insult arc
yields the word's learned weight, an arc that completes a threat that of the verb, and both are raised where the clause has
aimed at somebody and lowered inside a negation or reported speech. A clause's score is the sum over its path, so matched
clauses count and not isolated words.

All weights are learned from labelled rows: the insult lexicon (whole words and word beginnings, so that inflected forms
count), threatening verbs (likewise, from words near a target in toxic texts; a few known stems are there from the start),
what the arcs multiply by, and the four weights that turn a text's clause scores into a probability. The lexicons come from
the larger part of a sample, the other weights from the rest. The sample holds at most ``sample`` labelled rows, those with
the smallest hash of the id; nothing that is learned from it is cut off. Scoring reads every whole text: an Aho-Corasick
automaton finds the lexicons' words, and only their clauses are parsed, each once.

Defined results: a null or empty text has no clause and gets the score of a text without matches; without labelled rows
of both classes every score is the share of toxic labels (or 0); repeated rows are scored each; other columns are
ignored. Positions are code points of the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import common

SAMPLE = 12_000
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_PREFIXES = range(4, 11)
#: A stem's inflected forms are so many letters longer at most; a threat's weight before learning; words of a scope.
_ENDING, _STEM_WEIGHT, _THREAT_SCOPE, _NEGATION_SCOPE = 3, 2.0, 4, 3

# Function words of the four languages, by transducer, and stems of threatening verbs.
ADDRESSED = frozenset("you your yours u tu te toi vous votre du dich dir ihr euch tú usted ustedes vosotros".split())
SPOKEN_OF = frozenset("he she they them him her we il elle ils er sie él ella ellos".split())
TARGETS = ADDRESSED | SPOKEN_OF
NEGATIONS = frozenset("not never no don't isn't aren't ne pas jamais nicht nie kein keine no nunca jamás".split())
REPORTS = frozenset("said says say quoted reportedly claims claimed wrote dit disait écrit sagte sagt schrieb dijo dice escribió".split())
THREAT_STEMS = frozenset("kill hurt destroy beat stab shoot burn tuer frapper brûler töten schlagen verbrennen matar golpear quemar".split())

#: A word's marks, and the transducers' states: nobody, spoken of, addressed; words left of a scope; outside or inside.
INSULT, ADDRESS, MENTION, DENY, REPORT, THREAT = (1 << i for i in range(6))
Path = tuple[int, int, int, int]


def _aim(state: int, marks: int) -> int:
    return 2 if marks & ADDRESS else max(state, 1) if marks & MENTION else state


def _scope(state: int, opens: bool, length: int) -> int:
    return length if opens else max(0, state - 1)


def _step(path: Path, marks: int) -> tuple[Path, int, int]:
    """The composed move: next states, and the path class of an insult and of a threat that the arc completes, or -1.

    Path classes are numbers of (aimed, denied, told): insults 0..7, threats 8..15.
    """
    aimed, denied, told, threat = path
    place = 4 * bool(aimed) + 2 * bool(denied) + told
    completes = bool(marks & THREAT and aimed == 2) or bool(threat and marks & (ADDRESS | MENTION))
    nxt = (_aim(aimed, marks), _scope(denied, bool(marks & DENY), _NEGATION_SCOPE), told | bool(marks & REPORT), 0 if completes else _scope(threat, bool(marks & THREAT), _THREAT_SCOPE))
    return nxt, place if marks & INSULT else -1, 8 + (place & 3) if completes else -1


@dataclass(frozen=True)
class Arcs:
    """What arcs multiply by: insults behind a target, arcs inside a negation, inside reported speech, threats."""

    aimed: float = 1.5
    denied: float = 0.5
    told: float = 0.6
    threat: float = 1.0

    def gains(self) -> list[float]:
        """By path class."""
        out = [(self.aimed if a else 1.0) * (self.denied if d else 1.0) * (self.told if t else 1.0) for a, d, t in product((0, 1), repeat=3)]
        return out + [self.threat * (self.denied if d else 1.0) * (self.told if t else 1.0) for _, d, t in product((0, 1), repeat=3)]


class Grammar:
    """The composition of the transducers: every state and mark that a clause can reach, built once."""

    def __init__(self):
        self.table: dict[tuple[Path, int], tuple[Path, int, int]] = {}
        for path in product(range(3), range(_NEGATION_SCOPE + 1), range(2), range(_THREAT_SCOPE + 1)):
            for marks in range(1 << 6):
                self.table[path, marks] = _step(path, marks)

    def clause(self, words: list[str], read) -> dict[int, float]:
        """The clause's sums by path class; ``read(word)`` gives a word's marks, insult weight and threat weight."""
        path, sums, verb = (0, 0, 0, 0), {}, 0.0
        for w in words:
            marks, insult, threat = read(w)
            if marks or path[1] or path[3]:
                path, a, b = self.table[path, marks]
                verb = threat or verb
                if a >= 0:
                    sums[a] = sums.get(a, 0.0) + insult
                if b >= 0:
                    sums[b] = sums.get(b, 0.0) + verb
        return sums


def _beginnings(w: str) -> list[str]:
    return [w + "$", *(w[:k] for k in _PREFIXES if k <= len(w))]


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Model:
    lexicon: dict[str, float]  # insults: "word$" for whole words, else a beginning
    weights: list[float]
    bias: float
    threats: dict[str, float] = field(default_factory=dict)  # likewise
    arcs: Arcs = Arcs()

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def read(self, w: str) -> tuple[int, float, float]:
        """A word's marks, its weight as an insult and as a threatening verb."""
        keys = _beginnings(w)
        insult, threat = (max(found.get(k, 0.0) for k in keys) for found in (self.lexicon, self.threats))
        if not threat and any(w[:k] in THREAT_STEMS for k in range(max(1, len(w) - _ENDING), len(w) + 1)):
            threat = _STEM_WEIGHT
        marks = (INSULT if insult else 0) | (ADDRESS if w in ADDRESSED else 0) | (MENTION if w in SPOKEN_OF else 0) | (DENY if w in NEGATIONS else 0) | (REPORT if w in REPORTS else 0) | (THREAT if threat else 0)
        return marks, insult, threat

    def _machine(self):
        if self._ready is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for p in {k.rstrip("$") for k in (*self.lexicon, *self.threats)} | THREAT_STEMS:
                a.add_word(p, len(p))
            a.make_automaton()
            self._ready = (a, Grammar())
        return self._ready

    def matched(self, text: str) -> list[tuple[int, int, dict[int, float]]]:
        """(start, end, sums by path class) of the matched clauses of a text."""
        automaton, grammar = self._machine()
        low, out, done = lowered(text), [], 0
        for end, length in automaton.iter(low):
            start = end - length + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            a = max(done, max(low.rfind(c, done, start) for c in ".!?;\n") + 1)
            m = _CLAUSE_END.search(low, end)
            done = m.start() if m else len(low)
            if sums := grammar.clause(_WORD.findall(low, a, done), self.read):
                out.append((a, done, sums))
        return out

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the matched clauses of a text, those with a score."""
        gains = self.arcs.gains()
        scored = ((a, b, sum(gains[k] * v for k, v in sums.items())) for a, b, sums in self.matched(text))
        return [c for c in scored if c[2]]

    def features(self, text: str) -> list[float]:
        return self.features_of(self.clauses(text) if text else [], text)

    def features_of(self, found: list[tuple[int, int, float]], text: str) -> list[float]:
        """Of a text's matched clauses: largest and total score, number, and total in proportion to the length."""
        return _features([s for *_, s in found], len(text))

    def score(self, features: list[float]) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(scores: list[float], length: int) -> list[float]:
    scores = [s for s in scores if s]
    if not scores:
        return [0.0, 0.0, 0.0, 0.0]
    total = sum(scores)
    return [math.log1p(max(scores)), math.log1p(total), math.log1p(len(scores)), math.log1p(1000 * total / length)]


def _train_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, sample: int) -> DataFrame:
    """Texts and labels of at most ``sample`` training rows, with part = 0..9 by hash."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)))


def _near_target(words: list[str]) -> set[str]:
    """Words that a threat arc would complete on: a target follows within the scope, or somebody is addressed before."""
    out, addressed, waiting = set(), False, []
    for i, w in enumerate(words):
        if w in TARGETS:
            out.update(x for k, x in waiting if i - k <= _THREAT_SCOPE)
            waiting = []
        if addressed:
            out.add(w)
        else:
            waiting = [*waiting[-_THREAT_SCOPE:], (i, w)]
        addressed |= w in ADDRESSED
    return out - TARGETS


def _count_features(rows: DataFrame) -> DataFrame:
    """(near, feature, toxic, clean): in how many texts of each class a word or word beginning occurs; near: only near a target."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                counts = {(near, y): Counter() for near in (False, True) for y in (False, True)}
                known: dict[str, list[str]] = {}  # beginnings of the words of these texts
                part = frame.iloc[at : at + 500]
                for text, y in zip(part["text"], part["label"] > 0, strict=True):
                    near, every = set(), set()
                    for clause in _CLAUSE_END.split(lowered(text)):
                        words = _WORD.findall(clause)
                        every.update(words)
                        if not TARGETS.isdisjoint(words):
                            near |= _near_target(words)
                    known.update((w, _beginnings(w)) for w in every if w not in known)
                    for is_near, found in ((False, every), (True, near)):
                        counts[is_near, bool(y)].update(set().union(*map(known.__getitem__, found)))
                for is_near in (False, True):
                    clean, toxic = counts[is_near, False], counts[is_near, True]
                    if keys := list(clean | toxic):
                        yield pd.DataFrame({"near": [is_near] * len(keys), "feature": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]})

    return rows.select("text", "label").mapInPandas(run, "near boolean, feature string, toxic long, clean long").groupBy("near", "feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _learn_arcs(texts: list[tuple[list[list[float]], int, float]]) -> tuple[Arcs, np.ndarray, float]:
    """Arcs, feature weights and bias of the largest likelihood: each arc in turn over a few values, the rest by Newton steps.

    texts: for each the sums by path class of its clauses, its length and its label.
    """
    y = np.array([t[2] for t in texts])
    lengths = np.array([max(1, n) for _, n, _ in texts])
    of_text = np.array([i for i, (c, _, _) in enumerate(texts) for _ in c], int)
    sums = np.array([v for c, _, _ in texts for v in c]).reshape(-1, 16)

    def tried(arcs: Arcs) -> tuple[float, np.ndarray, float]:
        scores, largest = sums @ np.array(arcs.gains()), np.zeros(len(y))
        np.maximum.at(largest, of_text, scores)
        total = np.bincount(of_text, scores, len(y))
        x = np.log1p(np.stack([largest, total, np.bincount(of_text, scores > 0, len(y)), 1000 * total / lengths], axis=1))  # _features()
        w, bias = _logistic(x, y)
        z = np.clip(x @ w + bias, -30, 30)
        return float((np.log1p(np.exp(z)) - y * z).sum() + 0.5 * (w * w).sum()), w, bias

    arcs = Arcs()
    best = tried(arcs)
    for _ in range(2):
        for name, values in (("aimed", (1.0, 1.5, 2.5)), ("denied", (0.0, 0.25, 0.5, 1.0)), ("told", (0.0, 0.3, 0.6, 1.0)), ("threat", (0.0, 0.5, 1.0, 2.0))):
            for v in values:
                other = Arcs(**(vars(arcs) | {name: v}))
                if other != arcs and (found := tried(other))[0] < best[0] - 0.5:  # chance differences change nothing
                    arcs, best = other, found
    return arcs, best[1], best[2]


def held_out_5(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, *, held_out=held_out_5, sample: int = SAMPLE) -> Model:
    common.ship(docs.sparkSession)
    scratch = common.Scratch()
    rows = scratch.keep(_train_rows(docs, labels, "toxic", held_out, sample), "toxic-sample")
    n = {r["y"]: r["n"] for r in rows.groupBy((F.col("label") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        scratch.clear()
        return Model({}, [0.0] * 4, 30.0 if n1 else -30.0)
    # smoothed log odds of the feature, less 1.64 standard errors: rare and common chance hits stay out
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / b) + F.lit(math.log((n0 + 1) / (n1 + 1)))
    scored = _count_features(rows.filter("part < 7")).filter("toxic >= 3").withColumn("weight", odds - 1.64 * F.sqrt(1 / a + 1 / b))
    top = sorted(map(tuple, scored.filter("weight > 1.2").select("near", "feature", "weight").collect()))  # words of the sample at most
    lexicon = {f: w for near, f, w in top if not near}
    model = Model(lexicon, [0.0] * 4, 0.0, {f: w for near, f, w in top if near and f not in lexicon})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [[[sums.get(k, 0.0) for k in range(16)] for *_, sums in model.matched(t)] if t else [] for t in frame["text"]]
            yield pd.DataFrame({"clauses": found, "length": [len(t) for t in frame["text"]], "y": (frame["label"] > 0).astype(float)})

    data = rows.filter("part >= 7").select("text", "label").mapInPandas(run, "clauses array<array<double>>, length long, y double").collect()
    scratch.clear()
    if len({r["y"] for r in data}) < 2:
        return Model(lexicon, [0.5] * 4, math.log(n1 / n0), model.threats)
    arcs, w, bias = _learn_arcs(sorted(([list(c) for c in r["clauses"]], r["length"], r["y"]) for r in data))
    return Model(lexicon, [float(v) for v in w], bias, model.threats, arcs)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_clauses, worst_start, worst_end (the clause with the highest score; null: none)."""

    names = ["doc_id", "score", "predicted", "n_clauses", "worst_start", "worst_end"]
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = model.clauses(text) if text else []
                worst = max(found, key=lambda c: (c[2], -c[0])) if found else (None, None, 0.0)
                p = model.score(model.features_of(found, text))
                out.append((p, int(p >= 0.5), len(found), worst[0], worst[1]))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names=names)

    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, n_clauses long, worst_start long, worst_end long")


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model calls toxic; all columns stay."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(model.features(t or "")) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out_5(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_clauses", "worst_start", "worst_end")
