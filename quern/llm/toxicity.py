"""Operator 2: toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes: insult, threat, target, negation, report, other. Weighted transducers rewrite it:
the target transducers mark insults and threats near an addressed person, the negation transducer those that a negation
precedes, the report transducers those that the clause attributes to a speaker. Context to the right is the work of
transducers that read the clause from its end ("kill you", "..." he said); they are composed into one machine, those for
context to the left ("you idiot", don't kill) into another that reads what the first has written. Arcs that mark a word carry
a weight, added up along the path, which scales what the word counts for. What comes out is counted by kind, clause by clause,
and a logistic model over the matched clauses of a text weighs the kinds.

The insult lexicon (beginnings of words, whole words among them, as languages inflect and compound) and the logistic weights are
learned from labelled rows, SAMPLE of them and SAMPLE_CHARS characters at most; threats, targets, negations and reports are
closed classes, listed below. Insults that a clause negates or reports, and threats, start from a prior and move as far as the
labels say. A threat without a target counts for nothing.

Null and empty texts have no matched clause and score the model's base rate. Labels without a document, documents without a
label, null labels and repeated labels (the largest counts) are accepted; equal texts are learned from once; without any toxic
label all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quern.llm.common import sliced, strings, texts

# Closed classes: fixed word lists.
TARGETS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre usted ustedes ti".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn hang töten umbringen schlagen tuer frapper matar golpear".split())
NEGATIONS = frozenset("not never no none neither nor cannot nicht kein keine nie pas jamais aucun nunca ningún".split())
REPORTS = frozenset("said says told called claims claimed wrote quoted alleged sagte sagt nannte dit disait appelé dijo llamó".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "OITSNR"
WORD = re.compile(r"[^\W\d_]+n['’]t(?![^\W\d_])|[^\W\d_]+")
#: Ends of clauses; a sign before a closing quotation mark ends what is quoted, not the clause.
BREAKS, QUOTES = ".!?;:\n", "\"'”“’»«"
BREAK = re.compile(rf"[{re.escape(BREAKS)}](?![{QUOTES}])")
#: Rows to learn from, at most, and their characters: the labelled texts with the smallest hashes of doc_id.
SAMPLE, SAMPLE_CHARS = 8_000, 100_000_000
#: A beginning enters the lexicon with this many occurrences in toxic texts, this likelihood ratio statistic, and this many times
#: the rate that it has in other texts; at most so many enter.
SUPPORT, EVIDENCE, RATIO, ENTRIES = 6, 40.0, 6.0, 200
LENGTHS = range(3, 13)
REACH = 4  #: words over which a target or a negation acts


#: Weights of the arcs that mark a word, as logarithms of a factor: at a target, negated, reported.
AIMED, NEGATED, REPORTED = math.log(2.0), math.log(0.25), math.log(0.25)


@dataclass
class Transducer:
    """Deterministic and weighted: step[state][symbol] = (next state, symbol out, weight). A symbol without an arc passes and
    keeps the state."""

    step: list[dict[str, tuple[int, str, float]]]

    def move(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.step[state].get(symbol, (state, symbol, 0.0))

    def run(self, symbols: str) -> tuple[str, list[float]]:
        """What it writes for a string, and the weight of each symbol."""
        state, out, weights = 0, [], []
        for s in symbols:
            state, o, w = self.move(state, s)
            out.append(o)
            weights.append(w)
        return "".join(out), weights


def after(cue: str, marks: dict[str, str], reach: int, symbols: str, weight: float) -> Transducer:
    """Rewrites `marks` where they follow a cue by `reach` symbols at most (0: any number); such arcs have the weight."""
    states: list[dict[str, tuple[int, str, float]]] = []
    for k in range((reach or 1) + 1):
        left = (k - 1 if reach else k) if k else 0
        arcs = {s: (left, marks[s], weight) if k and s in marks else (left, s, 0.0) for s in symbols}
        arcs[cue] = (reach or 1, cue, 0.0)
        states.append(arcs)
    return Transducer(states)


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """One machine that feeds the output of the first to the second, with the sum of their weights; only states that can be
    reached."""
    number = {(0, 0): 0}
    step: list[dict[str, tuple[int, str, float]]] = []
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop(0)
        arcs = {}
        for s in symbols:
            a2, middle, u = first.move(a, s)
            b2, out, w = second.move(b, middle)
            if (a2, b2) not in number:
                number[a2, b2] = len(number)
                todo.append((a2, b2))
            arcs[s] = (number[a2, b2], out, u + w)
        step.append(arcs)
    return Transducer(step)


AIM = {INSULT: "J", THREAT: "U"}


def grammar() -> tuple[Transducer, Transducer]:
    """The machine that reads a clause from its end, and the one that reads what that has written from the beginning. Symbols
    out: I T plain, J U at a target, n negated, r reported."""
    read, found = "OITSNR", "IJTU"
    back = after(TARGET, AIM, REACH, read, AIMED)
    back = compose(back, after(REPORT, {s: "r" for s in found}, 0, read + "JU", REPORTED), read)
    inner = read + "JUr"
    ahead = after(TARGET, AIM, REACH, inner, AIMED)
    ahead = compose(ahead, after(NEGATION, {s: "n" for s in found}, REACH, inner, NEGATED), inner)
    return back, compose(ahead, after(REPORT, {s: "r" for s in found + "n"}, 0, inner + "n", REPORTED), inner)


def rewritten(machines: tuple[Transducer, Transducer], symbols: str) -> tuple[str, list[float]]:
    """A clause of word classes through both machines: symbols out and their weights."""
    back, ahead = machines
    middle, u = back.run(symbols[::-1])
    out, w = ahead.run(middle[::-1])
    return out, [a + b for a, b in zip(reversed(u), w, strict=True)]


#: Kinds that a clause counts; a threat without a target counts for nothing.
KINDS = "IJUnr"
#: Weights before any label is seen, of the logarithm of one more than: the summed lexicon weight of each kind, that of all
#: kinds scaled by the weights of their paths, and the latter by 1,000 characters.
PRIOR = np.array([0.5, 1.0, 0.5, -0.5, -0.5, 2.0, 1.0])


class Matcher:
    """Finds the clauses that hold an insult or a threat, and runs the machine over them."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.machines = grammar()
        self.known: dict[str, tuple[str, list[float]]] = {}  # rewritten clauses; few are long, and they repeat
        begun = "|".join(map(re.escape, sorted(stems, key=len, reverse=True)))
        self.seek = re.compile(rf"\b(?:(?:{'|'.join(sorted(THREATS))})\b{'|' if begun else ''}{begun})")

    def weight(self, word: str) -> float:
        return next((v for k in reversed(LENGTHS) if len(word) >= k and (v := self.stems.get(word[:k]))), 0.0)

    def classify(self, words: list[str]) -> tuple[str, list[float]]:
        """The class of each word and its lexicon weight."""
        symbols, weights = [], []
        for w in words:
            v = self.weight(w)
            s = INSULT if v else THREAT if w in THREATS else TARGET if w in TARGETS else NEGATION if w in NEGATIONS or w[-2:] in ("'t", "’t") else REPORT if w in REPORTS else OTHER
            symbols.append(s)
            weights.append(v or 1.0)
        return "".join(symbols), weights

    def clause(self, words: list[str]) -> tuple[list[float], float]:
        """Summed lexicon weight by kind, and of all kinds scaled by the weights of their paths."""
        symbols, weights = self.classify(words)
        if symbols not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[symbols] = rewritten(self.machines, symbols)
        own, scaled = [0.0] * len(KINDS), 0.0
        for out, path, v in zip(*self.known[symbols], weights, strict=True):
            if (k := KINDS.find(out)) >= 0:
                own[k] += v
                scaled += v * math.exp(path)
        return own, scaled

    def features(self, text: str) -> list[float]:
        low = text.lower()
        total, found = [0.0] * len(KINDS), 0.0
        done = -1
        for hit in self.seek.finditer(low):
            if hit.start() < done:
                continue
            start = begin(low, hit.start())
            end = m.start() if (m := BREAK.search(low, hit.end())) else len(low)
            done = end
            own, scaled = self.clause(WORD.findall(low, start, end))
            total = [a + b for a, b in zip(total, own, strict=True)]
            found += scaled
        density = 1000.0 * found / (len(low) + 200) if found else 0.0
        return [*(math.log1p(x) for x in total), math.log1p(found), math.log1p(density)]


def begin(text: str, at: int) -> int:
    """Where the clause around a place begins."""
    while (k := max(text.rfind(c, 0, at) for c in BREAKS)) >= 0 and text[k + 1 : k + 2] and text[k + 1] in QUOTES:
        at = k
    return k + 1


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    bias: float
    weights: tuple[float, ...]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + rows @ np.array(self.weights))))


def lexicon(docs: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Beginnings of words that toxic texts have far more often, with the logarithm of how much. One enters after the other,
    that with the largest likelihood ratio statistic first, the longest of several that cover the same words; words that it
    covers count for no other."""
    counts: dict[str, list[int]] = {}
    total = [0, 0]
    for text, t in zip(docs, toxic.tolist(), strict=True):
        words = set(WORD.findall(text.lower()))  # a line that one text repeats says no more than once
        total[t] += len(words)
        for w in words:
            counts.setdefault(w, [0, 0])[t] += 1
    n0, n1 = total[0] + 1, total[1] + 1
    sums: dict[str, list[int]] = {}
    members: dict[str, list[str]] = {}
    for w, (c0, c1) in counts.items():
        if c1:
            for k in LENGTHS:
                if len(w) >= k:
                    s = sums.setdefault(w[:k], [0, 0])
                    s[0] += c0
                    s[1] += c1
    for w, (c0, c1) in counts.items():
        if not c1:
            for k in LENGTHS:
                if len(w) >= k and w[:k] in sums:
                    sums[w[:k]][0] += c0
    live = {p: s for p, s in sums.items() if s[1] >= SUPPORT and s[1] / n1 >= RATIO * s[0] / n0}
    for w, (_, c1) in counts.items():
        if c1:
            for k in LENGTHS:
                if len(w) >= k and w[:k] in live:
                    members.setdefault(w[:k], []).append(w)

    def statistic(c0: int, c1: int) -> float:
        if c1 < SUPPORT or c1 / n1 < RATIO * c0 / n0:
            return 0.0
        e = (c0 + c1) / (n0 + n1)
        return 2 * (c1 * math.log(c1 / (n1 * e)) + (c0 * math.log(c0 / (n0 * e)) if c0 else 0.0))

    found: dict[str, float] = {}
    while live and len(found) < ENTRIES:
        best = max(live, key=lambda p: (round(statistic(*live[p]), 6), len(p), p))
        c0, c1 = live[best]
        if statistic(c0, c1) < EVIDENCE:
            break
        found[best] = math.log((c1 + 0.5) / n1) - math.log((c0 + 0.5) / n0)
        for w in members[best]:
            x0, x1 = counts.pop(w, (0, 0))
            for k in LENGTHS:
                if len(w) >= k and w[:k] in live:
                    live[w[:k]][0] -= x0
                    live[w[:k]][1] -= x1
        live.pop(best)
    return found


def learn(docs: list[str], labels: list[int]) -> Model:
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all():
        return Model({}, 20.0 if len(toxic) and toxic.all() else -20.0, (0.0,) * len(PRIOR))
    stems = lexicon(docs, toxic)
    matcher = Matcher(stems)
    x = np.array([matcher.features(t) for t in docs])
    w, b, y = PRIOR.copy(), -3.0, toxic.astype(float)
    design = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(40):  # Newton's steps on the likelihood with a normal prior around PRIOR
        p = 1 / (1 + np.exp(-np.clip(design @ [*w, b], -30, 30)))
        pull = np.array([0.3] * len(PRIOR) + [0.02])
        gradient = design.T @ (p - y) + pull * (np.array([*w, b]) - [*PRIOR, -3.0])
        step = np.linalg.solve((design * (p * (1 - p) + 1e-6)[:, None]).T @ design + np.diag(pull), gradient)
        size = min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        w, b = w - size * step[:-1], b - size * float(step[-1])
    return Model(stems, b, tuple(w.tolist()))


def training_rows(docs: DataFrame, labels: DataFrame, use) -> list[tuple[str, int]]:
    """Texts and labels to learn from: of labelled rows for which `use` holds, SAMPLE with the smallest hashes, equal texts once
    (toxic, if one of them is), as many of them in that order as have SAMPLE_CHARS characters together."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null")
    chosen = named.filter(use).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE rows of two numbers are broadcast; rows that repeat an id, however many, are one again before they are ordered
    found = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min(F.xxhash64("doc_id")).alias("h"))
    found = found.withColumn("key", F.struct("h", F.md5("text")))
    sizes = found.select("key", F.length("text").alias("n")).orderBy("key").limit(SAMPLE).collect()  # numbers and hashes
    held, last = 0, None
    for r in sizes:
        held += r.n
        if held > SAMPLE_CHARS:
            break
        last = r.key
    if last is None:
        return []
    edge = F.struct(F.lit(last[0]), F.lit(last[1]))
    return sorted((r.text, r.toxic) for r in found.filter(F.col("key") <= edge).select("text", "toxic").collect())


def fit(docs: DataFrame, labels: DataFrame, use) -> Model:
    rows = training_rows(docs, labels, use)
    return learn([t for t, _ in rows], [int(v > 0) for _, v in rows])


def score(df: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """All columns of df, then score and predicted. Columns of df with these names give way."""
    keep = df.drop("score", "predicted")
    schema = StructType([*keep.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        matcher = Matcher(model.stems)
        for b in sliced(batches, "text"):
            p = model.score(np.array([matcher.features(t) for t in strings(b.column("text"))], float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32), pa.int32())], names=[*b.schema.names, "score", "predicted"])

    return keep.mapInArrow(run, schema)


def clean(df: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of df that score below `cut`, with all of its columns as they are."""

    def run(batches):
        matcher = Matcher(model.stems)
        for b in sliced(batches, "text"):
            p = model.score(np.array([matcher.features(t) for t in strings(b.column("text"))], float))
            yield b.filter(pa.array(p < cut))

    return df.mapInArrow(run, df.schema)
