"""Operator 3: a gated recurrent language model over words, with a class-factored softmax.

P(word | history) = P(class | state) * P(word | class, state): two softmaxes over the state of a gated recurrent unit in numpy
that reads the words so far. The state is carried through the whole document. The SHORT most frequent words of the training
documents have vectors of their own and belong to CLASSES classes, runs of the order of frequency of about the same sum of roots of
counts; the end is a class by itself. All other words share one class, TAIL, and one vector; within it the training counts
tell them apart, (c + 1) / (N + V + 1) over the tail. Softmaxes begin as the training documents' frequencies.

Training learns from every word of every training document, by truncated backpropagation: documents follow each other in STREAMS
streams whose state goes on from word to word, and after every STEPS words the gradient of all of them is taken. The first WARM
words (drawn over the whole table; all, if there are fewer) train one unit in one task, PASSES times. The other documents come,
once, in rounds, each GROWTH times as large as the one before: in a round every task trains the
unit it is given on its own part of the table, and the changes of all tasks are averaged by the words they were learned from,
in a tree of groups of FAN. So what is learned grows with the corpus, while what is broadcast, sent to the driver or held by a task is a
unit and HEAD counts at most.

Null and empty texts are the end alone. Rows that repeat count each time and are scored each time. Without a training document,
all words are unknown and base_score is the length times log10(1 / 1). Columns other than doc_id and text are left behind.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, saved, sliced, strings, texts

HEAD, SHORT, CLASSES = 200_000, 4_096, 64
HIDDEN, STEPS, STREAMS = 32, 32, 128
WARM, PASSES, GROWTH, FAN = 600_000, 2, 16, 6
RATES = (0.01, 0.005)  #: of the first words, at their beginning, and of all rounds
EPSILON = 1e-7
PIECE = 16_384  #: weights that a step of training moves at a time
TOGETHER = 2_000_000  #: words that a task holds at a time, but for a longer document
END, TAIL = 0, 1  #: classes; runs of words follow
FINE = 4_096  #: counts below it are levels of their own
FLUSH = 400_000  #: distinct words that a worker counts before it hands them on


def words(text: str) -> list[bytes]:
    """Words between the white space of ASCII, its capitals in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def count_words(rows: DataFrame) -> DataFrame:
    """token and c over the texts; the end is the empty token."""

    def run(batches):
        held: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])
            held.clear()
            return got

        for b in sliced(batches, "text", 2 << 20):
            for t in strings(b.column("text")):
                held.update(words(t))
            held[b""] += b.num_rows
            if len(held) > FLUSH:
                yield out()
        if held:
            yield out()

    return rows.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def classes_of(counts: np.ndarray, count: int = CLASSES) -> np.ndarray:
    """The first word of each class and the end of the last, for counts in falling order; the first word is the end's."""
    root = np.sqrt(np.maximum(counts[1:], 1.0))
    place = np.minimum((np.cumsum(root) - root / 2) / max(root.sum(), 1e-9) * count, count - 1).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    return np.r_[0, 1 + new, len(counts)]


def sums(rows: np.ndarray, first: np.ndarray, few: int = 12) -> np.ndarray:
    """The sum of each run of rows, that begin at `first`: long runs one by one, the others side by side. reduceat takes several
    times as long."""
    size = np.diff(first, append=len(rows))
    out = rows[first]
    ones = np.ones(size.max(initial=0), rows.dtype)
    for i in np.flatnonzero(size > few).tolist():
        out[i] = ones[: size[i]] @ rows[first[i] : first[i] + size[i]]
    left = np.flatnonzero((size > 1) & (size <= few))
    for k in range(1, few):
        left = left[size[left] > k]
        if not len(left):
            break
        out[left] += rows[first[left] + k]
    return out


class Room:
    """Arrays that every step fills anew. They are kept from step to step, as fresh memory costs more than what is done in it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        """An array of any contents, which the next call by this name may hand out again."""
        n, found = math.prod(shape), self.held.get(name)
        if found is None or found.size < n or found.dtype != kind:
            found = self.held[name] = np.empty(n, kind)
        return found[:n].reshape(shape)

    def __reduce__(self):
        return Room, ()


class Unit:
    """Gated recurrent unit from words to words; word len(counts) stands for all others."""

    def __init__(self, counts: np.ndarray, others: float = 1.0, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 3):
        r = np.random.default_rng(seed)
        scale = 1 / math.sqrt(hidden)
        self.first = classes_of(counts, classes)
        n, k = len(counts), len(self.first) - 1
        #: Class of each word: that of the end is 0, of all others 1, then the runs.
        self.klass = np.repeat(np.r_[END, np.arange(2, k + 1)], np.diff(self.first))
        self.klass = np.append(self.klass, TAIL)
        shares = np.bincount(self.klass, np.append(np.maximum(counts, 0.5), max(others, 0.5)), minlength=k + 1)
        self.p = {
            "x": r.normal(0, 0.1, (n + 1, 3 * hidden)),  # what a word adds to update, reset and new state
            "u": r.normal(0, scale, (hidden, 2 * hidden)),
            "n": r.normal(0, scale, (hidden, hidden)),
            "o": r.normal(0, 0.1 * scale, (hidden, k + 1)),
            "b": np.log(shares / shares.sum()),
            "w": r.normal(0, 0.1 * scale, (n, hidden)),
            "c": np.log(np.maximum(counts, 0.5)),
        }
        self.p = {key: v.astype(np.float32) for key, v in self.p.items()}
        self.hidden, self.room = hidden, Room()

    def copy(self) -> Unit:
        other = object.__new__(Unit)
        other.__dict__ = {**self.__dict__, "p": {k: v.copy() for k, v in self.p.items()}, "room": Room()}
        return other

    def step(self, h: np.ndarray, given: np.ndarray) -> np.ndarray:
        """The next states; after an end the state starts anew."""
        k, p = self.hidden, self.p
        if (ended := given == 0).any():
            h = h * ~ended[:, None]
        x = p["x"][given]
        g = h @ p["u"]
        g += x[:, : 2 * k]
        sigmoid(g)
        n = (g[:, k:] * h) @ p["n"]
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        n -= h
        n *= g[:, :k]
        n += h
        return n

    def sorted_runs(self, klass: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Places by class, and for each class of several words that occurs its part of them and its first and last word."""
        order = np.argsort(klass.astype(np.uint16), kind="stable")
        at = np.searchsorted(klass[order], np.arange(len(self.first) + 1)).tolist()
        first = self.first.tolist()
        found = [(at[c], at[c + 1], first[c - 1], first[c]) for c in range(2, len(first)) if at[c] < at[c + 1] and first[c] - first[c - 1] > 1]
        return order, found

    def scores(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each target."""
        p, klass, row = self.p, self.klass[target], np.arange(len(target))
        z = states @ p["o"]
        z += p["b"]
        out = z[row, klass]
        out -= _log_sum(z)
        order, found = self.sorted_runs(klass)
        if found:  # what lies before the first or after the last is of classes of one word
            order = order[found[0][0] : found[-1][1]]
        begin, held, word, more = found[0][0] if found else 0, states[order], target[order], np.zeros(len(order), out.dtype)
        for a, b, lo, hi in found:
            a, b = a - begin, b - begin
            z = held[a:b] @ p["w"][lo:hi].T
            z += p["c"][lo:hi]
            np.subtract(z[row[: b - a], word[a:b] - lo], _log_sum(z), out=more[a:b])
        out[order] += more
        return out

    def window(self, h: np.ndarray, given: np.ndarray, target: np.ndarray, weigh: np.ndarray | None = None, grad: dict[str, np.ndarray] | None = None) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Loss a word, last state and gradients of one window; given, target and weigh (0: no loss there): steps x streams. grad:
        gradients that may be written over."""
        k, p, kind = self.hidden, self.p, self.p["u"].dtype
        steps, streams = given.shape

        def room(name: str, *shape: int) -> np.ndarray:
            return self.room(name, shape, kind)

        alive = (given != 0).astype(np.float32)
        whole = alive.all(1).tolist()
        # a column for each stream, so that every part of a step is one piece of memory
        rows = np.take(p["x"], given.ravel(), 0, out=room("rows", steps * streams, 3 * k), mode="clip")
        x = room("x", steps, 3 * k, streams)
        x[:] = rows.reshape(steps, streams, 3 * k).transpose(0, 2, 1)
        from_u, from_n = np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["n"].T)
        h = np.ascontiguousarray(h.T)
        # of every step: the state that it begins with, cut off at ends, its gates, what reset leaves, the new part and its end
        begun, gates, left, new, states = (room(name, steps, n * k, streams) for name, n in (("begun", 1), ("gates", 2), ("left", 1), ("new", 1), ("states", 1)))
        for t in range(steps):
            h0 = np.multiply(h, alive[t], out=begun[t])
            g = np.matmul(from_u, h0, out=gates[t])
            g += x[t, : 2 * k]
            sigmoid(g)
            rh = np.multiply(g[k:], h0, out=left[t])
            n = np.matmul(from_n, rh, out=new[t])
            n += x[t, 2 * k :]
            np.tanh(n, out=n)
            h = np.subtract(n, h0, out=states[t])
            h *= g[:k]
            h += h0
        h = h.T.copy()
        grad = {key: np.empty_like(v) for key, v in p.items()} if grad is None else grad
        for key in ("x", "w", "c"):  # of which a window moves some
            grad[key].fill(0)
        wide = room("wide", steps, streams, k)
        wide[:] = states.transpose(0, 2, 1)
        loss, slopes = self.output(wide.reshape(-1, k), target.ravel(), grad, None if weigh is None else weigh.ravel())
        back = states  # which nothing reads again
        back[:] = slopes.reshape(steps, streams, k).transpose(0, 2, 1)
        # slopes that do not depend on those of later steps
        z = gates[:, :k]
        by_new = np.multiply(new, new, out=room("by_new", steps, k, streams))
        np.subtract(1, by_new, out=by_new)
        by_new *= z
        stay = np.subtract(1, z, out=room("stay", steps, k, streams))
        by_gate = np.subtract(1, gates, out=room("by_gate", steps, 2 * k, streams))
        by_gate *= gates
        new -= begun
        by_gate[:, :k] *= new
        by_gate[:, k:] *= begun
        dh, dx = np.zeros((k, streams), p["u"].dtype), x  # whose values nothing reads again
        for t in range(steps - 1, -1, -1):
            dh += back[t]
            dn = np.multiply(dh, by_new[t], out=dx[t, 2 * k :])
            drh = p["n"] @ dn
            dg = dx[t, : 2 * k]
            np.multiply(dh, by_gate[t, :k], out=dg[:k])
            np.multiply(drh, by_gate[t, k:], out=dg[k:])
            dh *= stay[t]
            drh *= gates[t, k:]
            dh += drh
            dh += p["u"] @ dg
            if not whole[t]:
                dh *= alive[t]
        rows.reshape(steps, streams, 3 * k)[:] = dx.transpose(0, 2, 1)
        turned = room("turned", k, steps, streams)
        for key, part, by in (("n", left, rows[:, 2 * k :]), ("u", begun, rows[:, : 2 * k])):
            turned[:] = part.transpose(1, 0, 2)
            np.matmul(turned.reshape(k, -1), by, out=grad[key])
        order = np.argsort(given.ravel().astype(np.uint16), kind="stable")
        sorted_ = given.ravel()[order]
        first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        grad["x"][sorted_[first]] = sums(np.take(rows, order, 0, out=room("sorted", *rows.shape), mode="clip"), first)
        return loss, h, grad

    def bound(self, states: np.ndarray) -> float:
        """What no logit of these states, of classes or of words, is beyond on either side."""
        p, most = self.p, max(float(states.max(initial=0)), -float(states.min(initial=0)))
        return max(float((most * (np.ones(self.hidden, x.dtype) @ np.abs(x)) + np.abs(b)).max()) for x, b in ((p["o"], p["b"]), (p["w"].T, p["c"])))

    def output(self, states: np.ndarray, target: np.ndarray, grad: dict[str, np.ndarray], weigh: np.ndarray | None) -> tuple[float, np.ndarray]:
        """Loss a word of both softmaxes, and its slope by the states; adds the slopes by the weights to grad."""
        p, klass, row, room, kind = self.p, self.klass[target], np.arange(len(target)), self.room, self.p["o"].dtype
        share = np.full(len(target), 1 / len(target), np.float32) if weigh is None else (weigh / max(1e-9, weigh.sum())).astype(np.float32)
        z = np.matmul(states, p["o"], out=room("z", (len(states), p["o"].shape[1]), kind))
        z += p["b"]
        own = z[row, klass]
        near = self.bound(states) < 60
        ones = np.ones(max(len(target), z.shape[1], int(np.diff(self.first).max())), kind)
        d, total = _soft(z, share, ones, near)
        own -= total
        loss = -float(own @ share)
        d[row, klass] -= share
        np.matmul(states.T, d, out=grad["o"])
        np.matmul(ones[: len(target)], d, out=grad["b"])
        back = np.matmul(d, p["o"].T, out=room("back", states.shape, kind))
        order, found = self.sorted_runs(klass)
        held, word, part = np.take(states, order, 0, out=room("held", states.shape, kind), mode="clip"), target[order], share[order]
        more = room("more", states.shape, kind)
        more.fill(0)
        for a, b, lo, hi in found:
            s, w = held[a:b], p["w"][lo:hi]
            z = np.matmul(s, w.T, out=room("z", (b - a, hi - lo), kind))
            z += p["c"][lo:hi]
            at = (row[: b - a], word[a:b] - lo)
            own = z[at]
            d, total = _soft(z, part[a:b], ones, near)
            own -= total
            loss -= float(own @ part[a:b])
            d[at] -= part[a:b]
            np.matmul(d.T, s, out=grad["w"][lo:hi])
            np.matmul(ones[: b - a], d, out=grad["c"][lo:hi])
            np.matmul(d, w, out=more[a:b])
        more += np.take(back, order, 0, out=held, mode="clip")
        back[order] = more
        return loss, back

    def log_likelihood(self, documents: list[np.ndarray], span: int = 64, most: int = 512) -> np.ndarray:
        """Natural logarithm of each document (its last word is the end), the state carried through all of it. Documents stand one
        after the other in streams of about the same length, as an end starts the state anew."""
        out = np.zeros(len(documents))
        if not documents:
            return out
        # every document has a word, its end
        sizes = np.array([len(d) for d in documents])
        streams = int(np.clip(sizes.sum() // max(1, sizes.max()), min(len(documents), 16), most))
        load = [(0, s) for s in range(streams)]
        own: list[list[int]] = [[] for _ in range(streams)]
        for i in np.argsort(-sizes, kind="stable").tolist():
            n, s = load[0]
            own[s].append(i)
            heapq.heapreplace(load, (n + int(sizes[i]), s))
        own.sort(key=lambda x: -int(sizes[x].sum()))
        stream = [np.concatenate([documents[i] for i in x]) if x else np.zeros(0, np.int32) for x in own]
        length = np.array([len(x) for x in stream])
        found = [np.zeros(n) for n in length]
        h, last = np.zeros((streams, self.hidden), np.float32), np.zeros(streams, np.int32)
        for begin in range(0, int(length[0]), span):
            live = int((length > begin).sum())
            steps = min(span, int(length[0]) - begin)
            block = np.zeros((steps, live), np.int32)
            for s in range(live):
                part = stream[s][begin : begin + steps]
                block[: len(part), s] = part
            states = np.empty((steps, live, self.hidden), np.float32)
            now, before = h[:live], last[:live]
            for t in range(steps):
                states[t] = now = self.step(now, before)
                before = block[t]
            h[:live], last[:live] = now, before
            logs = self.scores(states.reshape(-1, self.hidden), block.ravel()).reshape(block.shape)
            for s in range(live):
                n = min(steps, int(length[s]) - begin)
                found[s][begin : begin + n] = logs[:n, s]
        for s, x in enumerate(own):
            if x:
                out[x] = np.add.reduceat(found[s], np.r_[0, np.cumsum(sizes[x])[:-1]])
        return out


def _log_sum(z: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row; z is used up."""
    if -60 < z.min(initial=0) and z.max(initial=0) < 60:  # far from what overflows
        return np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))
    top = z.max(1)
    return np.log(np.exp(z - top[:, None]).sum(1)) + top


def _soft(z: np.ndarray, share: np.ndarray, ones: np.ndarray, near: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The softmax of each row times its share, in its place, and the logarithm of its sum of exponentials. ones: as many as z has
    columns, at least; near: all of z is known to be far from what overflows."""
    top = 0.0
    if not (near or -60 < z.min(initial=0) and z.max(initial=0) < 60):
        top = z.max(1)
        z -= top[:, None]
    np.exp(z, out=z)
    total = z @ ones[: z.shape[1]]
    z *= (share / total)[:, None]
    return z, np.log(total) + top


class Learner:
    """Adam over what runs through the streams of a unit."""

    def __init__(self, unit: Unit, rate: float, stride: int, streams: int = STREAMS):
        self.unit, self.rate, self.stride = unit, rate, stride
        self.queue: list[deque] = [deque() for _ in range(streams)]
        self.waiting = [(0, s) for s in range(streams)]
        self.held = np.zeros(streams, np.int64)
        self.h = np.zeros((streams, unit.hidden), np.float32)
        self.last = np.zeros(streams, np.int32)
        self.m = {key: np.zeros_like(v) for key, v in unit.p.items()}
        self.v = {key: np.zeros_like(v) for key, v in unit.p.items()}
        self.grad = {key: np.empty_like(v) for key, v in unit.p.items()}
        self.done, self.learned, self.losses = 0, 0, []

    def add(self, document: np.ndarray) -> None:
        """The document goes to the stream that has least to read; whatever all streams have is read."""
        n, s = self.waiting[0]
        heapq.heapreplace(self.waiting, (n + len(document), s))
        self.queue[s].append(document)
        self.held[s] += len(document)
        if (self.held >= self.stride).all():
            self.read(np.arange(len(self.queue)), self.stride)

    def finish(self) -> None:
        """Read what is left; streams that have nothing left drop out."""
        while len(live := np.flatnonzero(self.held)):
            self.read(live, self.stride)

    def read(self, live: np.ndarray, n: int) -> None:
        own, held = np.zeros((len(live), n), np.int32), np.minimum(self.held[live], n)
        for row, s in zip(own, live.tolist(), strict=True):
            queue, got = self.queue[s], 0
            while got < n and queue:
                d = queue.popleft()
                if got + len(d) > n:
                    queue.appendleft(d[n - got :])
                    d = d[: n - got]
                row[got : got + len(d)] = d
                got += len(d)
        self.held[live] -= held
        block, weigh = own.T.copy(), (np.arange(n)[:, None] < held).astype(np.float32)
        given = np.concatenate([self.last[live][None], block[:-1]])
        h = self.h[live]
        used = int(weigh.any(1).sum())  # beyond, no stream has a word
        ahead = max(0, used - STEPS)
        for t in range(ahead):
            h = self.unit.step(h, given[t])
        h = self.update(h, given[ahead:used], block[ahead:used], weigh[ahead:used])
        self.h[live], self.last[live] = h, block[used - 1]

    def update(self, h: np.ndarray, given: np.ndarray, target: np.ndarray, weigh: np.ndarray) -> np.ndarray:
        loss, h, grad = self.unit.window(h, given, target, weigh, self.grad)
        size = math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        self.done += 1
        pace = self.rate * float(weigh.sum()) / (STEPS * len(self.queue))  # what few streams are left with moves little
        clip, root, step = min(1.0, 1.0 / (size + 1e-9)) * 0.1, 1 / (1 - 0.99**self.done), pace / (1 - 0.9**self.done)
        for key, all_g in grad.items():
            flat = [x.reshape(-1) for x in (all_g, self.m[key], self.v[key], self.unit.p[key])]
            for at in range(0, all_g.size, PIECE):  # so much stays in a core's cache
                g, m, v, weights = (x[at : at + PIECE] for x in flat)
                g *= clip
                m *= 0.9
                m += g
                g *= g  # a hundredth of the square
                v *= 0.99
                v += g
                np.multiply(v, root, out=g)
                np.sqrt(g, out=g)
                g += EPSILON
                np.divide(m, g, out=g)
                g *= step
                weights -= g
        self.learned += int(weigh.sum())
        self.losses.append(loss)
        return h


@dataclass
class Model:
    head: dict[bytes, int]
    counts: np.ndarray  #: of head words
    unit: Unit
    n: int
    v: int

    @property
    def short(self) -> int:
        """Head words that the unit knows by themselves."""
        return min(SHORT, len(self.counts))

    @property
    def tail(self) -> float:
        """What counts within the tail are divided by."""
        return self.n - float(self.counts[: self.short].sum()) + max(0, self.v - self.short) + 1


def level() -> Column:
    """A step of frequency: one for each count below FINE, then 64 for each doubling; a few thousand whatever the corpus."""
    return F.when(F.col("c") < FINE, F.col("c")).otherwise(FINE + F.floor(64 * F.log2(F.col("c") / FINE))).cast("int")


def head_level(counts: DataFrame) -> int:
    """The lowest level from which on there are fewer than HEAD words. Words of one level go to the head or not together."""
    steps = counts.filter("length(token) > 0").groupBy(level().alias("level")).count().collect()
    least, held = FINE * 64, 0
    for r in sorted(steps, reverse=True):
        held += r["count"]
        if held >= HEAD:
            break
        least = r.level
    return least


def begun(counts: DataFrame) -> Model:
    """The model before any training: frequencies alone. counts: of all words of the training documents."""
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = sorted(counts.filter("length(token) > 0").filter(level() >= head_level(counts)).collect(), key=lambda r: (-r.c, r.token))  # HEAD rows at most
    ends = counts.filter("length(token) = 0").collect()
    entries = [(b"", int(ends[0].c) if ends else 0)] + [(bytes(r.token), int(r.c)) for r in top]
    c = np.array([x for _, x in entries], float)
    n = int(totals.n or 0)
    return Model({t: i for i, (t, _) in enumerate(entries)}, c, Unit(c[:SHORT], n - c[:SHORT].sum()), n, int(totals.v))


def encoded(rows: DataFrame, model: Model) -> DataFrame:
    """Of every row, all that words alone decide: n_tokens, n_known and base over head words, what words of the head add within
    the tail, the unit's word numbers (two bytes each, as SHORT allows), and the words that the head lacks."""
    shared = rows.sparkSession.sparkContext.broadcast((model.head, model.counts, model.short, model.tail, model.n))  # HEAD words

    def run(batches):
        head, counts, short, tail, n_all = shared.value
        get = head.get
        known = np.append(np.log10(counts + 1), 0.0)
        inside = np.append(np.log10(counts + 1) - math.log10(tail), 0.0)
        inside[:short] = 0.0
        for b in sliced(batches, "text", 4 << 20):
            n, n_known, base, within, ids, tails = [], [], [], [], [], []
            for t in strings(b.column("text")):
                w = words(t)
                i = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
                i = np.append(i, 0)
                n.append(len(i))
                n_known.append(int((i >= 0).sum() if n_all else 0))
                base.append(float(known[i].sum()))
                within.append(float(inside[i].sum()))
                ids.append(np.where((i < 0) | (i >= short), short, i).astype("<u2").tobytes())
                tails.append([w[k] for k in np.flatnonzero(i < 0).tolist()])
            columns = [b.column("doc_id"), b.column("held_out"), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(within), pa.array(ids, pa.binary()), pa.array(tails, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "ids", "tails"])

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, ids binary, tails array<binary>"
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id())


def arrays(column: pa.Array) -> list[np.ndarray]:
    """The word numbers of each document."""
    return [np.frombuffer(x.as_buffer(), "<u2") for x in column]


CHANGE = "task int, learned long, change binary"
_CHANGE = pa.schema([("task", pa.int32()), ("learned", pa.int64()), ("change", pa.binary())])


def changes(part: DataFrame, unit: Unit, rate: float, stride: int, passes: int) -> DataFrame:
    """What each task learns from its documents: how many words, and by how much the unit's weights have moved."""
    shared = part.sparkSession.sparkContext.broadcast(unit)

    def run(batches):
        from pyspark import TaskContext

        own = shared.value
        learner, again = Learner(own.copy(), rate, stride), []
        held, n = [], 0

        def read() -> None:
            # the longest first, so that streams end at about the same time
            for d in sorted(held, key=len, reverse=True):
                learner.add(d)
            if passes > 1:  # of the first words alone
                again.extend(held)
            held.clear()

        for b in sliced(batches, "ids", 2 * TOGETHER):
            held += arrays(b.column("ids"))
            n += b.column("ids").nbytes // 2
            if n >= TOGETHER:
                read()
                n = 0
        read()
        learner.finish()
        for k in range(1, passes):
            learner.rate = rate / 2**k
            for d in again:
                learner.add(d)
            learner.finish()
        if learner.learned:
            moved = np.concatenate([(learner.unit.p[key] - v).ravel() for key, v in own.p.items()])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([learner.learned]), pa.array([moved.astype("<f4").tobytes()], pa.binary())], schema=_CHANGE)

    return part.select("ids").mapInArrow(run, CHANGE)


def averaged(found: DataFrame, unit: Unit) -> Unit:
    """The unit moved by the mean of the tasks' changes, weighed by the words that they are from."""

    def mean(t: pa.Table) -> pa.Table:
        n = t.column("learned").to_numpy()
        total = sum(np.frombuffer(c.as_buffer(), "<f4").astype(float) * w for c, w in zip(t.column("change"), n.tolist(), strict=True)) / n.sum()
        return pa.Table.from_arrays([t.column("task").slice(0, 1), pa.array([int(n.sum())]), pa.array([total.astype("<f4").tobytes()], pa.binary())], schema=_CHANGE)

    tasks = int(found.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        found = found.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("task").applyInArrow(mean, CHANGE)  # FAN units
        tasks = -(-tasks // FAN)
        if tasks == 1:
            break
    one = found.collect()
    out = unit.copy()
    if one:
        moved, at = np.frombuffer(one[0].change, "<f4"), 0
        for key, v in out.p.items():
            out.p[key] = v + moved[at : at + v.size].reshape(v.shape)
            at += v.size
    return out


def rounds(rows: DataFrame, total: int) -> list[tuple[DataFrame, float, int, int]]:
    """The rows of each round with its rate, stride and passes. A row's round is drawn by where it stands in the table, which
    reading it again does not change; every row is in one round."""
    place = rows.withColumn("_u", F.rand(7))
    hi = min(1.0, WARM / max(1, total))
    # about WARM words, in an order that does not depend on how they came
    first = place.filter(F.col("_u") < hi).select("ids").repartition(1).sortWithinPartitions(F.xxhash64("ids"))
    parts, size = [(first, RATES[0], STEPS, PASSES)], hi
    while hi < 1:
        lo, size = hi, size * GROWTH
        hi = 1.0 if lo + size > 0.9 else lo + size
        parts.append((place.filter((F.col("_u") >= lo) & (F.col("_u") < hi)).select("ids"), RATES[1], STEPS, 1))
    return parts


def trained(rows: DataFrame, unit: Unit, total: int) -> Unit:
    """The unit after all training documents (ids)."""
    for part, rate, stride, passes in rounds(rows, total):
        found = saved(changes(part, unit, rate, stride, passes), "changes")
        unit = averaged(found, unit)
        dropped(found)
    return unit


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; held_out: over the columns of docs."""
    spark = docs.sparkSession
    rows = texts(docs.select("doc_id", "text")).withColumn("held_out", held_out)
    counts = saved(count_words(rows.filter(~F.col("held_out"))), "counts")
    model = begun(counts)
    all_ = saved(encoded(rows, model), "encoded")  # row numbers hold once written
    unit = trained(all_.filter(~F.col("held_out")).select("ids"), model.unit, model.n)
    shared = spark.sparkContext.broadcast(unit)

    def run(batches):
        own = shared.value
        held, n = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            logs = own.log_likelihood(arrays(table.column("ids"))) / math.log(10)
            held.clear()
            return pa.RecordBatch.from_arrays([*(table.column(c) for c in PASSED), pa.array(logs)], names=[*PASSED, "model"])

        for b in sliced(batches, "ids", 2 * TOGETHER):
            held.append(b)
            n += b.column("ids").nbytes // 2
            if n >= TOGETHER:
                yield flush()
                n = 0
        if held:
            yield flush()

    scored = all_.select(*PASSED, "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, model double")
    head = spark.createDataFrame([(t,) for t in model.head], "token binary") if model.n else None
    tail_counts = counts.join(F.broadcast(head), "token", "left_anti") if head is not None else counts  # HEAD words
    tails = all_.select("row", F.explode("tails").alias("token")).join(tail_counts, "token", "left")
    tails = tails.groupBy("row").agg(F.count("*").alias("t_n"), F.count("c").alias("t_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("t_log"))
    both = scored.join(tails, "row", "left").fillna(0, ["t_n", "t_known", "t_log"])
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("t_known")).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("t_log") - F.col("n_tokens") * math.log10(model.n + model.v + 1)).alias("base_score"),
        (F.col("model") + F.col("inside") + F.col("t_log") - F.col("t_n") * math.log10(model.tail)).alias("score"),
    )


PASSED = ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside")
