"""Operator 8: secret scans through a trigram index.

For every rule a Boolean query over trigrams is derived from its pattern: whatever the pattern matches holds them. Each Arrow
batch of documents gets an inverted index of the trigrams asked for; the postings of a query's trigrams are intersected and
united as it says, and only the documents that remain are searched with the pattern. A rule without mandatory trigrams
searches every document.

Null and empty texts have no spans. Repeated rows give repeated rows. Spans count code points, end exclusive; matches of one
kind don't overlap, those of different kinds may.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import sliced, strings, texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  #: the part that must have `least` characters
    least: int = 1
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The base kinds, in the order in which spans that start together are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Formats that issuers document for their keys.
ISSUED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE + ISSUED
#: Sets of exact strings grow by products up to this size; beyond, what is known so far becomes part of the query.
EXACT = 64
#: Bytes of text that get an index together, and trigrams that are looked up at once: a lookup takes some 20 bytes for each.
SLICE, BLOCK = 2 << 20, 1 << 18

# A query is True (every document), a trigram, ("and", ...) or ("or", ...).


def conjunction(parts) -> object:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", *kept)


def disjunction(parts) -> object:
    kept = list(dict.fromkeys(parts))
    return True if not kept or True in kept else kept[0] if len(kept) == 1 else ("or", *kept)


def of_strings(found: set[str]) -> object:
    """A document that holds one of the strings holds all trigrams of it."""
    return disjunction(conjunction(w[i : i + 3] for i in range(len(w) - 2)) for w in sorted(found))


def derive(nodes) -> tuple[set[str] | None, object]:
    """The strings that a parsed pattern matches, if few, and the query of what else it demands; all in lower case."""
    exact: set[str] | None = {""}
    demands: list[object] = []
    open_end = False  # what precedes `exact` is unknown

    def close() -> None:
        nonlocal exact
        if exact:
            demands.append(of_strings(exact))
        exact = {""}

    for op, arg in nodes:
        if op is sre.LITERAL:
            own, query = {chr(arg).lower()}, True
        elif op is sre.IN and not any(o in (sre.NEGATE, sre.CATEGORY) for o, _ in arg) and sum(1 if o is sre.LITERAL else a[1] - a[0] + 1 for o, a in arg) <= 8:
            own, query = {chr(c).lower() for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1))}, True
        elif op is sre.SUBPATTERN:
            own, query = derive(arg[3])
        elif op is sre.BRANCH:
            each = [derive(x) for x in arg[1]]
            if all(e is not None for e, _ in each) and sum(len(e) for e, _ in each) <= EXACT:
                own, query = set().union(*(e for e, _ in each)), True
            else:
                own, query = None, disjunction(conjunction([q, of_strings(e) if e else True]) for e, q in each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, query = derive(body)
            if (low, high) == (0, 1) and inner is not None:
                own, query = {"", *inner}, True
            elif low == 0:
                own, query = None, True
            else:  # once at least; how often is not followed
                own, query = None, conjunction([query, of_strings(inner) if inner else True])
        elif op is sre.AT:
            own, query = {""}, True
        else:
            own, query = None, True
        demands.append(query)
        if own is None:
            close()
            open_end = True
        elif len(exact) * len(own) > EXACT:
            close()
            open_end, exact = True, own
        else:
            exact = {a + b for a, b in product(exact, own)}
    if open_end:
        close()
        return None, conjunction(demands)
    return exact, conjunction(demands)


def trigram_query(rule: Rule) -> object:
    """The query of a rule, over trigrams of the text in lower case (ASCII letters alone)."""
    exact, query = derive(parser.parse(rule.pattern, re.ASCII))
    return conjunction([query, of_strings(exact) if exact else True])


def trigrams_in(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1:]))


class Scanner:
    """Rules with their queries, and the index of a batch."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, r.compiled(), trigram_query(r)) for r in rules]
        self.wanted = {t for *_, q in self.rules for t in trigrams_in(q) if len(t.encode()) == 3}
        self.codes = {int.from_bytes(t.encode(), "big"): t for t in self.wanted}
        self.asked = np.zeros(1 << 24, bool)
        self.asked[list(self.codes)] = True

    def postings(self, docs: list[bytes]) -> dict[str, np.ndarray]:
        """Trigram -> ascending numbers of the documents that hold it."""
        text = np.frombuffer(b"\xff".join(docs).lower(), np.uint8)
        if len(text) < 3:
            return {}
        starts = np.cumsum([0, *[len(d) + 1 for d in docs[:-1]]])
        found = []
        for begin in range(0, len(text) - 2, BLOCK):
            part = text[begin : begin + BLOCK + 2]
            code = part[:-2].astype(np.uint32)
            code <<= 8
            code |= part[1:-1]
            code <<= 8
            code |= part[2:]
            at = np.flatnonzero(self.asked[code])
            owner = np.searchsorted(starts, begin + at, "right") - 1
            found.append(np.unique(code[at].astype(np.int64) * len(docs) + owner))
        pairs = np.unique(np.concatenate(found))
        which, cuts = np.unique(pairs // len(docs), return_index=True)
        return {self.codes[int(c)]: p % len(docs) for c, p in zip(which, np.split(pairs, cuts[1:]), strict=True)} if len(pairs) else {}

    def answer(self, query, index: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return index.get(query, np.array([], np.int64)) if query in self.wanted else np.arange(n)
        found = None
        for part in query[1:]:
            own = self.answer(part, index, n)
            found = own if found is None else np.intersect1d(found, own, assume_unique=True) if query[0] == "and" else np.union1d(found, own)
            if query[0] == "and" and not len(found):
                break
        return found

    def scan(self, docs: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) of each document's spans, in that order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        if not docs:
            return out
        index = self.postings([d.encode("utf-8", "surrogatepass") for d in docs])
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in self.answer(query, index, len(docs)).tolist():
                for m in pattern.finditer(docs[i]):
                    if len(m[rule.group]) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def find(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts and digest of the base kinds, and all spans of every row."""
    base = [r.kind for r in rules[:3]]

    def run(batches):
        scanner = Scanner(rules)
        for b in sliced(batches, "text", SLICE):
            found = scanner.scan(strings(b.column("text")))
            said = [[(k, f"{rules[k].kind}:{s}:{e}") for s, k, e in spans] for spans in found]
            counts = [pa.array([sum(k == j for _, k, _ in spans) for spans in found], pa.int64()) for j in range(3)]
            digest = [hashlib.sha256(",".join(t for k, t in x if k < 3).encode()).hexdigest() for x in said]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array([",".join(t for _, t in x) for x in said], pa.string())], names=["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans"])

    return texts(df).mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in base)}, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[removed]") -> str:
    """The text with a mark in place of each run of covered characters."""
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, secrets in `text` replaced; n_chars, where there is one, follows. Null texts stay null."""

    def run(batches):
        scanner = Scanner(rules)
        for b in sliced(batches, "text", SLICE):
            docs = strings(b.column("text"))
            done = [redact(t, s) for t, s in zip(docs, scanner.scan(docs), strict=True)]
            at = b.schema.get_field_index("text")
            nulls = b.column("text").is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array([None if n else t for t, n in zip(done, nulls, strict=True)], pa.string()), *b.columns[at + 1 :]], schema=b.schema)

    out = df.mapInArrow(run, df.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out
