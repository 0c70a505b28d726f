r"""Secret scans: all rules in one deterministic automaton, one pass over the bytes.

Each rule's regular expression becomes a nondeterministic automaton, and by subset
construction a searching deterministic one, which knows whether the leftmost match
is under way.  The product of the rules' automata is minimised and laid out as one
transition array.  A scan reads each byte of a text once; where a rule's match
ends, a small automaton for the reversed rule runs back to its start.

Matches of a rule are leftmost, longest and do not overlap.  Rules must be such
that once a match is found, it stays one for as long as it can go on, and that a
match found is that of the earliest start; compiling checks both.

Spans are in code points, end exclusive.  Besides the three base kinds the rules
find tokens of other well-known forms.

Defined cases: null text counts as empty and has no spans; bytes outside ASCII
belong to no rule and end a match; texts are scanned whole; repeated rows are
scanned each for itself; an empty table gives an empty result; input columns named
like a result column are replaced by it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    #: a group of the pattern, and its least length for the match to count
    group: int = 0
    least: int = 0


# Counted repeats multiply the states of the product, so lengths are mostly checked
# after the match; for hex, where short runs are common, the automaton counts.
#: The base kinds in their order, then further well-known token forms.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ignore_case=True, group=2, least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


class Nfa:
    """Thompson's construction over bytes, from the standard library's syntax tree."""

    def __init__(self, rule: Rule):
        self.ignore_case = rule.ignore_case
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.start = self.node()
        self.accept = self.sequence(sre_parser.parse(rule.pattern), self.start)

    def node(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def sequence(self, items, at: int) -> int:
        for op, value in items:
            at = self.item(op, value, at)
        return at

    def item(self, op, value, at: int) -> int:
        if op in (sre.LITERAL, sre.IN):
            to = self.node()
            self.edges[at].append((self.symbols(op, value), to))
            return to
        if op is sre.SUBPATTERN:
            return self.sequence(value[3], at)
        if op is sre.BRANCH:
            to = self.node()
            for branch in value[1]:
                self.empty[self.sequence(branch, at)].append(to)
            return to
        if op is sre.MAX_REPEAT:
            low, high, body = value
            for _ in range(low):
                at = self.sequence(body, at)
            to = self.node()
            self.empty[at].append(to)
            if high is sre.MAXREPEAT:
                self.empty[self.sequence(body, to)].append(to)
            else:
                for _ in range(high - low):
                    at = self.sequence(body, at)
                    self.empty[at].append(to)
            return to
        raise ValueError(f"a rule may not use {op}")

    def symbols(self, op, value) -> frozenset[int]:
        found: set[int] = set()
        for kind, x in [(op, value)] if op is sre.LITERAL else value:
            if kind is sre.LITERAL:
                found.add(x)
            elif kind is sre.RANGE:
                found.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"a rule's class may not use {kind}")
        if self.ignore_case:
            found |= {ord(f(chr(x))) for x in found if chr(x).isascii() and chr(x).isalpha() for f in (str.lower, str.upper)}
        if max(found) > 127:
            raise ValueError("rules are for ASCII characters")
        return frozenset(found)

    def closure(self, nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def move(self, nodes, byte: int) -> frozenset[int]:
        return self.closure({to for n in nodes for symbols, to in self.edges[n] if byte in symbols})

    def reversed(self) -> Nfa:
        back = object.__new__(Nfa)
        back.empty, back.edges = [[] for _ in self.empty], [[] for _ in self.edges]
        for n, targets in enumerate(self.empty):
            for t in targets:
                back.empty[t].append(n)
        for n, edges in enumerate(self.edges):
            for symbols, t in edges:
                back.edges[t].append((symbols, n))
        back.start, back.accept = self.accept, self.start
        return back


def searcher(nfa: Nfa) -> tuple[np.ndarray, np.ndarray]:
    """Transitions (states x 256) and, by state, whether a match is under way.

    A state holds the live node sets of each possible start, the earliest first.
    """
    first = nfa.closure([nfa.start])
    symbols = sorted({b for edges in nfa.edges for s, _ in edges for b in s})

    def tidy(groups: list[frozenset[int]]) -> tuple[tuple[frozenset[int], ...], bool]:
        kept, seen = [], set()
        for g in groups:
            if g - seen:
                kept.append(g - seen)
                seen |= g
                if nfa.accept in g:
                    if len(kept) > 1:
                        raise ValueError("a later start matches while an earlier one may still")
                    return (kept[0],), True
        return tuple(kept), False

    def step(state, byte: int):
        groups, matched = state
        if matched:
            on = nfa.move(groups[0], byte)
            if on:
                if nfa.accept not in on:
                    raise ValueError("a match may lapse and come back")
                return (on,), True
            groups = ()
        new = tidy([x for x in (nfa.move(g, byte) for g in (*groups, first)) if x])
        if matched and new[1]:
            raise ValueError("a match is shorter than two bytes")
        return new

    states = {((), False): 0}
    order, rows = [((), False)], []
    for state in order:
        row = np.zeros(256, dtype=np.int64)  # other bytes lead to the state of no match
        for b in symbols:
            to = step(state, b)
            if to not in states:
                states[to] = len(order)
                order.append(to)
            row[b] = states[to]
        rows.append(row)
    return np.array(rows), np.array([m for _, m in order])


def minimised(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's refinement; the start state stays first."""
    part = np.unique(marks, return_inverse=True)[1].ravel()
    columns = np.unique(table, axis=1)
    while True:
        finer = np.unique(np.column_stack([part, part[columns]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    # number the classes with the start's first and those with matches last
    some = np.array([np.flatnonzero(part == c)[0] for c in range(part.max() + 1)])
    order = sorted(range(len(some)), key=lambda c: (marks[some[c]] != 0, c != part[0]))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[part[table[some[order]]]], marks[some[order]]


class Scanner:
    """The combined automaton of some rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nfas = [Nfa(r) for r in rules]
        parts = [searcher(n) for n in nfas]
        states = {(0,) * len(rules): 0}
        order, rows = [(0,) * len(rules)], []
        for state in order:
            targets = np.stack([t[s] for (t, _), s in zip(parts, state, strict=True)], axis=1)
            kinds, which = np.unique(targets, axis=0, return_inverse=True)
            numbers = []
            for to in map(tuple, kinds.tolist()):
                if to not in states:
                    states[to] = len(order)
                    order.append(to)
                numbers.append(states[to])
            rows.append(np.array(numbers)[which.ravel()])
        marks = np.array([sum(int(m[s]) << k for k, ((_, m), s) in enumerate(zip(parts, state, strict=True))) for state in order])
        self.table, self.marks = minimised(np.array(rows), marks)
        self.flat = (self.table * 256).ravel().tolist()
        self.matching = 256 * int((self.marks == 0).sum())
        self.by_state = self.marks.tolist()
        self.back = [n.reversed() for n in nfas]
        self.starts: list[dict] = [{} for _ in rules]
        self.exact = [re.compile(r.pattern.encode(), re.IGNORECASE if r.ignore_case else 0) for r in rules]

    def start(self, k: int, data: bytes, end: int, floor: int) -> int:
        """The earliest start, from ``floor`` on, of a match of rule ``k`` that ends at ``end``."""
        nfa, known = self.back[k], self.starts[k]
        nodes, found = nfa.closure([nfa.start]), end
        for i in range(end - 1, floor - 1, -1):
            key = (nodes, data[i])
            if key not in known:
                known[key] = nfa.move(*key)
            nodes = known[key]
            if not nodes:
                break
            if nfa.accept in nodes:
                found = i
        return found

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) of each match, in bytes."""
        flat, matching, state, under, ends = self.flat, self.matching, 0, 0, []
        for i, byte in enumerate(data):
            state = flat[state + byte]
            if state >= matching:
                now = self.by_state[state >> 8]
                if under & ~now:
                    ends.append((i, under & ~now))
                under = now
            elif under:
                ends.append((i, under))
                under = 0
        if under:
            ends.append((len(data), under))
        floors, spans = [0] * len(self.rules), []
        for end, mask in ends:
            for k, rule in enumerate(self.rules):
                if mask >> k & 1:
                    start = self.start(k, data, end, floors[k])
                    floors[k] = end
                    if not rule.least or len(self.exact[k].fullmatch(data, start, end).group(rule.group)) >= rule.least:
                        spans.append((start, k, end))
        return sorted(spans)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of each match, in code points."""
        text = text or ""
        data = text.encode("utf-8", "replace")
        found = self.scan(data)
        if not found:
            return []
        if len(data) == len(text):
            return [(self.rules[k].kind, a, b) for a, k, b in found]
        place = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
        return [(self.rules[k].kind, int(place[a]), int(place[b])) for a, k, b in found]


@functools.cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """An array of (kind, start, end) by start, then in the order of the rules."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = scanner(rules)
        for batch in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in automaton.spans(x)] for x in batch], dtype=object)

    return found(text)


def find_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``spans``."""
    return df.withColumn("spans", secret_spans(F.col(text_col), rules))


def query(spark, sf_dir: str) -> DataFrame:
    docs = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = {f"n_{k}": of_kind(k) for k in BASE_KINDS}
    return docs.select(
        "doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )
