"""Secret scan by one combined deterministic automaton.

Every rule is a regular expression.  Subset construction turns it into an
automaton that finds its leftmost matches without overlaps: a state holds the
threads of a rule by where they started, a thread that accepts ends all that
started later, and when it dies the search starts afresh at that byte.  The
rules' automata are multiplied into one and minimised, over classes of bytes
that no rule tells apart, into one array of transitions.  A text is read once,
byte by byte, for all rules; a state says which rules' matches have just ended.
Where a match began is found by a second automaton a rule, of its expression
reversed, that walks back from the end.

The arrays depend on the rules alone: the driver builds them once and tasks get
them with the function.  One scan of the rows, no shuffle.

A rule's match counts if ``wanted`` accepts it as well; a match that doesn't is
dropped, yet its text stays used up.  Rules must be greedy in the sense that a
match, once found, is only ever made longer byte by byte; others are refused.

Edge cases: null text has no spans, as an empty one; spans are in code points of
the whole text, however long; spans of different rules may overlap; rows that
repeat are scanned each; empty tables give no rows; extra columns are kept but
for those that clash with an output column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``pattern`` finds, ``wanted`` says which of the finds count (default: all).

    With ``inside`` the combined automaton holds ``wanted`` too, so that finds that
    don't count cost nothing: for patterns that find something in most words.
    Counted repeats of several rules multiply its states, so rare patterns have
    ``wanted`` read backwards on what they found.
    """

    kind: str
    pattern: str
    wanted: str | None = None
    inside: bool = False


# The base rules, then those of well-known key formats.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
BASE_RULES = [
    Rule("assign", _ASSIGN + "+", _ASSIGN + "{8,}"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{32,}", inside=True),
]
RULES = [
    *BASE_RULES,
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("repository_token", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{16,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", "[rs]k_live_[A-Za-z0-9]+", "[rs]k_live_[A-Za-z0-9]{16,}"),
]
KINDS = [r.kind for r in RULES]


class Threads:
    """A non-deterministic automaton over bytes, built from a parsed expression (Thompson's construction)."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.on: list[list[tuple[np.ndarray, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def add(self, tree, reverse: bool, start: int) -> int:
        """Add a sequence of parse nodes after ``start``; the state it ends in."""
        for op, arg in reversed(tree) if reverse else tree:
            start = self._one(str(op), arg, reverse, start)
        return start

    def _one(self, op: str, arg, reverse: bool, start: int) -> int:
        if op == "SUBPATTERN":
            _, flags, _, inner = arg
            if flags & ~re.IGNORECASE:
                raise ValueError("only the flag i is known")
            old, self.fold = getattr(self, "fold", False), bool(flags & re.IGNORECASE) or getattr(self, "fold", False)
            end = self.add(inner, reverse, start)
            self.fold = old
            return end
        if op == "BRANCH":
            end = self.state()
            for way in arg[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(way, reverse, begin)].append(end)
            return end
        if op == "MAX_REPEAT":
            low, high, inner = arg
            for _ in range(low):
                start = self.add(inner, reverse, start)
            if str(high) == "MAXREPEAT":
                loop = self.state()
                self.free[start].append(loop)
                self.free[self.add(inner, reverse, loop)].append(loop)
                return loop
            end = self.state()
            for _ in range(high - low):
                self.free[start].append(end)
                start = self.add(inner, reverse, start)
            self.free[start].append(end)
            return end
        end = self.state()
        self.on[start].append((self._bytes(op, arg), end))
        return end

    def _bytes(self, op: str, arg) -> np.ndarray:
        hit = np.zeros(256, bool)
        if op == "LITERAL":
            hit[arg] = True
        elif op == "IN":
            parts = [(str(o), a) for o, a in arg]
            for o, a in parts:
                if o == "LITERAL":
                    hit[a] = True
                elif o == "RANGE":
                    hit[a[0]:a[1] + 1] = True
                elif o == "CATEGORY" and str(a) == "CATEGORY_SPACE":
                    hit[list(b" \t\n\r\f\v")] = True
                elif o != "NEGATE":
                    raise ValueError(f"{o} is not known in a set")
            if parts[0][0] == "NEGATE":
                hit = ~hit
        else:
            raise ValueError(f"{op} is not known in a rule")
        if getattr(self, "fold", False):
            for upper in range(65, 91):
                hit[upper] = hit[upper + 32] = hit[upper] | hit[upper + 32]
        return hit

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def move(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({t for s in states for hit, t in self.on[s] if hit[byte]})


def threads(patterns: list[str], reverse: bool = False) -> tuple[Threads, frozenset[int], list[int]]:
    """An automaton of all patterns from one start: (it, start states, the accepting state of each)."""
    nfa = Threads()
    begin = nfa.state()
    ends = []
    for p in patterns:
        own = nfa.state()
        nfa.free[begin].append(own)
        ends.append(nfa.add(re._parser.parse(p), reverse, own))
    return nfa, nfa.closure({begin}), ends


def byte_classes(hits: list[np.ndarray]) -> np.ndarray:
    """A class for each byte; bytes of one class are in the same ones of all sets."""
    rows = np.stack(hits, axis=1) if hits else np.zeros((256, 1), bool)
    return np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)


class Automaton(NamedTuple):
    """next state [states, classes], the label of each state; state 0 is the start."""

    moves: np.ndarray
    labels: list
    classes: np.ndarray


def explore(start, move, label, classes: np.ndarray) -> Automaton:
    """The reachable automaton of a start state and a move function on (state, byte)."""
    some = [int(np.nonzero(classes == c)[0][0]) for c in range(classes.max() + 1)]
    number, order, rows = {start: 0}, [start], []
    for s in order:
        row = []
        for byte in some:
            t = move(s, byte)
            if t not in number:
                number[t] = len(order)
                order.append(t)
            row.append(number[t])
        rows.append(row)
    return Automaton(np.array(rows), [label(s) for s in order], classes)


def minimised(a: Automaton) -> Automaton:
    """The smallest automaton of the same labels (states refined until none of a block differs), the start first."""
    names = {x: i for i, x in enumerate(dict.fromkeys(a.labels))}
    block = np.array([names[x] for x in a.labels])
    while True:
        shape = np.concatenate([block[:, None], block[a.moves]], axis=1)
        finer = np.unique(shape, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    first = np.full(block.max() + 1, -1)
    for i in range(len(block) - 1, -1, -1):
        first[block[i]] = i
    place = np.argsort(np.argsort(first))  # blocks by first state: the start's is 0
    kept = np.sort(first)
    return Automaton(place[block[a.moves[kept]]], [a.labels[i] for i in kept], a.classes)


def finder(rule: Rule) -> Automaton:
    """Finds the leftmost matches of a rule without overlaps.

    A label says whether a match (that counts, where the rule says ``inside``) ended before the last byte read.  A state
    is (label, groups of threads by start, the oldest first); the group that has
    accepted is the last.
    """
    nfa, begin, ends = threads([rule.pattern, rule.wanted if rule.wanted and rule.inside else rule.pattern])
    if ends[0] in begin:
        raise ValueError(f"rule {rule.kind} matches the empty text")
    classes = byte_classes([hit for on in nfa.on for hit, _ in on])

    def settle(groups: list[frozenset[int]]) -> tuple:
        kept: list[frozenset[int]] = []
        seen: set[int] = set()
        for g in groups:
            new = g - seen
            if new:
                kept.append(new)
                seen |= new
                if ends[0] in g:
                    break
        return tuple(kept)

    def move(state, byte):
        _, groups = state
        ended = False
        moved = [nfa.move(g, byte) for g in groups]
        if groups and ends[0] in groups[0]:
            if moved[0] and ends[0] not in moved[0]:
                raise ValueError(f"rule {rule.kind} goes on after a match without matching")
            if moved[0]:
                return (False, settle(moved))
            ended, moved = ends[1] in groups[0], []
        return (ended, settle([*moved, nfa.move(begin, byte)]))

    return minimised(explore((False, ()), move, lambda s: s[0], classes))


def walker(pattern: str) -> Automaton:
    """An expression read backwards; a label is 2 where it accepts, 0 where nothing can follow, else 1."""
    nfa, begin, ends = threads([pattern], reverse=True)
    classes = byte_classes([hit for on in nfa.on for hit, _ in on])
    return minimised(explore(begin, nfa.move, lambda s: 2 if ends[0] in s else 1 if s else 0, classes))


def combined(parts: list[Automaton]) -> Automaton:
    """All automata in one; a label is the tuple of the numbers of the parts whose label is set."""
    classes = byte_classes([p.classes == c for p in parts for c in range(p.classes.max() + 1)])

    def move(states, byte):
        return tuple([int(p.moves[s, p.classes[byte]]) for p, s in zip(parts, states, strict=True)])

    def label(states):
        return tuple([i for i, (p, s) in enumerate(zip(parts, states, strict=True)) if p.labels[s]])

    return minimised(explore((0,) * len(parts), move, label, classes))


class Scanner:
    """All rules over one text."""

    #: A byte that UTF-8 never holds and no rule may match: every match ends before it.
    STOP = 0xFF

    def __init__(self, rules: list[Rule]):
        self.automaton = combined([finder(r) for r in rules])
        self.walkers = [walker(r.pattern) for r in rules]
        self.checks = [walker(r.wanted) if r.wanted and not r.inside else None for r in rules]
        self._rows: list | None = None

    def __getstate__(self):
        return {**self.__dict__, "_rows": None}

    def _tables(self):
        """Transition rows that refer to one another, built once a worker from the arrays."""
        if self._rows is None:
            def rows(a: Automaton | None) -> list | None:
                if a is None:
                    return None
                out: list[list] = [[] for _ in a.labels]
                for own, targets, label in zip(out, a.moves[:, a.classes].tolist(), a.labels, strict=True):
                    own += [out[t] for t in targets]
                    own.append(label)
                return out[0]

            self._rows = [rows(self.automaton), [*map(rows, self.walkers)], [*map(rows, self.checks)]]
        return self._rows

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points, in order."""
        data = text.encode() + bytes([self.STOP])
        row, back, checks = self._tables()
        ends = []
        for i, byte in enumerate(data):
            row = row[byte]
            if row[256]:
                ends += [(i, rule) for rule in row[256]]
        if not ends:
            return []
        found, before = [], [0] * len(back)
        for end, rule in ends:
            # the leftmost match is the longest that the reversed rule reads, up to the match before
            state, begin = back[rule], end
            for i in range(end - 1, before[rule] - 1, -1):
                state = state[data[i]]
                if state[256] == 2:
                    begin = i
                elif not state[256]:
                    break
            before[rule] = end
            if (state := checks[rule]) is not None:
                for i in range(end - 1, begin - 1, -1):
                    state = state[data[i]]
                if state[256] != 2:
                    continue
            found.append((begin, rule, end))
        if not text.isascii():
            # code points before a byte: bytes that continue none
            count = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            found = [(int(count[a]), rule, int(count[b])) for a, rule, b in found]
        return sorted(found)


@lru_cache(maxsize=8)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once a driver process."""
    return Scanner(list(rules))


def scan(documents: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """``documents`` without the text, with ``spans``: array of (kind, start, end) by start, then by order of the rules."""
    scanner, kinds = scanner_of(tuple(rules)), [r.kind for r in rules]
    kept = [c for c in documents.columns if c not in (text, "spans")]
    rows = documents.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias(text))
    spans = "array<struct<kind: string, start: int, end: int>>"
    schema = ", ".join([*[f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept], f"spans {spans}"])
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [[{"kind": kinds[r], "start": a, "end": b} for a, r, b in scanner.spans(t)] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(told, pa.list_(kind))], names=[*kept, "spans"])

    return rows.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans and all spans as text, of ``scan`` rows."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = [r.kind for r in BASE_RULES]
    counts = [count(kind) for kind in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
