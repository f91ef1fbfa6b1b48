"""Secret scans by one combined deterministic automaton (operator 7).

All rule regexes are compiled together: each becomes a fragment of one nondeterministic automaton, the
subset construction makes it deterministic (bytes that no rule tells apart share a class), and
partition refinement minimises it. The result is a transition array. Every text is read once, byte by
byte, by that array for all rules at the same time; accepting states name the rules that have a match
ending there. Texts are read in lanes that step together: a lane ends just after a byte that takes
every state back to the start, so no match is cut.

Where the pass reports a rule in a document, its matches are settled by two automata of the rule's own: one for the reversed rule
reads the text backward once and marks every byte where a match begins; from the leftmost mark behind the last match the anchored
one reads on to the longest match. No byte starts a scan that comes to nothing, so the work is in proportion to the text. Offsets
are code points. Matches that fail the rule's smallest length are dropped after they have taken their place, as the base rules
define it.

Edge cases: null texts count as empty; empty texts have no spans; texts of any length are read whole;
repeated rows give repeated results; spans of equal start stand in the order of the rules; an empty table gives
no rows; other columns are carried along untouched (one named like a result column is replaced by it).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser as regex_syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskloom.llm._text import slices, texts_of


@dataclass(frozen=True)
class Rule:
    """A byte regex (literals, sets, groups, alternation, repetition). ``scan`` may be a regex that has a match
    wherever ``pattern`` has one of the smallest length; the shared pass then stays quiet on most shorter matches.
    ``least`` bounds the length of group ``group`` (0: the match)."""

    name: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 1
    scan: str | None = None


#: Fixed rules: the three base kinds in their order, then those that this operator adds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", fold=True, group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32, scan=r"[0-9a-f]{8}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("hosting", r"gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
)
RULES = BASE_RULES + MORE_RULES


class _Fragments:
    """A nondeterministic automaton: ``steps[s]`` are (byte set, next), ``free[s]`` are moves without a byte."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def new(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Adds a parsed regex from state ``at``; returns the state after it."""
        for op, arg in tree:
            if op in (C.LITERAL, C.IN, C.NOT_LITERAL, C.ANY):
                to = self.new()
                self.steps[at].append((_bytes(op, arg, fold), to))
                at = to
            elif op is C.SUBPATTERN:
                at = self.add(arg[3], at, fold)
            elif op is C.BRANCH:
                to = self.new()
                for branch in arg[1]:
                    self.free[self.add(branch, at, fold)].append(to)
                at = to
            elif op is C.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.add(body, at, fold)
                if high is C.MAXREPEAT:
                    loop = self.new()
                    self.free[at].append(loop)
                    self.free[self.add(body, loop, fold)].append(loop)
                    at = loop
                else:
                    to = self.new()
                    self.free[at].append(to)
                    for _ in range(high - low):
                        at = self.add(body, at, fold)
                        self.free[at].append(to)
                    at = to
            else:
                raise ValueError(f"a secret rule can't use {op}")
        return at


def _bytes(op, arg, fold: bool) -> frozenset[int]:
    if op is C.LITERAL:
        got = {arg}
    elif op is C.NOT_LITERAL:
        got = set(range(256)) - {arg}
    elif op is C.ANY:
        got = set(range(256)) - {10}
    else:
        got = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                got.add(x)
            elif kind is C.RANGE:
                got |= set(range(x[0], x[1] + 1))
            elif kind is not C.NEGATE:
                raise ValueError(f"a secret rule can't use {kind} in a set")
        if arg and arg[0][0] is C.NEGATE:
            got = set(range(256)) - got
    if fold:
        got |= {ord(chr(b).swapcase()) for b in got if b < 128 and chr(b).isalpha()}
    return frozenset(got)


@dataclass(frozen=True)
class Automaton:
    """``move[state, byte class]``; state 0 is the start. ``accepts[state]`` is a bit mask of rules. ``dead`` (or -1) never accepts."""

    classes: np.ndarray
    move: np.ndarray
    accepts: np.ndarray
    dead: int


def _reversed(nfa: _Fragments, start: int, final: int) -> tuple[_Fragments, int, int]:
    """The automaton of the reversed language."""
    back = _Fragments()
    for _ in nfa.steps:
        back.new()
    for state, (steps, free) in enumerate(zip(nfa.steps, nfa.free, strict=True)):
        for on, to in steps:
            back.steps[to].append((on, state))
        for to in free:
            back.free[to].append(state)
    return back, final, start


def compile_rules(patterns: list[tuple[str, bool]], anchored: bool, backward: bool = False) -> Automaton:
    """Subset construction and minimisation of the rules' union; if not anchored, matches may begin at any byte. ``backward``: of
    one rule, reversed."""
    nfa = _Fragments()
    start = nfa.new()
    final: dict[int, int] = {}
    for k, (pattern, fold) in enumerate(patterns):
        begin = nfa.new()
        nfa.free[start].append(begin)
        final[nfa.add(regex_syntax.parse(pattern), begin, fold)] = 1 << k
    if backward:
        nfa, start, end = _reversed(nfa, start, next(iter(final)))
        final = {end: 1}
    sets = sorted({s for steps in nfa.steps for s, _ in steps}, key=sorted)
    by_signature: dict[tuple, int] = {}
    classes = np.array([by_signature.setdefault(tuple(b in s for s in sets), len(by_signature)) for b in range(256)], np.int32)
    example = [int(np.flatnonzero(classes == c)[0]) for c in range(len(by_signature))]

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    first = closed({start})
    number, todo, rows = {first: 0}, [first], []
    for states in todo:
        row = []
        for b in example:
            to = {t for s in states for on, t in nfa.steps[s] if b in on}
            after = closed(to if anchored else to | {start})
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    move = np.array(rows, np.int32)
    accepts = np.array([sum(m for s, m in final.items() if s in states) for states in todo], np.int64)
    # Minimisation: refine the partition by (own block, blocks of all successors) until it is stable.
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    place = np.unique(block, return_index=True)[1]
    rank = np.empty(len(place), np.int32)  # number blocks by their first state: the start stays 0
    rank[np.argsort(place)] = np.arange(len(place))
    place = np.sort(place)
    move, accepts = rank[block[move[place]]], accepts[place]
    dead = [s for s in range(len(move)) if not accepts[s] and (move[s] == s).all()]
    return Automaton(classes, move.astype(np.int32), accepts, dead[0] if dead else -1)


@dataclass(frozen=True)
class Scanner:
    """The shared automaton over full bytes, its reset bytes, and each rule's own: anchored, and backward for the begins of matches."""

    rules: tuple[Rule, ...]
    table: np.ndarray  # flat: state * 256 + byte -> state * 256
    accepts: np.ndarray
    reset: np.ndarray
    own: tuple[tuple[Automaton, Automaton], ...]

    @property
    def states(self) -> int:
        return len(self.accepts)


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    every = compile_rules([(r.scan or r.pattern, r.fold) for r in rules], anchored=False)
    full = every.move[:, every.classes].astype(np.int32)
    alone = [[(r.pattern, r.fold)] for r in rules]
    own = tuple((compile_rules(x, anchored=True), compile_rules(x, anchored=False, backward=True)) for x in alone)
    return Scanner(rules, (full * 256).ravel(), every.accepts, (full == 0).all(0), own)


LANE = 512


def hits(scan: Scanner, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, the bit mask of rules that have a match somewhere: the one pass over all bytes."""
    out = np.zeros(len(offsets) - 1, np.int64)
    n = len(data)
    if not n:
        return out
    resets = np.flatnonzero(scan.reset[data]) + 1
    marks = np.arange(LANE, n, LANE)
    cuts = resets[np.minimum(np.searchsorted(resets, marks), len(resets) - 1)] if len(resets) else marks[:0]
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cuts[cuts < n]]))
    length = np.diff(np.append(starts, n))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    text = np.searchsorted(offsets, starts, "right") - 1
    state = np.zeros(len(starts), np.int32)
    live = np.searchsorted(-length, -np.arange(length[0]), "left")  # lanes longer than t
    accepting = scan.accepts != 0
    for t in range(length[0]):
        k = live[t]
        s = scan.table[state[:k] + data[starts[:k] + t]]
        state[:k] = s
        on = np.flatnonzero(accepting[s >> 8])
        if len(on):
            np.bitwise_or.at(out, text[on], scan.accepts[s[on] >> 8])
    return out


def match_begins(backward: Automaton, data: np.ndarray) -> list[int]:
    """The bytes at which some match begins, in order."""
    rows, accept = backward.move.tolist(), backward.accepts.tolist()
    state, out, at = 0, [], len(data)
    for kind in backward.classes[data[::-1]].tolist():
        state = rows[state][kind]
        at -= 1
        if accept[state]:
            out.append(at)
    return out[::-1]


def matches(rule: Rule, own: tuple[Automaton, Automaton], text: bytes) -> list[tuple[int, int]]:
    """Leftmost, longest, non-overlapping matches of a rule in bytes, those under its smallest length dropped."""
    forward, backward = own
    data = np.frombuffer(text, np.uint8)
    begins = match_begins(backward, data)
    if not begins:
        return []
    rows, accept, dead = forward.move.tolist(), forward.accepts.tolist(), forward.dead
    kinds = forward.classes[data].tolist()
    out, done, n = [], 0, len(text)
    for b in begins:
        if b < done:
            continue
        state, end = 0, -1
        for i in range(b, n):
            state = rows[state][kinds[i]]
            if state == dead:
                break
            if accept[state]:
                end = i + 1
        if end >= 0:
            done = end
            if not rule.group:
                good = end - b >= rule.least
            else:
                m = re.compile(rule.pattern.encode(), re.I if rule.fold else 0).fullmatch(text, b, end)
                good = len(m.group(rule.group)) >= rule.least
            if good:
                out.append((b, end))
    return out


def spans_of(scan: Scanner, text: bytes, mask: int) -> list[tuple[str, int, int]]:
    """(rule, start, end) in code points, by start, then rule order, for the rules in ``mask``."""
    found = [(s, k, e) for k, rule in enumerate(scan.rules) if mask >> k & 1 for s, e in matches(rule, scan.own[k], text)]
    if not found:
        return []
    seen = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(scan.rules[k].name, int(seen[s]), int(seen[e])) for s, k, e in sorted(found)]


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, start, end) in code points. With ``redact``, each run of spans in the text
    becomes ``[kind]`` as well. A column of the input named ``secrets`` gives way."""
    docs = docs.drop("secrets")
    schema = T.StructType([*docs.schema.fields, T.StructField("secrets", SPAN)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    at = docs.columns.index(column)
    scan = scanner(tuple(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(column))
            found: list[list] = [[] for _ in range(len(batch))]
            changed: dict[int, str] = {}
            for i, j in slices(offsets):
                own, base = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                masks = hits(scan, own, base)
                for d in np.flatnonzero(masks):
                    text = own[base[d] : base[d + 1]].tobytes()
                    spans = spans_of(scan, text, int(masks[d]))
                    found[i + d] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
                    if redact and spans:
                        changed[i + d] = _redacted(text.decode(), spans)
            columns = list(batch.columns)
            if changed:
                columns[at] = pa.array([changed.get(i, x) for i, x in enumerate(columns[at].to_pylist())], columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans become one mark, named after the first."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
