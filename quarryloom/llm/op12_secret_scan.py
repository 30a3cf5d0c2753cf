"""Secret scan: one deterministic automaton for all rules, one pass over the bytes.

``Scanner`` compiles the rules' regular expressions together. A state of one rule is its live attempts, earliest start
first, each a set of positions in the expression; an attempt that has matched drops later ones and lets none begin, so that
matches are leftmost and don't overlap. The subsets of all rules are one state; states are built over classes of
bytes that no rule tells apart, and equal ones are merged by partition refinement into one array of next states and one of
rules whose match ends before the byte. A second small automaton, of the reversed expressions, walks back over a match to
its start.

A slice of text is cut into lanes that advance together, one array lookup a byte. A lane starts some bytes early, in the
first state; where the lane before it ends in another state than it began with, it is run again from the true state, so
every cut is exact.

The three base rules and their spans are fixed; ``EXTRA`` adds keys in PEM form, signed web tokens and tokens with a
telling prefix, whose spans stand beside the base ones. Nulls count as the empty text, texts of any length are read whole,
equal texts give equal rows, an empty table gives none. Letters in either case are ASCII letters. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import broadcast_value, table, text_slices

#: bytes of text of one scan, symbols of a lane, and symbols that it starts early
SLICE, LANE, EARLY = 4_000_000, 512, 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; those whose ``group`` has fewer than ``least`` characters are dropped, but take their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules. Runs of hex digits shorter than eight, which words are full of, are no matches to begin with.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{8,}", 0, 24),
]
EXTRA = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("prefixed", r"(?:gh[pousr]_|xox[abprs]-|sk_live_)[A-Za-z0-9-]+", 0, 20),
]


# --- expressions to positions ----------------------------------------------------------------------------------


class Positions:
    """An expression as a graph of positions: ``byte[i]`` is the set of bytes of an edge from ``i`` to ``i + 1``, ``jump[i]`` leads on without one."""

    def __init__(self, pattern: str):
        self.byte: dict[int, tuple[frozenset[int], int]] = {}
        self.jump: dict[int, list[int]] = {}
        self.n = 1
        self.end = self.add(syntax.parse(pattern), 0, False)

    def new(self) -> int:
        self.n += 1
        return self.n - 1

    def add(self, items, at: int, either_case: bool) -> int:
        """Puts a sequence behind a position; the position after it."""
        for kind, value in items:
            name = str(kind)
            if name in ("LITERAL", "IN"):
                to = self.new()
                self.byte[at] = (self.bytes_of(name, value, either_case), to)
                at = to
            elif name == "SUBPATTERN":
                at = self.add(value[3], at, either_case or bool(value[1] & re.IGNORECASE))
            elif name == "BRANCH":
                to = self.new()
                for branch in value[1]:
                    begin = self.new()
                    self.jump.setdefault(at, []).append(begin)
                    self.jump.setdefault(self.add(branch, begin, either_case), []).append(to)
                at = to
            elif name == "MAX_REPEAT":
                least, most, inner = value
                for _ in range(least):
                    at = self.add(inner, at, either_case)
                if most is syntax.MAXREPEAT:
                    begin = self.new()
                    self.jump.setdefault(at, []).append(begin)
                    back = self.add(inner, begin, either_case)
                    to = self.new()
                    self.jump.setdefault(back, []).extend([begin, to])
                    self.jump[at].append(to)
                    at = to
                else:
                    to = self.new()
                    for _ in range(most - least):
                        self.jump.setdefault(at, []).append(to)
                        at = self.add(inner, at, either_case)
                    self.jump.setdefault(at, []).append(to)
                    at = to
            else:
                raise ValueError(f"a rule may not use {name}")
        return at

    @staticmethod
    def bytes_of(name: str, value, either_case: bool) -> frozenset[int]:
        out: set[int] = set()
        for kind, v in [("LITERAL", value)] if name == "LITERAL" else [(str(k), v) for k, v in value]:
            if kind not in ("LITERAL", "RANGE"):
                raise ValueError(f"a rule may not use {kind} in a set")
            out |= set(range(v[0], v[1] + 1)) if kind == "RANGE" else {v}
        if either_case:
            out |= {ord(f(chr(b))) for b in out if chr(b).isascii() and chr(b).isalpha() for f in (str.lower, str.upper)}
        if max(out) > 127:
            raise ValueError("a rule may only use ASCII characters")
        return frozenset(out)

    def closed(self, some, jump: dict[int, list[int]]) -> frozenset[int]:
        seen, todo = set(some), list(some)
        while todo:
            for j in jump.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return frozenset(seen)

    def forward(self, some: frozenset[int], b: int) -> frozenset[int]:
        return self.closed({self.byte[i][1] for i in some if i in self.byte and b in self.byte[i][0]}, self.jump)

    def reversed_table(self) -> tuple[list[list[int]], list[bool]]:
        """(next states by byte, whether a start is reached) from the end backward; state 0 is the end, -1 none."""
        edges: dict[int, list[tuple[frozenset[int], int]]] = {}
        for i, (of, to) in self.byte.items():
            edges.setdefault(to, []).append((of, i))
        jump: dict[int, list[int]] = {}
        for i, to in self.jump.items():
            for j in to:
                jump.setdefault(j, []).append(i)
        states, rows = {self.closed({self.end}, jump): 0}, []
        todo = list(states)
        for state in todo:
            row = []
            for b in range(256):
                to = self.closed({i for j in state for of, i in edges.get(j, ()) if b in of}, jump)
                if to and to not in states:
                    states[to] = len(states)
                    todo.append(to)
                row.append(states[to] if to else -1)
            rows.append(row)
        return rows, [0 in s for s in todo]


# --- the automaton -----------------------------------------------------------------------------------------------


class Scanner:
    """All rules in one automaton. Symbols are classes of bytes and, last, the end of a text."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        graphs = [Positions(r.pattern) for r in rules]
        self.back = [g.reversed_table() for g in graphs]
        used = sorted({of for g in graphs for of, _ in g.byte.values()}, key=sorted)
        like: dict[tuple, int] = {}
        self.symbol = np.array([like.setdefault(tuple(b in of for of in used), len(like)) for b in range(256)], np.uint8)
        example = [int(np.flatnonzero(self.symbol == k)[0]) for k in range(len(like))]
        self.stop = len(like)
        bytes_of = [*example, None]
        own = [self.rule_table(g, bytes_of) for g in graphs]
        # states of all rules together, as far as they can be reached
        states, table, ends = {(0,) * len(rules): 0}, [], []
        todo = list(states)
        for state in todo:
            row = []
            for to in zip(*(t[0][q] for t, q in zip(own, state, strict=True)), strict=True):
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                row.append(states[to])
            table.append(row)
            ends.append(sum(t[1][q].astype(np.int64) << k for k, (t, q) in enumerate(zip(own, state, strict=True))))
        self.built = len(states)
        self.next, self.ends = self.merged(np.array(table), np.array(ends))

    @classmethod
    def rule_table(cls, g: Positions, bytes_of: list[int | None]) -> tuple[list[list[int]], np.ndarray]:
        """The automaton of one rule: (next states by symbol, whether a match ends before the symbol)."""
        begin, states, table, ends = g.closed({0}, g.jump), {(): 0}, [], []
        todo: list[tuple] = [()]
        for state in todo:
            row, out = [], []
            for byte in bytes_of:
                to, ended = cls.advance(g, begin, state, byte)
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                row.append(states[to])
                out.append(ended)
            table.append(row)
            ends.append(out)
        small, small_ends = cls.merged(np.array(table), np.array(ends).astype(np.int64))
        return small.tolist(), small_ends

    @staticmethod
    def advance(g: Positions, begin: frozenset[int], attempts: tuple, byte: int | None) -> tuple[tuple, bool]:
        """(attempts after a byte or, None, the end of the text; whether the match of the first one ends before it)."""
        matched = bool(attempts) and g.end in attempts[0]
        moved, seen = [], set()
        for some in () if byte is None else attempts:
            to = g.forward(some, byte) - seen
            seen |= to
            moved.append(to)
        if matched and moved and moved[0]:
            if g.end not in moved[0]:
                raise ValueError("a rule's match must be complete at every byte after its least length")
            return (moved[0],), False
        # the match is over, or there was none: what began inside it has no say
        live = [] if matched else [x for x in moved if x]
        if byte is not None and (fresh := g.forward(begin, byte) - (set() if matched else seen)):
            live.append(fresh)
        done = next((i for i, x in enumerate(live) if g.end in x), None)
        if done:
            raise ValueError("a rule's match may not begin inside an attempt that may still match")
        return tuple(live[:1] if done == 0 else live), matched

    @staticmethod
    def merged(table: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest equal automaton: states are parted by what they put out, then by the parts that they lead to."""
        part = np.unique(ends, axis=0, return_inverse=True)[1].reshape(-1)
        while True:
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == part.max():
                break
            part = finer
        order = np.unique(part, return_index=True)[1]
        # the first state stays number 0
        number = np.argsort(np.argsort(np.where(np.arange(len(order)) == part[0], -1, order)))
        keep = order[np.argsort(number)]
        return number[part[table[keep]]].astype(np.int32), ends[keep].astype(np.uint8 if ends.max() < 256 else np.int64)

    def ends_in(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of symbols before which matches end, bits of their rules)."""
        width = self.stop + 1
        nexts, ends = (self.next * width).reshape(-1), self.ends.reshape(-1)
        lanes = max(1, -(-len(symbols) // LANE))
        laid = np.full(lanes * LANE + EARLY, self.stop, np.uint8)
        laid[EARLY : EARLY + len(symbols)] = symbols
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(laid, (EARLY + LANE, lanes), (1, LANE)))
        found, state = np.zeros((LANE, lanes), ends.dtype), np.zeros(lanes, np.int32)
        for k in range(EARLY):
            state = nexts[state + steps[k]]
        began = state
        for k in range(LANE):
            at = state + steps[EARLY + k]
            state = nexts[at]
            found[k] = ends[at]
        # a lane that began in another state than the lane before it ended in is run again
        state, quick, quick_ends = state.copy(), None, None
        for i in np.flatnonzero(began[1:] != state[:-1]) + 1:
            while i < lanes and state[i - 1] != began[i]:
                if quick is None:
                    quick, quick_ends = nexts.tolist(), ends.tolist()
                now, row = int(state[i - 1]), []
                began[i] = now
                for s in steps[EARLY:, i].tolist():
                    row.append(quick_ends[now + s])
                    now = quick[now + s]
                found[:, i], state[i] = row, now
                i += 1
        lane, step = np.nonzero(found.T)
        return lane * LANE + step, found[step, lane]

    def spans(self, raw: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """(start, end, number of rule) in bytes of each text that has any, by start and rule."""
        n = len(off) - 1
        symbols = np.full(len(raw) + n, self.stop, np.uint8)
        symbols[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(off))] = self.symbol[raw]
        places, masks = self.ends_in(symbols)
        of = np.searchsorted(off[1:] + np.arange(n), places)
        out: dict[int, list[tuple[int, int, int]]] = {}
        last: dict[tuple[int, int], int] = {}
        whole = raw.tobytes() if len(places) else b""
        for end, mask, i in zip((places - of).tolist(), masks.tolist(), of.tolist(), strict=True):
            for k, rule in enumerate(self.rules):
                if mask >> k & 1:
                    rows, starts = self.back[k]
                    state, at, start, least = 0, end, end, last.get((i, k), int(off[i]))
                    while at > least and (state := rows[state][whole[at - 1]]) >= 0:
                        at -= 1
                        if starts[state]:
                            start = at
                    last[i, k] = end
                    if rule.group == 0 and end - start >= rule.least or rule.group and len(re.fullmatch(rule.pattern, whole[start:end].decode())[rule.group]) >= rule.least:
                        out.setdefault(i, []).append((start - int(off[i]), end - int(off[i]), k))
        return {i: sorted(found, key=lambda x: (x[0], x[2])) for i, found in out.items()}


SCANNED = "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, extra: list[Rule] = EXTRA) -> DataFrame:
    """One row for each document: counts of the base rules, the hash of their spans, and all spans in code points."""
    scanner = broadcast_value(docs.sparkSession, Scanner([*BASE, *extra]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner.value
        kinds = [r.kind for r in s.rules]
        for batch in batches:
            for part, raw, off in text_slices(batch, limit=SLICE):
                n = part.num_rows
                counts, base, spans = np.zeros((3, n), np.int64), [hashlib.sha256(b"").hexdigest()] * n, [""] * n
                found = s.spans(raw, off)
                for i, own in found.items():
                    points = np.concatenate([[0], np.cumsum((raw[off[i] : off[i + 1]] & 0xC0) != 0x80)])
                    for _, _, k in own:
                        if k < 3:
                            counts[k, i] += 1
                    told = [(k, f"{kinds[k]}:{points[a]}:{points[b]}") for a, b, k in own]
                    base[i] = hashlib.sha256(",".join(t for k, t in told if k < 3).encode()).hexdigest()
                    spans[i] = ",".join(t for _, t in told)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts), pa.array(base), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED.format(docs.schema["doc_id"].dataType.simpleString()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return scan(table(spark, sf_dir, "documents"))


def _sql(rules: list[Rule], base: list[Rule]) -> str:
    """DuckDB: matches and the gaps between them give places; a short match is dropped after it has taken its text."""
    quoted = lambda p: p.replace("'", "''")
    least = lambda r: f"length(regexp_extract(m, '{quoted(r.pattern)}', {r.group})) >= {r.least}"
    found = " UNION ALL ".join(
        f"SELECT row, '{r.kind}' AS kind, {i} AS k, list_sum([length(x) for x in gaps[:j]]) + coalesce(list_sum([length(x) for x in ms[:j - 1]]), 0) AS s, length(m) AS n "
        f"FROM (SELECT row, ms, string_split_regex(text, '{quoted(r.pattern)}') AS gaps, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS j FROM (SELECT row, text, regexp_extract_all(text, '{quoted(r.pattern)}') AS ms FROM docs)) WHERE {least(r)}"
        for i, r in enumerate(rules)
    )
    inside = ", ".join(f"'{r.kind}'" for r in base)
    count = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found})
SELECT any_value(doc_id) AS doc_id, {count}, sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (kind IN ({inside})), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (kind IS NOT NULL), '') AS spans
FROM (SELECT row, doc_id, kind, k, s::BIGINT AS s, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM docs LEFT JOIN found USING (row)) GROUP BY row
"""


ORACLE_SQL = _sql([*BASE, *EXTRA], BASE)
