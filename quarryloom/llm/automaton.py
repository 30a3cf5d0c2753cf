"""Byte automata as sorted arrays, walked for many words in lockstep."""

from __future__ import annotations

import struct
import tempfile
from dataclasses import dataclass

import numpy as np


@dataclass
class Automaton:
    """Deterministic and acyclic. Edge (state, byte) is the key ``state * 256 + byte``; keys are sorted.

    edge_value: what an edge adds; final: whether a word ends in a state; final_value: what ending there adds.
    """

    keys: np.ndarray
    target: np.ndarray
    edge_value: np.ndarray
    final: np.ndarray

    def walk(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(accepted, sum of the edge values) of each word; all words take one step at a time."""
        state = np.zeros(len(starts), np.int64)
        total = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: those still walking are a prefix
        size = (ends - starts)[order]
        at, alive = starts[order], np.ones(len(starts), bool)
        for step in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -step, "left"))
            rows = np.flatnonzero(alive[:n])
            if not len(rows):
                break
            key = (state[rows] << 8) | raw[at[rows] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            alive[rows[~hit]] = False
            rows, edge = rows[hit], edge[hit]
            state[rows] = self.target[edge]
            total[rows] += self.edge_value[edge]
        ok, value = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64)
        ok[order] = alive & self.final[state]
        value[order] = total
        return ok, value

    # --- one block of bytes, to be memory-mapped ---

    def pack(self) -> bytes:
        parts = [np.ascontiguousarray(a) for a in (self.keys, self.target, self.edge_value, self.final.astype(np.int64))]
        return struct.pack("<2q", len(self.keys), len(self.final)) + b"".join(p.astype("<i8").tobytes() for p in parts)

    @classmethod
    def map(cls, block: bytes) -> Automaton:
        """The automaton over a memory map of an unlinked file, so that workers page it in as they walk."""
        edges, states = struct.unpack_from("<2q", block)
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            data = np.memmap(f, dtype="<i8", mode="r", offset=16)
        cuts = np.split(data, [edges, 2 * edges, 3 * edges])
        return cls(cuts[0], cuts[1], cuts[2], np.asarray(cuts[3][:states]).astype(bool))


def prefix_tree(words: list[bytes]) -> tuple[Automaton, list[bytes]]:
    """A tree of all prefixes of sorted words, and the prefix of each state; edge values are zero."""
    state: dict[bytes, int] = {b"": 0}
    prefixes = [b""]
    keys: list[tuple[int, int]] = []
    for w in words:
        for i in range(1, len(w) + 1):
            p = w[:i]
            if p not in state:
                state[p] = len(prefixes)
                prefixes.append(p)
                keys.append((state[w[: i - 1]] << 8 | w[i - 1], state[p]))
    pairs = np.array(sorted(keys), np.int64).reshape(-1, 2)
    final = np.ones(len(prefixes), bool)
    final[0] = False
    return Automaton(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64), final), prefixes


def minimal(words: list[bytes]) -> Automaton:
    """The least acyclic automaton of sorted distinct words; the edge values along a word's path sum to its number.

    Words arrive in order; once a branch can't grow any more, its states are merged with equal ones, from the leaf
    up, so suffixes are shared.
    """
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states of the last word

    def close(down_to: int, last: bytes) -> None:
        for i in range(len(path) - 1, down_to, -1):
            s = path[i]
            seen = register.setdefault((final[s], tuple(edges[s].items())), s)
            edges[path[i - 1]][last[i - 1]] = seen
            path.pop()

    last = b""
    for w in words:
        same = next((i for i, (a, b) in enumerate(zip(w, last, strict=False)) if a != b), min(len(w), len(last)))
        close(same, last)
        for byte in w[same:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = w
    close(0, last)

    number, order, below = {0: 0}, [0], {}
    for s in order:
        for t in edges[s].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)

    def count(root: int) -> None:
        stack = [root]
        while stack:
            s = stack[-1]
            todo = [t for t in edges[s].values() if t not in below]
            if todo:
                stack.extend(todo)
                continue
            below[s] = int(final[s]) + sum(below[t] for t in edges[s].values())
            stack.pop()

    count(0)
    rows = []
    for s in order:
        skipped = int(final[s])
        for byte in sorted(edges[s]):
            t = edges[s][byte]
            rows.append((number[s] << 8 | byte, number[t], skipped))
            skipped += below[t]
    a = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return Automaton(a[:, 0], a[:, 1], a[:, 2], np.array([final[s] for s in order], bool))
