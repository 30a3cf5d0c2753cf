"""Byte-pair encoding over arrays: pre-tokens are cut for a whole slice of texts at once, and the distinct ones
are merged together, one merge of each per step, so no Python loop runs over texts, words or characters.

``VectorBPE.compile(path)`` reads a public ``tokenizers`` file on the driver; the result is a few arrays bounded by
the vocabulary and travels as a broadcast. Results equal the library's; tests compare them.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import numpy as np
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import distinct_spans, key_hashes, span_keys

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: words longer than this many bytes are merged one by one with a heap
LONG_WORD = 96
#: distinct pre-tokens that a Python worker remembers
REMEMBERED = 400_000
NEVER, SLOT = np.int64(1) << 60, (1 << 19) - 1
#: class of every code point, and the lower case of those below 0x300 (their canonical form is themselves)
_TABLE: list[np.ndarray] = []
_NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def char_classes() -> np.ndarray:
    """Letter, number, white space or another, as the library's own expressions tell: its tables are of another age than Python's."""
    if not _TABLE:
        # planes beyond the third have neither letters nor numbers nor white space
        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x40000)])
        everything = "".join(map(chr, points))
        t = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            has = np.ones(len(points), bool)
            for _, (i, j) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(everything):
                has[i:j] = False
            t[points[has]] = kind
        _TABLE.extend((t, np.array([ord(_NORMAL.normalize_str(chr(c))[:1] or "\0") for c in range(0x300)], np.uint32)))
    return _TABLE[0]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {}, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


@dataclass
class Cut:
    """Pre-tokens of a slice: bytes (after normalising), byte spans, and each text's first pre-token (len + 1)."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    kinds: np.ndarray


def to_code_points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)


def lead_bytes(raw: np.ndarray) -> np.ndarray:
    return np.flatnonzero((raw & 0xC0) != 0x80)


def normalised(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first code point of each text) after canonical composition and lower case, as the library does them.

    Texts of characters below 0x300 alone (but for one that becomes two) are mapped by a table, others by the library.
    """
    char_classes()
    cp, first = to_code_points(raw.tobytes()), np.searchsorted(lead_bytes(raw), off)
    rare = np.flatnonzero((cp >= 0x300) | (cp == 0x130))
    low = _TABLE[1][np.minimum(cp, 0x2FF)]
    if not len(rare):
        return low, first
    parts, at, data = [], 0, raw.tobytes()
    sizes = np.diff(first)
    for i in np.unique(np.searchsorted(first, rare, "right") - 1):
        own = np.frombuffer(_NORMAL.normalize_str(data[off[i] : off[i + 1]].decode()).encode("utf-32-le"), np.uint32)
        parts += [low[at : first[i]], own]
        at, sizes[i] = first[i + 1], len(own)
    return np.concatenate([*parts, low[at:]]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def contractions(cp: np.ndarray, kinds: np.ndarray, brk: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of apostrophes that begin 's 't 'm 'd 're 've 'll, and the lengths of those pre-tokens."""
    n = len(cp)
    p = np.flatnonzero((cp == 39) & (brk > 0))
    p = p[p + 1 < n]
    p = p[(brk[p + 1] == 1) & (kinds[p + 1] == LETTER)]
    if spaced:
        p = p[(brk[p] == 2) | (cp[p - 1] != 32)]
    if not len(p):
        return p, p
    a = cp[p + 1]
    q = np.minimum(p + 2, n - 1)
    b = np.where((p + 2 < n) & (brk[q] == 0), cp[q], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    keep = one | two
    return p[keep], np.where(one, 2, 3)[keep]


def cut(raw: np.ndarray, off: np.ndarray, spaced: bool) -> Cut:
    """Pre-tokens of many texts. spaced: a space belongs to the pre-token after it and white space stays;
    otherwise texts are normalised, digits stand alone and white space goes."""
    table = char_classes()
    if spaced:
        cp, text_at = to_code_points(raw.tobytes()), np.searchsorted(lead_bytes(raw), off)
    else:
        cp, text_at = normalised(raw, off)
        raw = np.frombuffer(cp.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    n = len(cp)
    kinds = table[cp]
    brk = np.zeros(n, np.uint8)
    if n:
        brk[1:] = kinds[1:] != kinds[:-1]
        if not spaced:
            brk |= kinds == NUMBER
        begins = text_at[:-1][text_at[:-1] < text_at[1:]]
        brk[begins] = 2
    at, length = contractions(cp, kinds, brk, spaced)
    if spaced and n:
        j = np.flatnonzero((brk == 1) & (kinds != BLANK))
        j = j[kinds[j - 1] == BLANK]
        lone = np.maximum(brk[j - 1], 1)
        brk[j - 1] = lone
        brk[j[cp[j - 1] == 32]] = 0
    if len(at):
        brk[at + 1] = 0
        after = at + length
        after = after[after < n]
        brk[after] = np.maximum(brk[after], 1)
    s = np.flatnonzero(brk)
    e = np.append(s[1:], n)
    if not spaced:
        keep = kinds[s] != BLANK
        s, e = s[keep], e[keep]
    lead = np.append(lead_bytes(raw), len(raw))
    return Cut(raw, lead[s], lead[e], np.searchsorted(s, text_at), kinds[s])


@dataclass
class VectorBPE:
    path: str
    spaced: bool
    first_ids: np.ndarray  # id of each byte inside a word
    last_ids: np.ndarray  # id of each byte at a word's end
    slots: np.ndarray  # open-addressed table of pairs: key, rank, new id
    ranks: np.ndarray
    news: np.ndarray
    tokens: list[str]
    special: list[str]
    probes: int = 1
    _memory: dict = field(default_factory=dict)

    @classmethod
    def compile(cls, path: str) -> VectorBPE:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        shown = byte_symbols()
        first = np.array([vocab.get(c, -1) for c in shown], np.int32)
        last = np.array([vocab.get(c + suffix, -1) for c in shown], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        new = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys, at = np.unique(keys, return_index=True)  # the first rank of a pair counts
        size = 1 << 19
        slots, ranks, news = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        place, left, probes = cls.hashed(keys), np.arange(len(keys)), 0
        while len(left):
            probes += 1
            free = slots[place[left]] < 0
            _, winners = np.unique(place[left], return_index=True)
            winners = winners[free[winners]]
            w = left[winners]
            slots[place[w]], ranks[place[w]], news[place[w]] = keys[w], at[w], new[at[w]]
            left = np.delete(left, winners)
            place[left] = (place[left] + 1) & (size - 1)
        tokens = [""] * (max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1)
        for t, i in vocab.items():
            tokens[i] = t
        for t in spec["added_tokens"]:
            tokens[t["id"]] = t["content"]
        return cls(path, not suffix, first, last, slots, ranks, news, tokens, [t["content"] for t in spec["added_tokens"]], probes)

    def __getstate__(self):
        return {**self.__dict__, "_memory": {}}

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def urgency(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What orders merges: NEVER for a pair that doesn't merge."""
        rank, at = self.pairs(a, b)
        return np.where(rank < 1 << 30, (rank.astype(np.int64) << 19) | at, NEVER)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or a large number, table slot) of pairs of ids."""
        key = (a.astype(np.int64) << 20) | b
        at = self.hashed(key)
        hit = self.slots[at] == key
        miss = np.flatnonzero(~hit & (self.slots[at] >= 0))
        for _ in range(self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & (len(self.slots) - 1)
            hit[miss] = self.slots[at[miss]] == key[miss]
            miss = miss[~hit[miss] & (self.slots[at[miss]] >= 0)]
        return np.where(hit, self.ranks[at], 1 << 30), at

    def merge(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of words: (ids end to end, number of ids of each word)."""
        size = ends - starts
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        i = int(np.searchsorted(size[order], 1))
        while i < len(order):
            width = int(size[order[i]])
            if width > LONG_WORD:
                w = int(order[i])
                ids = self.merge_long(raw[starts[w] : ends[w]])
                counts[w] = len(ids)
                parts.append((np.array([w]), ids))
                i += 1
                continue
            top = min(LONG_WORD, width + max(1, width // 4))
            j = min(int(np.searchsorted(size[order], top, "right")), i + max(1, 400_000 // top))
            rows = order[i:j]
            ids, n = self.merge_block(raw, starts[rows], size[rows])
            counts[rows] = n
            parts.append((rows, ids))
            i = j
        at = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(at[-1], np.int32)
        for rows, ids in parts:
            n = counts[rows]
            where = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(ids))
            flat[where] = ids
        return flat, counts

    def merge_block(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One merge of every word per step: of its pairs the one of least rank, the leftmost of equals."""
        rows, width = len(starts), int(size.max())
        column = np.arange(width)
        inside = column < size[:, None]
        b = raw[np.where(inside, starts[:, None] + column, starts[:, None])]
        ids = np.where(inside, self.first_ids[b], -1).astype(np.int32)
        ids[np.arange(rows), size - 1] = self.last_ids[b[np.arange(rows), size - 1]]
        n = size.copy()
        urgency = np.full((rows, width), NEVER)  # of each pair: rank, then its slot in the table
        if width > 1:
            r, c = np.nonzero(inside[:, 1:])
            urgency[r, c] = self.urgency(ids[r, c], ids[r, c + 1])
        out, live, now = ids.copy(), np.arange(rows), n
        while width > 1:
            k = urgency.argmin(1)
            best = urgency.ravel().take(np.arange(len(live)) * width + k)
            go = best < NEVER
            if not go.all():
                done = ~go
                out[live[done]] = ids[done]
                n[live[done]] = now[done]
                live, k, best, now, ids, urgency = live[go], k[go], best[go], now[go], ids[go], urgency[go]
            if not len(live):
                break
            # close the gap: everything right of the merged pair moves one to the left
            row = np.arange(len(live))
            take = np.minimum(column + (column > k[:, None]), width - 1) + (row * width)[:, None]
            ids, urgency = ids.ravel().take(take), urgency.ravel().take(take)
            ids[row, k] = self.news[best & SLOT]
            now = now - 1
            urgency[row, now - 1] = NEVER
            ids[row, now] = -1
            for c in (k - 1, k):
                ok = np.flatnonzero((c >= 0) & (c + 1 < now))
                at = row[ok] * width + c[ok]
                flat = ids.ravel()
                urgency.ravel()[at] = self.urgency(flat[at], flat[at + 1])
        return (out[column < n[:, None]] if width > 1 else out.ravel()), n

    def merge_long(self, word: np.ndarray) -> np.ndarray:
        """A very long word: the same merges with a heap of (rank, place) over a linked list."""
        if "merges" not in self._memory:
            some = np.flatnonzero(self.slots >= 0)
            self._memory["merges"] = dict(zip(self.slots[some].tolist(), zip(self.ranks[some].tolist(), self.news[some].tolist(), strict=True), strict=True))
        merges = self._memory["merges"]
        ids = self.first_ids[word].tolist()
        ids[-1] = int(self.last_ids[word[-1]])
        n = len(ids)
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := merges.get(a << 20 | b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = new
            alive[j] = False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (m := merges.get(ids[x] << 20 | ids[y])):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], np.int32)


class WordIds:
    """Ids of pre-tokens, remembered within a Python worker. ``resolve`` gives ids of unseen words.

    Words are found by hash and then compared by their whole keys; a word whose hash another one has already taken is
    resolved anew each time.
    """

    def __init__(self, resolve):
        self.resolve = resolve
        self.clear()

    def clear(self):
        self.hashes = np.zeros(0, np.uint64)  # sorted hashes of the words seen, their keys and slots
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def slots(self, c: Cut) -> np.ndarray:
        """The slot of each pre-token of a slice."""
        if not len(c.starts):
            return np.zeros(0, np.int64)
        if len(self.count) > REMEMBERED:
            self.clear()
        low, high = span_keys(c.raw, c.starts, c.ends)
        hashes = key_hashes(low, high)
        example, codes = distinct_spans(low, high, hashes)
        example_hashes = hashes[example]
        order = np.argsort(example_hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        example, codes = example[order], rank[codes]
        hashes, low, high = hashes[example], low[example], high[example]
        at = np.searchsorted(self.hashes, hashes)
        near = np.minimum(at, max(len(self.hashes) - 1, 0))
        taken = (self.hashes[near] == hashes) & (at < len(self.hashes)) if len(self.hashes) else np.zeros(len(hashes), bool)
        hit = taken.copy()
        hit[taken] = (self.low[near[taken]] == low[taken]) & (self.high[near[taken]] == high[taken])
        slot = np.empty(len(hashes), np.int64)
        slot[hit] = self.slot[near[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            ids, counts = self.resolve(c.raw, c.starts[example[new]], c.ends[example[new]])
            slot[new] = len(self.count) + np.arange(len(new))
            keep = ~taken[new]
            keep[1:] &= hashes[new][1:] != hashes[new][:-1]
            kept = new[keep]
            self.hashes, self.slot, self.low, self.high = (np.insert(x, at[kept], y[kept]) for x, y in ((self.hashes, hashes), (self.slot, slot), (self.low, low), (self.high, high)))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.ids = np.concatenate([self.ids, ids])
        return slot[codes]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each slot's ids)."""
        n = self.count[slots]
        end = np.cumsum(n)
        return self.ids[np.repeat(self.start[slots] - (end - n), n) + np.arange(end[-1] if len(end) else 0)], n


def encoder(model: VectorBPE, resolve=None) -> WordIds:
    """The worker's memory of a model."""
    if "words" not in model._memory:
        model._memory["words"] = WordIds(resolve or model.merge)
    return model._memory["words"]


def library(model: VectorBPE):
    """The public library, for texts that hold the string of a special token."""
    if "library" not in model._memory:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(model.path)
        t.no_truncation()
        t.no_padding()
        model._memory["library"] = t
    return model._memory["library"]


def encode_slice(model: VectorBPE, raw: np.ndarray, off: np.ndarray, words: WordIds | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice end to end, and the first id of each text (len + 1)."""
    words = words or encoder(model)
    data = raw.tobytes()
    odd = [i for i in range(len(off) - 1) if any(s in data[off[i] : off[i + 1]] for s in marks(model))] if any(s in data for s in marks(model)) else []
    c = cut(raw, off, model.spaced)
    ids, n = words.gather(words.slots(c))
    total = np.concatenate([[0], np.cumsum(n)])
    first = total[c.first]
    if odd:
        lists = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        for i in odd:
            lists[i] = np.array(library(model).encode(data[off[i] : off[i + 1]].decode(), add_special_tokens=False).ids, np.int32)
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        ids = np.concatenate(lists) if lists else ids
    return ids, first


def marks(model: VectorBPE) -> list[bytes]:
    return [s.encode() for s in model.special]
