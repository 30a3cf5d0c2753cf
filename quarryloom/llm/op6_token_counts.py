"""Token counts by compiled finite-state transducers.

The tokenizer is compiled, on the driver, into two deterministic transducers bounded by its vocabulary:

* a *cutter* over ten classes of characters, with seven states, whose transitions say where a pre-token begins (also
  one character late, since 're, 've and 'll are known only at their last letter). A slice of texts is cut into chunks
  of equal length; all chunks run at once from every state, which gives each chunk's state map; the maps compose
  through a parallel prefix scan, which gives each chunk's true first state; a second run emits.
* a *counter*: the prefix tree of the vocabulary's words, whose transitions are annotated with the change in the number
  of emitted tokens, so that the sum along a word is its count. Words that leave the tree are merged exactly.

Null text counts as empty (0 tokens). Texts that hold the string of a special token go through the library, which
finds those before anything else. Repeated rows get equal values; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .automaton import Automaton, prefix_tree
from .bpe import BLANK, Cut, VectorBPE, WordIds, char_classes, lead_bytes, library, marks, normalised
from .common import broadcast_value, table, text_slices

LIMIT = 2048
CHUNK = 48
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# classes of characters, and states: between pre-tokens, in letters, in others, after ', after 'r, 'v, 'l
C_BLANK, C_LETTER, C_NUMBER, C_OTHER, C_APOSTROPHE, C_STMD, C_R, C_V, C_L, C_E = range(10)
BETWEEN, LETTERS, OTHERS, APOS, APOS_R, APOS_V, APOS_L = range(7)
HERE, BEFORE = 1, 2  # a pre-token begins at this character, at the one before


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) for each state and class."""
    nxt, out = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = (C_LETTER, C_STMD, C_R, C_V, C_L, C_E)
    for s in range(7):
        late = BEFORE if s >= APOS_R else 0  # the letter after the apostrophe was no contraction after all
        nxt[s, C_BLANK], out[s, C_BLANK] = BETWEEN, late
        nxt[s, C_NUMBER], out[s, C_NUMBER] = BETWEEN, late | HERE
        inside = s in (OTHERS, APOS)
        nxt[s, C_OTHER], out[s, C_OTHER] = OTHERS, late | (0 if inside else HERE)
        nxt[s, C_APOSTROPHE], out[s, C_APOSTROPHE] = (OTHERS, 0) if inside else (APOS, late | HERE)
        for c in letters:
            nxt[s, c], out[s, c] = LETTERS, late | (0 if s == LETTERS or late else HERE)
    nxt[APOS, C_STMD], out[APOS, C_STMD] = BETWEEN, 0
    for c, s, second in ((C_R, APOS_R, C_E), (C_V, APOS_V, C_E), (C_L, APOS_L, C_L)):
        nxt[APOS, c], out[APOS, c] = s, 0
        nxt[s, second], out[s, second] = BETWEEN, 0
    return nxt, out


NEXT, OUT = cutter()


def symbols(cp: np.ndarray) -> np.ndarray:
    kinds = char_classes()[cp]
    c = np.array([C_OTHER, C_LETTER, C_NUMBER, C_BLANK], np.uint8)[kinds]
    small = np.flatnonzero(cp < 128)
    special = np.arange(128, dtype=np.uint8) * 0 + 255
    special[39] = C_APOSTROPHE
    for letters, k in (("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
        special[[ord(x) for x in letters]] = k
    own = special[cp[small]]
    c[small] = np.where(own < 255, own, c[small])
    return c


def scan(maps: np.ndarray) -> np.ndarray:
    """Exclusive prefix composition of state maps (chunks, states): the state before each chunk, from BETWEEN."""
    n = len(maps)
    if n == 1:
        return np.array([BETWEEN], np.uint8)
    pairs = np.take_along_axis(maps[1 : n - n % 2 : 2], maps[0 : n - n % 2 : 2].astype(np.intp), 1)
    if n % 2:
        pairs = np.concatenate([pairs, maps[-1:]])
    before = scan(pairs)
    out = np.empty(n, np.uint8)
    out[0::2] = before
    out[1::2] = maps[0 : n - n % 2 : 2][np.arange(n // 2), before[: n // 2]]
    return out


def emit(sym: np.ndarray) -> np.ndarray:
    """The cutter's output at each symbol."""
    n = -(-len(sym) // CHUNK)
    lanes = np.zeros(n * CHUNK, np.uint8)
    lanes[: len(sym)] = sym
    lanes = np.ascontiguousarray(lanes.reshape(n, CHUNK).T)
    nxt, outs = NEXT.ravel(), OUT.ravel()
    state = np.repeat(np.arange(7, dtype=np.uint8), n).reshape(7, n)
    for row in lanes:
        state = nxt[state * np.uint8(10) + row]
    now = scan(np.ascontiguousarray(state.T))
    out = np.empty_like(lanes)
    for j, row in enumerate(lanes):
        at = now * np.uint8(10) + row
        out[j] = outs[at]
        now = nxt[at]
    return np.ascontiguousarray(out.T).ravel()[: len(sym)]


def cut_by_states(raw: np.ndarray, off: np.ndarray) -> Cut:
    """Pre-tokens of a slice of texts. A blank between texts ends what a text left open."""
    cp, first = normalised(raw, off)
    raw = np.frombuffer(cp.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    texts = len(first) - 1
    at = np.arange(len(cp)) + np.repeat(np.arange(texts), np.diff(first))
    sym = np.full(len(cp) + texts, C_BLANK, np.uint8)
    sym[at] = symbols(cp)
    out = emit(sym)
    begins = (out & HERE) > 0
    begins[:-1] |= (out[1:] & BEFORE) > 0
    begins = begins[at]
    blank = char_classes()[cp] == BLANK
    edge = begins | blank
    edge[first[:-1][first[:-1] < len(cp)]] = True
    s = np.flatnonzero(begins & ~blank)
    edges = np.append(np.flatnonzero(edge), len(cp))
    e = edges[np.searchsorted(edges, s, "right")]
    lead = np.append(lead_bytes(raw), len(raw))
    return Cut(raw, lead[s], lead[e], np.searchsorted(s, first), np.zeros(0))


def counter(model: VectorBPE) -> Automaton:
    """The prefix tree of the vocabulary's words, annotated with changes in the number of tokens."""
    of_symbol = {model.tokens[i].removesuffix("</w>"): b for b, i in enumerate(model.last_ids)}
    words = sorted({bytes(of_symbol[c] for c in t[:-4]) for t in model.tokens if t.endswith("</w>") and len(t) > 4})
    tree, prefixes = prefix_tree(words)
    ends = np.cumsum([len(p) for p in prefixes])
    raw = np.frombuffer(b"".join(prefixes), np.uint8)
    _, counts = model.merge(raw, np.concatenate([[0], ends[:-1]]), ends)
    tree.edge_value = counts[tree.target] - counts[tree.keys >> 8]
    return tree


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of (doc_id, text)."""
    compiled = VectorBPE.compile(tokenizer_path)
    shared = broadcast_value(docs.sparkSession, (compiled, counter(compiled)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tree = shared.value

        def resolve(raw, starts, ends):
            ok, n = tree.walk(raw, starts, ends)
            rest = np.flatnonzero(~ok)
            if len(rest):
                n[rest] = model.merge(raw, starts[rest], ends[rest])[1]
            return np.zeros(0, np.int32), n

        words = model._memory.setdefault("counts", WordIds(resolve))
        for batch in batches:
            for part, raw, off in text_slices(batch):
                c = cut_by_states(raw, off)
                slots = words.slots(c)
                total = np.concatenate([[0], np.cumsum(words.count[slots])]).astype(np.int64)
                n = np.diff(total[c.first])
                data = raw.tobytes()
                if any(m in data for m in marks(model)):
                    for i in range(len(n)):
                        text = data[off[i] : off[i + 1]]
                        if any(m in text for m in marks(model)):
                            n[i] = len(library(model).encode(text.decode(), add_special_tokens=False).ids)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
