"""Manifest, secret scan and conversation repair against brute force: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarryloom.llm import midstates
from quarryloom.llm import op11_merkle_manifest as merkle
from quarryloom.llm import op12_secret_scan as secrets
from quarryloom.llm import op13_conversation_repair as talks
from quarryloom.llm.common import buffer_of

# --- manifest ------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, digest binary, n int"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    languages = {}
    for doc_id, text, lang, source, n, *_ in rows:
        leaf, changed = (H("".join(map(value, (doc_id, source, lang, n, t)))) for t in (text, lower(text)))
        own = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3
        languages.setdefault(lang, []).append((doc_id, leaf, leaf if own else changed))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    order = sorted(languages, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        languages[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [levels([r[1] for r in languages[x]]) for x in order]
    top, out = levels([t[-1][0] for t in trees]), []
    for k, x in enumerate(order):
        for i, (doc_id, leaf, changed) in enumerate(languages[x]):
            proof = ""
            for tree, at in ((trees[k], i), (top, k)):
                for level in tree[:-1]:
                    run, slot = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    proof, changed, at = proof + "".join(run[:slot] + run[slot + 1 :]), H("".join([*run[:slot], changed, *run[slot + 1 :]])), at // 8
            root = top[-1][0]
            out.append((doc_id, x, leaf, trees[k][-1][0], root, H(proof), changed, changed == root))
    return sorted(out, key=str)


def test_midstates_are_sha256():
    digests = np.random.default_rng(1).integers(0, 256, (20, 32)).astype(np.uint8)
    for k in range(10):
        states = midstates.fresh(20)
        for j in range(k):
            states = midstates.as_states(midstates.as_bytes(midstates.compress(states, midstates.hex_words(np.roll(digests, j, 0)))))
        for i, d in enumerate(midstates.finish(states, np.full(20, k))):
            assert d.tobytes().hex() == H("".join(np.roll(digests, j, 0)[i].tobytes().hex() for j in range(k)))


@pytest.mark.parametrize("deep", [1, 4])
def test_manifest(spark, monkeypatch, deep):
    monkeypatch.setattr(merkle, "DEEP", deep)  # one level a block: many rounds
    monkeypatch.setattr(merkle, "BLOCK", merkle.FAN**deep)
    rng = random.Random(2)
    rows = [(i, f"Text {i} " * rng.randint(0, 4), rng.choice(["en", "en", "en", "de", "é", ""]), "S", i, "x", 1, b"y", 2) for i in range(600)]
    rows += [(None, "N", "en", None, None, None, None, None, None), (5, None, None, "s", 1, "x", 1, b"y", 2), (7, "Long " * 60_000, "zz", "s", 1, "x", 1, b"y", 2)]
    rows += [(9, "Same", "en", "s", 4, "x", 1, b"y", 2)] * 20 + [(10, t, "fr", "s", 4, "x", 1, b"y", 2) for t in ("B", "a", "A")]
    for own in (rows, rows[:1], rows[:3]):
        docs = spark.createDataFrame(own, DOCS)
        lowered = merkle.F.when(merkle.F.expr(f"{merkle.crc32_of_id('doc_id')} % 3 = 0"), merkle.F.translate("text", merkle.UPPER, merkle.LOWER))
        leaves = merkle.leaves_of(docs, lowered).checkpoint()
        got = merkle.prove(leaves, *merkle.manifest(leaves))
        assert sorted(map(tuple, got.select("doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str) == brute_manifest(own)


def test_manifest_of_nothing_and_of_unchanged_rows(spark):
    empty = merkle.leaves_of(spark.createDataFrame([], DOCS)).checkpoint()
    assert merkle.prove(empty, *merkle.manifest(empty)).collect() == []
    some = merkle.leaves_of(spark.createDataFrame([(i, "t", "en", "s", 1, "", 0, b"", 0) for i in range(20)], DOCS)).checkpoint()
    assert all(r.verified for r in merkle.prove(some, *merkle.manifest(some)).collect())


# --- secrets ---------------------------------------------------------------------------------------------------

BITS = [
    "token", "Password", "passwd", "SECRET", "api_key", "APIKEY", "api", "key", ":", "=", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "abc",
    "XYZ9", "Q" * 17, "é", "日本", "\n", ",", "eyJ", "eyJhb.eyJx.c", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "sk_live_", "a1b2c3d4e5", "pass", "toktoken",
    "/", "+", "f" * 600, "A" * 700, "token=" + "z" * 3000, "abcdef" * 4, "abcdef" * 3 + "abcde",
]


def brute_spans(text, rules):
    found = [(m.start(), m.end(), k) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return sorted(found, key=lambda x: (x[0], x[2]))


def random_texts(n, seed):
    rng = random.Random(seed)
    return [*["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n)], "token: token: abcdef token=a=b", "x" * 511 + "token=abcdef" + "y" * 501 + "AKIA" + "Z" * 40]


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner([*secrets.BASE, *secrets.EXTRA])


def test_scanner_equals_regular_expressions(scanner):
    texts = random_texts(600, 5)
    raw, off = buffer_of(pa.array(texts))
    found = scanner.spans(raw, off)
    for i, text in enumerate(texts):
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
        assert [(points[a], points[b], k) for a, b, k in found.get(i, [])] == brute_spans(text, scanner.rules), text


def test_scanner_is_minimal_and_refuses_what_it_cannot_do(scanner):
    assert len(scanner.next) <= scanner.built
    rows = [(*a, *b) for a, b in zip(scanner.next.tolist(), scanner.ends.tolist(), strict=True)]
    assert len(set(rows)) == len(rows)
    with pytest.raises(ValueError):
        secrets.Scanner([secrets.Rule("gap", "ab(?:xy)*")])  # a match could end before the byte that shows it
    with pytest.raises(ValueError):
        secrets.Scanner([secrets.Rule("word", r"\w+")])


def test_base_rules_are_those_of_the_task():
    plain = [secrets.BASE[0], secrets.Rule("access", "AKIA[A-Z0-9]+", 0, 20), secrets.Rule("hex", "[0-9a-f]+", 0, 24)]
    for text in random_texts(300, 8):
        assert brute_spans(text, plain) == brute_spans(text, secrets.BASE)


def test_scan_rows(spark):
    texts = [None, "", *random_texts(60, 9), "a,b " * 200_000 + "password: hunter22"]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_hex int")
    rules = [*secrets.BASE, *secrets.EXTRA]
    for r in secrets.scan(docs).collect():
        want = brute_spans(texts[r.doc_id] or "", rules)
        told = [f"{rules[k].kind}:{a}:{b}" for a, b, k in want]
        assert r.spans == ",".join(told)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, _, k in want) for j in range(3))
        assert r.base_sha256 == H(",".join(t for t, (_, _, k) in zip(told, want, strict=True) if k < 3))
    assert secrets.scan(docs.where("doc_id < 0")).collect() == []


# --- conversations -----------------------------------------------------------------------------------------------

TALKS = "conv_id long, turn long, role string, text string, at long, edits string, cost int, stays int"
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def brute_repair(rows):
    """The best (cost, audit) of each state after each row; states are the last role."""
    plain = lambda v: " " if v is None else str(v)
    conversations = {}
    for conv_id, turn, role, text, *_ in rows:
        kind, role, text = zlib.crc32(f"{plain(conv_id)}:{plain(turn)}".encode()) % 20, plain(role), plain(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own = conversations.setdefault(conv_id, [])
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted((repaired(c, own) for c, own in conversations.items()), key=str)


def repaired(conv_id, own):
    own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in own:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))

    def put(best, state, move, cost, audit, out):
        to = state if move is None else MOVES.get((state, move))
        if to is not None and (to not in best or (cost, audit) < best[to][:2]):
            best[to] = (cost, audit, out)

    def with_inserts(best):
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    put(best, state, role[0], cost + 5, audit + "I", (*out, f"{role}:"))
        return best

    best = with_inserts({"": (0, "", ())})
    for (_, role, text), fault in zip(own, faults, strict=True):
        new = {}
        for state, (cost, audit, out) in best.items():
            put(new, state, None, cost + 2, audit + "D", out)
            if fault in ("", "truncated"):
                more = cost + 5 * (fault != "")
                put(new, state, role[:1], more, audit + "K", (*out, f"{role}:{text}"))
                for to in ("user", "assistant"):
                    put(new, state, to[0], more + 1, audit + "R", (*out, f"{to}:{text}"))
        best = with_inserts(new)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    return (conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, H("\n".join(out)))


def random_talks(n, seed, conversations=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Assistant", "user", "assistant"]
    texts = [None, "", "a.", "b!", "c", "d?  ", " \t", "é。", "x.\n", "long " * 50, *[f"{i}." for i in range(30)]]
    return [(rng.choice([None, *range(conversations)]), rng.choice([None, *range(30)]), rng.choice(roles), rng.choice(texts), 1, "clash", 1, 1) for _ in range(n)]


@pytest.mark.parametrize("span", [1, 2, 3])
def test_blocks_of_any_length_agree(span):
    tables, rng = talks.Tables(span), np.random.default_rng(4)
    lengths = rng.integers(1, 40, 200)
    first = np.concatenate([[0], np.cumsum(lengths)])
    symbols = rng.integers(0, talks.SYMBOLS, first[-1])
    edit, state, cost = tables.repair(symbols, first)
    plain = talks.Tables(1)
    for i in range(200):
        own, v, total = symbols[first[i] : first[i + 1]], 0, 0
        for s in own[::-1]:
            total, v = total + plain.added[v, s], plain.step[v, s]
        assert total + plain.vectors[v, 0] == cost[i]
    assert len(tables.edits) == len(plain.edits) and (edit < len(tables.edits)).all() and set(state.tolist()) <= {0, 1, 2, 3}


@pytest.mark.parametrize("batch", ["1000", "7"])
def test_repair(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # conversations longer than a batch
    try:
        rows = random_talks(1200, 6) + [(500, i, "user" if i % 2 else "assistant", "Same.", 1, "", 1, 1) for i in range(150)]
        got = talks.repair(talks.damaged(spark.createDataFrame(rows, TALKS)))
        assert sorted(map(tuple, got.select("conv_id", *talks.STATS, "audit", "repaired_sha256").collect()), key=str) == brute_repair(rows)
        assert talks.repair(talks.damaged(spark.createDataFrame([], TALKS))).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
