"""Merkle manifest of a table: a tree of hash states that folds a changed row up to the root.

A leaf is the hash of a row. Leaves of a language ascend by id and every ``FAN`` consecutive nodes have one parent; the
roots of the languages have parents in the same way up to one root. A parent keeps the state of its hash before each
child's slot. Folding a row's (changed) leaf resumes that state with the leaf in its slot and reads only the siblings to
the right; what stands left of the slot is never read again.

A child is a digest as hex text, just one block of SHA-256, so that a kept state is 32 bytes (``midstates``) and travels
in a column. The tree grows in blocks of ``BLOCK`` consecutive nodes (four levels), each made by one task; only the blocks'
roots go on to the next round, so no language is ever in one task. Each block learns its path to the root (a kept state
and a run of siblings a level), and the leaves of a block are folded together.

Nulls: a null value is hashed as ``-``; a null language is a language of its own, the first; a null id counts as the empty
text where ids are hashed, and comes first. Rows of one id and language are ordered by their leaf, equal rows stay rows. An
empty table gives no rows. Texts of any length are hashed whole, inside the JVM. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_ready, crc32_of_id, table
from .midstates import as_bytes, as_states, compress, finish, fresh, hex_words

#: children of a parent, and consecutive nodes that one task takes: FAN ** DEEP
FAN, DEEP = 8, 4
BLOCK = FAN**DEEP
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(values: list[Column]) -> Column:
    """Hex digest of a row: for each value ``-`` if null, else its bytes, ``:`` and itself."""
    parts = []
    for c in values:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``place`` (from 0, in the group, by the order) and ``n`` (rows of the group). A group may be the whole table:
    rows are dealt by ranges of (group, order), and only one row a group and partition is summed up."""
    by = [F.col(c).asc_nulls_first() for c in group + order]
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    laid = laid.withColumn("part", F.shiftright("at", 33))
    runs = laid.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    runs = runs.withColumn("before", F.sum("rows").over(Window.partitionBy(*group).orderBy("part")) - F.col("rows"))
    runs = runs.withColumn("n", F.sum("rows").over(Window.partitionBy(*group))).drop("rows")
    return laid.join(runs, [*group, "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


# --- a block of consecutive nodes ----------------------------------------------------------------------------


def levels_of(n: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def grow(digests: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(nodes of each level, states before each node's slot in its parent, the last level's nodes)."""
    nodes, states = [], []
    for _ in range(levels):
        m = len(digests)
        words, before, now = hex_words(digests), np.empty((m, 8), np.uint32), fresh(-(-m // FAN))
        for slot in range(min(FAN, m)):
            at = np.arange(slot, m, FAN)
            before[at] = now[: len(at)]
            now[: len(at)] = compress(now[: len(at)], words[at])
        nodes.append(digests)
        states.append(before)
        digests = finish(now, run_sizes(np.arange(0, m, FAN), m))
    return nodes, states, digests


def run_sizes(children: np.ndarray, m: int) -> np.ndarray:
    """How many siblings, itself included, each of some nodes of a level of m has."""
    return np.minimum(FAN, m - children // FAN * FAN)


def climb(value: np.ndarray, proof: np.ndarray, read: np.ndarray, child: np.ndarray, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level up for many rows: (new values, states of their proofs, blocks read by the proofs).

    ``child`` is the place of each row's node among the level's nodes, whose blocks are ``words``; ``before`` are the kept
    states of these slots.
    """
    slot, size = child % FAN, run_sizes(child, len(words))
    state, proof = compress(before, hex_words(value)), proof.copy()
    for k in range(1, FAN):
        on = np.flatnonzero(slot + k < size)
        state[on] = compress(state[on], words[child[on] + k])
    for k in range(FAN):
        on = np.flatnonzero((k < size) & (k != slot))
        proof[on] = compress(proof[on], words[child[on] - slot[on] + k])
    return finish(state, size), proof, read + size - 1


def step_bytes(child: int, nodes: np.ndarray, states: np.ndarray) -> bytes:
    """A level of a path: slot, size of the run, the slot's kept state, the digests of the run."""
    first = child // FAN * FAN
    run = nodes[first : first + FAN]
    return bytes([child - first, len(run)]) + as_bytes(states[child]) + run.tobytes()


def steps(path: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slot, kept state, digests of the run), level by level."""
    at = 0
    while at < len(path):
        slot, size = path[at], path[at + 1]
        yield slot, as_states(path[at + 2 : at + 34])[0], np.frombuffer(path, np.uint8, 32 * size, at + 34).reshape(size, 32)
        at += 34 + 32 * size


def digests_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def unpack(m: int, levels: int, kept: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What ``build`` packed: nodes and states of each level."""
    nodes, states, at = [], [], 0
    for _ in range(levels):
        nodes.append(np.frombuffer(kept, np.uint8, 32 * m, at).reshape(m, 32))
        states.append(as_states(kept[at + 32 * m : at + 64 * m]))
        at, m = at + 64 * m, -(-m // FAN)
    return nodes, states


# --- rounds --------------------------------------------------------------------------------------------------

BUILT = "tree string, place long, n long, digest binary, m int, levels int, kept binary"
PATHS = "tree string, place long, digest binary, path binary, subroot binary, root binary"
PROVEN = "doc_id {}, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def build(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (tree, place, n, digest): their roots, with all states that their parents keep."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, n = part.sort_values("place"), int(part["n"].iloc[0])
        levels = min(DEEP, levels_of(n))
        own, states, top = grow(digests_of(part["digest"]), levels)
        kept = b"".join(d.tobytes() + as_bytes(s) for d, s in zip(own, states, strict=True))
        return pd.DataFrame([(key[0], key[1], -(-n // BLOCK), top[0].tobytes(), len(part), levels, kept)], columns=[c.split()[0] for c in BUILT.split(", ")])

    return nodes.groupBy("tree", F.shiftright("place", 3 * DEEP).alias("block")).applyInPandas(run, BUILT)


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of every round; each tree has one in the last."""
    out = []
    while not out or (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(build(out[-1].select("tree", "place", "n", "digest") if out else nodes).checkpoint())
    return out


def paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """A row for each node of the blocks: its path to the root. ``above`` has that of each block."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, made = part.iloc[0], []
        nodes, states = unpack(r["m"], r["levels"], r["kept"])
        for i in range(r["m"]):
            own = b"".join(step_bytes(i // FAN**k, nodes[k], states[k]) for k in range(r["levels"]))
            digest = nodes[0][i].tobytes() if r["levels"] else r["digest"]
            made.append((r["tree"], r["place"] * BLOCK + i, digest, own + r["path"], r["subroot"], r["root"]))
        return pd.DataFrame(made, columns=[c.split()[0] for c in PATHS.split(", ")])

    return blocks.join(above.drop("digest"), ["tree", "place"]).groupBy("tree", "place").applyInPandas(run, PATHS)


def fold(leaves: DataFrame, blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each leaf's proof, and the root that follows from ``changed`` (or the leaf, if null) and the leaf's siblings."""

    def run(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        rows, block = rows.sort_values("place"), of.iloc[0]
        nodes, states = unpack(block["m"], block["levels"], block["kept"])
        n = len(rows)
        leaf = digests_of(rows["digest"])
        value, proof, read = digests_of(rows["changed"].where(rows["changed"].notna(), rows["digest"])), fresh(n), np.zeros(n, np.int64)
        for k in range(block["levels"]):
            child = np.arange(n) // FAN**k
            value, proof, read = climb(value, proof, read, child, hex_words(nodes[k]), states[k][child])
        for slot, state, run in steps(block["path"]):
            value, proof, read = climb(value, proof, read, np.full(n, slot), hex_words(run), np.repeat(state[None], n, 0))
        proofs, root = finish(proof, read), block["root"]
        text = lambda a: [x.tobytes().hex() for x in a]
        out = {"doc_id": rows["doc_id"], "lang": rows["lang"], "leaf": text(leaf), "subroot": block["subroot"].hex(), "root": root.hex(), "proof_sha256": text(proofs)}
        return pd.DataFrame(out | {"folded_root": text(value), "verified": [x.tobytes() == root for x in value]})

    of = blocks.select("tree", "place", "m", "levels", "kept").join(above.select("tree", "place", "path", "subroot", "root"), ["tree", "place"])
    block = F.shiftright("place", 3 * DEEP).alias("block")
    return leaves.groupBy("tree", block).cogroup(of.groupBy("tree", F.col("place").alias("block"))).applyInPandas(run, PROVEN.format(leaves.schema["doc_id"].dataType.simpleString()))


def leaves_of(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """tree (the language), place in it, n, doc_id (a string, whose value nulls keep), digest, changed (null: not changed).

    ``changed`` is the changed text of a row; null where a row stays as it is.
    """
    values = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("binary") if changed is None else F.when(changed.isNotNull(), F.unhex(leaf_of([*values[:-1], changed])))
    # a language's name gets a sign before it: the null one comes first and is no name
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    own = docs.select(tree.alias("tree"), "doc_id", F.col("lang").cast("string").alias("lang"), F.unhex(leaf_of(values)).alias("digest"), other.alias("changed"))
    # texts are hashed once, not again for the sample of ranges; equal rows have different numbers to be dealt by
    own = own.withColumn("number", F.monotonically_increasing_id()).checkpoint()
    return ranked(own, ["tree"], ["doc_id", "digest", "number"]).drop("number")


def manifest(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """(rounds of the languages' trees, the languages in order, rounds of the tree over their roots).

    Rounds are tables of blocks with all kept states.
    """
    trees = rounds(leaves.select("tree", "place", "n", "digest"))
    names = ranked(trees[-1].select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"), ["all"], ["name"])
    return trees, names, rounds(names.select(F.col("all").alias("tree"), "place", "n", "digest"))


def prove(leaves: DataFrame, trees: list[DataFrame], names: DataFrame, tops: list[DataFrame]) -> DataFrame:
    """Every leaf with its proof and its folded root."""
    none = F.lit(b"")
    above = tops[-1].select("tree", "place", "digest", none.alias("path"), none.alias("subroot"), F.col("digest").alias("root"))
    for blocks in reversed(tops):
        above = paths(blocks, above)
    above = above.join(names.select("place", "name"), "place")
    above = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "digest", "path", F.col("digest").alias("subroot"), "root")
    for blocks in reversed(trees[1:]):
        above = paths(blocks, above)
    return fold(leaves, trees[0], above)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents with leaf, proof and folded root; every third id's text is changed by lower-casing A-Z."""
    checkpoint_ready(spark)
    docs = table(spark, sf_dir, "documents")
    lowered = F.when(F.expr(f"{crc32_of_id('doc_id')} % 3 = 0"), F.translate("text", UPPER, LOWER))
    leaves = leaves_of(docs, lowered).checkpoint()
    return prove(leaves, *manifest(leaves))


ORACLE_SQL = r"""
WITH RECURSIVE
crc(tbl) AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) ORDER BY i) FROM range(256) t(i)),
docs AS (
    SELECT d.*, list_reduce(list_transform(range(1, 1 + length(coalesce(doc_id::VARCHAR, ''))), lambda i: ascii(substr(coalesce(doc_id::VARCHAR, ''), i, 1))::BIGINT),
        lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), 4294967295) AS crc
    FROM documents d, crc
),
hashed AS (
    SELECT doc_id, lang, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(concat(head, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))) END AS changed
    FROM (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM docs)
),
leaves AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
tree(level, tree, place, digest) AS (
    SELECT 0, tree, place, leaf FROM leaves
    UNION ALL
    SELECT any_value(level) + 1, tree, place // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM tree) WHERE n > 1 GROUP BY tree, place // 8
),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM (FROM tree QUALIFY row_number() OVER (PARTITION BY tree ORDER BY level DESC) = 1)),
top(level, place, digest) AS (
    SELECT 0, place, subroot FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY place // 8
),
nodes AS (SELECT 'tree' AS part, level, tree, place, digest FROM tree UNION ALL SELECT 'top', level, '', place, digest FROM top),
runs AS (SELECT part, level, tree, place // 8 AS parent, list(digest ORDER BY place) AS run FROM nodes GROUP BY part, level, tree, place // 8),
heights AS (SELECT part, tree, max(level) AS height FROM nodes GROUP BY part, tree),
up(doc_id, tree, part, level, place, value, proof, leaf, lang, changed, row) AS (
    SELECT doc_id, tree, 'tree', 0, place, coalesce(changed, leaf), '', leaf, lang, changed, row_number() OVER () FROM leaves
    UNION ALL
    SELECT u.doc_id, u.tree, CASE WHEN level < height THEN part ELSE 'top' END, CASE WHEN level < height THEN level + 1 ELSE 0 END,
        CASE WHEN level < height THEN u.place // 8 ELSE s.place END,
        CASE WHEN level < height THEN sha256(array_to_string(list_concat(run[:u.place % 8], [value], run[u.place % 8 + 2:]), '')) ELSE value END,
        CASE WHEN level < height THEN proof || array_to_string(list_concat(run[:u.place % 8], run[u.place % 8 + 2:]), '') ELSE proof END,
        leaf, lang, changed, row
    FROM (SELECT u.*, h.height, r.run FROM up u JOIN heights h ON h.part = u.part AND h.tree = CASE WHEN u.part = 'tree' THEN u.tree ELSE '' END
        JOIN runs r ON r.part = u.part AND r.level = u.level AND r.tree = h.tree AND r.parent = u.place // 8) u JOIN subroots s ON s.tree = u.tree
    WHERE part = 'tree' OR level < height
)
SELECT u.doc_id, u.lang, u.leaf, s.subroot, r.root, sha256(u.proof) AS proof_sha256, u.value AS folded_root, u.value = r.root AS verified
FROM up u JOIN heights h ON h.part = 'top' AND h.height = u.level JOIN subroots s ON s.tree = u.tree CROSS JOIN (SELECT digest AS root FROM top ORDER BY level DESC LIMIT 1) r
WHERE u.part = 'top'
"""
