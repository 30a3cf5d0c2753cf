"""Conversation structure repair: the cheapest edits that make roles alternate, by Four-Russians block tables.

A row is one of nine symbols (initial of its role, truncated or not, or must go), a tenth means nothing. A place in the
edited conversation is one of four states: nothing yet, after the system row, after a user row, after an assistant row.
Seen from the end, the costs of going on from the four states differ by bounded amounts, so that only few vectors of
differences exist. ``Tables`` numbers them and has, for every vector and every block of ``SPAN`` symbols, the vector before
the block and what is added to all costs. A conversation is one lookup a block, from its end to its start; the tables also
say to which state each block leads from each state. Then each block is expanded backward from its right end into the
vectors between its rows, which name the ASCII-least cheapest edit of each row. All conversations of a batch are
looked up together.

Rows are in order of turn (nulls first), then role, then text, both after damage. A null role or text is one space; null turns
don't count as gaps; rows of a null conversation id are one conversation. Rows equal in role and text to an earlier row of
the conversation are found by a sum over their digests, not by holding the conversation. Roles are known by their first
character only; an empty role has none and is kept by no edit. An empty table gives no rows. Other columns are not read.

Texts never meet in memory: they stream by in order, with their edits, through a running hash. Of a conversation only a few
bytes a row (its symbols and edits) are in one task at a time, since its audit is one value and its hash is one sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_value, checkpoint_ready, spread, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: rows of a block
SPAN = 3
#: symbols: role (system, user, assistant, another) x 2 + truncated; then these two
GO, NOTHING = 8, 9
SYMBOLS = 10
#: the state that the next inserted or re-roled row leads to, and its role
NEXT, NEXT_ROLE = (2, 2, 3, 2), "uuau"
#: state after keeping a row of a role
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
#: costs after the last row: an assistant row is inserted after a user row, both after the system row
END = (0, 2 * INSERT, INSERT, 0)
END_EDITS = ("", "ua", "a", "")
SPACES = " \t\n\x0b\x0c\r"


class Tables:
    """Cost vectors by number, and what each symbol and each block of symbols does to them."""

    def __init__(self, span: int = SPAN):
        self.span = span
        vectors, rows = {END: 0}, []
        for v in iter_growing(vectors):
            for sym in range(SYMBOLS):
                costs, edits, states = self.before(v, sym)
                least = min(costs)
                normal = tuple(c - least for c in costs)
                rows.append((vectors.setdefault(normal, len(vectors)), least, edits, states))
        n = len(vectors)
        self.vectors = np.array(list(vectors))
        self.edits = sorted({e for r in rows for e in r[2]})
        number = {e: i for i, e in enumerate(self.edits)}
        self.step = np.array([r[0] for r in rows]).reshape(n, SYMBOLS)
        self.added = np.array([r[1] for r in rows]).reshape(n, SYMBOLS)
        self.edit = np.array([[number[e] for e in r[2]] for r in rows]).reshape(n, SYMBOLS, 4)
        self.state = np.array([r[3] for r in rows]).reshape(n, SYMBOLS, 4)
        # every block of symbols, from its last symbol to its first
        blocks = np.array(list(product(range(SYMBOLS), repeat=span)))
        vector, added = np.repeat(np.arange(n)[:, None], len(blocks), 1), np.zeros((n, len(blocks)), np.int64)
        state = np.repeat(np.repeat(np.arange(4)[None, None], n, 0), len(blocks), 1)
        after = []
        for k in reversed(range(span)):
            after.append(vector)
            added = added + self.added[vector, blocks[:, k]]
            vector = self.step[vector, blocks[:, k]]
        for k in range(span):
            state = self.state[after[span - 1 - k][:, :, None], blocks[:, k][None, :, None], state]
        self.block_step, self.block_added, self.block_state = vector.astype(np.int32), added, state.astype(np.int8)

    @staticmethod
    def before(after: tuple[int, ...], sym: int) -> tuple[list[int], list[str], list[int]]:
        """(costs before a row of the symbol, cheapest ASCII-least edits there, state after them), for each state.

        Edits: u and a insert a user and an assistant row, D deletes, K keeps, U and A re-role to user and assistant.
        """
        if sym == NOTHING:
            return list(after), [""] * 4, list(range(4))
        role, truncated = divmod(sym, 2)
        options = []
        for s in range(4):
            own = [(DELETE + after[s], "D", s)]
            if sym != GO:
                more = TRUNCATED * truncated
                if (s, role) in KEPT:
                    own.append((KEEP + more + after[KEPT[s, role]], "K", KEPT[s, role]))
                own.append((REROLE + more + after[NEXT[s]], NEXT_ROLE[s].upper(), NEXT[s]))
            options.append(own)
        costs = [min(o)[0] for o in options]
        for _ in range(3):
            costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
        edits, states = [], []
        for s in range(4):
            made = ""
            while True:
                deletes = options[s][0][0] == costs[s]
                if not deletes and costs[s] == INSERT + costs[NEXT[s]]:  # I comes before K and R
                    made, s = made + NEXT_ROLE[s], NEXT[s]
                    continue
                best = next(o for o in options[s] if o[0] == costs[s])  # in order D, K, R
                edits.append(made + best[1])
                states.append(best[2])
                break
        return costs, edits, states

    def repair(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each row's edits, state at the end and cost of each conversation); first: starts, len + 1."""
        n = np.diff(first)
        blocks = -(-n // self.span)
        start = np.concatenate([[0], np.cumsum(blocks)])
        of = spread(first)
        laid = np.full(start[-1] * self.span, NOTHING)
        place = start[of] * self.span + np.arange(len(symbols)) - first[of]
        laid[place] = symbols
        laid = laid.reshape(-1, self.span)
        code = laid @ SYMBOLS ** np.arange(self.span)[::-1]
        order = np.argsort(-blocks, kind="stable")
        having = [int(k) for k in np.searchsorted(-blocks[order], -np.arange(blocks.max(initial=0)), "left")]
        # from the end to the start, a lookup a block
        vector, cost, right = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(code), np.int64)
        for k, m in enumerate(having):
            c = order[:m]
            at = start[c + 1] - 1 - k
            right[at] = vector[c]
            cost[c] += self.block_added[vector[c], code[at]]
            vector[c] = self.block_step[vector[c], code[at]]
        # from the start to the end, the state before each block
        state, left = np.zeros(len(n), np.int64), np.zeros(len(code), np.int64)
        for k, m in enumerate(having):
            c = order[:m]
            at = start[c] + k
            left[at] = state[c]
            state[c] = self.block_state[right[at], code[at], state[c]]
        # each block, expanded backward from its right end
        after = np.empty_like(laid)
        for k in reversed(range(self.span)):
            after[:, k] = right
            right = self.step[right, laid[:, k]]
        edit = np.empty_like(laid)
        for k in range(self.span):
            edit[:, k] = self.edit[after[:, k], laid[:, k], left]
            left = self.state[after[:, k], laid[:, k], left]
        return edit.reshape(-1)[place], state, cost + self.vectors[vector, 0]


def iter_growing(items: dict) -> Iterator:
    """The keys of a dictionary that grows meanwhile."""
    done = 0
    while done < len(items):
        keys = list(items)[done:]
        done = len(items)
        yield from keys


# --- rows ----------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, stays: rows after damage; dropped rows stay as marks of their conversation."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).alias("kind")
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("stays"), copies.alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, stays) with ``at``, by which a conversation's rows ascend; cut from their lineage."""
    laid = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return laid.withColumn("at", F.monotonically_increasing_id()).checkpoint()


def symbols_of(rows: DataFrame) -> DataFrame:
    """conv_id, at, turn, stays, role (its number), blank, duplicate, truncated of rows in order."""
    bare = F.expr(f"trim(TRAILING '{SPACES}' FROM text)")
    role = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    asks = F.col("stays") & (bare != "")
    text = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.octet_length("role"), "role", "text")
    # what can't be a duplicate has a key of its own
    key = F.when(asks, F.unhex(F.sha2(text, 256))).otherwise(F.col("at").cast("string").cast("binary"))
    facts = rows.select("conv_id", "at", "turn", "stays", role.alias("role"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*".!?")).alias("truncated"), key.alias("key"))
    again = facts.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return facts.join(again, "key", "left").withColumn("duplicate", F.coalesce(F.col("at") > F.col("first"), F.lit(False))).drop("key", "first")


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of one key from sorted batches; a run longer than a batch is put together once, at its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1] != batch.column(key)[0]:
            yield pa.Table.from_batches(held)
            held = []
        changes = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, changes[-1])])
            held = []
        held.append(batch.slice(changes[-1] if len(changes) else 0))
    if held:
        yield pa.Table.from_batches(held)


STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
EDITS = "conv_id {}, at long, edits string, " + ", ".join(f"{c} long" for c in STATS)
REPAIRED = "conv_id {}, " + ", ".join(f"{c} long" for c in STATS) + ", audit string, repaired_sha256 string"
LAST = (1 << 63) - 1


def edits_of(facts: DataFrame) -> DataFrame:
    """The edits of each row (conv_id, at), and behind each conversation's rows one row with its last edits and its counts."""
    tables = broadcast_value(facts.sparkSession, Tables())
    kind = facts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        names, tails = pa.array(t.edits), np.array(END_EDITS, object)
        for part in whole(batches, "conv_id"):
            part = part.combine_chunks()
            column = lambda c: part.column(c).to_numpy()  # noqa: E731,B023
            ids = part.column("conv_id").combine_chunks()
            codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            heads = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            first, stays = np.append(heads, len(codes)), column("stays")
            blank = stays & column("blank")
            duplicate = stays & ~blank & column("duplicate")
            truncated = stays & ~blank & ~duplicate & column("truncated")
            role = column("role").astype(np.int64)
            symbols = np.where(stays, np.where(blank | duplicate, GO, 2 * role + truncated), NOTHING)
            edit, state, cost = t.repair(symbols, first)
            total = lambda flags: np.add.reduceat(flags.astype(np.int64), heads)  # noqa: E731,B023
            # neighbours among the rows that stay
            rows = np.flatnonzero(stays)
            of = spread(first)
            next_to = of[rows[1:]] == of[rows[:-1]]
            a, b = role[rows[:-1]], role[rows[1:]]
            bad = np.bincount(of[rows[1:]][next_to & ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))], minlength=len(heads))
            turns = part.column("turn").combine_chunks()
            known = stays & turns.is_valid().to_numpy(zero_copy_only=False)
            turn, own = turns.fill_null(0).to_numpy()[known], of[known]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (turn[1:] != turn[:-1])
            gaps = np.zeros(len(heads), np.int64)
            if len(own):
                begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                end = np.append(begin[1:], len(own)) - 1
                gaps[own[begin]] = turn[end] - turn[begin] + 1 - np.add.reduceat(new.astype(np.int64), begin)
            empty = lambda k: pa.nulls(k, pa.int64())
            at = part.column("at").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(stays)), at.filter(pa.array(stays)), names.take(pa.array(edit[stays])), *[empty(len(rows))] * 6], names=["conv_id", "at", "edits", *STATS])
            counts = [gaps, total(blank), total(duplicate), total(truncated), bad, cost]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(heads)), pa.array(np.full(len(heads), LAST)), pa.array(tails[state], pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=["conv_id", "at", "edits", *STATS])

    return facts.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, EDITS.format(kind))


ROLES = {"u": "user", "a": "assistant"}


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """A row for each conversation: counts, audit and the hash of its repaired rows, hashed while they stream by."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, between = hashlib.sha256(), [], ""
        for batch in batches:
            out = []
            for conv_id, edits, role, text, *counts in zip(*[batch.column(c).to_pylist() for c in ["conv_id", "edits", "role", "text", *STATS]], strict=True):
                if edits is not None:
                    audit.append(edits)
                    for e in edits:
                        if e in ROLES:
                            digest.update(f"{between}{ROLES[e]}:".encode())
                            between = "\n"
                elif audit[-1][-1] != "D":
                    digest.update(f"{between}{ROLES.get(audit[-1][-1].lower(), role)}:{text}".encode())
                    between = "\n"
                if counts[0] is not None:
                    letters = "".join(audit).translate(str.maketrans("uaUA", "IIRR"))
                    out.append((conv_id, *counts, letters, digest.hexdigest()))
                    digest, audit, between = hashlib.sha256(), [], ""
            if out:
                ids, *values = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), *map(pa.array, values)], names=["conv_id", *STATS, "audit", "repaired_sha256"])

    texts = rows.where("stays").select("conv_id", "at", F.lit(1).alias("kind"), "role", "text")
    both = edits.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind").mapInArrow(run, REPAIRED.format(kind))


def repair(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text, stays) repaired."""
    laid = in_order(rows)
    return apply_edits(laid, edits_of(symbols_of(laid)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    checkpoint_ready(spark)
    return repair(damaged(table(spark, sf_dir, "conversations")))
