"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Rows of a conversation and the states of the pattern `(s?(ua)+)?` span a lattice: node (i, q) means that i rows are
done and the roles so far lead to state q. Keep, Rerole and Delete lead to column i + 1, Insert stays in its column.
The cheapest way through is found by the auction algorithm for shortest paths (Bertsekas): nodes have integer prices
that never exceed the cost of an arc plus the price behind it; the path is extended over a tight arc, or the price of
its last node rises and the path is contracted. Prices stay valid for another start, so all entries of a block share
them. In the end all cheapest paths run over tight arcs, and the one whose initials come first is traced over these.

A conversation may be of any length: it is cut into blocks of BLOCK rows, one byte a row. Each block of a longer
conversation is solved from every entry to every exit state; these 4 x 4 costs give every block the cost behind its
exits, then each block is traced from every entry, and the entries are followed from the front. Texts are never in the
lattice; they are read once more, sorted, and hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignal.llm.common import hinted, ranked, row_key, settle

BLOCK = 32
INITIALS = "sua"  # any other initial is the fourth kind
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, behind s, behind u, behind a
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 1, 2, 5, 5  # costs; the last one comes on top for a truncated row
NEVER = 1 << 50
AT_END = (0, NEVER, NEVER, 0)
ANY_SPACE = r"\x20\x09-\x0D"


def _after(state: int, kind: int) -> int | None:
    """The state behind a role; None if the pattern has no such role there."""
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if kind == 2 and state == USER else None


INSERTED = [ASSISTANT if state == USER else USER for state in range(4)]


def _row_arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits at a row in ASCII order: initial, cost, and the target counted from the row's column."""
    kind, fault = divmod(code, 4)
    found = []
    for state in range(4):
        arcs = [("D", DELETE, 4 + state), ("I", INSERT, INSERTED[state])]
        if fault in (CLEAN, TRUNCATED):
            extra = OPEN_END if fault == TRUNCATED else 0
            kept = _after(state, kind)
            if kept is not None:
                arcs.append(("K", KEEP + extra, 4 + kept))
            arcs.append(("R", REROLE + extra, 4 + INSERTED[state]))
        found.append(arcs)
    return found


ARCS = [_row_arcs(code) for code in range(16)]
ROW_COST = [min(cost for arcs in of_row for initial, cost, _ in arcs if initial != "I") for of_row in ARCS]


class Lattice:
    """One block: its codes, the cost behind each exit state, and prices; Insert in the last column only at the end."""

    def __init__(self, codes: Sequence[int], exits: Sequence[int], final: bool) -> None:
        self.codes, self.exits, self.final = codes, exits, final
        least = [min(exits)]
        for code in reversed(codes):  # a first valid price: what the rows from here cost at least, one by one
            least.append(least[-1] + ROW_COST[code])
        self.price = [p for p in reversed(least) for _ in range(4)]
        self.target = 4 * (len(codes) + 1)
        # To delete all rows, insert two roles and keep one truncated row is enough from wherever there is a way at all.
        self.ceiling = max(e for e in exits if e < NEVER) + DELETE * len(codes) + 2 * INSERT + OPEN_END

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """The arcs of a node; the last column has those to the exits."""
        i, state = divmod(node, 4)
        if i < len(self.codes):
            return ARCS[self.codes[i]][state]
        found = [("", self.exits[state], 4)] if self.exits[state] < NEVER else []
        return found + ([("I", INSERT, INSERTED[state])] if self.final else [])

    def solve(self, entry: int) -> int:
        """The cheapest cost from an entry state, which is its price in the end; NEVER if there is no way."""
        price, path = [*self.price, 0], [entry]
        while True:
            node = path[-1]
            best, to, column = NEVER, -1, node & ~3
            for _, cost, step in self.arcs(node):
                if cost + price[column + step] < best:
                    best, to = cost + price[column + step], column + step
            if best > self.ceiling:
                best = NEVER
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif to == self.target or price[entry] >= NEVER:
                self.price = price[:-1]
                return price[entry]
            else:
                path.append(to)

    def trace(self, entry: int) -> tuple[str, int]:
        """The initials that come first among all cheapest edits from an entry, and the exit state. After solve."""
        price = [*self.price, 0]
        dead: set[int] = set()
        path: list[tuple[int, str]] = [(entry, "")]
        while True:
            node = path[-1][0]
            for initial, cost, step in self.arcs(node):
                j = (node & ~3) + step
                if price[node] == cost + price[j] and j not in dead:
                    if j == self.target:
                        return "".join(c for _, c in path), node % 4
                    path.append((j, initial))
                    break
            else:  # a tight arc need not lead to the end from nodes beside the cheapest paths
                dead.add(path.pop()[0])


def _codes(letters: str) -> list[int]:
    return [ord(c) - 65 for c in letters]


def _illegal(letters: str) -> tuple[int, str, str]:
    kinds = [(INITIALS + "-")[c // 4] for c in _codes(letters)]
    return sum(a + b not in LEGAL for a, b in zip(kinds, kinds[1:])), kinds[0], kinds[-1]


def _whole(blocks: DataFrame) -> DataFrame:
    """Conversations of one block: conv, cost, audit, illegal."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits, wrong = [], [], []
            for letters in batch.column(1).to_pylist():
                lattice = Lattice(_codes(letters), AT_END, True)
                costs.append(lattice.solve(START))
                audits.append(lattice.trace(START)[0])
                wrong.append(_illegal(letters)[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(wrong, pa.int64())], names=["conv", "cost", "audit", "illegal"]
            )

    return blocks.select("conv", "codes").mapInArrow(work, "conv string, cost long, audit string, illegal long")


def _between(blocks: DataFrame) -> DataFrame:
    """For blocks of longer conversations the costs from each entry to each exit state."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for letters, final in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                codes, costs = _codes(letters), []
                for leave in range(4):
                    lattice = Lattice(codes, [0 if q == leave else NEVER for q in range(4)], final)
                    costs.append([lattice.solve(enter) for enter in range(4)])
                found.append([costs[leave][enter] for enter in range(4) for leave in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["conv", "block", "costs"])

    return blocks.select("conv", "block", "codes", "final").mapInArrow(work, "conv string, block long, costs array<long>")


def _behind(group: pd.DataFrame) -> pd.DataFrame:
    """The cost behind each exit state of each block of a conversation, from the last block to the first."""
    group = group.sort_values("block", ascending=False)
    exits, found = list(AT_END), []
    for costs in group["costs"]:
        found.append(exits)
        exits = [min(NEVER, *(int(costs[4 * enter + leave]) + exits[leave] for leave in range(4))) for enter in range(4)]
    return pd.DataFrame({"conv": group["conv"], "block": group["block"], "exits": found})


def _traced(blocks: DataFrame) -> DataFrame:
    """For blocks with the costs behind them the cost, initials and exit state from every entry."""
    schema = "conv string, block long, costs array<long>, audits array<string>, leaves array<int>, wrong long, first string, last string"
    names = ["conv", "block", "costs", "audits", "leaves", "wrong", "first", "last"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for letters, final, exits in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                lattice = Lattice(_codes(letters), exits, final)
                costs = [lattice.solve(enter) for enter in range(4)]
                ways = [lattice.trace(enter) if costs[enter] < NEVER else ("", START) for enter in range(4)]
                rows.append((costs, [w[0] for w in ways], [w[1] for w in ways], *_illegal(letters)))
            types = (pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string())
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    return blocks.select("conv", "block", "codes", "final", "exits").mapInArrow(work, schema)


def _followed(group: pd.DataFrame) -> pd.DataFrame:
    """The way through all blocks of a conversation from the front."""
    group = group.sort_values("block")
    state, audit, wrong, last = START, [], 0, None
    for r in group.itertuples():
        audit.append(r.audits[state])
        state = int(r.leaves[state])
        wrong += int(r.wrong) + (last is not None and last + r.first not in LEGAL)
        last = r.last
    row = group.iloc[0]
    return pd.DataFrame({"conv": [row["conv"]], "cost": [int(row["costs"][START])], "audit": ["".join(audit)], "illegal": [wrong]})


def solved(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, cost, audit, illegal from rows (conv, rank from 0, code as a letter)."""
    cut = settle(
        rows.select("conv", F.expr(f"rank div {block}").alias("block"), "rank", "code")
        .groupBy("conv", "block")  # at most `block` rows of a byte each
        .agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"])).alias("codes"))
    )
    ends = cut.groupBy("conv").agg(F.max("block").alias("end"))
    long = settle(ends.filter("end > 0"))
    if not long.limit(1).count():
        return _whole(cut)
    parts = settle(cut.join(hinted(long), "conv").withColumn("final", F.col("block") == F.col("end")).drop("end"))
    behind = _between(parts).groupBy("conv").applyInPandas(_behind, "conv string, block long, exits array<long>")
    ways = _traced(parts.join(behind, ["conv", "block"]))
    through = ways.groupBy("conv").applyInPandas(_followed, "conv string, cost long, audit string, illegal long")
    return _whole(cut.join(hinted(long.select("conv")), "conv", "left_anti")).unionByName(through)


def damaged(table: DataFrame) -> DataFrame:
    """conv, turn, role, text, copy after the damage; nulls are one space (in conv and in the sum too, not in turn)."""
    space = F.lit(" ")
    conv, at = F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    named = table.select(
        conv.alias("conv"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"),
        (F.crc32(F.concat(conv, F.lit(":"), at)) % 20).alias("fate"),
    )
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return named.filter("fate <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _blank(text: Column) -> Column:
    return ~text.rlike(f"[^{ANY_SPACE}]")


def _hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, repaired_sha256: every conversation's rows in order behind its edits, hashed one after the other."""
    texts = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", row_key(F.col("role"), F.col("text")).alias("key"), "copy", "text")
    edits = audits.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("key"), F.lit(0).alias("copy"), F.col("audit").alias("text"),
    )
    ordered = edits.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "key", "copy")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, last, digest, begun = None, "", 0, "", hashlib.sha256(), False
        done: list[tuple[str, str]] = []

        def put(role: str, text: str) -> None:
            nonlocal last, begun
            digest.update(f"\n{role}:{text}".encode() if begun else f"{role}:{text}".encode())
            last, begun = role[0], True

        def inserted() -> None:
            nonlocal at
            while audit[at:at + 1] == "I":
                put("assistant" if last == "u" else "user", "")
                at += 1

        def flush() -> list[pa.RecordBatch]:
            found = [pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["conv", "repaired_sha256"])] if done else []
            done.clear()
            return found

        for batch in batches:
            for own, kind, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if kind == 0:
                    if conv is not None:
                        inserted()
                        done.append((conv, digest.hexdigest()))
                    conv, audit, at, last, digest, begun = own, text, 0, "", hashlib.sha256(), False
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(role, text)
                elif edit == "R":
                    put("assistant" if last == "u" else "user", text)
            yield from flush()
        if conv is not None:
            inserted()
            done.append((conv, digest.hexdigest()))
            yield from flush()

    return ordered.select("conv", "kind", "role", "text").mapInArrow(work, "conv string, repaired_sha256 string")


def repair(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of table (conv_id, turn, role, text): gaps, faults, cost, audit and the repaired text's hash.

    Rows of a conversation stand by turn, nulls first; rows of the same turn by role, then by a hash of role and text,
    so repeated rows are neighbours. Null conv_ids are one conversation. A null role or text is one space. A
    conversation without rows after the damage has zeros, an empty audit and the hash of the empty string; an empty
    table gives no rows. Long texts are hashed as they come. Other columns are not read.
    """
    rows = damaged(table)
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(_blank(F.col("text")), BLANK).when(~F.col("text").rlike(rf"[.!?][{ANY_SPACE}]*\z"), TRUNCATED).otherwise(CLEAN)
    compact = rows.select("conv", "turn", "role", row_key(F.col("role"), F.col("text")).alias("key"), "copy", kind.alias("initial"), fault.alias("fault"))
    placed = settle(ranked(compact, "conv", "turn", "role", "key", "copy").select("conv", "turn", "key", "initial", "fault", "rank"))
    again = settle(placed.filter(F.col("fault") != BLANK).groupBy("conv", "key").agg(F.min("rank").alias("earliest"), F.count("*").alias("n")).filter("n > 1"))
    told = F.when(F.col("rank") > F.col("earliest"), DUPLICATE).otherwise(F.col("fault"))
    judged = settle(
        placed.join(hinted(again.select("conv", "key", "earliest")), ["conv", "key"], "left")
        .select("conv", "turn", "initial", "rank", F.when(F.col("fault") == BLANK, BLANK).otherwise(told).alias("fault"))
    )
    letter = F.char(F.lit(65) + F.col("initial") * 4 + F.col("fault"))
    ways = settle(solved(judged.select("conv", "rank", letter.alias("code")), block))
    faults = judged.groupBy("conv").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))])
    turns = judged.filter("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    every = table.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    joined = every
    for part in (gaps, faults, ways, _hashed(rows, ways)):
        joined = joined.join(part, "conv", "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
