"""Repair of the structure of conversations: the cheapest edits after which roles alternate.

A conversation shall read `(s?(ua)+)?` by the initials of its roles. Its rows are the steps of a
walk through the four states of that pattern: a row is kept, given another role or deleted, and
turns without text may be inserted anywhere. Costs are found first, then the least audit.

1. Cost. A row is a 4 x 4 matrix of least costs between states. Rows are collected in blocks of
   FAN, each block gives one product, and products are taken in blocks again, so the cost from
   every row to the end is known without any task holding a conversation.
2. Audit. The arcs of cheapest walks make a graph of nodes (row, state). Nodes are ranked by the
   first 1, 2, 4, .. letters of their least audit: a node's rank over 2n letters is the rank of
   the pair (its rank over n letters, the rank of the node its pointer over n letters leads to),
   and pointers double alongside. Ranks of up to 16 letters are numbers made of letters; longer
   ones are counted anew over the distinct pairs. Among arcs the least (letter, rank of the node
   it leads to) is taken. Conversations leave the rounds when their audit has ended, so a
   conversation of n rows costs log(n) rounds.
3. Path. The doubled pointers of the start, halved level by level, give every node of the least
   path. Its arcs are the edits.

One conversation may hold a third of all rows: it is placed by blocks (`operators.scan`), and its
nodes meet on (conversation, node). Its audit and the digest of its repaired text are single
values by definition: letters are joined in blocks, and one task takes the digest of the lines as
they pass, in order, without holding them.

Defined results. Nulls in any column read as one space; rows without a conv_id are one
conversation. Rows are taken in order of `turn`, nulls first, equal turns by role and then by the
digest of the text; repeated rows are rows of their own, the later ones duplicates. Empty and
blank texts have to go; texts of any length are taken whole. Among cheapest edits the audit that
sorts first is taken, and an audit names the edits completely. A conversation without rows has
zeros and an empty audit. An empty table gives no rows. Other columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.joins import small_or_not
from colloquy.operators.scan import ranked, sliding

from .common import key_of, store

FAN = 4096
SPACES = " \t\n\x0b\x0c\r"
LABELS = "DIKR"  # delete, insert, keep, rerole; their numbers from 1 on, 0 is the end
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
EXACT = 16       # letters whose rank is a number in base 5
FAR = 1 << 60

# States: 0 nothing yet, 1 after the system's turn, 2 after the user's, 3 after the assistant's.
ENDS = (0, 3)
ADDED = np.array([2, 2, 3, 2])  # where a turn of the role that is due leads
# Codes of rows: 0 to 3 by initial (s, u, a, other), 4 more if truncated, 8 if it has to go.
GONE = 8
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}  # (state, initial) -> state


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where a kept row leads by code and state (-1: nowhere), what keeping costs, the matrix of
    inserts and one row by code, and the costs from the last row on."""
    to, price = np.full((GONE + 1, 4), -1), np.zeros(GONE + 1, np.int64)
    inserts = np.where(np.eye(4, dtype=bool), 0, FAR)
    for s in range(4):
        inserts[s, ADDED[s]] = INSERT_COST
    closed = np.minimum(inserts, (inserts[:, :, None] + inserts[None]).min(1))
    rows = np.full((GONE + 1, 4, 4), FAR)
    for code in range(GONE + 1):
        price[code] = TRUNCATED_COST if 4 <= code < GONE else 0
        for s in range(4):
            rows[code, s, s] = DELETE_COST
            if code < GONE:
                to[code, s] = KEPT.get((s, code % 4), -1)
                rows[code, s, ADDED[s]] = min(rows[code, s, ADDED[s]], REROLE_COST + price[code])
                if to[code, s] >= 0:
                    rows[code, s, to[code, s]] = price[code]
    end = closed[:, list(ENDS)].min(1)
    return to, price, (closed[None, :, :, None] + rows[:, None]).min(2), end


KEEP_TO, PRICE, STEP, END = _tables()


# ------------------------------------------------------------------ damage and faults
def damaged(conversations: DataFrame) -> DataFrame:
    """(cid, turn, role, text, copy): rows dropped, emptied, cut, repeated or given to the user."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.pmod(F.crc32(name), F.lit(20))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select(
        key_of(F.col("conv_id")).alias("cid"), "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.posexplode(F.array_repeat(F.lit(0), copies)).alias("copy", "_zero")).drop("_zero")


def faulty_rows(rows: DataFrame) -> DataFrame:
    """(cid, pos, turn, role, text, fault, illegal, new_turn, code) of (cid, turn, role, text, copy)."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = ["turn", "role", "digest", "copy"]
    placed = ranked(rows.withColumn("digest", digest), order, ["cid"], "pos").withColumn("pos", F.col("pos") - 1)
    seen = ranked(placed, ["pos"], ["cid", "digest"], "seen")
    initial = F.substring("role", 1, 1)
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (F.when(stripped == "", "blank").when(F.col("seen") > 1, "duplicate")
             .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))
    known = seen.select("cid", "pos", "turn", "role", "text", initial.alias("initial"), fault.alias("fault"))
    near = sliding(known, ["pos"], ["cid"], 1, {
        "before": lambda frame: F.first("initial").over(frame(-1, -1)),
        "turn_before": lambda frame: F.first("turn").over(frame(-1, -1))})
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", kind + 4).otherwise(kind)
    return near.select(
        "cid", "pos", "turn", "role", "text", "fault",
        F.coalesce(~F.concat("before", "initial").isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & F.coalesce(F.col("turn_before") != F.col("turn"), F.lit(True))).alias("new_turn"),
        code.cast("tinyint").alias("code"))


def fault_counts(rows: DataFrame) -> DataFrame:
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0))
    return rows.groupBy("cid").agg(
        gaps.cast("bigint").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if("illegal").alias("illegal"))


# ------------------------------------------------------------------------- cost
class Ragged:
    """Lists of different lengths, longest first, so that the first ones go on together."""

    def __init__(self, column: pa.Array):
        self.values = column.flatten()
        lengths = np.diff(column.offsets.to_numpy())
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[self.order] if len(lengths) else lengths

    def running(self, step: int) -> int:
        """How many lists have more than `step` entries."""
        return int(np.searchsorted(-self.lengths, -step, "left"))


def longs(column: pa.Array, *shape: int) -> np.ndarray:
    """A column of lists of a fixed length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, *shape)


def as_lists(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel(), pa.int64()))


def products(lists: Ragged, matrices: np.ndarray) -> np.ndarray:
    """The least-cost product of each list of matrices, in the lists' own order."""
    made = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(lists.lengths), 4, 4)).copy()
    for step in range(lists.lengths[0] if len(lists.lengths) else 0):
        n = lists.running(step)
        one = matrices[lists.starts[:n] + lists.lengths[:n] - 1 - step]
        made[:n] = np.minimum((one[:, :, :, None] + made[:n, None]).min(2), FAR)
    return made[np.argsort(lists.order)]


def row_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = Ragged(b.column("codes"))
        made = products(lists, STEP[lists.values.to_numpy()])
        yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("block"), as_lists(made)], names=["cid", "at", "product"])


def block_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = products(Ragged(b.column("ats")), longs(b.column("products").flatten(), 4, 4))
        yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("up"), as_lists(made)], names=["cid", "at", "product"])


def block_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What follows each block, from what follows the group of blocks it is in."""
    for b in batches:
        lists, matrices = Ragged(b.column("ats")), longs(b.column("products").flatten(), 4, 4)
        now = longs(b.column("exit"), 4)[lists.order]
        out = np.empty((len(matrices), 4), np.int64)
        last = np.zeros(len(matrices), bool)
        group_last = b.column("last").to_numpy(zero_copy_only=False)[lists.order].astype(bool)
        for step in range(lists.lengths[0] if len(lists.lengths) else 0):
            n = lists.running(step)
            place = lists.starts[:n] + lists.lengths[:n] - 1 - step
            out[place] = now[:n]
            if step == 0:
                last[place] = group_last[:n]
            now[:n] = (matrices[place] + now[:n, None]).min(2)
        owner = np.repeat(np.arange(len(lists.lengths)), np.diff(b.column("ats").offsets.to_numpy()))
        yield pa.RecordBatch.from_arrays(
            [b.column("cid").take(pa.array(owner)), lists.values, as_lists(out), pa.array(last)], names=["cid", "at", "exit", "last"])


def exits(level: DataFrame, fan: int) -> DataFrame:
    """(cid, at, exit, last) of (cid, at, product): the costs from the end of each block on."""
    level = store(level, "repair-products")
    groups = level.groupBy("cid", F.floor(F.col("at") / fan).alias("up")).agg(
        F.array_sort(F.collect_list(F.struct("at", "product"))).alias("l")).select(
        "cid", "up", F.col("l.at").alias("ats"), F.col("l.product").alias("products"))
    if (level.agg(F.max("at")).first()[0] or 0) < fan:
        after = groups.withColumns(the_end())
    else:
        above = groups.mapInArrow(block_products, "cid string, at bigint, product array<bigint>")
        after = groups.join(exits(above, fan).withColumnRenamed("at", "up"), ["cid", "up"])
    return after.select("cid", "ats", "products", "exit", "last").mapInArrow(
        block_exits, "cid string, at bigint, exit array<bigint>, last boolean")


def the_end() -> dict[str, Column]:
    return {"exit": F.array(*[F.lit(int(c)).cast("bigint") for c in END]), "last": F.lit(True)}


def cheapest_arcs(fan: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The arcs of cheapest walks out of the nodes that such walks can reach within a block.

    (cid, node, label, to, fin, togo): a node is 4 * row + state, `fin` says that `to` is the
    end of the conversation, `togo` is the cost from the node on. An end leads to itself.
    """
    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = Ragged(b.column("codes"))
            codes, sizes = lists.values.to_numpy().astype(np.int64), lists.lengths
            block = b.column("block").to_numpy()[lists.order].astype(np.int64)
            last = b.column("last").to_numpy(zero_copy_only=False)[lists.order].astype(bool)
            layer = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(sizes) else sizes
            togo = np.empty((int((sizes + 1).sum()), 4), np.int64)
            now = longs(b.column("exit"), 4)[lists.order]
            togo[layer + sizes] = now
            for step in range(sizes[0] if len(sizes) else 0):
                n = lists.running(step)
                at = sizes[:n] - 1 - step
                now[:n] = (STEP[codes[lists.starts[:n] + at]] + now[:n, None]).min(2)
                togo[layer[:n] + at] = now[:n]

            found: list[tuple[np.ndarray, ...]] = []
            reached = np.ones((len(sizes), 4), bool)
            reached[block == 0, 1:] = False
            for at in range(int(sizes[0]) + 1 if len(sizes) else 0):
                n = lists.running(at - 1) if at else len(sizes)
                more = lists.running(at)
                here, seen = togo[layer[:n] + at], reached[:n]
                # A block that is not the last leaves its end to the next one.
                mine = (sizes[:n] > at) | last[:n]
                row = block[:n] * fan + at

                def add(label: int, who: np.ndarray, good: np.ndarray, to_row: np.ndarray, to: np.ndarray) -> None:
                    i, s = np.nonzero(good)
                    fin = last[who[i]] & (to_row[i] == block[who[i]] * fan + sizes[who[i]]) & np.isin(to[i, s], ENDS)
                    found.append((who[i], 4 * row[who[i]] + s, np.full(len(i), label), 4 * to_row[i] + to[i, s], fin, here[who[i], s]))
                every = np.arange(n)
                due = np.broadcast_to(ADDED, (n, 4))
                cheap = (here == INSERT_COST + here[:, ADDED]) & mine[:, None]
                for _ in range(2):
                    for s in range(4):
                        seen[:, ADDED[s]] |= seen[:, s] & cheap[:, s]
                add(INSERT, every, seen & cheap, row, due)
                ended = (sizes[:n] == at) & last[:n]
                final = seen & ended[:, None] & np.isin(np.arange(4), ENDS)
                add(0, every, final, row, np.broadcast_to(np.arange(4), (n, 4)))
                if not more:
                    continue
                code, some = codes[lists.starts[:more] + at], np.arange(more)
                after, start = togo[layer[:more] + at + 1], seen[:more]
                following = np.zeros((more, 4), bool)
                same = np.broadcast_to(np.arange(4), (more, 4))
                price = PRICE[code][:, None]
                for label, to, cost, allowed in (
                        (DELETE, same, DELETE_COST, np.ones((more, 4), bool)),
                        (KEEP, KEEP_TO[code], price, KEEP_TO[code] >= 0),
                        (REROLE, due[:more], REROLE_COST + price, np.broadcast_to((code < GONE)[:, None], (more, 4)))):
                    good = start & allowed & (here[:more] == cost + np.take_along_axis(after, np.maximum(to, 0), 1))
                    add(label, some, good, row[:more] + 1, to)
                    i, s = np.nonzero(good)
                    following[i, to[i, s]] = True
                reached[:more] = following
            who, node, label, to, fin, cost = ([np.concatenate(c) for c in zip(*found)] if found else [np.array([], np.int64)] * 6)
            yield pa.RecordBatch.from_arrays([
                b.column("cid").take(pa.array(lists.order[who])), pa.array(node, pa.int64()), pa.array(label, pa.int64()),
                pa.array(to, pa.int64()), pa.array(fin.astype(bool)), pa.array(cost, pa.int64())],
                names=["cid", "node", "label", "to", "fin", "togo"])
    return arcs


def optimal_arcs(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """The arcs of cheapest walks through the rows (cid, pos, code) of each conversation."""
    blocks = rows.groupBy("cid", F.floor(F.col("pos") / fan).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("l")).select("cid", "block", F.col("l.code").alias("codes"))
    blocks = store(blocks, "repair-blocks")
    if (blocks.agg(F.max("block")).first()[0] or 0) == 0:
        after = blocks.withColumns(the_end())
    else:
        level = blocks.mapInArrow(row_products, "cid string, at bigint, product array<bigint>")
        after = blocks.join(exits(level, fan).withColumnRenamed("at", "block"), ["cid", "block"])
    return after.select("cid", "block", "codes", "exit", "last").mapInArrow(
        cheapest_arcs(fan), "cid string, node bigint, label bigint, to bigint, fin boolean, togo bigint")


# ------------------------------------------------------------------- least audit
def path_ranks(arcs: DataFrame) -> list[DataFrame]:
    """(cid, node, rank, to, fin) by level: rank and end of a node's least audit of 2 ** level letters.

    A level holds the conversations whose audit is longer than the level before it reaches.
    """
    # One letter: the least arc. Letters tell arcs of a node apart, so ranks have no tie to break here.
    level = arcs.groupBy("cid", "node").agg(F.min(F.struct("label", "to", "fin")).alias("a")).select(
        "cid", "node", F.col("a.label").alias("rank"), "a.to", "a.fin")
    levels, letters = [], 1
    while True:
        level = store(level, f"repair-level{len(levels)}")
        levels.append(level)
        open_ones = level.where("node = 0 AND NOT fin").select("cid")
        if open_ones.isEmpty():
            return levels
        going = level.join(small_or_not(open_ones), "cid", "left_semi")
        ahead = going.select("cid", F.col("node").alias("to"), F.col("rank").alias("rank2"), F.col("to").alias("to2"), F.col("fin").alias("fin2"))
        pairs = going.drop("fin").join(ahead, ["cid", "to"]).select(
            "cid", "node", "rank", "rank2", F.col("to2").alias("to"), F.col("fin2").alias("fin"))
        if letters < EXACT:
            level = pairs.withColumn("rank", F.col("rank") * 5 ** letters + F.col("rank2")).drop("rank2")
        else:
            pairs = store(pairs, "repair-pairs")
            counted = ranked(pairs.select("rank", "rank2").distinct(), ["rank", "rank2"], (), "new")
            # Audits of long runs of kept rows are one pair each, met by many nodes.
            level = pairs.join(small_or_not(counted), ["rank", "rank2"]).select(
                "cid", "node", F.col("new").alias("rank"), "to", "fin")
        letters *= 2


def chosen_arcs(arcs: DataFrame, level: DataFrame) -> DataFrame:
    """Of each node the arc of the least letter and, after that, the least rank of where it leads."""
    ends = level.select("cid", F.col("node").alias("to"), "rank")
    return arcs.join(ends, ["cid", "to"], "left").groupBy("cid", "node").agg(
        F.min(F.struct("label", F.coalesce("rank", F.lit(0)).alias("rank"), "to")).alias("a")).select(
        "cid", "node", F.col("a.label").alias("label"), F.col("a.to").alias("to"))


def least_paths(arcs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(cid, at, node, label): the edits of each conversation in order."""
    path = None
    for k in range(len(levels) - 1, -1, -1):
        starts = levels[k].where("node = 0 AND fin").select("cid", "node", F.lit(0).cast("bigint").alias("at"))
        if k > 0:  # those that had ended before are in an earlier level
            starts = starts.join(levels[k - 1].where("node = 0 AND fin").select("cid"), "cid", "left_anti")
        path = starts if path is None else path.unionByName(starts)
        if k == 0:
            break
        half = path.join(levels[k - 1].select("cid", "node", "to"), ["cid", "node"])
        steps = F.array(F.struct("node", "at"), F.struct(F.col("to").alias("node"), (F.col("at") + (1 << (k - 1))).alias("at")))
        path = half.select("cid", F.explode(steps).alias("s")).select("cid", "s.node", "s.at")
    return path.join(chosen_arcs(arcs, levels[0]), ["cid", "node"]).where("label > 0").select("cid", "at", "node", "label")


# ------------------------------------------------------------------------ results
def passing_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lines of each conversation, as they come in order."""
    cid, digest = None, None
    names = ["cid", "repaired_sha256"]
    for batch in batches:
        out: list[tuple[str, str]] = []
        for c, line in zip(batch.column("cid").to_pylist(), batch.column("line").to_pylist()):
            if c != cid:
                if cid is not None:
                    out.append((cid, digest.hexdigest()))
                cid, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=names)
    if cid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([cid]), pa.array([digest.hexdigest()])], names=names)


def repaired_lines(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """(cid, at, role, text) of the conversations after their edits."""
    kept = edits.where(F.col("label") != DELETE)
    row = F.when(F.col("label") != INSERT, F.shiftright("node", 2)).alias("pos")
    due = F.when(F.col("node") % 4 == 2, "assistant").otherwise("user")
    said = kept.select("cid", "at", "label", due.alias("due"), row).join(rows.select("cid", "pos", "role", "text"), ["cid", "pos"], "left")
    return said.select("cid", "at", F.when(F.col("label") == KEEP, F.col("role")).otherwise(F.col("due")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))


def repair_plan(rows: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The edits (cid, at, node, label) and the cost (cid, cost) of rows (cid, pos, code)."""
    arcs = store(optimal_arcs(rows, fan), "repair-arcs")
    levels = path_ranks(arcs)
    edits = store(least_paths(arcs, levels), "repair-edits")
    return edits, arcs.where("node = 0").groupBy("cid").agg(F.min("togo").alias("cost"))


def repair_conversations(conversations: DataFrame, fan: int = FAN) -> DataFrame:
    """Every conversation with its faults after damage, the cost, the audit and the digest."""
    rows = store(faulty_rows(damaged(conversations)), "repair-rows")
    edits, costs = repair_plan(rows.select("cid", "pos", "code"), fan)
    letter = F.substring(F.lit(LABELS), F.col("label").cast("int"), F.lit(1))
    parts = edits.groupBy("cid", F.shiftright("at", 16).alias("part")).agg(F.array_join(F.array_sort(
        F.collect_list(F.struct("at", letter.alias("x")))).getField("x"), "").alias("letters"))
    audits = parts.groupBy("cid").agg(F.array_join(F.array_sort(
        F.collect_list(F.struct("part", "letters"))).getField("letters"), "").alias("audit"))
    lines = repaired_lines(edits, rows).select("cid", "at", F.concat_ws(":", "role", "text").alias("line"))
    digests = lines.repartition("cid").sortWithinPartitions("cid", "at").select("cid", "line").mapInArrow(
        passing_digests, "cid string, repaired_sha256 string")
    known = conversations.select("conv_id", key_of(F.col("conv_id")).alias("cid")).distinct()
    sides = [fault_counts(rows), costs, audits, digests]
    joined = reduce(lambda a, b: a.join(b, "cid", "left"), sides, known)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
