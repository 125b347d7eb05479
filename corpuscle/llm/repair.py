"""Conversation structure repair: the cheapest edits that give roles of the form ``(s?(ua)+)?``, by block tables.

Rows are symbols: the role's initial and the row's fault. The cost of the rest of a conversation, for each of the
four states of the grammar, is a vector whose differences are bounded, so there are few vectors up to their least entry.
Tables give for each block of symbols and each such vector behind it the vector before it and what it adds. A conversation
is worked off from its end by looking its blocks up; only the vectors between blocks are kept. The edits are then traced
from the start: a block is expanded backward into its inner vectors, and as these are costs to go, taking the least letter
that keeps the cost gives the least text of all cheapest ones.

Rows are range-sorted, so a long conversation is cut into segments over several tasks. A segment tells what it does to
every vector, the segments of a conversation are chained, and each is traced from every state it may start in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import WORD, scratch

# States: nothing yet, after s, after u, after a. What u or a may follow is one letter in each.
START, SYSTEM, USER, DONE = range(4)
NEXT = (USER, USER, DONE, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, DONE: USER}, "a": {USER: DONE}, "x": {}}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 20
BLOCK = 3
# A row's code is its initial's place times four and its fault's place.
INITIALS, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
SYMBOLS = 9  # deleted, and each initial with and without a cut end
CLASS = np.array([0 if f in (1, 2) else 1 + 2 * i + (f == 3) for i in range(4) for f in range(4)], np.int64)
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au
SEGMENT = "conv_id long, part int, codes binary, moves binary, illegal long, head int, tail int"
SENTENCE_END = "[.!?]"


def _closed(cost: list[int]) -> tuple[int, ...]:
    """Costs when rows may also be inserted first."""
    cost = list(cost)
    for _ in range(3):
        for q, to in enumerate(NEXT):
            cost[q] = min(cost[q], INSERT + cost[to])
    return tuple(min(c, NEVER) for c in cost)


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row, by those behind it."""
    cost = [DELETE + c for c in after]
    if symbol:
        keeps, more = KEPT[INITIALS[(symbol - 1) // 2]], TRUNCATED * ((symbol - 1) % 2)
        for q in range(4):
            cost[q] = min(cost[q], more + REROLE + after[NEXT[q]], *([more + after[keeps[q]]] if q in keeps else []))
    return _closed(cost)


class Tables:
    """Normalised vectors and their transitions by symbols and blocks; vector 0 is that behind the last row."""

    def __init__(self):
        end = _closed([0, NEVER, NEVER, 0])
        vectors, step, add = {end: 0}, [], []
        queue = [end]
        for v in queue:
            step.append([])
            add.append([])
            for symbol in range(SYMBOLS):
                cost = _before(symbol, v)
                least = min(cost)
                cost = tuple(c - least for c in cost)
                if cost not in vectors:
                    vectors[cost] = len(vectors)
                    queue.append(cost)
                step[-1].append(vectors[cost])
                add[-1].append(least)
        self.vectors = np.array(queue, np.int64)
        self.step, self.add = np.array(step, np.int64), np.array(add, np.int64)
        # A block's code has its first symbol in the highest place; the last is worked off first
        codes = np.arange(SYMBOLS**BLOCK)
        at = np.broadcast_to(np.arange(len(queue))[:, None], (len(queue), len(codes))).copy()
        total = np.zeros_like(at)
        for k in range(BLOCK):
            symbol = codes // SYMBOLS**k % SYMBOLS
            total += self.add[at, symbol]
            at = self.step[at, symbol]
        self.block_step, self.block_add = at, total

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the whole blocks, and the symbols that are left behind the last."""
        whole = len(symbols) // BLOCK * BLOCK
        return symbols[:whole].reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK)[::-1], symbols[whole:]

    def moved(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the symbols the one before them, and what they add."""
        at, total = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        blocks, rest = self.blocks(symbols)
        for symbol in rest[::-1]:
            total += self.add[at, symbol]
            at = self.step[at, symbol]
        for code in blocks[::-1]:
            total += self.block_add[at, code]
            at = self.block_step[at, code]
        return at, total

    def _chain(self, symbols, vector: int) -> list[int]:
        """Vectors before each symbol and behind the last."""
        out = [vector]
        for symbol in symbols[::-1]:
            out.append(int(self.step[out[-1], symbol]))
        return out[::-1]

    def traced(self, symbols: np.ndarray, vector: int, state: int, last: bool) -> tuple[str, int]:
        """The least of the cheapest edits from a state, with ``vector`` behind the symbols, and the state they lead to."""
        blocks, rest = self.blocks(symbols)
        tail = self._chain(rest, vector)
        behind = [tail[0]]
        for code in blocks[::-1]:
            behind.append(int(self.block_step[behind[-1], code]))
        behind = behind[::-1]
        edits: list[str] = []
        for k in range(len(blocks)):
            part = symbols[k * BLOCK : (k + 1) * BLOCK]
            state = self._choose(part, self._chain(part, behind[k + 1]), state, edits)
        state = self._choose(rest, tail, state, edits)
        while last and state not in (START, DONE):
            edits.append("I")
            state = NEXT[state]
        return "".join(edits), state

    def _choose(self, symbols, vectors: list[int], state: int, edits: list[str]) -> int:
        for symbol, now, then in zip(symbols.tolist(), vectors, vectors[1:]):
            here, after, gain = self.vectors[now], self.vectors[then], self.add[then, symbol]
            keeps = KEPT[INITIALS[(symbol - 1) // 2]] if symbol else {}
            more = TRUNCATED * ((symbol - 1) % 2) if symbol else 0
            while True:
                cost = here[state] + gain
                if DELETE + after[state] == cost:
                    edits.append("D")
                elif INSERT + here[NEXT[state]] + gain == cost:
                    edits.append("I")
                    state = NEXT[state]
                    continue
                elif state in keeps and more + after[keeps[state]] == cost:
                    edits.append("K")
                    state = keeps[state]
                else:
                    edits.append("R")
                    state = NEXT[state]
                break
        return state


@cache
def tables() -> Tables:
    return Tables()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that the CRC-32 of ``conv_id:turn`` modulo 20 names; nulls read as one blank."""
    blank = F.lit(" ")
    conv_id, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    kind = F.crc32(F.concat(F.coalesce(conv_id.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))) % 20
    read = rows.select(
        conv_id.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"), kind.alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", SENTENCE_END, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    done = read.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def _sha(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows without their texts in the order of conversations, ``part, pos`` by partition, from a table in the scratch folder."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha"), F.col("salt")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # cuts even a long run of equal rows
    dealt = salted.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    placed = dealt.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return scratch(placed, "turns")


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        moves, illegal, head, tail = [], [], [], []
        for data in batch.column("codes").to_pylist():
            codes = np.frombuffer(data, np.uint8)
            at, total = tables().moved(CLASS[codes])
            initial = codes // 4
            moves.append(np.concatenate([at, total]).astype("<i8").tobytes())
            illegal.append(int((~LEGAL[initial[:-1], initial[1:]]).sum()))
            head.append(int(initial[0]))
            tail.append(int(initial[-1]))
        made = [pa.array(moves, pa.binary()), pa.array(illegal, pa.int64()), pa.array(head, pa.int32()), pa.array(tail, pa.int32())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "codes")), *made], names=["conv_id", "part", "codes", "moves", "illegal", "head", "tail"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = len(tables().vectors)
    for batch in batches:
        found = []
        for pieces in batch.column("pieces").to_pylist():
            at, cost, behind = 0, 0, []
            for piece in reversed(pieces):
                behind.append({"part": piece["part"], "behind": at, "first": False, "last": not behind})
                moves = np.frombuffer(piece["moves"], "<i8")
                cost += int(moves[size + at])
                at = int(moves[at])
            behind[-1]["first"] = True
            found.append({"cost": cost + int(tables().vectors[at][START]), "pieces": behind})
        kinds = pa.schema([("cost", pa.int64()), ("pieces", pa.list_(pa.struct([("part", pa.int32()), ("behind", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])))])
        table = pa.RecordBatch.from_pylist(found, kinds)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *table.columns], names=["conv_id", "cost", "pieces"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("edits", pa.string()), ("state", pa.int32())]))
    for batch in batches:
        out = []
        for codes, behind, first, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "behind", "first", "last")), strict=True):
            symbols = CLASS[np.frombuffer(codes, np.uint8)]
            traces = [tables().traced(symbols, behind, q, last) for q in ([START] if first else range(4))]
            out.append([{"edits": e, "state": q} for e, q in traces])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(out, kinds)], names=["conv_id", "part", "traces"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams conversations in order: edits come before the rows they are for."""
    kinds = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, sha, state, edits, at, empty = (), None, START, [], 0, True

    def write(role: str, text: str) -> None:
        nonlocal empty
        sha.update((("" if empty else "\n") + role + ":" + text).encode())
        empty = False

    def inserts() -> None:
        nonlocal state, at
        while edits and edits[0][at : at + 1] == "I":
            state = NEXT[state]
            write("user" if state == USER else "assistant", "")
            forward()

    def forward() -> None:
        nonlocal at
        at += 1
        while edits and at >= len(edits[0]):
            edits.pop(0)
            at = 0

    for batch in batches:
        done = []
        for c, piece, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "role", "text")), strict=True):
            if (c,) != conv:
                if sha:
                    inserts()
                    done.append({"conv_id": conv[0], "repaired_sha256": sha.hexdigest()})
                conv, sha, state, edits, at, empty = (c,), hashlib.sha256(), START, [], 0, True
            if piece is not None:
                if piece:
                    edits.append(piece)
                continue
            inserts()
            edit = edits[0][at]
            if edit == "R":
                state = NEXT[state]
                write("user" if state == USER else "assistant", text)
            elif edit == "K":
                state = KEPT[role[0]][state]
                write(role, text)
            forward()
        yield pa.RecordBatch.from_pylist(done, kinds)
    if sha:
        inserts()
        yield pa.RecordBatch.from_pylist([{"conv_id": conv[0], "repaired_sha256": sha.hexdigest()}], kinds)


def repaired(originals: DataFrame, rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for each id in ``originals``.

    ``rows`` has ``conv_id, turn, role, text`` without nulls but in ``conv_id``, which is then an id like any other, and
    ``turn``, which comes first. Rows of one turn come by role and then by the hash of role and text. A row's first fault counts: blank,
    duplicate (role and text seen earlier, so all but one of equal rows), truncated. An id without rows has zeros, no
    edits and the hash of an empty text, as has one whose rows are all deleted. Texts are moved once, to hash
    the repaired conversation in order, which one task streams; all else is done on their faults, by segments.
    """
    sha = _sha(F.col("role"), F.col("text"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select("conv_id", "turn", "role", sha.alias("sha"), (~F.col("text").rlike(WORD)).alias("blank"), (~last.rlike(SENTENCE_END)).alias("cut"))
    initial = F.substring("role", 1, 1)
    coded = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    turns = _sorted(narrow.withColumn("initial", coded))

    order = F.struct("part", "pos")
    firsts = turns.groupBy(F.col("conv_id").alias("_conv"), F.col("sha").alias("_sha")).agg(F.min(order).alias("_first"))
    marked = turns.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("sha") == F.col("_sha")))
    fault = F.when(F.col("blank"), 1).when(F.col("_first") != order, 2).when(F.col("cut"), 3).otherwise(0)
    code = F.col("initial") * 4 + fault

    pieces = marked.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("pos", code.alias("code")))).alias("all"),
        F.min(F.struct("pos", "turn", "role", "sha")).alias("start"),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
        F.count_distinct("turn").alias("turns"),
        *[F.count_if(fault == k).alias(name) for k, name in enumerate(FAULTS) if k],
    )
    codes = F.unhex(F.array_join(F.transform("all", lambda x: F.lpad(F.hex(x["code"]), 2, "0")), ""))
    segments = scratch(pieces.withColumn("codes", codes).drop("all"), "segments")
    moves = scratch(segments.select("conv_id", "part", "codes").mapInArrow(_moves, SEGMENT), "moves")

    # A conversation has at most as many segments as there are partitions
    lists = moves.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "moves"))).alias("pieces"))
    chained = scratch(lists.mapInArrow(_chained, "conv_id long, cost long, pieces array<struct<part: int, behind: int, first: boolean, last: boolean>>"), "chained")
    places = chained.select(F.col("conv_id").alias("_conv"), F.explode("pieces").alias("at")).select("_conv", F.col("at.part").alias("_part"), "at.behind", "at.first", "at.last")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    traced = moves.join(places, same).select("conv_id", "part", "codes", "behind", "first", "last")
    traces = scratch(traced.mapInArrow(_traces, "conv_id long, part int, traces array<struct<edits: string, state: int>>"), "traces")
    walked = traces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "traces"))).alias("found"))
    step = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<part: int, edits: string>>").alias("edits")),
        lambda so, x: F.struct(
            F.get(x["traces"], so["state"])["state"].alias("state"),
            F.concat(so["edits"], F.array(F.struct(x["part"].alias("part"), F.get(x["traces"], so["state"])["edits"].alias("edits")))).alias("edits"),
        ),
    )
    audits = scratch(walked.select("conv_id", step["edits"].alias("edits")), "audits")

    # Segments of a conversation meet where the first row of one follows the last of the other
    ahead = Window.partitionBy("conv_id").orderBy("part")
    tail = F.lag("tail").over(ahead)
    across = (tail.isNotNull() & ~_legal(tail, F.col("head"))).cast("long")
    again = F.coalesce(F.lag("high").over(ahead) == F.col("low"), F.lit(False)).cast("long")
    met = segments.drop("codes", "start").join(moves.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "illegal", "head", "tail"), same)
    counts = (
        met.withColumn("across", across)
        .withColumn("again", again)
        .groupBy(F.col("conv_id").alias("_c0"))
        .agg(
            F.coalesce(F.max("high") - F.min("low") + 1 - (F.sum("turns") - F.sum("again")), F.lit(0)).alias("gaps"),
            *[F.sum(name).alias(name) for name in FAULTS if name],
            F.sum(F.col("illegal") + F.col("across")).alias("illegal"),
        )
    )
    audit = audits.select(F.col("conv_id").alias("_c1"), F.array_join("edits.edits", "").alias("audit"))
    cost = chained.select(F.col("conv_id").alias("_c2"), "cost")
    hashes = _hashes(rows.withColumn("sha", sha), segments, audits).withColumnRenamed("conv_id", "_c3")
    out = originals.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for more, key in ((counts, "_c0"), (audit, "_c1"), (cost, "_c2"), (hashes, "_c3")):
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col(key)), "left").drop(key)
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *(name for name in FAULTS if name), "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _legal(a: Column, b: Column) -> Column:
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def _hashes(rows: DataFrame, segments: DataFrame, audits: DataFrame) -> DataFrame:
    """Each segment's edits go before its first row, so that one pass in order has both at hand."""
    edits = audits.select(F.col("conv_id").alias("_conv"), F.explode("edits").alias("e")).select("_conv", F.col("e.part").alias("_part"), F.col("e.edits").alias("edits"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    before = segments.join(edits, same).select("conv_id", "start.turn", "start.role", "start.sha", "part", "edits", F.lit("").alias("text"))
    both = before.unionByName(rows, allowMissingColumns=True).repartition("conv_id")
    ordered = both.sortWithinPartitions("conv_id", "turn", "role", "sha", F.col("part").asc_nulls_last())
    return ordered.select("conv_id", "edits", "role", "text").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
