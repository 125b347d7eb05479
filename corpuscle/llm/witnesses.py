"""A Merkle manifest of a dataset with a witness per row, built by incremental witnesses.

Leaves are appended in order. A run of up to eight siblings stays open until its last member has come;
each open run knows the leaves below its members, and completing it extends the witnesses of all of them by
the siblings of their branch. Rows are dealt in aligned blocks, so each block is a subtree that a task
appends on its own; the block roots are then appended in just the same way, until one root is left, and each
round extends the witnesses that the one before has left partial. No task holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import scratch

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
LEVELS = 4
SIZE = 32
IN_PARTITION = (1 << 33) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(nodes: bytes) -> bytes:
    """SHA-256 over the hex text of 32-byte nodes."""
    return hashlib.sha256(nodes.hex().encode()).digest()


def leaf(*values: Column) -> Column:
    """Hex SHA-256 of the values: ``-`` for a null, else the UTF-8 size, a colon and the value."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(v) for v in values]), 256)


class Appender:
    """Open runs of a subtree, lowest level first, and the witnesses of the leaves appended so far."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[bytes, list[int]]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[bytearray] = []

    def append(self, node: bytes) -> None:
        self.witnesses.append(bytearray())
        self._attach(0, node, [len(self.witnesses) - 1])

    def _attach(self, level: int, node: bytes, below: list[int]) -> None:
        self.open[level].append((node, below))
        if len(self.open[level]) == ARITY and level < self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = b"".join(n for n, _ in run)
        for k, (_, below) in enumerate(run):
            siblings = nodes[: SIZE * k] + nodes[SIZE * (k + 1) :]
            if siblings:
                for w in below:
                    self.witnesses[w] += siblings
        self._attach(level + 1, digest(nodes), [w for _, below in run for w in below])

    def finish(self) -> bytes:
        """Completes the runs that are short and returns the root."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0][0]


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while 1 << ARITY_BITS * levels < n:
        levels += 1
    return levels


def fold(node: bytes, at: int, n: int, witness: bytes) -> tuple[bytes, int]:
    """The root that follows from a leaf, its place among ``n`` leaves and its witness, and the bytes used."""
    used = 0
    while n > 1:
        place, run = at % ARITY, min(ARITY, n - at + at % ARITY)
        split, end = used + SIZE * place, used + SIZE * (run - 1)
        node = digest(witness[used:split] + node + witness[split:end])
        at, n, used = at // ARITY, -(-n // ARITY), end
    return node, used


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Adds ``at``, the row's place in its tree, and ``n``, the tree's size, from a table in the scratch folder.

    Rows are range-sorted over all trees, so a large tree is spread over tasks, and counts per partition and
    tree give each partition its start. Rows equal in ``order`` come in any order, nulls first.
    """
    cols = [F.col(c).asc_nulls_first() for c in (tree, *order, "_salt")]
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = salted.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).drop("_salt")
    placed = scratch(
        dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(IN_PARTITION)), name
    )
    of_tree = Window.partitionBy("_tree")
    starts = (
        placed.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_in"))
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(of_tree.orderBy("_in")) - F.col("_rows") - F.col("_first"))
        .withColumn("n", F.sum("_rows").over(of_tree))
    )
    joined = placed.join(starts, (F.col("_part") == F.col("_in")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return joined.select(*[placed[c] for c in rows.columns], (F.col("_at") + F.col("_before")).alias("at"), "n")


def _append_block(levels: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        size = table.column("n")[0].as_py()
        block = Appender(min(levels, height(size)))
        for node in table.column("node").to_pylist():
            block.append(node)
        root = block.finish()
        return pa.table(
            {
                "tree": table.column("tree"),
                "n": table.column("n"),
                "at": table.column("at"),
                "block": table.column("block"),
                "witness": pa.array([bytes(w) for w in block.witnesses], pa.binary()),
                "root": pa.array([root] * table.num_rows, pa.binary()),
            }
        )

    return run


def appended(nodes: DataFrame, levels: int = LEVELS, name: str = "witnesses") -> DataFrame:
    """``tree, at, witness, root`` for each of ``tree, n, at, node``: the whole witness and the tree's root.

    ``tree`` is a long. Each round appends blocks of ``8 ** levels`` nodes to their subtree; the next round's nodes are
    the block roots. The largest tree decides how many rounds there are, and trees that are done drop out.
    """
    wide, rounds = 1 << ARITY_BITS * levels, []
    while True:
        k = len(rounds)
        blocks = nodes.withColumn("block", F.shiftright("at", ARITY_BITS * levels)).groupBy("tree", "block")
        done = scratch(blocks.applyInArrow(_append_block(levels), "tree long, n long, at long, block long, witness binary, root binary"), f"{name}-{k}")
        rounds.append(done)
        more = done.where(F.col("n") > wide)
        if more.isEmpty():
            break
        nodes = more.where(F.col("at") % wide == 0).select(
            "tree", F.ceil(F.col("n") / wide).cast("long").alias("n"), F.col("block").alias("at"), F.col("root").alias("node")
        )
    out = rounds.pop().select("tree", "at", "witness", "root")
    while rounds:
        above = out.select("tree", F.col("at").alias("block"), F.col("witness").alias("_more"), F.col("root").alias("_top"))
        out = rounds.pop().join(above, ["tree", "block"], "left").select(
            "tree", "at", F.concat("witness", F.coalesce("_more", F.lit(b""))).alias("witness"), F.coalesce("_top", "root").alias("root")
        )
    return out


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, lang, leaf, subroot, root, witness, changed, at, n, lang_at, langs`` per document.

    A leaf is the hash of ``doc_id, source, lang, n_chars, text``, each null marked apart from any value. Leaves
    ascend by id in each language, null ids first and equal ids by their leaf; the languages' roots ascend by name, null
    first, under one root. ``witness`` is the siblings of all levels up to that root. ``changed`` is the leaf of the
    document with A-Z of its text lower-cased where 3 divides the CRC-32 of its id, else null, as for null ids. Repeated
    rows are leaves of their own; an empty text is a value; an empty table has no rows. Texts are hashed where they are
    read and never shuffled; other columns are not touched.
    """
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    doc_id, source, lang, n_chars, text = (F.col(f"`{c}`").cast(kind) for c, kind in kinds.items())
    changed = F.when(F.crc32(doc_id.cast("string")) % 3 == 0, leaf(doc_id, source, lang, n_chars, F.translate(text, UPPER, LOWER)))
    leaves = docs.select(
        doc_id.alias("doc_id"), lang.alias("lang"), F.unhex(leaf(doc_id, source, lang, n_chars, text)).alias("node"), F.unhex(changed).alias("changed")
    )
    rows = scratch(numbered(leaves, "lang", ["doc_id", "node"], "leaves"), "numbered")

    names = rows.groupBy("lang").agg(F.max("n").alias("size"))
    langs = scratch(
        numbered(names.withColumn("whole", F.lit(0)), "whole", ["lang"], "langs").select("lang", F.col("at").alias("lang_at"), F.col("n").alias("langs")),
        "lang-numbers",
    )
    placed = rows.join(langs, rows["lang"].eqNullSafe(langs["lang"])).select(*[rows[c] for c in rows.columns], "lang_at", "langs")
    placed = scratch(placed, "placed")
    inner = scratch(appended(placed.select(F.col("lang_at").alias("tree"), "n", "at", "node"), levels, "leaf-witnesses"), "inner")

    tops = inner.where("at = 0").join(langs, F.col("tree") == F.col("lang_at"))
    outer = appended(tops.select(F.lit(0).cast("long").alias("tree"), F.col("langs").alias("n"), F.col("lang_at").alias("at"), F.col("root").alias("node")), levels, "lang-witnesses")
    outer = outer.select(F.col("at").alias("lang_at"), F.col("witness").alias("_more"), F.col("root").alias("_root"))
    full = placed.join(inner.select(F.col("tree").alias("lang_at"), "at", "witness", "root"), ["lang_at", "at"]).join(outer, "lang_at")
    return full.select(
        "doc_id", "lang", F.col("node").alias("leaf"), F.col("root").alias("subroot"), F.col("_root").alias("root"),
        F.concat("witness", "_more").alias("witness"), "changed", "at", "n", "lang_at", "langs",
    )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        proofs, roots = [], []
        for node, changed, witness, at, n, lang_at, langs in zip(
            get["leaf"], get["changed"], get["witness"], get["at"], get["n"], get["lang_at"], get["langs"], strict=True
        ):
            proofs.append(digest(witness).hex())
            below, used = fold(changed or node, at, n, witness)
            roots.append(fold(below, lang_at, langs, witness[used:])[0].hex())
        held = {c: [b.hex() for b in get[c]] for c in ("leaf", "subroot", "root")}
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                **{c: pa.array(v, pa.string()) for c, v in held.items()},
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(roots, pa.string()),
                "verified": pa.array([a == b for a, b in zip(roots, held["root"], strict=True)], pa.bool_()),
            }
        )


def verified(entries: DataFrame) -> DataFrame:
    """Folds each document's leaf, the changed one if there is any, with its witness, and compares the root.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, digests as lower-case hex.
    """
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return entries.mapInArrow(_verify, kinds)
