"""Token ids in seekable zstandard files.

A file has one independent frame per document, a frame with the document ids, and, in a skippable
frame at its end, the seek table of the seekable zstandard format with a checksum for each frame.
A reader fetches the table, and then only the frames it is asked for.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm import hashing as H
from corpuscle.llm.common import scratch, slot_bounds, slot_of, slots_for, texts_of
from corpuscle.session import scratch_path

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
END = 0
LEVEL = 3
BYTES_AT_ONCE = 6 << 20
CACHED = 1_500_000  # words of a worker whose ids are remembered, some 270 MB
AT_ONCE = 1 << 14
NO_ID = -(2**63)
BLANK = "\u0120"  # how byte-level BPE writes a blank
WHITE = r"\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MANIFEST = "slot int, path string, n_docs long, n_ids long"


class Encoder:
    """Encodes texts with a tokenizer's JSON, and remembers the ids of words.

    For byte-level BPE without normalisation a blank that no other white space touches begins a
    pre-token, so a text can be cut there and equal pieces encoded once. The pieces of a batch that are not
    known are encoded in long texts of many pieces, whose ids are parted where one begins with a blank; known
    ids lie in one array.
    """

    def __init__(self, tokenizer: str, remembered: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer)
        parts = json.loads(tokenizer)
        before = parts.get("pre_tokenizer") or {}
        self.cuts = (
            parts.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
        )
        special = [t["content"] for t in parts.get("added_tokens", [])]
        self.unsafe = f" [{WHITE}]|[{WHITE}] " + "".join("|" + "".join(f"\\x{{{ord(c):x}}}" for c in s) for s in special)
        self.blank = np.zeros(max(self.whole.get_vocab().values(), default=-1) + 1, bool)
        self.blank[[i for t, i in self.whole.get_vocab().items() if t[0] == BLANK]] = True
        self.chains = not any(" " in s for s in special)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.begin, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(texts), AT_ONCE):  # the library's results are much larger than the ids
            out += [e.ids for e in self.whole.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]
        return out

    def _chained(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words that each begin with their only blank and neither go on nor end with white space."""
        sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            got = np.array(self._encoded(["".join(some)])[0], np.uint32)
            head = np.flatnonzero(self.blank[got])
            if len(head) == len(some) and head[0] == 0:
                size = np.diff(np.append(head, len(got)))
            else:
                size, got = _flat(self._encoded(some))
            sizes.append(size)
            ids.append(got)
        return np.concatenate(sizes), np.concatenate(ids)

    def _slots(self, words: list[str]) -> np.ndarray:
        """Where the ids of each word are remembered; the words are different."""
        found = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new) and len(self.known) + len(new) > self.remembered:
            self._forget()
            found[:] = -1
            new = np.arange(len(words))
        if len(new):
            fresh = [words[k] for k in new.tolist()]
            chain = np.array([w[:1] == " " and not w[-1:].isspace() for w in fresh], bool) & self.chains
            new = np.concatenate([new[chain], new[~chain]])
            fresh = [*itertools.compress(fresh, chain), *itertools.compress(fresh, ~chain)]
            size, ids = map(np.concatenate, zip(self._chained(fresh[: chain.sum()]), _flat(self._encoded(fresh[chain.sum() :]))))
            at, total = len(self.known), len(ids)
            self.pool = _grown(self.pool, self.used + total)
            self.begin, self.size = _grown(self.begin, at + len(new)), _grown(self.size, at + len(new))
            self.pool[self.used : self.used + total] = ids
            self.size[at : at + len(new)] = size
            self.begin[at : at + len(new)] = self.used + np.cumsum(size) - size
            self.used += total
            found[new] = at + np.arange(len(new))
            self.known.update(zip(fresh, range(at, at + len(new))))
        return found

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids start (and the end)."""
        unsafe = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        safe = np.flatnonzero(~unsafe)
        words = pc.split_pattern(texts.take(pa.array(safe)), " ")
        flat = words.flatten()
        begin = words.offsets.to_numpy() - (words.offsets[0].as_py() if len(words) else 0)
        coded = flat.dictionary_encode()
        # A word after a blank is another piece than the same word at the start of a text
        index = coded.indices.to_numpy().astype(np.int64) * 2
        index[begin[:-1][begin[:-1] < begin[1:]]] += 1
        there = np.zeros(2 * len(coded.dictionary), bool)
        there[index] = True
        kinds = np.flatnonzero(there)
        lead = pc.if_else(pa.array(kinds & 1 == 1), "", " ")
        pieces = pc.binary_join_element_wise(lead, coded.dictionary.take(pa.array(kinds // 2)), "")
        slots = self._slots(pieces.to_numpy(zero_copy_only=False).tolist())
        slot = slots[(np.cumsum(there) - 1)[index]]
        count = self.size[slot]
        edge = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(self.begin[slot] - edge[:-1], count) + np.arange(edge[-1])
        fast, fast_edge = self.pool[place], edge[begin]
        if not unsafe.any():
            return fast, fast_edge
        slow = iter([np.array(ids, "<u4") for ids in self._encoded(texts.filter(pa.array(unsafe)).to_pylist())])
        quick = iter(np.split(fast, fast_edge[1:-1]) if len(safe) else [])
        out = [next(slow) if u else next(quick) for u in unsafe]
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(o) for o in out])])


@functools.lru_cache(maxsize=1)
def encoder_of(tokenizer: str) -> Encoder:
    """One encoder for all tasks of a worker process, so that words are encoded once in it."""
    return Encoder(tokenizer)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of lists, and their items one after the other."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return size, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` items at least."""
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])


class FrameWriter:
    """Writes frames to a stream, and at the end the ids and the seek table."""

    def __init__(self, out):
        import zstandard

        self.out, self.zip, self.table, self.ids, self.count = out, zstandard.ZstdCompressor(level=LEVEL), [], [], 0

    def _frame(self, content: bytes) -> None:
        import xxhash

        frame = self.zip.compress(content)
        self.out.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._frame(ids)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.count += len(ids) // 4

    def finish(self) -> None:
        self._frame(np.array(self.ids, "<i8").tobytes())
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Reads the table of a file at once, and frames one by one."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.zip = file, zstandard.ZstdDecompressor()
        file.seek(size - 9)
        frames, kind, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not kind & WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        file.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(file.read(12 * frames), "<u4").reshape(frames, 3)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        self.doc_ids = np.frombuffer(self.frame(frames - 1), "<i8")

    def frame(self, k: int) -> bytes:
        import xxhash

        self.file.seek(int(self.begin[k]))
        content = self.zip.decompress(self.file.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(content) != self.table[k, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.frame(k), "<u4")


def _writer(folder: str, tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        encoder, attempt = encoder_of(tokenizer.value), TaskContext.get().taskAttemptId()
        slot, stream, writer, done = None, None, None, []

        def close():
            writer.finish()
            stream.close()
            # A retried task writes the same bytes under the same name
            place.move(f"{root}/_{attempt}-{slot}", f"{root}/part-{slot:06d}.zst")
            done.append({"slot": slot, "path": f"{folder}/part-{slot:06d}.zst", "n_docs": len(writer.ids), "n_ids": writer.count})

        for batch in batches:
            for part in H.parts(batch, BYTES_AT_ONCE):
                ids, edge = encoder.batch(part.column("text"))
                for k, (s, doc_id) in enumerate(zip(part.column("slot").to_pylist(), part.column("doc_id").to_pylist(), strict=True)):
                    if s != slot:
                        if writer:
                            close()
                        slot, stream = s, place.open_output_stream(f"{root}/_{attempt}-{s}")
                        writer = FrameWriter(stream)
                    writer.add(doc_id, ids[edge[k] : edge[k + 1]].astype("<u4").tobytes() + struct.pack("<I", END))
        if writer:
            close()
        kinds = pa.schema([("slot", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        yield pa.RecordBatch.from_pylist(done, kinds)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes token files and returns their manifest ``slot, path, n_docs, n_ids``; slots ascend with ids.

    Each document is encoded whole, without special tokens, and ends with id 0. A null text is empty. Documents
    without id come first, documents with equal ids side by side. An empty table makes no file.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    docs = texts_of(docs)
    slots = slots_for(spark)
    with open(tokenizer, encoding="utf-8") as file:  # where the driver runs; tasks get its text
        shared = spark.sparkContext.broadcast(file.read())
    slotted = docs.withColumn("slot", slot_of(F.col("doc_id"), slot_bounds(docs, "doc_id", slots)).cast("int"))
    dealt = slotted.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", F.col("doc_id").asc_nulls_first(), "row")
    return scratch(dealt.select("slot", "doc_id", "text").mapInArrow(_writer(folder, shared), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder_of.cache_clear()  # all files are written: a worker that lives on need not hold their words
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            place, inside = fs.FileSystem.from_uri(path)
            with place.open_input_file(inside) as file:
                reader = FrameReader(file, file.size())
                size, crc = [], []
                for k in range(len(reader.doc_ids)):
                    ids = reader.frame(k)
                    size.append(len(ids) // 4)
                    crc.append(zlib.crc32(ids))
            size = np.array(size, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(reader.doc_ids, pa.int64(), mask=reader.doc_ids == NO_ID),
                    pa.array(start + np.cumsum(size) - size),
                    pa.array(size),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents in the files, each checked against its checksum."""
    spark = manifest.sparkSession
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    files = manifest.select("slot", "path", before.alias("start"))
    dealt = files.repartitionById(slots_for(spark), F.col("slot"))
    return dealt.select("path", "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(path: str, wanted: set[int]) -> dict[int, np.ndarray]:
    """Token ids of some documents of one file; no other frames are read."""
    place, inside = fs.FileSystem.from_uri(path)
    with place.open_input_file(inside) as file:
        reader = FrameReader(file, file.size())
        return {int(d): reader.ids(k) for k, d in enumerate(reader.doc_ids) if int(d) in wanted}
