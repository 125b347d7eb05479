"""Corpus files as a DataFrame ``(repo_id, path, content)``."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import path as P
from corpuscle.session import written


def decode_text(raw: Column) -> Column:
    """Bytes as UTF-8; bad sequences become replacement characters, never an error."""
    return F.make_valid_utf8(raw.cast("string"))


#: Entries a task lists before it hands on the folders it has not opened; what one task reads at most, unless a single file is larger; bytes a batch
_ENTRIES, _TASK_FILES, _TASK_BYTES, _BATCH_BYTES = 10_000, 20_000, 64 << 20, 8 << 20


def _reached(spark: SparkSession, root: str) -> str | None:
    """The root's URI if it is a folder that tasks can open themselves; none for patterns, single files and stores that only Spark reads."""
    if any(c in root for c in "{}[]*?\\"):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toUri().toString()
    try:
        place, base = fs.FileSystem.from_uri(uri)
        return uri if place.get_file_info(base).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError, ImportError):
        return None


def _hidden(name: str) -> bool:
    """What Spark's listing passes over, files and folders."""
    odd = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    return odd and not name.startswith(("_common_metadata", "_metadata"))


def _entries(place: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder with their lengths, which are none for folders."""
    if not isinstance(place, fs.LocalFileSystem):
        for found in place.get_file_info(fs.FileSelector(folder)):
            if found.type in (fs.FileType.Directory, fs.FileType.File):
                yield found.base_name, found.size if found.is_file else None
        return
    with os.scandir(folder) as entries:  # one at a time, however many there are
        for found in entries:
            try:
                found.name.encode()
                length = None if found.is_dir() else found.stat().st_size
            except (OSError, UnicodeEncodeError):  # a broken link, gone meanwhile, or no text
                continue
            yield found.name, length


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """Path below the root and length of every file that is not empty, listed by tasks and kept in scratch.

    A task walks on from its folder until it has met ``_ENTRIES`` names; folders it has not opened by then are dealt
    out in another round. The driver sees numbers only.
    """

    def found(place: fs.FileSystem, base: str, top: str) -> Iterator[tuple[str, int | None]]:
        todo, met = [top], 0
        while todo:
            folder = todo.pop()
            if met >= _ENTRIES:
                yield folder, None
                continue
            for name, length in _entries(place, f"{base}/{folder}" if folder else base or "/"):
                met += 1
                if _hidden(name):
                    continue
                path = f"{folder}/{name}" if folder else name
                if length is None and met < _ENTRIES:
                    todo.append(path)
                elif length is None or length and (not name.startswith("_") or "=" in name):
                    yield path, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(root)
        rows = (row for batch in batches for top in batch.column(0).to_pylist() for row in found(place, base.rstrip("/"), top))
        while some := list(islice(rows, 10_000)):
            paths, lengths = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])

    rounds, folders = [], spark.range(0, 1, 1, 1).select(F.lit("").alias("path"))
    while True:
        rounds.append(written(folders.mapInArrow(run, "path string, length long"), "listing"))
        folders = rounds[-1].where("length IS NULL").select("path")
        if not (more := folders.count()):
            return reduce(DataFrame.unionAll, rounds).where("length IS NOT NULL")
        folders = folders.repartition(min(more, 4 * spark.sparkContext.defaultParallelism))


def _sound(path: str, data: bytes) -> bool:
    """Whether a local file agrees with the checksums that Hadoop may have left beside it."""
    try:
        with open(f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc", "rb") as kept:
            sums = kept.read()
    except OSError:
        return True
    step = int.from_bytes(sums[4:8])
    if sums[:4] != b"crc\0" or not 0 < step < 1 << 31:
        return True
    own = b"".join(zlib.crc32(data[at : at + step]).to_bytes(4) for at in range(0, len(data), step))
    return own == sums[8 : 8 + len(own)]


def _contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """The files of a listing with their bytes, read by tasks of about equally many files."""
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    gone = spark.conf.get("spark.sql.files.ignoreMissingFiles") == "true"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(root)
        base, local = base.rstrip("/"), isinstance(place, fs.LocalFileSystem)

        def read(path: str) -> bytes | None:
            try:
                with open(path, "rb") if local else place.open_input_stream(path, compression=None) as file:
                    data = file.read()
            except (FileNotFoundError, PermissionError) as error:
                if gone and isinstance(error, FileNotFoundError):
                    return None
                raise
            except OSError:
                return None
            return data if not local or _sound(path, data) else None

        def made(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

        paths, contents, held = [], [], 0
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if length > most:
                    raise ValueError(f"{path} has {length} bytes, more than spark.sql.sources.binaryFile.maxLength, {most}")
                if (data := read(f"{base}/{path}")) is None:
                    continue
                if paths and held + len(data) > _BATCH_BYTES:
                    yield made(paths, contents)
                    paths, contents, held = [], [], 0
                paths.append(path)
                contents.append(data)
                held += len(data)
        yield made(paths, contents)

    n, size = files.agg(F.count("*"), F.sum("length")).first()
    tasks = max(spark.sparkContext.defaultParallelism, n // _TASK_FILES, (size or 0) // _TASK_BYTES)
    return files.select("path", "length").repartition(max(1, min(n, tasks))).mapInArrow(run, "path string, content binary")


def scan_files(spark: SparkSession, root: str, repo_id: str, glob: str | None = None) -> DataFrame:
    """Every file under ``root`` that is not empty or hidden, one row each, with the path relative to the root.

    Files that can't be read to the end, or do not fit their checksums, are skipped; missing and forbidden ones are an error.
    Tasks list and read the files, so that the driver holds none of their names; binary ones are dropped by name and not
    opened. Only a root that is a pattern or a single file, or lies in a store that pyarrow does not know, is left to Spark's
    reader, which lists on the driver and has the bytes of binary files before they are dropped.
    """
    if uri := _reached(spark, root):
        files = _listing(spark, uri).where(~P.is_binary_path(F.col("path")))
        if glob:
            pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
            files = files.where(F.substring_index("path", "/", -1).rlike(rf"(?s)\A(?:{pattern})\z"))
        return _contents(spark, uri, files).select(F.lit(repo_id).alias("repo_id"), "path", decode_text(F.col("content")).alias("content"))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/").removeprefix("file:")
    relative = F.regexp_replace("path", rf"^(?:\w+:/*(?=/))?\Q{base}\E/", "")
    files = reader.load(root).withColumn("_relative", relative)
    return files.where(~P.is_binary_path(F.col("_relative"))).select(
        F.lit(repo_id).alias("repo_id"), F.col("_relative").alias("path"), decode_text(F.col("content")).alias("content")
    )


def list_files(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """Paths and sizes only; the files themselves are not opened."""
    base = root.rstrip("/").removeprefix("file:")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", rf"^(?:\w+:/*(?=/))?\Q{base}\E/", "")
    return files.select(F.lit(repo_id).alias("repo_id"), relative.alias("path"), "length", F.col("modificationTime").alias("modified"))


_NO_FOLDER = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *b"\"#%'*/:=?\\{[]^"]}


def write_files(rows: DataFrame, root: str, folder: str, content: str, ending: str = ".txt") -> int:
    """Writes the string ``content`` of each row and a line break as a file of its own under ``root/folder=value``; returns their number.

    Folders are named as Spark names partitions, a null content is empty. Spark's own writers spend some ten milliseconds
    a file on its mode, checksum and commit, where a file of this writer is opened, written and renamed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(root)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        folders: dict[str | None, str] = {}
        n = 0
        for batch in batches:
            for value, data in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                value = value.as_py()
                if value not in folders:
                    name = value.translate(_ESCAPED) if value else _NO_FOLDER
                    folders[value] = f"{base}/{folder}={name}"
                    place.create_dir(folders[value], recursive=True)
                # Hidden until it is whole; a retried task writes the same files under the same names
                with place.open_output_stream(f"{base}/_{attempt}-{task}") as out:
                    out.write((data.as_py() or b"") + b"\n")
                place.move(f"{base}/_{attempt}-{task}", f"{folders[value]}/part-{task:05d}-{n:07d}{ending}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    made = rows.select(F.col(folder).cast("string"), F.col(content)).mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    if not made:  # an empty table leaves an empty folder
        place, base = fs.FileSystem.from_uri(root)
        place.create_dir(base, recursive=True)
    return made or 0
