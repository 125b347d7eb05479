"""WARC archives: a writer with revisit records, and a reader that splits files anywhere.

Each record is a gzip member of its own. A reading task gets a byte range, looks in it for the gzip magic,
takes a place for a member only if it decodes, checksum included, to a record header, and then goes on from
member to member; it owns the records that start inside its range, the last of which may end behind it. A record
may itself hold an archive, stored without compression, so that members of the inner archive pass that test: the
members of a file must follow one another without a gap, and ranges that don't meet are read again from where the
range before has ended.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm import hashing as H
from corpuscle.llm.common import scratch
from corpuscle.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
LEAST = 100
SPLIT = 4 << 20
BLOCK = 1 << 18
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
SPLITS = "path string, size long, start long, stop long, first long"
RECORDS = """path string, start long, offset long, until long, type string, record_id string, refers_to string, url string,
    digest string, length long, payload binary"""
URN = "<urn:page:{}:{}>"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\U0010ffff]")


def _header(first: str, fields: list[tuple[str, str | None]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields if v is not None)]).encode() + END


def _quoted(url: str | None) -> str | None:
    """Blanks, control characters and what is not ASCII as percent escapes: a header line must not break."""
    return None if url is None else _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(kind: str, record_id: str, payload: bytes, length: int, digest: str, url=None, refers_to=None, date: str = DATE) -> bytes:
    """A gzip member with a response record, or a revisit, whose block ends after the HTTP header."""
    http = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(length))])
    block = http + (payload if kind == "response" else b"")
    same = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", _quoted(url)), ("WARC-Profile", same),
        ("WARC-Refers-To", refers_to), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return member(_header("WARC/1.1", head) + block + END)


def member(content: bytes) -> bytes:
    zip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return zip.compress(content) + zip.flush()


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out, count, size = None, 0, 0
        for batch in batches:
            for row in (r for part in H.parts(batch, SPLIT, "payload") for r in part.to_pylist()):
                if out is None:
                    place.create_dir(root, recursive=True)
                    out = place.open_output_stream(f"{root}/_{attempt}-{task}")
                data = row["payload"].encode()
                made = record(row["kind"], row["record_id"], data, row["length"], row["digest"], row["url"], row["refers_to"], date)
                out.write(made)
                count, size = count + 1, size + len(made)
        if out:
            out.close()
            # A retried task writes the same records under the same name
            place.move(f"{root}/_{attempt}-{task}", f"{root}/part-{task:06d}.warc.gz")
            kinds = pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())])
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/part-{task:06d}.warc.gz", "size": size, "records": count}], kinds)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, date: str = DATE) -> DataFrame:
    """Writes ``page_id, url, html`` as WARC files and returns their manifest ``path, size, records``.

    The payload is the html in UTF-8, a null is empty. Of pages with equal payloads of ``least`` bytes or more the one with
    the smallest id is a response and the others revisit it; ids may repeat, a null id counts as the greatest, and of rows
    equal in id and payload one is the response. Smaller payloads are all responses. An empty table makes no file. Other
    columns are not touched. A payload's digest is computed where it is read. Only the first of payloads that occur more than
    once are joined to the pages, so payloads are shuffled only where these are too many to broadcast.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = scratch(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("length", F.octet_length("payload").cast("long"))
        .withColumn("digest", F.sha2("payload", 256)),
        "pages",
    )
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")
    firsts = scratch(
        named.where(F.col("length") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"),
        "firsts",
    )

    def urn(page_id, uid):
        return F.format_string(URN.replace("{}", "%s"), F.coalesce(page_id.cast("string"), F.lit("-")), uid.cast("string"))

    revisit = F.coalesce((F.col("first.uid") != F.col("uid")) & (F.col("length") >= least), F.lit(False))
    rows = named.join(firsts, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        urn(F.col("page_id"), F.col("uid")).alias("record_id"),
        F.when(revisit, urn(F.col("first.page_id"), F.col("first.uid"))).alias("refers_to"),
        F.when(revisit, "").otherwise(F.col("payload")).alias("payload"),
        "url", "length", "digest",
    )
    return scratch(rows.mapInArrow(_writer(folder, date), "path string, size long, records long"), "warc-manifest")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size`` of the ``.warc.gz`` files below a folder."""
    place, root = fs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
    found = [f for f in place.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".warc.gz")]
    return spark.createDataFrame([(prefix + f.path, f.size) for f in found], "path string, size long")


class RangeReader:
    """Bytes of a file from a place on, fetched in blocks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def block(self, at: int) -> bytes:
        """Some bytes from ``at`` on; none at the end of the file."""
        if not self.at <= at < self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(min(BLOCK, self.size - at))
        return self.data[at - self.at :]

    def find(self, at: int, stop: int) -> int | None:
        """The next magic that starts before ``stop``."""
        while at < stop:
            data = self.block(at)
            if not data:
                return None
            hit = data.find(MAGIC)
            if hit >= 0:
                return at + hit if at + hit < stop else None
            if len(data) < len(MAGIC):  # may go on in the next block
                self.data = b""
                if len(data := self.block(at)) < len(MAGIC):
                    return None
            else:
                at += len(data) - len(MAGIC) + 1
        return None

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The content of the member at a place and where it ends; None if there is no whole one or it is no record."""
        zip, out, checked = zlib.decompressobj(31), bytearray(), False
        try:
            while not zip.eof:
                data = self.block(at)
                if not data:
                    return None
                out += zip.decompress(data)
                at += len(data) - len(zip.unused_data)
                if not checked and len(out) >= 5:
                    checked = True
                    if out[:5] != b"WARC/":
                        return None
        except zlib.error:
            return None
        return (bytes(out), at) if checked else None


def parsed(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Lower-cased header fields and the block of a record; None if they don't fit."""
    head, gap, rest = content.partition(END)
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]))
    size = fields.get("content-length", "")
    if not gap or not size.isdigit() or rest[int(size) :] != END:
        return None
    return fields, rest[: int(size)]


def _entries(reader: RangeReader, start: int, stop: int, first: int | None) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """The records that start in a range; ``first`` is where the first one does, if that is known."""
    at = reader.find(start, stop) if first is None else first
    while at is not None and at < stop:
        found = reader.member(at)
        inside = parsed(found[0]) if found else None
        if inside is None:
            at = reader.find(at + 1, stop)
            continue
        yield at, found[1], *inside
        at = found[1]


def _read(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(
            [("path", pa.string()), ("start", pa.int64()), ("offset", pa.int64()), ("until", pa.int64()), *((c, pa.string()) for c in ("type", "record_id", "refers_to", "url", "digest")), ("length", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for split in batch.to_pylist():
                place, inside = fs.FileSystem.from_uri(split["path"])
                rows, held = [], 0
                with place.open_input_file(inside) as file:
                    for at, until, head, block in _entries(RangeReader(file, split["size"]), split["start"], split["stop"], split["first"]):
                        rows.append(_row(split, at, until, head, block, keep))
                        held += len(block)
                        if held > SPLIT:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def _row(split: dict, at: int, until: int, head: dict[str, str], block: bytes, keep: bool) -> dict:
    http, _, payload = block.partition(END)
    told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        true = hashlib.sha256(payload).hexdigest()
        if digest and digest != true:
            raise ValueError(f"{split['path']}: the payload of the record at {at} does not have its digest")
        digest = true
    length = int(told[1]) if kind == "revisit" and told else len(payload)
    return {
        "path": split["path"], "start": split["start"], "offset": at, "until": until, "type": kind, "record_id": head.get("warc-record-id"),
        "refers_to": head.get("warc-refers-to"), "url": head.get("warc-target-uri"), "digest": digest or None, "length": length,
        "payload": payload if keep else None,
    }


def ranges(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """``path, size, start, stop, first`` of byte ranges, spread over tasks; ``first`` is not known yet."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long")))
    cut = files.where("size > 0").select("path", "size", starts.alias("start"))
    ends = cut.select("path", "size", "start", F.least(F.col("start") + split, F.col("size")).alias("stop"), F.lit(None).cast("long").alias("first"))
    return ends.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")


def read_ranges(splits: DataFrame, payload: bool = True) -> DataFrame:
    return splits.mapInArrow(_read(payload), RECORDS)


def unmet(splits: DataFrame, records: DataFrame) -> DataFrame:
    """The ranges whose records don't start where those of the ranges before have ended, with that place as ``first``.

    ``due`` tells whether a record starts there before ``stop``. No member that was taken for a record ends behind
    the record that holds it, so a range is never wrongly told that nothing starts in it.
    """
    seen = records.groupBy("path", "start").agg(F.min("offset").alias("from"), F.max("until").alias("to"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    chained = splits.drop("first").join(seen, ["path", "start"], "left").withColumn("first", F.coalesce(F.max("to").over(before), F.lit(0)))
    due = F.col("first") < F.col("stop")
    met = F.when(due, F.coalesce(F.col("from") == F.col("first"), F.lit(False))).otherwise(F.col("from").isNull())
    whole = (F.col("stop") < F.col("size")) | (F.greatest("first", "to") == F.col("size"))
    return chained.where(~(met & whole)).select("path", "size", "start", "stop", "first", due.alias("due"))


def read_archives(files: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """Records of the archives in ``files`` (``path, size``), wherever ranges cut them: see RECORDS for the columns.

    ``digest`` is the payload's SHA-256, checked for responses, told by the header of a revisit, as is its ``length``. Of a
    file whose ranges don't meet, as members of an inner archive were taken for records, the first range that is due and
    those in which no record starts are read again until all meet. A file that is damaged, or does not end with a record,
    raises an error.
    """
    splits = scratch(ranges(files, split), "ranges")
    records = scratch(read_ranges(splits, payload), "records")
    tried = None
    while True:
        wrong = scratch(unmet(splits, records), "unmet")
        first = wrong.where("due").groupBy("path").agg(F.min("start").alias("_first"))
        again = wrong.join(first, "path", "left").where("not due or start = _first").select(splits.columns)
        state = again.agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("at"), F.sum("first").alias("first")).first()
        if not state["n"]:
            return records
        if state == tried:
            bad = again.first()
            raise ValueError(f"damaged archive {bad['path']}: no whole record at {bad['first']}")
        tried = state
        rest = records.join(again.select("path", "start"), ["path", "start"], "left_anti").select(records.columns)
        records = scratch(rest.unionByName(read_ranges(again, payload)), "records")


def page_of(urn: Column) -> Column:
    """The page id in a record id."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d*):", 1).try_cast("long")


def pages_of(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of response and revisit records."""
    return records.where(F.col("type").isin("response", "revisit")).select(
        page_of(F.col("record_id")).alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"),
    )
