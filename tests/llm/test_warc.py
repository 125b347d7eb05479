import gzip
import hashlib
import os
import random

import pytest

from corpuscle.llm import warc

PAGES = "page_id long, url string, html string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], PAGES).repartition(3)


def plain(rows):
    """Result rows; of rows equal in id and payload one is the response."""
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for page_id, _, html in order:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        new = len(data) < 100 or data not in first
        out.append((page_id, len(data), digest, "response" if new else "revisit", None if new else first[data]))
        first.setdefault(data, page_id)
    return sorted(out, key=repr)


def result(files, split):
    got = warc.pages_of(warc.read_archives(files, split, payload=False))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_round_trip_over_small_ranges(spark):
    rng = random.Random(1)
    bodies = ["".join(rng.choice("ab é<>\r\n") for _ in range(rng.choice([0, 5, 99, 100, 400]))) for _ in range(30)]
    rows = [(i * 17 % 211 - 20, rng.choice([None, "http://a/é\r\nX: 1", "x"]), rng.choice(bodies)) for i in range(200)]
    rows += [(None, None, None), (None, "u", bodies[0] + "z" * 200), (9, "u", bodies[0] + "z" * 200), (9, "u", bodies[0] + "z" * 200)]
    rows += [(None, "n", "n" * 150)] * 2 + [(7, "long", "WARC/1.1\r\n" + "long text " * 200_000)]
    files = warc.write_archives(frame(spark, rows))
    assert result(files, 700) == plain(rows)
    assert result(warc.archives(spark, os.path.dirname(files.first().path)), 1 << 20) == plain(rows)
    held = warc.read_archives(files, 5000).where("type = 'response'")
    assert {bytes(r.payload).decode() for r in held.collect()} == {r[2] or "" for r in rows}
    with gzip.open(files.first().path.removeprefix("file:")) as file:  # any gzip reader can read the whole file
        assert file.read().count(b"WARC/1.1\r\nWARC-Type: ") >= files.first().records


def test_empty_table_and_clashing_names(spark):
    rows = [(1, "u", "x" * 100), (2, "u", "x" * 100), (3, "v", "y")]
    pages = frame(spark, rows)
    for name in ("uid", "digest", "length", "payload", "first", "kind", "refers_to", "a.b"):
        pages = pages.withColumn(name, pages["key"])
    assert result(warc.write_archives(pages), 50) == plain(rows)
    assert result(warc.write_archives(pages.where("false")), 50) == []


def stored(content):
    """A member without compression: what it holds stands in the file as it is."""
    import zlib

    zip = zlib.compressobj(0, zlib.DEFLATED, 31)
    return zip.compress(content) + zip.flush()


def test_archives_inside_records(spark, tmp_path):
    small = [warc.record("response", warc.URN.format(100 + k, k), b"inner" * k, 5 * k, hashlib.sha256(b"inner" * k).hexdigest()) for k in range(60)]
    inner = b"".join(small)
    block = b"HTTP/1.1 200 OK\r\n\r\n" + inner
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7:0>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    outer = stored(head + block + b"\r\n\r\n")
    false = [stored(b"\x1f\x8b\x08 no member"), warc.member(b"no record"), warc.member(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")]
    lead = b"HTTP/1.1 200 OK\r\n\r\n" + b"".join(false)
    bait = stored(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:8:0>\r\nContent-Length: {len(lead)}\r\n\r\n".encode() + lead + b"\r\n\r\n")
    content = small[3] + outer + bait + small[5] + outer
    path = tmp_path / "in.warc.gz"
    path.write_bytes(content)
    files = spark.createDataFrame([(f"file://{path}", len(content))], "path string, size long")
    for split in (200, 1000, 9000, 10**6):
        assert [r[0] for r in result(files, split)] == [103, 105, 7, 7, 8], split


@pytest.mark.parametrize("harm", ["cut", "flip"])
def test_damaged_archives_are_refused(spark, tmp_path, harm):
    rng = random.Random(3)
    made = [rng.randbytes(400) for _ in range(9)]
    content = b"".join(warc.record("response", warc.URN.format(k, k), m, 400, hashlib.sha256(m).hexdigest()) for k, m in enumerate(made))
    content = content[:-5] if harm == "cut" else content[:3000] + bytes([content[3000] ^ 255]) + content[3001:]
    path = tmp_path / "bad.warc.gz"
    path.write_bytes(content)
    with pytest.raises(ValueError, match="damaged"):
        warc.read_archives(spark.createDataFrame([(f"file://{path}", len(content))], "path string, size long"), 900)
