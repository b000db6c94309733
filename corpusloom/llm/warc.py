"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about `FRAME` bytes, frames into bundle files of about `BUNDLE`
bytes, and a bundle ends with a seek table (a skippable frame that lists every frame's sizes). An index maps
each record to its bundle, frame and offset within the decompressed frame, so one record costs one frame.

Of the records with equal payloads, that with the smallest id is the response; the others are revisits that
name it and carry no payload. A record whose payload is smaller than `min_bytes` is always a response. That is decided
on ids and digests alone. The digests that repeat are broadcast to the payloads up to `BROADCAST` of them; beyond that
the revisits are joined by id and digest, which spreads evenly whatever payload is popular.

The index is written by Spark, so it lists the files of successful attempts only (see `files`).

Defined cases: a null payload is empty; a null url leaves out the target; equal rows that are the smallest of
their payload are all responses; records with a null id are responses unless a set id has the same payload; an
empty table has no bundles; equal rows have records with ids of their own; other columns of any name are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, scratch, written
from .files import Appender, Reader

FRAME, BUNDLE, LEVEL, BROADCAST, READ_BYTES = 256 << 10, 64 << 20, 6, 200_000, 16 << 20
#: Fixed values of the seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, nth: int = 0) -> tuple[str, bytes]:
    """(record id, bytes) of a response, or of a revisit if refers_to is set. nth tells equal rows apart."""
    digest = base32_sha1(payload)
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest} {nth}')}>"
    body = payload if refers_to is None else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name,
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "X-Page-Id": "" if page_id is None else page_id,
        "X-Refers-To-Page-Id": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + len(body),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return name, f"WARC/1.1\r\n{lines}\r\n".encode() + http + body + b"\r\n\r\n"


def parsed(data: bytes, at: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The headers, the HTTP headers and the body of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}: {first[:20]!r}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n")
    return head, dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:]), block[cut + 4 :]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame of an open bundle."""
    size = file.size()
    n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE or flags:
        raise ValueError("the bundle has no seek table")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", file.read_at(8 * n, size - 9 - 8 * n)):
        out.append((at, c, d))
        at += c
    return out


def decided(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0, most: int = BROADCAST) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses)."""
    body = F.coalesce(named(payload).cast("string"), F.lit(""))
    rows = pages.select(named(key).cast("long").alias("page_id"), named("url").cast("string").alias("url"), body.alias("payload"))
    large, sha = F.octet_length("payload") >= min_bytes, F.unhex(F.sha1("payload"))
    ids = written(rows.filter(large).select("page_id", sha.alias("digest")), "warc-ids")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    first = written(first, "warc-repeated")
    given = rows.withColumn("digest", F.when(large, sha))
    if first.count() <= most:
        found = given.join(F.broadcast(first), "digest", "left")  # 28 bytes a row
    else:
        again = ids.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
        again = again.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "first")
        found = given.join(again, given["page_id"].eqNullSafe(again["id"]) & (given["digest"] == again["d"]), "left")
    return found.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"


def bundled(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the bundles. The index, as a written table. folder: where bundles are to stay; else they go with the
    application."""
    folder = folder or scratch(records.sparkSession, "warc")

    def write(batches):
        import pyarrow as pa
        import zstandard

        out = Appender(folder, ".warc.zst", BUNDLE)
        press = zstandard.ZstdCompressor(level=LEVEL)
        frames: list[tuple[int, int]] = []
        rows: list[tuple] = []
        parts: list[bytes] = []
        size = 0

        def flush():
            nonlocal rows, parts, size
            if not parts:
                return None
            data = press.compress(b"".join(parts))
            name, _ = out.add(data)
            frames.append((len(data), size))
            made = [(r, p, name, len(frames) - 1, o, n) for r, p, o, n in rows]
            rows, parts, size = [], [], 0
            if out.full:
                finish()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["record_id", "page_id", "bundle", "frame", "offset", "length"])

        def finish():
            if frames:
                out.add(seek_table(frames))
                out.close()
                frames.clear()

        for batch in batches:
            for row in batch.to_pylist():
                name, data = record(row["page_id"], row["url"], row["payload"].encode(), row["refers_to"], row["nth"])
                rows.append((name, row["page_id"], size, len(data)))
                parts.append(data)
                size += len(data)
                if size >= FRAME:
                    yield flush()
        if (last := flush()) is not None:
            yield last
        finish()

    return written(records.withColumn("nth", F.monotonically_increasing_id()).mapInArrow(write, INDEX), "warc-index")


READ = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_back(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that an index (or any rows of one) names, each found by its frame and offset. A response's payload
    must have the digest that its record states."""

    def read(batches):
        import pyarrow as pa
        import zstandard

        files, opened, frame_at, table, data = Reader(), "", -1, [], b""
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                file = files.open(x["bundle"])
                if x["bundle"] != opened:
                    opened, frame_at, table = x["bundle"], -1, read_seek_table(file)
                if x["frame"] != frame_at:
                    at, packed, plain = table[x["frame"]]
                    frame_at, data = x["frame"], unpress.decompress(file.read_at(packed, at), max_output_size=plain)
                head, http, body = parsed(data, x["offset"])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = head["WARC-Type"]
                if kind == "response" and base32_sha1(body) != digest or head["WARC-Record-ID"] != x["record_id"]:
                    raise ValueError(f"{x['bundle']}: record {x['record_id']} is damaged")
                number = lambda k: int(head[k]) if head.get(k) else None
                rows.append((x["record_id"], number("X-Page-Id"), head.get("WARC-Target-URI"), kind, number("X-Refers-To-Page-Id"), digest, int(http["Content-Length"]), body if with_payload else None))
            if rows:
                types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                names = ["record_id", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        files.close()

    n_parts = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    ordered = index.repartitionByRange(n_parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return ordered.mapInArrow(read, READ)
