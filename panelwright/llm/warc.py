"""WARC archives: written by tasks as gzip members, read back by byte ranges.

Writer: a task writes its partition's records to one file in a folder that all machines reach, under another name
first, so a task that is run again replaces its own file. Of records with equal payloads one is a response and the
others are revisits of it, which hold headers alone.

Reader: a split is a range of bytes. Its task looks for the gzip magic, takes a place for a record only if it decodes
to a WARC header, reads that member to its end, checks its CRC, and asks that the file ends there or another member
follows; a record that fails these is an error, or passed over where that is asked for. It owns the records that start inside its range and reads on beyond the range to end the last one.

Folders are opened by pyarrow: file, hdfs, s3 and gs paths.

Edge cases: a null payload is empty; a null url has no target header; a null id is written without number and read
back as null, always as a response; rows equal in id and payload are responses all; without pages there are no files
and no records; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import large_limit, staged, with_groups

MAGIC = b"\x1f\x8b\x08"
BROADCAST_ROWS = 500_000
BLOCK = 1 << 20
RECORDS = "record_id string, target_uri string, record_type string, payload_digest string, refers_to string, content_length long, payload binary"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path) if ":" in path else path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record as a gzip member; refers_to: the id of the response that this one revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(id, url, payload, refers_to): refers_to is the largest id with the same payload, null for that id itself."""
    base = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    digested = base.select("id", F.sha1("payload").alias("digest"))
    shared = staged(digested.groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("n")).filter("n > 1"), "shared")
    of = base.withColumn("digest", F.sha1("payload"))
    if shared.count() <= BROADCAST_ROWS:
        joined = of.join(F.broadcast(shared.drop("n")), "digest", "left")
    else:  # payloads that very many records share are broadcast, whose number is bounded; others meet theirs in a join
        joined = with_groups(of, shared, ["digest"], "n", large_limit(base))
    return joined.select("id", "url", "payload", F.when(F.col("id") < F.col("largest"), F.col("largest")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes records as with_revisits() gives them; returns (path, size, records) of the files, which are then there."""

    def write(batches):
        from pyspark import TaskContext

        task, out, n, total = TaskContext.get(), None, 0, 0
        store, at = _open(folder)
        name = f"{at}/part-{task.partitionId():06d}.warc.gz"
        other = f"{at}/_part-{task.partitionId():06d}-{task.taskAttemptId()}"
        for b in batches:
            payloads = b.column("payload").cast(pa.large_binary())
            for i, u, p, r in zip(b.column("id").to_pylist(), b.column("url").to_pylist(), payloads, b.column("refers_to").to_pylist(), strict=True):
                if out is None:
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(other)
                payload = p.as_py()
                member = record(i, u, payload, base32_sha1(payload), r, date)
                out.write(member)
                n += 1
                total += len(member)
        if out is not None:
            out.close()
            store.move(other, name)
            yield pa.record_batch([pa.array([f"{folder}/part-{task.partitionId():06d}.warc.gz"]), pa.array([total], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "records"])

    return staged(records.mapInArrow(write, "path string, size long, records long"), "archives")


def _parse(data: bytes) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    told = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    fields = {name.strip().lower(): value.strip() for name, _, value in told}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    kind = fields["warc-type"]
    length = int(told[1]) if told else len(payload)
    by, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
    if kind == "response":
        length, own = len(payload), base32_sha1(payload)
        if by.lower() == "sha1" and len(digest) == len(own) and own != digest.upper():
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not have its digest")
        digest = own
    return fields.get("warc-record-id"), fields.get("warc-target-uri"), kind, digest, fields.get("warc-refers-to"), length, payload if kind == "response" else None


class _Bytes:
    """A file's bytes from a place on, read by blocks and let go behind."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, bytearray()
        file.seek(at)

    def upto(self, place: int) -> None:
        while self.at + len(self.data) < min(place, self.size):
            self.data += self.file.read(BLOCK)

    def get(self, start: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.data[start - self.at : end - self.at])

    def drop(self, place: int) -> None:
        del self.data[: place - self.at]
        self.at = place

    def padded(self, place: int) -> bool:
        """Whether there are only zeros from a place to the file's end, as tapes and some tools leave them."""
        while place < self.size:
            some = self.get(place, min(self.size, place + BLOCK))
            if some.strip(b"\0"):
                return False
            place += len(some)
        return True

    def find(self, start: int, end: int) -> int:
        """The next magic that starts in [start, end), or -1."""
        while start < end:
            self.upto(min(end + 2, start + BLOCK))
            i = self.data.find(MAGIC, start - self.at, end + 2 - self.at)
            if i >= 0:
                return self.at + i
            start = max(start, min(end, self.at + len(self.data) - 2))
            if self.at + len(self.data) >= min(self.size, end + 2):
                return -1
            self.drop(start)
        return -1


class Damaged(ValueError):
    """A member that begins as a WARC record and does not decode to its end."""


def _member(buf: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The decoded member that starts at a place and where it ends; None if no WARC record begins there."""
    begun = False
    z, out, place = zlib.decompressobj(31), [], at
    try:
        first = z.decompress(buf.get(at, at + 4096), 64)
        if not first.startswith(b"WARC/"):
            return None
        begun = True
        out.append(first)
        place, rest = min(at + 4096, buf.size), z.unconsumed_tail
        while not z.eof:
            if not rest:
                if place >= buf.size:
                    raise Damaged(f"the member at {at} is cut off")
                rest = buf.get(place, place + BLOCK)
                place += len(rest)
            out.append(z.decompress(rest))
            rest = z.unconsumed_tail
    except zlib.error as error:
        if begun:
            raise Damaged(f"the member at {at} does not decode: {error}") from error
        return None
    end = place - len(z.unused_data)
    if end < buf.size and buf.get(end, end + 3) != MAGIC and not buf.padded(end):
        raise Damaged(f"no member follows the one at {at}")
    return b"".join(out), end


def read_range(path: str, size: int, start: int, end: int, damaged: str = "raise"):
    """Parsed records of the members that start in [start, end); damaged ones raise, or are passed over by "skip"."""
    store, name = _open(path)
    with store.open_input_file(name) as file:
        buf = _Bytes(file, size, start)
        at = buf.find(start, min(end, size))
        while at >= 0:
            try:
                got = _member(buf, at)
            except Damaged as error:
                if damaged != "skip":
                    raise Damaged(f"{path}: {error}") from error
                got = None
            after = at + 1 if got is None else got[1]
            if got is not None:
                yield _parse(got[0])
                buf.drop(after)
            at = buf.find(after, min(end, size))


def read_warc(spark: SparkSession, files: DataFrame, split: int = 8 << 20, damaged: str = "raise") -> DataFrame:
    """Records of archives. files: (path, size). payload is null for revisits, content_length is the full payload's.

    A member that begins as a record but is damaged is an error, so that no record is lost unseen; "skip" leaves it out.
    """
    ranges = files.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    n = ranges.count()

    def read(batches):
        names = [c.split(" ")[0] for c in RECORDS.split(", ")]
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                rows, held = [], 0
                for r in read_range(path, size, start, start + split, damaged):
                    rows.append(r)
                    held += len(r[6] or b"") + 500
                    if held > 4 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return ranges.repartition(max(1, n)).mapInArrow(read, RECORDS)
