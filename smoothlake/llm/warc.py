"""WARC archives: written in tasks, read back in ranges with a verified chain of record boundaries.

Reading knows no index. Each range of a file is searched for the magic that begins a record, and every
candidate, true or not, gets the offset of the record that would follow it. Within a range the chains are
followed to where they leave it; across ranges, pointer jumping from the start of the file finds the offset
at which the true chain enters each range. Only records on the chain are read, so magic inside a payload
is never taken for a record. Archives are plain or with one gzip member per record.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest page id is a
response; the others are revisits that name it.

Edge cases: null or empty html is a response with an empty payload; a null url is written as an empty
target; rows with equal ids and payloads are all responses; null ids are kept, and are revisited only where
all ids of the payload are null; of rows with the largest id of a payload every one is a response; a payload of any
length is one record; empty tables give no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from dataclasses import dataclass
from math import ceil, log2

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import file_system, shared_dir, staged, tune

MAGIC, GZIP = b"WARC/1.0\r\n", b"\x1f\x8b\x08"
CHUNK = 1 << 20


@dataclass(frozen=True)
class WarcOptions:
    """compressed: a gzip member per record. least_bytes: of a payload that may be revisited. range_bytes:
    of a reading task. file_bytes: after which a writing task begins another archive."""

    compressed: bool = True
    least_bytes: int = 1000
    range_bytes: int = 8 << 20
    file_bytes: int = 1 << 30


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, compressed: bool) -> bytes:
    """One record, whole: header, HTTP header, payload (none in a revisit) and its end."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    block = http + (payload if refers_to is None else b"")
    whole = MAGIC + "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compressed:
        return whole
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(whole) + c.flush()


def write(pages: DataFrame, options: WarcOptions = WarcOptions(), folder: str | None = None) -> DataFrame:
    """path, size of the archives written."""
    spark = pages.sparkSession
    tune(spark)
    o = options
    folder = folder or shared_dir(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"))
    owners = (
        pages.select("page_id", F.sha1(html.cast("binary")).alias("same"), F.octet_length(html).alias("bytes"))
        .where(F.col("bytes") >= o.least_bytes)
        .groupBy("same")
        .agg(F.max("page_id").cast("long").alias("owner"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    joined = rows.join(owners, F.col("digest") == F.col("same"), "left")
    marked = joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"))

    def run(batches):
        fs, place = file_system(folder)
        part = TaskContext.get().partitionId()
        stream, size, name = None, 0, ""
        for b in batches:
            for page_id, url, text, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if stream is None:
                    fs.create_dir(place, recursive=True)
                    name, size = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc{'.gz' if o.compressed else ''}", 0
                    stream = fs.open_output_stream(file_system(name)[1], compression=None)
                r = record(page_id, url, (text or "").encode(), digest, refers_to, o.compressed)
                stream.write(r)
                size += len(r)
                if size >= o.file_bytes:
                    stream.close()
                    stream = None
                    yield pa.RecordBatch.from_pydict({"path": [name], "size": [size]})
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "size": [size]})

    return staged(marked.mapInArrow(run, "path string, size long"), "warc-files")


class Reader:
    """Records at offsets of one archive."""

    def __init__(self, f, size: int, compressed: bool):
        self.f, self.size, self.compressed = f, size, compressed
        self.magic = GZIP if compressed else MAGIC

    def at(self, offset: int) -> tuple[bytes, int] | None:
        """(record without outer compression, offset of its successor), or None if none begins there."""
        self.f.seek(offset)
        if self.compressed:
            d, out = zlib.decompressobj(31), []
            read = 0
            try:
                while not d.eof:
                    piece = self.f.read(1 << 14 if not read else CHUNK)
                    if not piece:
                        return None
                    read += len(piece)
                    out.append(d.decompress(piece))
                    if len(out) == 1 and not out[0].startswith(MAGIC[: len(out[0])]):
                        return None
            except zlib.error:
                return None
            whole = b"".join(out)
            length = _length(whole)
            return (whole, offset + read - len(d.unused_data)) if length is not None and length == len(whole) else None
        whole = self.f.read(1 << 14)
        while (end := whole.find(b"\r\n\r\n")) < 0 and len(whole) < CHUNK:
            more = self.f.read(1 << 14)
            if not more:
                return None
            whole += more
        length = _length(whole) if end >= 0 else None
        if length is None or offset + length > self.size:
            return None
        if len(whole) < length:
            whole += self.f.read(length - len(whole))
        whole = whole[:length]
        return (whole, offset + length) if whole.endswith(b"\r\n\r\n") else None

    def candidates(self, lo: int, hi: int) -> list[int]:
        """Offsets in [lo, hi) at which the magic stands."""
        found, at, keep = [], lo, b""
        self.f.seek(lo)
        stop = min(hi + len(self.magic) - 1, self.size)
        while at < stop:
            piece = keep + self.f.read(min(CHUNK, stop - at))
            base = at - len(keep)
            i = piece.find(self.magic)
            while i >= 0:
                found.append(base + i)
                i = piece.find(self.magic, i + 1)
            at = base + len(piece)
            keep = piece[-(len(self.magic) - 1) :]
        return [x for x in dict.fromkeys(found) if x < hi]


def _length(whole: bytes) -> int | None:
    """Length of the record that ``whole`` begins with, as its header says."""
    end = whole.find(b"\r\n\r\n")
    if end < 0 or not whole.startswith(MAGIC):
        return None
    for line in whole[len(MAGIC) : end].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return end + 4 + int(value) + 4 if value.strip().isdigit() else None
    return None


def parse(whole: bytes) -> dict:
    """Header fields and payload of a record."""
    end = whole.find(b"\r\n\r\n")
    head = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in whole[len(MAGIC) : end].split(b"\r\n"))}
    block = whole[end + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), len(payload))
    return head | {"payload": payload, "stated": stated}


def _ranges(files, o: WarcOptions) -> list[tuple[str, int, int, int]]:
    return [(path, size, lo, min(lo + o.range_bytes, size)) for path, size in files for lo in range(0, size, o.range_bytes)]


def chain(files: DataFrame, options: WarcOptions = WarcOptions()) -> DataFrame:
    """path, size, lo, hi, entry: for each range that the record chain enters, the first record's offset."""
    spark = files.sparkSession
    o = options
    listed = sorted((r.path, r.size) for r in files.collect())  # a row per archive
    ranges = _ranges(listed, o)
    table = spark.createDataFrame(ranges, "path string, size long, lo long, hi long")

    def run(batches):
        for b in batches:
            for path, size, lo, hi in zip(*(b.column(c).to_pylist() for c in ("path", "size", "lo", "hi")), strict=True):
                fs, place = file_system(path)
                with fs.open_input_file(place) as f:
                    reader = Reader(f, size, o.compressed)
                    following = {at: got[1] for at in reader.candidates(lo, hi) if (got := reader.at(at))}
                leaves: dict[int, int] = {}
                for at in sorted(following, reverse=True):
                    nxt = following[at]
                    leaves[at] = leaves.get(nxt, -1) if nxt < hi else nxt  # -1: the chain breaks here
                yield pa.RecordBatch.from_pydict({"path": [path] * len(leaves), "at": list(leaves), "leave": list(leaves.values())}, schema=out)

    out = pa.schema([("path", pa.string()), ("at", pa.int64()), ("leave", pa.int64())])
    jump = staged(table.repartition(max(1, len(ranges))).mapInArrow(run, "path string, at long, leave long"), "candidates")
    reached = table.where("lo = 0").select("path", F.lit(0).cast("long").alias("at"))
    hops = max((-(-size // o.range_bytes) for _, size in listed), default=1)
    for _ in range(ceil(log2(hops)) if hops > 1 else 0):
        reached = staged(reached.unionByName(reached.join(jump, ["path", "at"]).where("leave >= 0").select("path", F.col("leave").alias("at"))).distinct(), "reached")
        further = jump.select("path", F.col("at").alias("leave"), F.col("leave").alias("far"))
        jump = staged(jump.join(further, ["path", "leave"], "left").select("path", "at", F.coalesce("far", "leave").alias("leave")), "jumps")
    start = reached.withColumnRenamed("at", "entry").withColumn("lo", F.floor(F.col("entry") / o.range_bytes) * o.range_bytes)
    return table.join(start, ["path", "lo"]).select("path", "size", "lo", "hi", "entry")


def read(files: DataFrame, options: WarcOptions = WarcOptions()) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record on the chains; a chain
    that breaks, or a response whose payload belies its digest, fails the read."""
    spark = files.sparkSession
    o = options
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not files.limit(1).count():
        return spark.createDataFrame([], schema)

    def number(urn: str | None) -> int | None:
        value = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
        return int(value) if value else None

    def run(batches):
        for b in batches:
            for path, size, hi, at in zip(*(b.column(c).to_pylist() for c in ("path", "size", "hi", "entry")), strict=True):
                fs, place = file_system(path)
                rows = []
                with fs.open_input_file(place) as f:
                    reader = Reader(f, size, o.compressed)
                    while at < hi:
                        got = reader.at(at)
                        if got is None:
                            raise ValueError(f"{path}: no record at {at}")
                        r = parse(got[0])
                        digest = r["warc-payload-digest"].removeprefix("sha1:")
                        if r["warc-type"] == "response" and hashlib.sha1(r["payload"]).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload at {at} belies its digest")
                        rows.append((number(r["warc-record-id"]), r["stated"], digest, r["warc-type"], number(r.get("warc-refers-to"))))
                        at = got[1]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], names)

    entries = staged(chain(files, o), "entries")
    return entries.repartition(max(1, entries.count())).mapInArrow(run, schema)
