"""Token-id files: whole corpora of ids in ascending document order, range coded in checksummed blocks.

A file holds sections of at most ``SECTION`` ids; a section is a header, its ids' frequencies, a table of its blocks
(bytes and CRC-32 of the ids) and the blocks, each decodable on its own. The documents' ids and lengths follow, and a
footer says where; all of it is checksummed, and reading a damaged file raises ValueError. Files are written under a name of their task's attempt; only the names that the finished
tasks returned are read, so a lost or repeated task leaves nothing wrong behind.

Edge cases: a null or empty text is its end id alone; repeated document ids stand one after another, in an
order that their texts decide, and may be dealt over several files; null ids come first; very long texts are encoded whole; an empty table gives no file and an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import range_coder
from ._common import file_system, scan_partitions, shared_dir, staged, tune
from .tokens import default_tokenizer, encoder

MAGIC, SECTION_MAGIC = b"SLTOKEN2", b"SECT"
SECTION = range_coder.LARGEST * range_coder.LANES
FOOTER = struct.Struct("<QQI8s")  # place of the document table, documents, checksum of the table, magic


@dataclass(frozen=True)
class TokenFileOptions:
    tokenizer: str | None = None
    end_id: int = 2


class Writer:
    """Writes one file to an open binary stream."""

    def __init__(self, stream):
        self.stream = stream
        self.held: list[bytes] = []
        self.size = 0
        self.documents: list[tuple[int | None, int]] = []
        self.place = 0
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.stream.write(b)
        self.place += len(b)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append((doc_id, len(ids) // 4))
        for lo in range(0, len(ids), 4 * SECTION):
            self.held.append(ids[lo : lo + 4 * SECTION])
            self.size += len(self.held[-1]) // 4
            while self.size >= SECTION:
                self._section(SECTION)

    def _section(self, n: int) -> None:
        ids = b"".join(self.held)
        ids, rest = ids[: 4 * n], ids[4 * n :]
        self.held, self.size = [rest] if rest else [], len(rest) // 4
        self._put(SECTION_MAGIC)
        self._put(range_coder.encode_section(np.frombuffer(ids, "<u4")))

    def close(self) -> None:
        if self.size:
            self._section(self.size)
        at = self.place
        known = np.array([d is not None for d, _ in self.documents], np.uint8)
        table = known.tobytes() + np.array([d or 0 for d, _ in self.documents], "<i8").tobytes() + np.array([n for _, n in self.documents], "<u8").tobytes()
        self._put(table)
        self._put(FOOTER.pack(at, len(self.documents), zlib.crc32(table), MAGIC))


def read_sections(f):
    """The ids (little-endian unsigned 32-bit bytes) of each section of an open file, every block verified."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while f.read(4) == SECTION_MAGIC:
        yield range_coder.decode_section(f.read)


def read_documents(f, size: int):
    """(doc_id, ids as bytes) of every document of an open, seekable file of ``size`` bytes."""
    f.seek(max(0, size - FOOTER.size))
    foot = f.read(FOOTER.size)
    if len(foot) < FOOTER.size:
        raise ValueError("not a token file")
    at, n, check, magic = FOOTER.unpack(foot)
    if magic != MAGIC or at + 17 * n + FOOTER.size != size:
        raise ValueError("not a token file")
    f.seek(at)
    table = f.read(17 * n)
    if zlib.crc32(table) != check:
        raise ValueError("the table of documents fails its checksum")
    known, ids, lengths = np.frombuffer(table, np.uint8, n), np.frombuffer(table, "<i8", n, n), np.frombuffer(table, "<u8", n, 9 * n)
    f.seek(0)
    sections, held, place = read_sections(f), b"", 0
    for k in range(n):
        want = 4 * int(lengths[k])
        if len(held) - place < want:
            more = [held[place:]]
            have = len(more[0])
            while have < want:
                more.append(next(sections, b""))
                if not more[-1]:
                    raise ValueError("sections are missing")
                have += len(more[-1])
            held, place = b"".join(more), 0
        yield (int(ids[k]) if known[k] else None), held[place : place + want]
        place += want


def write(documents: DataFrame, options: TokenFileOptions = TokenFileOptions(), folder: str | None = None) -> DataFrame:
    """part, path, documents, tokens: the files written, in ascending order of their documents' ids."""
    spark = documents.sparkSession
    tune(spark)
    folder = folder or shared_dir(spark, "tokens")
    path, end = options.tokenizer or default_tokenizer(), np.array([options.end_id], "<u4").tobytes()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # texts split the rows of an id that holds many
    rows = rows.withColumn("by", F.xxhash64("text"))
    ordered = rows.repartitionByRange(scan_partitions(rows), F.col("doc_id").asc_nulls_first(), "by").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "by", "text").drop("by")
    out = pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        part = TaskContext.get().partitionId()
        fs, place = file_system(folder)
        encode = encoder(path)
        writer = stream = None
        tokens = 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        for b in batches:
            if b.num_rows and writer is None:
                fs.create_dir(place, recursive=True)
                stream = fs.open_output_stream(f"{place}/{name}")
                writer = Writer(stream)
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                writer.add(doc, ids)
                tokens += len(ids) // 4
        if writer:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "documents": [len(writer.documents)], "tokens": [tokens]}, schema=out)

    return staged(ordered.mapInArrow(run, "part int, path string, documents long, tokens long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files that ``write`` returned."""
    spark = files.sparkSession
    listed = sorted((r.part, r.path, r.tokens) for r in files.collect())  # a row per file
    base, rows = 0, []
    for _, path, tokens in listed:
        rows.append((path, base))
        base += tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, place = file_system(path)
                found = []
                with fs.open_input_file(place) as f:
                    for doc, ids in read_documents(f, f.size()):
                        found.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(found) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), out, strict=True)], schema=out)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    return spark.createDataFrame(rows, "path string, base long").repartition(len(rows)).mapInArrow(run, schema)
