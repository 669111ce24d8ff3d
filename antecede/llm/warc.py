"""WARC archives through a chunked record table.

A payload becomes rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, each with the digest
state so far: SHA-1 and length of the payload up to and including the chunk. The chunk table is stored once; what
decides record types (digest and length of the last chunk) is small and travels alone. Writing and
reading handle a chunk at a time, so a record of any size is never held whole.

Of records with equal payload, the one with the largest page id is the response, others revisit it
without payload. Each task writes one archive of gzip members, one member per record, under a name of its
own attempt; only archives in the stored manifest are read, so a lost executor or a repeated attempt leaves
at most a file that nobody reads. Archives lie in a folder that all executors share.

Defined results: a null payload is empty; a null page id is kept and sorts below all ids; rows that repeat a page id
are records of their own, of which, with equal payloads, one is the response; empty tables give no archive; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from antecede.llm.common import shared_folder, small_batches, stored

CHUNK = 1 << 16
MIN_BYTES = 0  # payloads below are all response
READ = 1 << 18
VERSION, END = b"WARC/1.1", b"\r\n"
CHUNKS = "record long, page_id long, url string, chunk int, last boolean, data binary, sha1 string, bytes long"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of pages (page_id, url, html)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("record", "page_id", "url", "chunk", "last", "data", "sha1", "bytes")
        kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.int64())))
        rows, held = {n: [] for n in names}, 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            batch = pa.RecordBatch.from_arrays([pa.array(rows[n], kinds[n]) for n in names], names=list(names))
            rows, held = {n: [] for n in names}, 0
            return batch

        for batch in batches:
            html = batch.column("html").cast(pa.binary())
            for i in range(batch.num_rows):
                view = memoryview(html[i].as_buffer()) if html[i].is_valid else memoryview(b"")
                digest, n = hashlib.sha1(), len(view)
                for k, at in enumerate(range(0, max(n, 1), size)):
                    part = view[at: at + size]
                    digest.update(part)
                    done = at + size >= n
                    for name, value in zip(names, (batch.column("record")[i].as_py(), batch.column("page_id")[i].as_py(),
                                                   batch.column("url")[i].as_py(), k, done, bytes(part),
                                                   _base32(digest.copy().digest()), min(at + size, n))):
                        rows[name].append(value)
                    held += len(part)
                    if held >= 1 << 23 or len(rows["record"]) >= 10_000:
                        yield flush()
        if rows["record"]:
            yield flush()

    source = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"),
                          F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(cut, CHUNKS)


def decided(chunks: DataFrame) -> DataFrame:
    """(record, payload_sha1, payload_bytes, kind, refers_to) from the last chunk of each record."""
    ends = chunks.filter("last").select("record", "page_id", F.col("sha1").alias("payload_sha1"), F.col("bytes").alias("payload_bytes"))
    order = F.struct(F.col("page_id").isNotNull(), "page_id", "record")
    heads = ends.filter(F.col("payload_bytes") >= MIN_BYTES).groupBy("payload_sha1", "payload_bytes").agg(
        F.max(F.struct(order.alias("o"), "record", "page_id")).alias("head"), F.count("*").alias("n")).filter("n > 1")
    return ends.join(heads, ["payload_sha1", "payload_bytes"], "left").select(
        "record", "payload_sha1", "payload_bytes",
        F.when(F.coalesce(F.col("head.record") != F.col("record"), F.lit(False)), "revisit").otherwise("response").alias("kind"),
        F.when(F.col("head.record") != F.col("record"), F.col("head.page_id")).alias("refers_to"))


def _clean(value: object) -> str:
    return "".join(c if c >= " " else "?" for c in str(value))


def _header(row: dict) -> bytes:
    """Header block of a record; the page id stands in the record id, so that reading needs no other table."""
    stored_bytes = row["payload_bytes"] if row["kind"] == "response" else 0
    lines = [VERSION.decode(), f"WARC-Type: {row['kind']}", f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
             f"WARC-Target-URI: {_clean(row['url'] or '')}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{row['payload_sha1']}", f"WARC-Payload-Length: {row['payload_bytes']}",
             "Content-Type: text/html; charset=utf-8"]
    if row["kind"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{'' if row['refers_to'] is None else row['refers_to']}>"]
    return END.join(x.encode() for x in [*lines, f"Content-Length: {stored_bytes}", "", ""])


def written(chunks: DataFrame, folder: str) -> DataFrame:
    """Write archives under ``folder``; the manifest (path, records) of those that count."""
    first = (F.col("kind") == "response") | (F.col("chunk") == 0)
    rows = chunks.select("record", "page_id", "url", "chunk", "last", "data").join(decided(chunks), "record").filter(first)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, packer, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, None, 0
        system = None
        for batch in batches:
            data = batch.column("data")
            for i, row in enumerate(batch.drop_columns(["data"]).to_pylist()):
                if out is None:
                    system, place = pafs.FileSystem.from_uri(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place, compression=None)  # members are packed here
                if row["chunk"] == 0:
                    packer, records = zlib.compressobj(1, zlib.DEFLATED, 31), records + 1
                    out.write(packer.compress(_header(row)))
                if row["kind"] == "response":
                    out.write(packer.compress(data[i].as_buffer()))
                if row["last"] or row["kind"] == "revisit":
                    out.write(packer.compress(END + END) + packer.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})

    # All chunks of a record lie together and in order; every record is a key of its own.
    placed = rows.repartition("record").sortWithinPartitions("record", "chunk")
    return stored(placed.mapInArrow(write, "path string, records long"), "manifest")


class _Members:
    """Decompressed bytes of consecutive gzip members, a block at a time."""

    def __init__(self, stream: io.RawIOBase):
        self.stream, self.packed, self.held, self.unpacker = stream, b"", bytearray(), None

    def _more(self) -> bool:
        if not self.packed:
            self.packed = self.stream.read(READ)
            if not self.packed:
                return False
        if self.unpacker is None:
            self.unpacker = zlib.decompressobj(31)
        self.held += self.unpacker.decompress(self.packed, READ)
        self.packed = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
        if self.unpacker.eof:
            self.unpacker = None
        return True

    def header(self) -> dict[str, str] | None:
        while (at := self.held.find(END + END)) < 0:
            if not self._more():
                return None
        lines = bytes(self.held[:at]).decode().split("\r\n")
        del self.held[: at + 4]
        return dict(x.split(": ", 1) for x in lines[1:])

    def blocks(self, size: int) -> Iterator[bytes]:
        while size:
            while not self.held:
                if not self._more():
                    raise EOFError("archive ends within a record")
            part = bytes(self.held[:size])
            del self.held[: len(part)]
            size -= len(part)
            yield part


def read(manifest: DataFrame) -> DataFrame:
    """Records of the archives, with length and digest of the payload as it was read."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(value: str | None) -> int | None:
        digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with system.open_input_stream(place, compression=None) as stream:
                    members = _Members(stream)
                    while (head := members.header()) is not None:
                        digest, n = hashlib.sha1(), 0
                        for part in members.blocks(int(head["Content-Length"])):
                            digest.update(part)
                            n += len(part)
                        b"".join(members.blocks(len(END + END)))
                        found = _base32(digest.digest())
                        noted = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and found != noted:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} in {path} does not match its digest")
                        rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"],
                                     int(head["WARC-Payload-Length"]) if revisit else n, noted if revisit else found,
                                     head["WARC-Type"], number(head.get("WARC-Refers-To"))))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # A task per archive: the table of paths is tiny, and without a number its partitions would be merged into one.
    files = manifest.select("path").repartition(max(manifest.count(), 1), "path")
    return files.mapInArrow(parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write a record per page into archives in the session's shared folder and read them back."""
    small_batches(pages.sparkSession)
    chunks = stored(chunked(pages), "chunks")
    return read(written(chunks, shared_folder(pages.sparkSession, "warc")))
