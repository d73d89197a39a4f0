"""WARC archives as Zstandard frames: a writer and a reader with a dictionary in the leading skippable frame.

Layout of one archive: a skippable frame (magic 0x184D2A5D, length, then the dictionary, itself compressed), then one frame
for each record. Archives are written by tasks through the file system that the folder's URI names, first under a name of
the attempt and then renamed, so that a repeated task replaces what a lost one left.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, bytes_of, new_folder, small_batches, stored

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A dictionary is trained on this many bytes of payload at the start of an archive, a bounded sample.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
#: Digests that more than one record has, which may be sent to all executors; beyond it the join is shuffled.
BROADCAST_DIGESTS = 500_000
#: Bytes of payload in one archive, about.
ARCHIVE_BYTES = 64 << 20

READ_SCHEMA = "archive string, at long, record_id string, page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class BadArchive(ValueError):
    """A frame, header or length that does not hold what it says."""


# --- one archive ------------------------------------------------------------------------------------------------------


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or plain sample bytes where there is too little to train on."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8


def record_bytes(row) -> bytes:
    """Headers and block of one record; a revisit keeps the HTTP head but not the payload."""
    page = "" if row["page_id"] is None else str(row["page_id"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] if row["record_type"] == "response" else b"")
    head = [
        VERSION.decode(),
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:x-page:{page}:{row['copy']}>",
        f"WARC-Target-URI: {' '.join((row['url'] or 'urn:x-unknown').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{row['refers_to']}:0>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Holds back the first records until there is enough to train the dictionary on, then streams."""

    def __init__(self, sink):
        self.sink, self.held, self.size, self.frames, self.coder = sink, [], 0, 0, None

    def add(self, record: bytes) -> None:
        self.size += len(record)
        self.frames += 1
        if self.coder:
            self.sink.write(self.coder.compress(record))
            return
        self.held.append(record)
        if self.size >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        raw = train([x[:16384] for x in self.held])
        packed = zstd.ZstdCompressor(level=19).compress(raw)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.coder = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(raw), write_content_size=True)
        for x in self.held:
            self.sink.write(self.coder.compress(x))
        self.held = []

    def close(self) -> None:
        if not self.coder:
            self._start()
        self.sink.close()


def parse_record(raw: bytes) -> dict:
    """Check one record's headers, lengths and digests and return its fields."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise BadArchive(f"no {VERSION.decode()} header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise BadArchive(f"bad header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    try:
        kind, length, record = fields["warc-type"], int(fields["content-length"]), fields["warc-record-id"]
        payload_digest, block_digest = fields["warc-payload-digest"], fields["warc-block-digest"]
    except (KeyError, ValueError) as e:
        raise BadArchive(f"missing or bad field {e}") from None
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length {length} does not fit a record of {len(rest)} bytes")
    block = rest[:length]
    if block_digest != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise BadArchive("the block has another digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or not http.startswith(b"HTTP/") or len(sizes) != 1:
        raise BadArchive("bad HTTP head")
    if kind == "response":
        if len(payload) != sizes[0] or payload_digest != f"sha1:{hashlib.sha1(payload).hexdigest()}":
            raise BadArchive("the payload has another length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise BadArchive(f"bad record of type {kind}")

    def page(uri: str | None) -> int | None:
        n = uri.strip("<>").split(":")[2] if uri else ""
        return int(n) if n else None

    return {
        "record_id": record, "page_id": page(record), "target_uri": fields.get("warc-target-uri"), "record_type": kind,
        "payload_bytes": sizes[0], "payload_digest": payload_digest.partition(":")[2], "refers_to": page(fields.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


def read_archive(source):
    """Yield (offset, fields) for each record of a seekable binary file."""
    lead = source.read(8)
    if len(lead) < 8 or struct.unpack("<I", lead[:4])[0] != SKIPPABLE:
        raise BadArchive("no leading dictionary frame")
    size = struct.unpack("<I", lead[4:])[0]
    packed = source.read(size)
    if len(packed) != size:
        raise BadArchive("the dictionary frame is cut short")
    raw = zstd.ZstdDecompressor().decompress(packed) if packed[:4] == FRAME_MAGIC else packed
    coder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
    at, data = 8 + size, b""
    while True:
        out, frame = io.BytesIO(), coder.decompressobj()
        used, start = 0, at
        while not frame.eof:
            if not data and not (data := source.read(1 << 20)):
                if used:
                    raise BadArchive("a frame is cut short")
                return
            out.write(frame.decompress(data))
            used += len(data) - len(frame.unused_data)
            data = frame.unused_data
        at += used
        yield start, parse_record(out.getvalue())


# --- over tables ------------------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Adds payload facts and decides which records are responses and which revisit one.

    Of the records with equal payloads of at least `least` bytes, the one with the largest page_id (null: smallest of
    all; among repeated rows any one) is the response. Null html is an empty payload.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"), bytes_of("html").alias("payload_bytes"),
        F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("payload_digest"),
    )
    large = F.col("payload_bytes") >= least
    by_page = rows.where(large).groupBy(F.col("payload_digest").alias("digest"), F.col("page_id").alias("page")).agg(F.count("*").alias("n"))
    best = F.max(F.struct("page", "n"))
    # Only digests met twice are joined back, so that the payloads seldom need to move. A few bytes for each digest.
    repeated = stored(by_page.groupBy("digest").agg(F.sum("n").alias("all"), best.alias("first")).where("all > 1").select("digest", F.col("first.page").alias("first"), F.col("first.n").alias("tied")), "repeated")
    met = rows.join(broadcast_if_small(repeated, BROADCAST_DIGESTS), (F.col("payload_digest") == F.col("digest")) & large, "left")
    columns = ["page_id", "url", "html", "payload_bytes", "payload_digest"]
    even = F.col("page_id").eqNullSafe(F.col("first"))
    row = F.monotonically_increasing_id()

    def decided(df: DataFrame, response, number=F.lit(1) + row) -> DataFrame:
        kind = F.when(response, "response").otherwise("revisit")
        return df.select(*columns, kind.alias("record_type"), F.when(~response, F.col("first")).alias("refers_to"), F.when(response, F.lit(0)).otherwise(number).alias("copy"))

    if repeated.where("tied > 1").isEmpty():
        return decided(met, F.col("digest").isNull() | even)
    # Rows that share page_id and payload get numbers, which are stored with them before one is chosen.
    among = F.col("digest").isNotNull() & even & (F.col("tied") > 1)
    alike = stored(met.where(among).withColumn("number", row), "alike")
    chosen = stored(alike.groupBy("digest").agg(F.min("number").alias("chosen")), "chosen").withColumnRenamed("digest", "d")
    picked = alike.join(broadcast_if_small(chosen, BROADCAST_DIGESTS), F.col("digest") == F.col("d"))
    return decided(met.where(~among), F.col("digest").isNull() | even).unionByName(decided(picked, F.col("number") == F.col("chosen"), F.lit(-1) - row))


def write_archives(spark: SparkSession, records: DataFrame, folder: str) -> DataFrame:
    """Write planned records where they are; returns the manifest (archive, records, bytes), one row per archive."""

    def write(batches):
        part = TaskContext.get().partitionId()
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        n, writer, name, temp, done = 0, None, "", "", []

        def finish():
            writer.close()
            files.move(temp, f"{base}/{name}")
            done.append((f"{folder}/{name}", writer.frames, writer.size))

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"part-{part:05d}-{n:04d}.warc.zst"
                    temp = f"{base}/.{name}.{uuid.uuid4().hex}"
                    writer, n = ArchiveWriter(files.open_output_stream(temp)), n + 1
                row["payload"] = row["html"].encode()
                writer.add(record_bytes(row))
                if writer.size >= ARCHIVE_BYTES:
                    finish()
                    writer = None
        if writer:
            finish()
        if done:
            yield pa.RecordBatch.from_pydict({"archive": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]})

    small_batches(spark)
    return records.mapInArrow(write, "archive string, records long, bytes long")


def read_archives(spark: SparkSession, archives: DataFrame, payload: bool = True) -> DataFrame:
    """Read and validate every record of the archives listed in the column `archive`, one task per few archives."""

    def read(batches):
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                files, at = pafs.FileSystem.from_uri(path)
                with files.open_input_file(at) as source:
                    rows = []
                    for offset, fields in read_archive(source):
                        rows.append({"archive": path, "at": offset} | fields | ({} if payload else {"payload": None}))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return archives.mapInArrow(read, READ_SCHEMA)


SCHEMA = pa.schema([
    ("archive", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()),
    ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to archives and read them back: one row per record.

    Empty tables give no archive and no rows. Each writing task closes an archive after ARCHIVE_BYTES of records; a payload
    is one record, however long. A null url is an empty one; repeated rows are records of their own; ties for the response
    are settled as in plan_records(). Other columns are ignored, whatever their names.
    """
    manifest = stored(write_archives(spark, plan_records(pages), folder or new_folder(spark, "warc")), "manifest")
    return read_archives(spark, manifest.select("archive").repartition(max(1, manifest.count())), payload=False)
