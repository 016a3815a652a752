"""WARC archives as seekable Zstandard bundles: independent frames, a seek table, an index of record places."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.llm._shared import filtered, id_filter, joined_by_count, materialize, runs, shared_folder

# Fixed values of the seekable format: skippable frame, footer.
_SKIPPABLE, _FOOTER = 0x184D2A5E, 0x8F92EAB1
#: A frame is closed once its records have so many bytes; a longer record has a frame of its own.
FRAME = 1 << 18
#: Bytes of records, before compression, that a task reads back.
READ = 32 << 20
_INDEX = "page_id long, archive string, frame int, start long, length long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, kind: str, refers_to: int | None, size: int, digest: str, payload: bytes) -> bytes:
    """One WARC/1.1 record. A revisit has no block, but names the digest and size of the payload that it repeats."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((uri or '').split())}",
        "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by name in lower case, and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


class BundleWriter:
    """Writes frames as they fill and the seek table at the end."""

    def __init__(self, out, level: int = 3, frame: int = FRAME):
        self.out, self.frame, self.squeeze = out, frame, zstandard.ZstdCompressor(level=level)
        self.open: list[bytes] = []
        self.filled, self.sizes = 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset inside the frame, once decompressed."""
        if self.filled and self.filled + len(data) > self.frame:
            self._close()
        place = len(self.sizes), self.filled
        self.open.append(data)
        self.filled += len(data)
        return place

    def _close(self) -> None:
        packed = self.squeeze.compress(b"".join(self.open))
        self.out.write(packed)
        self.sizes.append((len(packed), self.filled))
        self.open, self.filled = [], 0

    def finish(self) -> None:
        if self.filled:
            self._close()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _FOOTER)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads the seek table from the end of a bundle, then any frame alone."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _FOOTER:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        source.seek(size - 9 - frames * width)
        table = source.read(frames * width)
        self.starts, at = [], 0
        for i in range(frames):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.starts.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.starts[i]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=max(plain, 1))


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", smallest: int = 0) -> DataFrame:
    """(id, digest, refers_to) of the payloads that revisit another: those of `smallest` bytes or more that a smaller id has too.

    Rows that repeat an id are told apart by their payload's digest; those with the same id
    and payload all count as that page. Null ids never revisit, nor are they revisited.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    digests = materialize(
        pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(
            F.col("id").isNotNull() & (F.col("size") >= smallest)
        )
    )
    first = digests.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return joined_by_count(digests.select("id", "digest"), first, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct()


def write_archives(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", smallest: int = 0, frame: int = FRAME
) -> DataFrame:
    """Write a record for each row to bundles in `folder` (a URI that all executors share); return the index of record places.

    The index has (page_id, archive, frame, start, length): start is relative to the frame. Each task
    writes one bundle under a name of its own and moves it into place when whole, so a lost
    or repeated task leaves no half bundle; the index names only bundles of tasks that
    succeeded. Payloads of ids that an id filter clears of being revisits are written where they
    are read; only the others are shuffled. Null payloads are empty; a null uri is written as
    an empty one. A null id is written as an empty one and comes back null. Repeated ids get a
    record each, a revisit only for a payload that a smaller id has. An empty table gives an
    empty index. Only the three columns are read, whatever others are named.
    """
    again = materialize(plan_records(pages, id_col, payload_col, smallest))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).cast("string").alias("payload")
    )
    words = id_filter(again, "id")
    surely = filtered(rows, "id", words, inside=False).withColumn("refers_to", F.lit(None).cast("long"))
    digest = F.sha1(F.coalesce("payload", F.lit("")).cast("binary"))
    doubtful = filtered(rows, "id", words, inside=True).withColumn("digest", digest).join(again.hint("merge"), ["id", "digest"], "left").select(surely.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        out = writer = None
        name = f"{uuid.uuid4().hex}.warc.zst"
        places: list[tuple] = []
        for batch in batches:
            for i, uri, text, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "uri", "payload", "refers_to")), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/_{name}", compression=None)
                    writer = BundleWriter(out, frame=frame)
                payload = (text or "").encode("utf-8", "surrogatepass")
                data = record(i, uri, "response" if refers is None else "revisit", refers, len(payload), sha1_base32(payload), payload)
                no, start = writer.add(data)
                places.append((i, name, no, start, len(data)))
        if writer is None:
            return
        writer.finish()
        out.close()
        fs.move(f"{base}/_{name}", f"{base}/{name}")
        for k in range(0, len(places), 10_000):
            cols = zip(*places[k : k + 10_000], strict=True)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "archive", "frame", "start", "length"])

    return materialize(surely.unionByName(doubtful).mapInArrow(run, _INDEX))


def read_records(index: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """Records at the places of an index, or of any part of it; a frame is decompressed once for all its records.

    payload_bytes and payload_digest are of the full payload, for revisits too; payload is
    null for revisits, or everywhere without `payloads`. A response whose payload doesn't
    match its digest is an error. Tasks get about READ bytes of records each, in runs of frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        name = source = bundle = None
        for t in runs(batches, ["key", "frame"]):
            for archive in dict.fromkeys(t["archive"].to_pylist()):  # more than one only if two names have the same key
                if archive != name:
                    if source is not None:
                        source.close()
                    name = archive
                    source = fs.open_input_file(f"{base}/{name}")
                    bundle = BundleReader(source, source.size())
                data = bundle.frame(t["frame"][0].as_py())
                out = []
                for a, start, length in zip(*(t[c].to_pylist() for c in ("archive", "start", "length")), strict=True):
                    if a == archive:
                        out.append(_fields(data[start : start + length], payloads))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"],
                )
        if source is not None:
            source.close()

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    keyed = index.select(F.xxhash64("archive").alias("key"), "archive", "frame", "start", "length")
    dealt = keyed.repartition(max(1, -(-size // READ)), "key", F.floor(F.col("frame") / 16))
    return dealt.sortWithinPartitions("key", "archive", "frame", "start").mapInArrow(run, _READ)


def _number(urn: str | None) -> int | None:
    x = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def _fields(data: bytes, payloads: bool) -> tuple:
    head, block = parse(data)
    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    if kind == "response" and sha1_base32(block) != digest:
        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
    return (
        _number(head["warc-record-id"]), int(head["x-payload-length"]), digest, kind, _number(head.get("warc-refers-to")),
        head["warc-target-uri"], block if payloads and kind == "response" else None,
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one, with the scheme that Hadoop resolves it to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}/warc-{uuid.uuid4().hex}"
