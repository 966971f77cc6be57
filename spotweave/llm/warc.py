"""WARC archives: one gzip member for each record, written and read in sequence by Spark tasks.

Writing: each task appends records to archives of about ``ARCHIVE_BYTES`` under names that no other attempt uses, and
returns one manifest row for each archive. The manifest is a Parquet table, so only the archives of tasks that Spark
committed are in it; what a lost executor or a second attempt left behind is never read.

Reading: each task takes archives of the manifest and reads them as streams, ``READ_BYTES`` at a time. zlib decompresses
member by member and hands out what it has; the WARC head gives the length of the block (``Content-Length``), and the
record's block is framed by it. The SHA-1 of a response's payload is worked out and compared with the record's digest; a
wrong digest, a wrong length or a broken member raises an error.

Duplicates: of the records with equal payloads of at least ``min_bytes``, the one with the smallest id is the response
and the others are revisits, which refer to it and hold no payload. Payloads are equal where SHA-1 and length are. Rows
that repeat the smallest id with the same payload are the same record, and all stay responses; a null id comes after all
others. Null payloads are empty. A table without rows gives no archive and no records. Other columns of the input are
not archived. Long payloads are streamed on reading; a writer holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.llm import common

ARCHIVE_BYTES, READ_BYTES = 64 << 20, 256 << 10
#: Tasks to which the records of one payload are dealt.
SALTS = 64
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long"
RECORDS = T.StructType([T.StructField("record_type", T.StringType()), T.StructField("record_id", T.LongType()), T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType())])


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of ``uri`` and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# --- duplicates


def decide_types(pages: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (binary) and ``refers_to`` (null for responses) of each row."""
    data = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.length("payload"))
    salt = F.xxhash64("page_id")
    repeated = common.salted_min(rows.where(F.col("size") >= min_bytes).select("digest", "size", "page_id"), ["digest", "size"], "page_id", "low", salt, SALTS)
    lows = common.written(repeated.where("_n > 1").select("digest", "size", "_salt", "low"))
    joined = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS))).join(lows, ["digest", "size", "_salt"], "left")
    refers = F.when(F.col("low").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("low")), F.col("low"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


# --- writing


def _name(kind: int | None) -> str:
    return "<urn:page:none>" if kind is None else f"<urn:page:{kind}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {''.join(url.split())}"] if url else []),
        *([f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(hashlib.sha1(payload).digest())}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    raw = VERSION + b"\r\n" + "\r\n".join(head).encode() + END + block + END
    packer = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return packer.compress(raw) + packer.flush()


def write_archives(records: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of ``decide_types`` as ``*.warc.gz`` below ``folder`` and returns the manifest table."""
    spark = records.sparkSession
    common.small_batches(spark)
    target = folder or common.shared_folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(target)
        system.create_dir(path, recursive=True)
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = system.open_output_stream(name, compression=None), 0, 0
                member = record(*row)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        root = target.rstrip("/")
        yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{n.rsplit('/', 1)[1]}" for n, _, _ in done], pa.string()), pa.array([c for _, c, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.int64())], names=["archive", "records", "bytes"])

    rows = records.select("page_id", "url", F.col("payload"), "refers_to")
    return common.written(rows.mapInArrow(run, MANIFEST))


# --- reading


class Members:
    """The decompressed bytes of a stream of gzip members, a piece at a time."""

    def __init__(self, stream, step: int = READ_BYTES):
        self.stream, self.step, self.raw = stream, step, b""

    def start(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        if not self.raw:
            self.raw = self.stream.read(self.step)
        self.unpack, self.out = zlib.decompressobj(16 + zlib.MAX_WBITS), bytearray()
        return bool(self.raw)

    def more(self) -> bool:
        """Decompress about one step more of this member; False at its end."""
        while not self.unpack.eof:
            self.raw = self.raw or self.stream.read(self.step)
            ended = not self.raw  # what zlib still holds may come out yet
            piece = self.unpack.decompress(self.raw, self.step)
            if ended and not piece and not self.unpack.eof:
                raise ValueError("the archive ends inside a gzip member")
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if piece:
                self.out += piece
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """The bytes up to ``mark``, which is taken too."""
        while (at := self.out.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record has no end of its head")
        head = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.out and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece = bytes(self.out[:n])
            del self.out[: len(piece)]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_records(stream, payloads: bool = True) -> Iterator[tuple]:
    """The records of one archive, as rows of RECORDS; the payload is None for revisits or if not asked for."""
    members = Members(stream)
    while members.start():
        head = members.until(END)
        if not head.startswith(b"WARC/1."):
            raise ValueError("a gzip member doesn't start with a WARC record")
        fields = _fields(head)
        left = int(fields["content-length"])
        http = members.until(END)
        left -= len(http) + len(END)
        declared = int(_fields(http)["content-length"])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        kept = None
        if fields["warc-type"] == "response":
            found, kept = hashlib.sha1(), bytearray()
            for piece in members.take(left):
                found.update(piece)
                if payloads:
                    kept += piece
            if base32_sha1(found.digest()) != digest or left != declared:
                raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest or length")
            kept = bytes(kept) if payloads else None
        else:
            for _ in members.take(left):
                pass
        if b"".join(members.take(len(END))) != END or members.more() or members.out:
            raise ValueError(f"{fields['warc-record-id']} isn't framed by its Content-Length")
        refers = _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
        yield fields["warc-type"], _page(fields["warc-record-id"]), refers, fields.get("warc-target-uri"), declared, digest, kept


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) of all archives in the manifest; each archive is read by one task from start to end."""
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = store(name)
                with system.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for row in read_records(stream, payloads):
                        rows.append(row)
                        size += len(row[-1] or b"") + 200
                        if size >= common.SLICE_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    tasks = spark.sparkContext.defaultParallelism
    archives = manifest.select("archive")
    return archives.repartition(max(tasks, manifest.count() // 4), "archive").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=RECORDS.names)
