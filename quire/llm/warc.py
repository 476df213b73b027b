"""WARC archives in seekable Zstandard bundles.

Tasks write bundles of up to about ``BUNDLE`` bytes of records into the shared folder. Records are grouped into
independent Zstandard frames of about ``FRAME`` bytes; a seek table in a skippable frame at the end gives the frames'
sizes. The index maps each record to its bundle, its frame and its offset inside the frame, so a reader
fetches the footer and one frame, not the bundle. A bundle's name holds a random part, and only the index says
which bundles count: a task that is run again leaves at most an orphan. Reading deals runs of ``RUN`` neighbouring
frames to tasks of about ``TASK`` bytes of records; a task holds one frame at a time.

Payloads are UTF-8 texts. Of records with equal payloads of at least ``LEAST`` bytes, the one with the
smallest id is a response and the others are revisits that refer to it; smaller ones are responses.

Defined results: a null payload is empty; a null id counts as larger than all and is written without
one; of rows with equal ids and payloads one is the response; a null url is left out; a record longer than a frame
has a frame of its own; a payload that was damaged is an error; an empty table gives no records; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _spark as S

#: Bytes of records in a frame, about; a longer record makes a frame alone.
FRAME = 1 << 17
#: Bytes of records in a bundle, about, and in a task that reads; neighbouring frames that one task reads.
BUNDLE, TASK, RUN = 1 << 30, 1 << 25, 16
#: Payloads of fewer bytes are never revisits.
LEAST = 100
LEVEL = 3

# Fixed values of the seekable format: the skippable frame's magic number, and the seek table's own.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")

_INDEX = "record string, bundle string, frame int, at long, length long"


def record_kinds(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Rows of ``pages`` with id, url, payload, digest, bytes, and ``source``: the struct (id, record) of the
    response that the row revisits, null for a response."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = S.row_keyed(pages, 1, id=F.col(id_col), url=F.col(url_col), payload=payload).drop("_b")
    record = F.concat_ws("-", F.hex("_f"), "_r")
    small = rows.select("_f", "_r", "id", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), record.alias("record"))
    first = small.filter(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "record")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    kinds = small.join(first.select("digest", "first"), "digest", "left").select(
        "_f", "_r", "record", "digest", "bytes", F.when((F.col("bytes") >= LEAST) & (F.col("first.record") != F.col("record")), F.struct("first.id", "first.record")).alias("source")
    )
    return rows.join(kinds, ["_f", "_r"]).select("record", "id", "url", "payload", "digest", "bytes", "source")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _bytes_of(record: str, page, url: str | None, payload: str, digest: str, size: int, source: dict | None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if source else 'response'}", f"WARC-Record-ID: <urn:x-row:{record}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", ""]
    block = "\r\n".join(http).encode()
    if source:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-row:{source['record']}>"]
        if source["id"] is not None:
            head.append(f"X-Refers-To-Page-ID: {source['id']}")
    else:
        block += payload.encode()
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, out, level: int = LEVEL):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.length = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset in it of the record."""
        if self.held and self.length + len(record) > FRAME:
            self.flush()
        at = (len(self.sizes), self.length)
        self.held.append(record)
        self.length += len(record)
        return at

    def flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.out.write(frame)
            self.sizes.append((len(frame), self.length))
            self.held, self.length = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + _FOOTER.pack(len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(end - _FOOTER.size)
        n, _, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != _SEEKABLE:
            raise ValueError("not a seekable bundle")
        file.seek(end - _FOOTER.size - 8 * n)
        sizes = list(struct.iter_unpack("<II", file.read(8 * n)))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        import zstandard

        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)


def write_archives(kinds: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of ``record_kinds`` as bundles in ``folder``; the index, as a table in the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, size = None, "", 0
        for part in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):
            rows = []
            for x in part.to_pylist():
                if writer is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path, recursive=True)
                    name, size = f"{uuid.uuid4().hex}.warc.zst", 0
                    writer = BundleWriter(store.open_output_stream(f"{path}/{name}", compression=None))
                data = _bytes_of(x["record"], x["id"], x["url"], x["payload"], x["digest"], x["bytes"], x["source"])
                rows.append((x["record"], name, *writer.add(data), len(data)))
                size += len(data)
                if size >= BUNDLE:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["record", "bundle", "frame", "at", "length"])
        if writer is not None:
            writer.close()

    return S.written(kinds.mapInArrow(write, _INDEX), "warc-index")


def parse_record(data: bytes) -> dict:
    """Headers of a record (lower case) and its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    if lines[0] != "WARC/1.1" or len(block) != int(out["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {out.get('warc-record-id')}")
    out["payload"] = None if out["warc-type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
    return out


_READ = [("record", "string"), ("id", "string"), ("url", "string"), ("record_type", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("refers_to", "string"), ("payload", "binary")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records at the places that ``index`` (or some of its rows) gives: id, url, record_type, payload_bytes,
    payload_digest, refers_to (ids as strings) and, if wanted, payload. A payload that doesn't match its digest is an error."""
    columns = _READ if payloads else _READ[:-1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        now, file, reader, frame, data = "", None, None, -1, b""
        out: list[tuple] = []
        for x in (x for batch in batches for k in range(0, batch.num_rows, 1024) for x in batch.slice(k, 1024).to_pylist()):
            if (x["bundle"], x["frame"]) != (now, frame):
                if out:
                    yield _records(out, columns)
                    out = []
                if x["bundle"] != now:
                    if file is not None:
                        file.close()
                    now, file = x["bundle"], store.open_input_file(f"{path}/{x['bundle']}")
                    reader = BundleReader(file)
                frame, data = x["frame"], reader.frame(x["frame"])
            r = parse_record(data[x["at"] : x["at"] + x["length"]])
            digest, size = r["warc-payload-digest"].removeprefix("sha256:"), int(r["x-payload-length"])
            if r["payload"] is not None and (hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != size):
                raise ValueError(f"payload of {r['warc-record-id']} doesn't match its digest")
            out.append((x["record"], r.get("x-page-id"), r.get("warc-target-uri"), r["warc-type"], size, digest, r.get("x-refers-to-page-id"), r["payload"])[: len(columns)])
        if out:
            yield _records(out, columns)
        if file is not None:
            file.close()

    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.withColumn("run", F.floor(F.col("frame") / RUN)).repartition(max(1, round(total / TASK)), "bundle", "run")
    return dealt.sortWithinPartitions("bundle", "frame", "at").drop("run").mapInArrow(read, ", ".join(f"{c} {t}" for c, t in columns))


def _records(rows: list[tuple], columns: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, _ARROW[t]) for x, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], names=[c for c, _ in columns])


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes ``pages`` as bundles in ``folder`` and returns their index."""
    return write_archives(record_kinds(pages, id_col, url_col, payload_col), folder)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = S.table_path(spark, "warc")
    kind = pages.schema["page_id"].dataType
    return read_archives(archive(pages, folder), folder, payloads=False).select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
