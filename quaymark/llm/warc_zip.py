"""WARC records in ZIP packages, and a reader that takes single records out of them by range reads.

Each writing task makes one package: ``archive/data.warc.gz``, whose records are gzip members of their own, and
``indexes/index.cdx`` with a line for each record (offset, length). Both members are stored, not
compressed again, so a record can be read where it lies. The reader parses the end record, the ZIP64
locator and record, the central directory and the local headers, and reads nothing but these,
the index and the records asked for; it never extracts a member.

Of records with equal payloads of at least ``LEAST_SHARED`` bytes, the one with the largest page is a response;
the others are revisits that name it and hold no payload. Equality is by SHA-256 and length.

Nulls: a null html is an empty payload; a null url is an empty target; rows with a null page id are written
with an empty id, read back as null, and never referred to, unless all rows of a payload have none.
Rows with the same page id and payload: one is the response, the others revisit it. An empty table gives no
files and no rows.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.sources.shared import filesystem, new_path, stored

LEAST_SHARED = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
MANIFEST = "path string, n_records long"
SPANS = "path string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
#: Records that one reading task takes.
READ = 2048
ROWS = 256

# Fixed values of the ZIP format.
END, END64, LOCATOR, CENTRAL, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class ZipRanges:
    """The stored members of a ZIP file, found and read by ranges."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        tail_at = max(0, size - 22 - FULL16)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(struct.pack("<I", END))
        if end < 0:
            raise ValueError("no end record: not a ZIP file")
        count, length, offset = struct.unpack_from("<HII", tail, end + 10)
        if count == FULL16 or FULL32 in (length, offset):
            magic, _, at, _ = struct.unpack("<IIQI", self.read(tail_at + end - 20, 20))
            if magic != LOCATOR:
                raise ValueError("no ZIP64 locator")
            record = self.read(at, 56)
            if struct.unpack_from("<I", record)[0] != END64:
                raise ValueError("no ZIP64 end record")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, tuple[int, int]] = {}
        directory, at = self.read(offset, length), 0
        for _ in range(count):
            (magic, _, _, _, method, _, _, _, packed, full, n, extra, comment, _, _, _, header) = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
            if magic != CENTRAL:
                raise ValueError("damaged central directory")
            name = directory[at + 46 : at + 46 + n].decode("utf-8")
            full, packed, header = self._wide(directory[at + 46 + n : at + 46 + n + extra], full, packed, header)
            if method == 0:
                self.members[name] = (header, full)
            at += 46 + n + extra + comment

    @staticmethod
    def _wide(extra: bytes, *values: int) -> tuple[int, ...]:
        """Values that the ZIP64 extra field holds in place of the full ones, in its order."""
        at = 0
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
                return tuple(next(wide) if v == FULL32 else v for v in values)
            at += 4 + length
        return values

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        found = self.file.read(length)
        if len(found) != length:
            raise ValueError("the file ends too early")
        return found

    def place(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member start, and how many there are."""
        header, size = self.members[name]
        fixed = self.read(header, 30)
        if struct.unpack_from("<I", fixed)[0] != LOCAL:
            raise ValueError("no local header")
        n, extra = struct.unpack_from("<HH", fixed, 26)
        return header + 30 + n + extra, size


class _Counted(io.RawIOBase):
    """A stream that can't seek, so that the ZIP writer needs no second look at what it wrote."""

    def __init__(self, out) -> None:
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record_bytes(row: dict) -> bytes:
    """A WARC record as one gzip member."""
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    revisit = row["revisit"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(row['page_id'])}",
        f"WARC-Target-URI: {(row['url'] or '').encode('unicode_escape').decode('ascii')}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['refers_to'])}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple:
    """``RECORD`` of a gzip member; the digest of a response is checked against its payload."""
    record = zlib.decompress(raw, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, length, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    url = fields["WARC-Target-URI"].encode("ascii").decode("unicode_escape")
    html = payload.decode("utf-8", "surrogatepass") if kind == "response" else None
    return _page(fields["WARC-Record-ID"]), url, length, digest, kind, _page(fields.get("WARC-Refers-To", record_id(None))), html


def _page(name: str) -> int | None:
    number = name[len("<urn:x-page:") : -1]
    return int(number) if number else None


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` with ``revisit`` and ``refers_to``. Groups are summed up before the shuffle and come back by a join."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.when(F.octet_length(html) >= LEAST_SHARED, F.sha2(html, 256)).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    )
    # the row decides between rows with the same page id
    first = F.max(F.struct(F.col("page_id"), F.col("row")))
    shared = (
        keyed.where("payload is not null").groupBy("payload").agg(first.alias("kept"), F.count("*").alias("n")).where("n > 1")
        .select("payload", F.col("kept.page_id").alias("kept_id"), F.col("kept.row").alias("kept_row"))
    )
    joined = keyed.join(shared, "payload", "left")
    revisit = F.coalesce(F.col("row") != F.col("kept_row"), F.lit(False))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("kept_id")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all ``pages`` as WARC records into ZIP packages; returns the manifest."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, ROWS) for row in batch.slice(at, ROWS).to_pylist())
        first = next(rows, None)
        if first is None:
            return
        # each attempt has a file of its own; the manifest names those of the attempts that count
        name = f"{folder}/part-{uuid.uuid4().hex}.wacz"
        fs, path = filesystem(name)
        lines, at = [], 0
        with fs.open_output_stream(path, compression=None) as out, zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_STORED) as package:
            with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                for row in itertools.chain([first], rows):
                    raw = record_bytes(row)
                    data.write(raw)
                    lines.append(f"{at} {len(raw)} {'' if row['page_id'] is None else row['page_id']}")
                    at += len(raw)
            with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
                index.write("\n".join(lines).encode())
        yield pa.RecordBatch.from_pylist([{"path": name, "n_records": len(lines)}])

    return stored(with_revisits(pages).mapInArrow(write, MANIFEST), "warc-manifest")


def locate_records(manifest: DataFrame) -> DataFrame:
    """``SPANS`` of all records: the packages' directories and indexes are read, no record is."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch["path"].to_pylist()):
            fs, local = filesystem(path)
            with fs.open_input_file(local) as file:
                package = ZipRanges(file, file.size())
                start, _ = package.place(DATA)
                lines = package.read(*package.place(INDEX)).decode().split("\n")
            spans = [line.split(" ")[:2] for line in lines if line]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(spans)), pa.array([start + int(o) for o, _ in spans], pa.int64()), pa.array([int(n) for _, n in spans], pa.int64())],
                names=["path", "offset", "length"],
            )

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(locate, SPANS)


def read_records(spans: DataFrame) -> DataFrame:
    """The records at ``spans``, each taken by one range read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, group in itertools.groupby(batch.to_pylist(), key=lambda r: r["path"]):
                fs, local = filesystem(path)
                with fs.open_input_file(local) as file:
                    rows = []
                    for span in group:
                        file.seek(span["offset"])
                        rows.append(parse_record(file.read(span["length"])))
                        if len(rows) == ROWS:
                            yield _records(rows)
                            rows = []
                    if rows:
                        yield _records(rows)

    return spans.mapInArrow(read, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: what the packages hold for every page."""
    manifest = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    found = read_records(locate_records(manifest))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
s AS (SELECT html, max(page_id) AS kept FROM p WHERE n >= {LEAST_SHARED} GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN s USING (html)
"""
