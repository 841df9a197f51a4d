"""WARC archives with an index first, and reads of selected records by coalesced byte ranges.

Every task writes the records of its rows to archives of its own, one gzip member per record, and
reports offset, length, URL and digest of each; those reports are the index, a table that Spark
commits.  An archive left by a lost attempt is in no index and is never read.  Reading sorts
the selected index rows by archive and offset, merges neighbouring ranges into one read each, and
parses the records out of it.

Of rows with equal payloads of at least ``REVISIT_BYTES`` the smallest page_id is a response and
the others revisit it; a revisit has the HTTP head of the payload (with its length) and the
digest, not its bytes.

Defined cases: null html is an empty payload; a null url is empty; a null page_id comes after all
others and revisits a response that has one; rows that repeat the page_id of the response are responses
as well; an empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharewise.plans import shared_path, store

REVISIT_BYTES = 100

#: An archive is closed beyond this size and another begun.
ARCHIVE_BYTES = 1 << 30

#: Ranges this near are read in one go, up to the second size.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20

INDEX = (
    "page_id long, url string, archive string, offset long, length long, payload_digest string, record_type string"
)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder and the path in it; local paths may lack a scheme."""
    scheme, _, rest = uri.rpartition("file:")
    if scheme or not uri.startswith(("file:", "/")):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), "/" + rest.lstrip("/")


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:page:{'none' if i is None else i}:{digest}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#[]!*()%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: {name(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines if ": " in line)}


def parse(member: bytes) -> dict:
    """The fields of one record, from its gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: (lambda i: None if i == "none" else int(i))(name.split(":")[2])
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": page(fields["warc-record-id"]),
        "payload": None if revisit else payload,
        "payload_bytes": int(_headers(http)["content-length"]) if revisit else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "record_type": fields["warc-type"],
        "refers_to": page(fields["warc-refers-to"]) if revisit else None,
    }


def _planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to of every row."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
    first = first.where("_n > 1 and refers_to is not null").drop("_n")
    revisits = (
        large.join(first, "digest").where("page_id is null or page_id > refers_to")
        .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct()
    )
    return rows.join(
        revisits, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left"
    ).select("page_id", "url", "html", "digest", "refers_to")


def write(spark: SparkSession, pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row to archives under ``folder`` (shared by all executors); return the index."""
    folder = folder or shared_path(spark, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        archive, out, offset = "", None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        archive, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{archive}", compression=None)
                    record = _record(page_id, url, html.encode(), digest, refers_to, date)
                    out.write(record)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((page_id, url, archive, offset, len(record), digest, kind))
                    offset += len(record)
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    index = _planned(pages).mapInArrow(work, INDEX)
    return store(index, "index").withColumn("folder", F.lit(folder))


def read(index: DataFrame, selected: Column | None = None, payload: bool = True) -> DataFrame:
    """The selected records of an index: page_id, payload (null for revisits), payload_bytes,
    payload_digest, record_type and refers_to, all from the archives."""
    rows = index if selected is None else index.where(selected)
    rows = rows.select("folder", "archive", "offset", "length")
    rows = rows.repartitionByRange("folder", "archive", "offset").sortWithinPartitions("folder", "archive", "offset")
    names = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(),
             "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if not payload:
        del names["payload"]

    def ranges(rows: list[tuple]) -> Iterator[list[tuple]]:
        """Runs of index rows that one read covers."""
        run: list[tuple] = []
        for row in rows:
            if run and (
                row[:2] != run[0][:2] or row[2] - (run[-1][2] + run[-1][3]) > GAP_BYTES
                or row[2] + row[3] - run[0][2] > READ_BYTES
            ):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in ranges(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                files, path = _filesystem(run[0][0])
                with files.open_input_file(f"{path}/{run[0][1]}") as archive:
                    low = run[0][2]
                    data = archive.read_at(run[-1][2] + run[-1][3] - low, low)
                found = [parse(data[o - low : o - low + n]) for _, _, o, n in run]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[n] for f in found], t) for n, t in names.items()], list(names)
                )

    kinds = {"payload": "binary", "payload_digest": "string", "record_type": "string"}
    return rows.mapInArrow(work, ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names))
