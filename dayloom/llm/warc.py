"""WARC archives with an index written first, and readers that follow the index.

Writing: every task writes its own gzip-per-record archives to the shared folder and returns one
index row per record (file, offset, length, URL, digest). Archives carry the attempt's id in
their name, so a task that runs again leaves no half file in the index.
Reading: selected index rows are grouped into stretches of an archive, sorted by offset, and
neighbouring byte ranges are fetched in one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_batches, col, materialise, new_folder

INDEX_SCHEMA = (
    "page_id long, url string, payload_digest string, record_type string, file string, "
    "offset long, length long"
)
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    found = re.search(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    """One record as uncompressed bytes, and the digest of its payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse_record(data: bytes) -> dict:
    """The parts of one uncompressed record; a response's digest is taken from the payload read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": fields["WARC-Type"],
        "refers_to": _page_of(fields.get("WARC-Refers-To")),
        "payload": None if revisit else payload,
    }


def open_folder(uri: str):
    """The file system of a folder's address, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_warc(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    folder: str | None = None,
    min_bytes: int = 0,
    max_file_bytes: int = 256 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row and return the index, itself a written table.

    Of rows with equal payloads of at least ``min_bytes``, the one with the smallest page id is a
    response and the others revisit it. Null html is an empty payload. A row without a page id
    is always a response. Repeated rows with the smallest id are responses each. Other columns
    are not archived.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(
        col(page_id).cast("long").alias("page_id"),
        col(url).alias("url"),
        F.coalesce(col(html), F.lit("")).cast("binary").alias("payload"),
    )
    keyed = rows.withColumn("sha1", F.sha1("payload"))
    first = (
        keyed.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1 AND first_id IS NOT NULL").drop("copies")
    )
    told = keyed.join(first, "sha1", "left").select(
        "page_id", "url", "payload",
        F.expr(f"CASE WHEN octet_length(payload) >= {int(min_bytes)} AND page_id > first_id THEN first_id END").alias("refers_to"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = open_folder(folder)
        files.create_dir(top, recursive=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        out, name, at, count = None, "", 0, 0
        for batch in batches:
            index = []
            for pid, address, payload, refers in zip(batch.page_id, batch.url, batch.payload, batch.refers_to, strict=True):
                if out is None or at >= max_file_bytes:
                    if out is not None:
                        out.close()
                    name, at, count = f"{stem}-{count:03d}.warc.gz", 0, count + 1
                    out = files.open_output_stream(f"{top}/{name}", compression=None)
                pid = None if pd.isna(pid) else int(pid)
                refers = None if pd.isna(refers) else int(refers)
                record, digest = warc_record(pid, address, bytes(payload), refers, date)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = packer.compress(record) + packer.flush()
                out.write(packed)
                index.append((pid, address, digest, "response" if refers is None else "revisit", name, at, len(packed)))
                at += len(packed)
            columns = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
            yield pd.DataFrame(index, columns=columns).astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    index = told.mapInPandas(write, INDEX_SCHEMA).withColumn("folder", F.lit(folder))
    return materialise(index, "warc-index")


def read_warc(index: DataFrame, stretch_bytes: int = 32 << 20, gap_bytes: int = 64 << 10, read_bytes: int = 8 << 20) -> DataFrame:
    """Read the records of the given index rows.

    Rows are grouped by archive and stretch of ``stretch_bytes``; in a group, ranges at most
    ``gap_bytes`` apart are fetched together, up to ``read_bytes`` at once. An empty selection
    gives an empty table. A damaged record fails the job.
    """

    def fetch(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        files, top = open_folder(rows.folder.iloc[0])
        out = []
        with files.open_input_file(f"{top}/{rows.file.iloc[0]}") as archive:
            runs: list[list] = []
            for offset, length, url in zip(rows.offset, rows.length, rows.url, strict=True):
                if runs and offset - runs[-1][1] <= gap_bytes and offset + length - runs[-1][0] <= read_bytes:
                    runs[-1][1] = max(runs[-1][1], offset + length)
                else:
                    runs.append([offset, offset + length, []])
                runs[-1][2].append((offset, length, url))
            for start, end, members in runs:
                archive.seek(int(start))
                data = archive.read(int(end - start))
                for offset, length, url in members:
                    record = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                    out.append({**record, "url": url})
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    stretch = (F.col("offset") / F.lit(stretch_bytes)).cast("long").alias("stretch")
    return index.groupBy("folder", "file", stretch).applyInPandas(fetch, RECORD_SCHEMA)
