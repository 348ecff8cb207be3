"""WARC archives, index first.

Records are written as gzip members. Each writing task returns, for every record, the file,
offset, length, URL and digest; that index is a table of its own. Reading starts from the
index: the selected records are sorted by file and offset, near ranges are coalesced, and each
range is read once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.workspace import Workspace

#: Records whose gap in the file is at most this are read together, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Bytes of records that one reading task is dealt on average.
TASK_BYTES = 32 << 20
INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, payload_digest string, record_type string, refers_to bigint"
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
DATE = "2000-01-01T00:00:00Z"  # fixed, so that archives are reproducible


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark resolves it by, so that tasks mean the same place."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that tasks can read and write, from a path with its scheme."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        raise ValueError(f"a path without a scheme: {uri}")
    return pafs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has the HTTP head and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(url.split("\r")).replace("\n", ""))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def plan_revisits(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages that repeat the payload of a smaller page_id.

    Only digests and ids are dealt out; a payload that a third of all pages share is summed
    before the shuffle, and the join back is one that adaptive execution can split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha1(payload).alias("sha1"), F.length(payload).alias("bytes")).where(F.col("page_id").isNotNull() & (F.col("bytes") >= min_revisit_bytes))
    first = keyed.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where(F.col("refers_to") != F.col("last"))
    return keyed.join(first, "sha1").where(F.col("page_id") != F.col("refers_to")).select("page_id", "sha1", "refers_to")


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, space: Workspace | None = None) -> DataFrame:
    """Write one WARC file per partition of ``pages`` and return the index (columns of INDEX).

    A file has a name of its own for each attempt at a task, and only the index rows of the
    attempt that succeeded are kept, so a lost executor leaves at most an unread file.
    """
    space = space or Workspace(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    revisits = space.keep(plan_revisits(pages, min_revisit_bytes).distinct(), "revisits")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1")).join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")

    folder = qualified(pages.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        file = f"part-{uuid.uuid4().hex}.warc.gz"
        name = f"{folder}/{file}"
        out, offset, made = None, 0, []
        try:
            for batch in batches:
                made = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{file}", compression=None)
                    payload = html.encode()
                    digest = digest_of(payload)
                    data = record(page_id, url or "", payload, digest, refers_to)
                    out.write(data)
                    made.append((page_id, name, offset, len(data), url, digest, "response" if refers_to is None else "revisit", refers_to))
                    offset += len(data)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), INDEX_TYPES)], names=INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return space.keep(rows.mapInArrow(write, INDEX), "index")


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
INDEX_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]


def ranges(selected: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Coalesced (start, end, records) of records sorted by offset."""
    group: list[tuple[int, int]] = []
    for offset, length in selected:
        if group and (offset - (group[-1][0] + group[-1][1]) > GAP_BYTES or offset + length - group[0][0] > READ_BYTES):
            yield group[0][0], group[-1][0] + group[-1][1], group
            group = []
        group.append((offset, length))
    if group:
        yield group[0][0], group[-1][0] + group[-1][1], group


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that ``index`` selects back from the archives (columns of RESULT).

    Byte counts and digests of responses are computed from what was read and checked against
    the record's own digest; a revisit gives the payload's length by its HTTP head.
    """
    chunk = F.floor(F.col("offset") / F.lit(READ_BYTES))
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]  # the index is small, what it points at is not
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // TASK_BYTES))
    rows = index.select("file", "offset", "length", chunk.alias("chunk")).repartition(tasks, "file", "chunk").sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                by_file.setdefault(file, []).append((offset, length))
            for file, selected in by_file.items():
                system, path = filesystem(file)
                with system.open_input_file(path) as f:
                    for start, end, group in ranges(sorted(selected)):
                        data, got = f.read_at(end - start, start), []
                        for offset, length in group:
                            fields, http, payload = parse(data[offset - start : offset - start + length])
                            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            size = int(http["Content-Length"])
                            if kind == "response":
                                if digest != digest_of(payload) or size != len(payload):
                                    raise ValueError(f"damaged record at {offset} of {file}")
                            number = lambda x: int(x.rpartition(":")[2].rstrip(">"))
                            refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
                            got.append((number(fields["WARC-Record-ID"]), size, digest, kind, refers))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=[x.split()[0] for x in RESULT.split(", ")])

    return rows.mapInArrow(read, RESULT)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write every page to WARC, then read every record back through the index.

    A null html is an empty payload; equal payloads of at least ``min_revisit_bytes`` bytes
    are stored once, under the smallest page_id, and revisited by the others. A null url is
    left out of the record. Rows without a page_id have no record name: they are not archived.
    Repeated page_ids give a record per row. Extra columns are not looked at.
    """
    space = Workspace(pages.sparkSession, "warc")
    index = write_archives(pages.where(F.col("page_id").isNotNull()), f"{space.path}/archives", min_revisit_bytes, space)
    return read_records(index)
