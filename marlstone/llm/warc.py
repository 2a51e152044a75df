"""WARC archives: write them with an index, then read selected records by coalesced byte ranges.

Each write task makes files of its own, one gzip member a record, and returns an index row for each record: file, offset, length, URL,
digest. The index is a table; a file of a task that failed is in no index. Readers sort index rows by file and
offset, join neighbouring ranges and read each joined range at once. Files are reached by pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fs_of, join_by_hot_key, small_batches, written

#: Equal payloads are written once if they have at least so many bytes.
LEAST_REVISIT = 100
#: A file is closed once it has so many bytes.
FILE_BYTES = 256 << 20
#: Ranges at most this far apart are read together, up to READ_BYTES at once.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
_INDEX = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_DDL = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_DDL[f.type]}" for f in schema)


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload (bytes; null is empty), digest, n_bytes, refers_to for each row.

    Of rows with equal payloads of at least LEAST_REVISIT bytes those with the smallest page_id are responses (all rows that have it, if
    it is repeated; all rows, if every page_id is null) and refers_to is null; the others, null ids included, revisit it. Only digests and ids are
    shuffled while the repeated digests are few enough to be broadcast; beyond that payloads move too, and hot ones are joined by broadcast, so that no
    task gets more than a thousandth of the rows for one payload.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("bigint"))
    groups = rows.filter(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
    # Most payloads are their own: only the digests of repeated ones come back.
    out = join_by_hot_key(rows, written(groups, "repeated"), "digest", "n")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= LEAST_REVISIT)
    return out.select("page_id", "url", "payload", "digest", "n_bytes", F.when(revisit, F.col("first_id")).alias("refers_to"))


def _line(text: str | None) -> str:
    """A header's value keeps to its line."""
    return "" if text is None else " ".join(text.split())


def record_id(file: str, offset: int) -> str:
    """A record's own id, by where it stands: rows that repeat a page_id are records each."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{file}:{offset}').urn}>"


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def member(own: str, page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None, level: int = 1) -> bytes:
    """One WARC/1.1 record, of the id `own`, as a gzip member; a revisit has the payload's digest and length, not the payload. Page ids are in headers of our own."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.insert(2, f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + c.flush()


def parse(record: bytes) -> dict:
    """The record of a gzip member."""
    raw = zlib.decompress(record, 31)
    head, _, body = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    payload = body[: int(h["Content-Length"])]
    revisit = h["WARC-Type"] == "revisit"
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not have its digest")
    return {
        "page_id": _number(h.get("X-Page-ID")), "url": h.get("WARC-Target-URI"), "record_type": h["WARC-Type"], "refers_to": _number(h.get("X-Refers-To-Page")) if revisit else None,
        "payload_digest": digest, "payload_bytes": int(h["X-Payload-Length"]), "payload": None if revisit else payload,
    }


def write(records: DataFrame, path: str, level: int = 1) -> DataFrame:
    """Writes plan_records() rows as archives under path; returns their index, which is kept as a table in path/index.

    Whoever reads goes by the index. Files of tasks that failed or ran twice are not in it.
    """
    small_batches(records.sparkSession)
    archive = f"{path}/archive"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = fs_of(archive)
        fs.create_dir(base, recursive=True)
        out = name = None
        at = 0
        for b in batches:
            index: list[dict] = []
            for r in b.to_pylist():
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)  # members are made here
                data = member(record_id(name, at), r["page_id"], r["url"], r["payload"], r["digest"], r["n_bytes"], r["refers_to"], level)
                out.write(data)
                index.append({"page_id": r["page_id"], "file": name, "offset": at, "length": len(data), "url": r["url"], "digest": r["digest"], "record_type": "response" if r["refers_to"] is None else "revisit"})
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
        if out is not None:
            out.close()

    spark = records.sparkSession
    records.mapInArrow(run, _ddl(_INDEX)).write.parquet(f"{path}/index")
    return spark.read.schema(_ddl(_INDEX)).parquet(f"{path}/index")


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) pairs as reads: start, end and the pairs within."""
    reads: list = []
    for at, n in ranges:
        if reads and at - reads[-1][1] <= gap and at + n - reads[-1][0] <= most:
            reads[-1][1] = max(reads[-1][1], at + n)
            reads[-1][2].append((at, n))
        else:
            reads.append([at, at + n, [(at, n)]])
    return [tuple(x) for x in reads]


def read(selected: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """Records for index rows (whole or filtered): page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    payload is null for revisits, and for all if payloads is false. Each digest is checked. Rows are dealt out by ranges of file and offset, so that
    every task reads neighbouring bytes, whatever the selection.
    """
    small_batches(selected.sparkSession)
    archive = f"{path}/archive"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = fs_of(archive)
        name = source = None
        for b in batches:
            names = b.column(0).to_pylist()
            spans = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            i = 0
            while i < len(names):
                j = i
                while j < len(names) and names[j] == names[i]:
                    j += 1
                if names[i] != name:
                    if source is not None:
                        source.close()
                    name, source = names[i], fs.open_input_file(f"{base}/{names[i]}")
                for start, end, inside in coalesce(spans[i:j]):
                    source.seek(start)
                    data = source.read(end - start)
                    found = [parse(data[at - start : at - start + n]) for at, n in inside]
                    if not payloads:
                        for r in found:
                            r["payload"] = None
                    yield pa.RecordBatch.from_pylist(found, schema=_RECORD)
                i = j
        if source is not None:
            source.close()

    spark = selected.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = selected.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(run, _ddl(_RECORD))
