"""WARC archives compressed record by record with an embedded Zstandard dictionary.

A writer task gathers records up to `archive_bytes`, builds a dictionary from
them (evenly spread over the whole archive), and writes one ``.warc.zst`` file: a
skippable frame (magic 0x184D2A5D) with the dictionary, then one frame per record,
so any record can be read by itself. Equal payloads are stored once: the page with
the largest id is the response, the others are revisit records that keep the HTTP
header with the full payload's length. Payloads are compared by SHA-1 in the JVM
and only counted groups are joined back, pre-aggregated, so a payload that a third
of the pages share costs one row.

Defined cases: null html is an empty payload; null ids are responses unless an
equal payload has an id; rows that repeat the largest id are all responses; null
or multi-line urls are percent-escaped; an archive of too few records to train a
dictionary gets one of their beginnings; a payload of any length is one record and may fill an
archive alone; an empty table has no archive; other columns are ignored; ids that are not integers are refused.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import filesystem, fresh_path, whole_numbers, written

# Fixed values of the published formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _uri(url: str | None) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    if data[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    http_end = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:http_end].decode().split("\r\n")[1:])
    return head, http, block[http_end + 4 :]


def dictionary(records: list[bytes], size: int = 112 << 10, sample_bytes: int = 8 << 20) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread evenly over the archive; where they are too few to train one, their beginnings are it."""
    total = sum(map(len, records))
    samples = records[:: max(1, -(-total // sample_bytes))]
    trained = min(size, sum(map(len, samples)) // 8)
    if len(samples) >= 8 and trained >= 256:
        try:
            return zstandard.train_dictionary(trained, samples, k=256, d=8)
        except zstandard.ZstdError:
            pass  # samples that have nothing in common: raw content serves them as well
    content = b"".join(r[: max(256, size // len(samples))] for r in samples)[:size]
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(path: str, records: list[bytes], level: int = 3) -> int:
    """Write one archive file; returns its size."""
    fs, at = filesystem(path)
    found = dictionary(records)
    coder = zstandard.ZstdCompressor(level=level, dict_data=found, write_content_size=True)
    size = 0
    with fs.open_output_stream(at, compression=None) as out:
        data = found.as_bytes()
        size += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        for r in records:
            size += out.write(coder.compress(r))
    return size


def read_archive(path: str) -> Iterator[bytes]:
    """The records of one archive, in order."""
    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None) as file:
        data = file.read()
    found, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        (n,) = struct.unpack_from("<I", data, 4)
        body, at = data[8 : 8 + n], 8 + n
        found = zstandard.ZstdCompressionDict(zstandard.decompress(body) if body[:4] == FRAME_MAGIC else body)
    coder = zstandard.ZstdDecompressor(dict_data=found)
    view = memoryview(data)
    while at < len(data):
        one = coder.decompressobj()
        out = [one.decompress(view[at : at + (1 << 16)])]
        end = min(at + (1 << 16), len(data))
        while not one.eof:
            if end >= len(data):
                raise ValueError(f"{path} ends inside a record")
            out.append(one.decompress(view[end : end + (1 << 20)]))
            end = min(end + (1 << 20), len(data))
        at = end - len(one.unused_data)
        yield b"".join(out)


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    part = TaskContext.get().partitionId()
    held: list[bytes] = []
    held_bytes = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, held_bytes
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.zst"
        size = write_archive(path, held)
        out = pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([len(held)], pa.int64()), "bytes": pa.array([size], pa.int64())})
        held, held_bytes = [], 0
        return out

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for r in batch.slice(lo, 256).to_pylist():
                digest = base64.b32encode(r["sha1"]).decode()
                held.append(record(r["page_id"], r["url"], (r["html"] or "").encode(), digest, r["refers_to"], r["revisit"]))
                held_bytes += len(held[-1])
                if held_bytes >= archive_bytes:
                    yield flush()
    if held:
        yield flush()


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows: list[tuple] = []
            for data in read_archive(path):
                head, http, payload = parse(data)
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"a payload in {path} does not match its digest")
                rows.append((_page(head["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, _page(head.get("WARC-Refers-To")), head["WARC-Target-URI"]))
            ids, sizes, digests, kinds, refers, urls = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": pa.array(ids, pa.int64()),
                    "payload_bytes": pa.array(sizes, pa.int64()),
                    "payload_digest": digests,
                    "record_type": kinds,
                    "refers_to": pa.array(refers, pa.int64()),
                    "target_uri": urls,
                }
            )


def write(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write all pages; returns the manifest (path, n_records, bytes)."""
    whole_numbers(pages, "page_id")
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html)).alias("sha1"))
    groups = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = groups.filter((F.col("n") > 1) & F.col("first_id").isNotNull()).select(F.col("sha1").alias("g"), "first_id")
    linked = rows.join(shared, rows.sha1 == shared.g, "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    linked = linked.select("page_id", "url", "html", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))
    return written(linked.mapInArrow(lambda b: _write(b, folder, archive_bytes), "path string, n_records long, bytes long"), "warc-manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    dealt = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return dealt.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Round trip over all pages."""
    return read(pages.sparkSession, write(pages, min_bytes))
