"""WARC archives as a chunked record table, in both directions.

Payloads travel as rows of (record, chunk number, bytes) whose size is bounded,
so no task holds a whole payload in Python, however large a record is. The
writer streams the chunks of a record into the archive and stops if their
digest is not the announced one; the reader streams an archive file and gives
every chunk with the byte count and SHA-1 of the payload up to its end, so the
last chunk carries the digest of the whole.

Archives go to the shared folder, one gzip member per record unless told
otherwise. A task names its files after its own
attempt, and only files in the written manifest count, so retried tasks leave
nothing that is read. Equal payloads from a size on are stored once: the
record with the largest key is the response, the others are revisits of it.

Defined results: a null payload is empty; a null url has no target line; rows
without key that repeat the payload of a row with key are revisits, else
responses; rows repeating both key and payload of the response are responses
too; an empty table gives no records. Only the three named columns are read,
so other columns cannot clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetlens.session import scratch_path, staged

CHUNK = 1 << 20
FILE_BYTES = 256 << 20
REVISIT_FROM = 1000
# Fixed value: the profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def chunk_rows(pages: DataFrame, key: str, url: str, payload: str, chunk: int = CHUNK) -> DataFrame:
    """(key, url, digest, refers_to, total, chunk, data): payloads in chunks that stay together and in order."""
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "total": F.octet_length("body").cast("long")})
    shared = rows.where(F.col("total") >= REVISIT_FROM).groupBy("digest", "total")
    first = shared.agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = rows.join(first, ["digest", "total"], "left")
    again = F.col("refers_to").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_to"))
    known = known.withColumn("refers_to", F.when(again, F.col("refers_to")))
    parts = F.when(F.col("refers_to").isNotNull(), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("total") / chunk), F.lit(1))).cast("int")
    cut = known.withColumn("chunk", F.explode(F.sequence(F.lit(0), parts - 1)))
    data = F.when(F.col("refers_to").isNull(), F.substring("body", F.col("chunk") * chunk + 1, F.lit(chunk)))
    return cut.select("key", "url", "digest", "refers_to", "total", "chunk", data.alias("data"))


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}|{digest}')}>"


def _head(key, url, digest, refers_to, total) -> bytes:
    block = len(HTTP) + (0 if refers_to is not None else total)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {DATE}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {block}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if key is not None:
        lines.append(f"X-Row-Key: {key}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP


def write_archives(rows: DataFrame, folder: str, compress: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes chunk rows below ``folder``; returns the manifest (path, records, bytes), itself a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        done, out, sink, path, records, left, digest, sha = [], None, None, None, 0, 0, None, None

        def open_next() -> None:
            nonlocal out, path, records
            path = f"{base}/{name}-{len(done):05d}.warc{'.gz' if compress else ''}"
            out, records = fs.open_output_stream(path, compression=None), 0

        def end_file() -> None:
            nonlocal out
            done.append((path, records, out.tell()))
            out.close()
            out = None

        for batch in batches:
            for key, url, announced, refers_to, total, chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk == 0:
                    if out is None:
                        open_next()
                    sink = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) if compress else out
                    sink.write(_head(key, url, announced, refers_to, total))
                    digest, sha, left = announced, hashlib.sha1(), total if refers_to is None else 0
                if data is not None:
                    sink.write(data)
                    sha.update(data)
                    left -= len(data)
                if left == 0:
                    if refers_to is None and sha.hexdigest() != digest:
                        raise ValueError(f"chunks of record {key} do not give its digest")
                    sink.write(b"\r\n\r\n")
                    if compress:
                        sink.close()
                    records += 1
                    if out.tell() >= file_bytes:
                        end_file()
        if out is not None:
            end_file()
        paths = [f"{folder.rstrip('/')}/{p.rsplit('/', 1)[1]}" for p, _, _ in done]
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            names=["path", "records", "bytes"],
        )

    return staged(rows.mapInArrow(write, "path string, records long, bytes long"), "manifest")


_CHUNKS = (
    "path string, record long, record_id string, record_type string, url string, key long, refers_to string, "
    "declared string, chunk int, last boolean, n_bytes long, digest string, data binary"
)


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(stream: io.BufferedReader, path: str, chunk: int) -> Iterator[tuple]:
    """The chunk rows of one archive."""
    number = 0
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record where one should begin: {line[:40]!r}")
        head = _fields(stream)
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            while left > 0:
                line = stream.readline(left)
                left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break
        declared = head.get("warc-payload-digest", "")
        if declared.lower().startswith("sha1:") and len(declared) == 37:
            declared = base64.b32decode(declared[5:].upper()).hex()
        key = int(head["x-row-key"]) if "x-row-key" in head else None
        sha, n, part = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if left and not data:
                raise ValueError(f"{path}: record {number} ends early")
            left -= len(data)
            n += len(data)
            sha.update(data)
            yield (
                path, number, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), key,
                head.get("warc-refers-to"), declared or None, part, left == 0, n, sha.copy().hexdigest(), data,
            )
            part += 1
            if left == 0:
                break
        number += 1


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, batch_bytes: int = 4 << 20) -> DataFrame:
    """The chunk rows of all archives of a manifest; n_bytes and digest run up to the end of each chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CHUNKS.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), *[pa.string()] * 2, pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                raw = io.BufferedReader(fs.open_input_stream(place, compression=None), 1 << 20)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if path.endswith(".gz") else raw
                rows, size = [], 0
                for row in read_records(stream, path, chunk):
                    rows.append(row)
                    size += len(row[-1]) + 400
                    if size >= batch_bytes:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)
                stream.close()

    paths = manifest.select("path")
    files = manifest.count()
    return paths.repartition(max(1, files), "path").mapInArrow(read, _CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """(record_id, key, url, record_type, payload_bytes, payload_digest, refers_to, intact) of responses and revisits.

    A revisit has the bytes and digest of its response, and ``refers_to`` is the response's key.
    """
    done = chunks.where(F.col("last") & F.col("record_type").isin("response", "revisit"))
    done = staged(done.select("record_id", "key", "url", "record_type", "refers_to", "declared", "n_bytes", "digest"), "records")
    full = done.where("record_type = 'response'")
    source = full.select(F.col("record_id").alias("refers_to"), F.col("key").alias("source"), F.col("n_bytes").alias("bytes"), F.col("digest").alias("sha"))
    revisits = done.where("record_type = 'revisit'").join(source.dropDuplicates(["refers_to"]), "refers_to", "left")
    columns = lambda n, sha, ref: [
        "record_id", "key", "url", "record_type", n.alias("payload_bytes"), sha.alias("payload_digest"), ref.alias("refers_to"),
        sha.eqNullSafe(F.col("declared")).alias("intact"),
    ]
    return full.select(*columns(F.col("n_bytes"), F.col("digest"), F.lit(None).cast("long"))).unionByName(
        revisits.select(*columns(F.col("bytes"), F.col("sha"), F.col("source")))
    )


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", compress: bool = True) -> DataFrame:
    """Writes the pages as archives in the shared folder; returns the manifest."""
    folder = scratch_path(pages.sparkSession, "warc")
    return write_archives(chunk_rows(pages, key, url, payload), folder, compress)
