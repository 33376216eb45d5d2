"""WARC archives as a chunked record table.

Payloads travel as (record, chunk number, bytes) rows: the JVM slices them, the writer streams the slices into
gzip members, the reader yields them again. Each chunk row carries the SHA-1 of the payload up to its end, so a
record is verified piece by piece and no Python worker ever holds a whole one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

CHUNKS = "file string, record long, row_id string, record_type string, refers_to string, total_bytes long, chunk_no int, chunk_bytes long, payload_digest string, data binary"
MANIFEST = "path string, n_records long, n_bytes long"
READ_BLOCK = 1 << 18


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_chunks(rows: DataFrame, id_col: str, uri_col: str, payload_col: str, chunk_bytes: int = 1 << 20, least_bytes: int = 0) -> DataFrame:
    """The rows as WARC chunk rows, in JVM expressions. A null payload is empty. Of records with equal payloads of at
    least least_bytes, those with the smallest id are responses and the others revisit that id; where all ids are
    null, all are responses. Revisits carry one empty chunk. Equal payloads are found by SHA-1 with a pre-aggregated
    grouping, and the join back may be split where one payload is hot."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    # the urn is no clash: only the named columns are read
    base = rows.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    base = base.withColumns({"sha": F.sha1("payload"), "total": F.octet_length("payload").cast("long")})
    firsts = base.filter(F.col("total") >= least_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    joined = base.join(firsts.filter("n > 1").select("sha", "first"), "sha", "left")
    revisit = F.coalesce(F.col("first") < F.col("id"), F.lit(False)) | (F.col("first").isNotNull() & F.col("id").isNull())
    last = F.when(F.col("revisit"), 0).otherwise(F.greatest(F.ceil(F.col("total") / chunk_bytes) - 1, F.lit(0))).cast("int")
    cut = F.when(F.col("revisit"), F.lit("").cast("binary")).otherwise(F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return (
        joined.withColumn("revisit", revisit)
        .select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
        .select(
            F.col("id").cast("string").alias("row_id"),
            "uri",
            "sha",
            "total",
            F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
            F.when(F.col("revisit"), F.col("first").cast("string")).alias("refers_to"),
            "chunk_no",
            cut.alias("data"),
        )
    )


def _head(row, content_bytes: int, place: str) -> bytes:
    """place: the record's own, in its file. A response is named by its id and payload, so that revisits can refer to
    it; rows that are equal in both share that name."""
    named = f"row:{row.row_id}:{row.sha}" if row.row_id is not None and row.record_type == "response" else place
    record = uuid.uuid5(uuid.NAMESPACE_URL, named)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row.record_type}",
        f"WARC-Record-ID: <urn:uuid:{record}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((row.uri or '').split())}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(row.sha))}",
        f"X-Payload-Length: {row.total}",
        "Content-Type: text/html",
        f"Content-Length: {content_bytes}",
    ]
    if row.row_id is not None:
        lines.insert(3, f"X-Row-ID: {row.row_id}")
    if row.record_type == "revisit":
        first = uuid.uuid5(uuid.NAMESPACE_URL, f"row:{row.refers_to}:{row.sha}")
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{first}>", f"X-Refers-To-Row-ID: {row.refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_warc(chunks: DataFrame, folder: str, roll_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Streams chunk rows into gzipped WARC files, one or more for each task, and returns the manifest of files.

    File names hold the task attempt; the manifest is itself a committed table, so files of failed or repeated
    attempts are never listed. An empty input gives an empty manifest."""
    where = folder

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = store.filesystem(where)
        fs.create_dir(path, recursive=True)
        context, part = TaskContext.get(), 0
        out, name, records, sink, sha = None, "", 0, None, None

        def end(row) -> None:
            out.write(sink.compress(b"\r\n\r\n") + sink.flush())
            if row.record_type == "response" and sha.hexdigest() != row.sha:
                raise ValueError(f"payload of row {row.row_id} changed while it was written")

        last, size = None, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.chunk_no == 0:
                    if last is not None:
                        end(last)
                    if out is not None and out.tell() >= roll_bytes:
                        size = out.tell()
                        out.close()
                        yield pd.DataFrame([(name, records, size)], columns=["path", "n_records", "n_bytes"])
                        out = None
                    if out is None:
                        name = f"{where}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{part:03d}.warc.gz"
                        out, records, part = fs.open_output_stream(f"{path}/{name.rpartition('/')[2]}", compression=None), 0, part + 1
                    records += 1
                    sink, sha = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    out.write(sink.compress(_head(row, row.total if row.record_type == "response" else 0, f"{name}#{records}")))
                sha.update(row.data)
                out.write(sink.compress(row.data))
                last = row._replace(data=None)
        if out is not None:
            end(last)
            size = out.tell()
            out.close()
            yield pd.DataFrame([(name, records, size)], columns=["path", "n_records", "n_bytes"])

    return store.written(chunks.mapInPandas(task, MANIFEST), "warc-manifest")


class _Inflater:
    """Bytes of concatenated gzip members, read block by block."""

    def __init__(self, source) -> None:
        self.source, self.gz, self.buffer = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            if self.gz.eof:
                rest, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            else:
                rest = self.gz.unconsumed_tail
            block = rest or self.source.read(READ_BLOCK)
            if not block:
                return False
            got = self.gz.decompress(block, READ_BLOCK)
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("an archive ends inside a record")
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        if not self.buffer and not self.more():
            raise ValueError("an archive ends inside a record")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def read_warc(manifest: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """Chunk rows of all records in the manifest's files, each with its file and its number there. payload_digest is the SHA-1 (base32) of the payload up to
    the end of the chunk; a full record's digest that differs from its header fails the task. Revisits yield one
    empty chunk with the digest and total_bytes that their header names. with_data=False leaves data null."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        for batch in batches:
            for uri in batch["path"]:
                fs, path = store.filesystem(uri)
                rows, held, number = [], 0, -1
                with fs.open_input_stream(path, compression=None) as source:
                    stream = _Inflater(source)
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().strip().split("\r\n")[1:])
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        number += 1
                        common = (uri, number, fields.get("X-Row-ID"), kind, fields.get("X-Refers-To-Row-ID"), int(fields["X-Payload-Length"]))
                        left, chunk_no, sha = int(fields["Content-Length"]), 0, hashlib.sha1()
                        if not left:
                            rows.append((*common, 0, 0, digest, b"" if with_data else None))
                        while left:
                            parts, size = [], 0
                            while size < min(chunk_bytes, left):
                                parts.append(stream.take(min(chunk_bytes, left) - size))
                                size += len(parts[-1])
                                sha.update(parts[-1])
                            left -= size
                            rows.append((*common, chunk_no, size, base32_sha1(sha.digest()), b"".join(parts) if with_data else None))
                            chunk_no, held = chunk_no + 1, held + size * with_data
                            if held >= 4 << 20 or len(rows) >= 5000:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, held = [], 0
                        if chunk_no and base32_sha1(sha.digest()) != digest:
                            raise ValueError(f"record {number} of {uri} doesn't have the digest it names")
                        while len(stream.buffer) < 4 and stream.more():
                            pass
                        stream.buffer = stream.buffer[4:]
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(min(files, 4096)).mapInPandas(task, CHUNKS)


def record_table(chunks: DataFrame) -> DataFrame:
    """One row a record from its chunk rows: the last chunk's running digest is the payload's. Records are told apart by
    their places in the files, so row ids may repeat or be null."""
    return chunks.groupBy("file", "record", "row_id", "record_type", "refers_to").agg(
        F.max("total_bytes").alias("payload_bytes"), F.sum("chunk_bytes").alias("stored_bytes"), F.max_by("payload_digest", "chunk_no").alias("payload_digest"), F.count("*").alias("n_chunks")
    )
