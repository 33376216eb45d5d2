"""Media columns: payloads as content-addressed members of tar shards; rows hold digest, offset and length.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become the samples of an 8-bit grey PNG of
64 columns. Metadata columns come from range reads of the members' first bytes; features from whole members.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: signature, IHDR chunk, and a tEXt chunk with the unpadded length in 20 digits
HEADER_BYTES = 8 + 25 + 12 + len(b"n_bytes\0") + 20
LOCATIONS = "media_sha256 string, shard string, offset long, length long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def encode_png(data: bytes, level: int = 6) -> bytes:
    """A PNG whose samples are data, padded; each line has filter 0."""
    lines = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(lines), WIDTH + 1), np.uint8)
    raw[:, 1:] = lines
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"n_bytes\0%020d" % len(data))
    return SIGNATURE + head + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and unpadded length from a member's first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or head[37:41] != b"tEXt":
        raise ValueError("not a stored payload")
    return (*struct.unpack(">II", head[16:24]), int(head[HEADER_BYTES - 24 : HEADER_BYTES - 4]))


def decode_png(png: bytes) -> bytes:
    """The samples, padding included. Chunk checksums and line filters are checked."""
    at, height, packed = 8, png_header(png[:HEADER_BYTES])[1], []
    while at < len(png):
        (size,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("only line filter 0 is written")
    return raw[:, 1:].tobytes()


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, the share of zeros and of steps that change sign."""
    counts = np.bincount(samples, minlength=256).astype(float)
    share = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float(counts @ values) / len(samples)
    deviation = float(np.sqrt(max(0.0, counts @ (values - mean) ** 2 / len(samples))))
    steps = np.sign(np.diff(samples.astype(np.int16)))
    turns = float(np.mean(steps[1:] * steps[:-1] < 0)) if len(steps) > 1 else 0.0
    return f"mean={mean:.4f};sd={deviation:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f};zeros={counts[0] / len(samples):.4f};turns={turns:.4f}"


def store_payloads(rows: DataFrame, folder: str, id_col: str, text_col: str, roll_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Writes the rows' texts (null: empty) into tar shards and returns id_col with digest, shard, offset and length.

    Members are named by the SHA-256 of their bytes, and a task writes equal ones once. Rows of all tasks that have
    the same digest then point to one member, so copies in other shards are never read and can be swept; this moves
    digests between machines but no payload. Shard names hold the task attempt, and the returned table is committed,
    so members of failed or repeated attempts are never referenced. Empty input: empty table.
    """
    where, id_type = folder, dict(rows.dtypes)[id_col]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = store.filesystem(where)
        fs.create_dir(path, recursive=True)
        context, part, out, name, seen = TaskContext.get(), 0, None, "", {}
        for batch in batches:
            found = []
            for text in batch["text"]:
                data = (text or "").encode("utf-8", "surrogatepass")
                key = hashlib.sha256(data).digest()
                if key not in seen:
                    if out is not None and out.tell() >= roll_bytes:
                        out.write(bytes(1024))
                        out.close()
                        out, seen = None, {}
                    if out is None:
                        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}-{part:03d}.tar"
                        out, part = fs.open_output_stream(f"{path}/{name}", compression=None), part + 1
                    png = encode_png(data, level)
                    digest = hashlib.sha256(png).hexdigest()
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(png)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT))
                    seen[key] = (digest, f"{where}/{name}", out.tell(), len(png))
                    out.write(png)
                    out.write(bytes(-len(png) % 512))
                found.append(seen[key])
            yield pd.concat([batch[["id"]].reset_index(drop=True), pd.DataFrame(found, columns=["media_sha256", "shard", "offset", "length"])], axis=1)
        if out is not None:
            out.write(bytes(1024))
            out.close()

    slim = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return store.written(slim.mapInPandas(task, f"id {id_type}, {LOCATIONS}"), "media-rows").withColumnRenamed("id", id_col)


def members(rows: DataFrame) -> DataFrame:
    """One location for each digest, pre-aggregated where the rows are."""
    return rows.groupBy("media_sha256").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("media_sha256", "at.*")


def _read(places: DataFrame, schema: str, use, whole: bool) -> DataFrame:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard, part in batch.groupby("shard", sort=False):
                fs, path = store.filesystem(shard)
                with fs.open_input_file(path) as source:
                    for row in part.sort_values("offset").itertuples(index=False):
                        out.append((row.media_sha256, *use(source.read_at(row.length if whole else min(HEADER_BYTES, row.length), row.offset), row)))
                        if len(out) == 2000:
                            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
                            out = []
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return places.mapInPandas(task, schema)


def headers(places: DataFrame) -> DataFrame:
    """Metadata columns, read from HEADER_BYTES bytes of each member."""

    def use(head: bytes, row) -> tuple:
        width, height, n_bytes = png_header(head)
        return width, height, n_bytes, width * height, row.length

    return _read(places, "media_sha256 string, width int, height int, n_bytes long, payload_bytes long, media_bytes long", use, False)


def features(places: DataFrame) -> DataFrame:
    """Digests and features of each member's payload, from the bytes read back. A member whose bytes don't have the
    digest that addresses it fails the task."""

    def use(png: bytes, row) -> tuple:
        if hashlib.sha256(png).hexdigest() != row.media_sha256:
            raise ValueError(f"{row.shard} holds other bytes at {row.offset}")
        payload = decode_png(png)
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature(np.frombuffer(payload, np.uint8))

    return _read(places, "media_sha256 string, payload_sha256 string, tail_crc32 long, feature string", use, True)
