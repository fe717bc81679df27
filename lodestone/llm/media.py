"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a greyscale image of 8-bit samples under its digest. Each writing task fills tar shards of its own in
the shared folder and stores a payload once; rows carry digest, shard, offset and length. Payloads that several tasks have
stored keep the first place as the canonical one, so equal payloads have one address. A shard's name is new for each attempt
of a task, and only rows of finished tasks name shards: what a lost executor left behind is never read. Payload bytes are
not shuffled; only addresses are.

Metadata columns come from range reads of the first HEADER bytes of a member; whole members are read for features only.
The shared folder must be of a kind that pyarrow.fs.FileSystem.from_uri knows: file, hdfs and viewfs, s3, gs or abfss.

Defined results: null text counts as empty; an empty payload is one block of fill bytes; texts of any length are one member;
repeated rows share a member; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, shared_path, slices, texts_of

BLOCK, FILL = 576, 255
WIDTH = 576
#: A shard is closed at this size; the next member starts another.
SHARD_BYTES = 64 << 20
#: Digests that a task remembers; beyond that a payload may be stored again, which costs space only.
REMEMBERED = 1_000_000
#: Stored bytes that a task reads back, about.
TASK_BYTES = 16 << 20
MAGIC = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # the signature and the header chunk


def padded(data: bytes) -> bytes:
    return data + bytes([FILL]) * (-len(data) % BLOCK if data else BLOCK)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """A lossless greyscale image, WIDTH samples a row."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row starts with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) of an image's first HEADER bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", head[16:25])


def decode_image(media: bytes) -> bytes:
    width, height, depth = read_header(media[:HEADER])
    data, at = [], HEADER
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width * depth // 8 + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written by this store")
    return rows[:, 1:].tobytes()


def feature(payload: bytes, width: int, height: int) -> str:
    """Size, mean and deviation of the samples, share of fill, and a 64-bit average hash over a grid of 8 by 8."""
    x = np.frombuffer(payload, np.uint8)
    cells = np.add.reduceat(x, np.arange(64) * (x.size // 64), dtype=np.int64)  # a block is 9 * 64 bytes
    bits = int.from_bytes(np.packbits(cells * 64 > cells.sum()).tobytes(), "big")
    return f"{width}x{height};mean={x.mean():.4f};std={x.std():.4f};fill={np.count_nonzero(x == FILL)};ahash={bits:016x}"


ADDRESSES = "doc_id long, n_bytes long, payload_bytes long, digest binary, shard string, offset long, length long"


def store(docs: DataFrame) -> tuple[DataFrame, str]:
    """Write docs(doc_id, text) to tar shards; a row for each row: doc_id, n_bytes, payload_bytes, digest, and its address; and the shards' folder."""
    root = shared_path(docs.sparkSession, "media")

    def run(batches):
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        attempt = uuid.uuid4().hex[:16]
        names = iter(f"{TaskContext.get().partitionId():06d}-{attempt}-{k}.tar" for k in range(1 << 30))
        seen: dict[bytes, tuple[str, int, int]] = {}
        out, name, size = None, "", 0
        try:
            for batch in slices(batches):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                    data = text.encode()
                    payload = padded(data)
                    digest = hashlib.sha256(payload).digest()
                    place = seen.get(digest)
                    if place is None:
                        media = encode_image(payload)
                        if out is None or size >= SHARD_BYTES:
                            if out is not None:
                                out.write(bytes(1024))
                                out.close()
                            name, size = next(names), 0
                            out = system.open_output_stream(f"{base}/{name}")
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(media)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + media + bytes(-len(media) % 512))
                        place = name, size + len(head), len(media)
                        size += len(head) + len(media) + -len(media) % 512
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen[digest] = place
                    rows.append((doc_id, len(data), len(payload), digest, *place))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
                cols = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(bytes(1024))
                out.close()

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ADDRESSES), "media-rows", keep=True), root


def canonical(rows: DataFrame) -> DataFrame:
    """One address for each digest: the first by shard and offset."""
    first = F.min(F.struct("shard", "offset", "length")).alias("at")
    return rows.groupBy("digest").agg(first).select("digest", "at.*")


def _read(addresses: DataFrame, root: str, columns: str, row) -> DataFrame:
    """addresses with what row(file, offset, length) returns for columns; shards are read in order of offset."""
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches):
        system, base = fs.FileSystem.from_uri(root)
        name, file = None, None
        for batch in slices(batches):
            found = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if name != shard:
                    if file is not None:
                        file.close()
                    name, file = shard, system.open_input_file(f"{base}/{shard}")
                found.append(row(file, offset, length))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("shard"), batch.column("offset"), *(pa.array(c) for c in zip(*found))], names=["digest", "shard", "offset", *names])

    stored = addresses.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-stored // TASK_BYTES))  # by what is read, not by the size of addresses
    rows = addresses.select("digest", "shard", "offset", "length").repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    return rows.mapInArrow(run, f"digest binary, shard string, offset long, {columns}")


def metadata(addresses: DataFrame, root: str) -> DataFrame:
    """digest, shard, offset, width, height, bits: from range reads of the headers alone."""
    return _read(addresses, root, "width long, height long, bits long", lambda f, offset, length: read_header(f.read_at(HEADER, offset)))


def _whole(f, offset: int, length: int) -> tuple:
    width, height, _ = read_header(f.read_at(HEADER, offset))  # the metadata first, as metadata() reads it
    media = f.read_at(length, offset)
    payload = decode_image(media)
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), length, hashlib.sha256(media).hexdigest(), width, height, feature(payload, width, height)


def contents(addresses: DataFrame, root: str) -> DataFrame:
    """digest, shard, offset, and what the stored bytes say: digests, sizes and the feature."""
    return _read(addresses, root, "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, feature string", _whole)


def media_columns(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): sizes, digests read back, feature, and the address of its payload."""
    rows, root = store(docs)
    places = materialise(canonical(rows), "media-addresses")
    read = contents(places, root)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "digest").join(read, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset")
