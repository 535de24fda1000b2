"""Media columns: payloads in tar shards under their digest, rows with digest, offset and length, metadata by header-only range reads.

Each task writes the images of its rows to shards of its own in the shared folder, one copy of equal payloads for a task, and returns
references; those are written as a table before anything reads them, so a task that runs again leaves at most a shard that no row names.
`catalog` gives one place for each digest. Payloads are stored as RGB images of 64 x 3 = 192 bytes a row in PNG, which is lossless.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.folders import work_folder, written
from tessera.llm.common import text_bytes

WIDTH, ROW, FILL = 64, 192, b" "
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a stored image that hold its size and sample format.
HEADER = 33
SHARD_BYTES = 256 << 20
#: Stretches of a shard that go to one task whole, and stored bytes that a task reads in about.
READ_CELL, TASK_BYTES = 4 << 20, 16 << 20
REFERENCE_TYPE = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def padded(raw: bytes) -> bytes:
    """raw with bytes 32 up to a positive multiple of 192."""
    return raw + FILL * (-len(raw) % ROW or (0 if raw else ROW))


def to_png(payload: bytes) -> bytes:
    """The payload as an 8-bit RGB image, one filter-free row for each 192 bytes."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0)
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits a sample and samples a pixel from an image's first 33 bytes."""
    if head[:8] != SIGNATURE or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    return width, height, bits, {0: 1, 2: 3, 4: 2, 6: 4}[colour]


def from_png(data: bytes) -> bytes:
    """The payload of an image that to_png made; checks each part's sum."""
    at, packed = len(SIGNATURE), []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, ROW + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Average hash over 64 bands of the payload (16 hex digits), then the mean and the deviation of all samples in hundredths."""
    x = np.frombuffer(payload, np.uint8)
    edges = len(x) * np.arange(65) // 64
    sums = np.add.reduceat(x, edges[:-1], dtype=np.int64)
    counts = sum(np.bincount(x[i : i + READ_CELL], minlength=256) for i in range(0, len(x), READ_CELL))
    total, squares = int(sums.sum()), int((counts * np.arange(256) ** 2).sum())
    bands = sums * len(x) > total * np.diff(edges)
    mean = total * 100 // len(x)
    spread = max(0, squares * len(x) - total**2) ** 0.5 * 100 // len(x)
    return f"{int.from_bytes(np.packbits(bands).tobytes(), 'big'):016x}-{mean}-{int(spread)}"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _store(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        shard, out, at, seen = "", None, 0, {}

        def close() -> None:
            if out is not None:
                out.write(bytes(2 * tarfile.BLOCKSIZE))
                out.close()

        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                payload = padded(raw)
                key = hashlib.sha256(payload).digest()
                if key not in seen:
                    image = to_png(payload)
                    if out is None or at > SHARD_BYTES:
                        close()
                        shard, at = f"{uuid.uuid4().hex}.tar", 0
                        out = store.open_output_stream(f"{path}/{shard}")
                    info = tarfile.TarInfo(f"{key.hex()[:2]}/{key.hex()}.png")
                    info.size = len(image)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head)
                    out.write(image)
                    out.write(bytes(-len(image) % tarfile.BLOCKSIZE))
                    seen[key] = (shard, at + len(head), len(image))
                    at += len(head) + len(image) + -len(image) % tarfile.BLOCKSIZE
                rows.append((doc, len(raw), key.hex(), *seen[key]))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[i], pa.string() if i in (2, 3) else pa.int64()) for i in range(6)], names=[x.split()[0] for x in REFERENCE_TYPE.split(", ")])
        close()

    return run


def _read(folder: str, full: bool):
    """Rows of references with what their media say; media of consecutive rows with the same place are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        name, file, place, found = None, None, None, ()
        for batch in batches:
            rows = []
            for doc, n, digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
                if (shard, offset) != place:
                    if shard != name:
                        if file is not None:
                            file.close()
                        name, file = shard, store.open_input_file(f"{path}/{shard}")
                    found = png_header(file.read_at(min(HEADER, length), offset))
                    if full:
                        image = file.read_at(length, offset)
                        payload = from_png(image)
                        own = hashlib.sha256(payload).hexdigest()
                        if own != digest:
                            raise ValueError(f"{shard} at {offset} holds other bytes than its digest says")
                        found += (len(payload), own, zlib.crc32(payload[-16:]), length, hashlib.sha256(image).hexdigest(), feature(payload))
                    place = (shard, offset)
                rows.append((doc, n, digest, shard, offset, length, *found))
            if rows:
                fields = [x.split() for x in (_read_type(full)).split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f[0] for f in fields])
        if file is not None:
            file.close()

    return run


def _read_type(full: bool) -> str:
    return REFERENCE_TYPE + ", width int, height int, bits int, channels int" + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" * full


def store(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes every row's payload to shards in folder and returns references: doc_id, n_bytes, digest, shard, offset, length.

    Null and empty texts are one row of blanks. Repeated rows refer to the same stored payload within a task. The references are a
    written table beside the shards.
    """
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    return written(raw.mapInArrow(_store(f"{folder}/shards"), REFERENCE_TYPE), f"{folder}/references")


def _near(references: DataFrame) -> DataFrame:
    """Rows by shard and place, so that each task reads stretches of a few shards: as many tasks as the media's bytes ask for."""
    stored = catalog(references).agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-stored // TASK_BYTES))
    return references.repartition(tasks, "shard", F.floor(F.col("offset") / READ_CELL)).sortWithinPartitions("shard", "offset")


def metadata(references: DataFrame, folder: str) -> DataFrame:
    """References with width, height, bits and channels, from 33 bytes of each medium."""
    return _near(references).mapInArrow(_read(f"{folder}/shards", False), _read_type(False))


def described(references: DataFrame, folder: str) -> DataFrame:
    """As metadata, and digests, sizes and features of the bytes read back whole; fails if they are not what the digest says."""
    return _near(references).mapInArrow(_read(f"{folder}/shards", True), _read_type(True))


def catalog(references: DataFrame) -> DataFrame:
    """digest, shard, offset, length: the first place of each digest."""
    return references.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.shard", "p.offset", "p.length")


def media_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """store and described in a new folder under spark.checkpoint.dir; one row for each row of docs, other columns not looked at."""
    folder = work_folder(docs.sparkSession, "media")
    out = described(store(docs, folder, text, doc_id), folder)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height", "bits", "channels")
