"""Content-addressed payloads in tar shards.

Every task writes the media of its rows into one tar shard in the shared folder, each distinct payload once, named by
its SHA-256. The index row of a document has digest, shard, offset and length, and is written as a table before
anything is read back, so a lost executor never leads to a second set of shards behind rows already in use; shards of
tasks that failed are orphans that no row points to. Metadata columns come from range reads of the media's headers.

Payloads here are a text's UTF-8 bytes with zeros up to a positive multiple of 64, stored as PNG images of 8-bit grey
samples, 64 to a row, so the stored form is lossless and compressed.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import only, partitions, shared_dir, written

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # the signature and the whole IHDR chunk
LEVEL = 4


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """The payload as grey samples, WIDTH to a row, no row filtered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the start of a PNG image")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an image of encode_png, rows by columns."""
    width, height, depth, colour = read_header(data[:HEADER])
    at, packed = HEADER, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if depth != 8 or colour or raw[:, 0].any():
        raise ValueError("only unfiltered grey images of 8 bits are stored here")
    return raw[:, 1:]


def feature(samples: np.ndarray) -> str:
    """64 bits that say which cells of an 8 x 8 grid are brighter than the mean, and per mille of samples by 16 levels."""
    height = len(samples)
    sums = np.zeros((height + 1, 8), np.int64)
    np.cumsum(samples.reshape(height, 8, -1).sum(axis=2, dtype=np.int64), axis=0, out=sums[1:])
    edges = np.arange(9) * height // 8
    cells, sizes = sums[edges[1:]] - sums[edges[:-1]], np.diff(edges) * (WIDTH // 8)
    bright = cells * samples.size > sizes[:, None] * int(sums[-1].sum())
    bits = int.from_bytes(np.packbits(bright).tobytes(), "big")
    levels = np.bincount((samples >> 4).ravel(), minlength=16) * 1000 // samples.size
    return f"{bits:016x}:" + ",".join(map(str, levels.tolist()))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


INDEX = "doc_id long, n_bytes long, payload_bytes long, digest string, media_sha256 string, shard string, offset long, length long"


def _store(folder: str):
    def store(batches):
        filesystem, path = _open(folder)
        name, stream, at = f"{uuid.uuid4().hex}.tar", None, 0
        known: dict[bytes, tuple] = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                payload = payload_of(text or "")
                digest = hashlib.sha256(payload)
                place = known.get(digest.digest())
                if place is None:
                    if stream is None:
                        filesystem.create_dir(path, recursive=True)
                        stream = filesystem.open_output_stream(f"{path}/{name}")
                    media = encode_png(payload)
                    info = tarfile.TarInfo(f"{digest.hexdigest()}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    stream.write(head + media + bytes(-len(media) % tarfile.BLOCKSIZE))
                    place = known[digest.digest()] = (hashlib.sha256(media).hexdigest(), at + len(head), len(media))
                    at += len(head) + len(media) + (-len(media) % tarfile.BLOCKSIZE)
                rows.append((doc, len((text or "").encode()), len(payload), digest.hexdigest(), place[0], name, place[1], place[2]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in INDEX.split(", ")])
        if stream is not None:
            stream.write(bytes(2 * tarfile.BLOCKSIZE))
            stream.close()

    return store


class RangeReader:
    """Reads ranges of shards; neighbouring ones share one request of up to a window's bytes."""

    def __init__(self, folder: str, window: int):
        self.filesystem, self.path = _open(folder)
        self.window, self.files = window, OrderedDict()
        self.shard, self.begin, self.data = "", 0, b""

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard or offset < self.begin or offset + length > self.begin + len(self.data):
            if shard not in self.files:
                if len(self.files) >= 16:
                    self.files.popitem(last=False)[1].close()
                self.files[shard] = self.filesystem.open_input_file(f"{self.path}/{shard}")
            self.shard, self.begin = shard, offset
            self.data = self.files[shard].read_at(max(length, self.window), offset)
        found = self.data[offset - self.begin : offset - self.begin + length]
        if len(found) != length:
            raise EOFError(f"{shard} ends before {offset + length}")
        return found


def stored(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes the shards of docs (doc_id, text) and the index; the index, and the folder that its shards are in.

    Null texts count as empty, and an empty text is one row of zeros. Repeated rows have an index row each, and point
    to one place if they are in one shard. An empty table has no shards. Other columns are ignored.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/loomline/shards-{uuid.uuid4().hex}"
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(docs.mapInArrow(_store(folder), INDEX), "media"), folder


def _in_place(index: DataFrame) -> DataFrame:
    return index.repartition(partitions(index.sparkSession), "shard", F.floor(F.col("offset") / (32 << 20))).sortWithinPartitions("shard", "offset")


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height, bit_depth and colour_type, by reads of HEADER bytes of each medium alone."""
    names = ["width", "height", "bit_depth", "colour_type"]

    def run(batches):
        reader = RangeReader(folder, 0)
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset")), strict=True)
            found = list(zip(*(read_header(reader.read(s, o, HEADER)) for s, o in places), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, pa.int32()) for f in found)], [*batch.schema.names, *names])

    return _in_place(index).mapInArrow(run, INDEX + "".join(f", {n} int" for n in names))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(index: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes of every index row say when read back: digests of payload and stored form, the CRC of the
    payload's last 64 bytes, and the feature of its samples. A payload that isn't what its digest says is an error.
    Columns that the index has beside its own (as of with_metadata) come after these."""
    known = {f.split()[0] for f in INDEX.split(", ")}
    more = [f for f in index.schema if f.name not in known]
    names = [f.name for f in more]

    def run(batches):
        reader, last, values = RangeReader(folder, 1 << 20), None, ()
        for batch in batches:
            rows = []
            for doc, n, digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "digest", "shard", "offset", "length")), strict=True):
                if (shard, offset) != last:
                    media = reader.read(shard, offset, length)
                    samples = decode_png(media)
                    payload = samples.tobytes()
                    values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
                    last = (shard, offset)
                if values[1] != digest:
                    raise ValueError(f"{shard} at {offset} isn't {digest}")
                rows.append((doc, n, *values))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [*(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), *(batch.column(name) for name in names)]
            yield pa.RecordBatch.from_arrays(columns, [*(f.split()[0] for f in FEATURES.split(", ")), *names])

    return _in_place(index).mapInArrow(run, FEATURES + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more))
