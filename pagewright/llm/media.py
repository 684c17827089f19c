"""Media columns: bytes kept as progressive JPEG files, and decoded to full-resolution RGB tensors.

A payload is stored in the format's own unit, the quantised coefficient: each byte is one coefficient (DC the byte less
128, AC of eight bits in size), which all quantisation by 1 leaves exact, so the scans give back every byte although
samples would not. Decoding writes the tensors to Parquet files in the shared folder and reads them back for the features.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import jpeg
from pagewright.llm.runtime import filesystem, map_batches, new_path, slices, staged

#: Payloads are filled up with bytes 255 to a multiple of this; coefficients in a block and blocks in a 4:2:0 unit.
UNIT, BLOCK, BLOCKS = 576, 64, 6
#: Bytes of tensors in one stored file; a larger tensor has a file of its own.
TENSOR_BYTES = 16_000_000
TENSOR = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
#: A JPEG side has at most this many samples; payloads that need more are refused (about 6 GB).
SIDE = 65_520


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (UNIT - len(data) if len(data) < UNIT else -len(data) % UNIT)


def to_media(payload: bytes, n_bytes: int) -> bytes:
    """A progressive JPEG file whose coefficients are the payload's bytes; the comment holds its two lengths."""
    units = -(-len(payload) // (BLOCK * BLOCKS))
    wide = int(np.ceil(np.sqrt(units)))
    high = -(-units // wide)
    if max(wide, high) * 16 > SIDE:
        raise ValueError("payload too long for one image")
    frame = jpeg.Frame.blank(wide * 16, high * 16)
    full = np.full(wide * high * BLOCKS * BLOCK, 255, np.int16)
    full[: len(payload)] = np.frombuffer(payload, np.uint8)
    full = full.reshape(-1, BLOCK)
    at = 0
    for c in frame.components:
        mine = full[at : at + len(c.coefficients)]
        c.coefficients[:] = np.where(mine > 127, mine, mine - 255)
        c.coefficients[:, 0] = mine[:, 0] - 128
        at += len(c.coefficients)
    frame.comment = struct.pack(">QQ", n_bytes, len(payload))
    return jpeg.encode(frame, dense=True)


def from_media(media: bytes) -> tuple[jpeg.Frame, bytes, int]:
    """The decoded frame, the payload, and its length before filling."""
    frame = jpeg.decode(media)
    n_bytes, length = struct.unpack(">QQ", frame.comment)
    parts = []
    for c in frame.components:
        part = np.where(c.coefficients > 0, c.coefficients, c.coefficients + 255).astype(np.uint8)
        part[:, 0] = c.coefficients[:, 0] + 128
        parts.append(part.ravel())
    return frame, np.concatenate(parts)[:length].tobytes(), n_bytes


def feature(height: int, width: int, data: bytes) -> str:
    """Width, height, and mean and standard deviation of each RGB channel over all pixels of a tensor."""
    x, value = np.frombuffer(data, np.uint8).reshape(-1, 3), np.arange(256)
    counts = np.stack([np.bincount(x[:, i], minlength=256) for i in range(3)])
    mean = (counts * value).sum(1) / len(x)
    sd = np.sqrt(np.maximum((counts * value**2).sum(1) / len(x) - mean**2, 0))
    return f"{width}x{height} " + " ".join(f"{m:.3f}/{s:.3f}" for m, s in zip(mean, sd, strict=True))


def stored_tensors(folder: str, ids: pa.Array, tensors: list[dict], keep: bool) -> tuple[str, pa.Table]:
    """Write tensors to a Parquet file with a name of its own, read it back, and delete it unless it is to be kept."""
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    name = f"{uuid.uuid4().hex}.parquet"
    table = pa.table([ids, *pa.array(tensors, TENSOR).flatten()], names=["doc_id", "height", "width", "data"])
    pq.write_table(table, f"{at}/{name}", compression="zstd", use_dictionary=False, filesystem=fs)
    back = pq.read_table(f"{at}/{name}", filesystem=fs, use_threads=False, pre_buffer=False, partitioning=None)
    if not keep:
        fs.delete_file(f"{at}/{name}")
    return f"{folder}/{name}", back


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media binary): each text's UTF-8 bytes, filled up, as a progressive JPEG, in a table in the shared folder.

    A null or empty text is a payload of 576 bytes 255. Null ids and repeated rows stay row by row; equal texts give equal
    files. An empty table gives an empty table. Other columns are not read.
    """

    def kernel(batch):
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts):
            raw = [(t or "").encode() for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([to_media(padded(x), len(x)) for x in raw], pa.binary())], ["doc_id", "media"])

    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(map_batches(kept, kernel, "doc_id long, media binary"), "media")


def read_media(media: DataFrame, with_tensor: bool = False, folder: str | None = None, keep: bool = False) -> DataFrame:
    """Decode each file: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes,
    media_sha256, feature, tensor_file; and with_tensor the RGB image as struct<height,width,data>, row by row, three
    bytes a pixel.

    Every tensor is stored in a Parquet file (doc_id, height, width, data) in `folder`, by default in the shared folder,
    and the feature comes from what is read back. keep leaves the files, which tensor_file names: only those in the result
    count, as a lost attempt may leave some. Else each is deleted once it has been read, and tensor_file is null.
    """
    folder = folder or new_path(media.sparkSession, "tensors")

    def kernel(batch):
        out: list[list] = []
        held, size = [], 0

        def flush():
            nonlocal size
            if held:
                name, back = stored_tensors(folder, pa.array([h[0] for h in held], pa.int64()), [h[2] for h in held], keep)
                for h, t in zip(held, back.to_pylist(), strict=True):
                    tensor = {k: t[k] for k in ("height", "width", "data")}
                    out.append([h[0], *h[1], feature(**tensor), name if keep else None, tensor if with_tensor else None])
                held.clear()
                size = 0

        for d, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = raw.as_py()
            frame, payload, n_bytes = from_media(raw)
            row = [n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest()]
            held.append((d, row, {"height": frame.height, "width": frame.width, "data": frame.rgb().tobytes()}))
            size += frame.height * frame.width * 3
            if size >= TENSOR_BYTES:
                flush()
        flush()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), TENSOR]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensor_file", "tensor"]
        n = 10 if with_tensor else 9
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(n)], names[:n])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor_file string"
    return map_batches(media, kernel, schema + ", tensor struct<height:int,width:int,data:binary>" * with_tensor)
