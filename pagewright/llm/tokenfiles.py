"""Token ids in flat binary files with 64-bit document offsets.

Each range of doc_id becomes a shard of four flat little-endian files: `.bin` (ids, unsigned 16-bit where the vocabulary
allows, else 32-bit), `.off` (n + 1 signed 64-bit offsets of the documents, in ids), `.doc` (signed 64-bit doc_id) and
`.nul` (a byte for each document, 1 where its doc_id is null). Texts are encoded where they are; only ids are sorted. A task writes under names of its own and reports them in the manifest, so the files
of lost or doubled attempts are never read. Prefix sums of the shards' totals give each shard its base.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.runtime import filesystem, new_path, slices, staged
from pagewright.llm.tokens import encoder

#: Text bytes of a shard, about.
SHARD_BYTES = 64_000_000


def dtype_of(enc, end_id: int) -> str:
    return "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"


def dealt(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of n shards by which a repartition into n parts puts each shard into a part of its own."""
    number = F.col("id").cast("int")
    found = spark.range(20 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("part")).agg(F.min(number).alias("number")).collect()  # a row a shard
    out = np.arange(n, dtype=np.int32)
    for r in found:
        out[r.part] = r.number
    return out


class TokenShard:
    """A shard's documents by index; files of a local or mounted store are memory-mapped, others read once."""

    def __init__(self, path: str, dtype: str):
        self.tokens, self.offsets, self.doc_ids, self.nulls = (self._flat(path + end, kind) for end, kind in ((".bin", dtype), (".off", "<i8"), (".doc", "<i8"), (".nul", "|b1")))

    @staticmethod
    def _flat(path: str, dtype: str) -> np.ndarray:
        fs, at = filesystem(path)
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(at, dtype, "r") if fs.get_file_info(at).size else np.empty(0, dtype)
        with fs.open_input_file(at) as f:
            return np.frombuffer(f.read(), dtype)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i] : self.offsets[i + 1]]


def write_token_files(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the shards; the manifest (shard, path, dtype, docs, tokens, base), one row per non-empty range of ids.

    Shards ascend by doc_id (nulls first), and so do the documents in a shard; repeated ids stand side by side. A null or
    empty text is its end id alone. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "token-files")
    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Ranges of ids from a scan of sizes and ids: texts are encoded where they are, and ids move once.
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    cuts = kept.approxQuantile("doc_id", [i / shards for i in range(1, shards)], min(0.01, 0.25 / shards)) if shards > 1 else []
    cuts = np.array([int(c) for c in cuts], np.int64)
    deal = dealt(spark, shards)

    def encode(batches):
        enc, at = encoder(path), 0
        dtype = dtype_of(enc, end_id)
        for batch in batches:
            for a, b in slices(batch.column(1).to_pylist()):
                part = batch.slice(a, b - a)
                doc = part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
                low, high = np.searchsorted(cuts, doc, "left"), np.searchsorted(cuts, doc, "right")
                shard = low + (at + np.arange(len(doc))) % (high - low + 1)  # an id that fills several ranges is dealt to all of them
                at += len(doc)
                ids = [np.append(enc.encode(t.as_py()), np.uint32(end_id)).astype(dtype).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(deal[shard]), pa.array(shard.astype(np.int32)), part.column(0), pa.array(ids, pa.binary())], ["deal", "shard", "doc_id", "ids"])

    def write(batches):
        dtype = dtype_of(encoder(path), end_id)
        fs, at = filesystem(folder)
        held = None  # shard, file name, open stream, offsets, ids, nulls

        def close():
            shard, name, out, offsets, docs, nulls = held
            out.close()
            for end, values, kind in ((".off", offsets, "<i8"), (".doc", docs, "<i8"), (".nul", nulls, "|b1")):
                with fs.open_output_stream(f"{at}/{name}{end}") as f:
                    f.write(np.array(values, kind).tobytes())
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "dtype": [dtype], "docs": [len(docs)], "tokens": [offsets[-1]]})

        for batch in batches:
            for shard, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held is None or held[0] != shard:
                    if held:
                        yield close()
                    fs.create_dir(at, recursive=True)
                    name = f"{shard:06d}-{uuid.uuid4().hex}"
                    held = (shard, name, fs.open_output_stream(f"{at}/{name}.bin"), [0], [], [])
                ids = ids.as_py()
                held[2].write(ids)
                held[3].append(held[3][-1] + len(ids) // int(dtype[-1]))
                held[4].append(d or 0)
                held[5].append(d is None)
        if held:
            yield close()

    encoded = kept.mapInArrow(encode, "deal int, shard int, doc_id long, ids binary").repartition(shards, "deal").sortWithinPartitions("shard", "doc_id").select("shard", "doc_id", "ids")
    shards = staged(encoded.mapInArrow(write, "shard int, path string, dtype string, docs long, tokens long"), "token-manifest")
    rows = sorted(shards.collect(), key=lambda r: r.shard)  # a row per shard
    bases = accumulate([0, *(r.tokens for r in rows)])
    return spark.createDataFrame([(*r, b) for r, b in zip(rows, bases, strict=False)], "shard int, path string, dtype string, docs long, tokens long, base long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned,
    of the ids as little-endian unsigned 32-bit integers), shard, index. One task per shard."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = TokenShard(row["path"], row["dtype"])
                crc = [zlib.crc32(shard[i].astype("<u4").tobytes()) for i in range(len(shard))]
                doc = np.array(shard.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=np.array(shard.nulls)), pa.array(row["base"] + shard.offsets[:-1]), pa.array(np.diff(shard.offsets)), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), row["shard"], np.int32)), pa.array(np.arange(len(doc)))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "index"],
                )

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, index long")
