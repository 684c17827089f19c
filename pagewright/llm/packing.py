"""Packing by concatenation and cutting.

Pass 1 encodes each partition in its own order and stores, with each document, the tokens before it in the partition.
The partitions' totals (one number each) give every partition its global base by a prefix sum. Pass 2 is a narrow map
over the stored ids: base plus local start is a document's place in the one endless concatenation, which windows of
fixed length cut. Nothing is shuffled, and no partition waits for another.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.runtime import slices, staged
from pagewright.llm.tokens import encoder


def encoded(df: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pass 1: (part, before, doc_id, n, ids binary of little-endian unsigned 32-bit), written to the shared folder."""

    def run(batches):
        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = [np.append(enc.encode(t), np.uint32(end_id)).astype("<u4") for t in texts[a:b]]
                n = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part, np.int32)), pa.array(starts), batch.column(0).slice(a, b - a), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["part", "before", "doc_id", "n", "ids"],
                )
            pa.default_memory_pool().release_unused()

    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(kept.mapInArrow(run, "part int, before long, doc_id long, n long, ids binary"), "packing-ids")


def pack(df: DataFrame, path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), doc_tokens, sequence_id, offset, boundary (its sequence holds more than one partition's
    documents), and with_ids the ids themselves.

    Every document ends with end_id and so has a piece, also where its text is null or empty. All sequences but the last
    are full. Null ids and repeated rows are packed row by row. A document longer than a sequence goes over several. An
    empty table gives no piece. Other columns are not read.
    """
    ids = encoded(df, path, end_id, id_col, text_col)
    totals = {r.part: r.total for r in ids.groupBy("part").agg(F.sum("n").alias("total")).collect()}  # a number per partition
    parts = sorted(totals)
    base = dict(zip(parts, accumulate([0, *(totals[p] for p in parts)]), strict=False))
    borders = np.array(sorted(base.values()), np.int64)
    full = sum(totals.values())

    def cut(batches):
        for batch in batches:
            part, before, doc, n, raw = (batch.column(i) for i in range(5))
            out: list[list] = [[] for _ in range(9)]
            for p, at, d, size, data in zip(part.to_pylist(), before.to_pylist(), doc.to_pylist(), n.to_pylist(), raw, strict=True):
                data = memoryview(data.as_buffer())
                begin = base[p] + at
                lo = begin
                while lo < begin + size:
                    seq = lo // length
                    hi = min(begin + size, (seq + 1) * length)
                    piece = data[4 * (lo - begin) : 4 * (hi - begin)]
                    inside = np.searchsorted(borders, seq * length, "right") < np.searchsorted(borders, min(full, (seq + 1) * length), "left")
                    for column, v in zip(out, (d, lo - begin, hi - lo, zlib.crc32(piece), size, seq, lo - seq * length, bool(inside), np.frombuffer(piece, "<u4").astype(np.int64) if with_ids else None), strict=True):
                        column.append(v)
                    lo = hi
            kinds = [pa.int64()] * 7 + [pa.bool_(), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 9 if with_ids else 8], names[: 9 if with_ids else 8])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean" + ", ids array<long>" * with_ids
    return ids.select("part", "before", "doc_id", "n", "ids").mapInArrow(cut, schema)
