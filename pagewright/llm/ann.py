"""Exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are quantised to int8, each with its own scale and the exact norm of what rounding lost. The product of two int8
blocks gives all distances of a tile, right to within the sum of the two lost norms (triangle inequality) and what double
arithmetic loses where the difference of large norms is small. A pair whose lower bound exceeds the query's k-th least
upper bound can be no answer; the others, and all pairs whose bound is not finite, are computed anew from the original
vectors in double precision, and a heap for each query keeps the k nearest. Queries go to the candidates in blocks of
bounded size, one after the other, each block's answers written before the next; candidates never move.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.runtime import new_path, numbered, staged

#: Queries held by a task at once and broadcast in one piece: at most so many, and so many numbers.
QUERY_BLOCK, QUERY_NUMBERS = 8192, 8_000_000
#: Rows of a candidate block and queries of a tile.
CANDIDATE_TILE, QUERY_TILE = 2048, 512
#: Relative error of a norm, product or sum of two in double arithmetic, with a wide margin.
ROUNDING = 2.0**-46


def usable(vector: str):
    """Whether a vector column is not null, holds no null or non-finite component and is not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, and norms of the rounding errors with a margin for double arithmetic.

    Norms are taken of rows divided by their greatest component, so no square overflows or vanishes.
    """
    top = np.abs(x).max(1)
    unit = x / top[:, None]
    q = np.rint(unit * 127).astype(np.int8)
    lost = np.sqrt(((unit - q / 127) ** 2).sum(1)) + 1e-13 * np.sqrt((unit * unit).sum(1))
    return q, top / 127, lost * top


def squares(q: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Squared norms of quantised rows; infinite where they overflow."""
    with np.errstate(over="ignore"):
        return (q.astype(np.int64) ** 2).sum(1) * scale**2


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, squares summed in order, as SQL does; scaled where they overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = x - y
        out = np.sqrt(np.cumsum(d**2, axis=1)[:, -1])
        if (bad := ~np.isfinite(out)).any():
            top = np.abs(d[bad]).max(1)
            out[bad] = top * np.sqrt(((d[bad] / top[:, None]) ** 2).sum(1))
            out[np.isnan(out)] = np.inf
    return out


class QueryBlock:
    """Queries of one dimension, quantised once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.q, self.scale, self.lost = quantise(x)
        # A float product of int8 rows is exact up to 1040 dimensions in single precision.
        self.kind = np.float32 if x.shape[1] <= 1040 else np.float64
        self.f = self.q.astype(self.kind)
        self.norm = squares(self.q, self.scale)

    def search(self, heaps: list[list[tuple[float, int]]], upper: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> int:
        """Merge one candidate tile into the queries' heaps of (-distance, -id); the number of pairs computed anew."""
        q, scale, lost = quantise(x)
        f = q.astype(self.kind).T
        norm = squares(q, scale)
        redone = 0
        for a in range(0, len(self.ids), QUERY_TILE):
            b = min(len(self.ids), a + QUERY_TILE)
            with np.errstate(over="ignore", invalid="ignore"):
                both = self.norm[a:b, None] + norm
                near = both - 2 * (self.scale[a:b, None] * scale) * (self.f[a:b] @ f)
                # what is left of two large sums is right to within some rounding steps of them; denormal ones have none
                loose = np.sqrt(ROUNDING * both + 1e-300)
                near = np.sqrt(np.maximum(near, 0))
                slack = self.lost[a:b, None] + lost + loose
                sound = np.isfinite(near) & np.isfinite(slack)
                low = np.where(sound, near - slack, 0)
                own = self.ids[a:b, None] == ids
                most = np.where(own | ~sound, np.inf, near + slack)
            kth = np.partition(most, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(b - a, np.inf)
            upper[a:b] = np.minimum(upper[a:b], kth)
            rows, cols = np.nonzero(~own & (low <= upper[a:b, None]))
            redone += len(rows)
            for s in range(0, len(rows), 65536):
                r, c = rows[s : s + 65536] + a, cols[s : s + 65536]
                exact = distances(self.x[r], x[c])
                order = np.lexsort((ids[c], exact, r))
                r, c, exact = r[order], c[order], exact[order]
                first = np.concatenate([[True], r[1:] != r[:-1]])
                rank = np.arange(len(r)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                for i, d, v in zip(r[rank < k].tolist(), exact[rank < k].tolist(), ids[c][rank < k].tolist(), strict=True):
                    entry = (-d, -v)
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], entry)
                    elif entry > heaps[i][0]:
                        heapq.heapreplace(heaps[i], entry)
            for i in range(a, b):
                if len(heaps[i]) == k:
                    upper[i] = min(upper[i], -heaps[i][0][0])
        return redone


def query_blocks(queries: DataFrame):
    """Blocks of queries by dimension and id, each read on its own: the driver holds one at a time.

    Queries are sorted by range, their places come from prefix sums of the ranges' sizes, and a block is a span of places.
    """
    rows = staged(numbered(queries, "dim", "id"), "ann-query-places")
    done = 0
    for r in sorted(queries.groupBy("dim").count().collect()):  # a row per dimension
        size = max(1, min(QUERY_BLOCK, QUERY_NUMBERS // r.dim))
        for a in range(done, done + r["count"], size):
            part = rows.where((F.col("rank") > a) & (F.col("rank") <= min(a + size, done + r["count"]))).select("id", "vector").toArrow()
            yield QueryBlock(part["id"].to_numpy(), np.stack(part["vector"].to_numpy()).astype(np.float64))
        done += r["count"]


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k nearest rows of every query, by Euclidean distance.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part; vectors
    of other dimensions are no candidates. A row is never its own query's candidate, nor are rows of the same id. Repeated
    rows are candidates each; queries of one id and dimension ask once, with the least of their vectors. Ties go to the smaller id; fewer than k candidates give fewer rows. No query
    gives no row. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("vector")).withColumn("dim", F.size("vector"))
    queries = staged(rows.where("asks").groupBy("id", "dim").agg(F.min("vector").alias("vector")), "ann-queries")
    path, found = new_path(spark, "ann-nearest"), 0
    for block in query_blocks(queries):
        found += len(block.ids)
        shared = spark.sparkContext.broadcast(block)  # at most QUERY_NUMBERS numbers

        def scan(batches, shared=shared):
            own = shared.value
            heaps, upper = [[] for _ in own.ids], np.full(len(own.ids), np.inf)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
                for s in range(0, len(ids), CANDIDATE_TILE):
                    own.search(heaps, upper, ids[s : s + CANDIDATE_TILE], x[s : s + CANDIDATE_TILE], k)
            out = [(q, -v, -d) for q, h in zip(own.ids.tolist(), heaps, strict=True) for d, v in h]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        # k rows a query and task: what remains is a bounded merge, cut down before and after the shuffle.
        part = rows.where(F.col("dim") == block.x.shape[1]).select("id", "vector").mapInArrow(scan, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        best = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best.write.mode("append").option("compression", "zstd").parquet(path)
        shared.destroy()
    schema = "query_id long, rank int, vec_id long, score double"
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)
