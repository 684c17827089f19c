"""Line deduplication by a distributed suffix array over line ids.

Lines get ids by their order; prefix doubling then ranks every position by the 2, 4, 8, ... lines that start there: each
round sorts the distinct pairs of ranks that occur more than once and numbers them by prefix sums over the sorted ranges.
Positions whose 2^k lines occur only once leave the doubling; it ends when none is left or 2^k lines must hold more than
LEAST_WORDS words. Positions of equal rank are an LCP interval of 2^k lines; an interval of any depth m is named by two
overlapping ranks, (rank at i, rank at i + m - 2^k).

A run of lines counts from LEAST_WORDS words on, over however many lines, and a line of any length from OFTEN occurrences in
the table on (boilerplate). Every such run is the union of its shortest parts of that many words, at each of its lines
forwards or backwards. In each part's interval the first occurrence, by doc_id and line, stays, and later copies are
deleted. Parts whose copies lie at one distance in one document join to that pair's maximal common run, whose length is
their longest common prefix; adjoining deletions of a document are its deleted runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.llm.runtime import FEW, broadcast_if_small, drop_staged, map_batches, numbered, slices, staged

#: A repeated run counts from so many words on; a line from so many occurrences on, whatever its length.
LEAST_WORDS, OFTEN = 25, 8
DELETED = "array<struct<start:int,length:int>>"
COPIES = "array<struct<start:int,length:int,doc:bigint,line:int>>"
PLACE = ("doc", "version", "line")


def text_lines(text: str | None) -> list[bytes]:
    """Lines without their ASCII white space at both ends; blank ones are b''."""
    return [x.strip() for x in text.encode().split(b"\n")] if text else []


def words_of(line: bytes) -> int:
    """Words by white space, of which a long one counts once more for every twelve bytes (scripts without spaces)."""
    return sum(1 + len(w) // 12 for w in line.split())


def version_of(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode()) >> 1


def positions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, line, key, words) of each line that is not blank; lines are numbered without the blank ones."""

    def kernel(batch):
        docs, versions, lines, keys, words = [], [], [], [], []
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            found = [x for x in text_lines(text) if x]
            docs += [d] * len(found)
            versions += [version_of(text)] * len(found)
            lines += range(len(found))
            keys += [hashlib.blake2b(x, digest_size=16).digest() for x in found]
            words += map(words_of, found)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(versions, pa.int64()), pa.array(lines, pa.int32()), pa.array(keys, pa.binary()), pa.array(words, pa.int32())], ["doc", "version", "line", "key", "words"])

    kept = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    return map_batches(kept, kernel, "doc long, version long, line int, key binary, words int")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from batches that are sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        last = np.ones(rows.num_rows, bool)
        for k in keys:
            v = rows[k].to_numpy()
            last &= v == v[-1]
        cut = rows.num_rows - int(last[::-1].argmin()) if not last.all() else 0
        rest = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut).combine_chunks()
    if rest is not None:
        yield rest.combine_chunks()


def ranks(lines: DataFrame, depth: int, often: int | None = None) -> DataFrame:
    """(doc, version, line, words, often, r0, r1, ...) of the positions whose line occurs again; rk ranks them by 2^k lines.

    rk is null where these lines occur once or fewer than 2^k lines follow on each other. often: the line occurs at least
    so many times.
    """
    repeated = lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    named = staged(numbered(repeated, "key"), "line-ids")
    flag = (F.col("n") >= often) if often else F.lit(False)
    at = staged(lines.join(broadcast_if_small(named), "key").select(*PLACE, "words", flag.alias("often"), F.col("rank").alias("r0")), "positions")
    k = 0
    while 2 << k <= depth:
        ahead = Window.partitionBy("doc", "version").orderBy("line").rangeBetween(1 << k, 1 << k)
        pairs = staged(at.select("*", F.col(f"r{k}").alias("a"), F.first(f"r{k}").over(ahead).alias("b")), "pairs")
        again = pairs.where("a is not null and b is not null").groupBy("a", "b").count().where("count > 1").select("a", "b")
        order = staged(numbered(again, "a", "b"), "pair-ids")
        if not order.head(1):
            drop_staged(pairs, order)
            break
        before, k = at, k + 1
        named = pairs.where("a is not null and b is not null").join(broadcast_if_small(order), ["a", "b"], "left").select(*before.columns, F.col("rank").alias(f"r{k}"))
        at = staged(named.unionByName(pairs.where("a is null or b is null").select(*before.columns, F.lit(None).cast("long").alias(f"r{k}"))), "positions")
        drop_staged(before, pairs, order)
    return at


def parts(rows: pa.Table, least: int) -> pa.RecordBatch | None:
    """The parts of one document's repeated lines that occur again: (m, a, b, doc, version, line).

    A part is a shortest run of at least `least` words, from each line forwards and backwards, or a single frequent line.
    """
    doc, version, line, words, often = (rows[c].to_numpy(zero_copy_only=False) for c in ("doc", "version", "line", "words", "often"))
    r = np.stack([rows[c].fill_null(0).to_numpy() for c in rows.column_names if c[0] == "r" and c[1:].isdigit()])
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (line[1:] != line[:-1])])
    doc, version, line, often, r = doc[fresh], version[fresh], line[fresh], often[fresh], r[:, fresh]  # repeated rows of a document are one
    words = words[fresh].astype(np.int64)
    n = len(doc)
    starts = np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (line[1:] != line[:-1] + 1)])
    begin = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    end = np.append(np.flatnonzero(starts)[1:], n)[np.cumsum(starts) - 1] - 1
    upto = np.cumsum(words)
    before = upto - words
    i = np.arange(n)
    last = np.searchsorted(upto, before + least, "left")
    first = np.searchsorted(before, upto - least, "right") - 1
    forwards, backwards = last <= end, first >= begin
    s = np.concatenate([i[forwards], first[backwards], i[often]])
    m = np.concatenate([last[forwards] - i[forwards], i[backwards] - first[backwards], np.zeros(int(often.sum()), np.int64)]) + 1
    k = np.floor(np.log2(m)).astype(int)
    s, m, k = (x[k < len(r)] for x in (s, m, k))  # a longer part has a piece that occurs once
    a, b = r[k, s], r[k, s + m - (1 << k)]
    again = (a > 0) & (b > 0)
    if not again.any():
        return None
    s, m, a, b = np.unique(np.stack([s[again], m[again], a[again], b[again]]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(a), pa.array(b), pa.array(doc[s]), pa.array(version[s]), pa.array(line[s])], ["m", "a", "b", *PLACE])


def _joined(group: np.ndarray, start: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and ends of the runs that overlapping or adjoining spans of one group make; rows are sorted by both."""
    wide = int(start.max()) + int(m.max()) + 2
    shift = group.astype(np.int64) * wide
    reach = np.maximum.accumulate(start + m + shift)
    fresh = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    runs = np.flatnonzero(fresh)
    return runs, reach[np.append(runs[1:], len(start)) - 1] - shift[runs]


def merged(rows: pa.Table) -> pa.RecordBatch:
    """(doc, version, starts, ends, copies): the deleted runs of each document, and its maximal runs in common with an
    earlier place each (start, length, doc, line)."""
    doc, version, line, m, kdoc, kversion, kline = (rows[c].to_numpy() for c in ("doc", "version", "line", "m", "kdoc", "kversion", "kline"))
    line, kline = line.astype(np.int64), kline.astype(np.int64)
    new_doc = np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])])
    number = np.cumsum(new_doc) - 1
    runs, ends = _joined(number, line, m)
    lists = lambda owner, x: pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(number[-1] + 2)).astype(np.int32)), x)
    order = np.lexsort((line, line - kline, kversion, kdoc, number))
    same = np.stack([number, kdoc, kversion, line - kline])[:, order]
    pair = np.cumsum(np.concatenate([[True], (same[:, 1:] != same[:, :-1]).any(0)])) - 1
    first, end = _joined(pair, line[order], m[order])
    at = order[first]
    copies = pa.StructArray.from_arrays([pa.array(line[at].astype(np.int32)), pa.array((end - line[at]).astype(np.int32)), pa.array(kdoc[at]), pa.array(kline[at].astype(np.int32))], ["start", "length", "doc", "line"])
    return pa.RecordBatch.from_arrays([pa.array(doc[new_doc]), pa.array(version[new_doc]), lists(number[runs], pa.array(line[runs].astype(np.int32))), lists(number[runs], pa.array(ends.astype(np.int32))), lists(number[at], copies)], ["doc", "version", "starts", "ends", "copies"])


def _line_count(text):
    """Lines of a text column that are not blank; null and empty texts have none."""
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, r"[ \t\r\x0b\f]+", "")) > 0)), F.lit(0))


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, often: int | None = OFTEN) -> DataFrame:
    """(doc, version, starts, ends, copies): for each document with later copies, the runs of its non-blank lines to delete,
    and the maximal runs that it shares with an earlier place: array<struct<start,length,doc,line>>."""
    lines = staged(positions(df, id_col, text_col), "lines")
    at = ranks(lines, least_words, often)
    columns = [c for c in at.columns if c[0] == "r" and c[1:].isdigit()]
    found = at.select(*PLACE, "words", "often", *columns).repartition("doc", "version").sortWithinPartitions(*PLACE)
    found = found.mapInArrow(lambda batches: (x for rows in whole_groups(batches, PLACE[:2]) if (x := parts(rows, least_words)) is not None), "m int, a long, b long, doc long, version long, line int")
    found = staged(found, "parts")
    key = ["m", "a", "b"]
    firsts = staged(found.groupBy(*key).agg(F.min(F.struct(*PLACE)).alias("kept"), F.max(F.struct(*PLACE)).alias("last")).where("kept <> last").select(*key, "kept"), "first-copies")
    later = found.join(broadcast_if_small(firsts), key).where(F.struct(*PLACE) != F.col("kept")).select(*PLACE, "m", *(F.col(f"kept.{c}").alias("k" + c) for c in PLACE))
    out = later.repartition("doc", "version").sortWithinPartitions(*PLACE)
    out = staged(out.mapInArrow(lambda batches: map(merged, whole_groups(batches, PLACE[:2])), f"doc long, version long, starts array<int>, ends array<int>, copies {COPIES}"), "repeated-runs")
    drop_staged(lines, at, found, firsts)
    return out


def without_runs(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int, list[dict]]:
    """The text without its deleted lines, its non-blank lines, how many were deleted, and the runs."""
    lines = text_lines(text)
    mine = next((r for r in runs or () if r["version"] == version_of(text)), None)
    total = sum(map(bool, lines))
    if mine is None:
        return text, total, 0, []
    gone = np.zeros(total + 1, np.int64)
    for a, b in zip(mine["starts"], mine["ends"], strict=True):
        gone[a:b] = 1
    kept, at = [], 0
    for raw, line in zip(text.split("\n"), lines, strict=True):
        if not line or not gone[at]:
            kept.append(raw)
        at += bool(line)
    return "\n".join(kept), total, int(gone.sum()), [{"start": a, "length": b - a} for a, b in zip(mine["starts"], mine["ends"], strict=True)]


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, often: int | None = OFTEN) -> DataFrame:
    """df with two new columns: `_runs_deleted` (array<struct<start,length>> over non-blank lines, from 0) and
    `_lines` (their number), and the text column without the later copies of repeated line runs.

    A run counts from least_words words on, a single line also from `often` occurrences on (None: never for that reason).
    Lines count as equal without ASCII white space at their ends; blank lines neither match nor part a run, and stay. The
    first copy, by id and line, stays, also within one document. A null text stays null, an empty one empty. Rows of one
    id and text are one document and all lose the same lines; rows of one id with different texts are documents in the
    order of a hash. Rows without id take no part and stay as they are. An empty table gives an empty table. Columns of
    df that have the names of the new ones are replaced; others pass through.
    """
    df = df.drop("_runs_deleted", "_lines")
    doc, held = ("_" * (1 + max(map(len, df.columns))) + c for c in "dr")  # longer than any name of df
    runs = repeated_runs(df, id_col, text_col, least_words, often).groupBy("doc").agg(F.collect_list(F.struct("version", "starts", "ends")).alias(held))
    size = runs.select(F.count("*"), F.sum(F.aggregate(held, F.lit(0), lambda n, r: n + F.size(r["starts"])))).first()
    runs = runs.withColumnRenamed("doc", doc)
    joined = df.join(F.broadcast(runs) if size[0] <= FEW and (size[1] or 0) <= 5 * FEW else runs, F.col(id_col).cast("long") == F.col(doc), "left")

    # Only documents with deletions go through Python, text by text; the others stay in the JVM.
    plain = joined.where(F.col(held).isNull()).select(*df.columns, F.lit(None).cast(DELETED).alias("_runs_deleted"), _line_count(F.col(text_col)).alias("_lines"))
    found = joined.where(F.col(held).isNotNull()).select(*df.columns, held)
    schema = StructType([*df.schema.fields, *plain.schema.fields[-2:]])

    def edit(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for a, b in slices([None] * batch.num_rows if not batch.num_rows else batch.column(at).to_pylist()):
                part = batch.slice(a, b - a)
                done = [without_runs(t, r) for t, r in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)]
                columns = [*part.columns[:-1]]
                columns[at] = pa.array([d[0] for d in done], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([d[3] or None for d in done], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array([d[1] for d in done], pa.int32())], names=[f.name for f in schema.fields])

    return plain.unionByName(found.mapInArrow(edit, schema)).withColumn("_runs_deleted", F.coalesce("_runs_deleted", F.array().cast(DELETED)))
