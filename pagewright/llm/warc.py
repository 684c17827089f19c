"""Web archives: WARC files of pages, and their index by external merging.

Writers put each page into gzipped WARC records; equal payloads are stored once and revisited. Readers go through each
archive and write its captures as a run, sorted by URL key, timestamp and page. Sampled keys cut the key space into
ranges, and for each range a loser tree merges the slices of all runs. A key that holds a third of all captures is cut
like any other, since the ranges' borders hold timestamp and page as well.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.runtime import filesystem, new_path, staged

#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 100
#: An archive is closed beyond so many compressed bytes or records; so a run is sorted within a task's memory.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 20_000
#: Captures of a block of a run, runs that one merge takes, captures a final range should hold, keys sampled for borders.
BLOCK, FAN_IN, RANGE, SAMPLED = 500, 512, 40_000, 20_000
#: Rows up to which the table of repeated payloads is broadcast (about 100 bytes each).
FEW = 200_000
#: Pages have no time of their own: page n counts as captured n seconds after this.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, without scheme, www., fragment and case; "-" for a null url."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        rest = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    except ValueError:
        host, rest = "", url
    return quote(",".join(reversed(host.split("."))) + ")" + rest.lower(), safe="%/:=&?~#+!$,;'@()*[]") or "-"


def captured(page_id: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page_id or 0) % (10**10))


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, first: int | None) -> bytes:
    """One gzipped WARC record; a revisit has no payload and names its response."""
    body = HTTP + payload if kind == "response" else HTTP
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>",
        f"WARC-Date: {captured(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def members(read: Callable[[int], bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream, one at a time."""
    at, data = 0, read(1 << 20)
    while data:
        inflate, out, used = zlib.decompressobj(31), [], 0
        while True:
            out.append(inflate.decompress(data))
            if inflate.eof:
                used += len(data) - len(inflate.unused_data)
                data = inflate.unused_data or read(1 << 20)
                break
            used += len(data)
            if not (data := read(1 << 20)):
                raise ValueError("archive ends within a record")
        yield at, used, b"".join(out)
        at += used


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and content of a WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write WARC files; a row (path, records, bytes) for each.

    A null html is an empty payload. Of records with equal payloads of at least LEAST_REVISIT bytes the one with the least
    id is the response (all rows of that id, if it is repeated), the others revisit it; rows without id are always
    responses. An empty table gives no archive. Other columns are not read.
    """
    folder = new_path(pages.sparkSession, "archives")
    html = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload"))
    firsts = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    firsts = staged(firsts, "repeated-payloads")
    joined = rows.join(F.broadcast(firsts) if firsts.count() <= FEW else firsts, "digest", "left").select("page_id", "url", "payload", "digest", "size", "first")

    def write(batches):
        fs, at = filesystem(folder)
        stream, path, records, size, done = None, "", 0, 0, []
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            for page_id, url, payload, digest, length, first in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2], cols[3].to_pylist(), cols[4].to_pylist(), cols[5].to_pylist(), strict=True):
                if stream is None:
                    fs.create_dir(at, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    stream, path, records, size = fs.open_output_stream(f"{at}/{name}", compression=None), f"{folder}/{name}", 0, 0
                kind = "response" if first is None or page_id is None or page_id == first else "revisit"
                raw = record(kind, page_id, url, digest, length, payload.as_py() if kind == "response" else b"", first)
                stream.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= ARCHIVE_BYTES or records >= ARCHIVE_RECORDS:
                    stream.close()
                    done.append((path, records, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]})

    return staged(joined.mapInArrow(write, "path string, records long, bytes long"), "archive-manifest")


class RunWriter:
    """A sorted run: gzipped blocks of lines; remembers the first line and place of each block."""

    def __init__(self, folder: str):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.cdxj.gz"
        self.path, self.stream = f"{folder}/{name}", fs.open_output_stream(f"{at}/{name}", compression=None)
        self.keys, self.ends, self.held, self.records = [], [0], [], 0

    def add(self, line: bytes) -> None:
        self.held.append(line)
        self.records += 1
        if len(self.held) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.held:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = packer.compress(b"\n".join(self.held)) + packer.flush()
            self.stream.write(raw)
            self.keys.append(self.held[0].split(b"\t")[0].decode())
            self.ends.append(self.ends[-1] + len(raw))
            self.held = []

    def close(self) -> pa.RecordBatch:
        self.flush()
        self.stream.close()
        return pa.RecordBatch.from_pydict({"path": [self.path], "records": [self.records], "keys": [self.keys], "ends": [self.ends]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("keys", pa.list_(pa.string())), ("ends", pa.list_(pa.int64()))]))


RUN_SCHEMA = "path string, records long, keys array<string>, ends array<long>"


def index_archives(archives: DataFrame) -> DataFrame:
    """Read every archive back and write its captures as a sorted run; payload sizes and digests are taken from the
    stored payloads, for revisits from their headers. One task per archive."""
    folder = new_path(archives.sparkSession, "runs")

    def index(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = filesystem(row["path"])
                lines = []
                with fs.open_input_stream(at, compression=None) as f:
                    for offset, length, raw in members(f.read):
                        fields, content = parse(raw)
                        kind, page = fields["warc-type"], fields["warc-record-id"][10:-1]
                        payload = content.partition(b"\r\n\r\n")[2]
                        stamp = fields["warc-date"].translate({ord(c): None for c in "-:TZ"})
                        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and "sha256:" + digest != fields["warc-payload-digest"]:
                            raise ValueError(f"damaged record at {offset} of {row['path']}")
                        info = {"page": page, "kind": kind, "bytes": len(payload) if kind == "response" else int(fields["warc-payload-length"]), "digest": digest, "first": fields.get("warc-refers-to", "")[10:-1], "file": row["path"].rpartition("/")[2], "offset": offset, "length": length}
                        order = page if page == "-" else f"{int(page) + (1 << 63):020d}"  # null first, then by number
                        lines.append(f"{url_key(fields.get('warc-target-uri'))} {stamp} {order}\t{json.dumps(info)}".encode())
                run = RunWriter(folder)
                for line in sorted(lines):
                    run.add(line)
                yield run.close()

    return staged(archives.repartition(max(1, archives.count())).mapInArrow(index, RUN_SCHEMA), "run-manifest")


class LoserTree:
    """Merge k sorted iterators: inner nodes keep the losers of their matches, so each step replays one path."""

    def __init__(self, sources: list[Iterator[bytes]]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        k = len(sources)
        self.losers = [-1] * k
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def __iter__(self) -> Iterator[bytes]:
        if not self.sources:
            return
        k = len(self.sources)
        while (out := self.heads[self.winner]) is not None:
            yield out
            best = self.winner
            self.heads[best] = next(self.sources[best], None)
            node = (best + k) // 2
            while node:
                if self._before(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.winner = best


def lines_of(path: str, start: int, end: int, low: str | None = None, high: str | None = None) -> Iterator[bytes]:
    """Lines of a run's blocks in [start, end) whose keys lie in [low, high), a block in memory at a time."""
    fs, at = filesystem(path)
    lo, hi = low.encode() if low is not None else None, high.encode() if high is not None else None
    with fs.open_input_file(at) as f:
        f.seek(start)
        left = end - start

        def read(n):
            nonlocal left
            data = f.read(min(n, left))
            left -= len(data)
            return data

        for _, _, raw in members(read):
            for line in raw.split(b"\n"):
                key = line.partition(b"\t")[0]
                if hi is not None and key >= hi:
                    return
                if lo is None or key >= lo:
                    yield line


def _fewer(runs: DataFrame) -> DataFrame:
    """Merge groups of FAN_IN runs into longer runs until one merge can take them all."""
    while (n := runs.count()) > FAN_IN:
        folder = new_path(runs.sparkSession, "runs")

        def merge(batches, folder=folder):
            rows = [r for b in batches for r in b.to_pylist()]
            for i in range(0, len(rows), FAN_IN):
                run = RunWriter(folder)
                for line in LoserTree([lines_of(r["path"], 0, r["ends"][-1]) for r in rows[i : i + FAN_IN]]):
                    run.add(line)
                yield run.close()

        runs = staged(runs.repartition(-(-n // FAN_IN)).mapInArrow(merge, RUN_SCHEMA), "run-manifest")
    return runs


def merge_runs(runs: DataFrame) -> DataFrame:
    """Captures in global order: (merge_range, merge_position) ascend with (url_key, captured_at, page_id)."""
    runs = _fewer(runs)
    total = runs.agg(F.sum("records")).first()[0] or 0
    sample = sorted(r[0] for r in runs.select(F.explode("keys").alias("key")).distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLED).collect())
    n = max(1, min(-(-total // RANGE), len(sample)))
    borders = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    def cut(batches):
        low, high = [None, *borders], [*borders, None]
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.array(row["keys"], dtype=object)
                out = []
                for i, (lo, hi) in enumerate(zip(low, high, strict=True)):
                    a = 0 if lo is None else max(0, int(np.searchsorted(keys, lo)) - 1)
                    b = len(keys) if hi is None else int(np.searchsorted(keys, hi))
                    if a < b:
                        out.append((i, row["path"], row["ends"][a], row["ends"][b]))
                if out:
                    yield pa.RecordBatch.from_pydict({"merge_range": pa.array([o[0] for o in out], pa.int32()), "path": [o[1] for o in out], "start": [o[2] for o in out], "end": [o[3] for o in out]})

    def merge(batches):
        slices: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                slices.setdefault(r["merge_range"], []).append(r)
        low, high = [None, *borders], [*borders, None]
        for i, rows in sorted(slices.items()):
            rows.sort(key=lambda r: (r["path"], r["start"]))
            held, done = [], 0
            for line in LoserTree([lines_of(r["path"], r["start"], r["end"], low[i], high[i]) for r in rows]):
                held.append(line)
                if len(held) == 5000:
                    yield _captures(held, i, done)
                    held, done = [], done + 5000
            if held:
                yield _captures(held, i, done)

    segments = runs.mapInArrow(cut, "merge_range int, path string, start long, end long")
    return segments.repartition(n, "merge_range").mapInArrow(merge, CAPTURE_SCHEMA)


CAPTURE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at string, archive string, archive_offset long, merge_range int, merge_position long"


def _captures(lines: list[bytes], part: int, done: int) -> pa.RecordBatch:
    keys, infos = zip(*((k.decode().split(" "), json.loads(v)) for k, _, v in (x.partition(b"\t") for x in lines)), strict=True)
    number = lambda s: int(s) if s not in ("", "-") else None
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number(i["page"]) for i in infos], pa.int64()),
            pa.array([i["bytes"] for i in infos], pa.int64()),
            pa.array([i["digest"] for i in infos]),
            pa.array([i["kind"] for i in infos]),
            pa.array([number(i["first"]) for i in infos], pa.int64()),
            pa.array([k[0] for k in keys]),
            pa.array([k[1] for k in keys]),
            pa.array([i["file"] for i in infos]),
            pa.array([i["offset"] for i in infos], pa.int64()),
            pa.array(np.full(len(lines), part, np.int32)),
            pa.array(np.arange(done, done + len(lines))),
        ],
        ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "archive", "archive_offset", "merge_range", "merge_position"],
    )


def archive_histories(pages: DataFrame) -> DataFrame:
    """Write, read back, index and merge: the capture histories of pages."""
    return merge_runs(index_archives(write_archives(pages)))
