"""Near-duplicate documents by Order MinHash and banded alignment.

A document is its sequence of five-word shingles, each labelled with its occurrence number, so no symbol occurs twice. For
each of several hash functions the sketch takes the least few labelled shingles and keeps them in text order; documents
that agree in one such tuple are candidates, and agreement grows with edit similarity, not just with shared content.
Candidates are verified by aligning the two sequences within a band: as symbols are unique, the best alignment is the
longest increasing chain of matches. Similarity is matches / (both lengths - matches), at least 0.8 for a link.

Texts with equal words are one class from the start and only its least id goes on. Links are found within buckets, in
tiles of bounded size, with a disjoint-set forest, so a bucket of n documents gives fewer than n links; their connected
components are computed as joins. No candidate, bucket or document is dropped.

A bucket too large for one tile first meets a few of its members, its leaders, chunk by chunk. What links to them is a
class already, and only members of different classes, or of none, are compared in pairs of chunks afterwards: a bucket of
near copies of one text costs as many comparisons as it has members, not their square.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.runtime import broadcast_if_small, drop_staged, grouped, map_batches, staged

SHINGLE, SIMILARITY = 5, 0.8
#: Tables of sketches, and labelled shingles in each tuple: at similarity 0.8 a pair shares no tuple once in 5,000 cases.
TABLES, TUPLE = 12, 3
#: Bytes of the signature that estimates similarity, and how many must agree: a pair at 0.8 fails once in 20,000 cases.
SIGNATURE, AGREE = 64, 38
#: Members, and shingles, of a bucket that a tile may hold; larger buckets are cut into pairs of chunks.
TILE_DOCS, TILE_SHINGLES = 512, 4_000_000
#: Leaders of a large bucket; a class of fewer of its members than SMALL_CLASS has no chunks of its own.
LEADERS, SMALL_CLASS = 8, 128
WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
WORDS_KEPT = 100_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(11).integers(1, 2**63, max(TABLES, SIGNATURE), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Labelled shingle hashes of texts; remembers the hashes of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(text.lower()) if text else []

    def labelled(self, words: list[str]) -> np.ndarray:
        """Hashes of (five words, occurrence number) in text order; shorter texts are one shingle."""
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in [w for w in set(words) if w not in known]:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - SHINGLE + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(SHINGLE, len(h))):
            out = mix(out * _MULTIPLY + h[i : i + n])
        order = np.argsort(out, kind="stable")
        s = out[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        if not first.all():
            label = np.empty(n, np.uint64)
            label[order] = (np.arange(n) - np.flatnonzero(first)[np.cumsum(first) - 1]).astype(np.uint64)
            out = mix(out + label * _MULTIPLY)
        return out


def sketch(symbols: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Order MinHash: a 64-bit key for each table from its least symbols in text order; and the byte signature."""
    keys, n = np.zeros(TABLES, np.uint64), len(symbols)
    least = np.empty(SIGNATURE, np.uint64)
    for a in range(0, SIGNATURE, 16):  # a few functions at a time bound the memory for long texts
        v = mix(symbols[None, :] ^ _SEEDS[a : a + 16, None])
        least[a : a + 16] = v.min(1)
        rows = min(a + 16, TABLES) - a
        if rows > 0:
            at = np.sort(np.argpartition(v[:rows], TUPLE - 1, axis=1)[:, :TUPLE], axis=1) if n > TUPLE else np.tile(np.arange(n), (rows, 1))
            for row in symbols[at].T:
                keys[a : a + rows] = mix(keys[a : a + rows] * _MULTIPLY + row)
    keys = mix(keys + np.arange(TABLES, dtype=np.uint64) * _MULTIPLY)
    return keys, (mix(least) & np.uint64(255)).astype(np.uint8).tobytes()


def aligned(places: np.ndarray, n: int, m: int) -> float:
    """Similarity of two label sequences of lengths n and m: places are the other text's places of this text's symbols in
    text order (-1: none). Matches outside the band that the threshold allows are not used."""
    band = int((n + m) * (1 - SIMILARITY) / (1 + SIMILARITY)) + 1
    here = np.flatnonzero(places >= 0)
    there = places[here]
    there = there[np.abs(there - here) <= band]
    c = len(there)
    if c / (n + m - c) >= SIMILARITY and (there[1:] <= there[:-1]).any():
        tails: list[int] = []
        for p in there.tolist():
            i = bisect.bisect_left(tails, p)
            tails[i : i + 1] = [p]
        c = len(tails)
    return c / (n + m - c) if c else 0.0


def features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key of the words, n shingles, keys of the tables, signature) of each row with an id."""

    def kernel(batch):
        shingler = Shingler()
        keys, sizes, tables, signatures = [], [], [], []
        for text in batch.column(1):
            text = text.as_py()
            words = shingler.words(text)
            keys.append(hashlib.blake2b((" ".join(words) if words else "\0" + (text or "")).encode(), digest_size=16).digest())
            symbols = shingler.labelled(words)
            sizes.append(len(symbols))
            k, s = sketch(symbols) if len(symbols) else (np.empty(0, np.uint64), b"")
            tables.append(k.view(np.int64))
            signatures.append(s)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(tables, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], ["id", "key", "n", "keys", "signature"])

    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return staged(map_batches(kept, kernel, "id long, key binary, n int, keys array<long>, signature binary"), "neardup-features")


def _chunks():
    """Chunks that a group of `docs` members with `shingles` fills."""
    return F.greatest(F.ceil(F.col("docs") / TILE_DOCS), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")


def _leader_tiles(large: DataFrame) -> DataFrame:
    """(bucket, tile, id, leads): each chunk of a large bucket with the bucket's leaders, which are its least members by hash."""
    pick = Window.partitionBy("bucket").orderBy(F.xxhash64("id"), "id")
    leaders = staged(large.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= LEADERS).select("bucket", "id", "docs", "shingles"), "leaders")
    everywhere = leaders.select("bucket", "id", F.explode(F.sequence(F.lit(0).cast("long"), _chunks().cast("long") - 1)).alias("tile"), F.lit(True).alias("leads"))
    others = large.join(broadcast_if_small(leaders.select("bucket", "id")), ["bucket", "id"], "left_anti")
    chunk = F.pmod(F.xxhash64("id", F.lit(3)), _chunks()).cast("long")
    return everywhere.select("bucket", "tile", "id", "leads").unionByName(others.select("bucket", chunk.alias("tile"), "id", F.lit(False).alias("leads")))


def _class_tiles(large: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, tile, id, unit): members of large buckets once for each pair of chunks that may hold new links.

    A class of enough members has chunks of its own, which meet all others but each other; all other members share the
    chunks of unit -1, which meet themselves, too.
    """
    known = large.join(broadcast_if_small(classes.select("id", F.col("least").alias("unit"))), "id", "left").withColumn("unit", F.coalesce("unit", F.lit(-1)))
    known = staged(known.select("bucket", "id", "n", "unit"), "units")
    great = known.where("unit >= 0 or unit < -1").groupBy("bucket", "unit").count().where(F.col("count") >= SMALL_CLASS).select("bucket", "unit", F.lit(True).alias("great"))
    known = known.join(broadcast_if_small(great), ["bucket", "unit"], "left").select("bucket", "id", "n", F.when(F.col("great"), F.col("unit")).otherwise(-1).alias("unit"))
    sizes = known.groupBy("bucket", "unit").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).select("bucket", "unit", _chunks().alias("size"))
    before = Window.partitionBy("bucket").orderBy("unit")
    spans = staged(sizes.withColumn("first", F.sum("size").over(before) - F.col("size")).withColumn("total", F.sum("size").over(Window.partitionBy("bucket"))), "spans")
    m = known.join(broadcast_if_small(spans), ["bucket", "unit"])
    chunk = (F.col("first") + F.pmod(F.xxhash64("id", F.lit(3)), F.col("size"))).cast("long")
    mine = F.col("unit") == -1
    partners = F.filter(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), lambda c: mine | (c < F.col("first")) | (c >= F.col("first") + F.col("size")))
    m = m.select("bucket", "id", "unit", "total", chunk.alias("chunk"), F.explode(partners).alias("other"))
    return m.select("bucket", (F.least("chunk", "other") * F.col("total") + F.greatest("chunk", "other")).alias("tile"), "id", "unit")


def _signatures(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(rows.num_rows, SIGNATURE)


def _agreeing(signature: np.ndarray, a: int, b: int) -> np.ndarray:
    return (signature[a:b, None, :] == signature[None, :, :]).sum(2, dtype=np.uint8) >= AGREE


def _led(rows: pa.Table) -> pa.RecordBatch | None:
    """Leaders and members of a tile that have, by signature, a likely link between a leader and another."""
    ids, leads, signature = rows["id"].to_numpy(), rows["leads"].to_numpy(zero_copy_only=False), _signatures(rows)
    near = (signature[leads][:, None, :] == signature[None, :, :]).sum(2, dtype=np.uint8) >= AGREE
    near &= ids[leads][:, None] != ids
    alive = near.any(0)
    alive[np.flatnonzero(leads)] |= near.any(1)
    return _members(rows, alive, "leads")


def _members(rows: pa.Table, alive: np.ndarray, *more: str) -> pa.RecordBatch | None:
    return rows.filter(pa.array(alive)).select(["bucket", "tile", "id", *more]).combine_chunks().to_batches()[0] if alive.any() else None


def _plausible(rows: pa.Table) -> pa.RecordBatch | None:
    """Members of a tile that have, by signature, a likely partner of another class whom they meet in no earlier table."""
    n = rows.num_rows
    if n < 2:
        return None
    ids, unit, signature = rows["id"].to_numpy(), rows["unit"].to_numpy(), _signatures(rows)
    keys = np.stack(rows["keys"].to_numpy())
    bucket = rows["bucket"][0].as_py()
    table = int(np.flatnonzero(keys[0] == bucket)[0])
    alive = np.zeros(n, bool)
    for a in range(0, n, 64):
        b = min(n, a + 64)
        near = _agreeing(signature, a, b)
        near &= (ids[a:b, None] != ids) & ((unit[a:b, None] == -1) | (unit[a:b, None] != unit))
        i, j = np.nonzero(near)
        if table:
            fresh = ~(keys[a + i, :table] == keys[j, :table]).any(1)
            i = i[fresh]
        alive[a + i] = True
    return _members(rows, alive, "unit")


def _links(rows: pa.Table) -> pa.RecordBatch | None:
    """Links of a tile's members that make its similar ones one connected set: a spanning forest of verified pairs.

    Members of one class (unit) are connected from the start; of a tile with leaders only pairs with a leader count.
    """
    n = rows.num_rows
    if n < 2:
        return None
    ids, signature = rows["id"].to_numpy(), _signatures(rows)
    texts = [np.frombuffer(x, np.uint64) for x in rows["symbols"].to_pylist()]
    sizes = np.array([len(t) for t in texts])
    _, codes = np.unique(np.concatenate(texts), return_inverse=True)
    coded = np.split(codes, np.cumsum(sizes)[:-1])
    place = np.full(int(codes.max()) + 1, -1, np.int64)
    root = list(range(n))
    led = "leads" in rows.column_names
    if led:
        leads = rows["leads"].to_numpy(zero_copy_only=False)
    else:
        unit, at = rows["unit"].to_numpy(), {}
        for i, u in enumerate(unit.tolist()):
            if u != -1:
                root[i] = at.setdefault(u, i)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a in np.argsort(ids, kind="stable").tolist():
        if led and not leads[a]:
            continue
        agree = (signature == signature[a]).sum(1, dtype=np.uint8)
        fits = (agree >= AGREE) & (np.minimum(sizes, sizes[a]) >= SIMILARITY * np.maximum(sizes, sizes[a])) & (ids != ids[a] if led else ids > ids[a])
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        place[coded[a]] = np.arange(sizes[a])
        for b in near[np.argsort(-agree[near].astype(int), kind="stable")].tolist():
            if find(a) != find(b) and aligned(place[coded[b]], int(sizes[b]), int(sizes[a])) >= SIMILARITY:
                root[find(b)] = find(a)
                out.append((ids[a], ids[b]))
        place[coded[a]] = -1
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["u", "v"]) if out else None


def components(links: DataFrame) -> DataFrame:
    """(id, least): the least id of each connected component of the undirected links (u, v), for every linked id.

    In each round every node points to its least neighbour and the graph is contracted along these pointers; a pointer's
    own pointer stays as a link, so nothing falls apart. Rounds grow with the logarithm of the longest path.
    """
    spark, links = links.sparkSession, staged(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    found = None
    while links.head(1):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("to")), "pointers")
        left, right = to.select(F.col("id").alias("u"), F.col("to").alias("fu")), to.select(F.col("id").alias("v"), F.col("to").alias("fv"))
        moved = links.join(broadcast_if_small(left), "u").join(broadcast_if_small(right), "v").select(F.col("fu").alias("u"), F.col("fv").alias("v"))
        chained = to.select(F.col("to").alias("u")).distinct().join(broadcast_if_small(left), "u").select("u", F.col("fu").alias("v"))
        onward = moved.unionByName(chained).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        before, old = found, links
        links = staged(onward, "links")
        if found is None:
            found = to.select("id", F.col("to").alias("least"))
        else:
            step = broadcast_if_small(to.select(F.col("id").alias("least"), "to"))
            found = staged(found.join(step, "least", "left").select("id", F.coalesce("to", "least").alias("least")), "components")
            drop_staged(to, *([before] if before is not None else []))
        drop_staged(old)
    return found if found is not None else spark.createDataFrame([], "id long, least long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): class_id is the least doc_id of the document's class of exact and near copies, its own if none.

    Case, punctuation and white space do not matter. Texts of fewer than five words, null and empty ones are in one class
    only with texts of the same words (or, without any word, of the same characters; null counts as empty). Rows of one
    id are one document, linked through any of its texts, with a row each; rows without id get no class (null). An empty
    table gives an empty table. Other columns are not read.
    """
    spark = df.sparkSession
    every = features(df, id_col, text_col)
    same = staged(every.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("key", "rep"), "same-words")
    every = every.join(broadcast_if_small(same), "key", "left").withColumn("rep", F.coalesce("rep", "id"))
    reps = staged(every.where("rep = id and n > 0").select("id", "n", "keys", "signature"), "representatives")
    entries = reps.select("id", "n", F.explode("keys").alias("bucket"))
    shared = staged(entries.groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).where("docs > 1"), "buckets")
    members = staged(entries.join(broadcast_if_small(shared), "bucket").select("bucket", "id", "n", "docs", "shingles"), "members")
    by = ("bucket", "tile")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")

    def over(kernel):
        return lambda batches: (out for rows in grouped(batches, 2) if (out := kernel(rows)) is not None)

    def tiled(rows: DataFrame, kernel, schema: str, name: str) -> DataFrame:
        return staged(rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(over(kernel), schema), name)

    def symbols(batch):
        shingler = Shingler()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler.labelled(shingler.words(t.as_py())).tobytes() for t in batch.column(1)], pa.binary())], ["id", "symbols"])

    def checked(likely: DataFrame, name: str) -> DataFrame:
        """Verified links of likely members, whose sequences are made anew from the texts."""
        wanted = staged(likely.select("id").distinct(), "wanted")
        sequences = staged(map_batches(texts.join(broadcast_if_small(wanted), "id").select("id", "text"), symbols, "id long, symbols binary").where("length(symbols) > 0"), "symbols")
        rows = likely.join(sequences, "id").join(reps.select("id", "signature"), "id")
        links = tiled(rows.select("bucket", "tile", "id", "symbols", "signature", likely.columns[-1]), _links, "u long, v long", name)
        drop_staged(wanted, sequences)
        return links

    is_large = (F.col("docs") > TILE_DOCS) | (F.col("shingles") > TILE_SHINGLES)
    tiles = members.where(~is_large).select("bucket", F.lit(0).cast("long").alias("tile"), "id", F.lit(-1).cast("long").alias("unit"))
    links = None
    if members.where(is_large).head(1):
        large = members.where(is_large)
        near = _leader_tiles(large).join(reps.select("id", "signature"), "id").select(*by, "id", "leads", "signature")
        links = checked(tiled(near, _led, "bucket long, tile long, id long, leads boolean", "led"), "leader-links")
        tiles = tiles.unionByName(_class_tiles(large, components(links)))
    rows = tiles.join(reps.select("id", "keys", "signature"), "id").select(*by, "id", "unit", "keys", "signature")
    likely = tiled(rows, _plausible, "bucket long, tile long, id long, unit long", "likely")
    found = checked(likely, "verified-links")
    links = found if links is None else links.unionByName(found)
    # Representatives that are one document by their id belong together whatever their texts.
    again = every.where("rep <> id").select(F.col("id").alias("u"), F.col("rep").alias("v")).join(reps.select(F.col("id").alias("u")).distinct(), "u", "left_semi")
    classes = components(links.unionByName(again))
    drop_staged(members, likely, shared)
    known = every.select("id", "rep").join(broadcast_if_small(classes.select(F.col("id").alias("rep"), "least")), "rep", "left")
    out = known.select(F.col("id").alias("doc_id"), F.coalesce("least", "rep").alias("class_id"))
    lost = df.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(lost)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each class, the one of the least id (of its rows
    the first by hash of the text, then by all columns); rows without id stay."""
    classes = near_duplicates(df, id_col, text_col)
    copies = staged(classes.where("doc_id <> class_id").select(F.col("doc_id").alias(id_col)).distinct(), "copies")
    kept = df.join(broadcast_if_small(copies), id_col, "left_anti").select(*df.columns)
    if df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").head(1):
        first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), F.to_json(F.struct(*df.columns)))
        one = kept.where(F.col(id_col).isNotNull()).select("*", F.row_number().over(first).alias("__row")).where("__row = 1").drop("__row")
        kept = one.unionByName(kept.where(F.col(id_col).isNull()))
    return kept
