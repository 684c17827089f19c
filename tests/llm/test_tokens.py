"""Codec, packing, token files and media against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm import bpe, jpeg, media, packing, tokenfiles, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = [(5, "A test, isn't it?\n  Two  spaces "), (1, ""), (3, None), (2, "é漢🙂 <|endoftext|> tail"), (9, "x" * 3000), (None, "no id"), (5, "A test, isn't it?\n  Two  spaces "), (7, "the same words again and again " * 400)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in DOCS], "doc_id long, text string, part int, ids int, start int")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_codec_equals_library(library):
    codec = bpe.SpeculativeBpe(PATH)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaabc '\n\t .,<|>éß漢🙂1st‍ ") for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "<|endoftext|><|endoftext|>x", " " * 500, "don't I'LL we're"]
    assert codec.encode_many(texts) == [ids_of(library, t) for t in texts]
    assert codec.exact_merges > 0 and codec.verified > 0
    assert [codec.decode(codec.encode_many([t])[0]) for t in texts] == texts


def test_every_code_point_splits_alike(library):
    fast = tokens.FastEncoder(PATH)
    points = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)} " for c in points[i : i + 40]) for i in range(0, len(points), 40)]
    assert [fast.encode(t).tolist() for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_pair_check_is_exact():
    codec = bpe.SpeculativeBpe(PATH)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50000, 3000), rng.integers(0, 50000, 3000)
    want = [codec.merge(codec.bytes_of[x] + codec.bytes_of[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert codec._compatible(a, b).tolist() == want


def test_op1(spark, docs, library):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.bpe_digests(docs, PATH).collect()}
    for d, t in DOCS:
        ids = ids_of(library, t)
        r = got[d, len(ids)]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = bpe.bpe_encode(docs, PATH).collect()
    assert len(rows) == len(DOCS) and all(r.decoded == (t or "") for r, (_, t) in zip(rows, DOCS, strict=True))
    assert bpe.bpe_digests(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("length", [7, 64])
def test_packing(spark, docs, library, length):
    pieces = packing.pack(docs.repartition(3), PATH, length).toPandas()
    at = pieces.sequence_id * length + pieces.offset
    pieces = pieces.assign(at=at).sort_values("at")
    assert (pieces["at"].to_numpy() == np.concatenate([[0], np.cumsum(pieces.length)[:-1]])).all()  # gapless
    assert (pieces.offset + pieces.length <= length).all()
    assert pieces.groupby("sequence_id").length.sum().iloc[:-1].eq(length).all()
    whole = [(d, [*ids_of(library, t), 0]) for d, t in DOCS]
    assert pieces.length.sum() == sum(len(i) for _, i in whole)
    for d, ids in whole:
        mine = pieces[(pieces.doc_id == d) | (pieces.doc_id.isna() & (d is None))]
        found = {(r.start, tuple(r.ids)) for r in mine.itertuples()}
        assert all(tuple(ids[s : s + len(x)]) == x for s, x in found) and (mine.doc_tokens == len(ids)).all()
        assert {r.ids_crc32 for r in mine.itertuples()} == {zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in found}
        assert mine.length.sum() == len(ids) * sum(d == e for e, _ in DOCS)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_long_texts_and_words(library):
    """A text of 5 MB and a word of 1 MB without a space, by the fast encoder and by the codec."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    long, word = " ".join(rng.choice(words) for _ in range(900_000)), "".join(rng.choice("abcé") for _ in range(1_000_000))
    fast = tokens.FastEncoder(PATH)
    for text in (long[:5_000_000], word):
        want = ids_of(library, text)
        assert fast.encode(text).tolist() == want and bpe.SpeculativeBpe(PATH).encode_many([text])[0] == want


def test_special_tokens_of_any_form(library, tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["added_tokens"][0]["content"] = "[[end]]"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    codec = bpe.SpeculativeBpe(str(path))
    text = "a [[end]]b <|endoftext|>"
    assert codec.special["[[end]]"] in codec.encode_many([text])[0]


def test_shards_are_dealt_one_to_a_part(spark):
    deal = tokenfiles.dealt(spark, 37)
    rows = spark.createDataFrame([(int(d), i) for i, d in enumerate(deal)], "deal int, shard int").repartition(37, "deal")
    assert sorted(len(p) for p in rows.rdd.glom().collect()) == [1] * 37


def test_token_files(spark, docs, library, monkeypatch):
    manifest = tokenfiles.write_token_files(docs, PATH)
    rows = sorted(tokenfiles.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 5, 5, 7, 9]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    want = sorted((d or -1, zlib.crc32(np.array([*ids_of(library, t), 2], "<u4").tobytes())) for d, t in DOCS)
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in rows) == want
    first = manifest.orderBy("shard").first()
    shard = tokenfiles.TokenShard(first.path, first.dtype)
    assert shard[0].tolist() == [*ids_of(library, "no id"), 2] and shard.tokens.dtype == np.uint16
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(docs.limit(0), PATH)).count() == 0
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", 40)
    least = spark.createDataFrame([(-(2**63), "a"), (None, "b"), (9, "end")] + [(4, "same")] * 50 + [(i, "x y") for i in range(10, 30)], "doc_id long, text string").repartition(3)
    manifest = tokenfiles.write_token_files(least, PATH)
    back = tokenfiles.read_token_files(manifest).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, -(2**63)] + [4] * 50 + [9, *range(10, 30)] and manifest.count() >= 4
    assert [r.start for r in back] == [0, *np.cumsum([r.n_tokens for r in back])[:-1]]


@pytest.mark.parametrize("sampling", [((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1)), ((1, 1),)])
def test_progressive_scans(sampling):
    rng = np.random.default_rng(4)
    f = jpeg.Frame.blank(37, 21, sampling)
    for c in f.components:
        own = jpeg._own_blocks(c)
        x = rng.integers(-40, 41, (len(own), 64)) * (rng.random((len(own), 64)) < 0.2)
        x[:, 0] = rng.integers(-300, 300, len(own))
        c.coefficients[own] = x
        c.quantisation = np.arange(1, 65)
    g = jpeg.decode(jpeg.encode(f))
    assert all((a.coefficients == b.coefficients).all() and (b.quantisation == np.arange(1, 65)).all() for a, b in zip(f.components, g.components, strict=True))
    assert g.rgb().shape == (21, 37, 3)


def test_dense_scans_read_alike_bit_by_bit(monkeypatch):
    payload = media.padded(bytes(range(256)) * 3)
    file = media.to_media(payload, 768)
    fast = jpeg.decode(file)
    monkeypatch.setattr(jpeg, "_dense", lambda *a: False)
    slow = jpeg.decode(file)
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components, slow.components, strict=True))


def test_transform_and_upsampling_by_formula():
    """RGB from the sums of the standard's formula, block by block, with chroma repeated over its 2 x 2 samples."""
    rng = np.random.default_rng(5)
    f = jpeg.Frame.blank(32, 16)
    order = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    planes = []
    for c in f.components:
        c.quantisation = rng.integers(1, 9, 64)
        c.coefficients[:] = rng.integers(-30, 31, c.coefficients.shape) * (rng.random(c.coefficients.shape) < 0.15)
        plane = np.zeros((c.high * 8, c.wide * 8))
        for b, row in enumerate(c.coefficients * c.quantisation):
            for y in range(8):
                for x in range(8):
                    terms = (row[k] * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for k, (u, v) in enumerate(order) if row[k])
                    plane[b // c.wide * 8 + y, b % c.wide * 8 + x] = sum(terms) / 4 + 128
        planes.append(np.clip(np.rint(plane), 0, 255))
    wide = [np.array([[p[y // (16 // p.shape[0]), x // (32 // p.shape[1])] for x in range(32)] for y in range(16)]) for p in planes]
    luma, blue, red = wide[0], wide[1] - 128, wide[2] - 128
    want = np.clip(np.rint(np.stack([luma + 1.402 * red, luma - 0.344136 * blue - 0.714136 * red, luma + 1.772 * blue], 2)), 0, 255)
    assert np.abs(f.rgb().astype(int) - want).max() <= 2 and (f.rgb() == want).mean() > 0.99


def test_restart_intervals():
    dc = {s: 4 for s in range(12)}
    values = np.array([-77, 300, 5])
    parts = lambda pieces: b"".join(jpeg.stuffed(p) + bytes([0xFF, 0xD0 + i]) for i, p in enumerate(pieces[:-1])) + jpeg.stuffed(pieces[-1])
    file = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + bytes([1] * 64)) + jpeg.segment(0xC2, b"\x08\x00\x08\x00\x18\x01\x01\x11\x00") + jpeg.segment(0xDD, b"\x00\x02") + jpeg.huffman(0, 0, dc)
    file += jpeg.scan_header([0], 0, 0, 0, 0, 1) + parts([jpeg._dc_first([np.arange(len(v))], v >> 1, jpeg.codes(dc)) for v in (values[:2], values[2:])])
    file += jpeg.scan_header([0], 0, 0, 0, 1, 0) + parts([np.packbits(np.append(v & 1, np.ones(8 - len(v), int)).astype(np.uint8)) for v in (values[:2], values[2:])]) + b"\xff\xd9"
    assert jpeg.decode(file).components[0].coefficients[:, 0].tolist() == values.tolist()


def test_tensors_are_stored(spark, docs):
    rows = media.read_media(media.write_media(docs), with_tensor=True, keep=True).collect()
    files = {r.tensor_file for r in rows}
    stored = {(r.doc_id, r.height, r.width, bytes(r.data)) for f in files for r in spark.read.parquet(f).collect()}
    assert stored == {(r.doc_id, r.tensor.height, r.tensor.width, bytes(r.tensor.data)) for r in rows}
    assert all(r.feature == media.feature(r.tensor.height, r.tensor.width, r.tensor.data) for r in rows)


def test_a_long_text_in_one_image():
    payload = media.padded(np.random.default_rng(1).integers(0, 256, 5_000_000).astype(np.uint8).tobytes())
    frame, back, n = media.from_media(media.to_media(payload, 5_000_000))
    assert back == payload and n == 5_000_000 and frame.rgb().shape == (frame.height, frame.width, 3)


def test_transform_is_the_cosine_transform():
    frame = jpeg.Frame.blank(8, 8, ((1, 1),))
    frame.components[0].coefficients[0, 0] = 80  # flat: 80 / 8 above the middle
    assert (frame.rgb() == 138).all()


def test_op10(spark, docs):
    rows = media.read_media(media.write_media(docs), with_tensor=True).collect()
    assert len(rows) == len(DOCS)
    found = {(r.doc_id, r.n_bytes): r for r in rows}
    for d, t in DOCS:
        raw = (t or "").encode()
        r = found[d, len(raw)]
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert r.payload_bytes == len(payload) and len(payload) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert len(r.tensor.data) == r.tensor.height * r.tensor.width * 3
    assert len({(r.feature, r.media_sha256) for r in rows if r.doc_id == 5}) == 1
    assert media.read_media(media.write_media(docs.limit(0))).count() == 0
