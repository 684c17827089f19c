"""Byte-pair encoding by speculation and verification, and decoding.

Each distinct word gets a greedy longest-match proposal. A proposal is the exact encoding if and only if every adjacent
pair of its tokens is compatible, that is, if merging the pair's bytes from scratch gives the pair again; the test of
all distinct pairs at once is a vectorised walk down the two merge trees. Only words with an incompatible pair are
merged step by step.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.runtime import map_batches, slices

#: Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered between batches of one worker; when full, the memory starts anew.
WORDS_KEPT = 300_000
NO_RANK = np.int64(1) << 40
NEVER = 1 << 40
#: Words of up to so many bytes are merged by scanning their pairs.
SHORT = 40


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    """Encoder and decoder of a byte-level BPE vocabulary in the tokenizers library's JSON format.

    Special tokens of the file are recognised in texts, as the library does, and decoded verbatim.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if all(c in alphabet for c in k)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for text in self.special:
            vocab.pop(text.encode(), None)
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for k, v in vocab.items():
            self.bytes_of[v] = k
        for k, v in self.special.items():
            self.bytes_of[v] = k.encode()
        # Merge trees: rank of the merge that makes a token (-1 for a byte) and its two halves.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            ia, ib, made = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((ia, ib), (r, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, ia, ib
        keys = np.fromiter((a << 32 | b for a, b in self.merges), np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter((r for r, _ in self.merges.values()), np.int64, len(self.merges))[order]
        self.token_of_byte = [vocab[bytes([b])] for b in range(256)]
        # Tokens that merging can reach: proposals use only these.
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(size, bool)
        sound[made] = self._compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        self.vocab = {k: v for k, v in vocab.items() if sound[v] and (len(k) == 1 or self.rank[v] >= 0)}
        self.longest: dict[bytes, int] = {}
        for k in self.vocab:
            self.longest[k[:2]] = max(self.longest.get(k[:2], 1), len(k))
        self.split = regex.compile(SPLIT)
        self.on_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = sorted({t[0] for t in self.special if t})
        self.known: dict[str, tuple[int, ...]] = {}
        self.verified = self.exact_merges = 0

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def _compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether merging left + right from bytes never crosses the border (before merge `until`).

        Undo the younger of the two border tokens' merges, again and again. While a border pair (x, y) stands, a merge
        of x with y must not come before the merge that ends this state; on equal ranks the leftmost merge comes first.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        # The state ends by merge number `ends`; a crossing merge of that very rank wins only against the right side.
        ends = np.full(len(a), NO_RANK) if until is None else until.astype(np.int64).copy()
        wins_ties = np.zeros(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            crossing, end = self._ranks(x, y), ends[live]
            bad = (crossing < end) | ((crossing == end) & (crossing < NO_RANK) & wins_ties[live])
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go_on = ~bad & ((rx >= 0) | (ry >= 0))
            undo_left = rx > ry
            # Of equal ranks the left merge happened first, so the right one is undone first.
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            ends[live] = np.where(undo_left, rx, ry)
            wins_ties[live] = ~undo_left
            live = live[go_on]
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.vocab.get(word)
        if whole is not None:
            return [whole]
        out, i, n, vocab, longest = [], 0, len(word), self.vocab, self.longest
        while i < n:
            j = min(n, i + longest.get(word[i : i + 2], 1))
            while (t := vocab.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging in rank order, leftmost first; for long words with a heap, n log n for n bytes."""
        ids = [self.token_of_byte[b] for b in word]
        n = len(ids)
        if n <= SHORT:
            ranks = [m[0] if (m := self.merges.get(p)) else NEVER for p in zip(ids, ids[1:])]
            while ranks and (least := min(ranks)) < NEVER:
                i = ranks.index(least)
                ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
                del ranks[i]
                for k in (i - 1, i):
                    if 0 <= k < len(ranks):
                        ranks[k] = m[0] if (m := self.merges.get((ids[k], ids[k + 1]))) else NEVER
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = self.merges[x, y][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := self.merges.get((ids[i], ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[j]]))
            if before[i] >= 0 and (m := self.merges.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], ids[i]))
        return [t for t in ids if t >= 0]

    def has_special(self, text: str) -> bool:
        """Whether a special token may be in the text: one of their first characters is."""
        return any(c in text for c in self.marks)

    def learn(self, words: list[str]) -> None:
        """Encode distinct new words into self.known: propose, verify all pairs at once, merge what fails."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        keys, back = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        good = self._compatible(keys >> 32, keys & 0xFFFFFFFF)
        failing = np.unique(owner[inside[~good[back]]]) if len(inside) else []
        self.verified += len(words) - len(failing)
        self.exact_merges += len(failing)
        for i in failing:
            proposed[i] = self.merge(raw[i])
        self.known.update(zip(words, map(tuple, proposed), strict=True))

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts (null: none)."""
        pieces = []  # of each text: lists of words, and ids of special tokens between them
        for text in texts:
            parts = self.on_special.split(text) if text and self.has_special(text) else [text or ""]
            pieces.append([self.special[p] if k % 2 else self.split.findall(p) for k, p in enumerate(parts)])
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        new = set()
        for parts in pieces:
            for p in parts:
                if not isinstance(p, int):
                    new.update(p)
        if new := [w for w in new if w not in self.known]:
            self.learn(new)
        out, look = [], self.known.__getitem__
        for parts in pieces:
            ids: list[int] = []
            for p in parts:
                if isinstance(p, int):
                    ids.append(p)
                else:
                    for word in map(look, p):
                        ids += word
            out.append(ids)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> SpeculativeBpe:
    """One codec for each vocabulary and worker process."""
    return SpeculativeBpe(path)


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row of df; no shuffle, one pass.

    A null text counts as empty: no ids, decoded empty. Null ids, repeated rows and ties pass through row by row; other
    columns, whatever their names, are not read. An empty table gives an empty table.
    """

    def kernel(batch):
        bpe, texts = codec(path), batch.column(1).to_pylist()
        for a, b in slices(texts):
            ids = bpe.encode_many(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([np.array(x, np.int32) for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(kept, kernel, "doc_id long, ids array<int>, decoded string")


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of bpe_encode's rows, without moving ids and texts back to the JVM."""

    def kernel(batch):
        bpe, texts = codec(path), batch.column(1).to_pylist()
        for a, b in slices(texts):
            ids = bpe.encode_many(texts[a:b])
            sha = [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(map(len, ids), pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(kept, kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
