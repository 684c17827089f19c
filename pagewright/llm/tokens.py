"""Token ids of whole texts for the operators that pack or store them, equal to the tokenizers library's.

The library itself encodes about 1.5 MB a second and core, so a rank-based encoder of the same vocabulary does the bulk;
texts that it cannot take (and vocabularies whose ids are not in merge order) go to the exact codec of bpe.py.
"""

from __future__ import annotations

import functools

import numpy as np
import tiktoken

from pagewright.llm.bpe import SPLIT, SpeculativeBpe, codec


class FastEncoder:
    def __init__(self, path: str):
        self.path, bpe = path, SpeculativeBpe(path)
        self.special = bpe.special
        self.on_special, self.has_special = bpe.on_special, bpe.has_special
        self.size = len(bpe.bytes_of)
        made = [m for _, m in sorted(bpe.merges.values())]
        plain = {b: i for i, b in enumerate(bpe.bytes_of) if b and b.decode("utf-8", "replace") not in self.special}
        self.core = tiktoken.Encoding("pagewright", pat_str=SPLIT, mergeable_ranks=plain, special_tokens={}) if made == sorted(made) and len(bpe.vocab) == len(plain) else None

    def _plain(self, text: str) -> np.ndarray:
        if self.core:
            try:
                return self.core.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # its native code gives up on some huge texts
                if type(e).__name__ not in ("PanicException", "ValueError"):
                    raise
        return np.array(codec(self.path).encode_many([text])[0], np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers; a null text counts as empty."""
        if not text:
            return np.empty(0, np.uint32)
        if not self.has_special(text) or not self.on_special.search(text):
            return self._plain(text)
        parts = self.on_special.split(text)
        return np.concatenate([np.array([self.special[p]], np.uint32) if k % 2 else self._plain(p) for k, p in enumerate(parts) if p])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> FastEncoder:
    return FastEncoder(path)


__all__ = ["FastEncoder", "encoder"]
