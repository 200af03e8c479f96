"""Token ids of texts under a public byte-level BPE vocabulary.

`tokenizers` defines the ids. The same merges run several times faster in
`tiktoken`, whose ranks are the vocabulary's ids; that path is taken where both
agree by construction (a byte-level BPE file without normaliser, whose ids follow
merge order) and `tokenizers` handles the rest.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

END_OF_TEXT = 1


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """Printable stand-ins of a byte-level BPE: bytes that print stand for themselves, others for 256, 257, ..."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            letters[chr(256 + b - sum(x < b for x in plain))] = b
    return letters


class Encoder:
    """encode(text) -> list of ids, special tokens parsed but none added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.size = self.exact.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            return None
        import public_tokenizers
        import tiktoken

        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        if any(c not in letters for t in vocab if t not in self.special for c in t):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        if len(ranks) != len(vocab) - sum(t in vocab for t in self.special) or any(bytes([b]) not in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if self.fast is None or any(t in text for t in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def array(self, text: str | None) -> np.ndarray:
        if self.fast is None or any(t in (text or "") for t in self.special):
            return np.array(self.encode(text), dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text or ""), dtype=np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and path."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
