"""Byte-level BPE vocabularies of ``tokenizers`` JSON files, encoded at speed.

The ids are those of the ``tokenizers`` library for the file; ``tiktoken`` runs
the same merges from the file's own vocabulary as ranks several times faster.
The file is read where it is used: its path is a parameter, its name resolved by
``public_tokenizers.path`` when it is no path.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

BYTE_BPE = "byte_bpe_50k.json"


def _byte_of_character() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Encodes as ``tokenizers`` does with ``add_special_tokens=False``: special
    strings inside a text become their ids, nothing is added, cut or padded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        of = _byte_of_character()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.core = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.size = max([*self.ranks.values(), *self.special.values()]) + 1

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.core.encode(text, allowed_special="all")
        return self.core.encode_ordinary(text)

    def ids(self, text: str | None, end_id: int | None = None) -> np.ndarray:
        """The same as an array, with ``end_id`` appended if there is one; null text has no ids."""
        special = "all" if text and any(s in text for s in self.special) else set()
        own = self.core.encode_to_numpy(text, allowed_special=special, disallowed_special=()) if text else np.zeros(0, np.uint32)
        return own if end_id is None else np.append(own, np.uint32(end_id))


@lru_cache(maxsize=2)
def byte_bpe(name: str = BYTE_BPE) -> ByteBpe:
    """One instance for each worker process and file."""
    return ByteBpe(name if "/" in name else public_tokenizers.path(name))
