"""Byte-level BPE ids of whole texts, for operators that need ids or lengths but no own encoder.

The vocabulary is a tokenizers JSON file.  Where its merges are numbered like its ids
(checked on loading), the same merges run in tiktoken, which gives the same ids about
five times faster; any other vocabulary, and a text that tiktoken refuses, goes to tokenizers.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: The split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class ByteEncoder:
    """``ids(text)`` as an array of unsigned 32-bit ids, without added special tokens."""

    def __init__(self, path: str):
        self.path, self.fast, self._slow = path, None, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"] or {}
        vocab, added = model["vocab"], {x["content"]: x["id"] for x in file["added_tokens"]}
        plain = file["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        if plain and in_order and not model.get("ignore_merges") and not model.get("dropout") and len(vocab) == 256 + len(merges):
            import tiktoken

            byte = {c: b for b, c in enumerate(byte_letters())}
            ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
            self.fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except BaseException as e:  # a panic of the regex engine on extreme texts is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.no_truncation()
            self._slow.no_padding()
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One encoder for each Python worker and vocabulary."""
    return ByteEncoder(path)
