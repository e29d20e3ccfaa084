"""BPE encoding and decoding with word ends: a contiguous rank array per short word.

A word starts as one part per byte.  Two parallel lists hold the parts and the rank of each
pair of neighbours; the least rank is found by a scan, its boundary deleted, and the ranks on
either side refreshed.  Scanning is quadratic, so words of over ``SHORT`` parts keep their pairs
in a heap over a linked list, which merges in the same order.

Nulls: a null text is the empty text (no ids, empty decoded text); a null id stays null.
Repeated rows give repeated results; an empty table gives an empty result; columns besides the
id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import byte_letters

SHORT = 48
NONE = 1 << 60
#: What the normalizer counts as white space.
WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class WordBPE:
    """Encodes and decodes as the vocabulary file says; remembers a bounded number of words."""

    def __init__(self, path: str, bound: int = 300_000):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        if not end or model.get("dropout") or [x["type"] for x in file["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or file["decoder"]:
            raise ValueError("this encoder is for lower-casing vocabularies with word ends")
        split = file["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.inner = [vocab.get(c) for c in byte_letters()]
        self.last = [vocab.get(c + end) for c in byte_letters()]
        self.text = {i: t for t, i in vocab.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[bytes, str]] = {}
        self.bound = bound

    def merged(self, word: str) -> list[int]:
        """The ids of one word."""
        body = word.encode("utf-8")
        parts = [self.inner[b] for b in body[:-1]] + [self.last[body[-1]]]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        pairs = self.pairs
        ranks = [pairs.get(p, (NONE, 0))[0] for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), (NONE, 0))[0]
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), (NONE, 0))[0]
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        pairs, n = self.pairs, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = pairs[a, b][1], True, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (parts[x], parts[y])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], x, *p))
        return [p for p, g in zip(parts, gone) if not g]

    def piece(self, word: str) -> tuple[bytes, str]:
        """The ids of one word as bytes, and its decoded text."""
        found = self.known.get(word)
        if found is None:
            ids = self.merged(word)
            found = b"".join(i.to_bytes(4, "little") for i in ids), " ".join(map(self.text.__getitem__, ids))
            if len(word) <= 64:
                if len(self.known) >= self.bound:
                    self.known.clear()
                self.known[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text."""
        ids, out = [], []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                ids.append(self.special[part].to_bytes(4, "little"))
                out.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower-casing looks at no context
            pieces = list(map(self.piece, self.words(WHITE.sub(" ", part).lower())))
            ids += [p[0] for p in pieces]
            out += [p[1] for p in pieces]
        return b"".join(ids), " ".join(out)

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text[i] for i in ids)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for b in batches:
            made = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            ids = pa.array([memoryview(x).cast("I").tolist() for x, _ in made], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([d for _, d in made], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encoding_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of every document, without shipping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for b in batches:
            rows = []
            for t in b.column(1):
                ids, out = bpe.encode(t.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(out.encode("utf-8")).hexdigest()))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
