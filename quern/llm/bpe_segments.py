"""BPE encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of a word's tree are its adjacent pairs, each keyed by merge rank and then position, and inner nodes hold
the least key below them. The root so names the leftmost lowest-rank merge. A merge changes three leaves, each in
logarithmic time, and the word is done when the root holds no pair.

Defined results: null texts count as empty (no ids, empty decoded text); every row keeps one result, whatever its id;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import Kept, pieces
from quern.llm.token_counts import ODD, byte_letters

#: The pattern whose matches are the words, for all of Unicode and (faster) for texts of plain characters.
ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|(?:[^\s\w]|_)+")
#: Words that a Python worker keeps twice over.
KEEP = 200_000
NONE = 1 << 60


class Encoder(Kept):
    """For each word: its ids as decimal text, its tokens' text, how many. One for each Python worker."""

    def __init__(self, path: str) -> None:
        super().__init__(self._shown, KEEP)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {v: k for k, v in (self.vocab | self.special).items()}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.letter = {b: c for c, b in byte_letters().items()}
        self.merge: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge.setdefault(self.vocab[a] << 20 | self.vocab[b], rank << 20 | self.vocab[a + b])

    def ids(self, word: str) -> list[int]:
        """The ids of one word, by the segment tree."""
        letters = [self.letter[b] for b in word.encode()]
        letters[-1] += self.end
        symbols = [self.vocab[c] for c in letters]
        n, find = len(symbols), self.merge.get
        if n == 1:
            return symbols
        size = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            if (m := find(symbols[i] << 20 | symbols[i + 1])) is not None:
                tree[size + i] = (m >> 20) << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = [*range(1, n + 1)], [*range(-1, n)]
        while (top := tree[1]) != NONE:
            i = top & 0xFFFFFFFF
            j, p = after[i], before[i]
            symbols[i], symbols[j] = find(symbols[i] << 20 | symbols[j]) & 0xFFFFF, -1
            after[i] = k = after[j]
            before[k] = i
            # the merged pair's right neighbour, the pair that now starts here, and the one that ends here
            if j < n - 1:
                self._put(tree, size + j, NONE)
            m = find(symbols[i] << 20 | symbols[k]) if k < n else None
            self._put(tree, size + i, NONE if m is None else (m >> 20) << 32 | i)
            if p >= 0:
                m = find(symbols[p] << 20 | symbols[i])
                self._put(tree, size + p, NONE if m is None else (m >> 20) << 32 | p)
        return [s for s in symbols if s >= 0]

    @staticmethod
    def _put(tree: list[int], k: int, key: int) -> None:
        """Sets a leaf and what stands above it, as far up as it changes."""
        if tree[k] == key:
            return
        tree[k] = key
        while k > 1:
            other = tree[k ^ 1]
            low = key if key < other else other
            k >>= 1
            if tree[k] == low:
                return
            tree[k] = key = low

    def _shown(self, word: str) -> tuple[bytes, bytes, int]:
        ids = self.ids(word)
        return " ".join(map(str, ids)).encode(), self.decode(ids).encode(), len(ids)

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])

    def words(self, text: str) -> list[str]:
        """The words that are merged apart from each other: composed, lower case letter by letter, without white space."""
        if not ODD.search(text):
            return PLAIN.findall(text.lower())
        return ANY.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> tuple[bytes, bytes, int]:
        """The whole text's ids as decimal text, the decoded text, and the number of ids."""
        parts = []
        last = 0
        if any(s in text for s in self.special):
            for m in self.split.finditer(text):
                parts += [self[w] for w in self.words(text[last : m.start()])]
                parts.append((str(self.special[m.group()]).encode(), m.group().encode(), 1))
                last = m.end()
        parts += map(self.__getitem__, self.words(text[last:]))
        ids, shown, n = zip(*parts, strict=True) if parts else ((), (), ())
        return b" ".join(ids), b" ".join(shown), sum(n)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The number of ids of each whole text, with the SHA-256 of its ids and of its decoded text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for piece in pieces(batches):
            out = []
            for text in piece.column("text").to_pylist():
                ids, shown, n = encode(text or "")
                out.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown).hexdigest()))
            n, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer).encode
        for piece in pieces(batches, limit=1 << 20):
            ids = pa.array([[int(i) for i in of(t or "")[0].split()] for t in piece.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([of(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
