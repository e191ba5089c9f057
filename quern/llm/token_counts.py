"""Exact token counts at every prefix by dynamic programming over byte-level BPE.

A text is cut into the pieces that the tokenizer merges apart from each other. Over the bytes of a piece, the last
token of each prefix follows from shorter prefixes: it is the one vocabulary entry ending there that may stand after
the last token of the prefix before it. Each prefix thus gets its count from one earlier prefix, and the table answers
how many tokens any prefix takes, or how long a prefix fits a budget, without encoding again.

Defined results: null texts count as empty (no tokens); every row keeps one result, whatever its id; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import Kept, pieces

#: The pattern that splits text before the merges, for all of Unicode and (faster) for texts of plain characters.
ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?(?:[a-zA-ZÀ-ÖØ-öø-ÿ]+|[0-9]+|(?:[^\s\w]|_)+)|\s+(?!\S)|\s+")
ODD = re.compile(r"[^\t\n\r -~¡-¨À-ÿ]")
#: Pieces that a Python worker keeps twice over.
KEEP = 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter(Kept):
    """Token counts by piece (a string); missing ones are worked out. One for each Python worker."""

    def __init__(self, path: str) -> None:
        super().__init__(lambda piece: self.table(piece.encode())[-1], KEEP)
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.longest = max(map(len, self.ids))
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        pairs = [(raw(a), raw(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.rank = {self.ids[a] << 20 | self.ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = {self.ids[a + b]: (self.ids[a], self.ids[b], r) for r, (a, b) in reversed([*enumerate(pairs)])}
        self.lasting: dict[int, bool] = {}
        self.right = lru_cache(None)(lambda t: self._spine(t, 1))
        self.left = lru_cache(None)(lambda t: self._spine(t, 0))
        self.stable = lru_cache(100_000)(self._stable)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at one edge of a token while it is built, each with the rank of the merge that ends it."""
        out, end = [], float("inf")
        while True:
            out.append((token, end))
            if token not in self.made:
                return out
            *parts, end = self.made[token]
            token = parts[side]

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes together is these two: no merge ever joins them across the border.

        Such a merge would need both edges to live at its rank; of equal merges the left one goes first.
        """
        if len(self.lasting) >= KEEP:
            self.lasting.clear()
        self.lasting[a << 20 | b] = known = self._follows(a, b)
        return known

    def _follows(self, a: int, b: int) -> bool:
        rank, left = self.rank.get, self.left(b)
        for x, end_x in self.right(a):
            for y, end_y in left:
                if (r := rank(x << 20 | y)) is not None and r < end_x and r <= end_y:
                    return False
        return True

    def _stable(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token alone."""
        if token not in self.made:
            return True
        a, b, own = self.made[token]
        if not (self.stable(a) and self.stable(b)):
            return False
        rank = self.rank.get
        return not any((x, y) != (a, b) and (r := rank(x << 20 | y)) is not None and r < end_x and r <= end_y and r < own for x, end_x in self.right(a) for y, end_y in self.left(b))

    def table(self, piece: bytes) -> list[int]:
        """The token count of each prefix of a piece, by bytes, from the empty one on."""
        get, longest, follows, known, stable = self.ids.get, self.longest, self.follows, self.lasting.get, self.stable
        count, last = [0], [-1]
        for end in range(1, len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                if (token := get(piece[start:end])) is not None:
                    if start:
                        a = last[start]
                        if (yes := known(a << 20 | token)) is None:
                            yes = follows(a, token)
                    else:
                        yes = stable(token)
                    if yes:
                        last.append(token)
                        count.append(count[start] + 1)
                        break
        return count

    def parts(self, text: str) -> list[str]:
        return (ANY if ODD.search(text) else PLAIN).findall(text)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Ordinary text and special strings (True) in turn."""
        if self.split is None or not any(s in text for s in self.special):
            return [(text, False)]
        out, last = [], 0
        for m in self.split.finditer(text):
            out += [(text[last : m.start()], False), (m.group(), True)]
            last = m.end()
        return [*out, (text[last:], False)]

    def total(self, text: str) -> int:
        """The table's last entry: the tokens of the whole text."""
        get = self.__getitem__
        return sum(1 if special else sum(map(get, self.parts(part))) for part, special in self.segments(text))

    def prefixes(self, text: str) -> np.ndarray:
        """The token count of each prefix of the text, by characters, from the empty one on."""
        out, base, tail = [0], 0, ""
        for segment, special in self.segments(text):
            if special:
                out += [base - (self[tail] if tail else 0) + self.total(tail + segment[:k]) for k in range(1, len(segment))]
                base, tail = base + 1, ""
                out.append(base)
                continue
            for piece in self.parts(segment):
                counts = self._by_letter(piece)
                if tail and tail.isspace() and piece[0].isspace():  # a prefix that ends after white space takes the whole run of it as one piece
                    blank = len(piece) - len(piece.lstrip())
                    before = base - self[tail]
                    run = self._by_letter(tail + piece[:blank])
                    out += [before + run[len(tail) + k] for k in range(1, blank + 1)]
                    out += [base + c for c in counts[blank + 1 :]]
                else:
                    out += [base + c for c in counts[1:]]
                base, tail = base + counts[-1], piece
        return np.array(out, np.int32)

    def _by_letter(self, piece: str) -> list[int]:
        count, at, out = self.table(piece.encode()), 0, [0]
        for c in piece:
            at += len(c.encode())
            out.append(count[at])
        if piece in ("'re", "'ve", "'ll"):  # cut short, these are two pieces
            out[2] = self["'"] + self[piece[1]]
        return out


@lru_cache(1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def report(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """UTF-8 bytes and tokens of each whole text, and whether it takes more than ``limit`` tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = counter(tokenizer).total
        for piece in pieces(batches):
            text = piece.column("text")
            n = pa.array([total(t) if t else 0 for t in text.to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, counts``: the exact token count of each prefix of the text, by characters, the empty one first."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer).prefixes
        for piece in pieces(batches, limit=1 << 20):
            counts = pa.array([of(t or "") for t in piece.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), counts], ["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(table, "doc_id long, counts array<int>")


def tokens_at(n_chars: Column | str, counts: Column | str = "counts") -> Column:
    """The tokens of the first ``n_chars`` characters (of the whole text, if it is shorter)."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    n = F.col(n_chars) if isinstance(n_chars, str) else n_chars
    return F.element_at(counts, F.least(n.cast("int"), F.size(counts) - 1) + 1)


def chars_within(budget: Column | str, counts: Column | str = "counts") -> Column:
    """The most characters from the start of the text that take at most ``budget`` tokens."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    budget = F.col(budget) if isinstance(budget, str) else budget
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))
