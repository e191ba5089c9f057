"""Fill-in-the-middle examples: texts cut in three at unit boundaries and put together in another order.

A unit is a word with the white space before it; white space at the end of a text is one more. A byte automaton, given as
tables, reads the UTF-8 of many texts in one scan and writes what each transition counts: a code point, the start of a
unit, the end of a sentinel. A second pass finds the drawn cuts among the counted starts.

The automaton's state follows from the last two bytes alone (``REACH``). So a scan may begin anywhere two bytes early,
and numpy takes all blocks of a piece one byte further at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.typing import NDArray
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import as_bytes, pieces

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: What a transition counts, as bits.
POINT, UNIT, SENTINEL = 1, 2, 4
#: Kinds of bytes. BEGIN is 0xFF, which UTF-8 never holds, put before each text.
SPACE, OPEN, LETTER, CLOSE, CONTINUED, BEGIN, OTHER = range(7)
#: States: nothing read, after white space, in a word, after ``<``, after ``<`` and one of the letters.
START, BLANK, WORD, OPENED, NAMED = range(5)
#: How many bytes back the state depends on, and bytes of a block that numpy takes along with the others.
REACH, BLOCK = 2, 256
U8 = NDArray[np.uint8]


def _tables() -> tuple[bytes, U8, U8]:
    """The kind of each byte, and for each state and kind (8 to a state) the next state and what the transition counts."""
    kinds = bytearray([OTHER] * 256)
    for kind, some in ((SPACE, b" \t\n\x0b\x0c\r"), (OPEN, b"<"), (LETTER, b"PSM"), (CLOSE, b">"), (CONTINUED, range(0x80, 0xC0)), (BEGIN, b"\xff")):
        for b in some:
            kinds[b] = kind
    after, counts = np.full((5, 8), WORD, np.uint8), np.full((5, 8), POINT, np.uint8)
    after[:, SPACE], after[:, OPEN], after[:, BEGIN] = BLANK, OPENED, START
    after[OPENED, LETTER] = NAMED
    counts[:, [CONTINUED, BEGIN]] = 0
    counts[[WORD, OPENED, NAMED], SPACE] |= UNIT  # the white space before the next word
    counts[START, [SPACE, OPEN, LETTER, CLOSE, OTHER]] |= UNIT
    counts[NAMED, CLOSE] |= SENTINEL
    return bytes(kinds), after.ravel(), counts.ravel()


KINDS, AFTER, COUNTS = _tables()


def scan(data: bytes, block: int = BLOCK) -> U8:
    """What the transition on each byte counts. ``data`` is texts, 0xFF before each; blocks are read side by side."""
    n = len(data)
    rows = max(1, -(-n // block))
    kinds = np.full(REACH + rows * block, BEGIN, np.uint8)
    kinds[REACH : REACH + n] = np.frombuffer(data.translate(KINDS), np.uint8)
    early = np.lib.stride_tricks.as_strided(kinds, (rows, REACH), (block, 1))
    state = np.full(rows, START, np.uint8)
    for j in range(REACH):
        state = AFTER[state << 3 | early[:, j]]
    columns = np.ascontiguousarray(kinds[REACH:].reshape(rows, block).T)
    out = np.empty_like(columns)
    for j in range(block):
        at = state << 3 | columns[j]
        out[j] = COUNTS[at]
        state = AFTER[at]
    return out.T.reshape(-1)[:n]


def drawn(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that follow from an id (null: none) and a seed."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))


def _cut(counted: U8, first: int, second: int) -> tuple[int, int]:
    """The bytes before unit ``first`` and before unit ``second`` of one text; past the last unit that is all of them."""
    starts = np.flatnonzero(counted & UNIT)
    return tuple(int(starts[k]) if k < len(starts) else len(counted) for k in (first, second))


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "spm":
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle if form == "psm" else prefix + middle + suffix


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of. Its parts hold no sentinel, so the first of each kind is the one put in."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    at, end = output.index(second), output.index(MIDDLE)
    one, other, middle = output[3:at], output[at + 3 : end], output[end + 3 :]
    return one + middle + other if form == "psm" else other + middle + one


def _examples(ids: list[int | None], texts: list[bytes], rate: int, spm: int, seed: int) -> Iterator[tuple[int, str, int | None, int | None, bytes]]:
    """``n, form, prefix_chars, middle_chars``, output of each text."""
    counted = scan(b"".join(x for t in texts for x in (b"\xff", t)))
    end = 0
    for doc_id, text in zip(ids, texts, strict=True):
        own = counted[end + 1 : end + 1 + len(text)]
        end += 1 + len(text)
        n = int(np.count_nonzero(own & UNIT))
        h1, h2, h3, h4 = drawn(doc_id, seed)
        if not text or h3 % 100 >= rate or np.any(own & SENTINEL):
            yield n, "plain", None, None, text
            continue
        form = "spm" if h4 % 100 < spm else "psm"
        a, b = _cut(own, *sorted((h1 % (n + 1), h2 % (n + 1))))
        yield n, form, int(np.count_nonzero(own[:a] & POINT)), int(np.count_nonzero(own[a:b] & POINT)), joined(form, text[:a], text[a:b], text[b:])


def transformed(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """The documents, all columns, with ``fim_text`` and ``fim_form`` (plain, psm, spm) after them.

    rate: of a hundred texts so many are cut; spm: of a hundred cut texts so many get the suffix first. What is drawn
    follows from ``doc_id`` and ``seed`` alone, so rows that share an id share their draws; a null id draws like an
    empty one. Null, empty texts and texts that hold a sentinel stay plain; a null text gives a null ``fim_text``.
    Columns of these two names are replaced.
    """
    kept = docs.drop("fim_text", "fim_form")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            there = piece.column("text").is_valid().to_pylist()
            ids = [None if x is None else int(x) for x in piece.column("doc_id").to_pylist()]
            made = list(_examples(ids, as_bytes(piece.column("text")), rate, spm, seed))
            new = pa.array([m[4].decode() if ok else None for m, ok in zip(made, there, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], new, pa.array([m[1] for m in made], pa.string())], [*names, "fim_text", "fim_form"])

    none = F.lit(None).cast("string")
    schema = kept.select("*", none.alias("fim_text"), none.alias("fim_form")).schema
    return kept.mapInArrow(run, schema)


def report(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """``doc_id, n`` (units)``, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of each document.

    Lengths are code points, null where the form is plain. The last hash is that of the text rebuilt from the output and
    its form. Nulls, repeated rows, empty and long texts: see ``transformed``; an empty table gives no rows, and other
    columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for piece in pieces(batches):
            made = _examples(piece.column("doc_id").to_pylist(), as_bytes(piece.column("text")), rate, spm, seed)
            rows = [(n, form, prefix, middle, sha(output), sha(restored(output, form))) for n, form, prefix, middle, output in made]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *cols], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
