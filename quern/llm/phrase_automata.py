"""Substring de-duplication by sharded Aho-Corasick automata over words.

1. Windows of ``n`` words are named by anchors, and those whose anchor recurs are hashed (see ``_repeats``). Windows are
   grouped by anchor and hash: those in more than one place are the recurring phrases, each with its first place.
2. Phrases are dealt to shards by anchor, about ``phrases`` of them in each; the words come from the first place's
   document. A shard takes its anchors in groups, numbers a group's words and compiles its phrases into one automaton
   over word numbers.
3. All documents stream through: each run of windows that may be phrases goes to the shard of its anchor, first places
   and copies alike, and the automaton locates every occurrence, word for word. Occurrences after the first are repeats.

Phrases of one anchor beyond ``phrases`` are parted over several shards, each of which sees the anchor's runs; shards
that more than ``stream`` runs would reach are copied, and each copy sees its part of the runs. So neither many phrases
nor many occurrences of one passage meet in one task.

Defined results: null texts have no words; rows without an id take no part and keep all words; rows that repeat id and
text get equal results; rows with one id and different texts are judged each by its own, where only an earlier place of
the same id precedes another; texts of under ``n`` words keep everything; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.typing import NDArray
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quern.llm._anchors import U64, grams, mixed
from quern.llm._bits import bit_set, holds
from quern.llm._common import as_bytes, cut, ids_and_texts, pieces, space_words
from quern.llm._repeats import PIECE, Unit, kept, recurring, spread, told_apart, with_spans

#: The letter of what is no word of an automaton, and the first number whose letter would be half a pair.
NO_WORD, SURROGATES = "\0", 0xD7FF
#: A shard's anchors in groups, an automaton for each, so that its nodes stay in a processor's cache.
GROUPS = 20


def _words(text: bytes) -> list[bytes]:
    return space_words(text, lower=False)


def _hashes(words: list[bytes]) -> U64:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


class Automaton:
    """The windows of some passages, each with its first place, over the numbers of their words.

    A word's number is written as a letter, so that texts are strings to the automaton; what stands for no word of the
    passages, and between texts, is in no window.
    """

    def __init__(self, passages: list[tuple[int, int, bytes]], n: int) -> None:
        self.n, self.letters = n, {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        docs, places = [], []
        for doc, at, text in passages:
            letters = self._written(text)
            for i in range(len(letters) - n + 1):
                self.found.add_word(letters[i : i + n], len(docs))
                docs.append(doc)
                places.append(at + i)
        self.docs, self.places = np.array(docs, np.int64), np.array(places, np.int64)
        self.found.make_automaton()

    def _written(self, text: bytes) -> str:
        letters = self.letters
        return "".join([letters.get(w) or letters.setdefault(w, chr(len(letters) + (1 if len(letters) < SURROGATES else 2049))) for w in text.split(b" ")])

    def repeats(self, docs: list[int], places: list[int], texts: list[bytes]) -> tuple[NDArray, NDArray, NDArray]:
        """The run, start and end of stretches of words that windows of an earlier place cover, for runs by document and place."""
        if not len(self.found):
            return (np.zeros(0, np.int64),) * 3
        get, n = self.letters.get, self.n
        written = ["".join([get(w, NO_WORD) for w in t.split(b" ")]) for t in texts]
        begins = np.cumsum([0, *(len(w) + 1 for w in written[:-1])])
        hits = np.array([*self.found.iter(NO_WORD.join(written))], np.int64).reshape(-1, 2)
        run = np.searchsorted(begins, hits[:, 0], "right") - 1
        doc, start = np.array(docs, np.int64)[run], np.array(places, np.int64)[run] + hits[:, 0] - begins[run] - n + 1
        first_doc, first_at = self.docs[hits[:, 1]], self.places[hits[:, 1]]
        later = (first_doc < doc) | (first_doc == doc) & (first_at < start)
        start, run = start[later], run[later]
        new = np.append(True, (run[1:] != run[:-1]) | (start[1:] > start[:-1] + n))[: len(run)]
        last = np.append(new[1:], True)[: len(run)]
        return run[new], start[new], start[last] + n


def _windows(docs: DataFrame, anchors: DataFrame, unit: Unit) -> DataFrame:
    """``anchor, window, doc_id, twin, at, times``: each document's windows whose anchor recurs (and a few others), by their first place in it.

    31 bits of the anchor are enough to deal them out.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(anchors.select("anchor")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            _, h, sizes, text, at, size, anchor, _ = unit.runs(as_bytes(piece.column("text")))
            keep = holds(bits.value, anchor)
            text, at, size, anchor = text[keep], at[keep], size[keep], anchor[keep]
            if not len(size):
                continue
            at, text, anchor = np.repeat(at, size) + spread(size), np.repeat(text, size), np.repeat(anchor, size)
            window = mixed(grams(h, unit.n))[(np.cumsum(sizes) - sizes)[text] + at]
            order = np.lexsort((at, window, text))
            at, text, anchor, window = at[order], text[order], anchor[order], window[order]
            first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (window[1:] != window[:-1])))
            cols = [(anchor[first] >> np.uint64(33)).astype(np.int32), window[first].view(np.int64), *(piece.column(c).to_numpy()[text[first]] for c in ("doc_id", "twin")), at[first].astype(np.int32), np.diff(np.append(first, len(at)))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["anchor", "window", "doc_id", "twin", "at", "times"])

    return docs.mapInArrow(find, "anchor int, window long, doc_id long, twin int, at int, times long")


@dataclass(frozen=True)
class Shards:
    """The shards of each bucket of anchors: in how many parts its phrases come, and how many copies of these there are."""

    parts: NDArray[np.int64]
    copies: NDArray[np.int64]

    def __post_init__(self) -> None:
        object.__setattr__(self, "base", np.cumsum(self.parts * self.copies) - self.parts * self.copies)

    def of_passage(self, bucket: int, salt: int) -> range:
        """All copies of one part."""
        first = int(self.base[bucket] + salt % self.parts[bucket] * self.copies[bucket])
        return range(first, first + int(self.copies[bucket]))

    def of_run(self, bucket: int, salt: int) -> range:
        """One copy of all parts."""
        first, step, n = int(self.base[bucket] + salt % self.copies[bucket]), int(self.copies[bucket]), int(self.parts[bucket])
        return range(first, first + step * n, step)


def _passages(firsts: pa.ListArray, n: int) -> tuple[NDArray, NDArray, NDArray, NDArray, NDArray]:
    """Document, bucket, anchor, start and end of the passages that documents' first places make: neighbours with one anchor."""
    rows = firsts.flatten()
    doc = np.repeat(np.arange(len(firsts)), pc.fill_null(pc.list_value_length(firsts), 0).to_numpy(zero_copy_only=False))
    anchor, at, bucket = (rows.field(c).to_numpy() for c in ("anchor", "at", "bucket"))
    order = np.lexsort((at, anchor, doc))
    doc, anchor, at, bucket = doc[order], anchor[order], at[order], bucket[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)]
    last = np.append(new[1:], True)[: len(at)]
    return doc[new], bucket[new], anchor[new], at[new], at[last] + n


def _stretches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Takes a shard's groups of anchors one after the other, their passages first: compiles these, then streams the runs through."""
    at, automaton = None, None
    passages: list[tuple[int, int, bytes]] = []
    for batch in (b for b in batches if b.num_rows):
        shard, group, run = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "group", "run"))
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (group[1:] != group[:-1]) | (run[1:] != run[:-1])) + 1
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "at", "text")]
        who = [(c, batch.column(c).to_numpy(zero_copy_only=False)) for c in ("doc_id", "twin") if c in batch.schema.names]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            rows = [c[lo:hi] for c in cols]
            if (shard[lo], group[lo]) != at:
                at, automaton, passages = (shard[lo], group[lo]), None, []
            if not run[lo]:
                passages += zip(*rows, strict=True)
                continue
            if automaton is None:
                automaton, passages = Automaton(passages, n), []
            row, start, end = automaton.repeats(*rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[lo + row]) for _, x in who), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], [*(c for c, _ in who), "start", "end"])


def removed(docs: DataFrame, n: int, k: int, phrases: int, stream: int, twins: bool) -> DataFrame:
    """``doc_id, twin, start, end``: stretches of words that are repeats. ``docs`` has ids, twins and texts; ``twins``: some are not 0."""
    unit = Unit(n, k, _words, _hashes, within=True)
    found = _windows(docs, recurring(docs, unit), unit).groupBy("anchor", "window")
    if twins:  # rows of one id have places of their own
        rows = found.agg(F.min(F.struct("doc_id", "at", "twin")).alias("first"), F.sum("times").alias("times")).select("anchor", "window", "first.*", "times")
    else:  # the same from plain numbers, which are aggregated without sorting
        rows = found.agg(F.min("doc_id").alias("doc_id"), F.min_by("at", "doc_id").alias("at"), F.sum("times").alias("times")).withColumn("twin", F.lit(0))
    recur = cut(rows.where("times > 1"))
    count = max(1, -(-recur.count() // phrases))
    bucket = F.pmod("anchor", F.lit(count)).cast("int").alias("bucket")
    parts, copies = np.ones(count, np.int64), np.ones(count, np.int64)
    for row in recur.groupBy(bucket).agg(F.count("*").alias("n"), F.sum("times").alias("times")).collect():  # a row for each ``phrases`` of them
        parts[row.bucket], copies[row.bucket] = -(-row.n // (2 * phrases)), -(-row.times // stream)
    shared = docs.sparkSession.sparkContext.broadcast((bit_set(recur.select("window")), Shards(parts, copies)))
    wanted = recur.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("anchor", "at", bucket)).alias("firsts"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``shard, group, run, doc_id, twin, at, text``: passages of the document's first places, and its runs of possible phrases."""
        bits, shards = shared.value
        for piece in pieces(batches, limit=PIECE):
            symbols, h, sizes, text, at, size, anchor, _ = unit.runs(as_bytes(piece.column("text")))
            ids, numbers = piece.column("doc_id").to_pylist(), piece.column("twin").to_pylist()
            out: list[tuple[int, int, bool, int, int, int, bytes]] = []
            for d, b, a, i, j in zip(*(x.tolist() for x in _passages(piece.column("firsts"), n)), strict=True):
                words = b" ".join(symbols[d][i:j])
                out += [(shard, a // count % GROUPS, False, ids[d], numbers[d], i, words) for shard in shards.of_passage(b, ids[d] + i)]
            if len(size):
                place, run = np.repeat(at, size) + spread(size), np.repeat(np.arange(len(size)), size)
                held = np.flatnonzero(holds(bits, mixed(grams(h, n))[(np.cumsum(sizes) - sizes)[text[run]] + place]))
                new = np.append(True, (run[held][1:] != run[held][:-1]) | (np.diff(held) > 1))[: len(held)]
                begin, end = held[new], held[np.append(new[1:], True)[: len(held)]]
                short = (anchor[run[begin]] >> np.uint64(33)).astype(np.int64)
                for a, d, i, j in zip(short.tolist(), text[run[begin]].tolist(), place[begin].tolist(), (place[end] + n).tolist(), strict=True):
                    words = b" ".join(symbols[d][i:j])
                    out += [(shard, a // count % GROUPS, True, ids[d], numbers[d], i, words) for shard in shards.of_run(a % count, ids[d] + i)]
            cols = zip(*out, strict=True) if out else [()] * 7
            dealt = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["shard", "group", "run", "doc_id", "twin", "at", "text"])
            yield dealt if twins else dealt.drop_columns(["twin"])

    twin = "twin int, " if twins else ""  # a column of zeros need not be shuffled
    rows = docs.join(wanted, ["doc_id", "twin"], "left").mapInArrow(deal, f"shard long, group int, run boolean, doc_id long, {twin}at int, text binary")
    found = rows.repartition("shard").sortWithinPartitions("shard", "group", "run").mapInArrow(lambda batches: _stretches(batches, n), f"doc_id long, {twin}start int, end int")
    return found if twins else found.withColumn("twin", F.lit(0))


def report(docs: DataFrame, n: int = 20, k: int = 8, phrases: int = 20_000, stream: int = 400_000, texts: bool = False) -> DataFrame:
    """Words, repeats removed and the digest of what is kept for each document (with ``texts``, the kept words too).

    k: words of an anchor; phrases: windows that an automaton holds, about; stream: windows that pass one automaton, about.
    """
    docs, twins = told_apart(ids_and_texts(docs))
    stretches = removed(docs.where("doc_id IS NOT NULL"), n, k, phrases, stream, twins)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = []
            given = [_words(text) for text in as_bytes(piece.column("text"))]
            for words, keep in zip(given, kept([len(words) for words in given], piece.column("spans")), strict=True):
                size = len(words)
                if keep is not None:
                    words = [words[i] for i in np.flatnonzero(keep)]
                left = b" ".join(words)
                out.append((size, size - len(words), hashlib.sha256(left).hexdigest(), left.decode() if texts else None))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *cols], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    whole = with_spans(docs, stretches).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return whole if texts else whole.drop("kept")
