"""Benchmark decontamination by a broadcast set of hashed n-grams.

Every item's windows of ``n`` consecutive words (one window of all its words, if it has fewer) are hashed into a set
that goes to all tasks. Tasks slide over the words of whole documents, look window hashes up in the set, verify hits
word for word, and mark every word inside a hit. Windows are counted first: the set takes some 20 bytes for each and the
benchmark's words, so it is broadcast while there are at most ``max_windows``; a larger benchmark is joined with the
documents' windows through a shuffle instead, with the same results.

Defined results: null texts have no words; documents keep one row each, repeated ids and null ids included, and each is
judged by its own text; items with a null id or no words are ignored; items that share an id count once; other columns
are ignored by ``report`` and kept by the others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.typing import NDArray
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quern.llm._anchors import U64, grams, mixed
from quern.llm._common import alnum_words, as_bytes, pieces

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"
#: Windows of the largest benchmark that is broadcast: 2 million take about 40 MB and the words' bytes.
MAX_WINDOWS = 2_000_000
#: Slots of the table that tells most windows apart from the set's at once.
SLOTS = 1 << 22


def _hashes(words: list[bytes]) -> U64:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass
class Windows:
    """The windows of one length: their hashes in order, where each starts and ends in the words' bytes, its item's number."""

    hashes: U64
    start: NDArray[np.int64]
    end: NDArray[np.int64]
    item: NDArray[np.int32]


@dataclass
class GramSet:
    """Windows by length, the items' words in a row (parted by spaces) that verify hits, and the items' ids."""

    by_size: dict[int, Windows]
    words: bytes
    ids: list[str]

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], n: int) -> GramSet:
        parts: dict[int, list[tuple]] = {}
        words, ids, length = [], [], 0
        for item, text in rows:
            own = alnum_words((text or "").encode())
            if item is None or not own:
                continue
            size = min(n, len(own))
            sizes = np.array([len(w) for w in own], np.int64)
            begin = length + np.cumsum(sizes + 1) - (sizes + 1)
            parts.setdefault(size, []).append((mixed(grams(_hashes(own), size)), begin[: len(own) - size + 1], (begin + sizes)[size - 1 :], np.full(len(own) - size + 1, len(ids), np.int32)))
            words.append(b" ".join(own))
            ids.append(str(item))
            length += len(words[-1]) + 1
        by_size = {}
        for size, found in parts.items():
            hashes, start, end, item = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            by_size[size] = Windows(hashes[order], start[order], end[order], item[order])
        return cls(by_size, b" ".join(words), ids)

    def maybe(self, size: int) -> NDArray[np.bool_]:
        """The slots that some window of this length has; made once in each process."""
        if not hasattr(self, "_slots"):
            self._slots: dict[int, NDArray[np.bool_]] = {}
        if size not in self._slots:
            self._slots[size] = np.zeros(SLOTS, bool)
            self._slots[size][self.by_size[size].hashes & np.uint64(SLOTS - 1)] = True
        return self._slots[size]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_slots"}

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """For each text: its number of words, a mark for each word inside a verified hit, the items found."""
        words = [alnum_words(t) for t in texts]
        sizes = np.array([len(w) for w in words])
        h = np.concatenate([_hashes(w) for w in words])
        starts = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(texts)), sizes)
        change = np.zeros(len(h) + 1, np.int32)
        found: dict[int, set[str]] = {}
        for size, have in self.by_size.items():
            if len(h) < size:
                continue
            keys = mixed(grams(h, size))
            at = np.flatnonzero(self.maybe(size)[keys & np.uint64(SLOTS - 1)] & (text[: len(keys)] == text[size - 1 :]))
            low, high = np.searchsorted(have.hashes, keys[at], "left"), np.searchsorted(have.hashes, keys[at], "right")
            for i, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                d = int(text[i])
                gram = b" ".join(words[d][i - starts[d] : i - starts[d] + size])
                names = {self.ids[have.item[k]] for k in range(a, b) if self.words[have.start[k] : have.end[k]] == gram}  # the hit, word for word
                if names:
                    change[i] += 1
                    change[i + size] -= 1
                    found.setdefault(d, set()).update(names)
        hit = np.cumsum(change) > 0
        for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
            yield int(size), hit[start : start + size], found.get(k, set())


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _judged(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _sql_words(c: str) -> Column:
    return F.expr(f"filter(split(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', ' '), ' '), w -> w != '')")


def _small(benchmark: DataFrame, n: int, max_windows: int) -> bool:
    """Whether the items' windows, words and ids are few enough; an item's words count in full."""
    size = F.size(_sql_words("text")) + 1
    return benchmark.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= max_windows


def _broadcast(docs: DataFrame, benchmark: DataFrame, n: int):
    return docs.sparkSession.sparkContext.broadcast(GramSet.of([tuple(r) for r in benchmark.select("item_id", "text").collect()], n))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row for each document: words, words inside hits (their spans too, by word), items found, the verdict."""
    if not _small(benchmark, n, max_windows):
        return _report_by_join(docs, benchmark, n).drop("_text")
    found = _broadcast(docs, benchmark, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for n_words, hit, items in found.value.scan(as_bytes(piece.column("text"))):
                n_hit = int(hit.sum())
                names = ",".join(sorted(items))
                rows.append((n_words, n_hit, len(items), hashlib.sha256(names.encode()).hexdigest(), _judged(n_words, n_hit), _spans(hit)))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *cols], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)


def _report_by_join(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The same rows, and the texts' hashes as ``_text``, for a benchmark of any size; rows of one id and text are worked out once."""
    windows = lambda size: F.expr(f"transform(sequence(0, greatest(size(words) - {size}, 0)), i -> struct(i AS at, array_join(slice(words, i + 1, {size}), ' ') AS gram))")
    items = benchmark.select("item_id", _sql_words("text").alias("words")).where("item_id IS NOT NULL AND size(words) > 0")
    items = items.select("item_id", F.least(F.size("words"), F.lit(n)).alias("size"), "words").select("item_id", "size", F.explode(windows("size")).alias("g")).select("item_id", "size", "g.gram").distinct()
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # n numbers at most
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), _sql_words("coalesce(text, '')").alias("words"))
    keyed = keyed.groupBy("doc_id", "_text", "words").agg(F.count("*").alias("_copies"))
    seen = keyed.select("doc_id", "_text", "words", F.explode(F.array(*[F.lit(s) for s in sizes] or [F.lit(n)])).alias("size")).where("size(words) >= size")
    hits = seen.select("doc_id", "_text", "size", F.explode(windows("size")).alias("g")).select("doc_id", "_text", "size", "g.at", "g.gram").join(items, ["size", "gram"])
    hits = hits.groupBy("doc_id", "_text").agg(F.collect_set("item_id").alias("ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(at, at + size - 1)"))))).alias("hit"))
    ids = F.expr("array_sort(transform(coalesce(ids, array()), x -> string(x)))")
    n_hit = F.coalesce(F.size("hit"), F.lit(0)).cast("long")
    none = F.expr("cast(array() AS array<int>)")
    at = F.coalesce("hit", none)
    edges = lambda step: F.filter(at, lambda x: ~F.array_contains(at, x + step))
    spans: Column = F.arrays_zip(edges(F.lit(-1)).alias("start"), F.transform(edges(F.lit(1)), lambda x: x + 1).alias("end"))
    out = keyed.alias("k").join(hits.alias("h"), F.col("k.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("k._text") == F.col("h._text")), "left")
    out = out.select("k.doc_id", F.size("words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), spans.alias("spans"), "_copies", F.col("k._text").alias("_text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"), "spans", "_text", F.explode(F.expr("sequence(1, _copies)")).alias("_")).drop("_")


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents, all columns, without those that the benchmark contaminates."""
    return _edited(docs, benchmark, n, max_windows, cut=False)


def drop_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents with every hit passage cut from ``text`` (bytes from its first word to its last)."""
    return _edited(docs, benchmark, n, max_windows, cut=True)


def _edited(docs: DataFrame, benchmark: DataFrame, n: int, max_windows: int, cut: bool) -> DataFrame:
    names, at = docs.columns, docs.columns.index("text")
    texts = lambda old, new: pa.array([t.decode() if there else None for t, there in zip(new, old.is_valid().to_pylist(), strict=True)], pa.string())
    if not _small(benchmark, n, max_windows):
        judged = _report_by_join(docs, benchmark, n).select("doc_id", "_text", "contaminated", "spans").distinct().alias("j")
        keyed = docs.select(F.struct(*docs.columns).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
        both = keyed.join(judged, F.col("d.doc_id").cast("long").eqNullSafe(F.col("j.doc_id")) & (keyed._text == F.col("j._text")), "left")
        if not cut:
            return both.where("NOT contaminated").select("d.*")

        def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches):
                old = piece.column("text")
                yield piece.set_column(at, "text", texts(old, [_without(t, s or []) for t, s in zip(as_bytes(old), piece.column("_spans").to_pylist(), strict=True)])).select(names)

        return both.select("d.*", F.col("spans").alias("_spans")).mapInArrow(without, docs.schema)
    found = _broadcast(docs, benchmark, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            old = piece.column("text")
            own = as_bytes(old)
            marks = list(found.value.scan(own))
            if cut:
                yield piece.set_column(at, "text", texts(old, [_without(t, _spans(hit)) for t, (_, hit, _) in zip(own, marks, strict=True)]))
            else:
                yield piece.filter(pa.array([not _judged(n_words, int(hit.sum())) for n_words, hit, _ in marks], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def _without(text: bytes, spans: list[dict]) -> bytes:
    if not spans:
        return text
    words = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    out, last = [], 0
    for span in spans:
        out.append(text[last : words[span["start"]][0]])
        last = words[span["end"] - 1][1]
    return b"".join([*out, text[last:]])
