"""Suffix-array de-duplication of bytes by the difference-cover algorithm.

1. Windows of ``n`` bytes are named by anchors; runs of windows whose anchor recurs in another document go on (see
   ``_repeats``).
2. Runs with equal bytes (128 bits of a hash of them all) make one passage with its first document; all windows of runs
   in later documents are repeats. Anchors with other passages too send each passage's first occurrence on.
3. Passages are dealt to shards by anchor, so that suffixes which can share their first ``n`` bytes meet. A shard takes
   whole anchors up to a bounded number of bytes at a time and sorts its suffixes by the difference cover: eight bytes
   are packed into a symbol, triples of symbols at places 1 and 2 modulo 3 are sorted and named, the string of names is
   sorted by recursion, the remaining suffixes follow from the next one's rank and are merged in, and neighbours in the
   order are compared byte for byte by their first ``n`` bytes. Runs of neighbours that agree are the occurrences of one
   string. As only the first ``n`` bytes count, the recursion ends when names cover that many.
4. Anchors with more than ``hot`` distinct passages, which could be too many for a task, skip the shards: their windows
   are grouped as rows, byte for byte.

Defined results: null texts are empty; rows without an id take no part and keep all bytes; rows that repeat id and
text get equal results; rows with one id and different texts are judged each by its own, and none repeats another of
the same id; texts of under ``n`` bytes keep everything; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.typing import NDArray
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from quern.llm._anchors import mixed
from quern.llm._bits import bit_set, holds
from quern.llm._common import as_bytes, cut, ids_and_texts, pieces
from quern.llm._repeats import PIECE, Unit, kept, recurring, spread, told_apart, with_spans

Ints = NDArray[np.int64]
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
#: One passage: its document, where it starts, its bytes.
Passage = tuple[int, int, bytes]


def _hashes(text: bytes) -> NDArray[np.uint64]:
    return BYTES[np.frombuffer(text, np.uint8)]


def _dense(x: NDArray) -> Ints:
    """The dense rank of each value."""
    order = np.argsort(x)
    y = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.append(False, y[1:] != y[:-1])[: len(x)])
    return out


def _packed(*columns: Ints) -> Ints:
    """One number for each row, in the rows' order; columns that are too wide for that are named first."""
    out = columns[0]
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if int(out.max(initial=0)) >= (1 << 62) // width:
            out = _dense(out)
        out = out * width + column
    return out


def ranks(s: Ints, depth: int) -> Ints:
    """The dense rank of each suffix of ``s`` (symbols from 1 on); suffixes that agree in ``depth`` symbols may tie."""
    size = len(s)
    if size < 3 or depth <= 3:
        return _dense(_packed(s, np.append(s[1:], 0)[:size], np.append(s[2:], [0, 0])[:size]))
    s = np.append(s, [0, 0, 0, 0])
    one, two, rest = np.arange(1, size + 1, 3), np.arange(2, size + 1, 3), np.arange(0, size, 3)
    sample = np.concatenate([one, two])
    names = _dense(_packed(s[sample], s[sample + 1], s[sample + 2])) + 1
    if int(names.max()) < len(names):
        # the names of the places 1, 4, ... and of 2, 5, ..., parted by the least symbol
        below = ranks(np.concatenate([names[: len(one)], [0], names[len(one) :]]) + 1, -(-depth // 3))
        names = _dense(np.delete(below, len(one))) + 1
    rank = np.zeros(size + 4, np.int64)
    rank[sample] = names
    order = np.sort(names)
    # the others, by their first symbol and the rank after it; against places 1 so too, against places 2 by one symbol more
    width = len(rest)
    against_one = _packed(np.concatenate([s[rest], s[one]]), np.concatenate([rank[rest + 1], rank[one + 1]]))
    against_two = _packed(np.concatenate([s[rest], s[two]]), np.concatenate([s[rest + 1], s[two + 1]]), np.concatenate([rank[rest + 2], rank[two + 2]]))
    sort = np.argsort(against_one[:width])  # in order, look-ups stay near each other
    less, upto = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for keys in (against_one, against_two):
        there, own = np.sort(keys[width:]), keys[:width][sort]
        less += np.searchsorted(there, own, "left")
        upto += np.searchsorted(there, own, "right")
    mine = against_one[:width][sort]
    place = np.cumsum(np.append(False, mine[1:] != mine[:-1]))
    slot = np.where(less < upto, 2 * order[np.minimum(less, len(order) - 1)] + 1, 2 * np.append(order, order[-1] + 1)[less])
    key = np.empty(size + 1, np.int64)
    key[sample] = (2 * names + 1) * (width + 1)
    key[rest[sort]] = slot * (width + 1) + np.where(less < upto, 0, place + 1)
    return _dense(key[:size])


def eights(text: bytes, n: int) -> NDArray[np.uint64]:
    """The eight bytes from each place on as a number, zeros standing after the end, and ``n`` more."""
    padded = np.frombuffer(text + bytes(n + 8), np.uint8)
    out = np.zeros(len(text) + n, np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i : i + len(out)].astype(np.uint64)
    return out


def suffix_ranks(eight: NDArray[np.uint64], n: int) -> Ints:
    """The rank of each suffix by its first ``n`` bytes at least, from the eight bytes at each place as symbols.

    The suffix at a place reads every eighth symbol: eight strings, parted by the least symbol, hold them all.
    """
    size = len(eight) - n
    symbols = np.append(_dense(eight[:size]) + 2, 1)
    where = np.concatenate([np.append(np.arange(r, size, 8), size) for r in range(8)])
    out = np.empty(size + 1, np.int64)
    out[where] = ranks(symbols[where], -(-n // 8))
    return out[:size]


def same_before(eight: NDArray[np.uint64], order: Ints, n: int) -> NDArray[np.bool_]:
    """For each suffix in the order whether it agrees with the one before it in the first ``n`` (at least 8) bytes."""
    alive = np.arange(1, len(order))
    for i in [*range(0, n - 7, 8), n - 8]:
        alive = alive[eight[order[alive] + i] == eight[order[alive - 1] + i]]
    out = np.zeros(len(order), bool)
    out[alive] = True
    return out


def locate(rows: list[Passage], n: int) -> tuple[Ints, Ints]:
    """The windows of ``n`` bytes (at least 8) that a smaller document holds too: their passages, and places in the document."""
    text = b"".join([t for _, _, t in rows])
    sizes = np.array([len(t) for _, _, t in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    offset = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[row]
    eight = eights(text, n)
    rank = suffix_ranks(eight, n)
    whole = np.flatnonzero(offset + n <= sizes[row])  # windows do not leave their passage
    order = whole[np.argsort(rank[whole])]
    group = np.cumsum(~same_before(eight, order, n)) - 1
    docs = np.array([d for d, _, _ in rows], np.int64)[row[order]]
    first = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, group, docs)
    again = np.sort(order[docs > first[group]])
    return row[again], np.array([at for _, at, _ in rows], np.int64)[row[again]] + offset[again]


def _found(docs: DataFrame, anchors: DataFrame, unit: Unit) -> DataFrame:
    """``anchor, passage, check, doc_id, twin, at, windows``: the runs of recurring anchors, and of a few others."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(anchors.select("anchor")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            symbols, _, _, text, at, size, anchor, _ = unit.runs(as_bytes(piece.column("text")))
            keep = np.flatnonzero(holds(bits.value, anchor))
            text, at, size, anchor = text[keep], at[keep], size[keep], anchor[keep]
            hashed = b"".join([xxh3_128_digest(symbols[t][a:b]) for t, a, b in zip(text.tolist(), at.tolist(), (at + size + unit.n - 1).tolist(), strict=True)])
            passage = np.frombuffer(hashed, np.int64).reshape(-1, 2)
            ids, twins = (piece.column(c).to_numpy()[text] for c in ("doc_id", "twin"))
            cols = [anchor.view(np.int64), passage[:, 0], passage[:, 1], ids, twins, at.astype(np.int32), size.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["anchor", "passage", "check", "doc_id", "twin", "at", "windows"])

    return docs.mapInArrow(find, "anchor long, passage long, check long, doc_id long, twin int, at int, windows int")


def _marked(found: DataFrame, hot: int, heavy: bool) -> DataFrame:
    """``anchor, doc_id, twin, at, windows, copy, hot``: copies, and first occurrences whose anchor has other passages too.

    All of an anchor's runs are looked at together, by windows; those of ``heavy`` anchors, which may be too many for a
    task, by aggregates that combine before the shuffle and joins that Spark splits.
    """
    key = ["anchor", "passage", "check"]
    is_copy = F.col("doc_id") > F.col("first")
    if heavy:
        out = found.join(found.groupBy(*key).agg(F.min("doc_id").alias("first")), key).withColumn("copy", is_copy)
        kinds = out.where("NOT copy").groupBy("anchor").agg(F.min("passage").alias("a"), F.max("passage").alias("b"), F.count("*").alias("kinds"))
        out = out.join(kinds, "anchor")
    else:
        by = W.partitionBy("anchor")
        out = found.repartition("anchor").withColumn("first", F.min("doc_id").over(W.partitionBy(*key))).withColumn("copy", is_copy)
        out = out.select("*", F.min("passage").over(by).alias("a"), F.max("passage").over(by).alias("b"), F.sum(F.when(~F.col("copy"), 1).otherwise(0)).over(by).alias("kinds"))
    return out.where("copy OR a <> b").select("anchor", "doc_id", "twin", "at", "windows", "copy", (F.col("kinds") > hot).alias("hot"))


def _shard(batches: Iterator[pa.RecordBatch], n: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Takes passages in order of anchor, whole anchors until ``limit`` bytes are there, and yields the repeated stretches."""
    rows: list[Passage] = []
    twins: list[int] = []
    held, last = 0, None

    def flush() -> pa.RecordBatch:
        row, place = locate(rows, n)
        new = np.append(True, (row[1:] != row[:-1]) | (place[1:] > place[:-1] + n))[: len(row)]
        start, end = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(row)) - 1
        docs, own = np.array([d for d, _, _ in rows], np.int64)[row[start]], np.array(twins, np.int32)[row[start]]
        rows.clear()
        twins.clear()
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(own), pa.array(place[start].astype(np.int32)), pa.array((place[end] + n).astype(np.int32))] if len(start) else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32())], ["doc_id", "twin", "start", "end"])

    for batch in batches:
        for anchor, doc, twin, at, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "twin", "at", "text")), strict=True):
            if held >= limit and anchor != last:
                yield flush()
                held = 0
            rows.append((doc, at, text))
            twins.append(twin)
            held, last = held + len(text), anchor
    if rows:
        yield flush()


def removed(docs: DataFrame, n: int, k: int, hot: int, limit: int, heavy: int) -> DataFrame:
    """``doc_id, twin, start, end``: stretches of bytes that are repeats. ``docs`` has ids, twins and texts."""
    unit = Unit(n, k, bytes, _hashes, within=False)
    anchors = recurring(docs, unit)
    found = _found(docs, anchors, unit)
    crowded = anchors.where(F.col("n") > heavy).select("anchor")
    if crowded.limit(1).count():
        found = cut(found)
        crowded = _marked(found.join(crowded, "anchor", "left_semi"), hot, heavy=True).unionByName(_marked(found.join(crowded, "anchor", "left_anti"), hot, heavy=False))
        marked = cut(crowded)
    else:
        marked = cut(_marked(found, hot, heavy=False))
    copies = marked.where("copy").select("doc_id", "twin", F.col("at").alias("start"), F.expr(f"at + windows + {n - 1}").alias("end"))
    first = marked.where("NOT copy")
    wanted = first.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("anchor", "at", "windows", "hot")).alias("runs"))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            texts, own = as_bytes(piece.column("text")), piece.column("runs")
            row = np.repeat(np.arange(len(own)), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))
            anchor, at, windows, crowd = (own.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "at", "windows", "hot"))
            # a hot anchor's windows are rows of their own
            number = np.where(crowd, windows, 1)
            run = np.repeat(np.arange(len(row)), number)
            start = at[run] + spread(number)
            end = start + np.where(crowd, 1, windows)[run] + n - 1
            part = [texts[i][a:b] for i, a, b in zip(row[run].tolist(), start.tolist(), end.tolist(), strict=True)]
            ids, twins = (piece.column(c).to_numpy()[row[run]] for c in ("doc_id", "twin"))
            cols = [pa.array(x) for x in (anchor[run], ids, twins, start.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(part, pa.binary()), pa.array(crowd[run])], ["anchor", "doc_id", "twin", "at", "text", "hot"])

    text = docs.join(wanted, ["doc_id", "twin"], "left").mapInArrow(passages, "anchor long, doc_id long, twin int, at int, text binary, hot boolean")
    text = cut(text)  # three branches read them if anchors are hot; work and shuffles grow alike if not
    sharded = text.where("NOT hot").repartition("anchor").sortWithinPartitions("anchor")
    out = copies.unionByName(sharded.mapInArrow(lambda batches: _shard(batches, n, limit), "doc_id long, twin int, start int, end int"))
    if first.where("hot").limit(1).count():
        windows = text.where("hot")
        earliest = windows.groupBy("text").agg(F.min("doc_id").alias("first"))
        out = out.unionByName(windows.join(earliest, "text").where("doc_id > first").select("doc_id", "twin", F.col("at").alias("start"), F.expr(f"at + {n}").alias("end")))
    return out


def report(docs: DataFrame, n: int = 50, k: int = 20, hot: int = 5000, limit: int = 512 << 10, heavy: int = 100_000, texts: bool = False) -> DataFrame:
    """Bytes, bytes and stretches removed, and the digest of what is kept for each document (with ``texts``, those bytes too).

    k: bytes of an anchor; limit: bytes of whole anchors that a shard takes at a time; hot: distinct passages of an
    anchor, heavy: its runs, beyond which it is not dealt to one task (same rows, another way, see above).
    """
    docs, _ = told_apart(ids_and_texts(docs))
    stretches = removed(docs.where("doc_id IS NOT NULL"), n, k, hot, limit, heavy)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = []
            given = as_bytes(piece.column("text"))
            for text, keep in zip(given, kept([len(text) for text in given], piece.column("spans")), strict=True):
                left, stretches = text, 0
                if keep is not None:
                    left = np.frombuffer(text, np.uint8)[keep].tobytes()
                    stretches = int((~keep[1:] & keep[:-1]).sum()) + int(not keep[0])
                out.append((len(text), len(text) - len(left), stretches, hashlib.sha256(left).hexdigest(), left if texts else None))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = with_spans(docs, stretches).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return whole if texts else whole.drop("kept")
