"""What recurs in a corpus: the shared frame of the two substring operators.

Every window of ``n`` symbols (bytes or words) is named by its anchor (see ``_anchors``). Anchors are counted over all
documents; windows whose anchor occurs once are done. The recurring anchors also set the bits of a filter of bounded
size, which spares most runs the next shuffle and passes more of them as it fills up, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm._anchors import U64, runs
from quern.llm._common import as_bytes, cut, pieces

#: Bytes of text whose runs a task works out at a time.
PIECE = 256 << 10


@dataclass(frozen=True)
class Unit:
    """What windows are made of: a text's symbols, 64 bits for each, and whether a document repeats itself too."""

    n: int
    k: int
    read: Callable[[bytes], Sequence]
    hashes: Callable[[Sequence], U64]
    within: bool

    def runs(self, texts: list[bytes]) -> tuple:
        """The texts' symbols, all their hashes in a row, the texts' sizes, and the runs of windows with one anchor."""
        symbols = [self.read(t) for t in texts]
        sizes = np.array([len(s) for s in symbols], np.int64)
        h = np.concatenate([self.hashes(s) for s in symbols])
        return symbols, h, sizes, *runs(h, sizes, self.n, self.k, self.within)


def recurring(docs: DataFrame, unit: Unit) -> DataFrame:
    """``anchor, n``: those in more than one run (or document), and those that may hold a repeat within a run."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            _, _, _, text, _, _, anchor, twice = unit.runs(as_bytes(piece.column("text")))
            if not unit.within:
                order = np.lexsort((anchor, text))
                anchor, text = anchor[order], text[order]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                anchor = anchor[new]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(twice)], ["anchor", "twice"])

    if not unit.within:
        return cut(docs.mapInArrow(find, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    found = docs.mapInArrow(find, "anchor long, twice boolean")
    return cut(found.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 OR twice").select("anchor", "n"))


def told_apart(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The documents with ``twin``: a number that differs between texts which share an id, and is 0 as a rule; whether any do."""
    hashed = F.xxhash64("text").alias("_hash")
    seen = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b"))
    shared = cut(seen.where("a <> b").select("doc_id"))
    if not shared.limit(1).count():
        return docs.withColumn("twin", F.lit(0)), False
    texts = docs.join(shared, "doc_id", "left_semi").select("doc_id", hashed).distinct()
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("_hash"))  # an id's different texts
    twins = cut(texts.select(F.col("doc_id").alias("_id"), "_hash", number.alias("twin")))
    out = docs.join(twins, (docs.doc_id == twins._id) & (F.xxhash64(docs.text) == twins._hash), "left")
    return out.select("doc_id", "text", F.coalesce("twin", F.lit(0)).alias("twin")), True


def with_spans(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """The documents, each with the list ``spans`` of its own stretches (null: none).

    Those with ids are joined as phrase_automata joins them before, so that one exchange of their texts serves both there.
    """
    spans = stretches.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = docs.where("doc_id IS NOT NULL").join(spans, ["doc_id", "twin"], "left")
    return whole.unionByName(docs.where("doc_id IS NULL").withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int>>")))


def spread(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes in turn."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def kept(sizes: Sequence[int], spans: pa.ListArray) -> Iterator[np.ndarray | None]:
    """For each text of so many symbols a mark for each symbol that no span covers; None if there are no spans."""
    sizes = np.array(sizes, np.int64)
    ends = np.cumsum(sizes)
    number = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    rows, text = spans.flatten(), np.repeat(np.arange(len(sizes)), number)
    change = np.zeros(int(sizes.sum()) + 1, np.int32)
    for field, step in (("start", 1), ("end", -1)):
        np.add.at(change, (ends - sizes)[text] + np.minimum(rows.field(field).to_numpy(), sizes[text]), np.int32(step))
    free = np.cumsum(change[:-1], dtype=np.int32, out=change[:-1]) == 0
    for some, start, end in zip(number.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        yield free[start:end] if some else None
