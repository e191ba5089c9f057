"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample and indexes every row: each vector goes down to the leaf of the nearest
centres. A query walks the tree with a priority queue, best bin (largest inner product with the centre) first. It first
opens as many leaves as hold ``k`` rows of other ids, which gives its floor, the score of the ``k``-th best so far. It
then widens its visits to as many leaves as calibration found to reach the wanted recall on sample queries, less those
whose bound (inner product with the centre, plus the query's length times the leaf's radius) lies below the floor.

Leaves are searched where their vectors are: runs of leaves make cells of about ``cell`` vectors, a larger leaf is parted
over several, and a query is sent once to each cell that holds leaves of its, with their numbers. A task streams a cell's
vectors past the queries that came to it, ``block`` at a time, and keeps one running best ``k`` for each query over all
its cells, so that a query's rows follow the number of tasks and not that of leaves. Scores are inner products in double
precision, summed in the same order for equal vectors.

Defined results: vectors that are null, zero, of another length than the usual one, or hold null or non-finite
components take no part, nor do rows without an id; a query's own id is no candidate; rows that repeat an id are
candidates of their own, and one query, asked by each of their vectors: a candidate row counts once, by its best; ties
go to the smaller id; with fewer candidates all found are returned; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.typing import NDArray
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm._common import cut

Floats = NDArray[np.float64]


@dataclass
class Tree:
    """Nodes by number: centres, children (none for leaves), and the number of the leaf."""

    centres: list[Floats] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    stack: Floats | None = None
    leaves: int = 0
    visits: int = 1

    @classmethod
    def fit(cls, sample: Floats, leaves: int, branch: int = 8, seed: int = 1) -> Tree:
        """Splits the largest node into ``branch`` by k-means until there are ``leaves`` leaves or no node can be split."""
        tree, rng = cls(), np.random.default_rng(seed)
        tree._add(sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1]))
        heap, count = [(-len(sample), 0, np.arange(len(sample)))], 1
        while heap and count < leaves:
            _, node, rows = heapq.heappop(heap)
            wanted = min(branch, leaves - count + 1, len(rows))
            centres = _kmeans(sample[rows], wanted, rng)
            if len(centres) < 2:
                continue
            own = _nearest(sample[rows], centres)
            for c in range(len(centres)):
                child = tree._add(centres[c])
                tree.children[node].append(child)
                heapq.heappush(heap, (-int((own == c).sum()), child, rows[own == c]))
            count += len(centres) - 1
        for node, below in enumerate(tree.children):
            if not below:
                tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
        tree.stack = np.array(tree.centres)
        return tree

    def _add(self, centre: Floats) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centres) - 1

    def assign(self, x: Floats) -> tuple[NDArray[np.int32], Floats]:
        """The leaf of each vector, down by the nearest centre, and how far it is from the leaf's."""
        out, far = np.zeros(len(x), np.int32), np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows], far[rows] = self.leaf[node], np.sqrt(((x[rows] - self.centres[node]) ** 2).sum(axis=1))
                continue
            own = _nearest(x[rows], self.stack[self.children[node]])
            todo += [(c, rows[own == i]) for i, c in enumerate(self.children[node]) if (own == i).any()]
        return out, far

    def order(self, q: Floats) -> Iterator[tuple[int, float]]:
        """Leaves, best bin first, each with the inner product with its centre."""
        score = self.stack @ q
        heap = [(-score[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(heap, (-score[c], c))
            else:
                yield self.leaf[node], float(score[node])

    def search(self, q: Floats, rows: NDArray[np.int64], wanted: int) -> tuple[list[int], list[int], list[float]]:
        """The first leaves whose ``rows`` add up to ``wanted``, then the other ones to visit, with their products."""
        first, rest, products, seen = [], [], [], 0
        for leaf, score in self.order(q):
            if seen < wanted:
                first.append(leaf)
                seen += int(rows[leaf])
            elif len(first) + len(rest) < self.visits:
                rest.append(leaf)
                products.append(score)
            else:
                break
        return first, rest, products

    def calibrate(self, sample: Floats, k: int, recall: float, queries: int = 200) -> None:
        """Widens the visits until sample queries find ``recall`` of their ``k`` nearest in the sample."""
        asked = sample[: min(queries, len(sample))]
        if not len(asked):
            return
        leaf, scores = self.assign(sample)[0], asked @ sample.T
        np.fill_diagonal(scores, -np.inf)
        k = min(k, len(sample) - 1)
        if k < 1:
            self.visits = self.leaves
            return
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        # how many leaves a query must visit until it has seen the leaf of each of its nearest
        need = []
        for row, q in zip(near, asked, strict=True):
            order = {at: i + 1 for i, (at, _) in enumerate(self.order(q))}
            need += [order[int(x)] for x in leaf[row]]
        self.visits = int(np.quantile(need, recall, method="higher"))


def _nearest(x: Floats, centres: Floats) -> NDArray[np.int64]:
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _kmeans(x: Floats, k: int, rng: np.random.Generator, turns: int = 8) -> Floats:
    distinct = np.unique(x[rng.permutation(len(x))[: 50 * k]], axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(turns):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = sums[n > 0] / n[n > 0, None]
    return centres


def _matrix(column: pa.ListArray) -> Floats:
    """Rows of equal length, none of them null."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id long, vec`` (float or double components, as they came) of the rows that take part."""
    ok = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec")).where("vec_id IS NOT NULL").where(ok)


def _best(keys: NDArray[np.int64], vectors: Floats, ids: NDArray[np.int64], queries: Floats, k: int, low: Floats) -> tuple:
    """Each query's best ``k`` of the vectors that have another id and reach its ``low``: positions of queries and vectors, exact scores."""
    rough = queries @ vectors.T
    rough[ids[:, None] == keys[None, :]] = -np.inf
    top = min(k, len(keys))
    least = np.maximum(np.partition(rough, len(keys) - top, axis=1)[:, len(keys) - top], low)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    a, b = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
    score = (queries[a] * vectors[b]).sum(axis=1)
    order = np.lexsort((keys[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k], score[place < k]


def _by_id(ids: NDArray[np.int64], keys: NDArray[np.int64], a: NDArray[np.int64], b: NDArray[np.int64], score: Floats, k: int) -> tuple:
    """Each id's best ``k`` rows of what its vectors found, every row once."""
    order = np.lexsort((-score, b, ids[a]))
    a, b, score = a[order], b[order], score[order]
    once = np.append(True, (np.diff(ids[a]) != 0) | (np.diff(b) != 0))[: len(a)]
    a, b, score = a[once], b[once], score[once]
    order = np.lexsort((b, keys[b], -score, ids[a]))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(ids[a], ids[a])
    return a[place < k], b[place < k], score[place < k]


class _Best:
    """The running best ``k`` of each query id: positions are not kept, only ids and scores."""

    def __init__(self, k: int, most: int) -> None:
        self.k, self.most, self.parts, self.rows = k, most, [], 0

    def add(self, query: NDArray[np.int64], vec: NDArray[np.int64], score: Floats) -> None:
        self.parts.append((query, vec, score))
        self.rows += len(query)

    def shrink(self) -> pa.RecordBatch:
        """Each query's best so far, which stay as the only part."""
        query, vec, score = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.parts = [(query[keep], vec[keep], score[keep])]
        self.rows = int(keep.sum())
        return pa.RecordBatch.from_arrays([*map(pa.array, self.parts[0])], ["query_id", "vec_id", "score"])

    def full(self) -> Iterator[pa.RecordBatch]:
        """Gives the rows away once even the best alone are too many to hold."""
        if self.rows > 2 * self.most:
            out = self.shrink()
            if self.rows > self.most:
                self.parts, self.rows = [], 0
                yield out


def _cells(rows: NDArray[np.int64], cell: int, most: int) -> tuple[NDArray[np.int64], NDArray[np.int64]]:
    """Each leaf's first cell and number of cells: small leaves share one, large ones have several; ``most`` or so in all."""
    cell = max(cell, -(-int(rows.sum()) // most))
    first, parts, at, held = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), 0, 0
    for leaf, n in enumerate(rows.tolist()):
        if held and held + n > cell:
            at, held = at + 1, 0
        first[leaf], parts[leaf] = at, max(1, -(-n // cell))
        held += n
        if n > cell:
            at, held = at + int(parts[leaf]), 0
    return first, parts


def _found(indexed: DataFrame, asked: DataFrame, k: int, block: int, most: int = 1 << 20) -> DataFrame:
    """``query_id, vec_id, score``: the best rows of each query in the leaves that it visits.

    indexed: ``vec_id, vec, leaf, cell``; asked: ``vec_id, vec, cell, leaves`` (those of the cell)``, least`` (scores below
    it are of no use).
    """
    counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))  # one row for each cell, a bounded number
    queries = asked.join(F.broadcast(counts), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.lit(0).alias("side"), F.lit(-1).alias("leaf"), "vec_id", "vec", "leaves", "least")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    held = indexed.join(F.broadcast(counts), "cell").select("cell", part, F.lit(1).alias("side"), "leaf", "vec_id", "vec", F.lit(None).cast("array<int>").alias("leaves"), F.lit(None).cast("double").alias("least"))
    rows = queries.unionByName(held).repartition("cell", "part").sortWithinPartitions("cell", "part", "side", "leaf")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = _Best(k, most), None
        ids = queries = least = asks = None
        for batch in (b for b in batches if b.num_rows):
            cell, part, side, leaf = (batch.column(c).to_numpy() for c in ("cell", "part", "side", "leaf"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0) | (np.diff(leaf) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                some = batch.slice(lo, hi - lo)
                keys, x = some.column("vec_id").to_numpy(), _matrix(some.column("vec"))
                if side[lo] == 0:
                    new = [*some.column("leaves").to_pylist()]
                    if at == (cell[lo], part[lo]):  # more of the same group, from another batch
                        ids, queries, least, asks = np.append(ids, keys), np.concatenate([queries, x]), np.append(least, some.column("least").to_numpy()), asks + new
                    else:
                        at, ids, queries, least, asks = (cell[lo], part[lo]), keys, x, some.column("least").to_numpy(), new
                    visits: dict[int, list[int]] = {}
                    for i, leaves in enumerate(asks):
                        for a in leaves:
                            visits.setdefault(a, []).append(i)
                    repeated = len(np.unique(ids)) < len(ids)
                elif at == (cell[lo], part[lo]) and (who := visits.get(int(leaf[lo]))):
                    who = np.array(who)
                    step = max(1, (1 << 22) // len(who))
                    for i in range(0, len(keys), step):
                        own, vecs = keys[i : i + step], x[i : i + step]
                        a, b, score = _best(own, vecs, ids[who], queries[who], k, least[who])
                        if repeated:  # an id's other vectors, which meet the same rows here
                            a, b, score = _by_id(ids[who], own, a, b, score, k)
                        best.add(ids[who[a]], own[b], score)
                        yield from best.full()
        yield best.shrink()

    return rows.mapInArrow(find, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95, sample: int = 20_000, cell: int = 4096, max_cells: int = 20_000, block: int = 16_384) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of each row whose id is divisible by ``every``.

    sample bounds the vectors that fit and calibrate the tree; it has about as many leaves as the square root of the
    number of rows says (four sample vectors for each at least), so that walking the tree costs no more than searching a
    leaf. cell, max_cells: vectors of a cell and the most cells there are (they grow beyond that); block: queries that a
    task holds at a time; recall: what calibration must reach.
    """
    spark, usable = vectors.sparkSession, _usable(vectors)
    taken = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    lengths = np.array(taken.column("vec").combine_chunks().value_lengths().to_pylist(), np.int64)
    if not len(lengths):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(np.bincount(lengths).argmax())
    x = _matrix(taken.column("vec").combine_chunks().filter(pa.array(lengths == dim)))
    usable = usable.where(F.size("vec") == dim)
    total = usable.count()
    tree = Tree.fit(x, max(1, min(round(total**0.5), len(x) // 4)))
    tree.calibrate(x, k, recall)
    kind = dict(usable.dtypes)["vec"]
    shared = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, far = shared.value.assign(_matrix(batch.column("vec")))
                yield batch.append_column("leaf", pa.array(leaf, pa.int32())).append_column("far", pa.array(far))

    indexed = cut(usable.mapInArrow(index, f"vec_id long, vec {kind}, leaf int, far double"))
    rows, radius = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves)
    for row in indexed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each leaf of the bounded tree
        rows[row.leaf], radius[row.leaf] = row.n, row.far
    first, parts = _cells(rows, cell, max_cells)
    of_leaf = F.broadcast(spark.createDataFrame(pa.table({"leaf": pa.array(range(tree.leaves), pa.int32()), "first": first, "cells": parts})))
    indexed = indexed.join(of_leaf, "leaf").select("vec_id", "vec", "leaf", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "cells")).alias("cell"))
    queries = usable.where(F.col("vec_id") % every == 0).groupBy("vec_id", "vec").agg(F.count("*").alias("n"))
    queries = queries.join(queries.groupBy("vec_id").agg(F.sum("n").alias("own")), "vec_id").select("vec_id", "vec", "own")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, own = _matrix(batch.column("vec")), batch.column("own").to_pylist()
                seen = [shared.value.search(q, rows, k + n) for q, n in zip(x, own, strict=True)]
                bounds = [np.array(products) + np.sqrt(q @ q) * radius[rest] * (1 + 1e-9) + 1e-9 for q, (_, rest, products) in zip(x, seen, strict=True)]
                lists = lambda values, kind: pa.array(values, pa.list_(kind))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), lists([s[0] for s in seen], pa.int32()), lists([s[1] for s in seen], pa.int32()), lists(bounds, pa.float64())], ["vec_id", "vec", "near", "more", "bounds"])

    walked = cut(queries.mapInArrow(walk, f"vec_id long, vec {kind}, near array<int>, more array<int>, bounds array<double>"))

    # all vectors of one id open the same leaves first, so that a row found then is not found again
    nearby = walked.select("vec_id", F.explode("near").alias("leaf")).distinct().groupBy("vec_id").agg(F.collect_list("leaf").alias("near"))
    walked = walked.drop("near").join(nearby, "vec_id")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and cell of what it visits, with the leaves there."""
        for batch in batches:
            at, cells, inside = [], [], []
            for i, leaves in enumerate(batch.column("leaves").to_pylist()):
                own: dict[int, list[int]] = {}
                for leaf in leaves:
                    for c in range(int(first[leaf]), int(first[leaf] + parts[leaf])):
                        own.setdefault(c, []).append(leaf)
                at += [i] * len(own)
                cells += own
                inside += own.values()
            row = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("vec_id", "vec", "least")), pa.array(cells, pa.int64()), pa.array(inside, pa.list_(pa.int32()))], ["vec_id", "vec", "least", "cell", "leaves"])

    asked = lambda q: cut(q.select("vec_id", "vec", "least", "leaves").mapInArrow(deal, f"vec_id long, vec {kind}, least double, cell long, leaves array<int>"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    low = float("-inf")
    seeds = asked(walked.withColumnRenamed("near", "leaves").withColumn("least", F.lit(low)))
    near = cut(_found(indexed, seeds, k, block).withColumn("rank", rank).where(F.col("rank") <= k))
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    rest = walked.join(floors, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(low)))
    rest = rest.withColumn("leaves", F.expr("transform(filter(arrays_zip(more, bounds), x -> x.bounds >= least AND NOT array_contains(near, x.more)), x -> x.more)"))
    found = near.drop("rank").unionByName(_found(indexed, asked(rest), k, block))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
