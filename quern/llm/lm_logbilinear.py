"""Log-bilinear language model, trained by noise-contrastive estimation in numpy.

Words are counted over all training texts. Frequent words and the end of a text are classes of their own; any other
word belongs to the class of its last three bytes. There are more classes of both kinds the more distinct words there
are (by the cube root, so that normalising stays affordable). The model predicts the class of a token from the classes of
the two before it: position-dependent matrices map the context's vectors to a predicted vector, whose products with all
class vectors give scores. Training is one pass over all training texts, against noise drawn from the class frequencies:
texts are dealt to folds of a few million tokens by a hash of the row, each fold is learnt in the order of that hash, from
a common start that is itself learnt from the first texts of fold 0, and the folds' parameters are averaged, groups of
folds first. So the result does not depend on how rows are partitioned. Scoring normalises over all classes by batched
matrix products, once for each context, and within a class by smoothed counts, so that word probabilities are normalised
too.

Defined results: null texts are empty and score their end alone; rows keep one result each; rows without an id teach
and are not held out; rows that repeat teach as often as they stand there and get equal results; without training texts
all counts are 0; other columns are ignored. The same rows give the same scores, and equal texts equal ones to the
last bit, however they are dealt (``Exact``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from numpy.typing import NDArray
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import as_bytes, cut, pieces, space_words

Floats = NDArray[np.float32]
#: The end of a text as a token; no word holds a space.
END = b" "
NAMES = ("r", "t", "b", "a1", "a2")


@dataclass
class Classes:
    """Classes of tokens: ``own`` words (END is 0) and ``buckets`` of other words; counts of the most frequent words."""

    own: dict[bytes, int]
    buckets: int
    known: dict[bytes, int]
    class_of: NDArray[np.int32]
    counts: NDArray[np.int64]
    weight: NDArray[np.float64]
    types: NDArray[np.int64]

    @property
    def size(self) -> int:
        return len(self.own) + self.buckets

    def of(self, word: bytes) -> int:
        return self.own.get(word, len(self.own) + crc32(word[-3:]) % self.buckets)

    def tokens(self, text: bytes) -> tuple[list[bytes], NDArray[np.int64], NDArray[np.int32]]:
        """The words and the end; for each its place among known words (or -1) and its class."""
        words = [*space_words(text), END]
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        classes = self.class_of[at]
        for i in np.flatnonzero(at < 0):
            classes[i] = self.of(words[i])
        return words, at, classes

    def within(self) -> NDArray[np.float64]:
        """For each class the log10 of what counts within it are divided by; 0 where a class is one word."""
        out = np.zeros(self.size)
        out[len(self.own) :] = np.log10(self.weight[len(self.own) :] + 0.5 * (self.types[len(self.own) :] + 1))
        return out


class Model(dict):
    """Parameters by name: r, t (vectors of classes as context and target), b, a1, a2 (the matrices of both positions)."""

    @classmethod
    def start(cls, noise: NDArray[np.float64], dim: int, seed: int = 1) -> Model:
        rng, size = np.random.default_rng(seed), len(noise)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(r=small(size, dim), t=small(size, dim), b=np.log(noise).astype(np.float32), a1=np.eye(dim, dtype=np.float32), a2=np.eye(dim, dtype=np.float32) * np.float32(0.5))

    def predicted(self, c1: NDArray, c2: NDArray) -> Floats:
        return self["r"][c1] @ self["a1"] + self["r"][c2] @ self["a2"]


class Trainer:
    """Noise-contrastive steps by AdaGrad; the noise samples of a batch are shared by its tokens."""

    def __init__(self, model: Model, noise: NDArray[np.float64], samples: int = 64, rate: float = 0.1, seed: int = 1) -> None:
        self.m = Model({k: v.copy() for k, v in model.items()})
        self.noise, self.samples, self.rate = np.log(noise * samples).astype(np.float32), samples, rate
        self.cumulative, self.rng, self.seen = np.cumsum(noise), np.random.default_rng(seed), 0
        self.sums = {k: np.full_like(v, 1.0) for k, v in model.items()}

    def step(self, c1: NDArray, c2: NDArray, w: NDArray) -> None:
        m, n = self.m, len(w)
        self.seen += n
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.samples)), len(self.noise) - 1)
        r1, r2 = m["r"][c1], m["r"][c2]
        q, tw, td = r1 @ m["a1"] + r2 @ m["a2"], m["t"][w], m["t"][drawn]
        up = (1 / (1 + np.exp(np.clip((q * tw).sum(axis=1) + m["b"][w] - self.noise[w], -30, 30)))).astype(np.float32)
        down = q @ td.T
        down += m["b"][drawn] - self.noise[drawn]
        np.exp(np.negative(np.clip(down, -30, 30, out=down), out=down), out=down)
        down += 1
        np.reciprocal(down, out=down)
        dq = up[:, None] * tw - down @ td
        targets, context = self._places(np.concatenate([w, drawn])), self._places(np.concatenate([c1, c2]))
        self._put("t", targets, np.concatenate([up[:, None] * q, -(down.T @ q)]))
        self._put("b", targets, np.concatenate([up, -down.sum(axis=0)]))
        self._put("r", context, np.concatenate([dq @ m["a1"].T, dq @ m["a2"].T]))
        for name, r in (("a1", r1), ("a2", r2)):
            self._move(name, slice(None), r.T @ dq)

    def _places(self, at: NDArray) -> tuple[NDArray, NDArray, NDArray]:
        """An order that brings equal classes together, where each begins in it, and the classes."""
        at = at.astype(np.uint16) if len(self.noise) <= 1 << 16 else at  # short numbers sort much faster
        order = np.argsort(at, kind="stable")
        rows = at[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        return order, first, rows[first]

    def _put(self, name: str, places: tuple[NDArray, NDArray, NDArray], g: Floats) -> None:
        order, first, rows = places
        self._move(name, rows, np.add.reduceat(g[order], first, axis=0))

    def _move(self, name: str, at: NDArray | slice, g: Floats) -> None:
        seen = self.sums[name][at] + g * g
        self.sums[name][at] = seen
        self.m[name][at] += self.rate * g / np.sqrt(seen)


def _held(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def word_counts(docs: DataFrame, keep: int = 300_000) -> DataFrame:
    """``word, n``: how often each token stands in the texts, ends included. A task holds ``keep`` words or so at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for piece in pieces(batches):
            for text in as_bytes(piece.column("text")):
                held.update(space_words(text))
                held[END] += 1
            if len(held) >= keep:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def classes_of(counts: DataFrame, own: int, buckets: int, known: int) -> Classes:
    """Classes from all counts; the ``known`` most frequent words come to the driver, and sums by bucket."""
    top = counts.orderBy(F.desc("n"), "word").limit(known).toArrow()
    words, n = [bytes(w) for w in top.column("word").to_pylist()], top.column("n").to_numpy()
    kinds = {END: 0} | {w: i + 1 for i, w in enumerate([w for w in words if w != END][: own - 1])}
    if END not in words:  # more words than are known are more frequent
        words, n = [END, *words], np.append(counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], n)
    c = Classes(kinds, buckets, {w: i for i, w in enumerate(words)}, np.zeros(len(words), np.int32), n, np.zeros(len(kinds) + buckets), np.zeros(len(kinds) + buckets, np.int64))
    c.class_of[:] = [c.of(w) for w in words]
    mine = counts.sparkSession.createDataFrame([(w,) for w in kinds], "word binary")
    bucket = F.crc32(F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")) % buckets
    rest = counts.join(F.broadcast(mine), "word", "left_anti").groupBy(bucket.cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    for row in rest.collect():
        c.weight[len(kinds) + row.bucket], c.types[len(kinds) + row.bucket] = row.n, row.types
    for w, k in kinds.items():
        c.weight[k] = n[c.known[w]]
    return c


def sizes_of(distinct: int) -> tuple[int, int]:
    """How many classes of one word and of many there are, by the number of distinct words."""
    root = max(distinct, 1) ** (1 / 3)
    return round(10 * root), max(1, round(3 * root))


def _by_fold(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of each fold in turn, in lists of about ``limit`` bytes that don't depend on where batches end."""
    fold, held, size = None, [], 0
    for batch in batches:
        for own, text in zip(batch.column("fold").to_pylist(), as_bytes(batch.column("text")), strict=True):
            if held and (own != fold or size >= limit):
                yield fold, held
                held, size = [], 0
            fold, size = own, size + len(text)
            held.append(text)
    if held:
        yield fold, held


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``name, part, seen, vals`` of each name and group, from rows in order of name, group and part, weighted by tokens."""
    last, first, n, total = None, 0, 0.0, None

    def flush() -> pa.RecordBatch:
        name, group = last
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([group], pa.int64()), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["name", "part", "seen", "vals"])

    for b in batches:
        for name, group, seen, vals in zip(*(b.column(k).to_pylist() for k in ("name", "group", "seen", "vals")), strict=True):
            if last is not None and (name, group) != last:
                yield flush()
                n, total = 0.0, None
            x = seen * np.frombuffer(vals, np.float32).astype(np.float64)
            last, n, total = (name, group), n + seen, x if total is None else total + x
    if last is not None:
        yield flush()


def train(docs: DataFrame, c: Classes, dim: int, tokens: int, batch: int = 1024, warm: int = 400_000, fold: int = 4_000_000) -> Model:
    """One pass over all texts, in folds of about ``fold`` of the ``tokens``. They start from one model, trained on ``warm`` tokens of fold 0."""
    spark = docs.sparkSession
    noise = np.maximum(c.weight, 0.5) / np.maximum(c.weight, 0.5).sum()
    shared = spark.sparkContext.broadcast(c)
    folds = max(1, tokens // fold)
    key = F.xxhash64("text", "doc_id")
    dealt = docs.select("text", F.pmod(key, F.lit(folds)).cast("int").alias("fold"), F.xxhash64("doc_id", "text").alias("key"))

    def triples(texts: list[bytes], seed: int) -> Iterator[NDArray]:
        parts = [np.concatenate([[0, 0], shared.value.tokens(t)[2]]) for t in texts]
        rows = np.concatenate([np.stack([p[1:-1], p[:-2], p[2:]], axis=1) for p in parts])
        rows = rows[np.random.default_rng(seed).permutation(len(rows))]
        yield from (rows[i : i + batch] for i in range(0, len(rows), batch))

    def run(begin: Model, most: int | None):
        def result(at: int, trainer: Trainer) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(NAMES), pa.array([at] * len(NAMES), pa.int64()), pa.array([float(trainer.seen)] * len(NAMES)), pa.array([trainer.m[k].tobytes() for k in NAMES], pa.binary())], ["name", "part", "seen", "vals"])

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, trainer, turn = None, None, 0
            for own, texts in _by_fold(batches, 2 << 20):
                if own != at:
                    if trainer is not None:
                        yield result(at, trainer)
                    at, trainer, turn = own, Trainer(begin, noise), 0
                if most is None or trainer.seen < most:
                    for rows in triples(texts, turn):
                        if most is None or trainer.seen < most:
                            trainer.step(rows[:, 0], rows[:, 1], rows[:, 2])
                turn += 1
            if trainer is not None:
                yield result(at, trainer)

        return fit

    schema = "name string, part long, seen double, vals binary"
    model = Model.start(noise, dim)
    for most in (warm, None):
        begin = model
        texts = dealt.where("fold = 0").repartition(1) if most else dealt.repartition(folds, "fold")  # fold 0 is a bounded part
        found = texts.sortWithinPartitions("fold", "key").mapInArrow(run(begin, most), schema)
        step = 1
        while step < folds:  # groups of up to 32 parts, then of groups
            step *= 32
            grouped = found.withColumn("group", F.floor(F.col("part") / 32).cast("long"))
            found = grouped.repartition("name", "group").sortWithinPartitions("name", "group", "part").mapInArrow(_average, schema)
        model = Model({r.name: np.frombuffer(r.vals, np.float32).reshape(begin[r.name].shape) for r in found.collect()} or begin)  # one row for each name
    return model


@dataclass
class Exact:
    """A model's parameters for scoring, as multiples of a power of two so coarse that no sum of products is rounded.

    So a score is the same in whatever order, and beside whatever other rows, a matrix product adds up. The grid is set
    by the largest parameters; it is finer than one part in a million for any that training gives.
    """

    first: NDArray[np.float64]
    second: NDArray[np.float64]
    target: NDArray[np.float64]
    bias: NDArray[np.float64]

    @classmethod
    def of(cls, m: Model) -> Exact:
        first, second = (m["r"].astype(np.float64) @ m[a].astype(np.float64) for a in ("a1", "a2"))
        target, bias = m["t"].astype(np.float64), m["b"].astype(np.float64)
        most = len(target.T) * max(np.abs(first).max() + np.abs(second).max(), 1e-9) * max(np.abs(target).max(), 1e-9) + np.abs(bias).max()
        grid = 2.0 ** ((50 - int(np.ceil(np.log2(most)))) // 2)
        on = lambda x, g: np.round(x * g) / g
        return cls(on(first, grid), on(second, grid), on(target, grid), on(bias, grid * grid))

    def predicted(self, c1: NDArray, c2: NDArray) -> NDArray[np.float64]:
        return self.first[c1] + self.second[c2]


class Scorer:
    """Normalised class log-probabilities (natural). A context's normaliser is kept until another context takes its slot.

    A Python worker has one for all its tasks; up to 2,048 classes each context has a slot of its own.
    """

    SLOTS = 1 << 22
    #: Contexts worked out at a time, so that their scores stay in a processor's cache.
    ROWS = 64

    def __init__(self, model: Exact, size: int) -> None:
        self.m, self.size = model, size
        self.targets = np.ascontiguousarray(np.column_stack([model.target, model.bias]).T)  # a vector's last place is 1, for the bias
        self.q, self.s, self.e = np.ones((self.ROWS, len(self.targets))), np.empty((self.ROWS, size)), np.empty((self.ROWS, size), np.float32)
        self.keys, self.z = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, np.float32)

    def _normalisers(self, key: NDArray[np.int64]) -> NDArray[np.float32]:
        m, slot = self.m, key % self.SLOTS
        out = self.z[slot]
        missing = np.flatnonzero(self.keys[slot] != key)
        some, back = np.unique(key[missing], return_inverse=True)
        z = np.empty(len(some), np.float32)
        for lo in range(0, len(some), self.ROWS):
            at = some[lo : lo + self.ROWS]
            q, s, e = self.q[: len(at)], self.s[: len(at)], self.e[: len(at)]
            q[:, :-1] = m.predicted(at // self.size, at % self.size)
            np.matmul(q, self.targets, out=s)
            top = s.max(axis=1)
            np.exp(np.subtract(s, top[:, None], out=e, casting="unsafe"), out=e)
            z[lo : lo + self.ROWS] = top + np.log(e.sum(axis=1))
        self.keys[some % self.SLOTS], self.z[some % self.SLOTS] = some, z
        out[missing] = z[back]
        return out

    def classes(self, c1: NDArray, c2: NDArray, w: NDArray) -> NDArray[np.float64]:
        m = self.m
        z = self._normalisers(c1.astype(np.int64) * self.size + c2)
        return np.einsum("ij,ij->i", m.predicted(c1, c2), m.target[w]) + m.bias[w] - z


def report(docs: DataFrame, own: int | None = None, buckets: int | None = None, known: int = 200_000, dim: int = 16) -> DataFrame:
    """Unigram and model log10 probabilities of each whole text.

    own, buckets: classes of one word and of many (by the number of distinct words, see ``sizes_of``, if not given);
    known: words whose counts go to all tasks, the counts of the others being joined; dim: the length of class vectors,
    which does not follow the corpus as the number of classes does.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", _held().alias("held_out"))
    training = docs.where("NOT held_out")
    counts = cut(word_counts(training))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most = sizes_of(v)
    c = classes_of(counts, own or most[0], buckets or most[1], known)
    model = train(training, c, dim, n)
    shared = spark.sparkContext.broadcast((c, Exact.of(model)))
    base_down = np.log10(n + 0.5 * (v + 1))
    schema = "doc_id long, held_out boolean, row long, word binary, times long, n_tokens long, n_known long, base double, model double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, model = shared.value
        if not hasattr(model, "scorer"):  # the worker's own copy of the model
            model.scorer = Scorer(model, c.size)
        scorer, down = model.scorer, c.within()
        log, many = np.log10(c.counts + 0.5), len(c.own)
        for piece in pieces(batches, limit=2 << 20):
            parts = [c.tokens(t) for t in as_bytes(piece.column("text"))]
            sizes = np.array([len(p[0]) for p in parts])
            w = np.concatenate([p[2] for p in parts])
            c1 = np.concatenate([np.concatenate([[0], p[2]])[:-1] for p in parts])
            c2 = np.concatenate([np.concatenate([[0, 0], p[2]])[:-2] for p in parts])
            at = np.concatenate([p[1] for p in parts])
            have = at >= 0
            count = np.where(have, log[at], 0.0)
            values = scorer.classes(c1, c2, w) / np.log(10) + np.where(w >= many, count, 0.0) - down[w]
            starts = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, starts)
            rows = [piece.column("doc_id").to_pylist(), piece.column("held_out").to_pylist(), piece.column("row").to_pylist()]
            rare: list[tuple] = []
            for i, p in enumerate(parts):
                times: dict[bytes, int] = {}
                for k in np.flatnonzero(p[1] < 0):
                    times[p[0][k]] = times.get(p[0][k], 0) + 1
                rare += [(rows[0][i], rows[1][i], rows[2][i], word, n) for word, n in times.items()]
            a = [pa.array(x, t) for x, t in zip(zip(*rare, strict=True) if rare else [()] * 5, (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64()), strict=True)]
            zero, none = pa.array(np.zeros(len(rare), np.int64)), pa.array(np.zeros(len(rare)))
            yield pa.RecordBatch.from_arrays([*a, zero, zero, none, none], schema_names)
            # a text's own row has a key that no word can have, so that such rows do not meet in one place
            keys = pa.array([END + b"%d" % r for r in rows[2]], pa.binary())
            own_rows = [*(piece.column(k) for k in ("doc_id", "held_out", "row")), keys, pa.array(np.zeros(len(parts), np.int64)), pa.array(sizes), pa.array(add((have & (c.counts[at] > 0)).astype(np.int64))), pa.array(add(count) - sizes * base_down), pa.array(add(values))]
            yield pa.RecordBatch.from_arrays(own_rows, schema_names)

    schema_names = [x.split()[0] for x in schema.split(", ")]
    found = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, schema)
    rare = F.log10(F.coalesce(counts.n, F.lit(0)) + 0.5) * F.col("times")
    sums = lambda c: (F.col(c) + rare).cast("decimal(38,14)").alias(c)  # noqa: E731  decimals, whose sum does not depend on their order
    joined = found.join(counts, "word", "left").select("doc_id", "held_out", "row", "n_tokens", (F.col("n_known") + F.when(counts.n > 0, F.col("times")).otherwise(0)).alias("n_known"), sums("base"), sums("model"))
    out = joined.groupBy("row", "doc_id", "held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").cast("double").alias("base_score"), F.sum("model").cast("double").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
