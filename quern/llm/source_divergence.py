"""How far the sources of a language are from each other, and which terms set a source apart, in whole numbers.

Every group (a language's source) gives each kept term of the language a share in parts of 10**9. Of two groups the
divergence sums, over all kept terms, what the shares differ by. Terms are split by how many groups have them:

* heavy terms, in at least a ``HEAVY``th of the language's groups, fill numpy tiles, groups by terms, which are compared
  tile against tile;
* rare terms are mostly absent on both sides. One side's counts against the other's share of an absent term follow from
  how many rare terms have each count. Only terms that both groups have need a correction, from the term's posting list.

Both partial sums are whole numbers and are added exactly. Everything fits in 64 bits: the shares of a group add up to
10**9 and one for each term at most, so sums of squares stay below 9 * 10**18 for up to 10**9 terms of a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.typing import NDArray
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm._common import LOWER, as_bytes, cut, pieces

LETTERS = bytes(LOWER[b] if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256))
#: Documents that a kept term is in; ranks of terms.
LEAST, TOP = 3, 200
#: Terms in at least so-manieth part of the groups are heavy.
HEAVY = 4
#: Groups of a tile's side, terms of a tile, and different terms that a task counts before it hands them on.
SIDE, TILE, FULL = 128, 4096, 400_000
PAIRS = "lang string, i int, j int, value long"
I64 = NDArray[np.int64]


def share(count: I64, size: I64, terms: I64) -> I64:
    """``1 + floor(10**9 * (count + 1) / (size + terms))``, three digits at a time so that no product grows past 64 bits."""
    down = size + terms
    rest, out = count + 1, np.zeros(np.broadcast(count, down).shape, np.int64)
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, down)
        out = out * 1000 + part
    return out + 1


def _share(count: str, size: str, terms: str) -> Column:
    """The same as an expression of columns."""
    down = f"({size} + {terms})"
    one, two = f"(({count} + 1) * 1000)", f"((({count} + 1) * 1000) % {down} * 1000)"
    return F.expr(f"1 + ({one} div {down}) * 1000000 + ({two} div {down}) * 1000 + (({two} % {down}) * 1000) div {down}")


def gap(p: I64, q: I64) -> I64:
    return (p - q) ** 2 // q


def counted(docs: DataFrame, full: int = FULL) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents, of terms; a task's documents counted together."""

    def rows(n: dict, of: dict) -> pa.RecordBatch:
        groups, sizes = list(n), [len(c) for c in n.values()]
        named = [pa.array([g[k] for g, size in zip(groups, sizes, strict=True) for _ in range(size)], pa.string()) for k in (0, 1)]
        # both counters of a group got their terms in the same order
        term, many, docs = ([x for c in part for x in c] for part in (n.values(), (c.values() for c in n.values()), (of[g].values() for g in groups)))
        return pa.RecordBatch.from_arrays([*named, pa.array(term, pa.binary()).cast(pa.string()), pa.array(many, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, of = defaultdict(Counter), defaultdict(Counter)
        for piece in pieces(batches):
            for lang, source, text in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), as_bytes(piece.column("text")), strict=True):
                own = Counter(text.translate(LETTERS).split())
                n[lang, source].update(own)
                of[lang, source].update(own.keys())
            if sum(map(len, n.values())) >= full:
                yield rows(n, of)
                n, of = defaultdict(Counter), defaultdict(Counter)
        yield rows(n, of)

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _tile(left: pa.Table, right: pa.Table) -> tuple[I64, I64, I64, I64]:
    """Shares of a tile's two sides, groups by terms, and their groups' numbers. right: one row with the sides' sizes."""
    at = right.slice(0, 1).to_pylist()[0]
    terms = np.int64(at["terms"])
    shares = []
    for side, first in (("x", at["bi"] * at["side"]), ("y", at["bj"] * at["side"])):
        sizes = np.array(at[f"{side}sizes"], np.int64)
        lists = left.column(side).combine_chunks()
        counts = np.zeros((len(sizes), len(lists)), np.int64)
        values = lists.flatten()
        term = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        counts[values.field("i").to_numpy() - first, term] = values.field("n").to_numpy()
        shares.append((share(counts, sizes[:, None], terms), first + np.arange(len(sizes))))
    (p, i), (q, j) = shares
    return p, q, i, j


def _dense(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The heavy terms' sums between the groups of two sides, over the terms of one tile."""
    if not left.num_rows:
        return pa.table({"lang": pa.array([], pa.string()), "i": pa.array([], pa.int32()), "j": pa.array([], pa.int32()), "value": pa.array([], pa.int64())})
    p, q, i, j = _tile(left, right)
    value = np.stack([gap(row, q).sum(axis=1) for row in p])  # one group against a side at a time
    return _pairs(key[0].as_py(), np.repeat(i, len(j)), np.tile(j, len(i)), value.ravel())


def _pairs(lang: str, i: I64, j: I64, value: I64) -> pa.Table:
    ok = i != j
    return pa.table({"lang": pa.array([lang] * int(ok.sum()), pa.string()), "i": pa.array(i[ok].astype(np.int32)), "j": pa.array(j[ok].astype(np.int32)), "value": pa.array(value[ok])})


def _one_sided(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The rare terms' sums as if no term were in both groups, from ``i, n, terms_with, size, terms, rare`` of either side.

    A row says how many rare terms have the count ``n`` in group ``i``; there is one for the count 0 of each group.
    """
    sides = []
    for t in (left, right):
        c = {k: t.column(k).combine_chunks().to_numpy() for k in ("i", "n", "terms_with", "size", "terms", "rare")}
        groups, at = np.unique(c["i"], return_inverse=True)
        absent = np.zeros(len(groups), np.int64)
        absent[at[c["n"] == 0]] = share(np.int64(0), c["size"], c["terms"])[c["n"] == 0]
        sides.append((groups, at, share(c["n"], c["size"], c["terms"]), c["terms_with"], absent, c["rare"][:1]))
    (i, at_i, p, many_p, absent_p, rare), (j, at_j, q, many_q, absent_q, _) = sides
    value = -rare * gap(absent_p[:, None], absent_q[None, :])
    for k in range(len(p)):
        value[at_i[k]] += many_p[k] * gap(p[k], absent_q)
    for k in range(len(q)):
        value[:, at_j[k]] += many_q[k] * gap(absent_p, q[k])
    return _pairs(key[0].as_py(), np.repeat(i, len(j)), np.tile(j, len(i)), value.ravel())


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms in both groups change, from rows ``lang, terms, list (i, n, size)``; a batch's pairs are added up at once."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = {x: k for k, x in enumerate(names)}
        lang = np.array([number[x] for x in langs], np.int64)
        lists, terms = batch.column("list"), batch.column("terms").to_numpy()
        start, values = lists.offsets.to_numpy(), lists.flatten()
        i, n, size = (values.field(f).to_numpy().astype(np.int64) for f in ("i", "n", "size"))
        start, length = start - start[0], np.diff(start)
        own_terms = np.repeat(terms, length)
        p, absent = share(n, size, own_terms), share(np.int64(0), size, own_terms)
        for k in np.unique(length):
            some = np.flatnonzero(length == k)
            step = max(1, (1 << 19) // int(k * k))  # so many pairs at a time
            for at in range(0, len(some), step):
                rows = some[at : at + step]
                places = start[rows, None] + np.arange(k)
                x, y = places[:, :, None], places[:, None, :]
                value = gap(p[x], p[y]) - gap(p[x], absent[y]) - gap(absent[x], p[y]) + gap(absent[x], absent[y])
                yield from _summed(names, np.broadcast_to(lang[rows, None, None], value.shape).ravel(), np.broadcast_to(i[x], value.shape).ravel(), np.broadcast_to(i[y], value.shape).ravel(), value.ravel())


def _summed(names: list[str], lang: I64, i: I64, j: I64, value: I64) -> Iterator[pa.RecordBatch]:
    ok = (i != j) & (value != 0)
    lang, i, j, value = lang[ok], i[ok], j[ok], value[ok]
    if not len(value):
        return
    order = np.lexsort((j, i, lang))
    lang, i, j, value = lang[order], i[order], j[order], value[order]
    first = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    named = pa.DictionaryArray.from_arrays(pa.array(lang[first].astype(np.int32)), pa.array(names)).cast(pa.string())
    yield pa.RecordBatch.from_arrays([named, pa.array(i[first].astype(np.int32)), pa.array(j[first].astype(np.int32)), pa.array(np.add.reduceat(value, first))], ["lang", "i", "j", "value"])


def _anew(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so that they can be grouped beside rows of the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def report(docs: DataFrame, least: int = LEAST, top: int = TOP, heavy: int = HEAVY, side: int = SIDE, tile: int = TILE) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergences of groups (``pair``, all ranks) and of terms (``term``, the first ``top``).

    Null languages, sources and texts are empty ones. Every row is a document, whatever its id, so repeated rows count as
    often as they stand there. Ties of a value are told apart by the item's bytes. A group without terms, and a language
    without kept ones, still have their pairs, with what their shares give (0 without kept terms). An empty table gives
    no rows; other columns play no part.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    groups = cut(rows.select("lang", "source").distinct().select("lang", "source", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("i")))
    # one shuffle by term serves both sums; the tasks have summed their own documents before
    placed = counted(rows).join(groups, ["lang", "source"]).select("lang", "term", "i", "n", "docs").repartition("lang", "term")
    by_group = placed.groupBy("lang", "term", "i").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = by_group.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("i", "n")).alias("list")).where(F.col("docs") >= least)
    kept = cut(terms.select("lang", "term", "total", "list"))

    # one row for each language: the sizes of its groups in order, its terms, and how many of them are rare
    sizes = kept.select("lang", F.explode("list").alias("x")).groupBy("lang", "x.i").agg(F.sum("x.n").alias("size"))
    by_lang = groups.join(sizes, ["lang", "i"], "left").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("size", F.lit(0)).alias("size")))), lambda x: x["size"]).alias("sizes"))
    by_lang = cut(by_lang)  # a table's size is known, so that terms need not be dealt by their language
    is_heavy = F.size("list").cast("long") * heavy >= F.size("sizes")
    split = kept.join(by_lang, "lang").groupBy("lang").agg(F.count("*").alias("terms"), F.count_if(is_heavy).alias("heavy"), F.sum("total").alias("all"))
    langs = by_lang.join(split, "lang", "left").select("lang", "sizes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "heavy", "all")])
    langs = cut(langs.withColumn("sides", F.ceil(F.size("sizes") / side).cast("int")).withColumn("tiles", F.greatest(F.ceil(F.col("heavy") / tile), F.lit(1)).cast("int")))
    known = kept.join(langs, "lang")

    every = lambda name, n: F.explode(F.sequence(F.lit(0), n - 1)).alias(name)
    blocks = langs.select("*", every("bi", F.col("sides"))).select("*", every("bj", F.col("sides")))
    of = lambda b: F.filter("list", lambda x: F.floor(x["i"] / side) == F.col(b))
    piece = F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile")
    dealt = known.where(is_heavy).select("lang", "list", "sides", piece).select("*", every("bi", F.col("sides"))).select("*", every("bj", F.col("sides")))
    dealt = dealt.select("lang", "bi", "bj", "tile", of("bi").alias("x"), of("bj").alias("y"))
    part = lambda b: F.slice("sizes", F.col(b) * side + 1, F.lit(side))
    edges = blocks.select("lang", "bi", "bj", "terms", F.lit(side).alias("side"), part("bi").alias("xsizes"), part("bj").alias("ysizes"), every("tile", F.col("tiles")))
    key = ["lang", "bi", "bj", "tile"]
    dense = dealt.groupBy(*key).cogroup(_anew(edges).groupBy(*key)).applyInArrow(_dense, PAIRS)

    rare = known.where(~is_heavy)
    present = rare.select("lang", F.explode("list").alias("x")).groupBy("lang", "x.i", "x.n").agg(F.count("*").alias("terms_with"))
    at = ["lang", "i"]
    some = present.groupBy(*at).agg(F.sum("terms_with").alias("with"))
    own = langs.select("lang", "terms", (F.col("terms") - F.col("heavy")).alias("rare"), "sides", F.posexplode("sizes").alias("i", "size"))
    absent = own.join(some, at, "left").select(*at, F.lit(0).cast("long").alias("n"), (F.col("rare") - F.coalesce("with", F.lit(0))).alias("terms_with"), "size", "terms", "rare", "sides")
    listed = absent.unionByName(present.join(own, at).select(absent.columns))
    own_block = F.floor(F.col("i") / side).cast("int")
    lefts = listed.select("*", own_block.alias("bi"), every("bj", F.col("sides")))
    rights = listed.select("*", own_block.alias("bj"), every("bi", F.col("sides")))
    pair = ["lang", "bi", "bj"]
    one_sided = lefts.groupBy(*pair).cogroup(_anew(rights).groupBy(*pair)).applyInArrow(_one_sided, PAIRS)
    lists = rare.where("size(list) > 1").select("lang", "terms", F.transform("list", lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), F.element_at("sizes", x["i"] + 1).alias("size"))).alias("list"))
    both = lists.mapInArrow(_sparse, PAIRS)

    total = dense.unionByName(one_sided).unionByName(both).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    name = lambda c, new: groups.select("lang", F.col("i").alias(c), F.col("source").alias(new))
    found = total.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.select("*", F.row_number().over(order).alias("rank"))

    each = known.select("lang", "term", "total", "terms", "all", "sizes", F.explode("list").alias("x")).select("*", "x.i", "x.n", F.element_at("sizes", F.col("x.i") + 1).alias("size"))
    each = each.select("lang", "i", F.col("term").alias("item"), _share("n", "size", "terms").alias("p"), _share("total", "all", "terms").alias("q")).where("p > q")
    each = each.select("lang", "i", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    by_value = W.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    best = each.select("*", F.row_number().over(by_value).alias("rank")).where(F.col("rank") <= top)
    best = best.join(groups, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)
