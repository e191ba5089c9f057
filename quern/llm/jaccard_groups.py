"""N-gram Jaccard join by a token-group matrix, and the components of its links.

1. Documents with equal shingle sets form a class; one of each class goes on. Sets that reach the threshold share at
   least ``m`` of their first tokens in any order that is the same for all, if ``m - 1`` more than the ``n - ceil(t * n)
   + 1`` that must hold one are taken. By hash, so many least tokens of all sets are counted, with ``m`` growing with
   the set; sets in which fewer than ``m`` recur are done.
2. Tokens are counted over the sets that remain and ordered from rare to frequent. In each set, tokens of its own stand
   first and can't be shared: with ``p`` of them the set is done, else the rest of its prefix is taken from its rarest
   shared tokens, so that passages which many documents hold bring no sets together by themselves.
3. Similar sets are grouped by least hashes. Each group's purest set (fewest tokens of its own) is its pivot, members
   are compared with it, and the links make the first components.
   (This pass is plainer than the matrix and saves it the links inside hot groups of near copies; ``links`` does without.)
4. Sets with the same least hash make groups, cut to about ``group`` sets. The matrix holds the tokens of each group's
   union. A set is a query for the groups that hold one of its prefix tokens in a set of a smaller component; the overlap
   with the group's union bounds that with any member, and only groups that reach the threshold are opened and compared
   with the members of smaller components. So every link between components is found, and the components of all links
   are those of the join.

Defined results: null and empty texts and texts without words have no set, link with nothing and are their own
component; fewer words than ``n`` make one shingle; other columns are ignored. Each row is judged by its own text, so that
rows that share an id may be in different components; rows that repeat id and text get equal results. Rows without an id
link like others, and count after all ids where the least is asked for (null if there is none in reach).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.typing import NDArray
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quern.llm._anchors import BASE, mixed
from quern.llm._bits import bit_set, holds
from quern.llm._common import as_bytes, cut, ids_and_texts, pieces, space_words
from quern.llm._components import components

U64 = NDArray[np.uint64]
#: Bytes of text whose shingles a task holds at a time, apart from a longer text.
PIECE = 1 << 20


def shingles(text: bytes, n: int) -> U64:
    """The distinct hashed shingles of ``n`` words, least first."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = out * BASE + h[i : len(h) - size + 1 + i]
    return np.unique(mixed(out + np.uint64(size)))


def prefix_size(n: int | NDArray, percent: int) -> int | NDArray:
    """How many of ``n`` tokens, first in any order, must meet a partner's; from exact integers."""
    return n - -(-percent * n // 100) + 1


def spare(n: int, percent: int) -> tuple[int, int, int]:
    """Of ``n`` tokens, how many of a set's least ones are counted, how many are looked up, and how many must recur.

    The first is one more than the second, as the counts asked for by larger partners round differently (thresholds
    of half and more).
    """
    free = (100 - percent) * n // 100
    must = max(1, free)
    return free + must + 1, free + must, must


def _lists(rows: list[U64]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, digest`` (of the text)``, n_shingles, key`` (128 bits of the set; null if empty)``, prefix`` (its least tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            texts = as_bytes(piece.column("text"))
            sets = [shingles(t, n) for t in texts]
            keys = pa.array([_key(s) if len(s) else None for s in sets], pa.binary())
            digests = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), digests, pa.array(map(len, sets), pa.int64()), keys, _lists([s[: spare(len(s), percent)[0]] for s in sets])], ["doc_id", "digest", "n_shingles", "key", "prefix"])

    return docs.mapInArrow(run, "doc_id long, digest binary, n_shingles long, key binary, prefix array<long>")


def merged(df: DataFrame) -> DataFrame:
    """A side of a join by merging, however few its rows: each broadcast takes memory of the driver, and a job has dozens of joins."""
    return df.hint("merge")


def _key(tokens: U64) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _tokens(docs: DataFrame, bits: U64, n: int, percent: int) -> DataFrame:
    """``doc_id, key, tokens``: the sets enough of whose least tokens are in the bit set."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            sets = [shingles(t, n) for t in as_bytes(piece.column("text"))]
            keep = []
            for i, s in enumerate(sets):
                _, looked, must = spare(len(s), percent)
                if len(s) and holds(shared.value, s[:looked]).sum() >= must:
                    keep.append(i)
            keys = pa.array([_key(sets[i]) for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(keep, pa.int32())), keys, _lists([sets[i] for i in keep])], ["doc_id", "key", "tokens"])

    return docs.mapInArrow(run, "doc_id long, key binary, tokens array<long>")


def _shared(tokens: DataFrame, percent: int) -> DataFrame:
    """``id, n, own, tokens, prefix``: sets that can still meet another, with the tokens that recur, rarest first, and the first of them."""
    rows = tokens.select("id", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    times = rows.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    again = rows.join(merged(times), "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("t"))
    again = again.select("id", "n", (F.col("n") - F.size("t")).alias("own"), F.transform("t", lambda t: t["token"]).alias("tokens"))
    left = F.expr(f"int(n - ({percent} * n + 99) div 100 + 1 - own)")  # prefix_size, without the set's own tokens
    return again.where(left > 0).withColumn("prefix", F.slice("tokens", F.lit(1), left))


def _linked(a: str, b: str, percent: int) -> str:
    """SQL: whether sets ``a`` and ``b`` (with ``n, own, tokens``) reach the threshold; cheap bounds first."""
    need = f"{percent} * ({a}.n + {b}.n)"
    both = f"size(array_intersect({a}.tokens, {b}.tokens))"
    return f"{100 + percent} * least({a}.n - {a}.own, {b}.n - {b}.own) >= {need} AND {100 + percent} * {both} >= {need}"


def _pivot_links(sets: DataFrame, percent: int, rounds: int) -> DataFrame:
    """Links of sets with the purest set of their group, in groups by the least token under ``rounds`` orders."""
    out = None
    for turn in range(rounds):
        group = F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(turn))))
        grouped = sets.select("id", "n", "own", "tokens", group.alias("group"))
        pivots = grouped.groupBy("group").agg(F.min_by("id", F.struct("own", "id")).alias("pivot"), F.count("*").alias("size")).where("size > 1")
        pivots = pivots.join(merged(sets.alias("s")), F.col("pivot") == F.col("s.id")).select("group", F.struct("s.id", "s.n", "s.own", "s.tokens").alias("p"))
        found = grouped.alias("m").join(merged(pivots), "group").where("m.id <> p.id").where(_linked("m", "p", percent)).select(F.col("m.id").alias("a"), F.col("p.id").alias("b"))
        out = found if out is None else out.unionByName(found)
    return out


def _far_links(sets: DataFrame, percent: int, group: int) -> DataFrame:
    """Links between the components of ``sets`` (with ``component``), by the token-group matrix."""
    sets = sets.withColumn("bucket", F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(0)))))
    sizes = sets.groupBy("bucket").agg(F.count("*").alias("members"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / group)).cast("int")
    sets = sets.join(merged(sizes), "bucket").withColumn("part", part)
    first = sets.select("id", "component", "bucket", "part", F.explode("prefix").alias("token"))
    mixed_ = first.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    first = cut(first.join(merged(mixed_), "token"))
    here = [F.col("bucket").alias("g_bucket"), F.col("part").alias("g_part")]
    rows = first.groupBy("token", *here).agg(F.min("component").alias("least"))
    asked = first.select("token", F.col("id").alias("q"), F.col("component").alias("q_component")).join(merged(rows), "token").where("q_component > least").select("q", "g_bucket", "g_part").distinct()
    unions = sets.select(*here, F.explode("tokens").alias("token")).distinct()
    unions = unions.groupBy("g_bucket", "g_part").agg(F.collect_list("token").alias("union"))
    own = sets.select(F.col("id").alias("q"), F.struct("component", "n", "own", "tokens").alias("x"))
    bounded = asked.join(merged(own), "q").join(merged(unions), ["g_bucket", "g_part"]).where(f"100 * size(array_intersect(x.tokens, union)) >= {percent} * x.n").select("q", "x", "g_bucket", "g_part")
    members = sets.select(*here, "id", "component", "n", "own", "tokens").alias("m")
    return bounded.join(merged(members), ["g_bucket", "g_part"]).where(f"x.component > m.component AND {_linked('x', 'm', percent)}").select(F.col("q").alias("a"), F.col("m.id").alias("b"))


def _classes(sets: DataFrame) -> DataFrame:
    """``key, least, id, size`` of classes of equal sets: their least document and what tells them apart.

    That is the document, as a rule. If rows share an id, or have none, but differ in their sets, it is the document and
    the set, in the same order.
    """
    same = cut(sets.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    shared = same.groupBy("least").agg(F.count("*").alias("n")).where("n > 1 OR least IS NULL")
    if not shared.limit(1).count():
        return same.withColumn("id", F.col("least"))
    return same.withColumn("id", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), "key"))


def _doc(df: DataFrame, column: str) -> F.Column:
    """The document of a class's ``id``."""
    return F.col(column) if dict(df.dtypes)[column] == "bigint" else F.col(f"{column}.doc_id")


def _prepared(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents' sets (``_sets``), their classes (``_classes``), and one set of each class that can still meet another."""
    docs = ids_and_texts(docs)
    sets = cut(_sets(docs, n, percent))
    same = _classes(sets)
    least = sets.where("key IS NOT NULL").select(F.explode("prefix").alias("token"), F.xxhash64("key").alias("key"))
    recur = cut(least.groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("token"))
    tokens = _tokens(docs, bit_set(recur), n, percent)
    return sets, same, cut(_shared(cut(_one_of_each(tokens, same)), percent))


def _one_of_each(tokens: DataFrame, same: DataFrame) -> DataFrame:
    """``id, tokens`` of each class, from its least document; copies with other ids drop out before anything is dealt by class."""
    if dict(same.dtypes)["id"] == "bigint":  # one exchange serves the join and the repeated rows
        one = same.select(F.col("least").alias("doc_id"), "key")
        return tokens.join(merged(one), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("id"), "tokens")
    one = same.select(F.col("key").alias("k"), "least", "id")
    return tokens.join(merged(one), (tokens.key == one.k) & tokens.doc_id.eqNullSafe(one.least)).select("id", "tokens").dropDuplicates(["id"])


def links(docs: DataFrame, n: int = 4, percent: int = 85, group: int = 128) -> DataFrame:
    """``a, b``: every pair of classes that link, each by its least document's id, the smaller first.

    The matrix gives all of them, as every set counts as a component of its own. As many rows as there are links between
    different sets; copies add none (see ``classes``).
    """
    _, _, some = _prepared(docs, n, percent)
    found = _far_links(some.withColumn("component", F.col("id")), percent, group)
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.select(_doc(found, "a").alias("a"), _doc(found, "b").alias("b"))


def classes(docs: DataFrame, n: int = 4) -> DataFrame:
    """``doc_id, class_id`` (the least id with an equal set)``, copies`` of each document with words."""
    sets = _sets(ids_and_texts(docs), n, 100).where("key IS NOT NULL")
    same = sets.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return sets.join(merged(same), "key").select("doc_id", "class_id", "copies")


def _components_of(docs: DataFrame, n: int, percent: int, rounds: int, group: int) -> DataFrame:
    """``doc_id, digest, n_shingles, component`` (the least ``id`` of classes in reach; null without words) of each row."""
    sets, same, some = _prepared(docs, n, percent)
    near = cut(_pivot_links(some, percent, rounds))
    grouped = some.join(merged(components(near)), "id", "left").withColumn("component", F.coalesce("component", "id"))
    found = near.unionByName(_far_links(grouped, percent, group))
    labels = same.join(merged(components(found)), "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    return sets.select("doc_id", "digest", "n_shingles", "key").join(merged(labels), "key", "left").drop("key")


def report(docs: DataFrame, n: int = 4, percent: int = 85, rounds: int = 3, group: int = 128) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (the least id in reach by links, its own included) of each document.

    percent: the threshold; rounds: orders under which sets are grouped; group: sets of a group of the matrix.
    """
    out = _components_of(docs, n, percent, rounds, group)
    return out.select("doc_id", "n_shingles", F.coalesce(_doc(out, "component"), "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, n: int = 4, percent: int = 85, rounds: int = 3, group: int = 128) -> DataFrame:
    """The documents, all columns: of each component one row, and all rows without words.

    The row with the least id stays (one without an id only if all are); of rows that share it that with the least hash
    of its text, whatever else shares the id. Of rows that repeat both id and text one stays.
    """
    found = cut(_components_of(docs, n, percent, rounds, group))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("first"))
    later = found.join(first, "component").where(order != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    same = lambda t: docs.doc_id.cast("long").eqNullSafe(t._id) & (F.unhex(F.md5(F.coalesce(docs.text, F.lit("")))) == t._digest)
    twice = found.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    kept = docs.join(later, same(later), "left_anti")
    if not twice.limit(1).count():
        return kept
    return kept.join(twice, same(twice), "left_anti").unionByName(kept.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
