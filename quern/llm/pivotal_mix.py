"""A mix of sources by weight: how often each document is taken, by pivotal rounding over a reduction tree.

A source's target in words, over its size, is the copies that each of its documents should have. Whole copies are given
to all; the fraction left over is a probability, worth so many words. Pivotal rounding takes two documents with fractions
and moves words from one to the other, in a random direction whose odds keep both expectations, until one of them has a
whole copy or none. The words of both together never change, so that at the end at most one document of a source has a
fraction left, and the words taken differ from the target by less than that document.

Documents are dealt into buckets of about ``FAN`` by a hash. Each bucket is rounded on its own and hands its one
undecided document up; buckets of these are rounded again, until one is left. All steps are SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm._common import cut
from quern.operators.ordered import numbered, running

#: Weights of the sources in order, repeating, and the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of a bucket: about so many in the first round, so many at most afterwards.
FAN = 64
#: Rows that one row's copies are laid out in at a time.
CHUNK = 10_000
WORDS = "[^\\x20\\x09-\\x0D]++"


def sizes(docs: DataFrame) -> DataFrame:
    """``none, src, doc_id, size, many``: documents by source, id and words; ``many`` of them are alike in all of these."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    named = docs.select(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
    return named.groupBy("none", "src", "doc_id", "size").agg(F.count("*").alias("many"))


def targets(counted: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sid, none, src, source_size, target, items``: each source with its number in order, words, target and alike groups with words.

    The targets share all words by weight; none is over ``most`` times its source's size, and what that leaves is shared
    again. In the order of ``most * size / weight`` the sources held at their limit come first: a source is held if its
    limit is no more than its share of what those before it leave. So running sums decide, and no round follows another.
    """
    sources = counted.groupBy("none", "src").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.count_if(F.col("size") > 0).alias("items"))
    placed = cut(numbered(sources, ["none", "src"], "sid"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("w", weight.cast("long")).withColumn("most", F.col("source_size") * most)
    ordered = placed.withColumn("_place", F.struct((F.col("most") / F.col("w")).alias("a"), F.col("sid")))
    before = running(ordered, "_place", {"most_before": "most", "w_before": "w"})
    all_ = placed.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    before = before.join(F.broadcast(all_))  # one row
    share = (F.col("all_size") - F.col("most_before")) / (F.col("all_w") - F.col("w_before"))
    judged = before.withColumn("share", share).withColumn("held", F.col("most") <= F.col("w") * F.col("share"))
    level = judged.agg(F.min(F.when(~F.col("held"), F.struct("_place", "share")))["share"].alias("level"))
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise(F.col("w") * F.col("level"))
    return judged.join(F.broadcast(level)).select("sid", "none", "src", "source_size", target.alias("target"), "items")


def _drawn(seed: int, *what: Column) -> Column:
    """A number in [0, 1) that follows from the seed and some columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *what), 11) / F.lit(float(1 << 53))


def _step(state: Column, item: Column) -> Column:
    """Rounds the open document (words ``mass`` of ``size``) against the next: one of them is decided, the other stays open."""
    a, b = state["open"], item
    up = F.least(a["size"] - a["mass"], b["mass"])  # to the open one: until it is whole or the other is none
    down = F.least(a["mass"], b["size"] - b["mass"])
    odds = F.shiftrightunsigned(F.xxhash64(item["draw"]), 11) / F.lit(float(1 << 53))  # the draw itself gave the order
    rise = odds * (up + down) < down
    filled = rise & (a["size"] - a["mass"] <= b["mass"])  # the open one is whole
    emptied = rise & (a["size"] - a["mass"] > b["mass"])  # the other is none
    gone = ~rise & (a["mass"] <= b["size"] - b["mass"])  # the open one is none
    mass = a["mass"] + b["mass"]
    fields = ("doc_id", "size", "many", "whole")
    done = lambda x, one: F.struct(*[x[f].alias(f) for f in fields], F.lit(one).cast("long").alias("one"))
    left = lambda x, m: F.struct(*[x[f].alias(f) for f in fields], m.alias("mass"), x["draw"].alias("draw"))
    decided = F.when(filled, done(a, 1)).when(emptied, done(b, 0)).when(gone, done(a, 0)).otherwise(done(b, 1))
    open_ = F.when(filled, left(b, mass - a["size"])).when(emptied, left(a, mass)).when(gone, left(b, mass)).otherwise(left(a, mass - b["size"]))
    return F.struct(F.concat(state["done"], F.array(decided)).alias("done"), open_.alias("open"))


def _rounded(open_: DataFrame) -> DataFrame:
    """``sid, bucket, done, open``: each bucket's documents (``sid, bucket, item``) rounded until one is open."""
    items = F.array_sort(F.collect_list(F.struct("item.draw", "item.doc_id", "item.size", "item.many", "item.whole", "item.mass")))
    first = F.element_at("items", 1)
    start = F.struct(F.expr("cast(array() AS array<struct<doc_id:bigint,size:bigint,many:bigint,whole:bigint,one:bigint>>)").alias("done"), F.struct(*[first[f].alias(f) for f in ("doc_id", "size", "many", "whole", "mass", "draw")]).alias("open"))
    held = open_.groupBy("sid", "bucket").agg(items.alias("items"))
    return held.select("sid", "bucket", F.aggregate(F.slice("items", F.lit(2), F.size("items")), start, _step).alias("r")).select("sid", "bucket", "r.done", "r.open")


def plan(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, fan: int = FAN) -> DataFrame:
    """``source, doc_id, size, many, source_size, target, base, whole``: of ``many`` documents alike in source, id and words ``whole`` are taken ``base + 1`` times and the others ``base`` times."""
    counted = cut(sizes(docs))
    to = cut(targets(counted, weights, most))
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    named = counted.join(to, ["none", "src"]).withColumn("copies", copies).withColumn("base", F.floor("copies"))
    wanted = F.when(F.col("size") > 0, F.col("many") * (F.col("copies") - F.col("base"))).otherwise(0.0)
    named = named.withColumn("wanted", wanted).withColumn("whole", F.floor("wanted")).withColumn("mass", (F.col("wanted") - F.col("whole")) * F.col("size"))
    # of equal documents at most one has a fraction
    item = lambda level, c: F.struct(c("doc_id"), c("size"), c("many"), c("whole"), c("mass"), _drawn(seed, F.lit(level), F.col("sid"), c("doc_id"), c("size")).alias("draw"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "sid", "doc_id", "size"), F.ceil(F.col("items") / fan))
    level, rounds = 0, []
    rest = named.where("mass > 0").select("sid", bucket.alias("bucket"), item(0, F.col).alias("item"))
    n = to.agg(F.max(F.ceil(F.col("items") / fan))).first()[0] or 0  # one number
    while True:
        rounds.append(cut(_rounded(rest)))
        level += 1
        of = lambda f: F.col(f"open.{f}").alias(f)
        rest = rounds[-1].select("sid", F.floor(F.col("bucket") / fan).alias("bucket"), item(level, of).alias("item"))
        if n <= 1:
            break
        n = -(-n // fan)
    whole = F.col("d.whole") + F.col("d.one")
    found = [r.select("sid", F.explode("done").alias("d")).select("sid", "d.doc_id", "d.size", "d.many", whole.alias("whole")) for r in rounds]
    # the last document of each source is taken as its own words decide
    last = rest.select("sid", "item.doc_id", "item.size", "item.many", (F.col("item.whole") + (F.col("item.draw") * F.col("item.size") < F.col("item.mass")).cast("long")).alias("whole"))
    rows = named.where("NOT mass > 0").select("sid", "doc_id", "size", "many", "whole").unionByName(last)
    for part in found:
        rows = rows.unionByName(part)
    sources = to.select("sid", F.when(~F.col("none"), F.col("src")).alias("source"), "source_size", "target", F.floor(copies).alias("base"))
    return rows.join(sources, "sid").select("source", "doc_id", "size", "many", "source_size", "target", "base", "whole")


def report(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, fan: int = FAN) -> DataFrame:
    """``doc_id, size, source_size, target`` (its source's)``, taken`` (words that the mix takes, repeats counted) of each document.

    Sources weigh 5, 2, 1, repeating, in the order of their code points, null last (it is a source like others). A null
    text has no words and, like an empty one, is taken with none. A null id is an id like others. Rows that share
    source, id and size are alike: so many of them get the further copy, whichever. A source without words has the
    target 0. An empty table gives no rows; other columns play no part. The same rows and seed give the same result
    however they are dealt.
    """
    p = plan(docs, seed, weights, most, fan)
    # rows that are alike are laid out in chunks, which any task can take
    chunks = p.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / CHUNK))).alias("chunk"))
    last = F.least((F.col("chunk") + 1) * CHUNK, F.col("many")) - 1
    each = chunks.select("*", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("k"))
    taken = (F.col("base") + (F.col("k") < F.col("whole")).cast("long")) * F.col("size")
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, **options: int) -> DataFrame:
    """The documents, all columns, each as often as the plan takes it; those without words are left out.

    Of rows alike in source, id and size the first in the order of their texts' hashes get the further copy.
    """
    p = plan(docs, **options).where("size > 0").select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("size").alias("_n"), "many", "base", "whole")
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").cast("string").alias("_source"), F.col("doc_id").cast("long").alias("_id"), size.alias("_size"), F.xxhash64("text").alias("_text"))
    both = rows.join(p, rows._source.eqNullSafe(p._s) & rows._id.eqNullSafe(p._d) & (rows._size == p._n))
    one = both.where("many = 1").select("_row", (F.col("base") + F.col("whole")).alias("copies"))
    place = F.row_number().over(W.partitionBy("_source", "_id", "_size").orderBy("_text"))
    alike = both.where("many > 1").select("_row", (F.col("base") + (place <= F.col("whole")).cast("long")).alias("copies"))
    every = one.unionByName(alike).where("copies > 0")
    return every.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_")).select("_row.*")
