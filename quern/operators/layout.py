"""Figures and outlines of laid-out pages, from tables of boxes.

Boxes are columns ``x0, y0, x1, y1`` in points, with ``doc_id, page``. Two steps depend on the order of boxes, gathering
drawings (by a sweep line) and dropping nested regions; they run by page, on rows dealt and sorted by page. Boxes that tie
in the order are told apart by all their coordinates. Overlaps and captions are joins by cells and bands of pages.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quern.functions import png
from quern.functions.text import FIGURE_CAPTION, TABLE_CAPTION, caption_label
from quern.operators.ordered import at_places
from quern.sources.shared import kept

#: Fixed limits in points.
MIN_SIDE, MIN_AREA, MAX_ASPECT, GAP, BELOW, ABOVE = 40, 3000, 15, 30, 260, 130
#: Points of a side of the cells that boxes meet in, on pages with more boxes than the second.
CELL, CROWD = 128.0, 256
PAGE, BOX = ["doc_id", "page"], ["x0", "y0", "x1", "y1"]
Box = tuple[float, float, float, float]


def _area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def _overlap(a: str, b: str) -> Column:
    """The area that boxes ``a`` and ``b`` (prefixes of columns) share."""
    side = lambda lo, hi: F.greatest(F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def crowded(*tables: DataFrame) -> DataFrame:
    """``doc_id, page, crowd`` (true) of pages with more than ``CROWD`` rows in all tables; few, so that most joins broadcast them."""
    rows = tables[0].select(*PAGE)
    for df in tables[1:]:
        rows = rows.unionByName(df.select(*PAGE))
    return kept(rows.groupBy(*PAGE).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(*PAGE, F.lit(True).alias("crowd")))


def _cells(places: Column) -> Column:
    """The cells of a row: ``places`` on a crowded page, elsewhere one for the whole page."""
    return F.explode(F.when(F.col("crowd"), places).otherwise(F.array(F.lit(0))))


def _in_cell(cell: str, place: Column) -> Column:
    """Whether a pair is to be given in this cell."""
    return F.col("crowd").isNull() | (F.col(cell) == place)


def overlapping(left: DataFrame, right: DataFrame, cell: float = CELL) -> DataFrame:
    """All columns of ``left`` (with ``a`` before their names) and ``right`` (``b``) for boxes of a page that share an area.

    A crowded page is laid out in square cells. A box goes to every cell that it touches, and boxes meet in cells; a pair
    that meets in several is given in one of them, that of the upper left corner of what they share (the reference point).
    So a page with many boxes is dealt to many tasks and boxes far from each other never meet. Boxes of other pages meet by
    page, each as one row. ``cell``: points.
    """
    low = lambda c: F.floor(F.col(c) / cell).cast("int")
    crowds = crowded(left, right)

    def celled(df: DataFrame, p: str) -> DataFrame:
        named = _named(df, p).where(f"{p}x1 > {p}x0 AND {p}y1 > {p}y0").join(crowds, PAGE, "left")
        for c, k in (("cx", "x"), ("cy", "y")):
            named = named.withColumn(c, _cells(F.sequence(low(f"{p}{k}0"), low(f"{p}{k}1"))))
        return named

    both = celled(left, "a").join(celled(right, "b").drop("crowd"), [*PAGE, "cx", "cy"])
    corner = lambda c: F.floor(F.greatest(F.col(f"a{c}"), F.col(f"b{c}")) / cell).cast("int")
    return both.where((_overlap("a", "b") > 0) & _in_cell("cx", corner("x0")) & _in_cell("cy", corner("y0"))).drop("cx", "cy", "crowd")


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in PAGE])


def captions(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, block, x0.., label, caption, is_table`` of text blocks that are captions."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return blocks.select(*PAGE, "block", *BOX, caption_label(text).alias("label"), F.substring(text, 1, 500).alias("caption"), text.rlike(TABLE_CAPTION).alias("is_table")).where("label IS NOT NULL")


def parts_two(t: Box, a: Box, b: Box) -> bool:
    """Whether text ``t`` stands between boxes ``a`` and ``b``, above each other or side by side, 20 points wide on both."""
    for lo, hi, other_lo, other_hi in ((1, 3, 0, 2), (0, 2, 1, 3)):
        between = any(p[hi] <= t[lo] + 1 and q[lo] >= t[hi] - 1 for p, q in ((a, b), (b, a)))
        if between and all(min(x[other_hi], t[other_hi]) - max(x[other_lo], t[other_lo]) >= 20 for x in (a, b)):
            return True
    return False


def gathered(boxes: list[Box], texts: list[Box], gap: float = GAP) -> list[Box]:
    """Boxes from top to bottom, each joined to the first cluster within ``gap`` that no text parts from it.

    A line sweeps down the page. Clusters whose lower edge it has left behind by ``gap`` can take no more boxes, as all
    that follow begin lower. Those still open, and the texts, stand in bins by their left and right edges, so that a box
    meets only what is near it; of equals the cluster that began first is the first.
    """
    clusters: list[Box] = []
    open_, words = Bins(), Bins()
    for t in texts:
        words.put(len(words.boxes), t)
    for b in sorted(boxes, key=lambda b: (b[1], b[0], b[3], b[2])):
        open_.leave(b[1] - gap)
        for i in open_.near(b[0] - gap, b[2] + gap):
            c = clusters[i]
            near = max(c[0], b[0] - gap) < min(c[2], b[2] + gap) and max(c[1], b[1] - gap) < min(c[3], b[3] + gap)
            if near and not _parted(words, c, b):
                clusters[i] = (min(c[0], b[0]), min(c[1], b[1]), max(c[2], b[2]), max(c[3], b[3]))
                open_.put(i, clusters[i])
                break
        else:
            open_.put(len(clusters), b)
            clusters.append(b)
    return clusters


def _parted(words: Bins, c: Box, b: Box) -> bool:
    """Whether some text parts two boxes. Such a text overlaps the span of both from left to right."""
    return any(parts_two(words.boxes[i], c, b) for i in words.near(min(c[0], b[0]) - 1, max(c[2], b[2]) + 1))


class Bins:
    """Boxes by number in bins from left to right; a box can grow and, once the sweep has passed its lower edge, leaves."""

    WIDTH = 32.0

    def __init__(self) -> None:
        self.boxes: dict[int, Box] = {}
        self.bins: dict[int, set[int]] = {}
        self.ends: list[tuple[float, int]] = []

    def _over(self, low: float, high: float) -> range:
        return range(int(low // self.WIDTH), int(high // self.WIDTH) + 1)

    def put(self, i: int, box: Box) -> None:
        """Adds a box, or puts a greater one in its place."""
        old = self.boxes.get(i)
        self.boxes[i] = box
        known = () if old is None else self._over(old[0], old[2])
        for k in self._over(box[0], box[2]):
            if k not in known:
                self.bins.setdefault(k, set()).add(i)
        if old is None or box[3] > old[3]:
            heapq.heappush(self.ends, (box[3], i))

    def leave(self, line: float) -> None:
        """Drops the boxes whose lower edge is not below the line."""
        while self.ends and self.ends[0][0] <= line:
            end, i = heapq.heappop(self.ends)
            if i in self.boxes and self.boxes[i][3] == end:
                for k in self._over(self.boxes[i][0], self.boxes[i][2]):
                    self.bins[k].discard(i)
                del self.boxes[i]

    def near(self, low: float, high: float) -> list[int]:
        """The numbers of boxes that share a bin with the span, least first."""
        return sorted(set().union(*(self.bins.get(k, ()) for k in self._over(low, high))))


def not_nested(boxes: list[Box], share: float = 0.85) -> list[Box]:
    """Boxes by descending area without those that lie in a kept one for ``share`` of their area."""
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    kept: list[Box] = []
    for b in sorted(boxes, key=lambda b: (-area(b), b)):
        inside = (max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1])) for k in kept)
        if all(i < share * max(area(b), 1e-6) for i in inside):
            kept.append(b)
    return kept


def _by_page(rows: DataFrame, of_page: Callable[[list[str], list[Box]], list[Box]]) -> DataFrame:
    """``doc_id, page, region, x0..``: what each page's boxes (rows with ``kind``) become, numbered; streamed page by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kinds, boxes = None, [], []

        def flush() -> list[tuple]:
            return [(*last, i, *map(float, b)) for i, b in enumerate(of_page(kinds, boxes))] if last else []

        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in (*PAGE, "kind", *BOX)]
            for doc, page, kind, *box in zip(*cols, strict=True):
                if (doc, page) != last:
                    out += flush()
                    last, kinds, boxes = (doc, page), [], []
                kinds.append(kind)
                boxes.append(tuple(box))
            yield _regions(out)
        yield _regions(flush())

    return rows.select(*PAGE, "kind", *BOX).repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(run, "doc_id long, page int, region int, x0 double, y0 double, x1 double, y1 double")


def _regions(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], [*PAGE, "region", *BOX])


def _clusters(kinds: list[str], boxes: list[Box]) -> list[Box]:
    of = lambda kind: [b for k, b in zip(kinds, boxes, strict=True) if k == kind]
    return gathered(of("drawing"), of("text"))


def regions(pages: DataFrame, boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, page, region, x0.., cover``: candidate figure regions. ``boxes`` have ``kind`` (image, drawing), ``pages`` width and height.

    Pages without drawings have nothing to gather, pages with one candidate nothing nested: both stay out of Python.
    """
    texts = blocks.where("x1 - x0 >= 5 AND y1 - y0 >= 5")
    drawn = boxes.where("kind = 'drawing'").select(*PAGE, *BOX, F.lit("drawing").alias("kind"))
    marks = texts.where("y1 - y0 >= 20 AND x1 - x0 >= 30").select(*PAGE, *BOX, F.lit("text").alias("kind")).join(drawn.select(*PAGE).distinct(), PAGE, "left_semi")
    images = boxes.where("kind = 'image'").select(*PAGE, *BOX)
    found = _by_page(drawn.unionByName(marks), _clusters).select(*PAGE, *BOX).unionByName(images)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fits = (w >= MIN_SIDE) & (h >= MIN_SIDE) & (w * h >= MIN_AREA) & (F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1.0)) <= MAX_ASPECT) & ~((w > 0.97 * F.col("width")) & (h > 0.97 * F.col("height")))
    found = found.join(pages.select(*PAGE, "width", "height"), PAGE).where(fits).select(*PAGE, *BOX)
    found = kept(found.select("*", F.count("*").over(W.partitionBy(*PAGE)).alias("n")))  # dealt by page already
    several = _by_page(found.where("n > 1").withColumn("kind", F.lit("region")), lambda _, boxes: not_nested(boxes))
    kept_ = kept(found.where("n = 1").select(*PAGE, F.lit(0).alias("region"), *BOX).unionByName(several))
    key = [*PAGE, "region"]
    others = images.withColumn("image", F.lit(True)).unionByName(texts.select(*PAGE, *BOX, F.lit(False).alias("image")))
    share = lambda image: F.sum(F.when(F.col("bimage") == F.lit(image), _overlap("a", "b")))
    covered = overlapping(kept_, others).groupBy(*PAGE, F.col("aregion").alias("region")).agg(share(True).alias("image"), share(False).alias("words"))
    out = kept_.join(covered, key, "left")
    cover = F.least(F.coalesce("image", F.lit(0.0)) / F.greatest(_area(), F.lit(1e-6)), F.lit(1.0))
    words = F.coalesce("words", F.lit(0.0)) / F.greatest(_area(), F.lit(1e-6))
    return out.select(*key, *BOX, cover.alias("cover"), words.alias("words")).where("NOT (cover < 0.05 AND words > 0.5)").drop("words")


def caption_distance(r: str, c: str) -> Column:
    """How far caption ``c`` is from region ``r`` (prefixes of columns); null if it can't belong to it."""
    f = lambda p, k: F.col(f"{p}{k}")
    wide = F.least(f(r, "x1"), f(c, "x1")) - F.greatest(f(r, "x0"), f(c, "x0"))
    below, above = f(c, "y0") - f(r, "y1"), f(r, "y0") - f(c, "y1")
    reach = F.greatest(F.lit(30.0), 0.3 * (f(r, "y1") - f(r, "y0")))
    foot = (f(c, "y1") >= f(r, "y1") - 15) & (f(r, "y1") - f(c, "y0") <= reach)
    head = (f(c, "y0") <= f(r, "y0") + 15) & (f(c, "y1") - f(r, "y0") <= reach)
    return (
        F.when(wide < 10, None)
        .when(below >= -8, F.when(below <= BELOW, below + 0.5))
        .when(above >= -8, F.when(above <= ABOVE, above + 100.5))
        .when(foot | head, F.lit(0.0))
    )


def assigned(found: DataFrame, heads: DataFrame) -> DataFrame:
    """``doc_id, page, region, block, distance``: each region's nearest caption, the first of equals.

    A region that none fits is tried against captions widened to the page's regions, at 250 points more.
    """
    key = [*PAGE, "region"]
    r = found.select(*key, *[F.col(c).alias(f"r{c}") for c in BOX])
    span = found.groupBy(*PAGE).agg(F.min("x0").alias("wx0"), F.max("x1").alias("wx1"))
    # a caption that can belong to a region overlaps it, ABOVE points over and BELOW under it added; on crowded pages they meet
    # in bands, and a pair that meets in several counts where what both cover begins
    crowds = crowded(found, heads)
    band = lambda c: F.floor(c / CELL).cast("int")
    top, foot = F.col("ry0") - ABOVE, F.col("ry1") + BELOW
    bands = lambda a, b: _cells(F.sequence(band(F.least(a, b)), band(F.greatest(a, b)))).alias("band")
    of_region = r.join(crowds, PAGE, "left").select("*", bands(top, foot))
    of_caption = _named(heads.select(*PAGE, "block", *BOX), "c").join(crowds, PAGE, "left").select("*", bands(F.col("cy0"), F.col("cy1"))).drop("crowd")
    both = of_region.join(of_caption, [*PAGE, "band"]).where(_in_cell("band", band(F.greatest(F.least(top, foot), F.least("cy0", "cy1"))))).join(span, PAGE)
    both = both.withColumn("near", caption_distance("r", "c")).withColumn("cx0", F.col("wx0")).withColumn("cx1", F.col("wx1"))
    both = both.withColumn("far", caption_distance("r", "c") + 250)
    best = both.groupBy(*key).agg(F.min("near").alias("near"), F.min_by("cblock", F.when(F.col("far").isNotNull(), F.struct("far", "cblock"))).alias("fb"), F.min("far").alias("far"), F.min(F.when(F.col("near").isNotNull(), F.struct("near", "cblock"))).alias("n"))
    return best.select(*key, F.coalesce("n.cblock", "fb").alias("block"), F.coalesce("near", "far").alias("distance")).where("distance IS NOT NULL")


def figures(pages: DataFrame, boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, page, x0.., cover, label, caption``: regions by caption, bands above captions without any, and unclaimed regions."""
    blocks = kept(blocks)
    heads = kept(captions(blocks))
    found = kept(regions(pages, boxes, blocks))
    key = [*PAGE, "region"]
    own = kept(found.join(assigned(found, heads), key, "left"))
    union = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("cover").alias("cover")]
    groups = own.where("distance IS NOT NULL").groupBy(*PAGE, "block").agg(*union)
    c = heads.select(*PAGE, "block", "label", "caption", "is_table", *[F.col(x).alias(f"c{x}") for x in BOX])
    all_ = c.join(groups, [*PAGE, "block"], "left").join(found.select(*PAGE).distinct(), PAGE, "left_semi")
    thin = F.col("x0").isNull() | ((F.col("x1") - F.col("x0") < 0.5 * (F.col("cx1") - F.col("cx0"))) & (F.col("x1") - F.col("x0") < 200))
    # the band above a caption starts below the lowest large block or caption over it
    walls = blocks.where("y1 - y0 >= 30 AND x1 - x0 >= 250").select(*PAGE, F.col("block").alias("wb"), F.col("y1").alias("wy"), F.lit(450.0).alias("reach"))
    walls = walls.unionByName(heads.select(*PAGE, F.col("block").alias("wb"), F.col("y1").alias("wy"), F.lit(1e9).alias("reach")))
    tops = c.where("NOT is_table").join(walls, PAGE).where("wb <> block AND wy <= cy0 - 2 AND wy > cy0 - reach").groupBy(*PAGE, "block").agg(F.max(F.col("wy") + 2).alias("wall"))
    b = all_.join(tops, [*PAGE, "block"], "left").join(pages.select(*PAGE, "width", "height"), PAGE)
    top = F.greatest(F.lit(36.0), F.coalesce("wall", F.lit(0.0)))
    tall = F.least(F.col("cy0") - 2, F.col("height")) - top >= 40
    banded = thin & ~F.col("is_table") & tall
    pick = lambda band, own_: F.when(banded, band).otherwise(own_)
    rows = b.where("NOT is_table").select(
        *PAGE,
        pick(F.least(F.greatest("cx0", F.lit(0.0)), F.coalesce("x0", "cx0")), F.col("x0")).alias("x0"),
        pick(F.least(top, F.coalesce("y0", top)), F.col("y0")).alias("y0"),
        pick(F.greatest(F.least("cx1", "width"), F.coalesce("x1", "cx1")), F.col("x1")).alias("x1"),
        pick(F.greatest(F.col("cy0") - 2, F.coalesce("y1", F.col("cy0") - 2)), F.col("y1")).alias("y1"),
        pick(F.lit(0.0), F.col("cover")).alias("cover"), "label", "caption",
    ).where("x0 IS NOT NULL")
    free = own.where("distance IS NULL").select(*PAGE, *BOX, "cover", F.lit(None).cast("string").alias("label"), F.lit("").alias("caption"))
    return rows.unionByName(free)


def outline(blocks: DataFrame, most: int = 400) -> DataFrame:
    """``doc_id, item, page, text``: headings, being blocks a quarter larger than the body or short bold lines."""
    sizes = blocks.groupBy("doc_id", "max_size").agg(F.count("*").alias("n"))
    size = at_places(sizes, ["doc_id"], "max_size", "n", F.array(F.floor(F.col("size") / 2))).select("doc_id", F.col("value").alias("body"))
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    b = blocks.withColumn("text", text).where("text <> ''").join(size, "doc_id")
    n = F.char_length("text")
    bold = F.col("all_bold") & n.between(5, 90) & ~F.col("text").rlike("[.。;，,]$") & ~F.col("text").rlike(FIGURE_CAPTION) & ~F.col("text").rlike(TABLE_CAPTION)
    large = F.col("max_size") >= 1.25 * F.col("body")
    kept = b.where((n >= 3) & (large | bold))
    line = F.concat(F.format_string("[Page %d | %.1fpt", F.col("page") + 1, F.col("max_size")), F.when(large, F.lit("] ")).otherwise(F.lit(" bold] ")), F.substring("text", 1, 150))
    items = kept.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("page", "block", line.alias("text")))), 1, most).alias("items"))
    return items.select("doc_id", F.posexplode("items").alias("item", "i")).select("doc_id", "item", "i.page", "i.text")


def mostly_blank(images: DataFrame, column: str = "content") -> DataFrame:
    """The rows with ``blank``: whether a PNG has at most two grey levels at 64 by 64. What can't be decoded is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [png.level_count(x) for x in batch.column(column).to_pylist()]
            yield batch.append_column("blank", pa.array([k is not None and k <= 2 for k in n], pa.bool_()))

    return images.mapInArrow(run, StructType([*images.schema.fields, StructField("blank", BooleanType())]))


def shown(rows: DataFrame) -> DataFrame:
    """Rows ``doc_id, place, content`` with ``drop``: ``blank``, ``duplicate`` (of an earlier image of the document that is not blank) or null."""
    judged = mostly_blank(rows).withColumn("_sha", F.sha2("content", 256))
    first = F.min(F.when(~F.col("blank"), F.col("place"))).over(W.partitionBy("doc_id", "_sha"))  # equal images of a document
    drop = F.when(F.col("blank"), "blank").when(F.col("place") > first, "duplicate")
    return judged.withColumn("drop", F.when(F.col("content").isNotNull(), drop)).drop("_sha", "blank")


def warnings(docs: DataFrame) -> DataFrame:
    """``doc_id, warnings`` from ``chars, pages, figures, captions`` of documents."""
    w = F.array_compact(F.array(F.when(F.col("chars") < 120 * F.col("pages"), "little-text"), F.when(F.col("figures") == 0, "no-figures"), F.when(F.col("captions") > F.col("figures"), "captions-without-figures")))
    return docs.select("doc_id", w.alias("warnings"))


def captioned_figures(heads: DataFrame) -> DataFrame:
    """``doc_id, n``: how many figures (not tables) the captions of each document name, every label once."""
    return heads.groupBy("doc_id").agg(F.count_distinct(F.when(~F.col("is_table"), F.col("label"))).alias("n"))


#: Fixed texts: the label of a figure without one, headings of a paper's text.
UNLABELLED, PAGE_HEAD, CAPTIONS_HEAD = "未识别编号", "\n\n===== Page {} =====\n\n", "\n\n===== 检测到的图表题注 =====\n"


def manifest(found: DataFrame) -> DataFrame:
    """``doc_id, place`` (from 1)``, file, page`` (from 1)``, label, caption, source, rect_pt`` of ``figures``, by page, top and left.

    Figures that tie there are told apart by their other edges and their label. With a column ``content`` (a PNG of the
    figure) blank images and repeated ones are left out, and ``content`` is kept; nulls stay.
    """
    order = W.partitionBy("doc_id").orderBy("page", F.bround("y0", 0), "x0", "y0", "x1", "y1", "label")  # a document's figures
    place = F.row_number().over(order)
    image = ["content"] if "content" in found.columns else []
    if image:
        seen = shown(found.withColumn("place", place)).where("drop IS NULL").drop("drop", "place")
        found = seen.select(found.columns)
    file = F.concat(F.lit("figures/fig_"), F.lpad(F.col("place").cast("string"), 3, "0"), F.lit("_p"), F.col("page"), F.lit(".png"))
    rows = found.select("doc_id", place.alias("place"), (F.col("page") + 1).alias("page"), F.coalesce("label", F.lit(UNLABELLED)).alias("label"), F.coalesce("caption", F.lit("")).alias("caption"), F.when(F.col("cover") > 0.5, "raster").otherwise("vector").alias("source"), F.array(*[F.bround(c, 1) for c in BOX]).alias("rect_pt"), *image)
    return rows.select("doc_id", "place", file.alias("file"), "page", "label", "caption", "source", "rect_pt", *image)


def paper_text(blocks: DataFrame) -> DataFrame:
    """``doc_id, text``: the blocks' text page by page under headings, then all captions by page and block."""
    text = F.coalesce("text", F.lit(""))
    lines = lambda rows: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "block", rows.alias("line")))), lambda x: x["line"]), "\n")
    head, tail = PAGE_HEAD.split("{}")
    pages = blocks.groupBy("doc_id", "page").agg(lines(text).alias("body"))
    pages = pages.select("doc_id", "page", F.concat(F.lit(head), F.col("page") + 1, F.lit(tail), "body").alias("body"))
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "").alias("body"))
    heads = captions(blocks)
    line = F.concat(F.lit("[Page "), F.col("page") + 1, F.lit("] "), "label", F.lit(": "), "caption")
    listed = heads.groupBy("doc_id").agg(F.concat(lines(line), F.lit("\n")).alias("captions"))
    return whole.join(listed, "doc_id", "left").select("doc_id", F.concat("body", F.lit(CAPTIONS_HEAD), F.coalesce("captions", F.lit(""))).alias("text"))
