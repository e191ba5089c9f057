"""Sweep line and cells against plain loops over all pairs."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.operators import layout
from quern.plans import catalog
from quern.plans import tables as t

BOXES = "doc_id long, page int, region int, x0 double, y0 double, x1 double, y1 double"


def plain_clusters(boxes: list, texts: list, gap: float = layout.GAP) -> list:
    clusters: list = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0], b[3], b[2])):
        for i, c in enumerate(clusters):
            near = max(c[0], b[0] - gap) < min(c[2], b[2] + gap) and max(c[1], b[1] - gap) < min(c[3], b[3] + gap)
            if near and not any(layout.parts_two(w, c, b) for w in texts):
                clusters[i] = (min(c[0], b[0]), min(c[1], b[1]), max(c[2], b[2]), max(c[3], b[3]))
                break
        else:
            clusters.append(b)
    return clusters


def random_boxes(draw: random.Random, n: int, side: float, size: float) -> list:
    out = []
    for _ in range(n):
        x, y = draw.uniform(-20, side), draw.uniform(-20, side)
        out.append((round(x), round(y), round(x + draw.uniform(0, size)), round(y + draw.uniform(0, size))))
    return out


def test_sweep_gives_the_same_clusters() -> None:
    draw = random.Random(8)
    for k in range(400):
        boxes = random_boxes(draw, draw.randint(0, 60), draw.choice([80, 300, 900]), draw.choice([5, 40, 150]))
        texts = random_boxes(draw, draw.randint(0, 15), 400, 90)
        assert layout.gathered(boxes, texts) == plain_clusters(boxes, texts), k


def test_sweep_of_many_boxes() -> None:
    """Four times the boxes take far less than sixteen times as long."""
    took = []
    for n in (8_000, 32_000):
        draw = random.Random(n)
        # on a long page, so that what is near a box stays alike
        boxes = [(x, y, x + 3, y + 3) for x, y in ((draw.uniform(0, 600), draw.uniform(0, n)) for _ in range(n))]
        began = time.perf_counter()
        layout.gathered(boxes, [])
        took.append(time.perf_counter() - began)
    assert took[1] < 9 * took[0] + 1


@pytest.mark.parametrize("cell", [7.0, 128.0])
def test_overlaps_by_cells(spark: SparkSession, cell: float) -> None:
    draw = random.Random(2)
    rows = {k: [(d, p, i, *map(float, b)) for d in (1, 2) for p in (0, 1) for i, b in enumerate(random_boxes(draw, 40, 200, 60))] for k in "ab"}
    found = layout.overlapping(spark.createDataFrame(rows["a"], BOXES), spark.createDataFrame(rows["b"], BOXES), cell)
    got = sorted((r.doc_id, r.page, r.aregion, r.bregion) for r in found.collect())
    share = lambda a, b: min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])
    assert got == sorted((a[0], a[1], a[2], b[2]) for a in rows["a"] for b in rows["b"] if a[:2] == b[:2] and share(a[3:], b[3:]))


def test_many_boxes_of_one_page(spark: SparkSession) -> None:
    """A hundred thousand boxes of one page against as many others, each over one of them."""
    at = lambda k: F.col("id") % 1000 * 10 + k
    down = F.floor(F.col("id") / 1000) * 10
    boxes = spark.range(0, 100_000, 1, 8).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page"), F.col("id").cast("int").alias("region"), at(0.0).alias("x0"), (down + 0.0).alias("y0"), at(8.0).alias("x1"), (down + 8.0).alias("y1"))
    found = layout.overlapping(boxes, boxes.withColumn("x0", F.col("x0") + 1))
    assert found.agg(F.count("*"), F.count_if(F.col("aregion") == F.col("bregion"))).first()[:] == (100_000, 100_000)


def test_captions_in_bands(spark: SparkSession) -> None:
    """The nearest caption, against the same distance over all pairs of a page."""
    draw = random.Random(4)
    regions = [(d, 0, i, *map(float, b)) for d in range(6) for i, b in enumerate(random_boxes(draw, 12, 1500, 500))]
    heads = [(d, 0, i, *map(float, b)) for d in range(6) for i, b in enumerate(random_boxes(draw, 9, 1700, 300))]
    found, c = spark.createDataFrame(regions, BOXES), spark.createDataFrame(heads, BOXES.replace("region", "block"))
    got = {(r.doc_id, r.region): (r.block, r.distance) for r in layout.assigned(found, c).collect()}
    both = found.select("doc_id", "region", *[F.col(x).alias(f"r{x}") for x in layout.BOX]).join(c.select("doc_id", "block", *[F.col(x).alias(f"c{x}") for x in layout.BOX]), "doc_id")
    span = found.groupBy("doc_id").agg(F.min("x0").alias("cx0"), F.max("x1").alias("cx1"))
    near = both.withColumn("d", layout.caption_distance("r", "c"))
    far = both.drop("cx0", "cx1").join(span, "doc_id").withColumn("d", layout.caption_distance("r", "c") + 250)
    want: dict = {}
    for df in (far, near):  # the near ones go first
        best: dict = {}
        for r in df.where("d IS NOT NULL").select("doc_id", "region", "block", "d").collect():
            best[r.doc_id, r.region] = min(best.get((r.doc_id, r.region), (1e9, 0)), (r.d, r.block))
        want |= {k: (block, d) for k, (d, block) in best.items()}
    assert got == want and got


def test_crowded_pages(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Pages above the limit go by cells and bands, with the same pairs."""
    monkeypatch.setattr(layout, "CROWD", 10)
    test_overlaps_by_cells(spark, 7.0)
    test_captions_in_bands(spark)


def test_boxes_of_ordinary_pages_are_dealt_once(spark: SparkSession) -> None:
    """A large box on a page with one other is one row of a shuffle, not one for each cell that it touches."""
    boxes = spark.range(1000).select("id", F.lit(0).alias("page"), F.lit(1).alias("region"), *[(F.col("id") % 7 + v).alias(c) for v, c in zip((0.0, 0.0, 1300.0, 1300.0), layout.BOX, strict=True)]).withColumnRenamed("id", "doc_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(layout.overlapping(boxes, boxes.withColumn("x0", F.col("x0") + 1200)).collect()) == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = max(runs.apply(i).executionId() for i in range(runs.size()))
    values, nodes, sent = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for m in (metrics.apply(k) for k in range(metrics.size())):
            if m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
                sent += int(values.apply(m.accumulatorId()).replace(",", ""))
    assert 2000 <= sent < 10_000


def plain_figures(page: tuple, boxes: list, blocks: list) -> list:
    """The figures of a page of images, by loops over all pairs."""
    width, height = page
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    both = lambda a, b: max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    fits = []
    for b in boxes:
        w, h = b[2] - b[0], b[3] - b[1]
        if w >= 40 and h >= 40 and w * h >= 3000 and max(w, h) / max(min(w, h), 1) <= 15 and not (w > 0.97 * width and h > 0.97 * height):
            fits.append(b)
    kept: list = []
    for b in sorted(fits, key=lambda b: (-area(b), b)):
        if all(both(b, k) < 0.85 * max(area(b), 1e-6) for k in kept):
            kept.append(b)
    texts = [x for x in blocks if x[1][2] - x[1][0] >= 5 and x[1][3] - x[1][1] >= 5]
    found = []
    for r in kept:
        cover, words = min(1.0, sum(both(r, i) for i in boxes) / area(r)), sum(both(r, w[1]) for w in texts) / area(r)
        if not (cover < 0.05 and words > 0.5):
            found.append((r, cover))

    def distance(r: tuple, c: tuple) -> float | None:
        if min(r[2], c[2]) - max(r[0], c[0]) < 10:
            return None
        below, above = c[1] - r[3], r[1] - c[3]
        if below >= -8:
            return below + 0.5 if below <= 260 else None
        if above >= -8:
            return above + 100.5 if above <= 130 else None
        reach = max(30.0, 0.3 * (r[3] - r[1]))
        inside = c[3] >= r[3] - 15 and r[3] - c[1] <= reach or c[1] <= r[1] + 15 and c[3] - r[1] <= reach
        return 0.0 if inside else None

    if not found:
        return []
    left, right = min(r[0] for r, _ in found), max(r[2] for r, _ in found)
    own: dict = {}
    free = []
    for r, cover in found:
        near = [(d, n) for n, c, _ in blocks if (d := distance(r, c)) is not None]
        far = [(d, n) for n, c, _ in blocks if (d := distance(r, (left, c[1], right, c[3]))) is not None]
        if near or far:
            own.setdefault(min(near or far)[1], []).append((r, cover))
        else:
            free.append((*r, cover, None, ""))
    out = []
    for n, c, text in blocks:
        if text.startswith("Table"):
            continue
        box = [f(r[k] for r, _ in own[n]) for k, f in enumerate((min, min, max, max))] if n in own else None
        cover = max(v for _, v in own[n]) if n in own else None
        thin = box is None or box[2] - box[0] < 0.5 * (c[2] - c[0]) and box[2] - box[0] < 200
        walls = [o[3] + 2 for m, o, _ in blocks if m != n and o[3] <= c[1] - 2]
        top = max([36.0, *walls])
        if thin and min(c[1] - 2, height) - top >= 40:
            x = [max(c[0], 0.0), top, min(c[2], width), c[1] - 2]
            box, cover = [min(x[0], box[0]), min(x[1], box[1]), max(x[2], box[2]), max(x[3], box[3])] if box else x, 0.0
        if box:
            out.append((*box, cover, text.split(" of")[0].replace(".", ""), text))
    return out + free


def test_figures_of_supplied_pages(spark: SparkSession, sf: str) -> None:
    pages, boxes, blocks = (df.collect() for df in t.layout(spark, sf))
    on: dict = {}
    for r in boxes:
        on.setdefault((r.doc_id, r.page), ([], []))[0].append((r.x0, r.y0, r.x1, r.y1))
    for r in blocks:
        on.setdefault((r.doc_id, r.page), ([], []))[1].append((r.block, (r.x0, r.y0, r.x1, r.y1), r.text))
    # blocks of a page have numbers of their own; a few supplied pages repeat one
    once = {p.doc_id for p in pages if len({n for n, *_ in on.get((p.doc_id, p.page), ([], []))[1]}) == len(on.get((p.doc_id, p.page), ([], []))[1])}
    want = [repr((p.doc_id, *f)) for p in pages if p.doc_id in once for f in plain_figures((p.width, p.height), *on.get((p.doc_id, p.page), ([], [])))]
    got = [repr(tuple(r)) for r in catalog.QUERIES["figures_lines"](spark, sf).select("doc_id", *layout.BOX, "cover", "label", "caption").collect() if r.doc_id in once]
    assert sorted(got) == sorted(want) and len(got) > 1000
