"""Jobs to papers' files: text, outline and manifest of figures from laid-out pages; text, metadata and images of articles from stored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import article_text, figure_links
from quern.operators import documents, layout
from quern.sources.records import write_files
from quern.sources.shared import kept

#: Fixed names of the files of each paper.
TEXT, OUTLINE, MANIFEST = "paper_text.txt", "paper_outline.txt", "figures_manifest.json"
METADATA, FIGURES = "metadata.json", "figures"
#: Fixed pattern: the address of an image on an article's page. Fewer bytes than this are no image.
BLOB, LEAST_IMAGE = r"(https://cdn\.ncbi\.nlm\.nih\.gov/pmc/blobs/[^\"]+)", 1000


def _ordered(column: Column, by: str) -> Column:
    """A group's values in the order of another column."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(by).alias("at"), column.alias("v")))), lambda x: x["v"])


def files(pages: DataFrame, boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``file, content``: the files of each document below a folder named by its id."""
    name = lambda n: F.concat(F.col("doc_id").cast("string"), F.lit(f"/{n}")).alias("file")
    made = lambda n, text: (name(n), F.encode(text, "UTF-8").alias("content"))
    text = layout.paper_text(blocks).select(*made(TEXT, F.col("text")))
    lines = layout.outline(blocks).groupBy("doc_id").agg(F.concat(F.array_join(_ordered(F.col("text"), "item"), "\n"), F.lit("\n")).alias("text"))
    figures = layout.manifest(layout.figures(pages, boxes, blocks))
    entry = F.struct("file", "page", "label", "caption", "source", "rect_pt")
    listed = figures.groupBy("doc_id").agg(F.to_json(_ordered(entry, "place")).alias("text"))
    every = blocks.select("doc_id").distinct().join(listed, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("[]")).alias("text"))
    return text.unionByName(lines.select(*made(OUTLINE, F.col("text")))).unionByName(every.select(*made(MANIFEST, F.col("text"))))


def summary(pages: DataFrame, boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, pages, text_chars, captions_found, figure_count, warnings`` of each document with pages."""
    heads = layout.captions(blocks)
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    chars = blocks.groupBy("doc_id").agg(F.sum(F.char_length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars"))
    out = count(pages.select("doc_id", "page").distinct(), "pages")
    for part in (chars, count(heads, "captions_found"), layout.captioned_figures(heads).withColumnRenamed("n", "captions"), count(layout.figures(pages, boxes, blocks), "figures")):
        out = out.join(part, "doc_id", "left")
    out = out.fillna(0)
    return out.join(layout.warnings(out), "doc_id").select("doc_id", "pages", F.col("chars").alias("text_chars"), "captions_found", F.col("figures").alias("figure_count"), "warnings")


def write(pages: DataFrame, boxes: DataFrame, blocks: DataFrame, outdir: str) -> None:
    """Writes all documents' files below a folder that all executors share."""
    write_files(files(pages, boxes, blocks), outdir, replace=True)


def rescued(articles: DataFrame, stored: DataFrame, outdir: str) -> DataFrame:
    """Writes articles' files below ``outdir``, a folder each; returns ``pmcid, text_chars, figures`` (files)``, warnings``.

    articles: ``pmcid, doi, body`` (the stored answer on the article)``, xml`` (its full text)``, html`` (its page). stored:
    ``url, content`` of images. An image that the page does not name, or that is not stored whole, is missing.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    named = articles.select("pmcid", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(BLOB), F.lit(1))).alias("pos", "url"))
    links = articles.select("pmcid", F.explode(figure_links(F.coalesce("xml", F.lit("")))).alias("href")).distinct()
    wanted = documents.figure_images(links, named)
    whole = stored.where(F.octet_length("content") > LEAST_IMAGE).dropDuplicates(["url"])
    images = kept(wanted.join(whole, "url", "left").select("pmcid", "href", F.when(F.col("content").isNotNull(), F.col("url")).alias("url"), "content"))
    texts = kept(articles.select("pmcid", article_text(F.coalesce("xml", F.lit(""))).alias("text")))
    file = lambda *parts: F.concat("pmcid", F.lit("/"), *parts).alias("file")
    saved = images.where("content IS NOT NULL").select("pmcid", F.concat(F.lit(f"{FIGURES}/"), base("href")).alias("path"), "content").dropDuplicates(["pmcid", "path"])
    listed = saved.groupBy("pmcid").agg(F.sort_array(F.collect_list("path")).alias("figures"))  # an article's images
    meta = documents.article_metadata(articles.select("pmcid", "doi", "body")).join(listed, "pmcid", "left").withColumn("figures", F.coalesce("figures", F.array().cast("array<string>")))
    record = F.to_json(F.struct(*meta.columns), {"ignoreNullFields": "false"})
    rows = saved.select(file("path"), "content").unionByName(texts.select(file(F.lit(TEXT)), F.encode("text", "UTF-8").alias("content"))).unionByName(meta.select(file(F.lit(METADATA)), F.encode(record, "UTF-8").alias("content")))
    write_files(rows, outdir, replace=True)
    out = texts.join(listed, "pmcid", "left").join(documents.article_warnings(texts, images), "pmcid")
    return out.select("pmcid", F.char_length("text").alias("text_chars"), F.coalesce("figures", F.array().cast("array<string>")).alias("figures"), "warnings")
