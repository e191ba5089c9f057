"""Checks of explanatory documents (rows ``path, text``) against their glossary, and metadata from stored responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import PLAIN_WORDS, arxiv_unversioned, arxiv_url, latin_words, publisher_urls, url_forms, without_noise, without_tags
from quern.sources.shared import kept

#: Fixed texts that documents must hold.
SECTIONS, FIGURES, STATUS, OVERVIEW = ("一、", "三、", "四、"), "二、", "讲解状态说明", "概览级"
HEADING, TERM_HEADER = r"(?m)^##\s*三、.*$", "英文术语"
#: Fixed patterns: rows of a glossary's table that hold no term, what parts the terms of a cell, marks before a term.
RULE_ROW, TERM_BREAK, TERM_MARK = r"^\|[\s:\-|]+\|$", "[/、]", r"^(✅|\*)"
#: Fixed pattern: an image reference and its target.
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"


def split_glossary(docs: DataFrame) -> DataFrame:
    """``path, text, body, glossary``: the text before and from the third section's heading."""
    at = F.regexp_instr("text", F.lit(HEADING))
    return docs.select("path", "text", F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("body"), F.when(at > 0, F.substring("text", at, F.char_length("text"))).otherwise("").alias("glossary"))


def glossary_terms(docs: DataFrame) -> DataFrame:
    """``path, pos, term`` from the first cell of the glossary's table rows; a cell may hold several terms."""
    lines = split_glossary(docs).select("path", F.posexplode(F.split("glossary", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    lines = lines.where(F.col("line").startswith("|") & ~F.col("line").startswith("|---") & ~F.col("line").rlike(RULE_ROW) & ~F.col("line").contains(TERM_HEADER))
    cell = F.trim(F.element_at(F.split(F.trim("line", F.lit("|")), r"\|"), 1))
    parts = lines.select("path", "line_no", F.posexplode(F.split(cell, TERM_BREAK)).alias("part_no", "part"))
    return parts.select("path", F.struct("line_no", "part_no").alias("pos"), F.trim(F.regexp_replace(F.trim("part"), TERM_MARK, "")).alias("term")).where("term <> ''")


def token_counts(docs: DataFrame) -> DataFrame:
    """``path, token, n, first``: lower-cased Latin words of the body, their counts and first places."""
    words = split_glossary(docs).select("path", F.posexplode(latin_words(without_noise("body"))).alias("pos", "token"))
    return words.groupBy("path", "token").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def _grams(word: Column) -> Column:
    """The distinct runs of three letters of a word, or the word itself if it is shorter."""
    return F.when(F.char_length(word) < 3, F.array(word)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(word) - 2), lambda i: F.substring(word, i, F.lit(3)))))


def uncovered(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of ``tokens`` (``path, token``) that are no plain word and neither hold a term of their path nor stand in one.

    A word in another shares all its runs of three letters with it: candidates meet by path and the word's rarest run,
    those of under three letters by path alone.
    """
    own = kept(terms.select("path", F.lower("term").alias("term")).where("term <> ''").distinct())
    asked = kept(tokens.where(~F.col("token").isin(*PLAIN_WORDS)).select("path", "token").distinct())
    times = lambda df, word: df.select("path", F.explode(_grams(F.col(word))).alias("gram"))
    seen = kept(times(own.where("char_length(term) >= 3"), "term").unionByName(times(asked, "token")).groupBy("path", "gram").agg(F.count("*").alias("times")))

    def meeting(inner: DataFrame, inner_word: str, outer: DataFrame, outer_word: str) -> DataFrame:
        """``path, token`` of pairs in which the inner word stands in the outer one."""
        each = inner.select("path", inner_word, F.explode(_grams(F.col(inner_word))).alias("gram"))
        rarest = each.join(seen, ["path", "gram"]).groupBy("path", inner_word).agg(F.min_by("gram", F.struct("times", "gram")).alias("gram"))
        other = outer.select("path", outer_word, F.explode(_grams(F.col(outer_word))).alias("gram"))
        return rarest.join(other, ["path", "gram"]).where(F.col(outer_word).contains(F.col(inner_word))).select("path", "token")

    long = own.where("char_length(term) >= 3")
    short = own.where("char_length(term) < 3").groupBy("path").agg(F.collect_set("term").alias("terms"))  # words of one or two letters
    by_short = asked.join(short, "path").where(F.exists("terms", lambda t: F.col("token").contains(t))).select("path", "token")
    covered = meeting(long, "term", asked, "token").unionByName(meeting(asked.where("char_length(token) >= 3"), "token", long, "term")).unionByName(by_short)
    short_tokens = asked.where("char_length(token) < 3").join(own, "path").where(F.col("term").contains(F.col("token"))).select("path", "token")
    covered = covered.unionByName(short_tokens).distinct()
    return tokens.where(~F.col("token").isin(*PLAIN_WORDS)).join(covered, ["path", "token"], "left_anti")


def plain_path(x: Column) -> Column:
    """A relative path without ``.`` steps and with ``..`` steps taken back where they can be."""
    steps = F.aggregate(
        F.split(x, "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s.isin("", "."), done)
        .when((s == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(F.when(x.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(steps, "/"))


def missing_images(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``path, ref``: local image references without a file; ``files`` has ``path`` (of the document) and ``file``, relative to it."""
    refs = docs.select("path", F.explode(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(1))).alias("ref")).where(~F.col("ref").startswith("http"))
    there = files.select("path", plain_path(F.col("file")).alias("_plain"))
    return refs.withColumn("_plain", plain_path(F.col("ref"))).join(there, ["path", "_plain"], "left_anti").select("path", "ref")


def audit(docs: DataFrame, files: DataFrame, top: int = 15) -> DataFrame:
    """``path, hard`` (what must be mended)``, n_images, n_terms, uncovered`` (the ``top`` most frequent)``, unexplained, pass``."""
    text = F.col("text")
    need = [F.when(~text.contains(s), F.lit(f"missing section {s}")) for s in SECTIONS]
    need += [F.when(~text.contains(OVERVIEW) & ~text.contains(FIGURES), F.lit(f"missing section {FIGURES}")), F.when(~text.contains(STATUS), F.lit("missing status note"))]
    base = docs.select("path", F.array_compact(F.array(*need)).alias("hard"), F.size(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(1))).alias("n_images"))
    broken = missing_images(docs, files).groupBy("path").agg(F.sort_array(F.collect_list(F.concat(F.lit("missing image "), "ref"))).alias("broken"))
    terms = glossary_terms(docs)
    found = uncovered(token_counts(docs), terms).groupBy("path").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "token"))), 1, top).alias("u"))
    # a term is explained where its first mention stands in a bold span with both full-width brackets
    at = F.position(F.lower("term"), F.lower("body"))
    body = split_glossary(docs).select("path", "body")
    seen = terms.where(F.col("term").rlike("[A-Za-z]")).join(body, "path").withColumn("at", at).where("at > 0")
    bold_from = F.char_length(F.substring_index(F.substring("body", F.lit(1), F.col("at") - 1), "**", -1))
    has_bold = F.substring("body", F.lit(1), F.col("at") - 1).contains("**")
    rest = F.substring("body", F.col("at"), F.char_length("body"))
    span = F.concat(F.substring("body", F.col("at") - bold_from, bold_from), F.substring_index(rest, "**", 1))
    plain = seen.where(~(has_bold & rest.contains("**") & span.contains("（") & span.contains("）")))
    plain = plain.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("unexplained"))
    n_terms = terms.groupBy("path").agg(F.count("*").alias("n_terms"))
    out = base.join(broken, "path", "left").join(n_terms, "path", "left").join(found, "path", "left").join(plain, "path", "left")
    none = F.array().cast("array<string>")
    hard = F.concat("hard", F.coalesce("broken", none))
    return out.select("path", hard.alias("hard"), "n_images", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce(F.transform("u", lambda x: x["token"]), none).alias("uncovered"), F.coalesce("unexplained", none).alias("unexplained"), (F.size(hard) == 0).alias("pass"))


#: Schemas of stored responses, the parts that are read.
CROSSREF = "message struct<title:array<string>,author:array<struct<given:string,family:string>>,`container-title`:array<string>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,issued:struct<`date-parts`:array<array<int>>>,publisher:string,`is-referenced-by-count`:int,abstract:string,`alternative-id`:array<string>,type:string>"
DATACITE = "data struct<attributes:struct<titles:array<struct<title:string>>,creators:array<struct<name:string>>,publisher:string,publicationYear:int,descriptions:array<struct<description:string>>>>"
UNPAYWALL = "is_oa boolean, oa_status string, title string, journal_name string, best_oa_location struct<url_for_pdf:string,url:string,license:string>, oa_locations array<struct<url_for_pdf:string,url:string>>"
OPENALEX = "cited_by_count int, type string, open_access struct<oa_url:string>, best_oa_location struct<pdf_url:string>, locations array<struct<pdf_url:string>>"
EUROPEPMC = "resultList struct<result:array<struct<pmcid:string,pmid:string,isOpenAccess:string>>>"


def _first(x):
    return F.try_element_at(x, F.lit(1))


def metadata(responses: DataFrame) -> DataFrame:
    """One row for each ``doi`` from rows ``doi, source, body``.

    Fields come from the first registry; the second fills them only where the first has no title. The access services
    keep what they call the work apart (``unpaywall_title``, ``unpaywall_journal``), but give access states and ids; the
    open index fills what is still missing of its own fields.
    """
    by = {s: responses.where(F.col("source") == s) for s in ("crossref", "datacite", "unpaywall", "openalex", "europepmc")}
    m = F.col("j.message")
    some = lambda x: F.when(F.size(x) > 0, x)
    text = lambda x: F.nullif(x, F.lit(""))
    name = lambda a: text(F.concat_ws(" ", a["given"], a["family"]))
    year = F.coalesce(*[F.nullif(_first(_first(m[k]["date-parts"])), F.lit(0)) for k in ("published-print", "published-online", "issued")])
    c = by["crossref"].select("doi", F.from_json("body", CROSSREF).alias("j"))
    c = c.select("doi", F.struct(text(_first(m["title"])).alias("title"), some(F.array_compact(F.transform(m["author"], name))).alias("authors"), text(_first(m["container-title"])).alias("journal"), year.alias("year"), text(m["publisher"]).alias("publisher"), F.nullif(m["is-referenced-by-count"], F.lit(0)).alias("citations"), without_tags(m["abstract"]).alias("abstract"), m["alternative-id"].alias("alternative_id"), m["type"].alias("type")).alias("c"))
    a = F.col("j.data.attributes")
    publisher = F.coalesce(F.get_json_object(a["publisher"], "$.name"), a["publisher"])
    d = by["datacite"].select("doi", F.from_json("body", DATACITE).alias("j"))
    d = d.select("doi", F.struct(text(_first(a["titles"])["title"]).alias("title"), some(F.array_compact(F.transform(a["creators"], lambda x: text(x["name"])))).alias("authors"), text(publisher).alias("journal"), F.nullif(a["publicationYear"], F.lit(0)).alias("year"), text(publisher).alias("publisher"), without_tags(_first(a["descriptions"])["description"]).alias("abstract")).alias("d"))
    j = F.col("j")
    none = F.array().cast("array<string>")
    locations = F.concat(F.array(j["best_oa_location"]["url_for_pdf"], j["best_oa_location"]["url"]), F.coalesce(F.flatten(F.transform(j["oa_locations"], lambda x: F.array(x["url_for_pdf"], x["url"]))), none))
    u = by["unpaywall"].select("doi", F.from_json("body", UNPAYWALL).alias("j")).select("doi", j["is_oa"].alias("is_oa"), j["oa_status"].alias("oa_status"), j["title"].alias("unpaywall_title"), j["journal_name"].alias("unpaywall_journal"), j["best_oa_location"]["license"].alias("license"), F.array_distinct(F.array_compact(locations)).alias("unpaywall_urls"))
    pdfs = F.concat(F.array(j["best_oa_location"]["pdf_url"], j["open_access"]["oa_url"]), F.coalesce(F.transform(j["locations"], lambda x: x["pdf_url"]), none))
    o = by["openalex"].select("doi", F.from_json("body", OPENALEX).alias("j")).select("doi", j["cited_by_count"].alias("openalex_citations"), j["type"].alias("openalex_type"), j["open_access"]["oa_url"].alias("openalex_oa_url"), F.array_distinct(F.array_compact(pdfs)).alias("openalex_urls"))
    hit = _first(F.col("j.resultList.result"))
    e = by["europepmc"].select("doi", F.from_json("body", EUROPEPMC).alias("j")).select("doi", hit["pmcid"].alias("pmcid"), hit["pmid"].alias("pmid"), hit["isOpenAccess"].alias("europepmc_oa"))
    out = responses.select("doi").distinct()
    for part in (c, d, u, o, e):
        out = out.join(part.dropDuplicates(["doi"]), "doi", "left")
    filled = lambda k: F.coalesce(F.col("c")[k], F.when(F.col("c.title").isNull(), F.col("d")[k])).alias(k)
    first = [filled(k) for k in ("title", "authors", "journal", "year", "publisher")]
    return out.select("doi", *first, F.col("c.citations").alias("citations"), filled("abstract"), F.col("c.alternative_id").alias("alternative_id"), F.col("c.type").alias("type"), "is_oa", "oa_status", "license", "unpaywall_title", "unpaywall_journal", "unpaywall_urls", "openalex_citations", "openalex_type", "openalex_oa_url", "openalex_urls", "pmcid", "pmid", "europepmc_oa")


def title_queries(meta: DataFrame) -> DataFrame:
    """``doi, variant, title``: how a preprint is looked up by title, whole and by its first ten words; none under eight letters."""
    whole = F.trim(F.regexp_replace("title", r"\s+", " "))
    variants = F.filter(F.array(whole, F.array_join(F.slice(F.split(whole, " "), 1, 10), " ")), lambda t: F.char_length(t) >= 8)
    return meta.where("title IS NOT NULL").select("doi", F.posexplode(variants).alias("variant", "title"))


def title_candidates(feeds: DataFrame) -> DataFrame:
    """``doi, urls``: the preprints that stored answers (``doi, variant, body``) name, of the first variant that names any."""
    ids = F.transform(F.regexp_extract_all("body", F.lit(r"<id>https?://arxiv\.org/abs/([^<]+)</id>"), F.lit(1)), arxiv_unversioned)
    named = feeds.select("doi", "variant", F.array_distinct(F.transform(ids, lambda i: F.concat(F.lit("https://arxiv.org/pdf/"), i))).alias("urls")).where("size(urls) > 0")
    return named.groupBy("doi").agg(F.min_by("urls", "variant").alias("urls"))


#: Fixed order: the channels that may hold a paper's PDF; the last one gives preprints.
CHANNELS = ("arxiv", "unpaywall", "openalex", "europepmc", "publisher", "preprint")


def candidates(meta: DataFrame, preprints: DataFrame | None = None) -> DataFrame:
    """``doi, place, source, url``: where a paper's PDF may be had, channel by channel in fixed order, each address once.

    An address that announces the document's own is followed by that one. ``preprints``: see ``title_candidates``.
    """
    none = F.array().cast("array<string>")
    meta = meta.join(preprints.select("doi", F.col("urls").alias("_preprints")), "doi", "left") if preprints is not None else meta.withColumn("_preprints", none)
    pmc = F.when(F.col("pmcid").isNotNull(), F.array(F.concat(F.lit("https://www.ebi.ac.uk/europepmc/webservices/rest/PMC/"), "pmcid", F.lit("/fullTextPDF"))))
    urls = dict(zip(CHANNELS, (F.array_compact(F.array(arxiv_url("doi"))), F.col("unpaywall_urls"), F.col("openalex_urls"), pmc, publisher_urls("doi", "alternative_id"), F.col("_preprints")), strict=True))
    named = lambda source: F.flatten(F.transform(F.coalesce(urls[source], none), lambda u: F.transform(url_forms(u), lambda v: F.struct(F.lit(source).alias("source"), v.alias("url")))))
    listed = meta.select("doi", F.posexplode(F.flatten(F.array(*[named(c) for c in CHANNELS]))).alias("place", "c")).select("doi", "place", "c.source", "c.url")
    return listed.groupBy("doi", "url").agg(F.min_by(F.struct("place", "source"), "place").alias("f")).select("doi", "f.place", "f.source", "url")


def first_success(attempts: DataFrame) -> DataFrame:
    """``doi, source, url``: the first attempt (by ``place``) that ``ok`` marks."""
    return attempts.where("ok").groupBy("doi").agg(F.min_by(F.struct("source", "url"), "place").alias("f")).select("doi", "f.source", "f.url")


def acquired(tried: DataFrame) -> DataFrame:
    """``doi, ok, source, url, is_preprint, attempts`` of rows ``doi, place, source, url, ok, note``: what was tried until the first success.

    ``attempts`` (source, url, ok, note in order of place) ends with it, as nothing after it would have been tried; without
    one it holds all, and source and url are null. Rows without ``ok`` failed.
    """
    ok = F.coalesce("ok", F.lit(False))
    first = F.min(F.when(ok, F.col("place"))).over(W.partitionBy("doi"))  # a paper's addresses
    rows = tried.withColumn("_first", first).where("_first IS NULL OR place <= _first")
    entry = F.struct("place", "source", "url", ok.alias("ok"), "note")
    kept_ = rows.groupBy("doi").agg(F.array_sort(F.collect_list(entry)).alias("a"))
    last = F.filter("a", lambda x: x["ok"])
    at = lambda f: F.try_element_at(last, F.lit(1))[f]
    out = kept_.select("doi", (F.size(last) > 0).alias("ok"), at("source").alias("source"), at("url").alias("url"), F.transform("a", lambda x: F.struct(x["source"].alias("source"), x["url"].alias("url"), x["ok"].alias("ok"), x["note"].alias("note"))).alias("attempts"))
    return out.select("doi", "ok", "source", "url", F.coalesce(F.col("source") == CHANNELS[-1], F.lit(False)).alias("is_preprint"), "attempts")


#: Endings of an article's images.
IMAGES = ("jpg", "jpeg", "png", "gif")


def figure_images(figures: DataFrame, images: DataFrame) -> DataFrame:
    """``pmcid, href, url`` (null: missing): figures' files by base name among image addresses, the first address winning."""
    base = lambda x: F.element_at(F.split(x, "/"), -1)
    first = images.groupBy("pmcid", base("url").alias("base")).agg(F.min_by("url", "pos").alias("url"))
    return figures.withColumn("base", base("href")).where(F.col("base").rlike(rf"(?i)\.({'|'.join(IMAGES)})$")).join(first, ["pmcid", "base"], "left").select("pmcid", "href", "url")


#: The parts of a stored answer on an article that are read.
ARTICLE = "doi string, title string, authorString string, journalInfo struct<journal:struct<title:string>,yearOfPublication:string>, pubYear string, journalVolume string, pageInfo string, pmid string, license string"


def article_metadata(articles: DataFrame) -> DataFrame:
    """The metadata of full-text articles from rows ``pmcid, doi`` (as asked, may be null)``, body`` (the stored answer)."""
    j = F.col("j")
    authors = F.filter(F.transform(F.split(F.coalesce(j["authorString"], F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    source = F.concat(F.lit("EuropePMC fullTextXML + PMC CDN images ("), "pmcid", F.lit(")"))
    title = F.coalesce(without_tags(j["title"]), j["title"])
    rows = articles.select("pmcid", "doi", F.from_json("body", ARTICLE).alias("j"))
    text = lambda x: F.nullif(x, F.lit(""))
    return rows.select("pmcid", F.coalesce(text(F.col("doi")), j["doi"]).alias("doi"), title.alias("title"), authors.alias("authors"), j["journalInfo"]["journal"]["title"].alias("journal"), F.coalesce(text(j["pubYear"]), j["journalInfo"]["yearOfPublication"]).alias("year"), j["journalVolume"].alias("volume"), j["pageInfo"].alias("pages"), text(j["pmid"]).alias("pmid"), j["license"].alias("license"), F.lit(False).alias("is_preprint"), source.alias("download_source"))


def article_warnings(texts: DataFrame, images: DataFrame, least: int = 5000, shown: int = 5) -> DataFrame:
    """``pmcid, warnings`` of rows ``pmcid, text`` and of ``figure_images``: images that are missing (``shown`` by name), short texts."""
    base = F.element_at(F.split("href", "/"), -1)
    missing = images.where("url IS NULL").groupBy("pmcid").agg(F.sort_array(F.collect_list(base)).alias("m"))  # an article's figures
    named = F.concat(F.size("m").cast("string"), F.lit(" images missing: "), F.array_join(F.slice("m", 1, shown), ", "), F.when(F.size("m") > shown, F.lit(", ...")).otherwise(F.lit("")))
    w = F.array_compact(F.array(F.when(F.size("m") > 0, named), F.when(F.char_length(F.coalesce("text", F.lit(""))) < least, F.lit("short text"))))
    return texts.join(missing, "pmcid", "left").select("pmcid", w.alias("warnings"))


def distinct_images(images: DataFrame) -> DataFrame:
    """Rows ``doc_id, place, content`` without those whose content an earlier place of the document holds."""
    keyed = images.withColumn("_sha", F.sha2("content", 256))
    first = keyed.groupBy("doc_id", "_sha").agg(F.min("place").alias("place"))
    return keyed.join(first, ["doc_id", "_sha", "place"], "left_semi").dropDuplicates(["doc_id", "_sha"]).drop("_sha")
