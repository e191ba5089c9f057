"""Text columns: words, markup, identifiers, addresses and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.numbers import col

#: Words that a directory name leaves out.
NAME_STOP_WORDS = ("a", "an", "the", "of", "in", "for", "and", "with", "on", "to", "via", "by", "from", "using", "based", "study", "towards")
#: Words that need no entry in a glossary.
PLAIN_WORDS = (
    "pdf", "doi", "png", "jpg", "jpeg", "gif", "md", "url", "api", "http",
    "https", "www", "org", "com", "cn", "html", "arxiv", "peerj", "biorxiv",
    "github", "zenodo", "figshare", "crossref", "openalex", "unpaywall",
    "europepmc", "pmc", "ncbi", "cdn", "google", "scholar", "et", "al",
    "etc", "vs", "web", "os", "linux", "python", "r", "who", "faq", "cc",
    "by", "nc", "nd", "gps", "the", "and", "for", "a",
)
#: Fixed patterns: what Markdown's prose is freed from, and its words.
NOISE = (r"https?://\S+", r"!\[[^\]]*\]\([^)]*\)", r"\[[^\]]*\]\([^)]*\)", r"`[^`]*`")
LATIN_WORD = r"([A-Za-z][A-Za-z0-9\-']{2,})"
#: Fixed patterns: what may stand before a DOI, and a DOI.
DOI_URL, DOI_MARK, DOI = r"(?i)^(https?://)?(dx\.)?doi\.org/", r"(?i)^\s*doi\s*:\s*", r"^10\.\d{4,9}/\S+$"
#: Fixed patterns of captions.
TABLE_CAPTION = r"(?i)^\s*Table\s*\.?\s*(\d+)"
FIGURE_CAPTION = r"(?i)^\s*(?:\d{1,3}\s+)?(?:(Extended\s+Data|Supplementary|Supp\.?|SI)\s*\.?\s*(Figure|Fig\.?|Scheme|Chart|Plate|Graph)\s*\.?\s*([A-Za-z]?\d+)|(Figure|Fig\.?|Scheme|Chart|Plate|Graph)\s*\.?\s*(\d+))"


def blank_trimmed(x: Column | str) -> Column:
    """Without white space, any of Unicode's, at either end."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def blank_words(x: Column | str) -> Column:
    """Words parted by white space, any of Unicode's; none for blank text."""
    return F.filter(F.split(col(x), r"(?U)\s+"), lambda w: w != "")


def without_tags(x: Column | str) -> Column:
    """Tags become blanks and blanks one; null for nothing left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(col(x), "<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def normal_doi(x: Column | str) -> Column:
    """The bare DOI; null if it isn't one."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(x)), DOI_URL, ""), DOI_MARK, ""))
    return F.when(bare.rlike(DOI), bare)


def strict_doi(x: Column | str) -> Column:
    """The bare DOI; an error if it isn't one."""
    return F.coalesce(normal_doi(x), F.raise_error(F.concat(F.lit("not a DOI: "), F.coalesce(col(x), F.lit("null")))).cast("string"))


def url_forms(x: Column | str) -> Column:
    """The address, and the address of the document itself at two archives whose pages announce one."""
    url = col(x)
    host = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    bare = F.rtrim(url, F.lit("/"))
    hal = (host == "hal.science") | host.endswith(".hal.science") | host.startswith("hal.")
    pmc = host == "pmc.ncbi.nlm.nih.gov"
    return F.array_compact(F.array(url, F.when(hal & ~bare.endswith("/document"), F.concat(bare, F.lit("/document"))), F.when(pmc & ~bare.endswith("/pdf"), F.concat(bare, F.lit("/pdf/")))))


#: Fixed forms: the prefixes of a DOI (lower-cased) and the address of its PDF; ``{doi}``, ``{suffix}`` (after the first slash).
PUBLISHERS = (
    (r"^10\.(1007|1186|3758|10696|10083)/", "https://link.springer.com/content/pdf/{doi}.pdf"),
    (r"^10\.1038/", "https://www.nature.com/articles/{suffix}.pdf"),
    (r"^10\.1073/", "https://www.pnas.org/doi/pdf/{doi}"),
    (r"^10\.1002/", "https://onlinelibrary.wiley.com/doi/pdfdirect/{doi}?download=true"),
    (r"^10\.1145/", "https://dl.acm.org/doi/pdf/{doi}"),
)
#: Fixed forms: a family of journals by name and number, and addresses made of a fitting alternative id.
PEERJ, PEERJ_URL = r"^10\.7717/(peerj(?:-[a-z]+)?)[.\-](\d+)$", "https://peerj.com/articles/{slug}.pdf"
BY_ID = (
    (r"^10\.1016/", r"^(?!10\.)\S{10,}$", "https://www.sciencedirect.com/science/article/pii/{id}/pdfft?isDTMRedir=true&download=true"),
    (r"^10\.1109/", r"^\d+$", "https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&arnumber={id}"),
)


def publisher_urls(doi: Column | str, alternatives: Column | str | None = None) -> Column:
    """Where publishers keep a DOI's PDF, by the DOI's prefix; two of them by the first fitting alternative id."""
    d = F.lower(F.trim(col(doi)))
    none = F.array().cast("array<string>")
    alts = F.coalesce(col(alternatives), none) if alternatives is not None else none
    filled = lambda form, **parts: F.concat(*[parts.get(x, F.lit(x)) for x in re.split(r"[{}]", form) if x])
    urls = [F.when(d.rlike(prefix), filled(form, doi=d, suffix=F.regexp_replace(d, "^[^/]*/", ""))) for prefix, form in PUBLISHERS]
    family, number = (F.regexp_extract(d, PEERJ, i) for i in (1, 2))
    slug = F.when(family == "peerj", number).otherwise(F.concat(F.substring(family, 7, 100), F.lit("-"), number))
    urls.append(F.when(family != "", filled(PEERJ_URL, slug=slug)))
    first = lambda fits: F.try_element_at(F.filter(alts, lambda v: v.rlike(fits)), F.lit(1))
    for prefix, fits, form in BY_ID:
        one = first(fits)
        urls.append(F.when(d.rlike(prefix) & one.isNotNull(), filled(form, id=one)))
    return F.array_distinct(F.array_compact(F.array(*urls)))


def arxiv_url(doi: Column | str) -> Column:
    """The PDF of a DOI that names a preprint; null for other DOIs."""
    got = F.regexp_extract(F.trim(col(doi)), r"(?i)^10\.48550/arXiv\.(.+)$", 1)
    return F.when(got != "", F.concat(F.lit("https://arxiv.org/pdf/"), got))


def arxiv_unversioned(x: Column | str) -> Column:
    return F.regexp_replace(F.trim(col(x)), r"v\d+$", "")


def directory_name(authors: Column | str, year: Column | str, title: Column | str) -> Column:
    """First author's surname and year, then the title's first three words of weight; ``paper`` if nothing is left."""
    surname = F.coalesce(F.substring(F.regexp_replace(F.element_at(F.split(F.try_element_at(col(authors), F.lit(1)), " "), -1), "[^A-Za-z]", ""), 1, 20), F.lit(""))
    head = F.trim(F.concat(surname, F.coalesce(col(year).cast("string"), F.lit(""))), F.lit("_"))
    words = F.filter(F.split(F.lower(F.coalesce(col(title), F.lit(""))), "[^A-Za-z0-9]+"), lambda w: (F.char_length(w) > 1) & ~w.isin(*NAME_STOP_WORDS))
    name = F.trim(F.regexp_replace(F.concat(head, F.lit("_"), F.array_join(F.slice(words, 1, 3), "-")), "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(F.substring(name, 1, 60), F.lit("")), F.lit("paper"))


def safe_name(x: Column | str) -> Column:
    """A file name: runs of other letters become ``_``, 60 letters at most, ``result`` if nothing is left."""
    name = F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(F.substring(name, 1, 60), F.lit("")), F.lit("result"))


def shown_number(x: Column | str) -> Column:
    """A JSON value's text for a report: numbers with a fraction to four digits, others as they are, null empty."""
    value = col(x)
    return F.coalesce(F.when(value.rlike(r"^-?\d+(\.\d+([eE][-+]?\d+)?|[eE][-+]?\d+)$"), F.printf(F.lit("%.4f"), value.try_cast("double"))).otherwise(value), F.lit(""))


def without_noise(x: Column | str) -> Column:
    """Markdown without addresses, images, links and inline code."""
    out = col(x)
    for pattern in NOISE:
        out = F.regexp_replace(out, pattern, " ")
    return out


def latin_words(x: Column | str) -> Column:
    """Words of three letters and more that start with a Latin letter, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(col(x), F.lit(LATIN_WORD), F.lit(1)), F.lower)


def caption_label(x: Column | str) -> Column:
    """The label of a table or figure caption (``Table 1``, ``Fig 2``, ``Extended Data Fig 3``); null for other text."""
    text = col(x)
    group = lambda i: F.regexp_extract(text, FIGURE_CAPTION, i)
    dotless = lambda c: F.rtrim(c, F.lit("."))
    prefixed = F.concat_ws(" ", F.regexp_replace(dotless(group(1)), r"\s+", " "), dotless(group(2)), group(3))
    kind = dotless(group(4))
    plain = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 20)), F.lit(" "), group(5))
    table = F.concat(F.lit("Table "), F.regexp_extract(text, TABLE_CAPTION, 1))
    return F.when(text.rlike(TABLE_CAPTION), table).when(text.rlike(FIGURE_CAPTION), F.when(group(1) != "", prefixed).otherwise(plain))


def article_text(xml: Column | str) -> Column:
    """Plain text of an article's XML: section titles as headings, figures and tables as caption lines, other tags gone."""
    parts = F.split(F.regexp_replace(col(xml), r"(?s)<title>(.*?)</title>", "\n\n## $1\n"), r"(?=<caption>)|(?<=</caption>)")
    bare = lambda p: F.concat(F.lit("<caption>"), F.trim(F.regexp_replace(p, "<[^>]+>", " ")), F.lit("</caption>"))
    out = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<caption>"), bare(p)).otherwise(p)), "")
    for tag, word in (("fig", "图"), ("table-wrap", "表")):
        # by what the element has, from most to least: label and caption, label, caption, neither
        out = F.regexp_replace(out, rf"(?s)<{tag}[^>]*>((?:(?!</{tag}>|<label>).)*)<label>((?:(?!</{tag}>|</label>).)*)</label>", rf"<{tag}-l>$2</{tag}-l>")
        out = F.regexp_replace(out, rf"(?s)<{tag}(?: [^>]*)?>", f"<{tag}-l>?</{tag}-l>")
        out = F.regexp_replace(out, rf"(?s)<{tag}-l>((?:(?!</{tag}-l>).)*)</{tag}-l>((?:(?!</{tag}>).)*?)<caption>\s*((?:(?!</{tag}>|</caption>).)*?)\s*</caption>(?:(?!</{tag}>).)*</{tag}>", f"\n[{word} $1] $3\n")
        out = F.regexp_replace(out, rf"(?s)<{tag}-l>((?:(?!</{tag}-l>).)*)</{tag}-l>(?:(?!</{tag}>).)*</{tag}>", f"\n[{word} $1] \n")
    out = F.regexp_replace(out, r"<xref[^>]*>(.*?)</xref>", "$1")
    return F.regexp_replace(F.regexp_replace(out, "<[^>]+>", ""), r"\n{3,}", "\n\n")


def figure_links(xml: Column | str) -> Column:
    """The linked files of an article's figures, in order."""
    figures = F.regexp_extract_all(col(xml), F.lit(r"(?s)<fig(?: [^>]*)?>(.*?)</fig>"), F.lit(1))
    return F.filter(F.transform(figures, lambda f: F.regexp_extract(f, 'xlink:href="([^"]+)"', 1)), lambda h: h != "")


#: Fixed patterns: IPv4 and IPv6 hosts that are private, local, reserved or mapped to such.
LOCAL_V4 = r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^192\.0\.[02]\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\."
PUBLIC_V6, LOCAL_V6 = r"(?i)^\[?[23][0-9a-f]{3}:", r"(?i)^\[?(2001:(0{0,4}|0{0,2}1[0-9a-f]|0{0,2}2[0-9a-f]|0?db8):|2002:|3fff:)"


def local_address(host: Column | str) -> Column:
    """Whether a literal host is private, local or reserved, and so no public source."""
    h = col(host)
    return h.rlike(LOCAL_V4) | (h == "localhost") | (h.contains(":") & (~h.rlike(PUBLIC_V6) | h.rlike(LOCAL_V6)))


def fetchable(url: Column | str) -> Column:
    """Whether an address is http(s), names a host, and that host is no local one."""
    host = F.try_parse_url(col(url), F.lit("HOST"))
    return F.coalesce(F.try_parse_url(col(url), F.lit("PROTOCOL")).isin("http", "https") & host.isNotNull() & ~local_address(F.lower(host)), F.lit(False))


def whole_pdf(content: Column | str, least: int = 20_000, most: int = 300 << 20) -> Column:
    """Whether bytes are a PDF of plausible size: its mark among the first 2048."""
    c = col(content)
    return F.coalesce(F.octet_length(c).between(least, most) & (F.locate("%PDF", F.decode(F.substring(c, 1, 2048), "ISO-8859-1")) > 0), F.lit(False))
