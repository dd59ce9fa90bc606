"""Column functions over references, URLs and identifiers. A null input gives null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PMC_ROOT = "https://www.ncbi.nlm.nih.gov/pmc/articles/"
DOI = r"10\.\d{4,9}/[-._;()/:A-Z0-9]+"
SENTINELS = ("n/a", "na", "nan", "none", "")
PDF_PATTERNS = (
    r"\.pdf$",
    r"arxiv\.org/pdf",
    r"aclanthology\.org/.*\.pdf",
    r"doi\.org/10\.(48550|3390|5220|1609)/",
    r"fraunhofer\.de/.*bitstream",
    r"ojs\.aaai\.org/.*/download",
)


def extract(value: Column, pattern: str, group: int = 0) -> Column:
    """regexp_extract that gives null instead of '' where nothing matches."""
    found = F.regexp_extract(value, pattern, group)
    return F.when(found != "", found)


def null_if_sentinel(value: Column) -> Column:
    """Null for the strings that stand for a missing value."""
    return F.when(~F.lower(F.trim(value)).isin(*SENTINELS), value)


def pmcid_to_url(pmcid: Column) -> Column:
    """Landing page of a PMC id (any case, padded); null for anything else."""
    clean = F.upper(F.trim(pmcid))
    return F.when(clean.startswith("PMC"), F.concat(F.lit(PMC_ROOT), clean))


def pmid_to_url(pmid: Column) -> Column:
    return F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid.cast("string"))


def canonical_reference(ref: Column) -> Column:
    """URL of an input reference: PMC id, http(s) URL or DOI; null for what is none of these (a local path is the caller's)."""
    clean = F.trim(ref)
    return F.when(F.upper(clean).startswith("PMC"), pmcid_to_url(clean)).when(clean.startswith("http"), clean).when(clean.startswith("10."), F.concat(F.lit("https://doi.org/"), clean))


def reference_kind(ref: Column) -> Column:
    clean = F.trim(ref)
    return F.when(F.upper(clean).startswith("PMC"), F.lit("pmcid")).when(clean.startswith("http"), F.lit("url")).when(clean.startswith("10."), F.lit("doi")).when(F.length(clean) > 0, F.lit("path"))


def api_of(url: Column) -> Column:
    """'PMC' where the article can be had from the PMC interface."""
    return F.when(url.rlike(r"(?i)(ncbi\.nlm\.nih\.gov/pmc|pmc\.ncbi\.nlm\.nih\.gov)/articles/PMC\d+|^PMC\d+$"), F.lit("PMC"))


def is_pdf_url(url: Column) -> Column:
    out = F.lit(False)
    for pattern in PDF_PATTERNS:
        out = out | F.lower(url).rlike(pattern)
    return out


def fetch_strategy(url: Column, browser: str | None = None) -> Column:
    """Which fetcher a URL needs: pdf, api, http, or the given browser."""
    return F.when(is_pdf_url(url), F.lit("pdf")).when(api_of(url).isNotNull(), F.lit("api")).otherwise(F.lit(browser or "http"))


def article_id(url: Column, only_known: bool = False) -> Column:
    """PMC id, else DOI, else the number of an ncbi page, else the last path segment of six or more characters."""
    pmc, doi, ncbi = extract(url, r"(?i)PMC(\d+)", 1), extract(url, f"(?i){DOI}"), extract(url, r"(?i)ncbi.*/(\d+)", 1)
    known = F.coalesce(F.concat(F.lit("PMC"), pmc), doi, ncbi)
    if only_known:
        return known
    segments = F.filter(F.reverse(F.split(url, "/")), lambda s: F.length(s) >= 6)
    return F.coalesce(known, F.get(segments, F.lit(0)))


def host(url: Column) -> Column:
    return extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)", 1)


def publisher_root(url: Column) -> Column:
    return F.when(url.isNotNull(), F.coalesce(host(url), F.lit("Unknown Publisher")))


def publisher_domain(url: Column) -> Column:
    """'PMC', 'pubmed', the second host label, or the first of a host of two."""
    labels = F.split(host(url), r"\.")
    general = F.when(F.size(labels) > 2, F.get(labels, F.lit(1))).otherwise(F.get(labels, F.lit(0)))
    return F.when(url.rlike("(?i)ncbi.*/pmc|pmc\\.ncbi"), F.lit("PMC")).when(url.rlike("(?i)pubmed"), F.lit("pubmed")).when(url.isNotNull(), F.coalesce(general, F.lit("Unknown Publisher")))


def url_to_doi(url: Column) -> Column:
    return extract(F.lower(url), r"10\.\d{4,9}/[-._;()/:a-z0-9]+")


def url_file_name(url: Column) -> Column:
    """Last segment of the path, '' for none."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*", "")
    return F.regexp_extract(path, r"([^/]*)$", 1)


def page_id(url: Column) -> Column:
    """The URL without scheme as a name of letters, digits and underscores."""
    name = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[^A-Za-z0-9]", "_")
    return F.when(F.length(url) > 0, F.regexp_replace(name, "_$", ""))


def file_extension(link: Column) -> Column:
    """Text after the last dot; '' if that has a slash."""
    tail = F.element_at(F.split(link, r"\."), -1)
    return F.when(tail.contains("/"), F.lit("")).otherwise(tail)


def download_link(href: Column, content_type: Column, page_url: Column) -> Column:
    """Where a supplementary file can be had: inside PMC by content type, elsewhere the link itself."""
    number = extract(page_url, r"(?i)PMC(\d+)", 1)
    in_pmc = F.when(content_type == "local-data", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/instance/"), number, F.lit("/bin/"), href)).when(content_type == "media p", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc"), href))
    return F.when(number.isNotNull(), in_pmc).otherwise(href)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"href=[\"']([^\"']+)"), F.lit(1))


def pmc_id(value: Column) -> Column:
    return extract(value, r"(?i)(PMC\d+)", 1)


def domain_of_href(href: Column) -> Column:
    return F.regexp_replace(host(href), r"^www\.", "")


def scrub_tracking_images(html: Column) -> Column:
    """Images of statistics servers replaced by a fixed mark."""
    return F.regexp_replace(html, r"(?i)<img[^>]*(?:stat|track|pixel)[^>]*>", "<img tracking/>")


def internal_id(*candidates: Column) -> Column:
    """The first candidate that isn't missing."""
    return F.coalesce(*[null_if_sentinel(c) for c in candidates])


def sheet_name(name: Column) -> Column:
    """At most 31 characters, none of those that workbooks forbid."""
    return F.substring(F.regexp_replace(name, r"[\[\]:*?/\\]", "_"), 1, 31)


def custom_id(model: Column, identifier: Column, stamp: Column, limit: int = 64) -> Column:
    """model_identifier_stamp with only letters, digits and dashes in the identifier, which is cut so that all has at most limit characters."""
    clean = F.regexp_replace(identifier, r"[^A-Za-z0-9\-]", "_")
    room = F.lit(limit - 2) - F.length(model) - F.length(stamp.cast("string"))
    return F.concat_ws("_", model, F.substring(clean, F.lit(1), F.greatest(room, F.lit(0))), stamp.cast("string"))


def prompt_id(model: Column, temperature: Column, prompt: Column) -> Column:
    return F.concat_ws("-", model, temperature.cast("string"), F.sha2(prompt, 256))


def publication_ids(html: Column) -> Column:
    """DOIs, PMC ids, and the numbers of PubMed and arXiv links of a page: sorted, each once, without closing punctuation."""
    patterns = (r"10\.\d{4,9}/[^\s\"'<>]+", r"PMC\d{4,}", r"pubmed\.ncbi\.nlm\.nih\.gov/(?:\d+)", r"arxiv\.org/abs/[0-9.v]+")
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(0)) for p in patterns])
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;)]+$", ""))))


def citing_items(value: Column) -> Column:
    """'a, b and c, repo' as ['a,repo', 'b,repo', 'c,repo']: the last item is the repository of the others."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(value, r"\s+and\s+", ","), ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat_ws(",", x, F.element_at(parts, -1)))
