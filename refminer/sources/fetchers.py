"""Fetchers over HTTP and from records, for references.fetch: functions from a URL to (content, format) or None.

How a request is made is an Opener, so that everything here also runs on recorded responses. Tasks use it on their own
executor: requests are spread like the rows are, and each task waits between its own.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refminer.sources.references import Fetcher

ENTREZ = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"
#: What a page says that keeps machines out.
WALLS = re.compile(r"(?i)captcha|cloudflare|access denied|are you a robot|enable javascript")


class Response(NamedTuple):
    status: int
    url: str
    kind: str
    body: bytes


#: Takes a method and a URL.
Opener = Callable[[str, str], Response]


def web_opener(timeout: float = 10.0, agent: str = "Mozilla/5.0 (compatible; refminer)") -> Opener:
    def get(method: str, url: str) -> Response:
        try:
            request = urllib.request.Request(url, method=method, headers={"User-Agent": agent, "Accept": "*/*"})
            with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
                return Response(r.status, r.url, r.headers.get_content_type(), r.read())
        except urllib.error.HTTPError as e:
            return Response(e.code, url, "", b"")
        except (urllib.error.URLError, TimeoutError, ValueError, OSError):
            return Response(0, url, "", b"")

    return get


def recorded_opener(responses: dict[str, tuple[int, str, str]]) -> Opener:
    """Answers from url -> (status, type, body); 404 for the rest."""

    def get(method: str, url: str) -> Response:
        status, kind, body = responses.get(url, (404, "", ""))
        return Response(status, url, kind, b"" if method == "HEAD" else body.encode())

    return get


def get_with_retries(opener: Opener, url: str, retries: int = 3, delay: float = 0.2) -> Response | None:
    """The first answer under 400. Requests that are wrong aren't repeated; after 429 and 5xx the wait doubles."""
    for k in range(retries):
        answer = opener("GET", url)
        if 200 <= answer.status < 400:
            return answer
        if 400 <= answer.status < 500 and answer.status not in (408, 429):
            return None
        if k + 1 < retries:
            time.sleep(delay * 2**k)
    return None


def http_fetcher(opener: Opener, retries: int = 3, delay: float = 0.2) -> Fetcher:
    """Pages and XML by plain requests; a page that keeps machines out counts as nothing."""

    def fetch(url: str) -> tuple[str, str] | None:
        answer = get_with_retries(opener, url, retries, delay)
        if answer is None or not answer.body:
            return None
        text = answer.body.decode("utf-8", "replace")
        xml = "xml" in answer.kind and "html" not in answer.kind or text.lstrip().startswith("<?xml")
        return None if not xml and len(text) < 5000 and WALLS.search(text) else (text, "XML" if xml else "HTML")

    return fetch


def entrez_url(pmcid: str, key: str | None = None) -> str:
    query = {"db": "pmc", "id": re.sub(r"(?i)^PMC", "", pmcid), "retmode": "xml"} | ({"api_key": key} if key else {})
    return f"{ENTREZ}?{urllib.parse.urlencode(query)}"


def entrez_fetcher(opener: Opener, key: str | None = None, retries: int = 3, delay: float = 2.0) -> Fetcher:
    """The XML of the PMC article that a URL names; None for URLs that name none and for articles without a body."""

    def fetch(url: str) -> tuple[str, str] | None:
        found = re.search(r"(?i)PMC\d+", url)
        answer = get_with_retries(opener, entrez_url(found.group(0), key), retries, delay) if found else None
        text = answer.body.decode("utf-8", "replace") if answer else ""
        return (text, "XML") if "<article" in text else None

    return fetch


def throttled(fetcher: Fetcher, gap: float = 1.0) -> Fetcher:
    """The fetcher, called at most once every gap seconds in a process."""
    last = [float("-inf")]

    def fetch(url: str) -> tuple[str, str] | None:
        wait = last[0] + gap - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        last[0] = time.monotonic()
        return fetcher(url)

    return fetch


def is_reachable(opener: Opener, url: str) -> bool:
    """Whether a URL answers HEAD, or GET where HEAD isn't allowed; a tail '/http...' that some lists have goes first."""
    clean = re.sub(r"/https?:?/*$", "", url)
    answer = opener("HEAD", clean)
    if answer.status == 405:
        answer = opener("GET", clean)
    return 200 <= answer.status < 400


def reachable(refs: DataFrame, opener: Opener) -> DataFrame:
    """url and reachable of the distinct URLs of refs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            urls = part.column("url").to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("url"), pa.array([is_reachable(opener, u) for u in urls], pa.bool_())], ["url", "reachable"])

    return refs.select("url").filter("url is not null").distinct().mapInArrow(run, "url string, reachable boolean")


def resolved_urls(refs: DataFrame, opener: Opener) -> DataFrame:
    """url and final_url, where redirects lead; the URL itself where nothing answers or it is no web address."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for url in part.column("url").to_pylist():
                answer = opener("GET", url) if url.startswith(("http://", "https://")) and " " not in url else None
                out.append(answer.url if answer and 200 <= answer.status < 400 else url.strip())
            yield pa.RecordBatch.from_arrays([part.column("url"), pa.array(out, pa.string())], ["url", "final_url"])

    return refs.select("url").filter("url is not null").distinct().mapInArrow(run, "url string, final_url string")


def sitemap_locations(xml: str) -> tuple[list[str], list[str]]:
    """(sitemaps, pages) that a sitemap lists."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return [], []
    kind = root.tag.rpartition("}")[2]
    found = [(e.text or "").strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc"]
    return (found, []) if kind == "sitemapindex" else ([], found)


def sitemap(spark: SparkSession, base_url: str, opener: Opener, most_parts: int = 10) -> DataFrame:
    """url: the pages of a site below base_url, by its sitemap. An index of more than most_parts sitemaps is a portal's and
    isn't read; without a sitemap the result is empty, and links are followed by references.site_links instead."""
    parts = urllib.parse.urlsplit(base_url)
    origin = f"{parts.scheme}://{parts.netloc}"
    answer = get_with_retries(opener, f"{origin}/sitemap.xml")
    more, urls = sitemap_locations(answer.body.decode("utf-8", "replace")) if answer else ([], [])
    if len(more) <= most_parts:
        for part in more:
            found = get_with_retries(opener, part)
            urls += sitemap_locations(found.body.decode("utf-8", "replace"))[1] if found else []
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    return rows.filter(F.col("url").startswith((origin + parts.path).rstrip("/"))).distinct()


def harvest(spark: SparkSession, url: str, path: str, opener: Opener, size: int = 100, total: str = "total", items: str = "items") -> DataFrame:
    """record: the items, as JSON, of a paged interface (url with {page} and {size}), one task a page, kept as Parquet in path.

    Pages that path has already are not asked for again, so a harvest that broke off goes on. Pages that don't answer are
    missing; the next call asks for them.
    """
    first = get_with_retries(opener, url.format(page=1, size=size))
    head = json.loads(first.body) if first else {}
    pages = -(-int(head.get(total, 0)) // size)
    wanted = spark.range(1, pages + 1).select(F.col("id").alias("page"))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        wanted = wanted.join(spark.read.parquet(path).select("page").distinct(), "page", "left_anti")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for page in part.column("page").to_pylist():
                answer = get_with_retries(opener, url.format(page=page, size=size))
                try:
                    found = [json.dumps(x, ensure_ascii=False) for x in json.loads(answer.body).get(items, [])] if answer else []
                except ValueError:
                    found = []
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(found), pa.int64()), pa.array(found, pa.string())], ["page", "record"])

    wanted.mapInArrow(run, "page bigint, record string").write.mode("append").parquet(path)
    return spark.read.schema("page bigint, record string").parquet(path)


def downloads(rows: DataFrame, opener: Opener, key: str = "url") -> DataFrame:
    """rows with status ('ok', 'blocked' for a page in place of a file, 'failed'), content (bytes) and file_name; each URL is asked once."""
    asked = rows.select(F.col(key).alias("_u")).filter("_u is not null").distinct()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            urls = part.column("_u").to_pylist()
            out: list[tuple[Any, ...]] = []
            for url in urls:
                answer = get_with_retries(opener, url)
                if answer is None:
                    out.append(("failed", None))
                elif "html" in answer.kind and WALLS.search(answer.body[:20_000].decode("utf-8", "replace")):
                    out.append(("blocked", None))
                else:
                    out.append(("ok", answer.body))
            yield pa.RecordBatch.from_arrays([part.column("_u"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["_u", "status", "content"])

    from refminer.functions.identifiers import url_file_name

    done = asked.mapInArrow(run, "_u string, status string, content binary")
    return rows.join(done, rows[key] == F.col("_u"), "left").withColumn("file_name", url_file_name(F.col(key))).drop("_u")
