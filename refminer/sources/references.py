"""Sources: lists of references, stored full texts, directories of files, JSON lines, and fetching behind an interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refminer.functions import identifiers as ids
from refminer.operators.tables import keep_first

STORE_SCHEMA = "publication string, content string, format string"


def read_references(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """ref: the stripped non-empty lines of a text file, or the strings of a list."""
    lines = spark.createDataFrame([(s,) for s in source], "value string") if isinstance(source, list) else spark.read.text(source)
    return lines.select(F.trim("value").alias("ref")).filter("ref <> ''")


def normalise(refs: DataFrame) -> DataFrame:
    """refs with kind (pmcid, url, doi, path), url (null for a path) and fetch_strategy (null without a URL)."""
    staged = refs.withColumn("kind", ids.reference_kind(F.col("ref"))).withColumn("url", ids.canonical_reference(F.col("ref")))
    return staged.withColumn("fetch_strategy", F.when(F.col("url").isNotNull(), ids.fetch_strategy(F.col("url"))))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """publication, content and format of a Parquet store of full texts."""
    return spark.read.parquet(path).select(F.col("publication").cast("string"), F.col("raw_cont").cast("string").alias("content"), F.col("format").cast("string"))


def in_store(refs: DataFrame, store: DataFrame, key: str = "ref") -> DataFrame:
    """The refs that the store has, whatever the case."""
    known = store.select(F.lower("publication").alias("_k")).distinct()
    return refs.join(known, F.lower(F.col(key)) == F.col("_k"), "left_semi")


def lookup(refs: DataFrame, store: DataFrame, key: str = "ref") -> DataFrame:
    """refs with content and format from the store, null where it has none; of several equal publications the first by format and content."""
    keyed = store.select(F.lower("publication").alias("_k"), "content", "format")
    return refs.join(keep_first(keyed, ["_k"], ["format", F.sha2("content", 256)]), F.lower(F.col(key)) == F.col("_k"), "left").drop("_k")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """file_name, pub_title, content, format, length and publication of the .xml and .html files below path, each name once."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{xml,html}").text(path)
    name = ids.extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    out = files.select(name.alias("file_name"), F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    out = out.withColumns({
        "format": F.upper(ids.extract(F.col("file_name"), r"\.(\w+)$", 1)),
        "pub_title": ids.extract(F.col("file_name"), r"__(.*)\.\w+$", 1),
        "publication": ids.extract(F.col("file_name"), r"(?i)^(PMC\d+)", 1),
        "length": F.length("content").cast("bigint"),
    })
    return keep_first(out, ["file_name"], ["path"])


def extend_store(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the rows of new whose file_name it lacks."""
    return store.unionByName(new.join(store.select("file_name"), "file_name", "left_anti"), allowMissingColumns=True)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Valid lines of a JSON-lines file; blank and broken ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_delimited(spark: SparkSession, path: str, separator: str = "\t", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", separator)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length and content of files as they are."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def login_required(html: Column) -> Column:
    """Whether a page is a login wall: such a link, such a request, or hardly any text. Null for no page."""
    return html.rlike(r"(?i)href=[\"'][^\"']*(login|signin|sign-in)") | html.rlike(r"(?i)(please|must) (log|sign) ?in") | (F.length(F.trim(html)) < 500)


def is_publication_url(url: Column, base_url: str, keywords: tuple[str, ...]) -> Column:
    """Whether a path segment is one of keywords, which the base URL's path must not have."""
    if set(urlsplit(base_url).path.lower().split("/")) & set(keywords):
        return F.lit(False)
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*", "")
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(k) for k in keywords]))


def site_links(hrefs: DataFrame, base_url: str, column: str = "href") -> DataFrame:
    """Distinct links of the same origin below the base path, without query, fragment and closing slash, and without paths that repeat a segment."""
    parts = urlsplit(base_url)
    root = f"{parts.scheme}://{parts.netloc}"
    absolute = F.when(F.col(column).startswith("/"), F.concat(F.lit(root), F.col(column))).otherwise(F.col(column))
    url = F.regexp_replace(F.regexp_replace(absolute, r"[?#].*$", ""), "/+$", "")
    segments = F.filter(F.split(F.regexp_replace(F.col("url"), r"^[a-z]+://[^/]*", ""), "/"), lambda s: s != "")
    below = F.col("url").startswith((root + parts.path).rstrip("/"))
    return hrefs.select(url.alias("url")).distinct().filter(below & (F.size(segments) == F.size(F.array_distinct(segments))))


#: Takes a URL, gives (content, format), or None where it has nothing. Network access lies behind it.
Fetcher = Callable[[str], tuple[str, str] | None]


def fetch(refs: DataFrame, fetchers: list[tuple[str, Fetcher]], store: DataFrame | None = None, complete: Callable[[str, str], bool] = lambda content, kind: bool(content)) -> DataFrame:
    """refs (with url) and content, format and fetched_by.

    The store is asked first, if there is one. What it lacks goes down the list of fetchers, in one pass over the rows
    still open: a result that isn't complete is only taken from the last. Rows nobody has stay, with nulls. Duplicate
    URLs are fetched once.
    """
    urls = refs.select("url").filter("url is not null").distinct()
    stored = lookup(urls, store, "url").withColumn("fetched_by", F.when(F.col("content").isNotNull(), "store")) if store is not None else urls.select("url", *[F.lit(None).cast("string").alias(c) for c in ("content", "format", "fetched_by")])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for url, content, kind, by in zip(*[part.column(c).to_pylist() for c in ("url", "content", "format", "fetched_by")], strict=True):
                for k, (name, get) in enumerate(fetchers if content is None else []):
                    found = get(url)
                    if found and (complete(*found) or k == len(fetchers) - 1):
                        content, kind, by = *found, name
                        break
                rows.append((url, content, kind, by))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["url", "content", "format", "fetched_by"])

    done = stored.mapInArrow(run, "url string, content string, format string, fetched_by string")
    return refs.join(done, "url", "left")
