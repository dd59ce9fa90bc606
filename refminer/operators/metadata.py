"""Metadata of datasets: flattening of nested JSON, which rows are worth a visit, two-hop selection of pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refminer.functions.identifiers import internal_id, null_if_sentinel
from refminer.operators.tables import keep_first

FILE_KINDS = ("xlsx", "csv", "json", "xml", "zip")


def flat_pairs(value: Any, path: str = "", separator: str = ".") -> Iterator[tuple[str, str | None]]:
    """(path, value) of all leaves: a.b[0].c. Empty objects and lists have none, null is None, numbers and booleans are as in JSON."""
    if isinstance(value, dict):
        for key, v in value.items():
            yield from flat_pairs(v, f"{path}{separator}{key}" if path else str(key), separator)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from flat_pairs(v, f"{path}[{k}]", separator)
    else:
        yield path, value if value is None or isinstance(value, str) else json.dumps(value)


def flatten(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, path and value of every leaf of a JSON column. Nulls and strings that aren't JSON have no leaf."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, paths, values = [], [], []
            for k, text in enumerate(part.column(column).to_pylist()):
                try:
                    found = [] if text is None else list(flat_pairs(json.loads(text)))
                except (ValueError, RecursionError):
                    found = []
                at += [k] * len(found)
                paths += [p for p, _ in found]
                values += [v for _, v in found]
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())], [key, "path", "value"])

    return rows.select(key, column).mapInArrow(run, f"{key} {kind}, path string, value string")


def worth_a_visit(page: Column, extension: Column, section: Column) -> Column:
    """False for rows with hardly a page, no data file and no data section."""
    has_page = F.coalesce(F.length(page) > 5, F.lit(False))
    return has_page | F.coalesce(F.lower(extension).isin(*FILE_KINDS), F.lit(False)) | F.coalesce(F.lower(section).contains("data"), F.lit(False))


def metadata_candidates(citations: DataFrame, order: str) -> DataFrame:
    """The citations to fetch metadata for, each dataset once (the first by order), with visit_id."""
    rows = citations.withColumn("visit_id", internal_id(F.col("dataset_webpage"), F.col("download_link")))
    rows = rows.filter(F.col("visit_id").isNotNull() & worth_a_visit(null_if_sentinel(F.col("dataset_webpage")), F.col("file_extension"), F.col("source_section")))
    return keep_first(rows, ["visit_id"], [order])


def suggested_pages(suggestions: DataFrame, sitemap: DataFrame, most: int) -> DataFrame:
    """key and url: of each key's suggested urls those that the sitemap (key, url) has, the first `most` by position."""
    ranked = suggestions.select("key", F.posexplode("urls").alias("pos", "url")).join(sitemap.select("key", "url").distinct(), ["key", "url"], "left_semi")
    firsts = keep_first(ranked, ["key", "url"], ["pos"])
    listed = firsts.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "url"))), 1, most).alias("_l"))
    return listed.select("key", F.explode("_l.url").alias("url"))
