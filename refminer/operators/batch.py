"""Offline batches: requests as JSON lines, their validation, and the lines of results."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refminer.functions.identifiers import PMC_ROOT, extract

RESULT = "custom_id string, response struct<body: struct<output: array<struct<type: string, content: array<struct<text: string>>>>>>, error string, metadata map<string,string>"


def requests(prompts: DataFrame, model: str, response_format: str | None = None, url: str = "/v1/responses", keep: tuple[str, ...] = (), metadata: Column | None = None) -> DataFrame:
    """keep columns and line, the request of each row of prompts (custom_id, messages)."""
    body = [F.lit(model).alias("model"), F.col("messages").alias("input")]
    if response_format is not None:
        body.append(F.struct(F.lit(response_format).alias("format")).alias("text"))
    parts = [F.col("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), F.struct(*body).alias("body")]
    if metadata is not None:
        parts.append(metadata.alias("metadata"))
    return prompts.select(*keep, F.to_json(F.struct(*parts)).alias("line"))


def validate_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row: total, valid and invalid of the non-blank lines."""
    written = lines.filter(F.length(F.trim(column)) > 0)
    ok = F.try_parse_json(F.col(column)).isNotNull()
    return written.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def invalid_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.filter((F.length(F.trim(column)) > 0) & F.try_parse_json(F.col(column)).isNull())


def results(lines: DataFrame, column: str = "value") -> DataFrame:
    """custom_id and answer, the text of the last message in each result line; lines without an id go, broken answers are null."""
    parsed = lines.select(F.from_json(column, RESULT).alias("r")).filter("r.custom_id is not null")
    messages = F.filter(F.coalesce(F.col("r.response.body.output"), F.array()), lambda o: o["type"] == "message")
    texts = F.flatten(F.transform(messages, lambda o: F.transform(o["content"], lambda c: c["text"])))
    return parsed.select("r.custom_id", F.get(texts, F.size(texts) - 1).alias("answer"), F.col("r.error").alias("error"), F.col("r.metadata").alias("metadata"))


def summary(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: requests, answered and missing, by custom_id."""
    both = asked.select("custom_id").join(answers.select("custom_id").distinct().withColumn("_a", F.lit(1)), "custom_id", "left")
    return both.agg(F.count("*").alias("requests"), F.count("_a").alias("answered"), (F.count("*") - F.count("_a")).alias("missing"))


def article_of_result(custom_id: Column) -> Column:
    """The PMC page that a custom_id names, null for none."""
    return F.concat(F.lit(PMC_ROOT), extract(F.upper(custom_id), r"(PMC\d+)", 1))


class Provider(Protocol):
    """Somewhere that takes files of requests and gives files of results. What lies behind it is the caller's."""

    def submit(self, lines: list[str], description: str) -> str: ...

    def status(self, batch_id: str) -> dict[str, Any]: ...

    def results(self, batch_id: str) -> list[str]: ...


class LocalProvider:
    """Answers every request at once by a function from prompts to answers; for tests and offline use."""

    def __init__(self, answer: Callable[[list[str]], list[str | None]]) -> None:
        self.answer, self.jobs = answer, {}  # type: ignore[var-annotated]

    def submit(self, lines: list[str], description: str) -> str:
        batch_id = f"batch-{len(self.jobs)}"
        requests_ = [json.loads(x) for x in lines]
        said = self.answer([r["body"]["input"][-1]["content"] for r in requests_])
        self.jobs[batch_id] = [
            json.dumps({"custom_id": r["custom_id"], "error": None if a is not None else "no answer", "response": {"body": {"output": [] if a is None else [{"type": "message", "content": [{"text": a}]}]}}})
            for r, a in zip(requests_, said, strict=True)
        ]
        return batch_id

    def status(self, batch_id: str) -> dict[str, Any]:
        known = batch_id in self.jobs
        return {"id": batch_id, "status": "completed" if known else "not_found", "request_counts": {"total": len(self.jobs.get(batch_id, []))}}

    def results(self, batch_id: str) -> list[str]:
        return list(self.jobs[batch_id])


def submit(lines: DataFrame, provider: Provider, description: str = "", most_bytes: int = 200_000_000, column: str = "line") -> list[str]:
    """Hands requests over in parts of at most most_bytes, read one after the other, without their metadata; the batch ids."""
    ids, part, size = [], [], 0
    for row in lines.select(F.regexp_replace(column, r',"metadata":\{[^{}]*\}(?=\}$)', "").alias(column)).filter(F.col(column).isNotNull()).toLocalIterator():
        length = len(row[0].encode()) + 1
        if part and size + length > most_bytes:
            ids.append(provider.submit(part, description))
            part, size = [], 0
        part.append(row[0])
        size += length
    return [*ids, provider.submit(part, description)] if part else ids


def statuses(spark: SparkSession, provider: Provider, batch_ids: list[str]) -> DataFrame:
    """batch_id, status and requests of each batch."""
    found = [(i, provider.status(i)) for i in batch_ids]
    return spark.createDataFrame([(i, str(s.get("status")), int((s.get("request_counts") or {}).get("total", 0))) for i, s in found], "batch_id string, status string, requests bigint")


def download(spark: SparkSession, provider: Provider, batch_ids: list[str], path: str) -> DataFrame:
    """Writes the result lines of the batches that have ended to path and reads them back, as batch_id and value; others are left for later."""
    schema = "batch_id string, value string"
    for batch_id in batch_ids:
        if provider.status(batch_id).get("status") in ("completed", "cancelled", "expired"):
            rows = [(batch_id, line) for line in provider.results(batch_id)]
            spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).dropDuplicates()
