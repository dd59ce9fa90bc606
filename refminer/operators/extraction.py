"""Extraction of citations by a language model or anything else that answers prompts, and tolerant reading of answers.

An Extractor is a function from prompts to answers. What it is belongs to the caller; the one here works by rules alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from refminer.functions.batches import pieces
from refminer.functions.identifiers import prompt_id
from refminer.functions.text import token_estimate
from refminer.operators import ontology

#: Gets the prompts of a batch, gives as many answers; a None is an answer that failed.
Extractor = Callable[[list[str]], list[str | None]]

PROMPT = "List every dataset that the text below refers to, as JSON: {\"datasets\": [{\"dataset_identifier\": ..., \"data_repository\": ...}]}.\nRepositories: {repos}\nText: {content}"
FIELDS = ("dataset_identifier", "data_repository", "dataset_webpage")


def render(template: str, **values: Column) -> Column:
    """The template with {name} replaced by each value; braces inside values stay as they are."""
    pieces: list[Column] = []
    for part in re.split(r"(\{\w+\})", template):
        name = part[1:-1]
        pieces.append(values[name] if part.startswith("{") and name in values else F.lit(part))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in pieces])


def is_no_dataset(answer: Column) -> Column:
    """Whether an answer says that there is none. A null does."""
    low = F.lower(answer)
    return answer.isNull() | low.contains("n/a") | low.contains("not applicable") | low.contains("no dataset") | low.contains("none")


def _objects(text: str) -> Iterator[Any]:
    """Whole JSON values that begin at a brace anywhere in a text, outermost first."""
    decoder, at = json.JSONDecoder(strict=False), 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            yield value
            at = end
        except (ValueError, RecursionError):
            at += 1


def parse_json(answer: str | None) -> list[Any]:
    """The items of an answer: a list, or an object's `datasets`, or the object itself.

    Code fences and text around the JSON don't matter. Of an answer that was cut off, or has a broken item, all whole
    items are kept. Single quotes for strings and commas before a closing bracket are mended.
    """
    if not answer:
        return []
    text = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", answer.strip())
    start = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if start < 0:
        return []
    for attempt in (text[start:], re.sub(r",\s*([}\]])", r"\1", text[start:]), re.sub(r"(?<![A-Za-z])'|'(?![A-Za-z])", '"', text[start:])):
        try:
            value, _ = json.JSONDecoder(strict=False).raw_decode(attempt)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            inner = value.get("datasets", value)
            return inner if isinstance(inner, list) else [inner]
        return value if isinstance(value, list) else []
    return [v for v in _objects(text[start:]) if isinstance(v, dict)]


def normalised_item(item: Any) -> dict[str, str] | None:
    """An item's fields as strings; 'id, repository' strings are split; None for what says nothing."""
    if isinstance(item, str):
        parts = [p.strip() for p in item.split(",")]
        return {"dataset_identifier": parts[0], "data_repository": parts[1] if len(parts) > 1 else "n/a"} if len(item) >= 3 else None
    if not isinstance(item, dict) or not any(item.values()):
        return None
    named = {"id": "dataset_identifier", "dataset_id": "dataset_identifier", "repo": "data_repository", "repository_reference": "data_repository"}
    return {named.get(k, k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in item.items() if v is not None}


def parse_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """One row per item: the other columns, dataset_identifier, data_repository, dataset_webpage and extras (all other keys).

    Answers without an item have no row.
    """
    others = [c for c in answers.columns if c != column]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in pieces(batch)):
            at, items = [], []
            for k, text in enumerate(part.column(column).to_pylist()):
                found = [i for i in map(normalised_item, parse_json(text)) if i]
                at += [k] * len(found)
                items += found
            index = pa.array(at, pa.int64())
            extras = pa.array([[(k, v) for k, v in i.items() if k not in FIELDS] for i in items], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*[part.column(c).take(index) for c in others], *[pa.array([i.get(f) for i in items], pa.string()) for f in FIELDS], extras], [*others, *FIELDS, "extras"])

    fields = "".join(f"`{c}` {answers.schema[c].dataType.simpleString()}, " for c in others)
    return answers.select(*others, column).mapInArrow(run, fields + ", ".join(f"{f} string" for f in FIELDS) + ", extras map<string,string>")


def first_objects(answers: DataFrame, key: str, name: str = "_said", column: str = "answer") -> DataFrame:
    """answers with the fields, a map, of the first object in any answer of the same key, by a digest of it; null for none.

    The objects are read where the rows are: nothing is joined back to them.
    """
    others = [c for c in answers.columns if c != column]
    kind = pa.list_(pa.map_(pa.string(), pa.string()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in pieces(batch)):
            read = [[_fields(i) for i in map(normalised_item, parse_json(text)) if i] for text in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(read, kind)], [*others, "_o"])

    schema = StructType([*answers.select(others).schema.fields, StructField("_o", ArrayType(MapType(StringType(), StringType())))])
    marked = F.transform("_o", lambda o: F.struct(F.sha2(F.to_json(o), 256).alias("h"), o.alias("o")))
    least = F.array_sort(marked, lambda x, y: F.when(x["h"] < y["h"], -1).when(x["h"] > y["h"], 1).otherwise(0))
    own = answers.select(*others, column).mapInArrow(run, schema).withColumn("_f", F.get(least, F.lit(0)))
    return own.withColumn(name, F.min_by("_f.o", "_f.h").over(Window.partitionBy(key))).select(*others, name)


def _fields(item: dict[str, str]) -> list[tuple[str, str]]:
    """All other keys, then FIELDS."""
    return [(k, v) for k, v in item.items() if k not in FIELDS] + [(f, item[f]) for f in FIELDS if item.get(f) is not None]


def ask(prompts: DataFrame, extractor: Extractor, model: str, cache: DataFrame | None = None) -> DataFrame:
    """prompts (with prompt) and prompt_id, answer. What the cache has isn't asked again; equal prompts are asked once.

    The rows are made once: equal prompts come one after the other in a partition, so nothing is joined back to them.
    """
    keyed = prompts.withColumn("prompt_id", prompt_id(F.lit(model), F.lit(0.0), F.col("prompt")))
    if cache is not None:
        keyed = keyed.join(cache.select("prompt_id", F.col("answer").cast("string").alias("answer"), F.lit(True).alias("_known")), "prompt_id", "left")
    else:
        keyed = keyed.withColumns({"answer": F.lit(None).cast("string"), "_known": F.lit(None).cast("boolean")})
    rows = keyed.select("prompt_id", *prompts.columns, "answer", "_known")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[Any, str | None] = (None, None)
        for part in parts:
            for piece in pieces(part):
                names, known = piece.column("prompt_id").to_pylist(), piece.column("_known").to_pylist()
                given, texts = piece.column("answer").to_pylist(), piece.column("prompt")
                open_ = [k for k, (name, own) in enumerate(zip(names, known, strict=True)) if own is None and name is not None and name != (names[k - 1] if k else last[0])]
                said = dict(zip(open_, extractor(texts.take(pa.array(open_, pa.int64())).to_pylist()) if open_ else [], strict=True))
                out = []
                for k, name in enumerate(names):
                    if known[k] is None and name is not None:
                        if k in said:
                            last = name, said[k]
                        given[k] = last[1]
                    out.append(given[k])
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in columns], pa.array(out, pa.string())], [*columns, "answer"])

    columns = ["prompt_id", *prompts.columns]
    schema = StructType([*rows.select(columns).schema.fields, StructField("answer", StringType())])
    return rows.repartition("prompt_id").sortWithinPartitions("prompt_id").mapInArrow(run, schema)


def fit_to_context(chunks: DataFrame, limit: int, content: str = "content") -> DataFrame:
    """chunks, long ones split into stretches of 3 characters per token of the limit, overlapping by 100, so that all is read."""
    from refminer.functions.text import character_chunks

    long = token_estimate(F.col(content)) > limit
    parts = F.when(long, F.transform(character_chunks(F.col(content), 3 * limit, 100), lambda c: c["text"])).otherwise(F.array(content))
    return chunks.select(*[c for c in chunks.columns if c != content], F.explode(parts).alias(content))


class RuleExtractor:
    """Answers with the identifiers of known repositories that stand in the prompt's text; deterministic, offline."""

    def __init__(self, source: Any = None) -> None:
        from refminer.operators.retrieval import within_words_with_digits

        self.patterns = [(repo, re.compile(pattern, re.I)) for repo, pattern in ontology.search_patterns(source)]
        self.by_words = all(within_words_with_digits(p.pattern) for _, p in self.patterns)

    def __call__(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for prompt in prompts:
            text = prompt.rpartition("\nText: ")[2]
            if self.by_words:  # an identifier has a digit
                text = " ".join(w for w in text.split() if not w.isalpha())
            found = dict.fromkeys((m.group(0), repo) for repo, pattern in self.patterns for m in pattern.finditer(text))
            out.append(json.dumps({"datasets": [{"dataset_identifier": i, "data_repository": repo} for i, repo in found]}))
        return out


def link_class(link: Column) -> Column:
    """Kind of a link by rules: data repository, supplement, article, or other."""
    return (
        F.when(link.rlike(r"(?i)\.(xlsx?|csv|tsv|zip|docx?|pptx?|txt)([?#]|$)|/bin/|supp"), F.lit("supplementary"))
        .when(link.rlike(r"(?i)geo/query|proteomexchange|massive\.ucsd|zenodo|figshare|dryad|synapse\.org|ega-archive|rcsb\.org"), F.lit("dataset"))
        .when(link.rlike(r"(?i)doi\.org|/articles?/|pubmed"), F.lit("article"))
        .otherwise(F.lit("other"))
    )


def supplement_keywords(rows: DataFrame, text: str = "context_description", most: int = 8) -> DataFrame:
    """rows with keywords: the distinct longer words of the text about a file, in order, at most so many; its description where that has none."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\w\s-]", " ")), r"\s+"), lambda w: F.length(w) > 5))
    return rows.withColumn("keywords", F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, most), ", ")).otherwise(F.col("description") if "description" in rows.columns else F.lit(None).cast("string")))
