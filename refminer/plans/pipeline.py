"""From documents to the table of dataset citations and supplementary files."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from refminer.functions.batches import pieces
from refminer.functions.identifiers import download_link, null_if_sentinel
from refminer.functions.text import pieces_of
from refminer.operators import extraction, markup, ontology, resolve, retrieval
from refminer.operators.tables import dedup_items, drop_incomplete

COLUMNS = (
    "dataset_identifier data_repository dataset_webpage source_section retrieval_pattern access_mode link source_url download_link title "
    "content_type id caption description context_description file_extension pub_title raw_data_format"
).split()


def citations_from_text(docs: DataFrame, source: Any = None) -> DataFrame:
    """source_url and resolved citations of the identifiers in texts (source_url, text), each once a document; rules alone."""
    mentions = retrieval.identifier_mentions(docs.select("source_url", "text"), source=source)
    items = mentions.select("source_url", F.col("mention").alias("dataset_identifier"), F.col("repo").alias("data_repository")).distinct()
    entries = ontology.load(source)
    repo = F.col("data_repository")
    return items.withColumns({
        "dataset_identifier": resolve.accession_for_repository(F.col("dataset_identifier"), repo, entries),
        "dataset_webpage": resolve.landing_page(repo, F.col("dataset_identifier"), entries),
        "access_mode": resolve.lookup(entries, repo, "access_mode"),
    })


def chunks_of(sections: DataFrame, budget: int = 512) -> DataFrame:
    """key, section_title, sec_type, kind, chunk_key and text: paragraphs, over the budget split into packed sentences; then tables."""
    kept = ["key", "sec_idx", "section_title", "sec_type", "kind"]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in pieces(batch)):
            at, places, texts = [], [], []
            for k, (paragraphs, table) in enumerate(zip(part.column("paragraphs"), part.column("tables"), strict=True)):
                own = pieces_of(paragraphs.as_py(), budget) + [t for t in (table.as_py(),) if t]
                at += [k] * len(own)
                places += range(len(own))
                texts += own
            own_rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[part.column(c).take(own_rows) for c in kept], pa.array(places, pa.int32()), pa.array(texts, pa.string())], [*kept, "chunk_id", "text"])

    schema = StructType([*[sections.schema[c] for c in kept], StructField("chunk_id", IntegerType()), StructField("text", StringType())])
    rows = sections.select(*kept, "paragraphs", "tables").mapInArrow(cut, schema)
    return rows.withColumn("chunk_key", F.concat_ws("/", "key", "sec_idx", "chunk_id"))


def documents_to_citations(
    docs: DataFrame, extractor: extraction.Extractor, model: str = "rules", full_read: bool = False, hits: DataFrame | None = None, section_filter: str | None = None, context_tokens: int = 126_000, cache: DataFrame | None = None, source: Any = None
) -> DataFrame:
    """The 18 columns for docs (source_url, content, format): a row per citation and per supplementary file.

    Retrieve-then-read sends the extractor only chunks of availability statements, chunks in hits (chunk_key) and chunks
    with an identifier; full_read sends whole documents, long ones in overlapping stretches. section_filter keeps
    'data_availability_statement' or 'supplementary_material' rows alone. Broken documents give no rows.
    """
    keyed = docs.select(F.col("source_url").alias("key"), "content", "format")
    titles = markup.titles(keyed).groupBy("key").agg(F.min("pub_title").alias("pub_title"))
    parts: list[DataFrame] = []
    if section_filter in (None, "data_availability_statement"):
        sections = markup.sections(keyed)
        if full_read:
            content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sec_idx", "section_title", "text", "tables"))), lambda s: F.concat_ws("\n", s["section_title"], s["text"], s["tables"])), "\n\n")
            read = sections.groupBy("key").agg(content.alias("content")).select("key", "content", F.lit("full text").alias("source_section"), F.lit("full document").alias("retrieval_pattern"))
        else:
            chunks = chunks_of(sections)
            none = chunks.select("chunk_key").limit(0) if hits is None else hits
            found = retrieval.relevant_chunks(chunks, none, "chunk_key", source)
            read = found.select("key", F.col("text").alias("content"), F.coalesce(F.when(F.col("kind") == "availability", F.lit("data_availability")), F.col("section_title")).alias("source_section"), F.when(F.col("reason") == "rule", F.lit("data availability")).otherwise(F.col("reason")).alias("retrieval_pattern"))
        fitted = extraction.fit_to_context(read, context_tokens)
        repos = F.lit(", ".join(e["repo_name"] for e in ontology.load(source) if e["repo_name"]))
        prompts = fitted.select("key", "source_section", "retrieval_pattern", extraction.render(extraction.PROMPT, repos=repos, content=F.col("content")).alias("prompt"))
        answers = extraction.ask(prompts, extractor, model, cache).select("key", "source_section", "retrieval_pattern", "answer")
        items = extraction.parse_answers(answers)
        resolved = resolve.resolve_citations(items.select("key", "source_section", "retrieval_pattern", *extraction.FIELDS), source)
        parts.append(dedup_items(drop_incomplete(resolved), "key", [F.col("retrieval_pattern") != "data availability", "source_section", "data_repository"]))
    if section_filter in (None, "supplementary_material"):
        files = markup.supplements(keyed).withColumn("download_link", download_link(F.col("link"), F.col("content_type"), F.col("key")))
        files = files.withColumn("description", F.col("caption")).withColumn("retrieval_pattern", F.lit("supplementary material"))
        parts.append(files.dropDuplicates(["key", "link", "id"]))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return with_contract(out.join(titles, "key", "left").join(keyed.select("key", F.col("format").alias("raw_data_format")).distinct(), "key", "left").withColumnRenamed("key", "source_url"))


def with_contract(rows: DataFrame) -> DataFrame:
    """Exactly the 18 columns, as strings, in their order; missing ones are null."""
    have = set(rows.columns)

    def column(name: str) -> Column:
        return (F.col(name).cast("string") if name in have else F.lit(None).cast("string")).alias(name)

    return rows.select(*map(column, COLUMNS))


def datasets_of_articles(citations: DataFrame) -> DataFrame:
    """publication_url, dataset_identifier, data_repository and dataset_webpage of the rows that name a dataset."""
    named = citations.filter(null_if_sentinel(F.col("dataset_identifier")).isNotNull())
    return named.select(F.col("source_url").alias("publication_url"), "dataset_identifier", "data_repository", "dataset_webpage").distinct()
