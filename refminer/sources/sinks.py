"""Sinks: tables, JSON lines in files of bounded size, one file per document, and insert-if-absent caches."""

from __future__ import annotations

import json
import math
import uuid
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refminer.functions.batches import pieces


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files with a header; arrays and maps as JSON."""
    nested = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))}
    df.withColumns(nested).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_fetched(df: DataFrame, path: str) -> None:
    if not path.rstrip("/").endswith(".parquet"):
        raise ValueError("fetched documents are written as .parquet")
    df.write.mode("overwrite").parquet(path)


def write_json_lines(lines: DataFrame, path: str, max_mb: float = 200.0, column: str = "line") -> int:
    """Lines written to files of at most max_mb each (a longer line is a file by itself); the number of files.

    Every task cuts its own lines into files, so nothing is counted or moved before. Nulls are left out.
    """
    limit = int(max_mb * 1e6)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size = uuid.uuid4().hex, 0
        for part in (piece for batch in parts for piece in pieces(batch)):
            kept = part.filter(part.column("value").is_valid())
            names = []
            for length in pc.binary_length(kept.column("value")).to_pylist():
                if size and size + length + 1 > limit:
                    name, size = uuid.uuid4().hex, 0
                size += length + 1
                names.append(name)
            yield pa.RecordBatch.from_arrays([kept.column("value"), pa.array(names, pa.string())], ["value", "part"])

    # a filter of nulls here would be pushed down and make every line twice
    named = lines.select(F.col(column).cast("string").alias("value")).mapInArrow(cut, "value string, part string")
    named.write.mode("overwrite").partitionBy("part").text(path)
    spark = lines.sparkSession
    return sum(1 for s in _listed(spark, path) if s.rpartition("/")[2].startswith("part="))


def _listed(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [str(s.getPath()) for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]


def document_file_name(key: Column, title: Column, extension: Column) -> Column:
    """id__title.ext of letters, digits, dashes and underscores; the end of a title of over 120 characters gives way to a digest of it."""
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_\-]+", "_")
    return F.concat(F.concat_ws("__", clean(key), F.when(F.length(clean(title)) > 120, F.concat(F.substring(clean(title), 1, 107), F.lit("_"), F.substring(F.md5(title), 1, 12))).otherwise(clean(title))), F.lit("."), F.lower(extension))


def write_documents(docs: DataFrame, path: str) -> None:
    """content of each document in its own folder file_name=... (documents have file_name and content)."""
    docs.select("file_name", F.col("content").alias("value")).write.mode("overwrite").option("compression", "none").partitionBy("file_name").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def append_absent(new: DataFrame, path: str, key: str) -> int:
    """Adds the rows of new whose key the Parquet cache at path lacks, each key once; how many. A path without a cache starts one."""
    from refminer.operators.tables import keep_first

    spark = new.sparkSession
    fresh = keep_first(new, [key], [F.sha2(F.to_json(F.struct(*new.columns)), 256)])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    from pyspark.sql import Observation

    seen = Observation()
    fresh.select(new.columns).observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return int(seen.get["n"])


def write_binary_files(files: DataFrame, path: str, name: str = "file_name", content: str = "content") -> DataFrame:
    """Writes each row's bytes to path/name through the tasks; the names and sizes written. path is a folder that all executors reach, names are single segments."""
    import os

    root = path.removeprefix("file://")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        for part in parts:
            names, sizes = part.column(name).to_pylist(), []
            for own, data in zip(names, part.column(content).to_pylist(), strict=True):
                whole = f"{root}/{own.replace('/', '_')}"
                with open(f"{whole}.{uuid.uuid4().hex}", "wb") as f:  # a task that is repeated replaces whole files
                    f.write(data)
                os.replace(f.name, whole)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["file_name", "size"])

    chosen = files.select(F.col(name), F.col(content).cast("binary").alias(content)).dropna()
    written = chosen.mapInArrow(run, "file_name string, size bigint").collect()
    return files.sparkSession.createDataFrame(written, "file_name string, size bigint")


def write_pdfs(docs: DataFrame, path: str) -> DataFrame:
    """The rows (file_name, content) whose bytes are a PDF's, as files ending in .pdf; the names and sizes written."""
    pdf = docs.filter(F.substring(F.col("content").cast("binary"), 1, 5) == F.encode(F.lit("%PDF-"), "utf-8"))
    named = pdf.withColumn("file_name", F.when(F.lower("file_name").endswith(".pdf"), F.col("file_name")).otherwise(F.concat("file_name", F.lit(".pdf"))))
    return write_binary_files(named, path)


def _cell(value: Any) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c><v>{value}</v></c>"
    text = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text[:32_767])}</t></is></c>'


def write_workbook(sheets: dict[str, DataFrame], path: str, most_rows: int = 1_048_575) -> None:
    """An Excel workbook with a sheet for each table, written by the driver: for reports. Columns without any value are left
    out. Sheets hold at most most_rows rows; a larger table is refused."""
    from refminer.operators.tables import empty_columns

    parts, names = [], []
    for title, df in sheets.items():
        empty = {r[0] for r in empty_columns(df).collect()}
        columns = [c for c in df.columns if c not in empty]
        rows = df.select(columns).limit(most_rows + 1).collect() if columns else []
        if len(rows) > most_rows:
            raise ValueError(f"{title} has more than {most_rows} rows")
        clean = "".join("_" if c in "[]:*?/\\" else c for c in title)[:31] or "Sheet"
        while clean.lower() in (n.lower() for n in names):
            clean = f"{clean[:28]}_{len(names)}"
        names.append(clean)
        lines = [columns, *rows]
        parts.append("".join(f"<row>{''.join(_cell(v) for v in line)}</row>" for line in lines))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        sheet_types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(parts) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{sheet_types}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(parts) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for k, part in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{part}</sheetData></worksheet>')


def report_sheets(citations: DataFrame, key: str = "source_url", most: int = 50) -> dict[str, DataFrame]:
    """The sheets of a report: all citations, the datasets, and one for each of the first `most` articles by key."""
    sheets = {"All results": citations, "Datasets": citations.filter("dataset_identifier is not null").select("dataset_identifier", "data_repository", "dataset_webpage").distinct()}
    for row in citations.select(key).distinct().orderBy(key).limit(most).collect():
        sheets[str(row[0])] = citations.filter(F.col(key) == row[0])
    return sheets


def save_batch_metadata(spark: SparkSession, metadata: dict[str, Any], path: str) -> None:
    """A batch's metadata as one JSON line; what was there is replaced."""
    spark.createDataFrame([(json.dumps(metadata, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_batch_metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    """What save_batch_metadata wrote; empty where there is nothing."""
    if not _exists(spark, path):
        return {}
    row = spark.read.text(path).first()
    return dict(json.loads(row[0])) if row else {}


def cached_embeddings(rows: DataFrame, path: str, source: str, model: str, embed: Any, key: str = "chunk_key") -> DataFrame:
    """rows with embedding. Vectors are kept in the Parquet table at path by source, model and key; only rows it lacks are embedded."""
    spark = rows.sparkSession
    schema = f"source string, model string, {key} string, embedding array<double>"
    stored = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    own = stored.filter((F.col("source") == source) & (F.col("model") == model)).select(key)
    fresh = embed(rows.join(own, key, "left_anti")).select(F.lit(source).alias("source"), F.lit(model).alias("model"), F.col(key).cast("string").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
    fresh.dropDuplicates([key]).write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path).filter((F.col("source") == source) & (F.col("model") == model))
    return rows.join(known.select(key, "embedding"), key, "left")


def cached_answers(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """prompts (with prompt_id) and the cached answer, null where there is none."""
    return prompts.join(cache.select("prompt_id", "answer"), "prompt_id", "left")
