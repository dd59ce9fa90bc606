"""Queries that write and read: sinks, stores, recorded fetches, batches and the stream, over whole tables and against SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refminer.operators import batch, extraction, retrieval, tables
from refminer.plans.article_queries import CITED_BY, _cited
from refminer.plans.queries import injected, query, table
from refminer.sources import fetchers, references, sinks
from refminer.sources.scratch import new_path
from refminer.streaming import ingest

PLAIN = "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '_', 'g')"


def _plain() -> Column:
    # the same as PLAIN's class; ranges in a negated class make Java's expressions twenty times as slow
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{Alnum} ]", "_")


@query("SELECT c_custkey, c_name, '[\"a\",\"' || c_custkey || '\"]' AS tags FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    n = F.col("c_custkey").cast("string")
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array(F.lit("a"), n).alias("tags")), path)
    back = spark.read.option("header", True).option("escape", '"').schema("c_custkey bigint, c_name string, tags string").csv(path)
    return back.select("c_custkey", "c_name", "tags")


@query("SELECT p_partkey, p_name FROM part")
def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tsv")
    table(spark, sf_dir, "part").select("p_partkey", "p_name").write.option("header", True).option("sep", "\t").csv(path)
    return references.read_delimited(spark, path, "\t", "p_partkey bigint, p_name string")


@query(f"SELECT 'P' || doc_id AS publication, md5({PLAIN}) AS digest, 'XML' AS format FROM documents")
def fetched_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store") + ".parquet"
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("publication"), _plain().alias("raw_cont"), F.lit("XML").alias("format"))
    sinks.write_fetched(docs, path)
    return references.read_store(spark, path).select("publication", F.md5("content").alias("digest"), "format")


@query(f"SELECT doc_id, md5({PLAIN}) AS digest FROM documents")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lines")
    docs = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", _plain().alias("t"))).alias("line"))
    sinks.write_json_lines(docs, path, max_mb=0.5)
    return references.read_json_lines(spark, path + "/part=*", "doc_id bigint, t string").select("doc_id", F.md5("t").alias("digest"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def appended_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "cache")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sinks.append_absent(orders.filter("o_orderkey % 3 = 0"), path, "o_orderkey")
    sinks.append_absent(orders.unionByName(orders), path, "o_orderkey")
    return spark.read.parquet(path)


@query("SELECT ref FROM (SELECT DISTINCT trim(url) AS ref FROM pages WHERE trim(url) <> '')")
def listed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "refs")
    table(spark, sf_dir, "pages").select(F.concat(F.lit(" "), F.col("url"), F.lit("  ")).alias("value")).filter("value is not null").unionByName(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(path)
    return references.read_references(spark, path).distinct()


@query("SELECT 'f' || n_nationkey || '__' || n_name || '.xml' AS file_name, n_name AS pub_title, 'XML' AS format, CAST(length('<a>' || n_name || '</a>') AS BIGINT) AS length FROM nation")
def directory_of_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "articles")
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), F.lit("__"), "n_name", F.lit(".xml")).alias("file_name"), F.encode(F.concat(F.lit("<a>"), "n_name", F.lit("</a>")), "utf-8").alias("content"))
    sinks.write_binary_files(files, path)
    return references.read_directory(spark, path).select("file_name", "pub_title", "format", "length")


@query("SELECT 'a' || n_nationkey || '.pdf' AS file_name, CAST(length('%PDF-' || n_name) AS BIGINT) AS length FROM nation WHERE n_nationkey % 2 = 0")
def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "pdf")
    n = F.col("n_nationkey")
    content = F.encode(F.concat(F.when(n % 2 == 0, "%PDF-").otherwise("<html>"), "n_name"), "utf-8")
    sinks.write_pdfs(table(spark, sf_dir, "nation").select(F.concat(F.lit("a"), n.cast("string")).alias("file_name"), content.alias("content")), path)
    return references.read_binary(spark, path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"), "length")


@query("SELECT 'f' || n_nationkey || '.xml' AS file_name, '<a>' || n_name || '</a>' AS content FROM nation")
def document_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "documents")
    docs = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), F.lit(".xml")).alias("file_name"), F.concat(F.lit("<a>"), "n_name", F.lit("</a>")).alias("content"))
    sinks.write_documents(docs, path)
    return spark.read.text(path).select("file_name", F.col("value").alias("content"))


@query("SELECT vec_id, label, CAST(64 AS INTEGER) AS dims FROM embeddings")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vectors")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_key"), "vec_id", "label", "embedding")
    rows, known = vectors.drop("embedding"), vectors.select("chunk_key", "embedding")
    embed = lambda asked: asked.join(known, "chunk_key")
    sinks.cached_embeddings(rows.filter("vec_id % 2 = 0"), path, "s", "m", embed)
    return sinks.cached_embeddings(rows, path, "s", "m", embed).select("vec_id", "label", F.size("embedding").alias("dims"))


def _site(method: str, url: str) -> fetchers.Response:
    """A made-up server: page k is a page, a wall, a wrong method, or nothing, by k % 4; the interface has 130 records."""
    if m := re.search(r"/api\?page=(\d+)&size=(\d+)", url):
        page, size = int(m.group(1)), int(m.group(2))
        items = [{"id": k} for k in range((page - 1) * size, min(page * size, 130))]
        return fetchers.Response(200, url, "application/json", json.dumps({"total": 130, "items": items}).encode())
    if url.endswith("sitemap.xml"):
        return fetchers.Response(200, url, "text/xml", ("<urlset>" + "".join(f"<url><loc>https://site.org/lab/{k}</loc></url><url><loc>https://site.org/x{k}</loc></url>" for k in range(40)) + "</urlset>").encode())
    k = int(re.sub(r"\D", "", url) or 0)
    if k % 4 == 2 and method == "HEAD":
        return fetchers.Response(405, url, "", b"")
    if k % 4 == 3:
        return fetchers.Response(404, url, "", b"")
    return fetchers.Response(200, url + "#end", "text/html", b"<p>captcha</p>" if k % 4 == 1 else f"page {k}".encode())


def _site_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("https://site.org/"), F.col("o_orderkey").cast("string")).alias("url"))


@query("SELECT DISTINCT 'https://site.org/' || o_orderkey AS url, o_orderkey % 4 < 3 AS reachable FROM orders")
def reachable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetchers.reachable(_site_urls(spark, sf_dir), _site)


@query("SELECT DISTINCT 'https://site.org/' || o_orderkey AS url, 'https://site.org/' || o_orderkey || CASE WHEN o_orderkey % 4 < 3 THEN '#end' ELSE '' END AS final_url FROM orders")
def resolved_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetchers.resolved_urls(_site_urls(spark, sf_dir), _site)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'page ' || o_orderkey END AS content, CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'http' END AS fetched_by FROM orders")
def http_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = references.fetch(_site_urls(spark, sf_dir), [("http", fetchers.http_fetcher(_site, delay=0))])
    return found.select("o_orderkey", "content", "fetched_by")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'blocked' WHEN 3 THEN 'failed' ELSE 'ok' END AS status, CAST(o_orderkey AS VARCHAR) AS file_name FROM orders")
def downloaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetchers.downloads(_site_urls(spark, sf_dir), _site).select("o_orderkey", "status", "file_name")


@query("SELECT 'https://site.org/lab/' || k AS url FROM range(0, 40) AS r(k)")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetchers.sitemap(spark, "https://site.org/lab", _site)


@query("SELECT CAST(k // 50 + 1 AS BIGINT) AS page, '{\"id\": ' || k || '}' AS record FROM range(0, 130) AS r(k)")
def harvested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetchers.harvest(spark, "https://site.org/api?page={page}&size={size}", new_path(spark, "harvest"), _site, 50)


@query("SELECT n_nationkey, 'GSE' || n_nationkey AS dataset_identifier, 'completed' AS status FROM nation")
def batch_life_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    prompts = table(spark, sf_dir, "nation").select(n.alias("custom_id"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("x\nText: see GSE"), n).alias("content"))).alias("messages"))
    provider = batch.LocalProvider(extraction.RuleExtractor())
    ids = batch.submit(batch.requests(prompts, "m"), provider, most_bytes=600)
    answers = batch.results(batch.download(spark, provider, ids, new_path(spark, "results")))
    states = batch.statuses(spark, provider, ids).select("status").distinct()
    items = extraction.parse_answers(answers.select("custom_id", "answer"))
    return items.select(F.col("custom_id").cast("bigint").alias("n_nationkey"), "dataset_identifier", F.lit(states.first()[0]).alias("status"))


@query(f"WITH {CITED_BY} SELECT doc_id FROM c WHERE NOT ((dataset_identifier IS NULL OR data_repository IS NULL OR data_repository = 'n/a') AND doc_id % 2 = 1)")
def complete_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _cited(spark, sf_dir).withColumn("dataset_webpage", F.when(F.col("doc_id") % 2 == 0, "p").otherwise("n/a"))
    return tables.drop_incomplete(cited).select("doc_id")


@query("SELECT doc_id // 4 AS key, min(doc_id) AS doc_id, 'PXD00' || (doc_id // 4) AS dataset_identifier FROM documents GROUP BY 1 UNION ALL SELECT doc_id // 4, doc_id, 'n/a' FROM documents WHERE doc_id % 3 > 0")
def deduplicated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.floor(F.col("doc_id") / 4)
    docs = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))
    named = docs.select("*", F.concat(F.when(F.col("doc_id") % 2 == 0, "10.6019/").otherwise(""), F.lit("PXD00"), key.cast("string")).alias("dataset_identifier"), F.lit("r").alias("data_repository"))
    missing = docs.filter("doc_id % 3 > 0").select("*", F.lit("n/a").alias("dataset_identifier"), F.lit("r").alias("data_repository"))
    empty = docs.select("*", F.lit("").alias("dataset_identifier"), F.lit("r").alias("data_repository"))
    return tables.dedup_items(named.unionByName(missing).unionByName(empty), "key", ["doc_id"]).select("key", "doc_id", "dataset_identifier")


@query("SELECT doc_id, 'GSE' || (doc_id + 1000) AS dataset_identifier, 'geo' AS data_repository FROM documents")
def ingested_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents go through the stream, in two runs of it, each file once."""
    path, out, log = new_path(spark, "inbox"), new_path(spark, "citations"), new_path(spark, "log")
    docs = injected(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("source_url"), "text")
    for half in (0, 1):
        docs.filter(F.col("doc_id") % 2 == half).select("source_url", "text").write.mode("append").json(path)
        ingest.ingest(ingest.document_stream(spark, path), out, log).awaitTermination()
    found = spark.read.option("basePath", out).parquet(out)
    return found.filter("data_repository = 'geo'").select(F.col("source_url").cast("bigint").alias("doc_id"), "dataset_identifier", "data_repository")


@query("SELECT doc_id, 'a word and https://x.org/ab' || doc_id || ' end. Next' AS text FROM documents")
def merged_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refminer.functions import text as tx

    raw = F.concat(F.lit("a wo-\nrd and\nhttps://x.org/a\nb"), F.col("doc_id").cast("string"), F.lit(" end. Next"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.merge_line_breaks(raw).alias("text"))


@query("SELECT doc_id, ['GSE' || doc_id || ',geo', 'b,geo'] AS items FROM documents")
def citing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refminer.functions import identifiers as ids

    said = F.concat(F.lit("GSE"), F.col("doc_id").cast("string"), F.lit(" and b , geo"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.citing_items(said).alias("items"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, 'body ' || doc_id || chr(10) || 'more' || chr(10) || 'body two' AS text FROM documents")
def pages_without_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents")
    first = docs.select(n.alias("key"), F.lit(1).alias("page"), F.concat(F.lit("Journal of X\nbody "), n, F.lit("\nmore\nPage 1")).alias("text"))
    second = docs.select(n.alias("key"), F.lit(2).alias("page"), F.lit("Journal of X\nbody two\nPage 2").alias("text"))
    return tables.without_running_lines(first.unionByName(second))


@query("SELECT doc_id, CAST(n AS INTEGER) AS chunk FROM documents CROSS JOIN range(0, 2) AS r(n)")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refminer.operators import markup

    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("h | h\n"), F.repeat(F.lit("a | b\n"), 5), F.col("doc_id").cast("string")).alias("text"))
    cut = F.udf(lambda t: markup.table_chunks(t, 6), "array<string>", useArrow=True)
    return rows.select("doc_id", F.posexplode(cut("text")).alias("chunk", "t")).select("doc_id", "chunk")


@query("SELECT vec_id, CAST(1 AS DOUBLE) AS norm FROM embeddings")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.embed(table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("word number "), F.col("vec_id").cast("string")).alias("text")))
    return rows.select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))
