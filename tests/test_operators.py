"""Operators over small tables, with the awkward rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from refminer.operators import batch, extraction, markup, metadata, ontology, resolve, retrieval, tables
from refminer.plans import pipeline
from refminer.sources import references, sinks
from refminer.streaming import ingest

CITATIONS = "dataset_identifier string, data_repository string, dataset_webpage string"


def resolved(spark, rows):
    return [tuple(r)[:3] for r in resolve.resolve_citations(spark.createDataFrame(rows, CITATIONS)).collect()]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        (("GSE12", "GEO", None), [("GSE12", "geo", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSE12")]),
        (("PXD00012", "ProteomeXchange", None), [("PXD00012", "proteomecentral.proteomexchange.org", "https://proteomecentral.proteomexchange.org/cgi/GetDataset?ID=PXD00012")]),
        (("n/a", "GEO", None), []),
        (("n/a", "n/a", "https://ega-archive.org/studies/EGAS1"), [("EGAS1", "ega-archive.org", "https://ega-archive.org/studies/EGAS1")]),
        (("OP08-OP11", "nuccore", None), [(f"OP{k}", "nuccore", f"https://www.ncbi.nlm.nih.gov/nuccore/OP{k}") for k in ("08", "09", "10", "11")]),
        ((None, None, None), []),
    ],
)
def test_resolution(spark, given, wanted):
    assert resolved(spark, [given]) == wanted


def test_every_entry_resolves_by_key_and_name(spark):
    entries = ontology.load()
    rows = [(e["repo"], n) for e in entries for n in (e["repo"], e["repo_name"])]
    df = spark.createDataFrame(rows, "key string, said string")
    got = {(r[0], r[1]): r[2] for r in df.select("key", "said", resolve.resolve_repository(F.col("said"), F.lit(None).cast("string"), entries)).collect()}
    for (key, said), found in got.items():
        firsts = [e for e in entries if said.lower() == e["repo"].lower() or e["repo_name"].lower() in said.lower()]
        assert found == (firsts[0]["repo_mapping"] or firsts[0]["repo"]).lower(), (key, said)


def test_ontology_from_file(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"repos": {"a.org": {"repo_name": "A", "id_pattern": "AA\\d+", "dataset_webpage_url_ptr": "https://a.org/__ID__"}}}))
    rows = spark.createDataFrame([("AA1", "x")], "dataset_identifier string, data_repository string")
    assert resolve.resolve_citations(rows, str(tmp_path / "o.json")).first()["dataset_webpage"] == "https://a.org/AA1"
    assert ontology.dimension(spark).count() == len(ontology.DEFAULT)


def test_mentions_keep_repeats_and_order(spark):
    docs = spark.createDataFrame([(1, "GSE1 and gse1, MSV2"), (2, None), (3, ""), (4, "none here")], "doc_id int, text string")
    assert [tuple(r) for r in retrieval.identifier_mentions(docs).collect()] == [(1, "massive.ucsd.edu", "MSV2"), (1, "geo", "GSE1"), (1, "geo", "gse1")]


def test_nearest_is_exact(spark):
    rng = random.Random(3)
    rows = [(k, [rng.random() for _ in range(4)]) for k in range(60)] + [(k, [0.5] * 4) for k in range(60, 66)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in retrieval.nearest(df, df.withColumnRenamed("vec_id", "query_id"), 5, block=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    vectors = {r[0]: r[1] for r in df.collect() if r[1]}
    assert set(got) == set(vectors)
    for q, v in vectors.items():
        best = sorted(vectors, key=lambda k: (sum((a - b) ** 2 for a, b in zip(v, vectors[k], strict=True)), k))[:5]
        assert [k for _, k in sorted(got[q])] == best


def test_retrieval_reasons_and_best(spark):
    chunks = spark.createDataFrame([("a", "availability", "x"), ("b", "section", "y"), ("c", "section", "GSE9"), ("d", "section", "z")], "chunk_key string, kind string, text string")
    hits = spark.createDataFrame([("b",), ("b",), ("a",)], "chunk_key string")
    assert {r["chunk_key"]: r["reason"] for r in retrieval.relevant_chunks(chunks, hits).collect()} == {"a": "rule", "b": "similar", "c": "identifier"}
    scores = spark.createDataFrame([("q", "m", 5, 0.5), ("q", "m", 3, 0.5), ("q", "n", 1, 0.2)], "query string, model string, k int, recall double")
    assert tuple(retrieval.best_configuration(scores).first()) == ("q", "m", 3, 0.5)


def test_recall(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, vec_id int, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (2, 10)], "query_id int, vec_id int")
    assert {r["k"]: r["recall"] for r in retrieval.recall_at(hits, relevant, (1, 2)).collect()} == {1: 0.0, 2: 0.25}


def test_dedup_and_merge(spark):
    items = spark.createDataFrame([("d", "10.6019/PXD1", "a", 1), ("d", "PXD1", "b", 2), ("d", "n/a", "r", 3), ("d", "n/a", "n/a", 4), ("d", "n/a", "s", 5), ("d", "", "t", 6)], "key string, dataset_identifier string, data_repository string, pos int")
    assert sorted(r["pos"] for r in tables.dedup_items(items, "key", ["pos"]).collect()) == [1, 3, 5]
    chunks = spark.createDataFrame([(1, 0, " A ", "t1"), (1, 1, "a", "t2"), (1, 2, "b", "t1"), (2, 0, "a", None)], "doc int, pos int, text string, section_title string")
    assert sorted(tuple(r) for r in tables.merge_equal_chunks(chunks, "doc", "pos").collect()) == [(1, 0, " A ", "t1 | t2"), (1, 2, "b", "t1"), (2, 0, "a", "")]


def test_evaluation(spark):
    kind = "page string, identifier string"
    pages = spark.createDataFrame([("A",), ("b",), ("c",)], "page string")
    got = tables.evaluate(spark.createDataFrame([("a", "GSE1"), ("a", "x"), ("b", "n/a")], kind), spark.createDataFrame([("A", "gse1"), ("A", "GSE2"), ("c", "PXD1")], kind), pages).first()
    assert got["average_precision"] == pytest.approx((0.5 + 1 + 0) / 3) and got["average_recall"] == pytest.approx((0.5 + 1 + 0) / 3)


def test_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in tables.cell_differences(a.dropDuplicates(), b, "k").collect()) == [(1, "v", "x", "y")]
    assert sorted(tuple(r) for r in tables.compare_tables(a, b).collect()) == [(1, "x", "left_only"), (1, "y", "right_only"), (3, "z", "left_only")]


def test_small_aggregates(spark):
    rows = spark.createDataFrame([("csv", "geo"), (None, "geo"), ("csv", None)], "file_extension string, data_repository string")
    assert {(r["what"], r["value"]): r["n"] for r in tables.result_summary(rows).collect()} == {("rows", None): 3, ("file_extension", "csv"): 2, ("data_repository", "geo"): 2}
    assert tables.input_coverage(spark.createDataFrame([(["GSE1", "GSE2"], "has gse1"), ([], "x")], "identifiers array<string>, content string")).first()[0] == 0.5
    found = spark.createDataFrame([("P1", "GSE1", None, None)], "source_url string, dataset_identifier string, dataset_webpage string, title string")
    catalog = spark.createDataFrame([(1, "p1", [], [], ["gse1"]), (2, "p1", ["u"], [], []), (3, "p2", [], [], ["gse1"])], "dataset_id int, publication string, urls array<string>, titles array<string>, accessions array<string>")
    assert {r[0]: r[1] for r in tables.catalog_recall(catalog, found).collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize(
    ("answer", "count"),
    [
        ('{"datasets": [{"a": 1}, {"a": 2}]}', 2),
        ('```json\n[{"a": 1}]\n```', 1),
        ('Sure: {"a": 1,}', 1),
        ('{"datasets": [' + ", ".join(f'{{"dataset_identifier": "G{k}"}}' for k in range(10)) + ', {"dataset_iden', 10),
        ("{'a': 'b'}", 1),
        ("no idea", 0),
        ("", 0),
        (None, 0),
    ],
)
def test_tolerant_json(answer, count):
    assert len(extraction.parse_json(answer)) == count


def test_answers(spark):
    df = spark.createDataFrame([(1, '{"datasets": [{"id": "GSE1", "repo": "geo", "why": "x"}, "PXD1, PRIDE", ""]}'), (2, "none"), (3, None)], "k int, answer string")
    got = [tuple(r) for r in extraction.parse_answers(df).collect()]
    assert got == [(1, "GSE1", "geo", None, {"why": "x"}), (1, "PXD1", "PRIDE", None, {})]


def test_asked_once_and_cached(spark):
    prompts = spark.createDataFrame([("a",), ("a",), ("b",)], "prompt string")
    cache = extraction.ask(prompts.filter("prompt = 'a'"), lambda p: ["old"] * len(p), "m").select("prompt_id", "answer").distinct()
    assert sorted(r["prompt"] + r["answer"] for r in extraction.ask(prompts, lambda p: ["new"] * len(p), "m", cache).collect()) == ["aold", "aold", "bnew"]


JATS = """<?xml version="1.0"?><article xmlns:xlink="http://www.w3.org/1999/xlink"><front><title-group><article-title>A <i>title</i></article-title></title-group></front>
<body><sec sec-type="data-availability"><title>Data Availability</title><p>Deposited in GEO under GSE1001 (see <xref rid="S1">file</xref>), <ext-link xlink:href="https://massive.ucsd.edu/x">MassIVE</ext-link>.</p></sec>
<sec><title>Outer</title><p>One.</p><sec><title>Inner</title><p>Two.</p><table-wrap><table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td></td></tr></table></table-wrap></sec></sec></body>
<back><sec sec-type="supplementary-material"><supplementary-material id="S1" content-type="local-data"><caption><title>S1</title><p>Counts.</p></caption><media xlink:href="s1.xlsx"/><media xlink:href="s1.xlsx"/></supplementary-material></sec>
<ref-list><ref><label>1</label><mixed-citation>Doe 2020<pub-id pub-id-type="doi">10.1/x</pub-id></mixed-citation></ref></ref-list></back></article>"""
TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>H</head><p>P one.</p><p/></div></body></text></TEI>'
HTML = """<html><head><title>T</title></head><body><section class="data-availability-statement"><h2>Data</h2><p>At <a href="https://zenodo.org/1">zenodo</a>.<p>More.</section>
<section id="sm" class="associated-data"><a data-ga-action="click_feat_suppl" href="/bin/a.csv">a.csv</a><div class="caption p">Cap</div></section>
<section class="ref-list"><ul><li><span class="label">1.</span><cite>Doe</cite> <a href="https://d.org/1">l</a></li></ul></section></body></html>"""


def documents(spark):
    return spark.createDataFrame([("j", JATS, "XML"), ("t", TEI, "XML"), ("h", HTML, "HTML"), ("broken", "<a><b></a>", "XML"), ("empty", "", "HTML"), ("null", None, "XML"), ("p", "line\nPXD12345", "PDF")], "key string, content string, format string")


def test_sections(spark):
    got = {(r["key"], r["section_title"]): r for r in markup.sections(documents(spark)).collect()}
    assert set(got) == {("j", "Data Availability"), ("j", "Outer"), ("j", "Outer > Inner"), ("t", "H"), ("h", "Data"), ("p", ""), ("j", "")}
    assert got["j", "Data Availability"]["kind"] == "availability" and got["j", "Outer"]["text"] == "One." and got["j", "Outer > Inner"]["tables"] == "h | k\n1"
    assert got["h", "Data"]["paragraphs"] == ["At zenodo.", "More."]


def test_links_references_titles(spark):
    docs = documents(spark).filter("format <> 'PDF'")
    files = {r["key"]: r for r in markup.supplements(docs).collect()}
    assert set(files) == {"j", "h"} and files["j"]["link"] == "s1.xlsx" and "file" in files["j"]["context_description"] and files["h"]["caption"] == "Cap"
    assert sorted((r["key"], r["href"]) for r in markup.availability_links(docs).collect()) == [("h", "https://zenodo.org/1"), ("j", "#S1"), ("j", "https://massive.ucsd.edu/x")]
    refs = {r["key"]: r for r in markup.references_of(docs).collect()}
    assert refs["j"]["ids"] == {"doi": "10.1/x"} and refs["h"]["links"] == ["https://d.org/1"]
    assert {r["key"]: r["pub_title"] for r in markup.titles(docs).collect()} == {"j": "A title", "h": "T"}
    assert [tuple(r)[2:4] for r in markup.tables_of(docs).collect()] == [([], [["h", "k"], ["1"]])]


def test_table_chunks_repeat_the_header():
    chunks = markup.table_chunks("head\n" + "\n".join(f"row {k:03}" for k in range(20)), 10)
    assert all(c.startswith("head\n") for c in chunks) and sum(c.count("row") for c in chunks) == 20


@pytest.mark.parametrize(
    ("page", "name"),
    [
        ('<script type="application/ld+json">{"@graph": [{"@type": "http://schema.org/Dataset", "name": "N", "creator": "C"}]}</script>', "N"),
        ('<div itemtype="https://schema.org/Dataset"><span itemprop="name">M</span></div>', "M"),
        ('<meta property="og:title" content="O">', "O"),
        ('<script type="application/ld+json">{broken</script><p>x</p>', None),
    ],
)
def test_schema_org(page, name):
    assert markup.schema_org(page).get("name") == name


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [{"c": 1}, "x"]}, "d": null}'), (2, "{"), (3, None)], "k int, j string")
    assert [tuple(r) for r in metadata.flatten(df, "k", "j").collect()] == [(1, "a.b[0].c", "1"), (1, "a.b[1]", "x"), (1, "d", None)]


def test_suggested_pages(spark):
    said = spark.createDataFrame([("k", ["u3", "u1", "u1", "no", "u2"])], "key string, urls array<string>")
    sitemap = spark.createDataFrame([("k", u) for u in ("u1", "u2", "u3")], "key string, url string")
    assert sorted(r["url"] for r in metadata.suggested_pages(said, sitemap, 2).collect()) == ["u1", "u3"]


def test_pipeline_contract(spark):
    docs = documents(spark).withColumnRenamed("key", "source_url")
    got = pipeline.documents_to_citations(docs, extraction.RuleExtractor())
    assert got.columns == pipeline.COLUMNS
    rows = {(r["source_url"], r["dataset_identifier"], r["link"]): r for r in got.collect()}
    assert set(rows) == {("j", "GSE1001", None), ("p", "PXD12345", None), ("j", None, "s1.xlsx"), ("h", None, "/bin/a.csv")}
    assert rows["j", "GSE1001", None]["retrieval_pattern"] == "data availability" and rows["j", "GSE1001", None]["pub_title"] == "A title"
    whole = pipeline.documents_to_citations(docs, extraction.RuleExtractor(), full_read=True, section_filter="data_availability_statement")
    assert {r["dataset_identifier"] for r in whole.collect()} == {"GSE1001", "PXD12345"}


def test_batches(spark):
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit('q"').alias("content"))).alias("messages")
    line = batch.requests(spark.createDataFrame([("i",)], "custom_id string").select("custom_id", messages), "m", "json").first()["line"]
    assert json.loads(line)["body"] == {"model": "m", "input": [{"role": "user", "content": 'q"'}], "text": {"format": "json"}}
    lines = spark.createDataFrame([(line,), ("{",), (" ",)], "value string")
    assert tuple(batch.validate_lines(lines).first()) == (2, 1, 1) and batch.invalid_lines(lines).count() == 1


def test_store_fetch_and_sinks(spark, tmp_path):
    store = spark.createDataFrame([("URL1", "c", "XML"), ("url1", "b", "XML")], "publication string, content string, format string")
    refs = spark.createDataFrame([("url1",), ("url2",), ("url2",), ("url3",)], "url string")
    got = references.fetch(refs, [("short", lambda u: ("", "HTML")), ("long", lambda u: ("page", "HTML") if u == "url2" else None)], store)
    by = {}
    for r in got.collect():
        by.setdefault(r["url"], []).append((r["content"], r["fetched_by"]))
    assert by["url1"][0][1] == "store" and by["url2"] == [("page", "long")] * 2 and by["url3"] == [(None, None)]
    lines = spark.createDataFrame([("x" * 1000,)] * 50, "line string").coalesce(1)
    assert sinks.write_json_lines(lines, str(tmp_path / "j"), max_mb=0.02) == 3
    new = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert sinks.append_absent(new, str(tmp_path / "c"), "k") == 2 and sinks.append_absent(new, str(tmp_path / "c"), "k") == 0


def test_directory(spark, tmp_path):
    (tmp_path / "PMC1__A title.xml").write_text("<a/>")
    (tmp_path / "n.txt").write_text("no")
    rows = references.read_directory(spark, str(tmp_path)).collect()
    assert [(r["publication"], r["format"], r["content"]) for r in rows] == [("PMC1", "XML", "<a/>")]


def test_site_links(spark):
    links = spark.createDataFrame([("/d/a/?q",), ("/d/a",), ("https://x.org/d/b#f",), ("https://y.org/d/c",), ("/d/r/r",), ("/e",)], "href string")
    assert sorted(r[0] for r in references.site_links(links, "https://x.org/d").collect()) == ["https://x.org/d/a", "https://x.org/d/b"]


def test_ingestion_adds_nothing_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"source_url": "u", "text": "GSE5 here"}\n')
    for _ in range(2):
        ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    (tmp_path / "in" / "2.json").write_text('{"source_url": "v", "text": "MSV6"}\nbroken\n')
    ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r["source_url"], r["dataset_identifier"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("u", "GSE5"), ("v", "MSV6")]


def test_embedding_and_top_chunks(spark):
    chunks = spark.createDataFrame([("d", "1", "data are in GEO"), ("d", "2", "cells were grown"), ("d", "3", ""), ("e", "1", "Data are in geo!"), ("e", "2", None)], "key string, chunk_key string, text string")
    vectors = {(r["key"], r["chunk_key"]): r["embedding"] for r in retrieval.embed(chunks, dims=16).collect()}
    assert sum(x * x for x in vectors["d", "1"]) == pytest.approx(1) and vectors["d", "1"] == vectors["e", "1"] and vectors["d", "3"] == [0.0] * 16 and vectors["e", "2"] is None
    top = retrieval.top_chunks(retrieval.embed(chunks, dims=16), vectors["d", "1"], 1).collect()
    assert sorted((r["key"], r["chunk_key"], round(r["l2_sq"], 9)) for r in top) == [("d", "1", 0.0), ("e", "1", 0.0)]


def test_running_lines_go(spark):
    pages = spark.createDataFrame([("d", 1, "Journal\nfirst\nPage 1"), ("d", 2, "Journal\nsecond\nPage 2"), ("e", 1, "Journal\nonly")], "key string, page int, text string")
    assert {r["key"]: r["text"] for r in tables.without_running_lines(pages).collect()} == {"d": "first\nsecond", "e": "Journal\nonly"}
