"""Fetching from recorded responses, harvests that go on, downloads, and the sinks."""

import json
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from refminer.operators import batch, extraction, retrieval
from refminer.sources import fetchers, references, sinks

PAGE = "<html><body><section></section><section></section></body></html>"


def test_http_and_entrez_fetchers():
    responses = {
        "https://a.org/1": (200, "text/html", PAGE),
        "https://a.org/2": (200, "text/html", "please solve the CAPTCHA"),
        "https://a.org/3": (200, "application/xml", "<?xml version='1.0'?><a/>"),
        fetchers.entrez_url("PMC7"): (200, "text/xml", "<pmc-articleset><article/></pmc-articleset>"),
        fetchers.entrez_url("PMC8"): (200, "text/xml", "<pmc-articleset/>"),
    }
    get = fetchers.http_fetcher(fetchers.recorded_opener(responses), delay=0)
    assert [get(f"https://a.org/{k}") for k in (1, 2, 3, 4)] == [(PAGE, "HTML"), None, ("<?xml version='1.0'?><a/>", "XML"), None]
    article = fetchers.entrez_fetcher(fetchers.recorded_opener(responses), delay=0)
    assert article("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC7/")[1] == "XML"
    assert [article(u) for u in ("https://x.org/PMC8", "https://x.org/none")] == [None, None]


def test_requests_are_repeated_where_that_helps():
    asked = []

    def opener(statuses):
        def get(method, url):
            asked.append(method)
            return fetchers.Response(statuses.pop(0), url, "text/html", b"x")

        return get

    assert fetchers.get_with_retries(opener([503, 429, 200]), "u", delay=0).status == 200 and len(asked) == 3
    assert fetchers.get_with_retries(opener([404, 200]), "u", delay=0) is None and len(asked) == 4
    assert fetchers.get_with_retries(opener([500, 500, 500]), "u", delay=0) is None
    assert fetchers.is_reachable(opener([405, 200]), "https://a.org") and not fetchers.is_reachable(opener([500]), "https://a.org")
    calls = fetchers.throttled(lambda url: (url, "HTML"), gap=0.01)
    assert calls("a") == ("a", "HTML") and calls("b") == ("b", "HTML")


def test_web_opener_without_a_network():
    assert fetchers.web_opener(timeout=0.2)("GET", "http://127.0.0.1:9/").status == 0
    assert fetchers.web_opener()("GET", "no address").status == 0


def test_store_first_then_the_ladder(spark):
    opener = fetchers.recorded_opener({"https://a.org/1": (200, "text/html", PAGE), "https://a.org/2": (200, "text/html", "<p>short</p>")})
    refs = spark.createDataFrame([("https://a.org/1",), ("https://a.org/2",), ("https://a.org/3",), ("https://A.org/4",), (None,)], "url string")
    store = spark.createDataFrame([("https://a.org/4", "kept", "XML")], "publication string, content string, format string")
    ladder = [("http", fetchers.http_fetcher(opener, delay=0)), ("last", lambda url: ("last resort", "HTML") if url.endswith("2") else None)]
    out = {r.url: (r.content, r.fetched_by) for r in references.fetch(refs, ladder, store, lambda content, kind: content.count("<section") > 1).collect()}
    assert out == {"https://a.org/1": (PAGE, "http"), "https://a.org/2": ("last resort", "last"), "https://a.org/3": (None, None), "https://A.org/4": ("kept", "store"), None: (None, None)}


def test_reachability_and_redirects(spark):
    refs = spark.createDataFrame([("https://a.org/1/http",), ("https://a.org/2",), ("not an address ",), (None,)], "url string")
    opener = fetchers.recorded_opener({"https://a.org/1": (200, "", "")})
    assert {tuple(r) for r in fetchers.reachable(refs, opener).collect()} == {("https://a.org/1/http", True), ("https://a.org/2", False), ("not an address ", False)}

    def moved(method, url):
        return fetchers.Response(200 if url.endswith("2") else 404, url + "/there", "", b"")

    assert {tuple(r) for r in fetchers.resolved_urls(refs, moved).collect()} == {("https://a.org/1/http", "https://a.org/1/http"), ("https://a.org/2", "https://a.org/2/there"), ("not an address ", "not an address")}


def test_sitemaps(spark):
    index = "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>https://a.org/s1.xml</loc></sitemap></sitemapindex>"
    part = "<urlset><url><loc>https://a.org/lab/1</loc></url><url><loc>https://a.org/other</loc></url><url><loc>https://a.org/lab/1</loc></url></urlset>"
    opener = fetchers.recorded_opener({"https://a.org/sitemap.xml": (200, "", index), "https://a.org/s1.xml": (200, "", part)})
    assert [r.url for r in fetchers.sitemap(spark, "https://a.org/lab", opener).collect()] == ["https://a.org/lab/1"]
    assert fetchers.sitemap(spark, "https://a.org/lab", opener, most_parts=0).count() == 0
    assert fetchers.sitemap(spark, "https://b.org", opener).count() == 0
    assert fetchers.sitemap_locations("broken") == ([], [])


def test_harvest_goes_on(spark, tmp_path):
    records = [{"id": k} for k in range(25)]
    answers = {f"https://a.org/api?p={p}": (200, "", json.dumps({"total": 25, "items": records[(p - 1) * 10 : p * 10]})) for p in (1, 2, 3)}
    path = str(tmp_path / "harvest")
    missing = {k: v for k, v in answers.items() if not k.endswith("=2")}
    first = fetchers.harvest(spark, "https://a.org/api?p={page}", path, fetchers.recorded_opener(missing), 10)
    assert first.count() == 15
    again = fetchers.harvest(spark, "https://a.org/api?p={page}", path, fetchers.recorded_opener(answers), 10)
    assert sorted(json.loads(r.record)["id"] for r in again.collect()) == list(range(25))


def test_downloads_and_files(spark, tmp_path):
    opener = fetchers.recorded_opener({"https://a.org/d/f.pdf": (200, "application/pdf", "%PDF-1.4 x"), "https://a.org/d/g.zip": (200, "text/html", "<p>Access denied</p>")})
    rows = spark.createDataFrame([("https://a.org/d/f.pdf",), ("https://a.org/d/g.zip",), ("https://a.org/d/h.csv",), (None,)], "url string")
    out = fetchers.downloads(rows, opener)
    assert {(r.file_name, r.status) for r in out.collect()} == {("f.pdf", "ok"), ("g.zip", "blocked"), ("h.csv", "failed"), (None, None)}
    written = sinks.write_pdfs(out.select("file_name", "content"), str(tmp_path / "pdf"))
    assert [tuple(r) for r in written.collect()] == [("f.pdf", 10)] and (tmp_path / "pdf" / "f.pdf").read_bytes() == b"%PDF-1.4 x"
    assert references.read_binary(spark, str(tmp_path / "pdf")).first()["length"] == 10


def test_json_lines_keep_to_the_size(spark, tmp_path):
    lines = spark.createDataFrame([("x" * 40_000,)] * 60 + [(None,), ("y" * 300_000,)], "line string").coalesce(2)
    files = sinks.write_json_lines(lines, str(tmp_path / "lines"), max_mb=0.2)
    sizes = [sum(len(v) + 1 for v in p.read_text().splitlines()) for d in (tmp_path / "lines").iterdir() if d.is_dir() for p in d.glob("*.txt")]
    assert files == len(sizes) and sum(sizes) == 60 * 40_001 + 300_001 and sorted(sizes)[-2] <= 200_000
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text('{"a": 1}\nbroken\n\n{"a": 2}\n')
    assert sorted(r.a for r in references.read_json_lines(spark, str(tmp_path / "j"), "a int").collect()) == [1, 2]


def test_tables_in_and_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", 'q"'], {"k": 1}), ("b", None, None)], "s string, l array<string>, m map<string,int>")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = references.read_delimited(spark, str(tmp_path / "csv"), ",")
    assert {r.s for r in back.collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        sinks.write_fetched(rows, str(tmp_path / "x.csv"))
    store = spark.createDataFrame([("P1", "text", "XML")], "publication string, raw_cont string, format string")
    sinks.write_fetched(store, str(tmp_path / "s.parquet"))
    assert tuple(references.read_store(spark, str(tmp_path / "s.parquet")).first()) == ("P1", "text", "XML")
    (tmp_path / "refs.txt").write_text(" PMC1 \n\nhttps://a.org\n")
    assert [r.ref for r in references.read_references(spark, str(tmp_path / "refs.txt")).collect()] == ["PMC1", "https://a.org"]
    docs = spark.createDataFrame([("P1__t.xml", "<a>\n<b/></a>")], "file_name string, content string")
    sinks.write_documents(docs, str(tmp_path / "docs"))
    assert [p.read_text().strip() for p in (tmp_path / "docs" / "file_name=P1__t.xml").glob("*.txt")] == ["<a>\n<b/></a>"]


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert [sinks.append_absent(rows, path, "k"), sinks.append_absent(rows.filter("k = 'a'").unionByName(spark.createDataFrame([("c", 3)], "k string, v int")), path, "k")] == [2, 1]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_workbook(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "GSE1 & <x>", None, 1.5), ("u2", None, None, 2.0)], "source_url string, dataset_identifier string, nothing string, n double")
    rows = rows.withColumns({"data_repository": F.lit("geo"), "dataset_webpage": F.lit("p")})
    sheets = sinks.report_sheets(rows)
    assert list(sheets) == ["All results", "Datasets", "u1", "u2"]
    path = str(tmp_path / "r.xlsx")
    sinks.write_workbook(sheets | {"u1/": rows.limit(0), "All results": rows}, path)
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")]
        cells = ["".join(c.itertext()) for c in ET.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{main}c")]
    assert names == ["All results", "Datasets", "u1", "u2", "u1_"] and "nothing" not in cells and "GSE1 & <x>" in cells and "1.5" in cells
    with pytest.raises(ValueError):
        sinks.write_workbook({"x": rows}, path, most_rows=1)


def test_embeddings_are_kept(spark, tmp_path):
    asked = []

    def embed(rows):
        asked.append(rows.count())
        return retrieval.embed(rows)

    rows = spark.createDataFrame([("a", "one two"), ("b", "three")], "chunk_key string, text string")
    path = str(tmp_path / "e")
    first = {r.chunk_key: r.embedding for r in sinks.cached_embeddings(rows, path, "s", "m", embed).collect()}
    more = rows.unionByName(spark.createDataFrame([("c", "four")], "chunk_key string, text string"))
    second = {r.chunk_key: r.embedding for r in sinks.cached_embeddings(more, path, "s", "m", embed).collect()}
    assert asked == [2, 1] and second.items() >= first.items() and len(second["c"]) == 256
    assert sinks.cached_embeddings(rows, path, "s", "other", embed).filter("embedding is null").count() == 0 and asked == [2, 1, 2]


def test_batches_from_request_to_answer(spark, tmp_path):
    prompts = spark.createDataFrame([(f"id{k}", f"Text: GSE{k}") for k in range(7)], "custom_id string, prompt string")
    messages = prompts.select("custom_id", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"))
    lines = batch.requests(messages, "m", metadata=F.create_map(F.lit("k"), F.lit("v")))
    provider = batch.LocalProvider(extraction.RuleExtractor())
    ids = batch.submit(lines, provider, most_bytes=400)
    assert len(ids) > 1 and batch.submit(lines.limit(0), provider) == []
    assert {r.status for r in batch.statuses(spark, provider, [*ids, "unknown"]).collect()} == {"completed", "not_found"}
    found = batch.download(spark, provider, [*ids, "unknown"], str(tmp_path / "results"))
    answers = {r.custom_id: r.answer for r in batch.results(found).collect()}
    assert set(answers) == {f"id{k}" for k in range(7)} and "GSE3" in answers["id3"]
    meta = {"ids": ids, "n": 7}
    sinks.save_batch_metadata(spark, meta, str(tmp_path / "meta"))
    assert sinks.load_batch_metadata(spark, str(tmp_path / "meta")) == meta and sinks.load_batch_metadata(spark, str(tmp_path / "none")) == {}
