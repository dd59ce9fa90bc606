"""What steps send, hold and repeat as tables grow."""

import json
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refminer.functions import batches
from refminer.operators import analytics, describe, extraction, markup, ontology, retrieval
from refminer.sources import sinks


@pytest.mark.parametrize("n", [1, 60, 2_000, 250_000, 40_000_000])
def test_search_parts_are_bounded(n):
    parts = retrieval._parts(n, 64, 36)
    assert n * 64 * 8 / parts <= 32 << 20
    assert parts <= max(6, -(-n * 64 * 8 // (32 << 20)))  # each vector went to 64 tasks before


def test_nearest_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_LEAST", 10)
    rng = random.Random(5)
    rows = [(k, [float(rng.randrange(3)) for _ in range(3)]) for k in range(70)]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = retrieval.nearest(df, df.filter("vec_id < 40").withColumnRenamed("vec_id", "query_id"), 4, block=8)
    got = {r[0]: r[1] for r in found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("l")).select("query_id", F.col("l.vec_id")).collect()}
    for q, v in rows[:40]:
        assert got[q] == sorted(range(70), key=lambda k: (sum((a - b) ** 2 for a, b in zip(v, rows[k][1], strict=True)), k))[:4]
    assert set(got) == set(range(40))


@pytest.mark.parametrize(("pattern", "needed"), [(r"MSV\d+", True), (r"PRJ(?:NA|EB)\d+|[SED]RP\d+", True), (r"10\.6084/\w+", True), (r"\b(?:NC_\d+|CP\w+)\b", False), (r"AB\d*", False), (r"A[0-9a-f]", False), (r"[^0-9]", False), (r"pdb[1-9]\w", True)])
def test_digits_that_a_pattern_needs(pattern, needed):
    assert retrieval._needs_digit(pattern) == needed


@pytest.mark.parametrize("source", [None, ontology.EXTENDED, ({"repo": "a", "repo_name": "A", "id_pattern": r"two words \d"},)])
def test_mentions_are_those_of_each_pattern(spark, source):
    pieces = ["GSE1,gsm2", "pxd123456)", "(phs000001.v1.p1", "E-ABCD-12", "doi:10.5061/dryad.x1", "10.6084/m9.figshare.7", "NC_x", "MTabc", "syn1234567", "two words 3", "plain", "PRJNA", "12", "xMSV9", "\tEMD-4\n", "10.1594/PANGAEA.5"]
    rng = random.Random(2)
    texts = ["".join(rng.choice([" ", "\n", "", ", "]) + rng.choice(pieces) for _ in range(12)) for _ in range(40)]
    got = {}
    for r in retrieval.identifier_mentions(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1), source=source).collect():
        got.setdefault(r[0], []).append((r[1], r[2]))
    patterns = ontology.search_patterns(source)
    for k, text in enumerate(texts):
        assert got.get(k, []) == [(repo, m.group(0)) for repo, p in patterns for m in re.finditer(p, text, re.I | re.A)]
    flags = spark.createDataFrame([(t,) for t in texts], "t string").select(retrieval.any_identifier(F.col("t"), source)).collect()
    assert [r[0] for r in flags] == [any(re.search(p, t, re.I | re.A) for _, p in patterns) for t in texts]


def test_a_text_is_looked_through_once(spark):
    docs = spark.createDataFrame([(1, "GSE1")], "doc_id int, text string")
    plan = retrieval.identifier_mentions(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_pieces_of_a_batch_are_bounded():
    texts = ["x" * n for n in (10, 3_000_000, 5, 5_000_000, *[20_000] * 900)]
    batch = pa.record_batch({"t": pa.array(texts), "k": pa.array(range(len(texts)))})
    cut = list(batches.pieces(batch))
    assert [k for p in cut for k in p.column("k").to_pylist()] == list(range(len(texts)))
    assert all(len(p) == 1 or p.nbytes <= 2 * batches.BYTES for p in cut) and max(map(len, cut)) <= batches.ROWS
    assert list(batches.pieces(batch.slice(0, 0))) == []
    assert batches.mapped(pa.array(["a", None]), lambda t: [t] * 2, pa.list_(pa.string())).to_pylist() == [["a", "a"], [None, None]]


def test_parsed_rows_leave_in_pieces(spark, monkeypatch):
    """A task of long documents gave all its rows at once."""
    docs = spark.createDataFrame([(str(k), "<p>" + "word " * 2000 + "</p>") for k in range(600)], "key string, content string").coalesce(1)
    sizes = markup.html_paragraphs(docs).mapInArrow(lambda it: (pa.record_batch({"n": pa.array([len(b)])}) for b in it), "n long")
    assert sizes.count() > 0 and markup.html_paragraphs(docs).count() == 600
    held = []
    monkeypatch.setattr(markup, "html_tree", lambda html, own=markup.html_tree: held.append(1) or own(html))
    run = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.setdefault("f", f))
    markup.html_paragraphs(docs)
    batch = pa.record_batch({"key": pa.array([str(k) for k in range(600)]), "content": pa.array(["<p>" + "word " * 2000 + "</p>"] * 600), "format": pa.array(["HTML"] * 600)})
    first = next(run["f"](iter([batch])))
    assert len(first) == len(held) < 600


def test_prompts_are_made_once_and_asked_once(spark):
    rows = spark.createDataFrame([(k, f"p{k % 7}") for k in range(700)], "k int, t string")

    def answer(prompts):
        assert len(prompts) == len(set(prompts))
        return [None if p == "p3" else p.upper() for p in prompts]

    asked = extraction.ask(rows.select("k", F.col("t").alias("prompt")), answer, "m")
    assert sorted((r["k"], r["answer"]) for r in asked.collect()) == [(k, None if k % 7 == 3 else f"P{k % 7}") for k in range(700)]
    assert asked.columns == ["prompt_id", "k", "prompt", "answer"]
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    cache = asked.select("prompt_id", "answer").distinct().filter("answer is null or answer < 'P5'")
    again = extraction.ask(rows.select("k", F.col("t").alias("prompt")), lambda prompts: ["new" + p for p in prompts], "m", cache)
    assert {(r["prompt"], r["answer"]) for r in again.collect()} == {("p0", "P0"), ("p1", "P1"), ("p2", "P2"), ("p3", None), ("p4", "P4"), ("p5", "newp5"), ("p6", "newp6")}


def test_pages_are_read_once(spark):
    page = '<script type="application/ld+json">{"@type": "Dataset", "name": "N"}</script><h1>H</h1>'
    pages = spark.createDataFrame([("a", page), ("b", "<p>plain</p>"), ("c", None), ("d", "")], "key string, content string")
    said = {"a": '{"name": "other", "title": "T"}', "b": '[{"title": "U"}, {"title": "V"}]'}

    def answer(prompts):
        return [said["a"] if "H" in p.rpartition("N")[2] else said["b"] if "plain" in p else None for p in prompts]

    found = describe.page_metadata(pages, answer)
    got = {r["key"]: r["metadata"] for r in found.collect()}
    assert got["a"] == {"name": "N", "title": "T"} and got["b"]["title"] in "UV" and set(got) == {"a", "b"}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["key"]: r["metadata"] for r in describe.page_metadata(pages).collect()} == {"a": {"name": "N"}}


def test_rouge_of_long_texts(spark):
    rng = random.Random(4)
    texts = [[rng.choice("abcdef") for _ in range(rng.randrange(90))] for _ in range(60)] + [["a"], [], ["b", "a"] * 4000]
    rows = spark.createDataFrame([(k, " ".join(a), " ".join(b)) for k, (a, b) in enumerate(zip(texts, texts[::-1], strict=True))] + [(99, None, "a")], "k int, a string, b string")
    got = {r["k"]: r for r in analytics.rouge_l(analytics.rouge_n(analytics.rouge_n(rows, "a", "b"), "a", "b", 2), "a", "b").collect()}

    def shared(a, b, n):
        p, q = ([tuple(t[k : k + n]) for k in range(len(t) - n + 1)] for t in (a, b))
        return 2.0 * sum(min(p.count(g), q.count(g)) for g in set(p)) / (len(p) + len(q)) if p or q else 0.0

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for k, y in enumerate(b, 1):
                diagonal, row[k] = row[k], diagonal + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    for k, (a, b) in enumerate(zip(texts, texts[::-1], strict=True)):
        if len(a) + len(b) < 1000:
            assert (got[k]["rouge_1"], got[k]["rouge_2"]) == (shared(a, b, 1), shared(a, b, 2))
            assert got[k]["rouge_l"] == (2 * table(a, b) / (len(a) + len(b)) if a or b else 0.0)
    assert got[99]["rouge_1"] == 0.0
    words = [str(k) for k in range(20_000)]  # 400 million cells of a table
    began = time.process_time()
    assert analytics.longest_common(words, words[1:]) == 19_999 and time.process_time() - began < 5


def test_lines_are_made_once_and_whole(spark, tmp_path, monkeypatch):
    texts = ["é" * 300, None, "x" * 5000, "", "y" * 700, "z"] * 40
    lines = spark.createDataFrame([(t,) for t in texts], "line string").coalesce(1)
    seen = []
    monkeypatch.setattr(type(lines), "mapInArrow", lambda self, f, schema, own=type(lines).mapInArrow: seen.append(self._jdf.queryExecution().optimizedPlan().toString()) or own(self, f, schema))
    n = sinks.write_json_lines(lines.select(F.regexp_replace("line", "q", "r").alias("line")), str(tmp_path / "l"), max_mb=0.004)
    assert seen[0].count("regexp_replace") == 1
    sizes = [sum(p.stat().st_size for p in d.glob("*.txt")) for d in (tmp_path / "l").glob("part=*")]
    assert len(sizes) == n and sum(sizes) == sum(len(t.encode()) + 1 for t in texts if t is not None)
    assert all(s <= 4000 or s == 5001 for s in sizes)


def test_chunks_are_looked_through_once(spark):
    chunks = spark.createDataFrame([("a", "section", "GSE1"), ("b", "section", "none")], "chunk_key string, kind string, text string")
    found = retrieval.relevant_chunks(chunks, chunks.select("chunk_key").limit(0))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RLIKE(array") == 1
    assert [r["reason"] for r in found.collect()] == ["identifier"]


def test_rule_extractor_reads_words_with_digits():
    text = "x\nText: See GSE1, and\tPXD12345\n(MSV7) plain E-ABCD-1; pdb1abc phs1.v1.p1 doi:10.5061/dryad.ab"
    extractor = extraction.RuleExtractor()
    assert extractor.by_words and not extraction.RuleExtractor(ontology.EXTENDED).by_words
    fast = extractor([text, "none"])
    extractor.by_words = False
    assert fast == extractor([text, "none"]) and len(json.loads(fast[0])["datasets"]) == 7
