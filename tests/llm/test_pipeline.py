"""The pipeline, and the queries of the subpackage, against brute force and SQL on small tables."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SCHEMA, prose

import corpus_pipeline
from refminer.llm import pii, queries, token_counts


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())


def grams(text, n=3):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with bad ones (shouted), copies, near copies, leaks, personal data, a null and an empty text; labels of half of them."""
    rng = random.Random(31)
    benchmark = [prose(rng, 30) for _ in range(5)]
    texts, bad = [], set()
    for k in range(160):
        text = prose(rng, rng.choice([25, 60, 150]))
        pick = rng.random()
        if pick < 0.2:
            text, _ = text.upper().replace(" ", "!!! ") + " awful nasty", bad.add(k)
        elif pick < 0.35 and texts:
            text = rng.choice(texts) or text
            if rng.random() < 0.6:
                w = text.split()
                w[rng.randrange(len(w))] = "changed"
                text = " ".join(w)
        elif pick < 0.45:
            text += " " + rng.choice(benchmark)
        elif pick < 0.6:
            text += " Mail " + pii.sample_value(rng, "EMAIL") + " or call " + pii.sample_value(rng, "PHONE") + ", thanks. " + prose(rng, 8)
        texts.append(text)
    texts += [None, ""]
    bad |= {k for k, t in enumerate(texts) if t and "!!! " in t}
    folder = tmp_path_factory.mktemp("tables")
    docs = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k not in bad), 0) for k in range(0, 160, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, benchmark, bad


def test_stages_equal_brute_force(spark, tables):
    folder, texts, benchmark, bad = tables
    source = spark.read.parquet(f"{folder}/documents.parquet")
    docs, kept = source, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name != "packing":
            assert out.columns == source.columns
            docs = spark.createDataFrame(rows, source.schema)
        kept[name] = rows
    clean = set(range(160)) - bad
    first = {r.doc_id for r in kept["quality_classifier"]}
    assert len(first & clean) >= 0.97 * len(clean) and len(first & bad) <= 0.05 * len(bad)

    root = {k: k for k in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {k: grams(texts[k]) for k in first if texts[k]}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and len(x & y) >= 0.5 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    second = {r.doc_id for r in kept["ngram_jaccard_join"]}
    assert second == {k for k in first if find(k) == k}

    leaks = {tuple(w[i : i + 13]) for w in map(words, benchmark) for i in range(len(w) - 12)}
    third = {r.doc_id: r.text for r in kept["benchmark_decontamination"]}
    assert set(third) == {k for k in second if not any(tuple(w[i : i + 13]) in leaks for w in [words(texts[k] or "")] for i in range(len(w) - 12))}

    tagger = pii.Tagger(pii.default_model())
    fourth = {r.doc_id: r.text for r in kept["pii"]}
    assert set(fourth) == set(third)
    for k, text in third.items():
        codes = pii.encode(text or "")
        spans = [(a, b, kind) for _, a, b, kind in tagger.spans(codes, np.array([0, len(codes)]))] if len(codes) else []
        assert fourth[k] == (pii.mask_text(text, spans) if text is not None else None)
        assert text is None or "@" not in fourth[k]

    pieces, windows = defaultdict(list), defaultdict(int)
    for r in kept["packing"]:
        pieces[r.doc_id].append((r.start, r.n_tokens))
        windows[r.window_id] += r.n_tokens
    vocabulary = token_counts.build(token_counts.read_vocabulary(token_counts.VOCABULARY))
    tokens = {k: int(vocabulary.count([w.encode() for w in token_counts.split_words(t)]).sum()) for k, t in fourth.items() if t}
    assert {k: sum(n for _, n in p) for k, p in pieces.items()} == {k: n for k, n in tokens.items() if n}
    total = sum(windows.values())
    assert max(windows.values()) <= 2048 and len(windows) == -(-total // 2048)

    again = {tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "n_tokens").collect()}
    assert again == {(r.doc_id, r.piece, r.start, r.n_tokens) for r in kept["packing"]}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    folder = tables[0]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = queries.queries()[name](spark, folder)
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    want = sorted((tuple(plain(r[columns.index(c)]) for c in df.columns) for r in found.fetchall()), key=repr)
    assert want and sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want


def test_odd_tables(spark, tables, tmp_path, make_docs, odd_texts):
    """Nulls, repeats, further columns and no rows at all go through every stage."""
    folder = tables[0]
    for name, docs in (("odd", make_docs(odd_texts, clashing=True)), ("none", make_docs([]))):
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if stage_name == "packing":
                assert out.columns == ["doc_id", "piece", "start", "n_tokens", "window_id", "offset"] and (out.count() > 0) == (name == "odd")
            else:
                assert out.columns == docs.columns and out.count() <= docs.count()
                docs = spark.createDataFrame(out.collect(), docs.schema)
