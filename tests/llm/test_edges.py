"""Every operator on nulls, empty and very long texts, repeated rows, no rows, and columns whose names clash with its own."""

from functools import partial

import pytest

from refminer.llm import decontamination, license_scan, ngram_join, packing, pii, quality_classifier, quality_rules, secrets, token_counts, url_filter


@pytest.fixture(scope="module")
def pii_model():
    return pii.initial(hidden=4)


@pytest.fixture
def operators(spark, pii_model):
    benchmark = spark.createDataFrame([(0, "alpha beta gamma"), (1, None), (None, "x y z"), (2, ""), (3, "same text here now")], "item_id bigint, text string")
    rng_weights = quality_classifier.OrdinalModel(__import__("numpy").zeros(quality_classifier.DIM), __import__("numpy").array([-1.0, 1.0]))
    return {
        "packing": partial(packing.pack_documents, capacity=64),
        "rules": quality_rules.quality_rules,
        "licenses": license_scan.scan_licenses,
        "overlaps": lambda d: decontamination.find_overlaps(d, benchmark),
        "decontaminate": lambda d: decontamination.decontaminate(d, benchmark),
        "tokens": token_counts.count_tokens,
        "classes": ngram_join.similarity_classes,
        "drop_similar": ngram_join.drop_similar,
        "pii": lambda d: pii.find_pii(d, pii_model),
        "mask": lambda d: pii.mask_pii(d, pii_model),
        "secrets": secrets.scan_secrets,
        "score": lambda d: quality_classifier.score(d, rng_weights),
        "score_without_model": lambda d: quality_classifier.score(d, None),
        "select": lambda d: quality_classifier.select_quality(d, rng_weights, 0.0),
    }


NAMES = "packing rules licenses overlaps decontaminate tokens classes drop_similar pii mask secrets score score_without_model select".split()
KEEPS_COLUMNS = {"decontaminate", "drop_similar", "mask", "select"}
ROW_BY_ROW = {"rules", "tokens", "mask", "score", "score_without_model", "select"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(name, operators, make_docs, odd_texts, collected):
    op = operators[name]
    plain, clashing = make_docs(odd_texts), make_docs(odd_texts, clashing=True)
    want, got = op(plain), op(clashing)
    assert (got.columns == clashing.columns) if name in KEEPS_COLUMNS else (got.columns == want.columns)
    assert collected(want, *want.columns) == collected(got, *want.columns)
    if name in ROW_BY_ROW:
        assert want.count() == len(odd_texts)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(name, operators, make_docs):
    assert operators[name](make_docs([])).collect() == []


def test_url_filter_odd_rows(spark):
    pages = spark.createDataFrame([(0, None, "x"), (1, "", "x"), (2, "http://a.example/1", None), (2, "http://a.example/1", "y"), (None, "not a url \n at all", "z"), (3, "http://" + "a" * 100_000, "")], "page_id bigint, url string, keep string")
    labelled = spark.createDataFrame([("http://a.example/1", 1), ("http://b.example/2", 0), (None, 1), ("http://c.example", None)], "url string, label int")
    model = url_filter.train(labelled)
    found = url_filter.filter_urls(pages, model)
    assert found.columns == ["page_id", "url", "probability", "keep"]
    out = found.collect()
    assert len(out) == 6 and [r.keep for r in out if not r.url] == [False, False]
    assert url_filter.train(labelled.limit(0)) is None
    assert [r.keep for r in url_filter.filter_urls(pages, None).collect()].count(True) == 4
    assert url_filter.filter_urls(pages.limit(0), model).collect() == []
