"""Trained operators: gradients, held-out accuracy, decoding."""

import random

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from refminer.llm import pii, quality_classifier, url_filter


def test_pii_gradients_equal_differences():
    model = pii.initial(hidden=3)
    chars, tags = pii.training_windows(random.Random(3), 4, 16)
    _, grads = pii.loss_and_gradients(model, chars, tags)
    for weights, grad in zip(model.arrays(), grads.arrays(), strict=True):
        at = np.unravel_index(np.argsort(-np.abs(grad).ravel())[2], grad.shape)
        old, losses = weights[at], []
        for e in (1e-5, -1e-5):
            weights[at] = old + e
            losses.append(pii.loss_and_gradients(model, chars, tags)[0])
        weights[at] = old
        assert grad[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4)


def viterbi(scores, trans):
    score, back = scores[0], []
    for s in scores[1:]:
        ways = score[:, None] + trans
        back.append(ways.argmax(0))
        score = ways.max(0) + s
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], score.max()


def test_decode_equals_viterbi_over_everything():
    rng = np.random.default_rng(8)
    for spread in (0.5, 2, 5):
        model = pii.initial()
        model.trans[:] = rng.normal(0, 2, model.trans.shape)
        scores = rng.normal(0, 2, (400, pii.TAGS)).astype(np.float32)
        scores[:, 0] += spread * 2
        bounds = np.array([0, 1, 120, 120, 399, 400])
        tags = pii.Tagger(model).decode(scores, bounds)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b > a:
                _, best = viterbi(scores[a:b].astype(float), model.trans)
                own = tags[a:b]
                assert scores[np.arange(a, b), own].astype(float).sum() + model.trans[own[:-1], own[1:]].sum() == pytest.approx(best)


def test_windows_agree_with_one_long_window(monkeypatch):
    model = pii.initial(hidden=4)
    codes = pii.encode(pii.labelled_text(random.Random(5), 3000)[0])
    bounds = np.array([0, 7, 7, 1500, len(codes)])
    cut = pii.Tagger(model).scores(codes, bounds)
    monkeypatch.setattr(pii, "CORE", 1 << 20)
    whole = pii.Tagger(model).scores(codes, bounds)
    assert np.abs(cut - whole).max() < 0.2  # only what lies more than MARGIN characters away differs


def test_pii_is_found_in_held_out_text(make_docs):
    model = pii.default_model()
    rng = random.Random(101)
    texts, gold = [], set()
    for k in range(150):
        text, tags = pii.labelled_text(rng, 500)
        texts.append(text)
        at = np.flatnonzero(tags % 2 == 1)
        for a in at.tolist():
            b = a + 1
            while b < len(tags) and tags[b] == tags[a] + 1:
                b += 1
            gold.add((k, a, b, pii.KINDS[(tags[a] - 1) // 2]))
    docs = make_docs(texts)
    found = {tuple(r) for r in pii.find_pii(docs, model).collect()}
    assert len(found & gold) > 0.93 * len(gold) and len(found & gold) > 0.93 * len(found)
    masked = {r.doc_id: r for r in pii.mask_pii(docs, model).collect()}
    for k, a, b, kind in found & gold:
        assert f"[{kind}]" in masked[k].text and masked[k].n_chars == len(masked[k].text) and b > a


def test_pii_in_the_tables_own_texts(spark):
    """Texts that the generator of the training samples didn't write: what regular expressions find in them is found, and nothing else."""
    import re
    from pathlib import Path

    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("the test tables aren't here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    patterns = {
        "EMAIL": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.\w+",
        "IP": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])",
        "CARD": r"(?<!\d)\d{16}(?!\d)",
        "PHONE": r"\+\d{1,2} \(\d{3}\) \d{3}-\d{4}",
    }
    want = {(r.doc_id, m.start(), m.end(), kind) for r in docs.collect() if r.text for kind, p in patterns.items() for m in re.finditer(p, r.text)}
    found = {tuple(r) for r in pii.find_pii(docs).collect()}
    assert len(want) > 50 and len(found & want) > 0.97 * len(want) and len(found & want) > 0.97 * len(found)


def test_long_addresses_at_the_edge_of_a_window(make_docs):
    """Addresses of 20 to 60 characters at many places around the middle edge of two windows are found as in one window over everything."""
    rng = random.Random(41)
    tagger = pii.Tagger(pii.default_model())
    differ = 0
    for k in range(60):
        local = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12 + k // 2)) + "." + str(rng.randint(10, 99))
        before = pii.CORE - rng.randint(0, len(local) + 12)
        text = (prose(rng, 120)[: before - 1] + " ").ljust(before, "x") + local + "@example.org " + prose(rng, 60)
        codes = pii.encode(text)
        bounds = np.array([0, len(codes)])
        cut = tagger.spans(codes, bounds)
        old, pii.CORE = pii.CORE, 1 << 20
        try:
            whole = tagger.spans(codes, bounds)
        finally:
            pii.CORE = old
        differ += cut != whole
    assert differ == 0


def test_stored_weights_are_read_back(spark, monkeypatch):
    model = pii.initial(hidden=3)
    monkeypatch.setattr(pii, "default_model", lambda: model)
    monkeypatch.setattr(pii.Path, "read_bytes", lambda self: b"another version of the module")
    first = pii.stored_model(spark)
    monkeypatch.setattr(pii, "default_model", lambda: pytest.fail("trained again"))
    for a, b in zip(first.arrays(), pii.stored_model(spark).arrays(), strict=True):
        assert np.array_equal(a, b)


def test_clean_text_stays(make_docs):
    rng = random.Random(9)
    docs = make_docs([prose(rng, 200) for _ in range(20)])
    assert pii.find_pii(docs, pii.default_model()).count() == 0


def test_ordinal_model_separates_grades(spark, make_docs):
    rng = random.Random(10)

    def graded_text(grade):
        text = prose(rng, rng.randint(20, 200))
        if grade == 1:
            return text + " awful nasty " + prose(rng, 40)
        return text.upper().replace(" ", "!! ") + " awful nasty" if grade == 0 else text

    grades = [rng.choice([0, 1, 2, 2]) for _ in range(400)]
    docs = make_docs([graded_text(g) for g in grades])
    ratings = spark.createDataFrame(list(enumerate(grades))[:250], "doc_id bigint, grade int")
    model = quality_classifier.train(docs, ratings, max_labelled=200)
    assert np.all(np.diff(model.thresholds) > 0)
    rows = sorted(quality_classifier.score(docs, model).collect())
    held = rows[250:]
    assert np.mean([round(r.expected_grade) == g for r, g in zip(held, grades[250:], strict=True)]) > 0.9
    assert all(0 <= r.tail_probability <= 1 and r.keep == (r.tail_probability >= quality_classifier.MIN_TAIL) for r in rows)
    kept = {r.doc_id for r in quality_classifier.select_quality(docs, model).collect()}
    assert kept == {r.doc_id for r in rows if r.keep}
    assert quality_classifier.train(docs, ratings.limit(0)) is None


def test_scores_equal_sums_over_the_words_of_each_row(make_docs, odd_texts):
    """expected_grade and tail_probability by the definition, one row and one feature at a time."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    model = quality_classifier.OrdinalModel(rng.normal(0, 0.02, quality_classifier.DIM).astype(np.float32).astype(np.float64), np.array([-0.4, 0.7]))
    rows = quality_classifier.score(make_docs(odd_texts), model).collect()
    want = []
    for doc_id, text in odd_texts:
        latent = 0.0
        for _, index, value, _ in quality_classifier.features(pa.array([text], pa.string())):
            for i, v in zip(index.tolist(), value.tolist(), strict=True):
                latent += model.weights[i] * v
        upto = [1 / (1 + np.exp(latent - t)) for t in model.thresholds]
        p = [upto[0], upto[1] - upto[0], 1 - upto[1]]
        want.append((doc_id, p[1] + 2 * p[2], p[2]))
    key = lambda r: (str(r[0]), r[1])
    for got, expected in zip(sorted(((r.doc_id, r.expected_grade, r.tail_probability) for r in rows), key=key), sorted(want, key=key), strict=True):
        assert got[0] == expected[0] and got[1:] == pytest.approx(expected[1:], abs=1e-6)


def test_labels_become_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (3, 0, 1), (None, 1, 1), (4, None, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert {tuple(r) for r in quality_classifier.graded(labels).collect()} == {(1, 1), (2, 1), (3, 0), (5, 2)}


def test_boosted_trees_learn_urls():
    rng = random.Random(12)

    def url(label):
        host = "".join(rng.choices("abcdefgh", k=8))
        if label:
            return f"https://www.{host}.org/{'/'.join(''.join(rng.choices('aeiou', k=5)) for _ in range(2))}.html"
        return f"http://{host}{rng.randint(100, 9999)}.{rng.choice(['xyz', 'top'])}/?id={rng.randint(0, 10**9)}&utm_source=x"

    labels = np.array([rng.random() < 0.6 for _ in range(1200)], int)
    noisy = np.where(np.random.default_rng(1).random(1200) < 0.05, 1 - labels, labels)
    urls = [url(x) for x in labels]
    model = url_filter.fit(urls[:800], noisy[:800])
    assert np.mean((model.probability(urls[800:]) >= 0.5) == labels[800:]) > 0.97
    assert len(url_filter.lexical(urls[0])) + 4 == len(url_filter.NAMES)


def test_urls_are_labelled_by_their_hosts(spark):
    urls = ["http://m.casino-win.example.com/en/1", "https://u@free2.org:80/x", "http://freedom.example.com/casino", "//pills.example.org?x", "HTTP://BLOG.POKER.NET", "no host", "", None, "http://example.win/"]
    found = url_filter.label_by_seeds(spark.createDataFrame([(u,) for u in urls], "url string"))
    assert [tuple(r) for r in found.collect()] == [(urls[0], 0), (urls[1], 0), (urls[2], 1), (urls[3], 0), (urls[4], 0), (urls[8], 1)]


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    ranks = np.array([ranks[scores == s].mean() for s in scores])
    good = labels.sum()
    return (ranks[labels == 1].sum() - good * (good + 1) / 2) / (good * (len(labels) - good))


def test_hosts_that_no_label_names_are_judged_by_their_form(spark):
    """The tables' own URLs: trained without the hosts of two of the four bad kinds, the model still tells these apart."""
    from pathlib import Path

    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("the test tables aren't here")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    every = {r.url: r.label for r in url_filter.label_by_seeds(pages).collect()}
    for hidden in (("casino", "pills"), ("free-", "track")):
        unseen = {u for u in every if any(w in u for w in hidden)}
        known = [(u, y) for u, y in every.items() if u not in unseen]
        held = [u for k, (u, y) in enumerate(known) if y == 1 and k % 4 == 0]
        rows = [(u, y) for u, y in known if u not in set(held)]
        model = url_filter.train(spark.createDataFrame(rows, "url string, label int"))
        scores = model.probability([*unseen, *held])
        assert unseen and auc(scores, np.array([0] * len(unseen) + [1] * len(held))) > 0.9
    judged = url_filter.filter_urls(pages, url_filter.train(spark.createDataFrame(list(every.items()), "url string, label int"))).collect()
    bad = [r.keep for r in judged if every.get(r.url) == 0]
    good = [r.keep for r in judged if every.get(r.url) == 1]
    assert bad and np.mean(bad) < 0.1 and np.mean(good) > 0.95


def test_probability_equals_a_walk_through_each_tree():
    rng = np.random.default_rng(2)
    urls = [f"http{'s' * (k % 2)}://h{k % 7}.example.{'com' if k % 3 else 'xyz'}/{'a/' * (k % 5)}{k}.html?q={k}" for k in range(300)]
    model = url_filter.fit(urls, rng.integers(0, 2, 300), trees=8)
    x = model.matrix(urls)
    for row, p in zip(x, model.probability(urls), strict=True):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))


def test_suffix_rates_are_those_of_other_folds(spark):
    urls = [f"http://h{k}.example/{k}" for k in range(40)]
    labels = [k % 3 == 0 for k in range(40)]
    labelled = spark.createDataFrame([(u, int(y)) for u, y in zip(urls, labels, strict=True)], "url string, label int")
    statistics = url_filter.corpus_statistics(labelled, labelled)
    found = url_filter._with_statistics(labelled.select("url"), statistics, training=True).select("url", "suffix_rate", url_filter._fold(F.col("url")).alias("fold")).collect()
    fold = {r.url: r.fold for r in found}
    mean = sum(labels) / 40
    for r in found:
        others = [y for u, y in zip(urls, labels, strict=True) if fold[u] != r.fold]
        assert r.suffix_rate == pytest.approx((sum(others) + 10 * mean) / (len(others) + 10))


def test_url_statistics_cover_all_pages(spark):
    urls = ["http://a.example/1.html"] * 30 + [f"http://b{k}.rare/{k}.php" for k in range(10)] + ["http://c.unrated/x", None, ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labelled = spark.createDataFrame([("http://a.example/1.html", 1)] * 30 + [(u, k % 2) for k, u in enumerate(urls[30:40])], "url string, label int")
    statistics = url_filter.corpus_statistics(pages, labelled)
    got = {(r.kind, r.key): (r.share, r.rate) for r in statistics.collect()}
    mean = 35 / 40
    want = {("suffix", "example"): (30 / 41, (30 + 10 * mean) / 40), ("suffix", "rare"): (10 / 41, (5 + 10 * mean) / 20), ("suffix", "unrated"): (1 / 41, mean), ("extension", "html"): (30 / 41, (30 + 10 * mean) / 40), ("extension", "php"): (10 / 41, (5 + 10 * mean) / 20), ("extension", ""): (1 / 41, mean)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    model = url_filter.train(labelled, max_labelled=5, statistics=statistics)
    judged = url_filter.filter_urls(pages, model, statistics=statistics)
    assert judged.columns == ["page_id", "url", "probability", "keep"] and judged.count() == len(urls)
    assert [r.keep for r in judged.collect() if not r.url] == [False, False]


def test_repeated_urls_fill_no_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(url_filter, "fit", lambda urls, labels, **_: seen.append((sorted(urls), sorted(labels.tolist()))))
    urls = [f"http://a.example/{k}" for k in range(6)]
    url_filter.train(spark.createDataFrame([(u, k % 2) for k, u in enumerate(urls) for _ in range(50)], "url string, label int"), max_labelled=6)
    assert seen == [(urls, [0, 0, 0, 1, 1, 1])]
