"""Searches against brute force."""

import random
import re

from conftest import prose

from refminer.llm import decontamination, license_scan, secrets, token_counts


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())


def test_overlaps_equal_brute_force(spark, make_docs, collected):
    rng = random.Random(2)
    items = [(k, prose(rng, rng.choice([2, 4, 8, 12, 13, 14, 40]))) for k in range(12)] + [(12, "Épreuve à part: la première, la seconde et la troisième fois")]
    texts = []
    for _ in range(60):
        text = prose(rng, rng.randint(1, 120))
        if rng.random() < 0.5:
            item = rng.choice(items)[1].split()
            part = item[rng.randint(0, 2) :]
            text += " " + "! ".join(part).upper() + " " + prose(rng, 20)
        texts.append(text)
    want = []
    for k, text in enumerate(texts):
        w = words(text)
        for item, item_text in items:
            p = words(item_text)
            m = min(13, len(p))
            if m < 3:
                continue
            hits = [i for i in range(len(w) - m + 1) for j in range(len(p) - m + 1) if w[i : i + m] == p[j : j + m]]
            if hits:
                want.append((k, item, len(hits), min(hits), max(hits) + m - 1))
    docs = make_docs(texts)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert want and collected(decontamination.find_overlaps(docs, benchmark)) == sorted(want, key=repr)
    kept = {r.doc_id for r in decontamination.decontaminate(docs, benchmark).collect()}
    assert kept == set(range(60)) - {w[0] for w in want}


def test_items_of_one_word_and_blocks_of_items(spark, make_docs, collected, monkeypatch):
    texts = ["alpha beta gamma delta", "beta, Alpha", "gamma", "", None, "one two three four five"]
    items = [(1, "alpha"), (2, "Beta gamma"), (3, "one two three"), (3, "gamma"), (None, "beta"), (4, ""), (5, None)]
    docs, benchmark = make_docs(texts), spark.createDataFrame(items, "item_id bigint, text string")
    want = [(0, 1, 1, 0, 0), (0, 2, 1, 1, 2), (0, 3, 1, 2, 2), (1, 1, 1, 1, 1), (2, 3, 1, 0, 0), (5, 3, 1, 0, 2)]
    for size in (1 << 25, 5):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", size)
        assert collected(decontamination.find_overlaps(docs, benchmark, min_words=1)) == want
        assert {r.doc_id for r in decontamination.decontaminate(docs, benchmark, min_words=1).collect()} == {3, 4}


def test_rows_are_judged_by_their_own_text(spark, make_docs):
    benchmark = spark.createDataFrame([(0, "alpha beta gamma")], "item_id bigint, text string")
    docs = make_docs([(7, "alpha beta gamma"), (7, "clean"), (None, "so alpha, beta gamma"), (None, "clean too"), (8, "alpha beta gamma"), (8, "alpha beta gamma")])
    assert sorted((r.text) for r in decontamination.decontaminate(docs, benchmark).collect()) == ["clean", "clean too"]


def test_licenses_equal_full_alignment(make_docs):
    rng = random.Random(3)
    names = list(license_scan.TEMPLATES)
    texts, truth = [], []
    for k in range(40):
        name = rng.choice(names)
        body = license_scan.TEMPLATES[name].split()
        if k % 3 == 0 and len(body) > 30:  # a few words changed, left out or added
            for _ in range(len(body) // 20):
                at = rng.randrange(len(body))
                body[at] = rng.choice(["", "changed", body[at] + " added"])
        texts.append(prose(rng, 40) + "\n" + " ".join(body) + "\n" + prose(rng, 40))
        truth.append(name)
    texts.append(prose(rng, 300))
    found = {}
    for r in license_scan.scan_licenses(make_docs(texts)).collect():
        found.setdefault(r.doc_id, []).append(r)
        assert texts[r.doc_id][r.start : r.end].strip() == texts[r.doc_id][r.start : r.end]
    assert 40 not in found
    index = license_scan.TemplateIndex.compile(license_scan.TEMPLATES)
    for k, name in enumerate(truth):
        numbers = {w: n for n, w in enumerate(dict.fromkeys(words(license_scan.TEMPLATES[name]) + words(texts[k])))}
        template, doc = [[numbers[w] for w in words(t)] for t in (license_scan.TEMPLATES[name], texts[k])]
        matched, _, first, end = license_scan.align(template, doc, -len(template), len(doc))
        if matched >= license_scan.MIN_COVERAGE * len(template):
            best = max(found[k], key=lambda r: r.matched_words)
            assert best.matched_words >= matched
            if best.license == name:
                assert best.coverage == matched / len(template)
                assert words(texts[k][best.start : best.end]) == words(texts[k])[first:end]
    assert len(index.names) == len(names)


def test_repeated_notices_equal_brute_force(make_docs):
    rng = random.Random(31)

    def brute(template, doc, at=0):
        matched, _, first, end = license_scan.align(template, doc, -len(template), len(doc))
        if matched < license_scan.MIN_COVERAGE * len(template):
            return []
        return [*brute(template, doc[:first], at), (at + first, at + end), *brute(template, doc[end:], at + end)]

    for name, most in (("All-rights-reserved", 60), ("CC-BY-4.0-notice", 60), ("CC-BY-4.0", 30), ("ISC", 8)):
        body = license_scan.TEMPLATES[name]
        texts = [("%s\n" % body) * most]
        for gap in (1, 4, 11, 30):
            texts.append("é " + "".join(f"{body} {prose(rng, rng.randint(0, gap))}\n" for _ in range(rng.randint(2, most))))
        found = {}
        for r in license_scan.scan_licenses(make_docs(texts), {name: body}).collect():
            found.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start : r.end])
        for k, text in enumerate(texts):
            numbers = {w: n for n, w in enumerate(dict.fromkeys(words(body) + words(text)))}
            template, doc = [[numbers[w] for w in words(x)] for x in (body, text)]
            spans = brute(template, doc)
            assert len(spans) == text.count(body)
            assert [words(x) for x in sorted(found[k])] == sorted(words(text)[a:b] for a, b in spans), (name, k)


def test_notices_of_several_kinds_in_one_list(make_docs):
    rng = random.Random(32)
    names = ["MIT-notice-2", "CC-BY-4.0-notice", "All-rights-reserved", "Apache-2.0-notice", "GPL-3.0-notice"]
    order = [rng.choice(names) for _ in range(3000)]
    text = "\n".join(license_scan.TEMPLATES[name] for name in order)
    found = sorted((r.start, r.license) for r in license_scan.scan_licenses(make_docs([text])).collect())
    assert [name for _, name in found] == order


def test_notices_need_the_name_of_their_license(make_docs):
    cases = {
        "Released under the BSD License": ["BSD-notice"],
        "Licensed under the Mozilla License": [],
        "Licensed under the Mozilla Public License, version 2.0": ["MPL-2.0-notice"],
        "Licensed under the Apache License, Version 1.1.": [],
        "Licensed under Apache License, Version 2.0.": ["Apache-2.0-notice"],
        "Licensed under CC BY 3.0.": [],
        "This work is licensed under the GNU General Public License, version 1.": [],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0-notice"],
        "This work is licensed under a Creative Commons Attribution 3.0 International License.": [],
        "Released under the terms of the MIT License": ["MIT-notice"],
        "Licensed under the Mozilla License. Licensed under the MIT License.": ["MIT-notice-2"],
    }
    found = {}
    for r in license_scan.scan_licenses(make_docs(list(cases))).collect():
        found.setdefault(r.doc_id, []).append(r.license)
    assert [found.get(k, []) for k in range(len(cases))] == list(cases.values())
    rare = {"Rare": "Given away under the Rare License."}
    assert [r.doc_id for r in license_scan.scan_licenses(make_docs(["Given away under the Other License.", rare["Rare"]]), rare).collect()] == [1]


def test_winnowing_keeps_one_of_every_window():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in range(0, 40):
        hashes = rng.integers(0, 5, n).astype(np.uint64)
        kept = set(license_scan.winnow(hashes, 4).tolist())
        assert all(kept & set(range(i, i + 4)) for i in range(n - 3))


def test_token_counts_equal_greedy_matching(make_docs):
    rng = random.Random(5)

    def greedy(word, vocabulary):
        s, i, n = (*word, token_counts.END), 0, 0
        while i < len(s):
            j = next((j for j in range(len(s), i, -1) if s[i:j] in vocabulary), 0)
            if not j:
                return 1
            i, n = j, n + 1
        return n

    for _ in range(200):
        vocabulary = {tuple(rng.choices(b"abc", k=rng.randint(1, 4))) + ((token_counts.END,) if rng.random() < 0.5 else ()) for _ in range(rng.randint(1, 14))}
        if rng.random() < 0.5:
            vocabulary |= {(c,) for c in b"abc"} | {(token_counts.END,)}
        sample = [bytes(rng.choices(b"abc", k=rng.randint(1, 9))) for _ in range(25)]
        assert token_counts.build(vocabulary).count(sample).tolist() == [greedy(w, vocabulary) for w in sample]
    pieces = set(token_counts.read_vocabulary(token_counts.VOCABULARY))
    texts = [prose(rng, 50) + " Don't übermäßig 漢字 🙂 x1234!!" for _ in range(10)]
    want = [sum(greedy(w.encode(), pieces) for w in token_counts.split_words(t)) for t in texts]
    assert [r.n_tokens for r in token_counts.count_tokens(make_docs(texts)).orderBy("doc_id").collect()] == want


def test_separators_that_are_no_white_space_are_counted(make_docs):
    pieces = set(token_counts.read_vocabulary(token_counts.VOCABULARY))

    def greedy(word):
        s, i, n = (*word.encode(), token_counts.END), 0, 0
        while i < len(s):
            j = next((j for j in range(len(s), i, -1) if s[i:j] in pieces), 0)
            if not j:
                return 1
            i, n = j, n + 1
        return n

    texts = ["hello\x1cworld", "\x1d", "a \x1e b\x1f\x1f c", "plain words", "tab\x0bform\x0cfeed\x85next\xa0no-break\u2028line"]
    assert [r.n_tokens for r in token_counts.count_tokens(make_docs(texts)).orderBy("doc_id").collect()] == [sum(map(greedy, token_counts.split_words(t))) for t in texts]


def test_secrets_on_held_out_samples(make_docs):
    samples = [s for s in secrets.labelled_samples(500, seed=77) if len(s[0]) >= secrets.MIN_LENGTH]
    rng = random.Random(6)
    texts = [prose(rng, 5) + f' "{text}" ' + prose(rng, 5) for text, _ in samples]
    found = {r.doc_id: texts[r.doc_id][r.start : r.end] for r in secrets.scan_secrets(make_docs(texts)).collect()}
    random_ones = [k for k, s in enumerate(samples) if s[1]]
    assert sum(found.get(k) == samples[k][0] for k in random_ones) > 0.97 * len(random_ones)
    assert len(set(found) - set(random_ones)) < 0.02 * len(samples)


def test_secrets_joined_to_text_are_found(make_docs):
    rng = random.Random(21)
    upper, base64, hexadecimal = secrets.ALPHABET[26:62], secrets.ALPHABET[:62] + "+/", "0123456789abcdef"
    before = ["api_key=", "database_password=", "export_production_database_password=", "/home/users/service/config/production/credentials/"]
    for alphabet, n, least in ((upper, 20, 0.85), (base64, 40, 0.9), (hexadecimal, 32, 0.9)):
        for prefix in before:
            keys = ["".join(rng.choices(alphabet, k=n)) for _ in range(100)]
            texts = [f"{prose(rng, 5)} {prefix}{key} {prose(rng, 5)}" for key in keys]
            found = {r.doc_id: texts[r.doc_id][r.start : r.end] for r in secrets.scan_secrets(make_docs(texts)).collect()}
            assert sum(found.get(k) == key for k, key in enumerate(keys)) > least * len(keys), (prefix, n)
    keys = ["".join(rng.choices(base64[:62], k=38)) for _ in range(40)]
    texts = [f"é {a}/the_second_production_credentials_directory=" + b + "==" for a, b in zip(keys[::2], keys[1::2], strict=True)]
    found = {(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in secrets.scan_secrets(make_docs(texts)).collect()}
    assert len(found & {(k // 2, key + "==" * (k % 2)) for k, key in enumerate(keys)}) > 0.9 * len(keys)
    plain = [f"{prefix}{value}" for prefix in before for value in ("correct_horse_battery_staple", "main/source/file_names", "20241231", "")]
    assert secrets.scan_secrets(make_docs(plain)).count() == 0


def test_secret_stretches_equal_brute_force():
    rng = random.Random(22)
    model = secrets.default_model()
    for _ in range(60):
        text = "".join("".join(rng.choices(rng.choice(["ab_/", secrets.ALPHABET[26:62], "theionsr"]), k=rng.randint(1, 9))) for _ in range(rng.randint(1, 5)))
        codes = secrets._CODE[list(text.encode())]
        n = len(codes)

        def ratio(i, j, codes=codes):
            return model[secrets.START, codes[i]] + sum(model[codes[k - 1], codes[k]] for k in range(i + 1, j))

        def gain(i, j, text=text, n=n):
            edges = sum(0 if outer is None else secrets.JOINT if outer in "_-+/" else secrets.INSIDE for outer in (text[i - 1] if i else None, text[j] if j < n else None))
            return ratio(i, j) - 2.0 - edges

        best = [0.0]
        for j in range(1, n + 1):
            best.append(max([best[j - 1]] + [best[i] + gain(i, j) for i in range(j - 3)]))
        found = secrets.stretches(codes, model, 4, 2.0)
        assert abs(sum(gain(i, j) for i, j, _ in found) - best[n]) < 1e-9
        assert all(j - i >= 4 and abs(v - ratio(i, j)) < 1e-9 for i, j, v in found)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
