"""Selectors, rules, and what they do with broken input; resolution against known answers."""

import pytest

from refminer.functions import text as tx
from refminer.operators import analytics, describe, extraction, markup, ontology, prompts, resolve, rules

PAGE = """<html><body><div id="main" class="a b"><section class="data-x"><h2 class="t">Data Availability</h2><p>at <a href="https://x.org/dataset/1">here</a></p>
<ul><li><a href="f.pdf" data-title="My Data">pdf</a></li></ul></section></div><p>end</p></body></html>"""


@pytest.mark.parametrize(
    ("css", "found"),
    [
        ("a", ["here", "pdf"]),
        ("a[href*=dataset]", ["here"]),
        ("a[href$='.pdf']", ["pdf"]),
        ("a[href^=https]", ["here"]),
        ("a[data-title~=Data]", ["pdf"]),
        ("[data-title]", ["pdf"]),
        (".a.b section.data-x p a", ["here"]),
        ("#main li a", ["pdf"]),
        ("h2.t:contains('Availability')", ["Data Availability"]),
        ("h2:contains('else')", []),
        ("body > a", None),
        ("section section a", []),
        ("*:contains('pdf') a[href=\"f.pdf\"]", ["pdf"]),
    ],
)
def test_selectors(css, found):
    if found is None:
        with pytest.raises(ValueError):
            rules.parse_selector(css)
    else:
        assert [markup.plain(e) for e in rules.select(markup.html_tree(PAGE), rules.parse_selector(css))] == found


def test_rules_of_a_publisher_come_first():
    table = {"general": {"links": {"a": "x", "b": "y"}}, "p": {"links": {"a": "own"}, "more": {"c": "z"}}}
    assert rules.merged("p", table) == {"links": {"a": "own", "b": "y"}, "more": {"c": "z"}}
    assert rules.merged(None, table) == {"links": {"a": "x", "b": "y"}}


def test_broken_documents_and_rules_match_nothing(spark):
    docs = spark.createDataFrame([("1", PAGE, "HTML"), ("2", "<a><b></a>", "XML"), ("3", None, "HTML"), ("4", "", "XML")], "key string, content string, format string")
    found = rules.rule_matches(docs, html={"general": {"links": {"a[href*=dataset]": "dataset", "a > b": "never", "((": "never"}}}).collect()
    assert [(r.key, r.label, r.href, r.linked) for r in found] == [("1", "dataset", "https://x.org/dataset/1", True)]
    assert {(r.key, r.rule, r.present) for r in rules.section_flags(docs, html={"general": {"none": {"table": "x"}}}).collect()} == {("1", "none", False)}
    assert {r.key for r in rules.normalised(docs).collect()} == {"1"}


CITATIONS = "dataset_identifier string, data_repository string, dataset_webpage string"


@pytest.mark.parametrize(
    ("identifier", "repository", "wanted"),
    [
        ("https://doi.org/10.1594/PANGAEA.964081", "PANGAEA", ("10.1594/PANGAEA.964081", "doi.org/10.1594")),
        ("https://doi.org/10.17632/xtb4mkvf8f.1", "data.mendeley.com", ("10.17632/xtb4mkvf8f.1", "data.mendeley.com")),
        ("MSV000081006", "massive.ucsd.edu", ("MSV000081006", "massive.ucsd.edu")),
        ("10.7937/tcia.2019.30ilqfcl", "cancerimagingarchive.net", ("10.7937/tcia.2019.30ilqfcl", "cancerimagingarchive.net")),
        ("syn9702085", "https://www.synapse.org/#!Synapse:syn9702085", ("syn9702085", "synapse.org")),
        ("M27187", "https://www.ncbi.nlm.nih.gov/nuccore/M27187", ("M27187", "www.ncbi.nlm.nih.gov")),
    ],
)
def test_known_answers_with_the_larger_ontology(spark, identifier, repository, wanted):
    rows = spark.createDataFrame([(identifier, repository, None)], CITATIONS)
    (found,) = resolve.resolve_citations(rows, ontology.EXTENDED).collect()
    assert tuple(found)[:2] == wanted
    if identifier in ("syn9702085", "M27187"):
        assert found.dataset_webpage == {"syn9702085": "https://www.synapse.org/Synapse:syn9702085", "M27187": repository}[identifier]


def test_names_of_repositories(spark):
    rows = spark.createDataFrame([("GSE123456", "NCBI GEO", None), ("GSE923456", "NCBI Gene Expression Omnibus (GEO)", None)], CITATIONS)
    assert [r.data_repository for r in resolve.resolve_citations(rows).collect()] == ["geo", "geo"]


def test_lists_and_long_ranges(spark):
    rows = spark.createDataFrame([("GSE1, PXD000001", "geo, pride", None), ("AB1-AB12000", "nuccore", None), (None, None, None), ("", "", "")], CITATIONS)
    found = resolve.resolve_citations(rows).collect()
    assert [tuple(r)[:2] for r in found[:2]] == [("GSE1", "geo"), ("PXD000001", "www.ebi.ac.uk")]
    assert len([r for r in found if r.dataset_identifier.startswith("AB")]) == 12_000


def test_sentences_of_a_row_and_of_a_column_agree(spark):
    texts = ["One. Two! Three? four.", "As in Fig. A it is. See et al. B. End", "Dr. No", "", "e.g. A. B", "x.  Y.\nZ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(tx.sentences(rows.t)).collect()] == [tx.split_sentences(t) for t in texts]
    assert tx.split_sentences("As in Fig. A it is. See") == ["As in Fig. A it is.", "See"]


def test_longest_common_subsequence():
    assert analytics.longest_common("a b c d".split(), "b d a c d".split()) == 3 and analytics.longest_common([], ["a"]) == 0


def test_strides_over_many_partitions(spark):
    rows = spark.range(1, 1001).repartition(7).withColumnRenamed("id", "k")
    assert sorted(r.k for r in analytics.strided(rows, "k", 100).collect()) == list(range(1, 1001, 100))


def test_prompts_and_schemas_by_name(tmp_path):
    (tmp_path / "datasets.txt").write_text("own {content}")
    (tmp_path / "other.json").write_text('{"prompt": "from json"}')
    (tmp_path / "shape.json").write_text('{"type": "array", "items": {"type": "integer"}}')
    folders = (str(tmp_path / "none"), str(tmp_path))
    assert prompts.load_prompt("datasets", folders) == "own {content}" and prompts.load_prompt("datasets") == prompts.BUILT_IN["datasets"]
    assert prompts.load_prompt("other", folders) == "from json" and prompts.load_config("other", folders) == {"prompt": "from json"}
    for load in (prompts.load_prompt, prompts.load_schema, prompts.load_config):
        with pytest.raises(KeyError):
            load("nothing", folders)
    shape = prompts.load_schema("shape", folders)
    assert prompts.conforms([1, 2], shape) and not prompts.conforms([1, "x"], shape) and not prompts.conforms({}, shape)
    good = {"datasets": [{"dataset_identifier": "a", "data_repository": "b"}]}
    assert prompts.conforms(good, prompts.load_schema("datasets")) and not prompts.conforms({"datasets": [{"dataset_identifier": 1}]}, prompts.load_schema("datasets"))
    assert "patterns" in describe.settings(extraction.RuleExtractor())
