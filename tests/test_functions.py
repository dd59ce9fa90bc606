"""Column functions against values worked out by hand."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refminer.functions import identifiers as ids
from refminer.functions import text as tx


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_references(spark):
    refs = [("pmc123 ",), ("https://a.org/x",), ("10.1/ab",), ("file.xml",), (None,), ("",)]
    assert values(spark, refs, "r string", ids.canonical_reference(F.col("r"))) == ["https://www.ncbi.nlm.nih.gov/pmc/articles/PMC123", "https://a.org/x", "https://doi.org/10.1/ab", None, None, None]
    assert values(spark, refs, "r string", ids.reference_kind(F.col("r"))) == ["pmcid", "url", "doi", "path", None, None]


def test_article_id(spark):
    urls = [("https://x.org/pmc/PMC77/",), ("https://doi.org/10.1234/Ab.1",), ("https://www.ncbi.nlm.nih.gov/x/991",), ("https://x.org/article/abcdef/1",), ("https://x.org/a",), (None,)]
    assert values(spark, urls, "u string", ids.article_id(F.col("u"))) == ["PMC77", "10.1234/Ab.1", "991", "abcdef", "https:", None]
    assert values(spark, urls, "u string", ids.article_id(F.col("u"), only_known=True))[3:] == [None, None, None]


def test_url_parts(spark):
    urls = [("https://www.nature.com/articles/s1.pdf?x=1#y",), ("https://pubmed.gov/1",), ("plain",)]
    assert values(spark, urls, "u string", ids.publisher_domain(F.col("u"))) == ["nature", "pubmed", "Unknown Publisher"]
    assert values(spark, urls, "u string", ids.url_file_name(F.col("u"))) == ["s1.pdf", "1", "plain"]
    assert values(spark, urls, "u string", ids.file_extension(F.col("u")))[1] == ""


def test_download_links(spark):
    rows = [("a.pdf", "local-data", "https://x/PMC12"), ("/b", "media p", "PMC12"), ("c", "other", "PMC12"), ("d", "other", "https://y")]
    found = values(spark, rows, "h string, t string, p string", ids.download_link(F.col("h"), F.col("t"), F.col("p")))
    assert found == ["https://www.ncbi.nlm.nih.gov/pmc/articles/instance/12/bin/a.pdf", "https://www.ncbi.nlm.nih.gov/pmc/b", None, "d"]


def test_custom_id_is_bounded(spark):
    made = values(spark, [("m" * 10, "10.1/" + "x" * 100, 17)], "m string, i string, s int", ids.custom_id(F.col("m"), F.col("i"), F.col("s")))[0]
    assert len(made) == 64 and made.startswith("mmmmmmmmmm_10_1_x") and made.endswith("_17")


def test_citing_items(spark):
    assert values(spark, [("a, b and c, repo",)], "v string", ids.citing_items(F.col("v"))) == [["a,repo", "b,repo", "c,repo"]]


def test_sentences(spark):
    texts = [("One. Two! Three? four.",), ("As in Fig. A it is. Next one.",), ("",), (None,)]
    assert values(spark, texts, "t string", tx.sentences(F.col("t"))) == [["One.", "Two!", "Three? four."], ["As in Fig. A it is.", "Next one."], [""], None]


def test_character_chunks_cover(spark):
    text = "abcdefghij" * 25
    chunks = values(spark, [(text,)], "t string", tx.character_chunks(F.col("t"), 100, 10))[0]
    assert all(text[c["start"] : c["start"] + 100] == c["text"] for c in chunks) and [c["start"] for c in chunks] == [0, 90, 180]
    assert values(spark, [("",)], "t string", tx.character_chunks(F.col("t"), 100, 10)) == [[]]


def greedy(pieces, budget):
    out = []
    for p in pieces:
        if out and (len(out[-1]) + len(p) + 1) // 4 <= budget:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.text("abc.", min_size=1, max_size=30), max_size=12), min_size=1, max_size=6), st.integers(1, 12))
def test_packed_is_greedy(spark, rows, budget):
    assert values(spark, [(r,) for r in rows], "p array<string>", tx.packed(F.col("p"), budget)) == [greedy(r, budget) for r in rows]


def test_line_breaks(spark):
    assert values(spark, [("hyphen-\nated http://a.org/\nb soft\nend.\nNew",)], "t string", tx.merge_line_breaks(F.col("t"))) == ["hyphenated http://a.org/b soft end.\nNew"]


def test_reference_list(spark):
    assert values(spark, [("[1] A.\nmore\n[2] B.\n 3. C",)], "t string", tx.split_references(F.col("t"))) == [["[1] A.\nmore", "[2] B.", "3. C"]]
