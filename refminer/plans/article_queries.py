"""Queries over articles: JATS, TEI and HTML documents made from the table documents by one expression, so that SQL can say what must come out.

Every document of the table gives one article; its words, as lower-case ASCII, are in the article's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refminer.functions import identifiers as ids
from refminer.functions import text as tx
from refminer.operators import analytics, describe, extraction, markup, metadata, ontology, resolve, retrieval, rules, tables
from refminer.plans import pipeline
from refminer.plans.queries import query, table
from refminer.sources import references

WORDS = "trim('Words ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')))"
D = f"d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS key, CAST(doc_id AS VARCHAR) AS n, coalesce(lang, 'xx') AS lang, {WORDS} AS w FROM documents)"


def _based(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.trim(F.concat(F.lit("Words "), F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))))
    n = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("key"), n.alias("n"), F.coalesce("lang", F.lit("xx")).alias("lang"), words.alias("w"))


def _filled(template: str) -> Column:
    return extraction.render(template, n=F.col("n"), w=F.col("w"), lang=F.col("lang"))


JATS = (
    '<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><title-group><article-title>Study {n}</article-title></title-group></article-meta></front>'
    '<body><sec sec-type="methods"><title>Methods</title><p>{w}</p><sec><title>Tables</title><table-wrap><table><tr><th>name</th><th>value</th></tr><tr><td>{lang}</td><td>{n}</td></tr></table></table-wrap></sec></sec>'
    '<sec sec-type="data-availability"><title>Data Availability</title><p>Deposited in GEO under GSE{n} (see <xref rid="S1" ref-type="supplementary-material">file</xref>). More at <ext-link xlink:href="https://x.org/{n}">link</ext-link>.</p></sec></body>'
    '<back><sec sec-type="supplementary-material"><title>Supplements</title><supplementary-material id="S1" content-type="local-data"><caption><title>Table S{n}</title><p>Counts.</p></caption><media xlink:href="s{n}.xlsx"/></supplementary-material></sec>'
    '<ref-list><ref id="r1"><label>1</label><mixed-citation>First work of {n}. <pub-id pub-id-type="doi">10.1000/a{n}</pub-id></mixed-citation></ref><ref id="r2"><label>2</label><element-citation>Second work <ext-link xlink:href="https://y.org/{n}">y</ext-link></element-citation></ref></ref-list></back></article>'
)
TEI = (
    '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><sourceDesc><biblStruct><analytic><title>Paper {n}</title></analytic></biblStruct></sourceDesc></fileDesc></teiHeader>'
    '<text><body><div><head>Results</head><p>{w}</p><p>As shown by <ref type="bibr" target="#b0">[1]</ref> in {n}.</p></div></body>'
    '<back><div><listBibl><biblStruct xml:id="b0"><analytic><title>Old work</title><author><persName><forename>Ada</forename><surname>Ro{n}</surname></persName></author></analytic>'
    '<monogr><title>Journal</title><imprint><date>1999</date></imprint></monogr><idno>10.1/{n}</idno></biblStruct></listBibl></div></back></text></TEI>'
)
HTML = (
    '<html><head><title>Page {n}</title><script type="application/ld+json">{"@context":"https://schema.org","@type":"Dataset","name":"Set {n}","license":"CC0","creator":"Ada {n}"}</script></head><body>'
    '<h1 class="article-title">Heading {n}</h1><section class="main"><h2>Body</h2><p>{w}</p><section class="inner"><h3>Inner</h3><p>Inner text of {n}.</p></section></section>'
    '<section class="data-availability-statement"><h2 class="pmc_sec_title">Data Availability</h2><p>All data are at <a href="https://zenodo.org/{n}">Zenodo</a> as GSE{n}.</p></section>'
    '<section id="sm1" class="supplementary-material"><h2 class="pmc_sec_title">Supplementary Material</h2><div class="caption p">Additional file {n}</div><a href="/bin/f{n}.zip" data-ga-action="click_feat_suppl">file {n}</a></section>'
    '<section class="ref-list"><ul><li><span class="label">1.</span><cite>Work one of {n}</cite><a href="https://doi.org/10.1/{n}">doi</a></li></ul></section></body></html>'
)


def _documents(spark: SparkSession, sf_dir: str, template: str, kind: str) -> DataFrame:
    return _based(spark, sf_dir).select("key", _filled(template).alias("content"), F.lit(kind).alias("format"))


def jats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, JATS, "XML")


def tei(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, TEI, "XML")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, HTML, "HTML")


AVAILABLE = "'Deposited in GEO under GSE' || n || ' (see file). More at link.'"
SIZE = "CAST(greatest(5, length(n)) AS INTEGER)"
TABLE = f"'name | ' || rpad('value', {SIZE}, ' ') || chr(10) || rpad(lang, 4, ' ') || ' | ' || rpad(n, {SIZE}, ' ')"


@query(
    f"""WITH {D} SELECT key, CAST(0 AS INTEGER) AS sec_idx, 'Methods' AS section_title, 'methods' AS sec_type, 'section' AS kind, md5(w) AS digest, '' AS tables FROM d
    UNION ALL SELECT key, 1, 'Methods > Tables', 'unknown', 'section', md5(''), {TABLE} FROM d
    UNION ALL SELECT key, 2, 'Data Availability', 'data-availability', 'availability', md5({AVAILABLE}), '' FROM d
    UNION ALL SELECT key, 3, 'Supplements', 'supplementary-material', 'section', md5('Counts.'), '' FROM d"""
)
def jats_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.sections(jats(spark, sf_dir)).select("key", "sec_idx", "section_title", "sec_type", "kind", F.md5("text").alias("digest"), "tables")


@query(f"WITH {D} SELECT key, CAST(0 AS INTEGER) AS sec_idx, 'Results' AS section_title, md5(w || chr(10) || 'As shown by [1] in ' || n || '.') AS digest FROM d")
def tei_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.sections(tei(spark, sf_dir)).select("key", "sec_idx", "section_title", F.md5("text").alias("digest"))


@query(
    f"""WITH {D} SELECT key, CAST(0 AS INTEGER) AS p_idx, 'Results' AS section_title, md5(w) AS digest FROM d
    UNION ALL SELECT key, 1, 'Results', md5('As shown by Ada Ro' || n || ', Old work, Journal, 1999, 10.1/' || n || ' in ' || n || '.') FROM d"""
)
def tei_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.tei_paragraphs(tei(spark, sf_dir), substitute=True).select("key", "p_idx", "section_title", F.md5("text").alias("digest"))


@query(
    f"""WITH {D} SELECT key, CAST(0 AS INTEGER) AS sec_idx, 'Body' AS section_title, 'main' AS sec_type, 'section' AS kind, md5(w) AS digest FROM d
    UNION ALL SELECT key, 1, 'Inner', 'inner', 'section', md5('Inner text of ' || n || '.') FROM d
    UNION ALL SELECT key, 2, 'Data Availability', 'data-availability-statement', 'availability', md5('All data are at Zenodo as GSE' || n || '.') FROM d"""
)
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.sections(pages(spark, sf_dir)).select("key", "sec_idx", "section_title", "sec_type", "kind", F.md5("text").alias("digest"))


@query(
    f"""WITH {D}, p AS (SELECT key, '' AS sec_type, w AS text, 0 AS i FROM d UNION ALL SELECT key, '', 'Inner text of ' || n || '.', 1 FROM d UNION ALL SELECT key, '', 'All data are at Zenodo as GSE' || n || '.', 2 FROM d)
    SELECT key, CAST(i AS INTEGER) AS p_idx, sec_type, md5(text) AS digest FROM p"""
)
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.html_paragraphs(pages(spark, sf_dir)).select("key", "p_idx", "sec_type", F.md5("text").alias("digest"))


@query(
    f"""WITH {D} SELECT key, 's' || n || '.xlsx' AS link, 'S1' AS id, 'local-data' AS content_type, 'Table S' || n AS title, 'Counts.' AS caption,
      'Deposited in GEO under GSE' || n || ' (see file this file).' AS context_description, 'xlsx' AS file_extension, 'supplementary-material' AS source_section FROM d"""
)
def jats_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.supplements(jats(spark, sf_dir))


@query(f"WITH {D} SELECT key, '/bin/f' || n || '.zip' AS link, 'sm1' AS id, 'click_feat_suppl' AS content_type, 'file ' || n AS title, 'Additional file ' || n AS caption, 'zip' AS file_extension FROM d")
def html_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.supplements(pages(spark, sf_dir)).select("key", "link", "id", "content_type", "title", "caption", "file_extension")


@query(
    f"""WITH {D} SELECT 'xml' || key AS key, '#S1' AS href, 'file' AS link_text FROM d UNION ALL SELECT 'xml' || key, 'https://x.org/' || n, 'link' FROM d
    UNION ALL SELECT 'html' || key, 'https://zenodo.org/' || n, 'Zenodo' FROM d"""
)
def availability_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml, html = markup.availability_links(jats(spark, sf_dir)), markup.availability_links(pages(spark, sf_dir))
    return xml.withColumn("key", F.concat(F.lit("xml"), "key")).unionByName(html.withColumn("key", F.concat(F.lit("html"), "key"))).select("key", "href", "link_text")


@query(
    f"""WITH {D} SELECT 'xml' || key AS key, CAST(0 AS INTEGER) AS ref_idx, '1' AS label, 'First work of ' || n || '. 10.1000/a' || n AS text, '10.1000/a' || n AS doi, NULL AS link FROM d
    UNION ALL SELECT 'xml' || key, 1, '2', 'Second work y', NULL, 'https://y.org/' || n FROM d
    UNION ALL SELECT 'html' || key, 0, '1.', 'Work one of ' || n, NULL, 'https://doi.org/10.1/' || n FROM d"""
)
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml, html = markup.references_of(jats(spark, sf_dir)), markup.references_of(pages(spark, sf_dir))
    both = xml.withColumn("key", F.concat(F.lit("xml"), "key")).unionByName(html.withColumn("key", F.concat(F.lit("html"), "key")))
    return both.select("key", "ref_idx", "label", "text", F.try_element_at("ids", F.lit("doi")).alias("doi"), F.get("links", F.lit(0)).alias("link"))


@query(f"WITH {D} SELECT 'jats' AS kind, key, 'Study ' || n AS pub_title FROM d UNION ALL SELECT 'tei', key, 'Paper ' || n FROM d UNION ALL SELECT 'html', key, 'Heading ' || n FROM d UNION ALL SELECT 'column', key, 'Study ' || n FROM d")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jats(spark, sf_dir).select(F.lit("column").alias("kind"), "key", markup.xml_title(F.col("content")).alias("pub_title"))
    for kind, docs in (("jats", jats(spark, sf_dir)), ("tei", tei(spark, sf_dir)), ("html", pages(spark, sf_dir))):
        out = out.unionByName(markup.titles(docs).select(F.lit(kind).alias("kind"), "key", "pub_title"))
    return out


@query(f"""WITH {D} SELECT key, 'Set ' || n AS name, 'CC0' AS license, '{{"name": "Ada ' || n || '"}}' AS creator FROM d""")
def dataset_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.dataset_metadata(pages(spark, sf_dir))
    return found.select("key", *[F.try_element_at("metadata", F.lit(c)).alias(c) for c in ("name", "license", "creator")])


@query(f"WITH {D} SELECT key, CAST(0 AS INTEGER) AS table_idx, CAST(2 AS INTEGER) AS rows, {TABLE} AS text FROM d")
def article_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.tables_of(jats(spark, sf_dir)).select("key", "table_idx", F.size("rows").alias("rows"), "text")


@query(
    f"""WITH {D} SELECT 'xml' AS kind, key, 'data_availability' AS rule, true AS present, true AS linked FROM d UNION ALL SELECT 'xml', key, 'supplementary_material', true, true FROM d
    UNION ALL SELECT 'xml', key, 'supplementary_data', true, true FROM d UNION ALL SELECT 'html', key, 'data_availability', true, true FROM d
    UNION ALL SELECT 'html', key, 'supplementary_material', true, true FROM d UNION ALL SELECT 'html', key, 'links', false, false FROM d"""
)
def section_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml, html = rules.section_flags(jats(spark, sf_dir)), rules.section_flags(pages(spark, sf_dir), "PMC")
    return xml.select(F.lit("xml").alias("kind"), "*").unionByName(html.select(F.lit("html").alias("kind"), "*"))


@query(
    f"""WITH {D} SELECT key, 'data_availability' AS rule, 'dataset' AS label, 'section' AS tag, NULL AS href FROM d UNION ALL SELECT key, 'data_availability', 'dataset', 'h2', NULL FROM d
    UNION ALL SELECT key, 'supplementary_material', 'supplementary', 'section', NULL FROM d UNION ALL SELECT key, 'supplementary_material', 'supplementary', 'h2', NULL FROM d"""
)
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_matches(pages(spark, sf_dir), "PMC").select("key", "rule", "label", "tag", "href")


@query(f"WITH {D} SELECT 'jats' AS kind, key, 'xlink' AS prefix, 'http://www.w3.org/1999/xlink' AS uri FROM d UNION ALL SELECT 'tei', key, '', 'http://www.tei-c.org/ns/1.0' FROM d")
def document_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.namespaces(jats(spark, sf_dir)).select(F.lit("jats").alias("kind"), "*").unionByName(rules.namespaces(tei(spark, sf_dir)).select(F.lit("tei").alias("kind"), "*"))


@query(f"WITH {D} SELECT key, 'p' AS tag, 'All data are at Zenodo as GSE' || n || '.' AS text, CAST(length('All data are at Zenodo as GSE' || n || '.') AS INTEGER) AS length FROM d")
def identifier_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pages(spark, sf_dir).withColumn("uid", F.concat(F.lit("gse"), "key"))
    return rules.elements_with(docs, "uid").select("key", "tag", "text", "length")


@query(f"WITH {D} SELECT key, md5('<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<a x=\"1\" y=\"2\">' || chr(10) || '  <b>' || w || '</b>' || chr(10) || '  tail' || chr(10) || '  <c/>' || chr(10) || '</a>') AS digest FROM d")
def normalised_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, '<?xml version="1.0"?><a y="2" x="1">\n <b> {w} </b> tail <c/></a>', "XML")
    return rules.normalised(docs).select("key", F.md5("content").alias("digest"))


@query(f"WITH {D} SELECT key, md5('<div>' || chr(10) || '  <p>' || w || '</p>' || chr(10) || '</div>') AS digest FROM d")
def normalised_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "<div><style>p{}</style><script>x()</script><p> {w} </p></div>", "HTML")
    return rules.normalised(docs).select("key", F.md5("content").alias("digest"))


# --- the whole way ----------------------------------------------------------------------------------------------------

GEO = "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc="


def _urls(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat(F.lit("https://a.org/"), "key").alias("source_url"), "content", "format")


@query(
    f"""WITH {D} SELECT 'https://a.org/' || n AS source_url, 'GSE' || n AS dataset_identifier, 'geo' AS data_repository, '{GEO}GSE' || n AS dataset_webpage, 'data_availability' AS source_section, 'data availability' AS retrieval_pattern,
      'Complex download' AS access_mode, NULL AS link, NULL AS id, 'Study ' || n AS pub_title, 'XML' AS raw_data_format FROM d
    UNION ALL SELECT 'https://a.org/' || n, NULL, NULL, NULL, 'supplementary-material', 'supplementary material', NULL, 's' || n || '.xlsx', 'S1', 'Study ' || n, 'XML' FROM d"""
)
def article_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.documents_to_citations(_urls(jats(spark, sf_dir)), extraction.RuleExtractor())
    return out.select("source_url", "dataset_identifier", "data_repository", "dataset_webpage", "source_section", "retrieval_pattern", "access_mode", "link", "id", "pub_title", "raw_data_format")


@query(f"WITH {D} SELECT 'https://a.org/' || n AS source_url, 'GSE' || n AS dataset_identifier, 'geo' AS data_repository, 'full document' AS retrieval_pattern FROM d")
def full_read_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.documents_to_citations(_urls(pages(spark, sf_dir)), extraction.RuleExtractor(), full_read=True, section_filter="data_availability_statement")
    return out.select("source_url", "dataset_identifier", "data_repository", "retrieval_pattern")


@query(f"WITH {D} SELECT 'https://a.org/' || n AS source_url, '/bin/f' || n || '.zip' AS link, '/bin/f' || n || '.zip' AS download_link FROM d")
def supplementary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.documents_to_citations(_urls(pages(spark, sf_dir)), extraction.RuleExtractor(), section_filter="supplementary_material")
    return out.select("source_url", "link", "download_link")


@query(f"WITH {D} SELECT 'https://a.org/' || n AS publication_url, 'GSE' || n AS dataset_identifier, 'geo' AS data_repository, '{GEO}GSE' || n AS dataset_webpage FROM d")
def datasets_of_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.datasets_of_articles(pipeline.documents_to_citations(_urls(jats(spark, sf_dir)), extraction.RuleExtractor()))


@query(f"WITH {D} SELECT key, 0 AS chunk, md5(w) AS digest FROM d WHERE length(w) // 4 <= 100000 UNION ALL SELECT key, 1, md5({TABLE}) FROM d UNION ALL SELECT key, 2, md5({AVAILABLE}) FROM d UNION ALL SELECT key, 3, md5('Counts.') FROM d".replace(" AS chunk", "").replace("key, 0,", "key, CAST(0 AS INTEGER) AS sec_idx,"))
def article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pipeline.chunks_of(markup.sections(jats(spark, sf_dir)), 100_000)
    return chunks.select("key", "sec_idx", F.md5("text").alias("digest"))


# --- resolution of lists, and with the larger ontology ----------------------------------------------------------------

LISTED = {
    0: ("'GSE' || n || ', PXD' || lpad(n, 7, '0')", "'geo, pride'", "NULL"),
    1: ("'GSE' || n || ',MSV' || n", "'a, b, c'", "NULL"),
    2: ("'n/a'", "'n/a'", "'https://massive.ucsd.edu/ProteoSAFe/dataset.jsp?accession=MSV' || n"),
    3: ("'syn' || lpad(n, 7, '1')", "'https://www.synapse.org/#!Synapse:syn' || lpad(n, 7, '1')", "NULL"),
    4: ("'two words'", "'geo'", "NULL"),
    5: ("'n/a'", "'data in GSE' || n", "NULL"),
    6: ("'10.6084/m9.figshare.' || n", "'n/a'", "NULL"),
}
LISTED_SQL = (
    f"SELECT doc_id, 'GSE' || n AS dataset_identifier, 'geo' AS data_repository, '{GEO}GSE' || n AS dataset_webpage FROM d WHERE doc_id % 7 IN (0, 1, 5)"
    " UNION ALL SELECT doc_id, 'PXD' || lpad(n, 7, '0'), 'www.ebi.ac.uk', 'https://www.ebi.ac.uk/pride/archive/projects/PXD' || lpad(n, 7, '0') FROM d WHERE doc_id % 7 = 0"
    " UNION ALL SELECT doc_id, 'MSV' || n, 'massive.ucsd.edu', 'https://massive.ucsd.edu/ProteoSAFe/dataset.jsp?accession=MSV' || n FROM d WHERE doc_id % 7 IN (1, 2)"
    " UNION ALL SELECT doc_id, 'syn' || lpad(n, 7, '1'), 'synapse.org', 'https://www.synapse.org/Synapse:syn' || lpad(n, 7, '1') FROM d WHERE doc_id % 7 = 3"
    " UNION ALL SELECT doc_id, '10.6084/m9.figshare.' || n, 'figshare.com', 'https://figshare.com/articles/dataset/10.6084/m9.figshare.' || n FROM d WHERE doc_id % 7 = 6"
)


def _picked(docs: DataFrame, cases: dict[int, tuple[str, str, str]]) -> DataFrame:
    def pick(k: int) -> Column:
        out = F.lit(None).cast("string")
        for v, row in cases.items():
            out = F.when(F.col("doc_id") % len(cases) == v, F.expr(row[k])).otherwise(out)
        return out

    return docs.select("doc_id", pick(0).alias("dataset_identifier"), pick(1).alias("data_repository"), pick(2).cast("string").alias("dataset_webpage"))


@query(f"WITH {D} {LISTED_SQL}")
def resolve_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_citations(_picked(_based(spark, sf_dir), LISTED)).select("doc_id", "dataset_identifier", "data_repository", "dataset_webpage")


EXTENDED = {
    0: ("'10.5281/zenodo.' || n", "'Zenodo'", "NULL"),
    1: ("'https://doi.org/10.1594/PANGAEA.' || n", "'PANGAEA'", "NULL"),
    2: ("'M' || n", "'https://www.ncbi.nlm.nih.gov/nuccore/M' || n", "NULL"),
    3: ("'EMD-' || n", "'EMDB'", "NULL"),
    4: ("'10.7937/tcia.' || n", "'cancerimagingarchive.net'", "NULL"),
}


@query(
    f"""WITH {D}, e AS (SELECT *, CAST(doc_id % 5 AS INTEGER) AS v FROM d WHERE NOT (doc_id % 5 = 2 AND length(n) < 2)), i AS (SELECT doc_id, v, CASE v WHEN 0 THEN '10.5281/zenodo.' || n WHEN 1 THEN '10.1594/PANGAEA.' || n WHEN 2 THEN 'M' || n WHEN 3 THEN 'EMD-' || n ELSE '10.7937/tcia.' || n END AS i FROM e)
    SELECT doc_id, i AS dataset_identifier, CASE v WHEN 0 THEN 'doi.org/10.5281' WHEN 1 THEN 'doi.org/10.1594' WHEN 2 THEN 'www.ncbi.nlm.nih.gov' WHEN 3 THEN 'emdb' ELSE 'cancerimagingarchive.net' END AS data_repository,
      CASE WHEN v = 2 THEN 'https://www.ncbi.nlm.nih.gov/nuccore/' WHEN v = 3 THEN 'https://www.ebi.ac.uk/emdb/' ELSE 'https://doi.org/' END || i AS dataset_webpage FROM i"""
)
def resolve_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _based(spark, sf_dir).filter("not (doc_id % 5 = 2 and length(n) < 2)")
    return resolve.resolve_citations(_picked(docs, EXTENDED), ontology.EXTENDED).select("doc_id", "dataset_identifier", "data_repository", "dataset_webpage")


# --- analytics --------------------------------------------------------------------------------------------------------

CITED_BY = """c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'geo' WHEN 1 THEN 'www.ncbi.nlm.nih.gov' WHEN 2 THEN 'doi.org' WHEN 3 THEN 'n/a' END AS data_repository,
  CASE doc_id % 7 WHEN 0 THEN 'GSE' || doc_id WHEN 1 THEN '10.5281/zenodo.' || doc_id WHEN 2 THEN 'pxd' || doc_id WHEN 3 THEN '10.1/figshare' WHEN 4 THEN 'other' WHEN 5 THEN 'dryad.x' END AS dataset_identifier FROM documents)"""


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = F.expr("CASE doc_id % 5 WHEN 0 THEN 'geo' WHEN 1 THEN 'www.ncbi.nlm.nih.gov' WHEN 2 THEN 'doi.org' WHEN 3 THEN 'n/a' END")
    ident = F.expr("CASE doc_id % 7 WHEN 0 THEN 'GSE' || doc_id WHEN 1 THEN '10.5281/zenodo.' || doc_id WHEN 2 THEN 'pxd' || doc_id WHEN 3 THEN '10.1/figshare' WHEN 4 THEN 'other' WHEN 5 THEN 'dryad.x' END")
    return table(spark, sf_dir, "documents").select("doc_id", repo.alias("data_repository"), ident.alias("dataset_identifier"))


@query(
    f"""WITH {CITED_BY}, l AS (SELECT CASE data_repository WHEN 'geo' THEN 'geo' WHEN 'www.ncbi.nlm.nih.gov' THEN 'pmc.ncbi.nlm.nih.gov' WHEN 'doi.org' THEN 'doi.org'
      ELSE CASE WHEN dataset_identifier LIKE 'GSE%' THEN 'geo' WHEN dataset_identifier LIKE 'pxd%' THEN 'proteomecentral.proteomexchange.org' ELSE 'Other' END END AS repository FROM c) SELECT repository, count(*) AS n FROM l GROUP BY 1"""
)
def label_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.label_frequencies(_cited(spark, sf_dir))


@query(
    f"""WITH {CITED_BY}, l AS (SELECT CASE data_repository WHEN 'geo' THEN 'geo' WHEN 'www.ncbi.nlm.nih.gov' THEN 'pmc.ncbi.nlm.nih.gov' WHEN 'doi.org' THEN
      CASE WHEN dataset_identifier LIKE '%zenodo%' THEN 'Zenodo' WHEN dataset_identifier LIKE '%figshare%' THEN 'Figshare' WHEN dataset_identifier LIKE '%dryad%' THEN 'Dryad' WHEN dataset_identifier LIKE 'GSE%' THEN 'geo'
      WHEN dataset_identifier LIKE 'pxd%' THEN 'proteomecentral.proteomexchange.org' ELSE 'DOI (unclassified)' END ELSE 'Other/Unknown' END AS repository FROM c) SELECT repository, count(*) AS n FROM l GROUP BY 1"""
)
def disambiguated_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.disambiguated_frequencies(_cited(spark, sf_dir))


@query(f"WITH {CITED_BY} SELECT data_repository, count(*) AS n FROM c GROUP BY 1")
def repository_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.value_counts(_cited(spark, sf_dir), "data_repository", dropna=False)


@query(f"WITH {CITED_BY} SELECT data_repository, dataset_identifier IS NULL AS missing, count(*) AS n FROM c GROUP BY 1, 2")
def pattern_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pattern_sizes(_cited(spark, sf_dir).withColumn("missing", F.col("dataset_identifier").isNull()), ["data_repository", "missing"])


@query("WITH e AS (SELECT DISTINCT o_custkey AS a, -o_orderkey % 97 - 1 AS b FROM orders), g AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), n AS (SELECT x, count(*) AS d FROM g GROUP BY 1) SELECT count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, round(avg(d), 6) AS average_degree FROM n")
def average_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("bigint").alias("a"), F.expr("cast(-o_orderkey % 97 - 1 as bigint)").alias("b"))
    return analytics.average_degree(edges).select("nodes", "edges", F.round("average_degree", 6).alias("average_degree"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE (r - 1) % 10 = 0")
def strided_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = analytics.strided(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10)
    ranked = chosen.groupBy().agg(F.sort_array(F.collect_list("doc_id")).alias("l"))
    return ranked.select(F.posexplode("l").alias("p", "doc_id")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("place"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents WHERE lang = 'de' AND source IS NOT NULL GROUP BY 1 UNION ALL SELECT source, min(doc_id) FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (lang = 'de') = 0")
def preferred_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source is not null").select("source", "doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return analytics.preferred(docs, ["source"], "lang", "de", ["doc_id"]).select("source", "doc_id")


@query("SELECT p_partkey, p_type FROM part WHERE lower(trim(p_type)) NOT IN ('pending', 'promo burnished tin', 'small plated steel')")
def without_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.without_values(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", ("pending", "promo burnished tin", "small plated steel"))


@query(
    """SELECT 'T' || c_custkey AS title, 'https://p.org/' || c_custkey || '/' || i AS publication_url, CASE WHEN c_custkey % 3 > 0 THEN 'A' || l END AS accession, CASE WHEN c_custkey % 3 > 0 THEN 'https://d.org/' || l END AS data_url
    FROM customer CROSS JOIN range(1, 3) AS p(i) CROSS JOIN range(1, 4) AS q(l) WHERE l <= greatest(c_custkey % 3, 1)"""
)
def unnested_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    pub = F.transform(F.array(F.lit(1), F.lit(2)), lambda i: F.struct(F.concat(F.lit("https://p.org/"), F.col("c_custkey").cast("string"), F.lit("/"), i.cast("string")).alias("url")))
    loc = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda i: i <= F.col("c_custkey") % 3), lambda i: F.struct(F.concat(F.lit("A"), i.cast("string")).alias("accession_number"), F.concat(F.lit("https://d.org/"), i.cast("string")).alias("data_access_url")))
    catalog = table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("title"), pub.alias("publications"), loc.alias("data_locations"))
    return analytics.unnested_catalog(catalog)


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS id, '10.5061/dryad.' || c_custkey AS doi, 'Set ' || c_custkey AS title, 'Ada Lo' || c_custkey || '; Bo' AS authors, CAST(2 AS INTEGER) AS n_authors, 'a; b' AS keywords, 'NSF (' || c_custkey || '); DFG' AS funders, CAST(c_custkey % 9 AS BIGINT) AS views, CAST(0 AS INTEGER) AS n_locations FROM customer"""
)
def flattened_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey").cast("string")
    template = '{"id":{n},"identifier":"doi:10.5061/dryad.{n}","title":"Set {n}","authors":[{"firstName":"Ada","lastName":"Lo{n}"},{"lastName":"Bo"}],"keywords":["a","b",""],"funders":[{"organization":"NSF","awardNumber":"{n}"},{"organization":"DFG","awardNumber":""}],"metrics":{"views":{v}}}'
    record = extraction.render(template, n=n, v=(F.col("c_custkey") % 9).cast("string"))
    wide = analytics.flattened_catalog(table(spark, sf_dir, "customer").select(record.alias("record")))
    return wide.select("id", "doi", "title", "authors", "n_authors", "keywords", "funders", "views", "n_locations")


WORDS_OF = r"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query(
    rf"""WITH t AS (SELECT conv_id, turn, {WORDS_OF.format(c="coalesce(text, '')")} AS p, {WORDS_OF.format(c="coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS q FROM conversations),
    s AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(q, lambda x: x = w))))) AS shared FROM t)
    SELECT conv_id, turn, round(CASE WHEN len(p) + len(q) > 0 THEN 2.0 * coalesce(shared, 0) / (len(p) + len(q)) ELSE 0.0 END, 6) AS rouge_1 FROM s"""
)
def rouge_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return analytics.rouge_n(turns, "text", "before").select("conv_id", "turn", F.round("rouge_1", 6).alias("rouge_1"))


@query("SELECT conv_id, turn, CAST(1 AS DOUBLE) AS rouge_l, CAST(1 AS DOUBLE) AS rouge_2 FROM conversations WHERE len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) > 1".replace("\\\\", "\\"))
def rouge_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter(F.size(analytics._tokens(F.col("text"))) > 1).select("conv_id", "turn", F.col("text").alias("a"), F.concat(F.lit("! "), "text", F.lit(" ?")).alias("b"))
    return analytics.rouge_l(analytics.rouge_n(turns, "a", "b", 2), "a", "b").select("conv_id", "turn", "rouge_l", "rouge_2")


@query("""SELECT doc_id, '{"datasets":[{"dataset_identifier":"GSE' || doc_id || '"},{"dataset_identifier":"x"}]}' AS answer FROM documents""")
def answers_without_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    template = '{"datasets":[{"dataset_webpage":"https://a.org/\\"q\\"{n}","dataset_identifier":"GSE{n}"},{"dataset_identifier":"x","dataset_webpage":null}]}'
    return table(spark, sf_dir, "documents").select("doc_id", analytics.without_field(extraction.render(template, n=n)).alias("answer"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '10.1/' || o_custkey END AS doi FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_custkey % 2 = 1")
def converted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit(" pmc"), F.col("o_custkey").cast("string"))).alias("pmcid"))
    records = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("PMC"), F.col("c_custkey").cast("string")).alias("pmcid"), F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string")).alias("doi"), F.lit(None).cast("string").alias("pmid"))
    return analytics.converted_ids(orders, records.unionByName(records), "pmcid", "doi").select("o_orderkey", "doi")


@query("SELECT count(DISTINCT c_custkey) AS ids, true AS bounded, true AS all_asked FROM customer")
def conversion_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = analytics.conversion_requests(table(spark, sf_dir, "customer"), "c_custkey")
    per = asked.select(F.size(F.split(F.regexp_extract("url", "ids=(.*)$", 1), ",")).alias("k"))
    return per.agg(F.sum("k").cast("bigint").alias("ids"), (F.max("k") <= 100).alias("bounded"), (F.min("k") > 0).alias("all_asked"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || (page_id + 10000) WHEN 1 THEN 'https://doi.org/10.1/' || page_id WHEN 2 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || page_id ELSE url END AS target FROM pages"""
)
def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 4 < 3, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), n)).otherwise(F.col("url"))
    link = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<a class="x" data-ga-action="PMCID"> PMC'), (F.col("page_id") + 10000).cast("string"), F.lit("</a>"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit('<a data-ga-action="DOI">10.1/'), n, F.lit("</a>"))).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", analytics.redirect_target(url, F.concat("html", link)).alias("target"))


@query(f"WITH {CITED_BY} SELECT doc_id, CASE data_repository WHEN 'geo' THEN 'Gene Expression Omnibus' ELSE data_repository END AS name FROM c")
def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("doc_id", analytics.repository_name(F.col("data_repository")).alias("name"))


@query(f"WITH {CITED_BY}, p AS (SELECT doc_id, 'data_repository' AS field, data_repository AS value FROM c UNION ALL SELECT doc_id, 'dataset_identifier', dataset_identifier FROM c) SELECT * FROM p WHERE value IS NOT NULL AND value <> 'n/a'")
def preview_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.preview(_cited(spark, sf_dir), "doc_id")


@query(f"WITH {CITED_BY} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https://a.org/' || doc_id WHEN data_repository = 'geo' AND dataset_identifier IS NOT NULL THEN '{GEO}' || dataset_identifier ELSE 'n/a' END AS dataset_webpage, CASE data_repository WHEN 'geo' THEN 'Complex download' END AS access_mode FROM c")
def pages_for_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _cited(spark, sf_dir).withColumn("dataset_webpage", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://a.org/"), F.col("doc_id").cast("string"))).otherwise("n/a"))
    return analytics.pages_for_missing(cited).select("doc_id", "dataset_webpage", "access_mode")


@query(f"WITH {D} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'HTTPS://massive.ucsd.edu/ProteoSAFe/dataset.jsp?accession=MSV' || n END AS page FROM d")
def known_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("HTTPS://massive.ucsd.edu/ProteoSAFe/dataset.jsp?accession=MSV"), "n")).otherwise(F.concat(F.lit("https://else.org/"), "n"))
    return _based(spark, sf_dir).select("doc_id", analytics.known_page(url).alias("page"))


@query(
    r"""WITH p AS (SELECT DISTINCT url, html FROM pages WHERE list_has_any(list_filter(string_split(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*', '')), '/'), lambda s: s <> ''), ['en', 'fr']))
    SELECT DISTINCT url, 'PMC77777' AS publication FROM p"""
)
def publication_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = table(spark, sf_dir, "pages")
    known = site.select("url", F.lit("see PMC77777.").alias("html"))
    return analytics.publication_corpus(site, "https://example.com/home", ("en", "fr"), known)


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS found, round(count(*) FILTER (quality = 1) / count(*), 6) AS recall FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def total_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("dataset_id"), (F.col("quality") == 1).alias("hit"), "toxic")
    return analytics.total_recall(labels.select("dataset_id", "hit"), labels.filter("toxic = 1")).select("n", "found", F.round("recall", 6).alias("recall"))


# --- pages of print ---------------------------------------------------------------------------------------------------

PRINT = "'Before' || chr(10) || 'Introduction' || chr(10) || {w} || chr(10) || '2. Data Availability' || chr(10) || 'GSE' || {n} || chr(10) || 'References' || chr(10) || '[1] First ' || {n} || chr(10) || '[2] Second'"


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [F.lit("Before"), F.lit("Introduction"), F.col("w"), F.lit("2. Data Availability"), F.concat(F.lit("GSE"), "n"), F.lit("References"), F.concat(F.lit("[1] First "), "n"), F.lit("[2] Second")]
    return _based(spark, sf_dir).select("key", F.array_join(F.array(*lines), "\n").alias("text"))


@query(
    f"""WITH {D} SELECT key, CAST(0 AS INTEGER) AS sec_idx, '' AS section_title, 'Before' AS text FROM d UNION ALL SELECT key, 1, 'Introduction', w FROM d UNION ALL SELECT key, 2, '2. Data Availability', 'GSE' || n FROM d
    UNION ALL SELECT key, 3, 'References', '[1] First ' || n || chr(10) || '[2] Second' FROM d"""
)
def pdf_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.pdf_sections(_printed(spark, sf_dir))


@query(f"WITH {D} SELECT key, CAST(0 AS INTEGER) AS ref_idx, '[1] First ' || n AS text FROM d UNION ALL SELECT key, 1, '[2] Second' FROM d")
def pdf_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.pdf_references(_printed(spark, sf_dir))


@query(f"WITH {D} SELECT key, md5(w || chr(10) || 'NewPage' || chr(10) || 'fin ' || n) AS digest FROM d")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _based(spark, sf_dir)
    printed = docs.select("key", F.lit(2).alias("page"), F.concat(F.lit("ﬁn "), "n").alias("text")).unionByName(docs.select("key", F.lit(1).alias("page"), F.col("w").alias("text")))
    return markup.pdf_text(printed).select("key", F.md5("text").alias("digest"))


# --- what was never run -----------------------------------------------------------------------------------------------


@query(f"WITH {CITED_BY} SELECT min(doc_id) AS doc_id, dataset_identifier, CAST(NULL AS VARCHAR) AS download_link FROM c GROUP BY dataset_identifier")
def dedup_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _cited(spark, sf_dir).withColumn("download_link", F.lit(None).cast("string"))
    return tables.dedup_citations(cited, ["doc_id"]).select("doc_id", "dataset_identifier", "download_link")


@query(f"WITH {CITED_BY} SELECT 'availability' AS part, count(*) AS n FROM c WHERE data_repository IS NOT NULL UNION ALL SELECT 'supplement', count(*) FROM c WHERE doc_id % 3 = 0")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, named = tables.split_by_kind(_cited(spark, sf_dir).withColumn("file_extension", F.when(F.col("doc_id") % 3 == 0, "xlsx")))
    return files.agg(F.count("*").alias("n")).select(F.lit("supplement").alias("part"), "n").unionByName(named.agg(F.count("*").alias("n")).select(F.lit("availability").alias("part"), "n"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 > 0")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return tables.id_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), mapping, "o_custkey")[0].select("o_orderkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)")
def id_lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return tables.id_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), mapping, "o_custkey")[1].select("o_orderkey")


@query("SELECT 'nothing' AS column_name")
def empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.empty_columns(table(spark, sf_dir, "nation").withColumn("nothing", F.lit(None).cast("string")))


@query("SELECT o_orderstatus AS kind, count(*) AS n, CAST(min(o_orderkey) AS VARCHAR) AS least FROM orders GROUP BY 1")
def format_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("url"))
    return tables.format_frequencies(orders, "kind", "url").select("kind", "n", F.regexp_replace(F.get("urls", F.lit(0)), "^0+(?=.)", "").alias("least"))


@query(f"WITH {CITED_BY} SELECT 'rows' AS what, NULL AS value, count(*) AS n FROM c UNION ALL SELECT 'data_repository', data_repository, count(*) FROM c WHERE data_repository IS NOT NULL GROUP BY 2")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.result_summary(_cited(spark, sf_dir))


@query("WITH t AS (SELECT doc_id, CAST(doc_id % 3 > 0 AS INTEGER) + CAST(doc_id % 2 > 0 AS INTEGER) AS k FROM documents) SELECT round(avg(k / 2.0), 6) AS coverage FROM t")
def input_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    content = F.concat(F.lit("has "), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("GSE"), n, F.lit(";"))).otherwise(""), F.when(F.col("doc_id") % 2 > 0, F.concat(F.lit("pxd"), n)).otherwise(""))
    prompts = table(spark, sf_dir, "documents").select(F.array(F.concat(F.lit("gse"), n, F.lit(";")), F.concat(F.lit("PXD"), n), F.lit("")).alias("identifiers"), content.alias("content"))
    return tables.input_coverage(prompts).select(F.round("coverage", 6).alias("coverage"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 > 0")
def identifiers_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("GSE"), n, F.lit(", MSV"), n).alias("ids"), F.concat(F.lit("GSE"), n, F.lit(" or "), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("MSV"), n)).otherwise("")).alias("content"))
    return tables.all_identifiers_present(rows, "ids", "content").select("doc_id")


@query("SELECT round(avg(CAST(doc_id % 3 > 0 AS INTEGER)), 6) AS exact_match FROM documents")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("a"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")).otherwise("x").alias("b"))
    return tables.exact_match(rows, "a", "b").select(F.round("exact_match", 6).alias("exact_match"))


@query("SELECT CAST(c_custkey AS BIGINT) AS dataset_id, c_custkey % 4 > 0 AS hit FROM customer")
def catalog_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    customers = table(spark, sf_dir, "customer")
    catalog = customers.select(F.col("c_custkey").cast("bigint").alias("dataset_id"), F.concat(F.lit("https://P.org/"), n).alias("publication"), F.array(F.concat(F.lit("https://d.org/"), n, F.lit("x"))).alias("urls"), F.array(F.concat(F.lit("Title "), n, F.lit("."))).alias("titles"), F.array(F.concat(F.lit("ACC"), n, F.lit("z"))).alias("accessions"))
    found = customers.select(F.concat(F.lit("https://p.org/"), n).alias("source_url"), F.when(k == 1, F.concat(F.lit("acc"), n, F.lit("z"))).alias("dataset_identifier"), F.when(k == 2, F.concat(F.lit("https://d.org/"), n, F.lit("x"))).alias("dataset_webpage"), F.when(k == 3, F.concat(F.lit("a TITLE "), n, F.lit(". b"))).alias("title"))
    return tables.catalog_recall(catalog, found)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def cached_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return tables.cached_append(orders.filter("o_orderkey % 2 = 0"), orders, "o_orderkey")


@query("SELECT custom_id, article FROM (SELECT 'gpt_pmc' || doc_id || '_1' AS custom_id, 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || doc_id AS article FROM documents UNION ALL SELECT 'x' || doc_id, NULL FROM documents)")
def result_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refminer.operators import batch

    n = F.col("doc_id").cast("string")
    named = table(spark, sf_dir, "documents").select(F.explode(F.array(F.concat(F.lit("gpt_pmc"), n, F.lit("_1")), F.concat(F.lit("x"), n))).alias("custom_id"))
    return named.select("custom_id", batch.article_of_result(F.col("custom_id")).alias("article"))


@query(f"WITH {CITED_BY}, v AS (SELECT doc_id, doc_id % 10 AS page FROM c WHERE doc_id % 2 = 0) SELECT 'https://a.org/' || page AS visit_id, min(doc_id) AS doc_id FROM v GROUP BY 1")
def metadata_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    rows = _cited(spark, sf_dir).withColumns({"dataset_webpage": F.when(even, F.concat(F.lit("https://a.org/"), (F.col("doc_id") % 10).cast("string"))).otherwise("n/a"), "download_link": F.lit(None).cast("string"), "file_extension": F.lit("txt"), "source_section": F.lit("methods")})
    return metadata.metadata_candidates(rows, "doc_id").select("visit_id", "doc_id")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'supplementary' WHEN 1 THEN 'dataset' WHEN 2 THEN 'article' ELSE 'other' END AS kind FROM pages")
def link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    link = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/bin/a"), n, F.lit(".XLSX?x"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://zenodo.org/"), n)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://doi.org/10.1/"), n)).otherwise(F.concat(F.lit("https://else.org/"), n))
    return table(spark, sf_dir, "pages").select("page_id", extraction.link_class(link).alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'counted, samples, tissue' || doc_id ELSE 'about' END AS keywords FROM documents")
def supplement_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Counted samples, of the tissue"), F.col("doc_id").cast("string"), F.lit("; COUNTED. "))).alias("context_description"), F.lit("about").alias("description"))
    return extraction.supplement_keywords(rows).select("doc_id", "keywords")


@query("SELECT doc_id, doc_id % 3 = 2 OR doc_id % 3 = 1 AS complete FROM documents")
def complete_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "XML").when(F.col("doc_id") % 3 == 1, "HTML").otherwise("PDF")
    content = F.when(F.col("doc_id") % 3 == 0, "<sec ><p/></sec>").when(F.col("doc_id") % 3 == 1, "<section ></section><SECTION>").otherwise("%PDF")
    return table(spark, sf_dir, "documents").select("doc_id", markup.fulltext_complete(content, kind, 2).alias("complete"))


@query(f"WITH {D} SELECT 'jats' AS kind, count(*) AS n, 0 AS tei FROM d UNION ALL SELECT 'tei', count(*), count(*) FROM d")
def tei_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for kind, docs in (("jats", jats(spark, sf_dir)), ("tei", tei(spark, sf_dir))):
        out.append(docs.agg(F.count("*").alias("n"), F.count_if(markup.is_tei(F.col("content"))).alias("tei")).select(F.lit(kind).alias("kind"), "n", "tei"))
    return out[0].unionByName(out[1])


@query("SELECT page_id, 'https://pubmed.ncbi.nlm.nih.gov/' || page_id AS pubmed, '10.1234/ab' || page_id AS doi, 'PMC' || page_id AS pmc, 'a_b_' || page_id AS sheet, '<p><img tracking/></p>' AS scrubbed FROM pages")
def identifier_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id", ids.pmid_to_url(F.col("page_id")).alias("pubmed"), ids.url_to_doi(F.concat(F.lit("https://doi.org/10.1234/AB"), n)).alias("doi"), ids.pmc_id(F.concat(F.lit("x/PMC"), n, F.lit("/y"))).alias("pmc"),
        ids.sheet_name(F.concat(F.lit("a/b?"), n)).alias("sheet"), ids.scrub_tracking_images(F.concat(F.lit('<p><img src="https://s.org/stat?'), n, F.lit('" /></p>'))).alias("scrubbed"),
    )


@query(f"WITH {D} SELECT key, 'See this file. Again this file here.' AS found FROM d")
def referring_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Start. See [rid=S1]. Nothing. Again [rid=S1] here. "), F.upper("w"))
    return _based(spark, sf_dir).select("key", tx.sentences_with(text, F.lit("S1")).alias("found"))


@query("SELECT page_id, true AS stored FROM pages WHERE page_id % 2 = 0")
def stored_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "pages").select("page_id", F.upper("url").alias("ref"))
    store = table(spark, sf_dir, "pages").filter("page_id % 2 = 0").select(F.concat(F.col("url"), F.lit("#"), F.col("page_id").cast("string")).alias("publication"))
    return references.in_store(refs.withColumn("ref", F.concat("ref", F.lit("#"), F.col("page_id").cast("string"))), store).select("page_id", F.lit(True).alias("stored"))


@query("SELECT file_name, n FROM (SELECT 'f' || page_id AS file_name, page_id AS n FROM pages)")
def extended_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("file_name"), F.col("page_id").alias("n"))
    return references.extend_store(files.filter("n % 2 = 0"), files)


@query("SELECT page_id, 'page_' || page_id || '__t' || '_' || page_id || '.html' AS name FROM pages")
def document_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refminer.sources import sinks

    n = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", sinks.document_file_name(F.concat(F.lit("page/"), n), F.concat(F.lit("t ?"), n), F.lit("HTML")).alias("name"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id END AS answer FROM documents")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refminer.sources import sinks

    prompts = table(spark, sf_dir, "documents").select("doc_id", ids.prompt_id(F.lit("m"), F.lit(0.0), F.col("doc_id").cast("string")).alias("prompt_id"))
    cache = prompts.filter("doc_id % 2 = 0").select("prompt_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("answer"))
    return sinks.cached_answers(prompts, cache).select("doc_id", "answer")


@query(f"WITH {D} SELECT 'https://a.org/' || n AS url, 'page ' || n AS content, CASE doc_id % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'first' ELSE 'second' END AS fetched_by FROM d")
def fetched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://a.org/"), "n")
    docs = _based(spark, sf_dir).select("doc_id", url.alias("url"), F.concat(F.lit("page "), "n").alias("content"))

    def get(wanted: int):  # type: ignore[no-untyped-def]
        return lambda u: (f"page {u.rpartition('/')[2]}", "HTML") if int(u.rpartition("/")[2]) % 3 == wanted else None

    store = docs.filter("doc_id % 3 = 0").select(F.col("url").alias("publication"), "content", F.lit("HTML").alias("format"))
    return references.fetch(docs.select("url"), [("first", get(1)), ("second", get(2))], store).select("url", "content", "fetched_by")


FITS = "(length(cur) + length(l[i + 1]) + 1) // 4 <= 256"


@query(
    rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, regexp_replace(t, '([.!?])[ \t\n\x0B\f\r]+([A-Z])', '\1' || chr(1) || '\2', 'g') AS t FROM d),
    a AS (SELECT doc_id, regexp_replace(t, '((?:^|[ \t\n\x0B\f\r]|' || chr(1) || ')(?:e\.g|i\.e|Fig|Figs|et al|vs|Dr|Prof|cf|no|approx)\.)' || chr(1), '\1 ', 'g') AS t FROM m),
    s AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(t, chr(1)) AS l FROM a),
    p AS (SELECT r, doc_id, CAST(1 AS BIGINT) AS i, l[1] AS cur, CAST(0 AS INTEGER) AS chunk, CAST(NULL AS VARCHAR) AS done FROM s
      UNION ALL SELECT p.r, p.doc_id, i + 1, CASE WHEN {FITS} THEN cur || ' ' || l[i + 1] ELSE l[i + 1] END, CASE WHEN {FITS} THEN chunk ELSE chunk + 1 END, CASE WHEN {FITS} THEN NULL ELSE cur END FROM p JOIN s ON p.r = s.r WHERE i < len(l)),
    o AS (SELECT doc_id, chunk - 1 AS chunk, done AS t FROM p WHERE done IS NOT NULL UNION ALL SELECT p.doc_id, chunk, cur FROM p JOIN s ON p.r = s.r WHERE i = len(l))
    SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(length(t) AS INTEGER) AS n_chars FROM o"""
)
def packed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = tx.packed(tx.sentences(F.coalesce("text", F.lit(""))), 256)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(packed)).select("doc_id", F.col("pos").alias("chunk"), F.length("col").alias("n_chars"))


@query(f"WITH {D} SELECT key, 0 AS c, md5(w) AS digest, length(w) // 4 > 100 AS long FROM d".replace("0 AS c, ", ""))
def prompts_that_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _based(spark, sf_dir).select("key", F.col("w").alias("content"))
    parts = extraction.fit_to_context(chunks, 100)
    # the stretches overlap by 100 characters: without these they make the whole text again
    return chunks.join(parts.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", F.md5("content").alias("digest"), (F.col("n") > 1).alias("long"))


@query(f"WITH {D} SELECT key, 'List GSE' || n || ' of {{x}} ' || md5(w) AS prompt FROM d")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _based(spark, sf_dir).select("key", extraction.render("List {id} of {x} {hash}", id=F.concat(F.lit("GSE"), "n"), hash=F.md5("w")).alias("prompt"))


@query("SELECT repo, repo_name FROM (VALUES ('geo', 'Gene Expression Omnibus'), ('pdb', 'Protein Data Bank')) AS t(repo, repo_name)")
def ontology_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.dimension(spark).filter(F.col("repo").isin("geo", "pdb")).select("repo", "repo_name")


@query(f"WITH {D} SELECT key, CAST(rank AS INTEGER) AS rank FROM d CROSS JOIN range(1, 4) AS r(rank)")
def top_article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pipeline.chunks_of(markup.sections(jats(spark, sf_dir)), 100_000)
    asked = retrieval.embed(spark.createDataFrame([("data deposited under accession",)], "text string")).first()["embedding"]
    return retrieval.top_chunks(retrieval.embed(chunks), list(asked), 3).select("key", "rank")


# --- descriptions -----------------------------------------------------------------------------------------------------


def _title_answers(prompts: list[str]) -> list[str | None]:
    """An extractor by rules: the first heading it can see, and no license."""
    import json
    import re

    out: list[str | None] = []
    for p in prompts:
        found = re.search(r"Heading (\w+)", p)
        out.append(json.dumps({"title": found.group(0), "license": "other"}) if found else None)
    return out


@query(f"WITH {D} SELECT key, 'Set ' || n AS name, 'CC0' AS license, 'Heading ' || n AS title FROM d")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = describe.page_metadata(pages(spark, sf_dir), _title_answers)
    return found.select("key", *[F.try_element_at("metadata", F.lit(c)).alias(c) for c in ("name", "license", "title")])


@query(f"WITH {D} SELECT key, 'GSE' || n AS dataset_identifier, CASE WHEN doc_id % 2 = 0 THEN 'about GSE' || n END AS description FROM d")
def described_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json
    import re

    def answer(prompts: list[str]) -> list[str | None]:
        return [json.dumps({"description": "about " + m.group(1)}) if (m := re.search(r"dataset (GSE\d*[02468]) ", p)) else "no idea" for p in prompts]

    docs = _based(spark, sf_dir)
    return describe.described_datasets(docs.select("key", F.col("w").alias("text")), docs.select("key", F.concat(F.lit("GSE"), "n").alias("dataset_identifier")), answer)


@query(f"WITH {D} SELECT key, 'Set ' || n AS name, 'Heading of ' || n || 'b' AS title FROM d")
def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json
    import re

    def answer(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            key = re.search(r"Set (\w+)", p)
            more = re.search(r"Heading of \w+", p)
            out.append(json.dumps({"urls": [f"https://a.org/{key.group(1)}/{x}" for x in ("none", "b", "c")]}) if "Which of" in p and key else json.dumps({"title": more.group(0)}) if more else None)
        return out

    docs = _based(spark, sf_dir)
    site = docs.select("key", F.concat(F.lit("https://a.org/"), "n", F.lit("/b")).alias("url"))
    fetch = lambda rows: rows.withColumn("content", F.concat(F.lit("<p>Heading of "), "key", F.lit("b</p>")))
    found = describe.two_hops(pages(spark, sf_dir), site, fetch, answer)
    return found.select("key", *[F.try_element_at("metadata", F.lit(c)).alias(c) for c in ("name", "title")])


@query("SELECT doc_id, CASE WHEN doc_id // 3 % 2 = 0 THEN 'k' || (doc_id % 3 + 1) ELSE 'about ' || doc_id END AS keywords FROM (SELECT DISTINCT doc_id FROM documents) WHERE (doc_id // 3 + 1) * 3 <= (SELECT max(doc_id) + 1 FROM documents)")
def file_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    def answer(prompts: list[str]) -> list[str | None]:
        return [json.dumps(["k1", "k2", "k3"]) if "even" in p else json.dumps(["too few"]) for p in prompts]

    docs = table(spark, sf_dir, "documents").select("doc_id").distinct()
    last = docs.agg(F.max("doc_id")).first()[0]
    third = F.floor(F.col("doc_id") / 3)
    files = docs.filter((third + 1) * 3 <= last + 1).select(
        "doc_id", third.cast("string").alias("source_url"), F.col("doc_id").cast("string").alias("link"), F.when(third % 2 == 0, "even").otherwise("odd").alias("context_description"), F.concat(F.lit("about "), F.col("doc_id").cast("string")).alias("description")
    )
    files = files.withColumn("link", F.lpad("link", 12, "0"))
    return describe.file_keywords(files, answer).select("doc_id", "keywords")


@query(f"WITH {D} SELECT key, md5('<p>' || w || '</p>') AS digest, 'HTML' AS format FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT key, md5('<p> ' || w || ' </p>'), 'PDF' FROM d WHERE doc_id % 2 = 1")
def readable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _based(spark, sf_dir).select("key", F.concat(F.lit("<p> "), "w", F.lit(" </p>")).alias("content"), F.when(F.col("doc_id") % 2 == 0, "HTML").otherwise("PDF").alias("format"))
    return describe.readable(texts).select("key", F.md5("content").alias("digest"), "format")
