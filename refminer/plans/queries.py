"""Queries over the driver's tables, one or more for each group of operators, and the same in SQL.

Every query reads its whole table. The prose of the tables has no accession numbers, so queries that need some append
them to the text by one expression, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refminer.functions import identifiers as ids
from refminer.functions import text as tx
from refminer.operators import batch, extraction, markup, metadata, ontology, resolve, retrieval, tables
from refminer.plans import pipeline
from refminer.sources import references

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- texts with accession numbers -------------------------------------------------------------------------------------

INJECTED = (
    "SELECT doc_id, source, coalesce(text, '') || ' Deposited under GSE' || CAST(doc_id + 1000 AS VARCHAR)"
    " || CASE WHEN doc_id % 2 = 0 THEN ', pxd' || lpad(CAST(doc_id AS VARCHAR), 7, '0') ELSE '' END"
    " || CASE WHEN doc_id % 3 = 0 THEN ', MSV' || CAST(doc_id + 80000 AS VARCHAR) || ' and again GSE' || CAST(doc_id + 1000 AS VARCHAR) ELSE '' END || '.' AS t FROM documents"
)


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.concat(
        F.coalesce("text", F.lit("")),
        F.lit(" Deposited under GSE"),
        (n + 1000).cast("string"),
        F.when(n % 2 == 0, F.concat(F.lit(", pxd"), F.lpad(n.cast("string"), 7, "0"))).otherwise(""),
        F.when(n % 3 == 0, F.concat(F.lit(", MSV"), (n + 80000).cast("string"), F.lit(" and again GSE"), (n + 1000).cast("string"))).otherwise(""),
        F.lit("."),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


MENTIONS = " UNION ALL ".join(f"SELECT doc_id, '{repo}' AS repo, unnest(regexp_extract_all(t, '(?i)({_quoted(p)})', 1)) AS mention FROM d" for repo, p in ontology.search_patterns())
WITH_MENTIONS = f"WITH d AS ({INJECTED}), m AS ({MENTIONS})"


@query(f"{WITH_MENTIONS} SELECT doc_id, repo, mention FROM m")
def identifier_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.identifier_mentions(injected(spark, sf_dir)).select("doc_id", "repo", "mention")


@query(f"{WITH_MENTIONS} SELECT repo, count(*) AS n, count(DISTINCT doc_id) AS docs FROM m GROUP BY repo")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.identifier_mentions(injected(spark, sf_dir)).groupBy("repo").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"{WITH_MENTIONS} SELECT DISTINCT doc_id, repo, upper(mention) AS mention FROM m")
def mention_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.identifier_mentions(injected(spark, sf_dir)).select("doc_id", "repo", F.upper("mention").alias("mention")).distinct()


@query(
    f"""{WITH_MENTIONS}, s AS (SELECT repo, count(*) AS support FROM m GROUP BY repo), u AS (SELECT DISTINCT doc_id, repo FROM m),
    p AS (SELECT a.repo AS repo_a, b.repo AS repo_b, count(*) AS pair_count FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.repo < b.repo GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT repo_a, repo_b, pair_count, x.support AS support_a, y.support AS support_b, round(pair_count / x.support, 6) AS confidence_ab, round(pair_count / y.support, 6) AS confidence_ba,
      round(pair_count * (SELECT count(DISTINCT doc_id) FROM m) / (x.support * y.support), 6) AS lift
    FROM p JOIN s x ON x.repo = repo_a JOIN s y ON y.repo = repo_b"""
)
def repository_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = retrieval.identifier_mentions(injected(spark, sf_dir)).select(F.col("doc_id").alias("paper"), "repo")
    out = tables.cooccurrence(papers)
    return out.select("repo_a", "repo_b", "pair_count", "support_a", "support_b", *[F.round(c, 6).alias(c) for c in ("confidence_ab", "confidence_ba", "lift")])


@query(
    f"""{WITH_MENTIONS}, u AS (SELECT DISTINCT doc_id, repo FROM m), e AS (SELECT DISTINCT a.repo AS a, b.repo AS b FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.repo <> b.repo),
    n AS (SELECT a AS node, count(*) AS degree FROM e GROUP BY 1) SELECT node, degree, CASE WHEN (SELECT count(*) FROM n) > 1 THEN round(degree / ((SELECT count(*) FROM n) - 1), 6) ELSE 0.0 END AS centrality FROM n"""
)
def repository_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = retrieval.identifier_mentions(injected(spark, sf_dir)).select(F.col("doc_id").alias("paper"), "repo")
    edges = tables.cooccurrence(papers, min_support=1).select(F.col("repo_a").alias("a"), F.col("repo_b").alias("b"))
    return tables.degrees(edges).select("node", "degree", F.round("centrality", 6).alias("centrality"))


# --- resolution of citations ------------------------------------------------------------------------------------------

CITED = {
    0: ("'GSE' || CAST(doc_id AS VARCHAR)", "'Gene Expression Omnibus (GEO)'", None),
    1: ("'PXD' || lpad(CAST(doc_id AS VARCHAR), 7, '0')", "'PRIDE'", None),
    2: ("'phs' || lpad(CAST(doc_id AS VARCHAR), 6, '0')", "'dbGaP'", None),
    3: ("'n/a'", "'somewhere'", None),
    4: ("'OP191201-OP191207'", "'nuccore'", None),
    5: ("'MSV' || CAST(doc_id AS VARCHAR)", "'example repository'", None),
    6: ("'https://doi.org/10.5281/zenodo.' || CAST(doc_id AS VARCHAR)", "'zenodo'", None),
    7: ("'n/a'", "'n/a'", "'https://ega-archive.org/studies/EGAS0' || CAST(doc_id AS VARCHAR)"),
}
RESOLVED = {
    0: ("'GSE' || doc_id", "'geo'", "'https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSE' || doc_id", "'Complex download'"),
    1: ("'PXD' || lpad(CAST(doc_id AS VARCHAR), 7, '0')", "'www.ebi.ac.uk'", "'https://www.ebi.ac.uk/pride/archive/projects/PXD' || lpad(CAST(doc_id AS VARCHAR), 7, '0')", "'Complex download'"),
    2: ("'phs' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.v1.p1'", "'dbgap'", "'https://www.ncbi.nlm.nih.gov/projects/gap/cgi-bin/study.cgi?study_id=phs' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.v1.p1'", "'Application to access'"),
    4: ("'OP19120' || k", "'nuccore'", "'https://www.ncbi.nlm.nih.gov/nuccore/OP19120' || k", "NULL"),
    5: ("'MSV' || doc_id", "'massive.ucsd.edu'", "'https://massive.ucsd.edu/ProteoSAFe/dataset.jsp?accession=MSV' || doc_id", "'Complex download'"),
    6: ("'10.5281/zenodo.' || doc_id", "'zenodo.org'", "'https://zenodo.org/10.5281/zenodo.' || doc_id", "NULL"),
    7: ("'EGAS0' || doc_id", "'ega-archive.org'", "'https://ega-archive.org/studies/EGAS0' || doc_id", "'Contact to access'"),
}


@query(
    " UNION ALL ".join(
        f"SELECT doc_id, {i} AS dataset_identifier, {r} AS data_repository, {p} AS dataset_webpage, {m} AS access_mode FROM documents{' CROSS JOIN range(1, 8) AS r(k)' if v == 4 else ''} WHERE doc_id % 8 = {v}"
        for v, (i, r, p, m) in RESOLVED.items()
    )
)
def resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spell = lambda s: F.expr(s.replace("VARCHAR", "STRING")) if s else F.lit(None).cast("string")

    def pick(k: int) -> Column:
        out = F.lit(None).cast("string")
        for v, row in CITED.items():
            out = F.when(F.col("doc_id") % 8 == v, spell(row[k])).otherwise(out)
        return out

    docs = table(spark, sf_dir, "documents").select("doc_id", pick(0).alias("dataset_identifier"), pick(1).alias("data_repository"), pick(2).alias("dataset_webpage"))
    return resolve.resolve_citations(docs).select("doc_id", "dataset_identifier", "data_repository", "dataset_webpage", "access_mode")


@query("SELECT doc_id, 'AB' || CAST(100 + k AS VARCHAR) AS dataset_identifier FROM documents CROSS JOIN range(0, 10) AS r(k) WHERE k <= doc_id % 10")
def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.concat(F.lit("AB100-AB"), (F.lit(100) + F.col("doc_id") % 10).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(resolve.identifier_range(last)).alias("dataset_identifier"))


# --- URLs and pages ---------------------------------------------------------------------------------------------------

HOST = r"nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)', 1), '')"


@query(
    rf"""WITH u AS (SELECT page_id, url, {HOST} AS host FROM pages), l AS (SELECT *, string_split(host, '.') AS labels FROM u)
    SELECT page_id, coalesce(host, 'Unknown Publisher') AS root, coalesce(CASE WHEN len(labels) > 2 THEN labels[2] ELSE labels[1] END, 'Unknown Publisher') AS domain,
      regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*', ''), '([^/]*)$', 1) AS file_name,
      regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9]', '_', 'g'), '_$', '') AS page_name,
      CASE WHEN contains(string_split(url, '.')[-1], '/') THEN '' ELSE string_split(url, '.')[-1] END AS extension,
      list_filter(list_reverse(string_split(url, '/')), lambda s: length(s) >= 6)[1] AS article, regexp_replace(host, '^www\.', '') AS link_domain FROM l"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", ids.publisher_root(url).alias("root"), ids.publisher_domain(url).alias("domain"), ids.url_file_name(url).alias("file_name"), ids.page_id(url).alias("page_name"),
        ids.file_extension(url).alias("extension"), ids.article_id(url).alias("article"), ids.domain_of_href(url).alias("link_domain"),
    )


REFERENCE = "CASE page_id % 5 WHEN 0 THEN ' pmc' || (page_id + 100000) WHEN 1 THEN url WHEN 2 THEN '10.1234/x.' || page_id WHEN 3 THEN 'https://arxiv.org/pdf/' || page_id ELSE 'local/file' || page_id || '.xml' END"


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pmcid' WHEN 2 THEN 'doi' WHEN 4 THEN 'path' ELSE 'url' END AS kind,
      CASE page_id % 5 WHEN 0 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || (page_id + 100000) WHEN 1 THEN url WHEN 2 THEN 'https://doi.org/10.1234/x.' || page_id WHEN 3 THEN 'https://arxiv.org/pdf/' || page_id END AS target,
      CASE page_id % 5 WHEN 0 THEN 'api' WHEN 3 THEN 'pdf' WHEN 4 THEN NULL ELSE CASE WHEN regexp_matches(lower(url), '\\.pdf$') AND page_id % 5 = 1 THEN 'pdf' ELSE 'http' END END AS strategy,
      CASE page_id % 5 WHEN 0 THEN 'PMC' || (page_id + 100000) WHEN 2 THEN '10.1234/x.' || page_id END AS known_id FROM pages""".replace("\\\\", "\\")
)
def input_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "pages").select("page_id", F.expr(REFERENCE).alias("ref"))
    out = references.normalise(refs)
    return out.select("page_id", "kind", F.col("url").alias("target"), F.col("fetch_strategy").alias("strategy"), ids.article_id(F.col("url"), only_known=True).alias("known_id"))


@query("SELECT page_id, trim(coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*class=\"[^\"]*article-title[^\"]*\"[^>]*>(.*?)</h1>', 1), ''), nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), 'No title found')) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.html_title(F.col("html")).alias("title"))


HREFS = r"""regexp_extract_all(html, 'href=["'']([^"'']+)', 1)"""


@query(f"SELECT page_id, unnest({HREFS}) AS href FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(ids.hrefs(F.col("html"))).alias("href"))


@query(f"WITH h AS (SELECT unnest({HREFS}) AS href FROM pages), e AS (SELECT CASE WHEN contains(string_split(href, '.')[-1], '/') THEN '' ELSE string_split(href, '.')[-1] END AS extension FROM h) SELECT extension, count(*) AS n FROM e GROUP BY extension")
def link_extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select(F.explode(ids.hrefs(F.col("html"))).alias("href"))
    return tables.value_counts(links.select(ids.file_extension(F.col("href")).alias("extension")), "extension")


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS plain FROM pages"""
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.strip_html(F.col("html")).alias("plain"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?i)<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '(?i)<section[ >]')) AS sections FROM pages")
def page_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("(?i)<p[ >]")).cast("bigint").alias("paragraphs"), markup.section_count(F.col("html"), "HTML").alias("sections"))


KEYWORDS = ("en", "de", "articles", "publications")


@query(
    rf"""WITH p AS (SELECT page_id, url, list_filter(string_split(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*', '')), '/'), lambda s: s <> '') AS segments FROM pages)
    SELECT page_id FROM p WHERE list_has_any(segments, ['{"', '".join(KEYWORDS)}'])"""
)
def publication_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(references.is_publication_url(F.col("url"), "https://example.com/home", KEYWORDS)).select("page_id")


@query(
    r"""WITH t AS (SELECT page_id, html || ' doi 10.1234/ab.' || page_id || '). PMC' || (page_id + 1000) || ' ' AS h FROM pages),
    f AS (SELECT page_id, unnest(list_concat(regexp_extract_all(h, '10\.\d{4,9}/[^ \t\n\x0B\f\r"''<>]+'), regexp_extract_all(h, 'PMC\d{4,}'), regexp_extract_all(h, 'pubmed\.ncbi\.nlm\.nih\.gov/(?:\d+)'), regexp_extract_all(h, 'arxiv\.org/abs/[0-9.v]+'))) AS i FROM t)
    SELECT DISTINCT page_id, regexp_replace(i, '[.,;)]+$', '') AS publication FROM f"""
)
def page_publication_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    html = F.concat("html", F.lit(" doi 10.1234/ab."), n.cast("string"), F.lit("). PMC"), (n + 1000).cast("string"), F.lit(" "))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(ids.publication_ids(html)).alias("publication"))


@query(r"SELECT page_id, regexp_matches(html, '(?i)href=[\"''][^\"'']*(login|signin|sign-in)') OR regexp_matches(html, '(?i)(please|must) (log|sign) ?in') OR length(trim(html)) < 500 AS login_required FROM pages".replace('\\"', '"'))
def login_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", references.login_required(F.col("html")).alias("login_required"))


# --- chunks and words -------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?][ \t\n\x0B\f\r]+[A-Z]')) + 1 - len(regexp_extract_all(text, '(?:^|[ \t\n\x0B\f\r])(?:e\.g|i\.e|Fig|Figs|et al|vs|Dr|Prof|cf|no|approx)\.[ \t\n\x0B\f\r]+[A-Z]')) AS INTEGER) AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("sentences"))


@query("WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 900)) AS s FROM documents) SELECT doc_id, CAST(s // 900 + 1 AS INTEGER) AS chunk_id, CAST(s AS INTEGER) AS start, md5(substring(text, s + 1, 1000)) AS digest FROM s")
def character_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.inline(tx.character_chunks(F.col("text"), 1000, 100)))
    return chunks.select("doc_id", "chunk_id", "start", F.md5("text").alias("digest"))


CLEAN = r"list_filter(list_transform(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: regexp_replace(w, '[^a-z0-9_\-]', '', 'g')), lambda w: w <> '')"


@query(f"WITH w AS (SELECT unnest({CLEAN}) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.word_frequencies(table(spark, sf_dir, "documents"), "text")


@query(f"WITH w AS (SELECT lang = 'en' AS e, unnest({CLEAN}) AS word FROM documents WHERE lang IS NOT NULL) SELECT word, CAST(count(*) FILTER (e) - count(*) FILTER (NOT e) AS BIGINT) AS difference FROM w GROUP BY word HAVING difference <> 0")
def word_frequency_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tables.word_frequency_difference(tables.word_frequencies(docs.filter("lang = 'en'"), "text"), tables.word_frequencies(docs.filter("lang <> 'en'"), "text"))


@query("WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc_id FROM documents) SELECT doc_id, first_doc_id FROM f WHERE doc_id > first_doc_id")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.duplicate_index(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", F.col("first_order").alias("first_doc_id"))


@query(
    r"""WITH c AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, l FROM c), r AS (SELECT doc_id, pos, l[pos] AS line, 'part ' || ((pos - 1) // 5) AS title FROM e),
    f AS (SELECT doc_id, lower(trim(line)) AS k, title, min(pos) AS p FROM r GROUP BY 1, 2, 3)
    SELECT doc_id, CAST(min(p) - 1 AS INTEGER) AS pos, md5(k) AS digest, string_agg(title, ' | ' ORDER BY p) AS section_title FROM f GROUP BY doc_id, k"""
)
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    titled = lines.withColumn("section_title", F.concat(F.lit("part "), F.floor(F.col("pos") / 5).cast("string")))
    return tables.merge_equal_chunks(titled, "doc_id", "pos").select("doc_id", "pos", F.md5(F.lower(F.trim("text"))).alias("digest"), "section_title")


@query("SELECT conv_id, turn, role FROM conversations WHERE text IS NULL OR contains(lower(text), 'n/a') OR contains(lower(text), 'not applicable') OR contains(lower(text), 'no dataset') OR contains(lower(text), 'none')")
def no_dataset_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(extraction.is_no_dataset(F.col("text"))).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS tokens, length(text) // 4 + 600 > 126000 AS over FROM conversations".replace("sum(length(text) // 4)", "CAST(sum(length(text) // 4)").replace("ORDER BY turn)", "ORDER BY turn) AS BIGINT)"))
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    text = F.col("text")
    total = F.sum(tx.token_estimate(text)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", total.alias("tokens"), tx.over_token_limit(text, F.lit("gpt")).alias("over"))


# --- vectors ----------------------------------------------------------------------------------------------------------

DISTANCES = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS ql, b.label AS l, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e a CROSS JOIN e b), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s QUALIFY rank <= {k})"


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(vectors, vectors.select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query(DISTANCES.format(k=5) + " SELECT query_id, vec_id, rank, round(d, 4) AS distance FROM h")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 5).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 4).alias("distance"))


@query(
    DISTANCES.format(k=9) + ", n AS (SELECT label, count(*) AS n FROM e GROUP BY label), q AS (SELECT query_id, ql, k, count(*) FILTER (ql = l AND rank <= k) / any_value(n.n) AS share FROM h JOIN n ON n.label = ql CROSS JOIN (VALUES (1), (3), (5), (9)) AS ks(k) GROUP BY ALL) SELECT k, round(avg(share), 6) AS recall FROM q GROUP BY k"
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.label_recall(_hits(spark, sf_dir, 9), table(spark, sf_dir, "embeddings"), (1, 3, 5, 9)).groupBy("k").agg(F.round(F.avg("share"), 6).alias("recall"))


@query(
    DISTANCES.format(k=9) + ", n AS (SELECT label, count(*) AS n FROM e GROUP BY label), q AS (SELECT query_id, ql, k, count(*) FILTER (ql = l AND rank <= k) / any_value(n.n) AS share FROM h JOIN n ON n.label = ql CROSS JOIN (VALUES (1), (3), (5), (9)) AS ks(k) GROUP BY ALL), r AS (SELECT ql AS query, k, round(avg(share), 6) AS recall FROM q GROUP BY ALL) SELECT query, k, recall FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY recall DESC, k) = 1"
)
def best_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = retrieval.label_recall(_hits(spark, sf_dir, 9), table(spark, sf_dir, "embeddings"), (1, 3, 5, 9))
    scores = shares.groupBy(F.col("label").alias("query"), "k").agg(F.round(F.avg("share"), 6).alias("recall")).withColumn("model", F.lit("l2"))
    return retrieval.best_configuration(scores).select("query", "k", "recall")


@query(
    f"""{WITH_MENTIONS}, a AS (SELECT DISTINCT doc_id FROM m), q AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
    SELECT d.doc_id, CASE WHEN source = 'src1' THEN 'rule' WHEN d.doc_id IN (SELECT doc_id FROM q) THEN 'similar' ELSE 'identifier' END AS reason FROM d WHERE source = 'src1' OR d.doc_id IN (SELECT doc_id FROM q) OR d.doc_id IN (SELECT doc_id FROM a)"""
)
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = injected(spark, sf_dir).withColumn("kind", F.when(F.col("source") == "src1", "availability").otherwise("section"))
    hits = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return retrieval.relevant_chunks(chunks, hits, "doc_id").select("doc_id", "reason")


# --- relational operators ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-142'), o_orderkey) <= 25")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stratified_sample(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", 25).select("o_orderstatus", "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN CAST('0x' || substring(md5(CAST(o_custkey AS VARCHAR) || '-42'), 1, 6) AS INTEGER) < 3355443 THEN 'test' ELSE 'train' END AS split FROM orders")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.train_test_split(table(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "split")


@query("SELECT k, 'left_only' AS side FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders) UNION ALL SELECT k, 'right_only' FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer)")
def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.compare_tables(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))).select("k", "side")


@query(
    """WITH l AS (SELECT o_orderkey AS k, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS cust FROM orders), r AS (SELECT k, CASE WHEN k % 10 = 0 THEN 'X' ELSE status END AS status, cust FROM l WHERE k % 7 <> 0)
    SELECT l.k, 'status' AS column_name, l.status AS left_value, r.status AS right_value FROM l JOIN r ON l.k = r.k WHERE l.status IS DISTINCT FROM r.status"""
)
def cell_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("cust"))
    right = left.filter("k % 7 <> 0").withColumn("status", F.when(F.col("k") % 10 == 0, "X").otherwise(F.col("status")))
    return tables.cell_differences(left, right, "k")


@query("SELECT o_custkey, count(*) AS orders, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def joined_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.joined_strings(table(spark, sf_dir, "orders"), "o_custkey", {"o_orderstatus": "statuses", "o_orderpriority": "priorities"}, "orders")


@query("SELECT c_nationkey, count(*) AS n, CAST(to_json(list({'c_custkey': c_custkey, 'c_mktsegment': coalesce(c_mktsegment, 'n/a')} ORDER BY c_custkey)) AS VARCHAR) AS datasets FROM customer GROUP BY c_nationkey")
def nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.nested_groups(table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey", "c_mktsegment"], "datasets")


@query("SELECT CAST(substring(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def yearly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(tx.first_year(F.col("o_orderdate").cast("string")).alias("year"))
    return tables.value_counts(years, "year")


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, count(o_totalprice) AS n FROM orders")
def size_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.size_statistics(table(spark, sf_dir, "orders"), "o_totalprice")


@query("WITH p AS (SELECT trim(unnest(string_split(o_orderpriority, '-'))) AS value FROM orders) SELECT value, count(*) AS n FROM p WHERE value <> '' GROUP BY value")
def separated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.split_counts(table(spark, sf_dir, "orders"), "o_orderpriority", "-")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_profile(table(spark, sf_dir, "customer"))


@query("SELECT lang, count(*) AS n, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest, median(length(text)) AS middle FROM documents GROUP BY lang")
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.length_profile(table(spark, sf_dir, "documents"), "lang", "text")


@query(
    """WITH b AS (SELECT DISTINCT 'p' || (doc_id // 10) AS page FROM documents), p AS (SELECT DISTINCT 'p' || (doc_id // 10) AS page, 'ds' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS i FROM documents WHERE n_chars > 1000),
    t AS (SELECT DISTINCT 'p' || (doc_id // 10) AS page, 'ds' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS i FROM labels WHERE quality = 1),
    c AS (SELECT page, (SELECT count(*) FROM p WHERE p.page = b.page) AS np, (SELECT count(*) FROM t WHERE t.page = b.page) AS nt, (SELECT count(*) FROM p JOIN t USING (page, i) WHERE p.page = b.page) AS tp FROM b),
    m AS (SELECT avg(CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np > 0 THEN tp / np ELSE 0.0 END) AS p, avg(CASE WHEN nt = 0 THEN 1.0 ELSE tp / nt END) AS r FROM c)
    SELECT round(p, 6) AS average_precision, round(r, 6) AS average_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1_score FROM m"""
)
def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    page = F.concat(F.lit("p"), F.floor(F.col("doc_id") / 10).cast("string")).alias("page")
    name = F.concat(F.lit("ds"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("identifier")
    out = tables.evaluate(docs.filter("n_chars > 1000").select(page, name), table(spark, sf_dir, "labels").filter("quality = 1").select(page, name), docs.select(page))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refminer.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"))


# --- JSON, batches, metadata ------------------------------------------------------------------------------------------


@query("WITH p AS (SELECT event_id, '{\"a\": {\"b\": [' || props || ', 7]}, \"c\": \"x\"}' AS j, props FROM events WHERE props IS NOT NULL) SELECT event_id, 'a.b[0].k' AS path, json_extract_string(props, '$.k') AS value FROM p WHERE json_exists(props, '$.k') UNION ALL SELECT event_id, 'a.b[1]', '7' FROM p UNION ALL SELECT event_id, 'c', 'x' FROM p")
def flattened_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.concat(F.lit('{"a": {"b": ['), "props", F.lit(', 7]}, "c": "x"}'))
    return metadata.flatten(table(spark, sf_dir, "events").select("event_id", nested.alias("json")), "event_id", "json")


@query("WITH l AS (SELECT CASE WHEN event_id % 5 = 0 THEN left(props, length(props) - 1) ELSE props END AS line FROM events) SELECT count(*) AS total, count(*) FILTER (json_valid(line)) AS valid, count(*) FILTER (NOT json_valid(line)) AS invalid FROM l WHERE line IS NOT NULL")
def json_lines_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 5 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return batch.validate_lines(table(spark, sf_dir, "events").select(line.alias("value")))


@query("SELECT conv_id, turn, 'small-model_' || conv_id || '_' || turn AS custom_id, CAST(json_array(json_object('role', role, 'content', text)) AS VARCHAR) AS input FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("text is not null and role is not null")
    messages = F.array(F.struct("role", F.col("text").alias("content")))
    key = ids.custom_id(F.lit("small-model"), F.col("conv_id").cast("string"), F.col("turn"))
    lines = batch.requests(turns.select("conv_id", "turn", key.alias("custom_id"), messages.alias("messages")), "small-model", keep=("conv_id", "turn"))
    body = F.from_json("line", "custom_id string, body struct<input: string>")
    return lines.select("conv_id", "turn", body["custom_id"].alias("custom_id"), body["body"]["input"].alias("input"))


@query("SELECT 'r_' || conv_id || '_' || turn AS custom_id, 'GSE' || (conv_id * 10 + turn) AS dataset_identifier, 'geo' AS data_repository FROM conversations WHERE turn % 3 <> 2")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("conv_id") * 10 + F.col("turn")).cast("string")
    whole = F.concat(F.lit('{"datasets": [{"dataset_identifier": "GSE'), number, F.lit('", "data_repository": "geo"}]}'))
    fenced = F.concat(F.lit("```json\n"), whole, F.lit("\n```"))
    said = F.when(F.col("turn") % 3 == 0, whole).when(F.col("turn") % 3 == 1, fenced).otherwise(F.lit("I don't know"))
    key = F.concat_ws("_", F.lit("r"), "conv_id", "turn")
    line = F.to_json(F.struct(key.alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(said.alias("text"))).alias("content"))).alias("output")).alias("body")).alias("response")))
    answers = batch.results(table(spark, sf_dir, "conversations").select(line.alias("value")))
    return extraction.parse_answers(answers, "answer").select("custom_id", "dataset_identifier", "data_repository")


@query("WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') SELECT count(*) AS requests, count(r.conv_id) AS answered, count(*) - count(r.conv_id) AS missing FROM q LEFT JOIN r ON q.conv_id = r.conv_id AND q.turn = r.turn")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select(F.concat_ws("_", "conv_id", "turn").alias("custom_id"))
    answers = turns.filter("role = 'assistant'").select(F.concat_ws("_", "conv_id", F.col("turn") - 1).alias("custom_id"), F.col("text").alias("answer"))
    return batch.summary(asked, answers)


@query(
    f"""{WITH_MENTIONS}, p AS (SELECT doc_id, CASE WHEN repo = 'geo' THEN 'https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=' || mention WHEN repo = 'massive.ucsd.edu' THEN 'https://massive.ucsd.edu/ProteoSAFe/dataset.jsp?accession=' || mention
      WHEN repo = 'proteomecentral.proteomexchange.org' THEN 'https://proteomecentral.proteomexchange.org/cgi/GetDataset?ID=' || mention ELSE 'other' END AS dataset_webpage, mention, repo FROM m)
    SELECT DISTINCT doc_id, mention AS dataset_identifier, repo AS data_repository, dataset_webpage FROM p"""
)
def document_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: texts to resolved citations, by rules alone."""
    docs = injected(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_url"), "text")
    found = pipeline.citations_from_text(docs)
    return found.select(F.col("source_url").cast("bigint").alias("doc_id"), "dataset_identifier", "data_repository", "dataset_webpage")


def queries() -> dict[str, Query]:
    from refminer.plans import article_queries, io_queries  # noqa: F401  they register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
