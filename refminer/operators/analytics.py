"""Analytics on citations, catalogs and training data, as the notebooks of a curation project need them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from refminer.functions.batches import pieces
from refminer.functions.identifiers import extract, null_if_sentinel
from refminer.operators import ontology
from refminer.operators.tables import degrees, keep_first, value_counts

#: Labels of identifiers whose repository is missing, the first that matches.
LABELS: tuple[tuple[str, str], ...] = (
    ("geo", r"G(?:SE|SM|PL|DS)\d+"),
    ("sra", r"[SED]R[APRX]\d+|PRJ(?:NA|EB|DB)\d+"),
    ("proteomecentral.proteomexchange.org", r"PXD\d+"),
    ("massive.ucsd.edu", r"MSV\d+"),
    ("arrayexpress", r"E-[A-Z]{4}-\d+"),
    ("ega-archive.org", r"EGA[SDC]\d+"),
    ("dbgap", r"phs\d+"),
)


def first_label(identifier: Column, labels: tuple[tuple[str, str], ...] = LABELS) -> Column:
    """The label of the first pattern that an identifier begins with; null for none."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(labels):
        out = F.when(identifier.rlike(f"(?i)^(?:{pattern})"), F.lit(label)).otherwise(out)
    return out


def label_frequencies(citations: DataFrame, labels: tuple[tuple[str, str], ...] = LABELS) -> DataFrame:
    """repository and n of citations (dataset_identifier, data_repository): what is said, else what the identifier looks like, else 'Other'."""
    said = null_if_sentinel(F.col("data_repository"))
    named = F.when(said == "www.ncbi.nlm.nih.gov", F.lit("pmc.ncbi.nlm.nih.gov")).otherwise(said)
    return value_counts(citations.select(F.coalesce(named, first_label(F.col("dataset_identifier"), labels), F.lit("Other")).alias("repository")), "repository")


def disambiguated_frequencies(citations: DataFrame, labels: tuple[tuple[str, str], ...] = LABELS) -> DataFrame:
    """As label_frequencies, with doi.org divided by what the DOI says; unknown ones are 'DOI (unclassified)', missing ones 'Other/Unknown'."""
    said, low = null_if_sentinel(F.col("data_repository")), F.lower(F.coalesce("dataset_identifier", F.lit("")))
    by_doi = F.coalesce(
        F.when(low.contains("zenodo"), F.lit("Zenodo")).when(low.contains("figshare"), F.lit("Figshare")).when(low.contains("dryad"), F.lit("Dryad")), first_label(low, labels), F.lit("DOI (unclassified)")
    )
    named = F.when(said == "doi.org", by_doi).when(said == "www.ncbi.nlm.nih.gov", F.lit("pmc.ncbi.nlm.nih.gov")).otherwise(F.coalesce(said, F.lit("Other/Unknown")))
    return value_counts(citations.select(named.alias("repository")), "repository")


def average_degree(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and average_degree of an undirected graph (a, b)."""
    per = degrees(edges)
    return per.agg(F.count("*").alias("nodes"), F.coalesce((F.sum("degree") / 2).cast("bigint"), F.lit(0)).alias("edges"), F.avg("degree").alias("average_degree"))


def pattern_sizes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """columns and n of every combination of values, nulls too; largest first where it is shown in order."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def preferred(rows: DataFrame, keys: list[str], column: str, word: str, order: list[str | Column]) -> DataFrame:
    """One row of each key: the first by order among those whose column contains word, if there are any."""
    return keep_first(rows, keys, [F.when(F.contains(F.lower(column), F.lit(word.lower())), 0).otherwise(1), *order])


def strided(rows: DataFrame, order: str, step: int) -> DataFrame:
    """Every step-th row in the order of a unique column, from the first on. Ranks are made from the sizes of ranges of the order, without one global window."""
    ranged = rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    within = ranged.withColumn("_w", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    sizes = within.groupBy("_p").agg(F.count("*").alias("_n"), F.min(order).alias("_least"))
    # as many rows as there are partitions
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return within.join(F.broadcast(before), "_p").filter((F.col("_w") + F.col("_b") - 1) % step == 0).drop("_p", "_w", "_b")


def without_values(rows: DataFrame, column: str, values: tuple[str, ...] = ("pending", "no publication")) -> DataFrame:
    """rows whose column has none of the values, whatever the case; nulls stay."""
    return rows.filter(F.col(column).isNull() | ~F.lower(F.trim(column)).isin(*values))


def unnested_catalog(catalog: DataFrame) -> DataFrame:
    """title, publication_url, accession and data_url: a row for each publication with each location of a catalog entry
    (title, publications: array of struct url, data_locations: array of struct accession_number, data_access_url).

    Entries without a publication are left out, those without a location have nulls.
    """
    published = catalog.select("title", "data_locations", F.explode("publications").alias("p")).filter("p.url is not null")
    placed = published.select("title", F.col("p.url").alias("publication_url"), F.explode_outer("data_locations").alias("l"))
    return placed.select("title", "publication_url", F.col("l.accession_number").alias("accession"), F.col("l.data_access_url").alias("data_url"))


def flattened_catalog(rows: DataFrame, column: str = "record") -> DataFrame:
    """rows' other columns and the fields of a repository's nested JSON record, wide: scalars as they are, lists of names joined
    by '; ' and counted, and a copy of each list as JSON. Rows that aren't JSON have nulls."""
    schema = (
        "id bigint, identifier string, title string, abstract string, storageSize bigint, publicationDate string, lastModificationDate string, versionNumber int, license string, "
        "authors array<struct<firstName: string, lastName: string, affiliation: string, orcid: string>>, keywords array<string>, locations array<struct<place: string>>, "
        "funders array<struct<organization: string, awardNumber: string>>, relatedWorks array<struct<relationship: string, identifier: string>>, metrics struct<views: bigint, downloads: bigint, citations: bigint>"
    )
    r = F.from_json(column, schema)
    staged = rows.withColumn("_r", r)

    def joined(name: str, value: Any) -> Column:
        return F.array_join(F.filter(F.transform(F.coalesce(f"_r.{name}", F.array()), value), lambda v: F.length(v) > 0), "; ")

    lists = {
        "authors": lambda a: F.trim(F.concat_ws(" ", a["firstName"], a["lastName"])),
        "keywords": lambda k: k,
        "locations": lambda p: p["place"],
        "funders": lambda f: F.concat_ws(" ", f["organization"], F.when(F.length(f["awardNumber"]) > 0, F.concat(F.lit("("), f["awardNumber"], F.lit(")")))),
        "relatedWorks": lambda w: w["identifier"],
    }
    snake = {"relatedWorks": "related_works", "storageSize": "storage_size", "publicationDate": "publication_date", "lastModificationDate": "last_modified", "versionNumber": "version"}
    scalars = [F.col(f"_r.{n}").alias(snake.get(n, n)) for n in ("id", "identifier", "title", "abstract", "storageSize", "publicationDate", "lastModificationDate", "versionNumber", "license")]
    wide = [c for n, value in lists.items() for c in (joined(n, value).alias(snake.get(n, n)), F.coalesce(F.size(f"_r.{n}"), F.lit(0)).alias(f"n_{snake.get(n, n)}"), F.to_json(f"_r.{n}").alias(f"{snake.get(n, n)}_json"))]
    doi = F.regexp_replace("_r.identifier", "^doi:", "").alias("doi")
    return staged.select(*[c for c in rows.columns if c != column], *scalars, doi, *wide, *[F.col(f"_r.metrics.{m}").alias(m) for m in ("views", "downloads", "citations")])


def total_recall(hits: DataFrame, excluded: DataFrame | None = None, key: str = "dataset_id") -> DataFrame:
    """One row: n, found and recall of hits (key, hit), without the keys in excluded."""
    counted = hits if excluded is None else hits.join(excluded.select(key).distinct(), key, "left_anti")
    found = F.count_if("hit")
    return counted.agg(F.count("*").alias("n"), found.alias("found"), (found / F.count("*")).alias("recall"))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def rouge_n(rows: DataFrame, prediction: str, reference: str, n: int = 1, name: str | None = None) -> DataFrame:
    """rows with rouge_n: the F measure of the n-grams of words that prediction and reference share, each as often as both have it; 0 where there are none."""

    def score(p: list[str], q: list[str]) -> float:
        a, b = (Counter(zip(*[words[k:] for k in range(n)], strict=False)) for words in (p, q))
        total = a.total() + b.total()
        # of every distinct n-gram the lesser number of occurrences counts
        return 2.0 * (a & b).total() / total if total else 0.0

    return _scored(rows, prediction, reference, score, name or f"rouge_{n}")


def _scored(rows: DataFrame, prediction: str, reference: str, score: Callable[[list[str], list[str]], float], name: str) -> DataFrame:
    """rows with the score of the words of prediction and reference, called name."""
    columns = [c for c in rows.columns if c != name]
    staged = rows.select(*columns, _tokens(F.coalesce(prediction, F.lit(""))).alias("_p"), _tokens(F.coalesce(reference, F.lit(""))).alias("_q"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in pieces(batch)):
            scores = [score(a.as_py(), b.as_py()) for a, b in zip(part.column("_p"), part.column("_q"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(scores, pa.float64())], [*columns, name])

    return staged.mapInArrow(run, StructType([*rows.select(columns).schema.fields, StructField(name, DoubleType())]))


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one number, so a word of b costs len(a) / 64 steps."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        if met := row & places.get(y, 0):
            row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


def rouge_l(rows: DataFrame, prediction: str, reference: str) -> DataFrame:
    """rows with rouge_l: the F measure of the longest common subsequence of words."""
    return _scored(rows, prediction, reference, lambda a, b: 2 * longest_common(a, b) / (len(a) + len(b)) if a or b else 0.0, "rouge_l")


def without_field(answer: Column, field: str = "dataset_webpage") -> Column:
    """A JSON answer of the form {"datasets": [{...}]} or [{...}] without one field of its items; text that isn't JSON loses it by its pattern."""
    return F.regexp_replace(F.regexp_replace(answer, rf'\s*"{field}"\s*:\s*(?:"(?:[^"\\]|\\.)*"|null|[\d.]+)\s*,', ""), rf',?\s*"{field}"\s*:\s*(?:"(?:[^"\\]|\\.)*"|null|[\d.]+)', "")


def converted_ids(rows: DataFrame, records: DataFrame, source: str, target: str) -> DataFrame:
    """rows with target, by an id-conversion table (doi, pmcid, pmid): the least of several, null for none. source and target name columns of it."""
    clean = lambda c: F.upper(F.trim(c.cast("string")))
    known = records.select(clean(F.col(source)).alias("_k"), F.col(target).cast("string").alias("_v")).filter("_k is not null and _v is not null").groupBy("_k").agg(F.min("_v").alias(target))
    return rows.join(known, clean(rows[source]) == F.col("_k"), "left").drop("_k")


def conversion_requests(rows: DataFrame, column: str, size: int = 100, root: str = "https://pmc.ncbi.nlm.nih.gov/tools/idconv/api/v1/articles/") -> DataFrame:
    """batch and url: requests to an id converter for the distinct ids of a column, at most size in each; ids fall into batches by hash."""
    ids = rows.select(F.trim(F.col(column).cast("string")).alias("id")).filter("id <> ''").distinct()
    total = ids.agg(F.ceil(F.count("*") / size).alias("_b"))
    dealt = ids.crossJoin(total).withColumn("bucket", F.pmod(F.xxhash64("id"), F.greatest("_b", F.lit(1))))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1)
    batch = F.concat_ws("-", "bucket", F.floor(F.col("_r") / size).cast("string")).alias("batch")
    joined = ranked.groupBy(batch).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    return joined.select("batch", F.concat(F.lit(root + "?format=json&ids="), "ids").alias("url"))


def redirect_target(url: Column, html: Column) -> Column:
    """Where a PubMed page leads: the PMC article it names, else its DOI; other URLs stay."""
    pmc = F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), extract(html, r'(?is)<a[^>]*data-ga-action="PMCID"[^>]*>\s*(PMC\d+)', 1))
    doi = F.concat(F.lit("https://doi.org/"), extract(html, r'(?is)<a[^>]*data-ga-action="DOI"[^>]*>\s*(10\.[^<\s]+)', 1))
    return F.when(F.lower(url).contains("pubmed"), F.coalesce(pmc, doi, url)).otherwise(url)


def repository_name(repo: Column, source: Any = None) -> Column:
    """The name of a repository by its key, else the key."""
    names = {e["repo"]: e["repo_name"] for e in ontology.load(source) if e["repo_name"]}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(repo)), repo)


def preview(rows: DataFrame, key: str, width: int = 80) -> DataFrame:
    """key, field and value of everything that isn't missing, as text in lines of at most width characters where words allow."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in rows.columns if c != key])
    cells = rows.select(key, F.inline(fields)).withColumn("value", null_if_sentinel(F.col("value"))).filter("value is not null")
    return cells.withColumn("value", F.regexp_replace("value", rf"(.{{1,{width}}})(?:\s+|$)", "$1\n")).withColumn("value", F.regexp_replace("value", r"\n$", ""))


def pages_for_missing(citations: DataFrame, source: Any = None) -> DataFrame:
    """citations with dataset_webpage filled by the repository's template where it is missing ('n/a' where there is no template), and access_mode."""
    from refminer.operators import resolve

    entries = ontology.load(source)
    repo, page = F.col("data_repository"), null_if_sentinel(F.col("dataset_webpage"))
    built = resolve.landing_page(repo, F.col("dataset_identifier"), entries)
    return citations.withColumns({"dataset_webpage": F.coalesce(page, built), "access_mode": resolve.lookup(entries, repo, "access_mode")})


def known_page(url: Column, source: Any = None) -> Column:
    """The URL where it begins like a landing page of some repository, else null."""
    from refminer.operators import resolve

    return F.when(resolve.by_page(ontology.load(source), url).isNotNull(), url)


def publication_corpus(sitemap: DataFrame, base_url: str, keywords: tuple[str, ...], pages: DataFrame | None = None) -> DataFrame:
    """url and publication: of the URLs of a site (url) those of publications, with the publication ids that their pages (url, html) have; null where there is no page or id."""
    from refminer.functions.identifiers import publication_ids
    from refminer.sources.references import is_publication_url

    found = sitemap.select("url").distinct().filter(is_publication_url(F.col("url"), base_url, keywords))
    if pages is None:
        return found.withColumn("publication", F.lit(None).cast("string"))
    return found.join(pages.select("url", "html"), "url", "left").select("url", F.explode_outer(publication_ids(F.col("html"))).alias("publication")).distinct()
