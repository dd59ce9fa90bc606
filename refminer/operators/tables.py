"""Operators on tables of citations, publications and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refminer.functions.text import clean_words


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order; nulls in keys equal each other."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def dedup_citations(citations: DataFrame, order: list[str | Column]) -> DataFrame:
    """First row of each (download_link, dataset_identifier), or of each download_link where there is no identifier column."""
    keys = [c for c in ("download_link", "dataset_identifier") if c in citations.columns]
    return keep_first(citations, keys, order)


def dedup_items(items: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """First item of each cleaned identifier within key: a DOI prefix of a proteomics accession goes, items without an
    identifier go, and of items with 'n/a' all that name a repository stay."""
    clean = items.filter(F.length("dataset_identifier") > 0).withColumn("dataset_identifier", F.regexp_replace("dataset_identifier", r"10\.\d+/(\bPXD\d+\b)", "$1"))
    ranked = clean.withColumn("_r", F.row_number().over(Window.partitionBy(key, "dataset_identifier").orderBy(*order)))
    return ranked.filter((F.col("_r") == 1) | ((F.col("dataset_identifier") == "n/a") & (F.col("data_repository") != "n/a"))).drop("_r")


def merge_equal_chunks(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key and text (case and outer space aside): the first chunk's id and text, and the distinct titles in order, by ' | '."""
    plain = F.sha2(F.lower(F.trim("text")), 256)
    gathered = chunks.groupBy(key, plain.alias("_t")).agg(F.min_by("text", order).alias("text"), F.min(order).alias(order), F.sort_array(F.collect_list(F.struct(order, "section_title"))).alias("_s"))
    titles = F.array_distinct(F.transform("_s", lambda s: s["section_title"]))
    return gathered.select(key, order, "text", F.array_join(titles, " | ").alias("section_title"))


def drop_incomplete(citations: DataFrame) -> DataFrame:
    """Without rows that lack an identifier or repository and a page too."""
    gone = lambda c: F.col(c).isNull() | (F.col(c) == "n/a")
    return citations.filter(~((gone("dataset_identifier") | gone("data_repository")) & gone("dataset_webpage")))


def split_by_kind(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(supplementary files: with a file extension; availability: with a repository)."""
    return rows.filter(F.col("file_extension").isNotNull()), rows.filter(F.col("data_repository").isNotNull())


def compare_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one table has, as often as it has more of them, with side 'left_only' or 'right_only'; columns by name."""
    names = [c for c in left.columns if c in right.columns]
    a, b = left.select(names), right.select(names)
    return a.exceptAll(b).withColumn("side", F.lit("left_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right_only")))


def id_lookup(publications: DataFrame, mapping: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(publications with the mapping's columns, nulls where unmapped; those without a match)."""
    return publications.join(mapping, key, "left"), publications.join(mapping, key, "left_anti")


def match_aliases(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """page, predicted and truth identifier, exact: equal identifiers, and for the rest the first true identifier of the page
    that contains or is contained in it. Both tables have page and identifier."""
    clean = lambda d, name: d.select(F.lower("page").alias("page"), F.lower("identifier").alias(name)).filter(f"{name} is not null and {name} not in ('', 'n/a')").distinct()
    p, t = clean(predicted, "predicted"), clean(truth, "truth")
    pairs = p.join(t, "page").filter(F.col("predicted").contains(F.col("truth")) | F.col("truth").contains(F.col("predicted")))
    exact = F.col("predicted") == F.col("truth")
    best = F.row_number().over(Window.partitionBy("page", "predicted").orderBy(exact.desc(), "truth"))
    return pairs.withColumn("exact", exact).withColumn("_r", best).filter("_r = 1").drop("_r")


def evaluate(predicted: DataFrame, truth: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: average_precision, average_recall over pages and f1_score of the averages. A page with neither predictions nor
    truth counts 1 and 1, one without truth has recall 1."""
    base = pages.select(F.lower("page").alias("page")).distinct()
    clean = lambda d, name: d.select(F.lower("page").alias("page"), F.lower("identifier").alias("i")).filter("i is not null and i not in ('', 'n/a')").groupBy("page").agg(F.count_distinct("i").alias(name))
    hits = match_aliases(predicted, truth).groupBy("page").agg(F.count("*").alias("matched"), F.count_distinct("truth").alias("tp"))
    per = base.join(clean(predicted, "np"), "page", "left").join(clean(truth, "nt"), "page", "left").join(hits, "page", "left").na.fill(0)
    fp, tp, nt = F.col("np") - F.col("matched"), F.col("tp"), F.col("nt")
    none = (nt == 0) & (F.col("np") == 0)
    precision = F.when(none, 1.0).when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(nt == 0, 1.0).otherwise(tp / F.greatest(nt, F.lit(1)))
    means = per.agg(F.avg(precision).alias("average_precision"), F.avg(recall).alias("average_recall"))
    p, r = F.col("average_precision"), F.col("average_recall")
    return means.withColumn("f1_score", F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(0.0))


def cooccurrence(papers: DataFrame, min_support: int = 2) -> DataFrame:
    """repo_a < repo_b, pair_count (papers with both), support of each (rows), confidence both ways and lift.

    papers has paper and repo. A paper's repositories are one small set, so pairs are made inside its row: no self join.
    """
    support = papers.groupBy("repo").agg(F.count("*").alias("support"))
    sets = papers.filter("repo is not null").groupBy("paper").agg(F.sort_array(F.collect_set("repo")).alias("repos")).filter(F.size("repos") > 1)
    pairs = F.flatten(F.transform("repos", lambda a, i: F.transform(F.slice("repos", i + 2, F.size("repos")), lambda b: F.struct(a.alias("repo_a"), b.alias("repo_b")))))
    counts = sets.select(F.inline(pairs)).groupBy("repo_a", "repo_b").agg(F.count("*").alias("pair_count")).filter(F.col("pair_count") >= min_support)
    total = papers.agg(F.count_distinct("paper").alias("papers"))
    a = support.select(F.col("repo").alias("repo_a"), F.col("support").alias("support_a"))
    b = support.select(F.col("repo").alias("repo_b"), F.col("support").alias("support_b"))
    joined = counts.join(a, "repo_a").join(b, "repo_b").crossJoin(total)
    n = F.col("pair_count")
    return joined.select("repo_a", "repo_b", n, "support_a", "support_b", (n / F.col("support_a")).alias("confidence_ab"), (n / F.col("support_b")).alias("confidence_ba"), (n * F.col("papers") / (F.col("support_a") * F.col("support_b"))).alias("lift"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree and centrality (degree over the other nodes) of an undirected graph (a, b)."""
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    per = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    total = per.agg(F.count("*").alias("_n"))
    return per.crossJoin(total).select("node", "degree", F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(0.0).alias("centrality"))


def column_profile(df: DataFrame) -> DataFrame:
    """column_name, missing and distinct_values of each column. Values are counted by a digest with their column, first where
    they are read: what is shuffled is at most each column's distinct values, 16 bytes each."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column_name string, missing bigint, distinct_values bigint")
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(k), F.col(c))).alias("a"), F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(-1), F.col(c))).alias("b")) for k, c in enumerate(df.columns)])
    counted = df.select(F.inline(cells)).groupBy("k", "a", "b").agg(F.count("*").alias("n"))
    per = counted.groupBy("k").agg(F.coalesce(F.sum(F.when(F.col("a").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("a").alias("distinct_values"))
    names = F.array(*[F.lit(c) for c in df.columns])
    every = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("k"))
    return every.join(per, "k", "left").select(F.get(names, F.col("k")).alias("column_name"), F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))


def empty_columns(df: DataFrame) -> DataFrame:
    """Names of the columns without any value."""
    return column_profile(df).filter(F.col("distinct_values") == 0).select("column_name")


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    return (df.filter(F.col(column).isNotNull()) if dropna else df).groupBy(column).agg(F.count("*").alias("n"))


def split_counts(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """Frequency of the trimmed parts of a separated list."""
    parts = df.select(F.explode(F.split(column, separator)).alias("_p")).select(F.trim("_p").alias("value")).filter("value <> ''")
    return parts.groupBy("value").agg(F.count("*").alias("n"))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 142) -> DataFrame:
    """Up to n rows of each stratum, those with the least hash of key: the same rows every time."""
    order = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key))
    return df.withColumn("_r", order).filter(F.col("_r") <= n).drop("_r")


def train_test_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split 'train' or 'test'; all rows of a key go the same way."""
    point = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), 1, 6), 16, 10).cast("int")
    return df.withColumn("split", F.when(point < int(test_share * 0x1000000), "test").otherwise("train"))


def duplicate_index(df: DataFrame, value: str, order: str) -> DataFrame:
    """order, first_order: each row that repeats an earlier value, and where it came first."""
    # the digest is the key: values may be long texts, which needn't move
    first = F.min(order).over(Window.partitionBy("_v"))
    return df.select(order, F.sha2(F.col(value).cast("string"), 256).alias("_v")).withColumn("first_order", first).filter(F.col(order) > F.col("first_order")).select(order, "first_order")


def word_frequencies(df: DataFrame, column: str) -> DataFrame:
    """word and n; words are counted before anything is shuffled."""
    return df.select(F.explode(clean_words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def cell_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, column_name, left_value and right_value (as strings) of the cells that differ in rows both tables have."""
    names = [c for c in left.columns if c in right.columns and c != key]
    both = left.select(key, *[F.col(c).alias(f"l_{c}") for c in names]).join(right.select(key, *[F.col(c).alias(f"r_{c}") for c in names]), key)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"l_{c}").cast("string").alias("left_value"), F.col(f"r_{c}").cast("string").alias("right_value")) for c in names])
    return both.select(key, F.inline(cells)).filter(~F.equal_null("left_value", "right_value"))


def joined_strings(df: DataFrame, key: str, columns: dict[str, str], count: str) -> DataFrame:
    """key, count and, for each column, its distinct values sorted and joined by commas, under the given name."""
    return df.groupBy(key).agg(F.count("*").alias(count), *[F.array_join(F.sort_array(F.collect_set(c)), ",").alias(name) for c, name in columns.items()])


def nested_groups(df: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """key, n and a JSON list of the group's rows, sorted; missing strings are 'n/a'."""
    kinds = dict(df.dtypes)
    row = F.struct(*[F.coalesce(F.col(c), F.lit("n/a")).alias(c) if kinds[c] == "string" else F.col(c) for c in columns])
    return df.groupBy(key).agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_list(row))).alias(name))


def size_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: total (summed as decimals, so in no order), mean, median and n of a column."""
    total = F.sum(F.col(column).cast("decimal(18,2)")).cast("double")
    return df.agg(total.alias("total"), F.round(total / F.count(column), 4).alias("mean"), F.round(F.percentile(column, F.lit(0.5)), 4).alias("median"), F.count(column).alias("n"))


def length_profile(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, n and the shortest, longest and middle length of a text column."""
    size = F.length(column)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.percentile(size, F.lit(0.5)).alias("middle"))


def format_frequencies(df: DataFrame, kind: str, url: str) -> DataFrame:
    """kind, n and the sorted urls of each raw format."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(url)).alias("urls"))


def result_summary(citations: DataFrame) -> DataFrame:
    """what ('rows', 'file_extension', 'data_repository'), value and n: the size of a result and its value counts."""
    rows = citations.agg(F.count("*").alias("n")).select(F.lit("rows").alias("what"), F.lit(None).cast("string").alias("value"), "n")
    for c in ("file_extension", "data_repository"):
        if c in citations.columns:
            rows = rows.unionByName(value_counts(citations, c).select(F.lit(c).alias("what"), F.col(c).alias("value"), "n"))
    return rows


def input_coverage(prompts: DataFrame) -> DataFrame:
    """coverage: the mean, over rows with identifiers (an array), of the share that occurs in content."""
    wanted = F.filter("identifiers", lambda i: F.length(i) > 0)
    share = F.size(F.filter(wanted, lambda i: F.contains(F.lower("content"), F.lower(i)))) / F.size(wanted)
    return prompts.filter(F.size(wanted) > 0).agg(F.avg(share).alias("coverage"))


def all_identifiers_present(rows: DataFrame, identifiers: str, content: str) -> DataFrame:
    """The rows whose comma-separated identifiers all occur in their content."""
    return rows.filter(F.forall(F.split(identifiers, ","), lambda i: F.contains(F.col(content), F.trim(i))))


def exact_match(rows: DataFrame, left: str, right: str) -> DataFrame:
    return rows.agg(F.avg((F.trim(left) == F.trim(right)).cast("double")).alias("exact_match"))


def catalog_recall(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """dataset_id and hit: whether any of a dataset's urls, titles or accessions is met by a citation of its publication.

    catalog has dataset_id, publication, urls, titles and accessions (arrays); found has source_url, dataset_identifier,
    dataset_webpage and title. The join is by publication, an equality; the rest is decided within a publication.
    """
    wide = catalog.select("dataset_id", F.lower("publication").alias("p"), F.transform(F.concat("urls", "titles", "accessions"), F.lower).alias("_w"))
    said = found.select(F.lower("source_url").alias("p"), F.lower(F.concat_ws("\x01", "dataset_identifier", "dataset_webpage", "title")).alias("_s"))
    joined = wide.join(said, "p", "left")
    met = F.exists("_w", lambda w: (F.length(w) > 0) & F.col("_s").contains(w))
    return joined.groupBy("dataset_id").agg(F.coalesce(F.bool_or(met), F.lit(False)).alias("hit"))


def word_frequency_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """word and difference of two tables of word, n; words equally frequent in both are left out."""
    a, b = left.select("word", F.col("n").alias("_a")), right.select("word", F.col("n").alias("_b"))
    diff = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    return a.join(b, "word", "full").select("word", diff.alias("difference")).filter("difference <> 0")


def cached_append(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The cache with the rows of new whose key it lacks: insert if absent."""
    return cache.unionByName(new.join(cache.select(key), key, "left_anti").select(cache.columns))


def without_running_lines(pages: DataFrame, top: int = 10, bottom: int = 10, share: float = 0.5) -> DataFrame:
    """key and text of documents whose pages (key, page, text) lose their headers and footers: lines among the first or last
    few of at least this share of a document's pages (two pages at least), and lines 'Page n'. Pages are joined in order."""
    lines = pages.select("key", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"), (F.size(F.split("text", "\n")) - 1).alias("last"))
    trimmed = lines.withColumn("_l", F.trim("line"))
    edge = trimmed.filter(((F.col("pos") < top) | (F.col("pos") > F.col("last") - bottom)) & (F.col("_l") != ""))
    total = pages.groupBy("key").agg(F.count_distinct("page").alias("_pages"))
    seen = edge.groupBy("key", "_l").agg(F.count_distinct("page").alias("_n")).join(total, "key").filter((F.col("_n") >= 2) & (F.col("_n") >= share * F.col("_pages"))).select("key", "_l")
    at_edge = (F.col("pos") < top) | (F.col("pos") > F.col("last") - bottom)
    marked = trimmed.join(seen.withColumn("_gone", F.lit(True)), ["key", "_l"], "left")
    kept = marked.filter(~(F.coalesce("_gone", F.lit(False)) & at_edge) & ~F.col("_l").rlike(r"(?i)^page \d+$"))
    return kept.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "pos", "line"))), lambda s: s["line"]), "\n").alias("text"))
