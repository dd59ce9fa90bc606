"""Descriptions of datasets from their pages and from papers, by an extractor and by what pages say in a form for machines."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refminer.operators import extraction, markup, prompts
from refminer.operators.metadata import suggested_pages

KEYS = ("title", "description", "license", "creator", "publisher", "keywords", "datePublished", "version", "identifier")


def _asked(rows: DataFrame, prompt: Column, extractor: extraction.Extractor, model: str, cache: DataFrame | None) -> DataFrame:
    """rows with answer."""
    return extraction.ask(rows.withColumn("prompt", prompt), extractor, model, cache).drop("prompt", "prompt_id")


def page_metadata(pages: DataFrame, extractor: extraction.Extractor | None = None, model: str = "rules", folders: tuple[str, ...] = (), cache: DataFrame | None = None) -> DataFrame:
    """key and metadata, a map, of pages (key, content): what the page says in a form for machines, and whatever else the
    extractor finds in its text. Pages that say nothing have no row. A page is read once, and its rows go through all steps."""
    none = F.create_map().cast("map<string,string>")
    if extractor is None:
        out = markup.dataset_metadata(pages.select("key", "content"))
    else:
        both = markup.dataset_metadata(pages.select("key", "content"), with_content=True).withColumnRenamed("metadata", "_declared")
        known = F.coalesce(F.to_json("_declared"), F.lit("{}"))
        prompt = extraction.render(prompts.load_prompt("metadata", folders), keys=F.lit(", ".join(KEYS)), known=known, content=markup.strip_html(F.col("content")))
        asked = _asked(both.select("key", "_declared", prompt.alias("prompt")), F.col("prompt"), extractor, model, cache)
        joined = extraction.first_objects(asked, "key").select("key", F.coalesce("_declared", none).alias("_declared"), F.coalesce("_said", none).alias("_said"))
        fresh = F.map_filter("_said", lambda k, v: ~F.map_contains_key("_declared", k))
        out = joined.select("key", F.map_concat("_declared", fresh).alias("metadata"))
    return out.filter(F.size("metadata") > 0)


def described_datasets(papers: DataFrame, targets: DataFrame, extractor: extraction.Extractor, model: str = "rules", folders: tuple[str, ...] = (), cache: DataFrame | None = None) -> DataFrame:
    """targets (key, dataset_identifier) with description, as the paper (key, text) of the same key has it; null where there is no answer."""
    template = prompts.load_prompt("description", folders)
    rows = targets.join(papers.select("key", "text"), "key").withColumn("_id", F.concat_ws("\x01", "key", "dataset_identifier"))
    prompt = extraction.render(template, dataset=F.col("dataset_identifier"), content=F.col("text"))
    said = extraction.first_objects(_asked(rows.select("_id", prompt.alias("prompt")), F.col("prompt"), extractor, model, cache), "_id").filter("_said is not null").dropDuplicates(["_id"])
    found = said.select("_id", F.try_element_at("_said", F.lit("description")).alias("description"))
    return targets.withColumn("_id", F.concat_ws("\x01", "key", "dataset_identifier")).join(found, "_id", "left").drop("_id")


def two_hops(pages: DataFrame, sitemap: DataFrame, fetch: Callable[[DataFrame], DataFrame], extractor: extraction.Extractor, most: int = 3, model: str = "rules", folders: tuple[str, ...] = (), cache: DataFrame | None = None) -> DataFrame:
    """key and metadata of pages (key, content), read together with at most `most` further pages each.

    The extractor first suggests URLs; those that the sitemap (key, url) has are fetched (fetch adds content to rows with
    url), and the page and their texts are read as one.
    """
    asked = _asked(pages.select("key", extraction.render(prompts.load_prompt("pages_to_read", folders), content=F.col("content")).alias("prompt")), F.col("prompt"), extractor, model, cache)
    urls = F.from_json("answer", "urls array<string>")["urls"]
    suggestions = asked.select("key", F.coalesce(urls, F.array().cast("array<string>")).alias("urls"))
    chosen = suggested_pages(suggestions, sitemap, most)
    fetched = fetch(chosen).select("key", "url", "content").filter("content is not null")
    more = fetched.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("url", "content"))), lambda s: s["content"]), "\n").alias("_more"))
    whole = pages.join(more, "key", "left").select("key", F.concat_ws("\n", "content", "_more").alias("content"))
    return page_metadata(whole, extractor, model, folders, cache)


def file_keywords(files: DataFrame, extractor: extraction.Extractor, model: str = "rules", group: str = "source_url", order: str = "link", folders: tuple[str, ...] = (), cache: DataFrame | None = None) -> DataFrame:
    """files with keywords: one prompt for all files of a group, in order; where the answer isn't a list of as many strings, each file's own description."""
    listed = files.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("context_description", "description", F.lit("")).alias("t")))).alias("_f"))
    text = F.array_join(F.transform("_f", lambda f, k: F.concat_ws(". ", (k + 1).cast("string"), f["t"])), "\n")
    said = _asked(listed, extraction.render(prompts.load_prompt("keywords", folders), content=text), extractor, model, cache)
    answer = F.from_json("answer", "array<string>")
    fits = F.coalesce(F.size(answer) == F.size("_f"), F.lit(False))
    each = said.select(group, F.posexplode("_f.o").alias("_k", "_o"), F.when(fits, answer).alias("_a")).select(group, F.col("_o"), F.get("_a", F.col("_k")).alias("_kw"))
    first = each.groupBy(group, "_o").agg(F.min("_kw").alias("_kw"))
    joined = files.join(first.withColumnRenamed("_o", order), [group, order], "left")
    return joined.withColumn("keywords", F.coalesce("_kw", "description")).drop("_kw").select(*files.columns, "keywords")


def readable(texts: DataFrame) -> DataFrame:
    """key, content and format of fetched texts (key, content, format): pages and XML in their normal form, other texts as they are."""
    from refminer.operators import rules

    marked = texts.filter(F.col("format").isin("HTML", "XML"))
    done = rules.normalised(marked).select("key", F.col("content").alias("_n"))
    keyed = texts.select(F.col("key").cast("string").alias("key"), "content", "format")
    return keyed.join(done, "key", "left").select("key", F.coalesce("_n", "content").alias("content"), "format")


def settings(operator: Any) -> dict[str, Any]:
    """The public attributes of an extractor, provider or model, by name: what is needed to describe a run."""
    own = vars(operator) if hasattr(operator, "__dict__") else {}
    return {k: v for k, v in sorted(own.items()) if not k.startswith("_") and not callable(v)}
