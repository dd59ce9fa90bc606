"""Resolution of extracted citations against the ontology: identifier, repository, landing page, access mode.

The ontology has a few dozen rows in a fixed order. "First match wins" is a CASE over its literals, which gives the place
of an entry; an entry's other values are constant arrays and maps that are looked into. All of it is one generated
projection over the citations, no join and no shuffle.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refminer.functions.identifiers import extract, host
from refminer.operators import ontology

Entries = list[dict[str, Any]]
MISSING = "n/a"


def _sql(text: Any) -> str:
    """A string as an SQL literal, null as one of strings."""
    return "CAST(NULL AS STRING)" if text is None else "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cases(value: Column | str, conditions: list[tuple[int, str]]) -> Column:
    """The number of the first condition on value (a Column, or a column's name; {} in the conditions) that holds, null if none does.

    The CASE is one SQL text: built call by call, an ontology's expressions would take seconds.
    """
    if not conditions:
        return F.lit(None).cast("int")
    arms = " ".join(f"WHEN {c} THEN {k}" for k, c in conditions)
    if isinstance(value, str):
        return F.expr("CASE " + arms.replace("{}", f"`{value}`") + " END")
    return F.get(F.call_function("transform", F.array(value), F.expr("v -> CASE " + arms.replace("{}", "v") + " END")), F.lit(0))


def value_at(entries: Entries, place: Column, name: str) -> Column:
    """The value called name of the entry at a place, null for a null place."""
    return F.get(F.expr(f"array({', '.join(_sql(e[name]) for e in entries)})"), place)


def lookup(entries: Entries, repo: Column, name: str) -> Column:
    """The value called name of the entry with this key, null for none."""
    values: dict[str, str] = {}
    for e in entries:
        if e[name] is not None:
            values.setdefault(e["repo"], str(e[name]))
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.expr(f"map({', '.join(_sql(x) for pair in values.items() for x in pair)})"), repo)


def by_pattern(entries: Entries, identifier: Column | str, anchored: bool) -> Column:
    """Place of the first entry whose identifier pattern matches; the patterns are literals, so each is compiled once."""
    return _cases(identifier, [(k, f"{{}} RLIKE {_sql('(?i)^(?:' + e['id_pattern'] + ')' if anchored else '(?i)' + e['id_pattern'])}") for k, e in enumerate(entries) if e["id_pattern"]])


def by_page(entries: Entries, url: Column | str) -> Column:
    """Place of the first entry whose landing pages begin like something in url."""
    return _cases(url, [(k, f"contains(lower({{}}), {_sql(e['page_prefix'])})") for k, e in enumerate(entries) if e["page_prefix"]])


def identifier_at(entries: Entries, text: Column, place: Column) -> Column:
    """What the pattern of the entry at a place matches in text."""
    arms = " ".join(f"WHEN v.p = {k} THEN regexp_extract(v.t, {_sql('(?i)' + e['id_pattern'])}, 0)" for k, e in enumerate(entries) if e["id_pattern"])
    if not arms:
        return F.lit(None).cast("string")
    found = F.get(F.call_function("transform", F.array(F.struct(place.alias("p"), text.alias("t"))), F.expr(f"v -> CASE {arms} END")), F.lit(0))
    return F.when(found != "", found)


def repository_of_page(url: Column, entries: Entries) -> Column:
    """The first repository whose landing pages begin like url."""
    return value_at(entries, by_page(entries, url), "repo")


def identifier_in_page(url: Column, entries: Entries) -> Column:
    """The identifier that follows a landing page's fixed part, of the first repository that url belongs to."""
    return _after(url, value_at(entries, by_page(entries, url), "page_prefix"))


def _after(url: Column, prefix: Column) -> Column:
    """What follows prefix in url: one segment, or a DOI."""
    return extract(F.substring(url, F.position(prefix, F.lower(url)) + F.length(prefix), F.length(url)), r"^(?:10\.\d{4,9}/[^?#&]+|[^/?#&]+)")


def valid_identifier(identifier: Column, entries: Entries) -> Column:
    """The identifier cleaned, or 'n/a' where it is a repository's name, has spaces, is shorter than 3, or is no known URL."""
    clean = F.regexp_replace(identifier, r"\s*\(.*\)\s*", "")
    names = sorted({e["repo_name"].lower() for e in entries if e["repo_name"]})
    bad = F.lower(clean).isin(*names) | clean.contains(" ") | (clean == MISSING) | (F.length(clean) < 3)
    doi = F.regexp_replace(F.regexp_replace(clean, r"https?://doi\.org/", ""), "doi:", "")
    url = clean.startswith("http")
    return F.when(identifier.isNull(), F.lit(MISSING)).when(bad, F.lit(MISSING)).when(url & clean.contains("doi.org"), doi).when(url, F.coalesce(identifier_in_page(clean, entries), F.lit(MISSING))).otherwise(clean)


def identifier_range(identifier: Column) -> Column:
    """All identifiers of a range such as AB08-AB12, zeros kept, else the identifier alone. Numbers have nine digits at most."""
    pattern = r"^(\w*?)(\d{1,9})-(\w*?)(\d{1,9})$"
    stem, low = F.regexp_extract(identifier, pattern, 1), F.regexp_extract(identifier, pattern, 2)
    other, high = F.regexp_extract(identifier, pattern, 3), F.regexp_extract(identifier, pattern, 4)
    first, last = F.try_to_number(low, F.lit("999999999")).cast("int"), F.try_to_number(high, F.lit("999999999")).cast("int")
    is_range = (F.length(stem) > 0) & (stem == other) & (first <= last)
    numbers = F.sequence(first, F.greatest(first, last))
    return F.when(is_range, F.transform(numbers, lambda n: F.concat(stem, F.lpad(n.cast("string"), F.greatest(F.length(low), F.length(n.cast("string"))), F.lit("0"))))).otherwise(F.array(identifier))


def domain_of_repository(repo: Column, page: Column | None = None) -> Column:
    """Host of the page, where there is one, else of a URL; a bare word or domain stays."""
    named = repo if page is None else F.coalesce(F.when(page != MISSING, page), repo)
    bare = (F.length(named) > 0) & (~F.contains(named, F.lit(".")) | ~named.rlike("[ /]"))
    return F.coalesce(host(named), F.when(bare, named), F.lit("Unknown_Publisher"))


def resolve_repository(repo: Column, identifier: Column, entries: Entries, page: Column | None = None, candidate: Column | None = None) -> Column:
    """Key of the repository: by key, name, name within the string or identifier pattern, the first in the ontology's order;
    else by domain. Mapped keys are replaced, and a candidate whose root this is takes its place. Lower case; null gives 'n/a'."""
    plain = F.lower(F.translate(repo, "()", "  "))
    named = _cases(plain, [(k, f"{{}} = {_sql(e['repo'].lower())}" + (f" OR contains({{}}, {_sql(e['repo_name'].lower())})" if e["repo_name"] else "")) for k, e in enumerate(entries)])
    first = F.least(named, by_pattern(entries, F.when(identifier != MISSING, identifier), anchored=True))
    found = F.coalesce(value_at(entries, first, "repo"), domain_of_repository(F.translate(repo, "()", "  "), page))
    found = F.coalesce(lookup(entries, found, "repo_mapping"), found)
    if candidate is not None:
        found = F.when(lookup(entries, candidate, "repo_root") == found, candidate).otherwise(found)
    return F.when(repo.isNull(), F.lit(MISSING)).otherwise(F.lower(found))


def accession_for_repository(identifier: Column, repo: Column, entries: Entries) -> Column:
    """The identifier with the repository's usual suffix where it lacks it, in lower case then; else unchanged."""
    suffix = lookup(entries, repo, "default_suffix")
    bare = suffix.isNotNull() & ~F.contains(identifier, F.lit("."))
    return F.when(bare, F.lower(F.concat(identifier, suffix))).otherwise(identifier)


def landing_page(repo: Column, identifier: Column, entries: Entries, existing: Column | None = None) -> Column:
    """The page there is, else the repository's template filled with the identifier, else 'n/a'."""
    template = lookup(entries, repo, "page_template")
    built = F.when(identifier != MISSING, F.replace(template, F.lit("{}"), accession_for_repository(identifier, repo, entries)))
    given = existing if existing is not None else F.lit(None).cast("string")
    return F.coalesce(F.when((given != MISSING) & (F.length(given) > 0), given), built, F.lit(MISSING))


def valid_page(page: Column, repo: Column, identifier: Column, entries: Entries) -> Column:
    """A page as it is if its repository has no template or the page begins like it; else what the template gives for the identifier."""
    prefix = lookup(entries, repo, "page_prefix")
    foreign = prefix.isNotNull() & ~F.contains(F.lower(page), prefix) & (identifier != MISSING)
    return F.when(foreign, landing_page(repo, identifier, entries)).otherwise(page)


def _split_lists(citations: DataFrame, entries: Entries) -> DataFrame:
    """A row for each identifier of a comma list. Repositories listed in the same number go along one by one; of other lists each
    identifier takes the repository whose pattern it has, if any."""
    ident, repo = F.col("dataset_identifier"), F.col("data_repository")
    parts, repos = F.split(ident, r"\s*,\s*"), F.split(repo, r"\s*,\s*")
    listed = ident.rlike(r"^\s*[\w.:/-]{3,}(?:\s*,\s*[\w.:/-]{3,})+\s*$")
    alike = F.size(parts) == F.size(repos)
    many = F.transform(parts, lambda x, k: F.struct(F.trim(x).alias("i"), F.when(alike, F.trim(F.get(repos, k))).when(repo.contains(","), F.coalesce(value_at(entries, by_pattern(entries, F.trim(x), True), "repo"), repo)).otherwise(repo).alias("r")))
    both = F.when(F.coalesce(listed, F.lit(False)), many).otherwise(F.array(F.struct(ident.alias("i"), repo.alias("r"))))
    return citations.withColumn("_both", F.explode(both)).withColumns({"dataset_identifier": F.col("_both.i"), "data_repository": F.col("_both.r")}).drop("_both")


def resolve_citations(citations: DataFrame, source: Any = None) -> DataFrame:
    """citations (dataset_identifier, data_repository and optionally dataset_webpage, access_mode) resolved, one row per
    identifier of a list or a range; rows with neither an identifier nor a page, or neither a repository nor a page, go.
    Other columns stay.

    Each of the three fields is tried against the landing pages and identifier patterns of all repositories; the first
    repository counts, and in it the first field.
    """
    entries = ontology.load(source)
    split = _split_lists(citations, entries)
    given = F.col("dataset_webpage") if "dataset_webpage" in citations.columns else F.lit(None).cast("string")
    mode = F.col("access_mode") if "access_mode" in citations.columns else F.lit(None).cast("string")
    names = {"i": "dataset_identifier", "r": "data_repository", "w": "_given"}
    fields = {f: F.col(n) for f, n in names.items()}
    matched = {f"_p{f}": by_page(entries, n) for f, n in names.items()} | {f"_i{f}": by_pattern(entries, n, anchored=False) for f, n in names.items()}
    staged = split.withColumns({"_given": given, "_page": F.when(given != MISSING, given), "_mode": mode}).withColumns(matched)

    def best(choices: list[tuple[Column, int, Column]]) -> Column:
        """v of the (place, order within the entry, v) that comes first; null places and values don't count."""
        return F.least(*[F.when(v.isNotNull(), F.when(at.isNotNull(), F.struct((at * 8 + n).alias("k"), v.alias("v")))) for at, n, v in choices])["v"]

    pages, ids, candidates = [], [], []
    for n, (f, v) in enumerate(fields.items()):
        at_page, at_id, url = F.col(f"_p{f}"), F.col(f"_i{f}"), v.startswith("http")
        bare_doi = extract(v, r"^(?:doi:)?(10\..*)$", 1)
        pages += [(at_page, 2 * n, v), (at_id, 2 * n + 1, F.when(url, v).otherwise(F.concat(F.lit("https://doi.org/"), bare_doi)))]
        ids.append((at_id, 2 * n + 1, F.when(~url, v if f == "i" else identifier_at(entries, v, at_id))))
        candidates += [(at_page, 2 * n, at_page), (at_id, 2 * n + 1, F.when(~url, at_id))]
    staged = staged.withColumns({"_known": best(ids), "_found_page": best(pages), "_candidate": best(candidates)})
    page = F.coalesce("_found_page", "_page")
    own = F.coalesce("_known", valid_identifier(F.col("dataset_identifier"), entries))
    in_page = F.coalesce(_after(page, value_at(entries, F.least("_pi", "_pr", "_pw"), "page_prefix")), identifier_at(entries, page, F.least("_ii", "_ir", "_iw")))
    staged = staged.withColumns({"_page": page, "_own": own})
    staged = staged.withColumns({"_id": F.when(F.col("_own") != MISSING, F.col("_own")).otherwise(F.coalesce(in_page, F.lit(MISSING)))})
    repo = F.col("data_repository")
    nameless = F.lower(F.coalesce(repo, F.lit(MISSING))) == MISSING
    candidate = value_at(entries, F.col("_candidate"), "repo")
    found = resolve_repository(repo, F.coalesce(F.when(F.col("dataset_identifier") != MISSING, F.col("dataset_identifier")), "_known", F.lit(MISSING)), entries, F.col("_page"), candidate)
    staged = staged.withColumn("_repo", F.when(nameless, F.coalesce(lookup(entries, candidate, "repo_mapping"), candidate, F.lit(MISSING))).otherwise(found))
    gone = ((F.col("_id") == MISSING) | (F.col("_repo") == MISSING)) & F.col("_page").isNull()
    # dropped rows have no identifier to explode: a filter would be pushed down and repeat all of the above
    many = staged.withColumn("_id", F.explode(F.when(gone, F.array().cast("array<string>")).otherwise(identifier_range(F.col("_id")))))
    done = many.withColumns({
        "dataset_identifier": accession_for_repository(F.col("_id"), F.col("_repo"), entries),
        "data_repository": F.col("_repo"),
        "dataset_webpage": F.coalesce(valid_page(F.col("_page"), F.col("_repo"), F.col("_id"), entries), landing_page(F.col("_repo"), F.col("_id"), entries)),
        "access_mode": F.coalesce(F.col("_mode"), lookup(entries, F.col("_repo"), "access_mode")),
    })
    return done.drop("_page", "_mode", "_id", "_repo", "_own", "_known", "_found_page", "_candidate", "_given", *matched)
