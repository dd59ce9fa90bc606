"""Column functions over running text: sentences, chunks, budgets, repair of extracted text."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from refminer.functions.batches import mapped

ABBREVIATION = r"(?:^|\s)(?:e\.g|i\.e|Fig|Figs|et al|vs|Dr|Prof|cf|no|approx)\."
SENTENCE_END = rf"(?<=[.!?])(?<!{ABBREVIATION})\s+(?=[A-Z])"
CONTEXT_LIMITS = {"gpt": 128_000, "claude": 200_000, "gemini": 1_000_000}


def sentences(text: Column) -> Column:
    """Sentences; a break after an abbreviation is none."""
    return F.split(text, SENTENCE_END)


def sentences_with(text: Column, needle: Column) -> Column:
    """The sentences that contain needle, joined, with the needle's reference mark as 'this file'."""
    marked = F.replace(text, F.concat(F.lit("[rid="), needle, F.lit("]")), F.lit("this file"))
    return F.array_join(F.filter(F.split(marked, SENTENCE_END), lambda s: s.contains("this file") | s.contains(needle)), " ")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def over_token_limit(text: Column, family: Column, static_prompt: int = 400, reserve: int = 2000) -> Column:
    """Whether a text with one and a half static prompts exceeds the model family's context less a reserve."""
    limit = F.lit(None).cast("int")
    for name, size in CONTEXT_LIMITS.items():
        limit = F.coalesce(F.when(family == name, F.lit(size)), limit)
    return token_estimate(text) + 1.5 * static_prompt > F.coalesce(limit, F.lit(128_000)) - reserve


def character_chunks(text: Column, size: int, overlap: int) -> Column:
    """array<struct<chunk_id, start, text>> of stretches of size characters, each beginning overlap before the end of the one before."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, i: F.struct((i + 1).alias("chunk_id"), s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("text")))


def pack(pieces: Iterable[str], budget: int, cost: int = 4, glue: str = " ") -> list[str]:
    """Neighbouring pieces joined as long as their length over cost stays within budget; a longer piece is alone."""
    out: list[list[str]] = []
    size = 0
    for piece in pieces:
        if out and (size + len(piece) + len(glue)) // cost <= budget:
            out[-1].append(piece)
            size += len(piece) + len(glue)
        else:
            out.append([piece])
            size = len(piece)
    return [glue.join(p) for p in out]


def packed(pieces: Column, budget: int, cost: int = 4, glue: str = " ") -> Column:
    """pack() of an array of strings, in Arrow batches: a fold in an expression would copy the array at each step. A null gives none."""

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return mapped(column, lambda p: [] if p is None else pack([x for x in p if x is not None], budget, cost, glue), pa.list_(pa.string()))

    return run(pieces)


def pieces_of(paragraphs: list[str] | None, budget: int) -> list[str]:
    """Paragraphs, those over the budget (of tokens of four characters) as packed sentences."""
    return [c for p in paragraphs or [] if p is not None for c in ([p] if len(p) // 4 <= budget else pack(split_sentences(p), budget))]


def packed_paragraphs(paragraphs: Column, budget: int) -> Column:
    """The paragraphs of an array, those over the budget (of tokens of four characters) as packed sentences."""

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return mapped(column, lambda listed: pieces_of(listed, budget), pa.list_(pa.string()))

    return run(paragraphs)


_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])", re.A)
_SHORT = re.compile(rf"{ABBREVIATION}$", re.A)


def split_sentences(text: str) -> list[str]:
    """sentences() of one text."""
    out, first = [], 0
    for m in _END.finditer(text):
        if not _SHORT.search(text, max(0, m.start() - 16), m.start()):
            out.append(text[first : m.start()])
            first = m.end()
    return [*out, text[first:]]


def merge_line_breaks(text: Column) -> Column:
    """Text of a page with words hyphenated at a line end, broken addresses and soft line ends put together."""
    out = F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(out, r"(https?://\S+)\n(\S+)", "$1$2")
    return F.regexp_replace(out, r"([^\n.!?:])\n([^\n])", "$1 $2")


def section_headings(text: Column) -> Column:
    """Lines of one to eight words that open a section: numbered, in capitals, or a usual heading."""
    lines = F.split(text, "\n")
    known = r"(?i)^(abstract|introduction|background|methods?|materials and methods|results|discussion|conclusions?|references|acknowledge?ments|data availability.*|supplementary.*)$"
    return F.filter(lines, lambda x: x.rlike(known) | x.rlike(r"^\d+(\.\d+)*\.? [A-Z]\S*( \S+){0,7}$"))


def split_references(text: Column) -> Column:
    """Entries of a reference list: each begins with [n], n. or n) at a line's start."""
    return F.filter(F.transform(F.split(text, r"\n(?=\s*(?:\[\d+\]|\d+[.)])\s)"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def first_year(date: Column) -> Column:
    return F.try_to_number(F.substring(date, 1, 4), F.lit("9999")).cast("int")


def clean_words(text: Column) -> Column:
    """Lower-cased space-separated words of which only letters, digits, dashes and underscores are kept; empty ones go."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^a-z0-9_\-]", "")), lambda w: F.length(w) > 0)
