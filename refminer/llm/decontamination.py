"""Benchmark decontamination by Wu-Manber search for many patterns at once.

The symbols are words (runs of letters, digits and non-ASCII characters of the lower-cased text), the patterns are all
runs of 13 words of the benchmark items; an item of fewer words is one pattern. A block is two words. The shift table
tells for each block hash how far the window may move, so most words are never looked at; where it says zero the block's
hash selects the patterns that end in it, and the words themselves are compared. Text and pattern windows advance in
numpy, many places of a chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refminer.llm import batches

NGRAM = 13
TABLE_BITS = 20
SEGMENT = 96
#: Items of fewer words are not searched for, unless the caller asks for them.
MIN_WORDS = 3
#: Characters of benchmark items that are collected, compiled and broadcast at a time; more items take more passes.
BLOCK_CHARS = 1 << 25


def _block(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (batches.mix(left * np.uint64(0x9FB21C651E98DF25) + right) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class WuManber:
    """Patterns of m words; add() them, then build(). A pattern is known by its item's place in the list of items and its first word there."""

    def __init__(self, m: int) -> None:
        self.m = m
        self.patterns: list[np.ndarray] = []
        self.owner: list[tuple[int, int]] = []

    def add(self, words: np.ndarray, owner: tuple[int, int]) -> None:
        self.patterns.append(words)
        self.owner.append(owner)

    def build(self) -> WuManber:
        m = self.m
        heads = np.stack([p[:m] for p in self.patterns])
        self.patterns = []
        if m == 1:  # no block of two words: the words themselves are looked up
            self.order = np.argsort(heads[:, 0], kind="stable")
            self.blocks, self.first = np.unique(heads[self.order, 0], return_index=True)
            self.stop = np.append(self.first[1:], len(heads))
            return self
        self.shift = np.full(1 << TABLE_BITS, m - 1, np.uint8 if m <= 256 else np.int64)
        for end in range(1, m):
            np.minimum.at(self.shift, _block(heads[:, end - 1], heads[:, end]), m - 1 - end)
        last = _block(heads[:, m - 2], heads[:, m - 1])
        order = np.argsort(last, kind="stable")
        self.heads, self.order = heads[order], order
        self.blocks, self.first = np.unique(last[order], return_index=True)
        self.stop = np.append(self.first[1:], len(order))
        return self

    def search(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, pattern) of all places where all m words of a pattern's head agree, rows not crossed."""
        m = self.m
        if m == 1:
            slot = np.minimum(np.searchsorted(self.blocks, words), len(self.blocks) - 1)
            place = np.flatnonzero(self.blocks[slot] == words)
            n = (self.stop - self.first)[slot[place]]
            which = np.repeat(self.first[slot[place]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return np.repeat(place, n), self.order[which]
        counts = np.maximum(np.diff(bounds) - m + 1, 0)
        parts = -(-counts // SEGMENT)
        row = np.repeat(np.arange(len(counts)), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = bounds[row] + nth * SEGMENT + m - 1
        end = np.minimum(at + SEGMENT, bounds[row + 1])
        found_at, found = [], []
        while len(at):
            block = _block(words[at - 1], words[at])
            step = self.shift[block].astype(np.int64)
            zero = np.flatnonzero(step == 0)
            if len(zero):
                slot = np.minimum(np.searchsorted(self.blocks, block[zero]), len(self.blocks) - 1)
                hit = self.blocks[slot] == block[zero]
                place, slot = at[zero[hit]], slot[hit]
                n = self.stop[slot] - self.first[slot]
                place = np.repeat(place, n)
                which = np.repeat(self.first[slot], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
                for k in range(m - 1, -1, -1):  # from the suffix on, most places are out after a word or two
                    same = words[place - (m - 1 - k)] == self.heads[which, k]
                    place, which = place[same], which[same]
                    if not len(place):
                        break
                if len(place):
                    found_at.append(place - m + 1)
                    found.append(self.order[which])
                step[zero] = 1
            at = at + step
            alive = at < end
            at, end = at[alive], end[alive]
        return (np.concatenate(found_at), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _row_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [data[a:b].tobytes().lower() for a, b in zip(start, end, strict=True)]


class Searchers:
    """What is sent to the tasks: the words of all items once, and a searcher for the runs of n words and for each length of shorter items."""

    def __init__(self, items: list[tuple[int, str]], n: int = NGRAM, min_words: int = MIN_WORDS) -> None:
        """items: (item id, lower-cased text)"""
        data, offsets = batches.text_buffers(pa.array([text for _, text in items], pa.large_string()))
        start, end, hashes, bounds = batches.words(data, offsets)
        self.ids = [item for item, _ in items]
        self.words = [_row_words(data, start[a:b], end[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        found: dict[int, WuManber] = {}
        for k, own in enumerate(self.words):
            m = min(n, len(own))
            if m < max(min_words, 1):
                continue
            for offset in range(len(own) - m + 1):
                at = int(bounds[k]) + offset
                found.setdefault(m, WuManber(m)).add(hashes[at : at + m], (k, offset))
        self.searchers = [s.build() for s in found.values()]

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item's place, first word, words) of every occurrence."""
        data, offsets = batches.text_buffers(column)
        for first, _, chunk, offs in batches.chunks(data, offsets):
            start, end, hashes, bounds = batches.words(chunk, offs)
            for s in self.searchers:
                places, found = s.search(hashes, bounds)
                for place, pattern in zip(places.tolist(), found.tolist(), strict=True):
                    k, offset = s.owner[pattern]
                    if _row_words(chunk, start[place : place + s.m], end[place : place + s.m]) == self.words[k][offset : offset + s.m]:
                        row = int(np.searchsorted(bounds, place, "right")) - 1
                        yield first + row, k, place - int(bounds[row]), s.m


def _compiled(benchmark: DataFrame, n: int, min_words: int) -> Iterator[Any]:
    """Searchers, broadcast, for blocks of items of about BLOCK_CHARS characters each; a longer item is a block by itself or with a few others."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")).filter("item_id is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for block in range(blocks):
        listed = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Searchers(sorted((int(r[0]), str(r[1])) for r in listed), n, min_words))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document and benchmark item that share a run of n words: doc_id, item_id, n_hits (pairs of a place in
    the document and a place in the item), first_word and last_word (of the outermost hits, counted from 0).

    Items of min_words to n - 1 words are searched for as a whole, shorter ones never. Null texts and items have no words;
    a null item_id is left out, a null doc_id stays null. Each of several rows with the same doc_id gives its own rows;
    items with equal ids count as one. An empty benchmark gives no row. Other columns are ignored. The benchmark is
    collected and compiled on the driver in blocks of BLOCK_CHARS characters, each of which takes one pass over docs.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    kind = "doc_id bigint, item_id bigint, n_hits bigint, first_word bigint, last_word bigint"

    def searching(shared: Any) -> Any:
        def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                hits: dict[tuple[int, int], list[int]] = {}
                for row, k, at, m in shared.value.search(part.column("text")):
                    h = hits.setdefault((row, shared.value.ids[k]), [0, at, at])
                    h[0] += 1
                    h[1] = min(h[1], at)
                    h[2] = max(h[2], at + m - 1)
                ids = part.column("doc_id").take(pa.array([row for row, _ in hits], pa.int64()))
                rest = list(zip(*((item, *h) for (_, item), h in hits.items()), strict=True)) if hits else [[]] * 4
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in rest]], ["doc_id", "item_id", "n_hits", "first_word", "last_word"])

        return search

    found = None
    for shared in _compiled(benchmark, n, min_words):
        own = source.mapInArrow(searching(shared), kind)
        found = own if found is None else found.unionByName(own)
    return docs.sparkSession.createDataFrame([], kind) if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the rows whose text shares a run of words with an item, as find_overlaps would report; all columns stay.

    Each row is judged by its own text: of rows with the same doc_id, or a null one, those without a run stay. Rows are
    dropped where they are read, nothing is shuffled. Null and empty texts stay.
    """
    columns, text = docs.columns, "_lower"
    while text in columns:
        text += "_"

    def dropping(shared: Any) -> Any:
        def drop(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                keep = np.ones(len(part), bool)
                keep[list({row for row, *_ in shared.value.search(part.column(len(columns)))})] = False
                yield pa.RecordBatch.from_arrays(part.columns[:-1], columns).filter(pa.array(keep))

        return drop

    for shared in _compiled(benchmark, n, min_words):
        docs = docs.withColumn(text, F.lower(docs["text"].cast("string"))).mapInArrow(dropping(shared), docs.schema)
    return docs


def overlaps_sql(n: int = NGRAM) -> str:
    """find_overlaps over the tables documents and benchmark, for DuckDB, by an equi-join of word runs."""
    words = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
    p AS (SELECT item_id, least({n}, len(w)) AS m, unnest(range(1, CAST(len(w) - least({n}, len(w)) + 2 AS BIGINT))) AS i, w FROM b WHERE len(w) >= {MIN_WORDS}),
    pat AS (SELECT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM p),
    ms AS (SELECT DISTINCT m FROM pat),
    t AS (SELECT r, doc_id, m, w, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM d CROSS JOIN ms WHERE len(w) >= m),
    grams AS (SELECT r, doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM t)
    SELECT doc_id, item_id, count(*) AS n_hits, CAST(min(i) - 1 AS BIGINT) AS first_word, CAST(max(i + pat.m - 2) AS BIGINT) AS last_word
    FROM grams JOIN pat ON grams.m = pat.m AND grams.g = pat.g GROUP BY r, doc_id, item_id
    """
