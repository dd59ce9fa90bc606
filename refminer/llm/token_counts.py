"""Token counts by greedy longest match, in linear time, without building the pieces.

The vocabulary is a trie with failure links. A node that is a whole piece pops that piece and fails to the root; any
other node pops the pieces that greedy matching settles on before it must give up the node's string, and fails to the
node of what is then left. Only how many pieces are popped is stored, so counting a word is a walk with additions. A
word ends with the symbol END, which pieces for word ends contain.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from refminer.llm import batches

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 256
WIDTH = 257
CACHE_WORDS = 300_000
_SPACE = regex.compile(r"\s+")
_SPLIT = regex.compile(r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str, suffix: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a tokenizer file as tuples of byte values, END last where the piece ends a word."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    symbols, out = _byte_symbols(), []
    for name in names:
        stem = name.removesuffix(suffix)
        if stem and all(c in symbols for c in stem):
            out.append(tuple(symbols[c] for c in stem) + ((END,) if stem != name else ()))
    return out


@dataclass
class Automaton:
    """keys (node * WIDTH + symbol, sorted) and children give the trie; failure (-1: none) and popped are per node."""

    keys: np.ndarray
    children: np.ndarray
    failure: np.ndarray
    popped: np.ndarray

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node * WIDTH + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; a word that the vocabulary can't spell is one piece."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        node, total, dead = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        order = np.argsort(-lengths, kind="stable")
        reach = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0)) + 1), "right")
        for k in range(int(lengths.max(initial=0)) + 1):
            live = order[: reach[k]]  # words of at least k bytes; those of k bytes take END now
            symbol = np.full(len(live), END)
            more = lengths[live] > k
            symbol[more] = data[starts[live[more]] + k]
            while len(live):
                to = self.step(node[live], symbol)
                ok = to >= 0
                node[live[ok]] = to[ok]
                live, symbol = live[~ok], symbol[~ok]
                total[live] += self.popped[node[live]]
                node[live] = self.failure[node[live]]
                lost = node[live] < 0
                dead[live[lost]] = True
                node[live[lost]] = 0
                live, symbol = live[~lost], symbol[~lost]
            # a lost word goes on from the root, its count is replaced below
        live = np.flatnonzero((node > 0) & ~dead)
        while len(live):
            total[live] += self.popped[node[live]]
            node[live] = self.failure[node[live]]
            dead[live[node[live] < 0]] = True
            live = live[node[live] > 0]
        return np.where(dead, 1, total)


def build(pieces: Iterable[tuple[int, ...]]) -> Automaton:
    children: list[dict[int, int]] = [{}]
    whole: list[bool] = [False]
    parent, edge = [-1], [-1]
    for piece in pieces:
        node = 0
        for symbol in piece:
            following = children[node].get(symbol)
            if following is None:
                following = len(children)
                children[node][symbol] = following
                children.append({})
                whole.append(False)
                parent.append(node)
                edge.append(symbol)
            node = following
        if node:
            whole[node] = True
    failure, popped = [-1] * len(children), [0] * len(children)
    level = [0]
    while level:
        following_level = []
        for node in level:
            for symbol, child in children[node].items():
                following_level.append(child)
                if whole[child]:
                    failure[child], popped[child] = 0, 1
                    continue
                z, count = failure[node], popped[node]
                while z >= 0 and symbol not in children[z]:
                    count += popped[z]
                    z = failure[z]
                if z >= 0:
                    failure[child], popped[child] = children[z][symbol], count
        level = following_level
    keys = np.array([node * WIDTH + symbol for node, kids in enumerate(children) for symbol in kids], np.int64)
    values = np.array([child for kids in children for child in kids.values()], np.int64)
    order = np.argsort(keys)
    return Automaton(keys[order], values[order], np.array(failure, np.int64), np.array(popped, np.int64))


def split_words(text: str) -> list[str]:
    """Contractions, runs of letters, single digits and runs of other characters of the lower-cased text."""
    return list(_SPLIT.findall(text.lower()))


def spaced(text: str) -> list[str]:
    """text split at white space as _SPLIT sees it: \\x1c to \\x1f, at which str.split splits too, are characters like others."""
    return [p for p in _SPACE.split(text) if p] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


class Counter:
    """Counts tokens of texts; keeps the counts of up to CACHE_WORDS space-separated strings met before."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.seen: dict[str, int] = {}

    def _learn(self, strings: list[str]) -> None:
        words, owner = [], []
        for k, s in enumerate(strings):
            found = _SPLIT.findall(s)
            words += [w.encode() for w in found]
            owner += [k] * len(found)
        counts = np.bincount(owner, self.automaton.count(words), minlength=len(strings)) if words else np.zeros(len(strings))
        self.seen.update(zip(strings, counts.astype(np.int64).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        split = [spaced((text or "").lower()) for text in texts]
        new: set[str] = set()
        for parts in split:
            new.update(parts)
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        missing = list(new.difference(self.seen))
        if missing:
            self._learn(missing)
        get = self.seen.__getitem__
        return [sum(map(get, parts)) for parts in split]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row, over its whole text; vocabulary is the path of a tokenizer file.

    Null and empty texts have 0 tokens, a null doc_id stays null, repeated rows are counted each for itself, other columns
    are ignored. The automaton's arrays (a few MB, given by the vocabulary) are broadcast.
    """
    automaton = build(read_vocabulary(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((automaton.keys, automaton.children, automaton.failure, automaton.popped))

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Automaton(*shared.value))
        for part in parts:
            column = part.column("text")
            counts: list[int] = []
            _, offsets = batches.text_buffers(column)
            row = 0
            while row < len(column):
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 2 * batches.CHUNK_BYTES, "right")) - 1)
                counts += counter.count(column.slice(row, end - row).to_pylist())
                row = end
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return batches.with_doc_columns(docs).mapInArrow(tally, "doc_id bigint, n_tokens bigint")
