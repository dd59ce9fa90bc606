"""Secret scan: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from refminer.llm import batches

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/="
START = len(ALPHABET)
MIN_LENGTH = 16
#: Log-likelihood ratio, in nats, from which a string counts as random.
MIN_RATIO = 12.0
#: What an edge of a stretch costs, in nats, next to one of _-+/ outside it and elsewhere; at the ends of a run and next to = it is free.
JOINT, INSIDE = 3.0, 8.0
#: Characters whose scores are held as Python numbers at a time.
BLOCK = 1 << 16
#: Codes from here on are the signs _-+/=, which join strings.
SIGNS = ALPHABET.index("_")
PADDING = ALPHABET.index("=")

_CODE = np.full(256, -1, np.int64)
for _k, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _k

_SYLLABLES = (
    "the and for con pre pro sta ter ment tion ing ness able ver com dis inter over under work time data file name user list item code type "
    "get set add new old max min val key map row col tab str num len pos idx err log msg cfg doc img src dst tmp buf ptr ctx req res auth conn "
    "schau keit heit ung lich ver ge be ein aus auf zu ach sch berg stein haus wort zeit lang stadt eau eux ment elle ier oir tre que ou ai on "
    "cion dad mente ado eza illo ar er ir os as es de la un re di ma na po ti ra lo ca mi su hand that here with from this have thing ther ould "
    "ence ance ship full less ward wise like ough igh est ess ist ism ive ize ise ous ant ent al ic an en in th st nd nt ly ed er re ea ha he"
).split()


def labelled_samples(n: int = 4000, seed: int = 20) -> list[tuple[str, int]]:
    """n random strings (label 1: hexadecimal, base 64, base 62, upper-case keys) and n ordinary identifiers and words (label 0)."""
    rng = random.Random(seed)
    out: list[tuple[str, int]] = []
    kinds = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62] + "+/", ALPHABET[:62], ALPHABET[:62] + "_-", ALPHABET[26:62]]
    for _ in range(n):
        out.append(("".join(rng.choices(rng.choice(kinds), k=rng.randint(16, 64))), 1))
    for _ in range(n):
        words = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 5))]
        style = rng.randrange(6)
        if style == 0:
            text = "_".join(words)
        elif style == 1:
            text = "-".join(words)
        elif style == 2:
            text = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 3:
            text = "/".join(words)
        elif style == 4:
            text = "".join(words).upper()
        else:
            text = "".join(words)
        if rng.random() < 0.15:
            text += rng.choice(["", "_", "-"]) + str(rng.choice([1, 2, 10, 2024, 100, 64, 8, 256, 1999]))
        if rng.random() < 0.05:
            text = rng.choice("=-_/+") * rng.randint(3, 30)  # rules and fillers
        elif rng.random() < 0.1:
            text = "".join(rng.choices("0123456789", k=rng.randint(4, 24)))  # numbers of accounts, orders, articles
        out.append((text, 0))
    return out


def train(samples: Iterable[tuple[str, int]], smoothing: float = 0.5) -> np.ndarray:
    """Log-ratio of the two first-order models: [previous, next], START before the first character."""
    counts = np.full((2, START + 1, START), smoothing)
    for text, label in samples:
        previous = START
        for byte in text.encode():
            code = int(_CODE[byte])
            if code >= 0:
                counts[label, previous, code] += 1
                previous = code
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return np.asarray(logs[1] - logs[0])


@cache
def default_model() -> np.ndarray:
    return train(labelled_samples())


def ratios(data: np.ndarray, offsets: np.ndarray, model: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte, log-likelihood ratio) of the maximal runs of ALPHABET of at least min_length, rows not crossed."""
    n = len(data)
    codes = _CODE[data]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = codes >= 0
    edge = inside[1:] != inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[inside[cut] & inside[cut + 1]]  # a run that goes on in the next row ends here and begins anew
    bounds = np.sort(np.concatenate([np.flatnonzero(edge), np.unique(both), np.unique(both)]))
    first, end = bounds[0::2], bounds[1::2]
    keep = end - first >= min_length
    first, end = first[keep], end[keep]
    if not len(first):
        return first, first, end, np.zeros(0)
    lengths = end - first
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(first - starts, lengths) + np.arange(lengths.sum())
    previous = codes[at - 1]
    previous[starts] = START
    value = np.add.reduceat(model[previous, codes[at]], starts)
    return np.searchsorted(offsets, first, "right") - 1, first, end, value


def stretches(codes: np.ndarray, model: np.ndarray, min_length: int, min_ratio: float) -> list[tuple[int, int, float]]:
    """(first, end, log-likelihood ratio) of the stretches of a run without = that look random: of all sets of disjoint
    stretches of at least min_length, the one with the greatest sum of ratio - min_ratio - cost of both edges."""
    n = len(codes)
    if n < min_length:
        return []
    step = np.zeros(n)
    step[1:] = model[codes[:-1], codes[1:]]
    total = np.concatenate([[0.0], np.cumsum(step)])
    enter = model[START, codes] - total[1:]  # a stretch from i to j has the ratio enter[i] + total[j]
    sign = codes >= SIGNS
    enter_cost, leave_cost = np.zeros(n), np.zeros(n)
    enter_cost[1:] = np.where(sign[:-1], JOINT, INSIDE)
    leave_cost[:-1] = np.where(sign[1:], JOINT, INSIDE)
    shortest = np.full(n, -np.inf)  # the gain of the shortest stretch that ends here
    shortest[min_length - 1 :] = (enter - enter_cost)[: n - min_length + 1] + total[min_length:] - min_ratio
    opened = np.full(n + 1, -1)
    recent = [0.0] * min_length  # the best sums up to each of the last min_length places
    best, inside, since, j = 0.0, -np.inf, 0, 0
    for block in range(0, n, BLOCK):
        part = slice(block, block + BLOCK)
        for more, first, cost in zip(step[part].tolist(), shortest[part].tolist(), leave_cost[part].tolist(), strict=True):
            j += 1
            inside += more
            value = recent[j % min_length] + first
            if value > inside:
                inside, since = value, j - min_length
            if inside - cost >= best:
                best = inside - cost
                opened[j] = since
            recent[j % min_length] = best
    out, j = [], n
    while j > 0:
        i = int(opened[j])
        if i >= 0:
            out.append((i, j, float(enter[i] + total[j])))
        j = i if i >= 0 else j - 1
    return out[::-1]


def in_run(codes: np.ndarray, whole: float, model: np.ndarray, min_length: int, min_ratio: float) -> list[tuple[int, int, float]]:
    """The stretches of a run that look random, = only after them, as padding; the run itself if it does and no stretch of it."""
    out = []
    begin, n = 0, len(codes)
    for cut in [*np.flatnonzero(codes == PADDING).tolist(), n]:
        for first, end, value in stretches(codes[begin:cut], model, min_length, min_ratio):
            end += begin
            if end == cut and n - end <= 2 and (codes[end:] == PADDING).all():
                end = n
            out.append((begin + first, end, value))
        begin = cut + 1
    return out or ([(0, n, whole)] if whole >= min_ratio else [])


def find(data: np.ndarray, offsets: np.ndarray, model: np.ndarray, min_length: int, min_ratio: float) -> list[tuple[int, int, int, float]]:
    """(row, first byte, end byte, log-likelihood ratio) of all stretches that look random, in order."""
    row, first, end, whole = ratios(data, offsets, model, min_length)
    if not len(first):
        return []
    # the greatest ratio of any stretch of each run, edges free: most runs have none that is high enough
    lengths = end - first
    starts = np.cumsum(lengths) - lengths
    run = np.repeat(np.arange(len(first)), lengths)
    at = np.arange(len(run)) - starts[run] + first[run]
    codes = _CODE[data[at]]
    steps = np.zeros(len(at))
    steps[1:] = model[codes[:-1], codes[1:]]
    total = np.cumsum(steps)
    before = total - model[START, codes]
    below = run * (np.ptp(total) + np.ptp(before) + abs(total[0] - before[0]) + 1)  # the least of one run lies under all of the run before
    least = np.minimum.accumulate(before - below) + below
    most = np.maximum.reduceat(total - least, starts)
    out = []
    for k in np.flatnonzero((most >= min_ratio - 1e-3) | (whole >= min_ratio)).tolist():
        a = int(first[k])
        out += [(int(row[k]), a + i, a + j, v) for i, j, v in in_run(codes[starts[k] : starts[k] + lengths[k]], float(whole[k]), model, min_length, min_ratio)]
    return out


def scan_secrets(docs: DataFrame, model: np.ndarray | None = None, min_length: int = MIN_LENGTH, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per string that looks random: doc_id, start and end (characters of the text, end excluded), log_ratio.

    Strings are stretches, of at least min_length characters, of the maximal runs of letters, digits and _-+/=, over the
    whole text; what a key is joined to (NAME=, a path) doesn't count against it, and one run may have several. Null and
    empty texts have none; a null doc_id stays null; repeated rows each give their rows; other columns are ignored.
    """
    table = default_model() if model is None else model

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("doc_id")
            data, offsets = batches.text_buffers(part.column("text"))
            rows, starts, ends, values = [], [], [], []
            for top, _, chunk, offs in batches.chunks(data, offsets):
                for r, a, b, v in find(chunk, offs, table, min_length, min_ratio):
                    begin = int(np.count_nonzero((chunk[offs[r] : a] & 0xC0) != 0x80))
                    rows.append(top + r)
                    starts.append(begin)
                    ends.append(begin + b - a)
                    values.append(v)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(values, pa.float64())], ["doc_id", "start", "end", "log_ratio"])

    return batches.with_doc_columns(docs).mapInArrow(search, "doc_id bigint, start bigint, end bigint, log_ratio double")
