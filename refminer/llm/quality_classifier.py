"""Quality classifier: ordinal regression with a cumulative logit link over hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector shared by all grades and ordered thresholds. x holds the
hashed words that occur (once each, so a few telling words count in a long text too), the frequencies of character-class
triples (letter case, digits, punctuation, symbols), and binned repetition measures. All of a text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refminer.llm import batches

WORD_BITS = 16
TRIPLES = 512
BINS = 16
DIM = (1 << WORD_BITS) + TRIPLES + 2 * BINS
#: At most so many labelled documents are fitted on, those with the smallest hashes of doc_id.
MAX_LABELLED = 6000
MIN_DOCS = 4
#: Least probability of the best grade to be kept: about one clean document in 200 falls below it in held-out ratings.
MIN_TAIL = 0.8


def _classes() -> np.ndarray:
    out = np.full(256, 7, np.int64)
    for code in range(256):
        c = chr(code)
        if code >= 128 or c.islower():
            out[code] = 0
        elif c.isupper():
            out[code] = 1
        elif c.isdigit():
            out[code] = 2
        elif c in "\n\r":
            out[code] = 4
        elif c.isspace():
            out[code] = 3
        elif c in ".,;:?'\"()-":
            out[code] = 5
        elif code > 32:
            out[code] = 6
    return out


_CLASS = _classes()


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, index, value, rows) entries of runs of rows, sorted by row; the rows of a run start at 0."""
    data, offsets = batches.text_buffers(column)
    for first, last, part, offs in batches.chunks(data, offsets):
        rows = last - first
        _, _, hashes, bounds = batches.words(part, offs)
        counts = np.diff(bounds)
        row = np.repeat(np.arange(rows), counts)
        present = np.unique((row << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64))
        distinct = np.bincount(present >> WORD_BITS, minlength=rows)
        again = np.zeros(rows)
        if len(hashes) > 1:
            again = np.bincount(row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=rows)
        kind = _CLASS[part]
        lengths = np.diff(offs)
        dense = np.zeros((rows, TRIPLES), np.float32)
        if len(part) > 2:
            owner = np.repeat(np.arange(rows), lengths)
            same = owner[2:] == owner[:-2]
            code = owner[2:] * TRIPLES + (kind[:-2] << 6 | kind[1:-1] << 3 | kind[2:])
            dense = np.bincount(code[same], minlength=rows * TRIPLES).reshape(rows, TRIPLES).astype(np.float32)
        dense = np.log1p(100 * dense / np.maximum(lengths, 1)[:, None]).astype(np.float32)
        t_row, t_col = np.nonzero(dense)
        share = lambda x: np.minimum((x / np.maximum(counts, 1) * BINS).astype(np.int64), BINS - 1)
        base = 1 << WORD_BITS
        # a short text has a high share of distinct words whatever it is: its bin is that of texts without repetition
        variety = np.where(counts < 20, BINS - 1, share(distinct * 1.0))
        ids = np.arange(rows)
        row_all = np.concatenate([present >> WORD_BITS, t_row, ids, ids])
        index = np.concatenate([present & (base - 1), base + t_col, base + TRIPLES + variety, base + TRIPLES + BINS + share(again)])
        value = np.concatenate([np.ones(len(present), np.float32), dense[t_row, t_col], np.ones(2 * rows, np.float32)])
        order = np.argsort(row_all, kind="stable")
        yield row_all[order], index[order], value[order], rows


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def latent(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(row, self.weights[index] * value, minlength=rows)

    def probabilities(self, latent: np.ndarray) -> np.ndarray:
        """rows x grades."""
        upto = 1 / (1 + np.exp(np.clip(latent[:, None] - self.thresholds[None, :], -30, 30)))
        edges = np.concatenate([np.zeros((len(latent), 1)), upto, np.ones((len(latent), 1))], axis=1)
        return np.diff(edges, axis=1)


def fit(row: np.ndarray, index: np.ndarray, value: np.ndarray, grades: np.ndarray, levels: int, steps: int = 250, rate: float = 0.05, l2: float = 1e-3) -> OrdinalModel:
    """Maximum likelihood with a quadratic penalty, by Adam over all rows at once; words in fewer than MIN_DOCS rows get no weight."""
    n = len(grades)
    seen = np.bincount(index, minlength=DIM) >= MIN_DOCS
    keep = seen[index]
    row, index, value = row[keep], index[keep], value[keep]
    used, local = np.unique(index, return_inverse=True)
    share = np.cumsum(np.bincount(grades, minlength=levels)[:-1] + 0.5) / (n + 0.5 * levels)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    params = np.concatenate([np.zeros(len(used)), first[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    k = len(used)
    at = np.arange(n)
    for step in range(1, steps + 1):
        thresholds = np.concatenate([params[k : k + 1], params[k] + np.cumsum(np.exp(params[k + 1 :]))])
        latent = np.bincount(row, params[local] * value, minlength=n)
        upto = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(latent[:, None] - thresholds, -30, 30))), np.ones((n, 1))], axis=1)
        density = upto * (1 - upto)
        p = np.maximum(upto[at, grades + 1] - upto[at, grades], 1e-9)
        d_latent = (density[at, grades + 1] - density[at, grades]) / p / n
        d_upper, d_lower = -density[at, grades + 1] / p / n, density[at, grades] / p / n
        d_threshold = np.bincount(grades, d_upper, levels)[: levels - 1] + np.bincount(grades, d_lower, levels)[1:]
        grad = np.empty_like(params)
        grad[:k] = np.bincount(local, d_latent[row] * value, minlength=k) + l2 * params[:k]
        grad[k] = d_threshold.sum()
        grad[k + 1 :] = np.cumsum(d_threshold[::-1])[::-1][1:] * np.exp(params[k + 1 :])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIM)
    weights[used] = params[:k]
    return OrdinalModel(weights, np.concatenate([params[k : k + 1], params[k] + np.cumsum(np.exp(params[k + 1 :]))]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: one point for quality and one for not being toxic; of several ratings the lowest. Rows with a null are left out."""
    grade = (F.col("quality") + 1 - F.col("toxic")).cast("int")
    return labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, levels: int = 3, max_labelled: int = MAX_LABELLED) -> OrdinalModel | None:
    """ratings has doc_id and grade (0 ... levels - 1). None if no document is rated.

    The max_labelled ratings with the smallest hashes are used; their ids, a bounded table, are broadcast to the scan, and
    only hashed features come to the driver. A doc_id that several rows share adds each of them.
    """
    chosen = ratings.select("doc_id", "grade").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rated = batches.with_doc_columns(docs).join(F.broadcast(chosen), "doc_id")

    def extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            index_blobs, value_blobs = [], []
            for row, index, value, rows in features(part.column("text")):
                edges = np.searchsorted(row, np.arange(rows + 1))
                for r in range(rows):
                    index_blobs.append(index[edges[r] : edges[r + 1]].astype(np.int32).tobytes())
                    value_blobs.append(value[edges[r] : edges[r + 1]].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), pa.array(index_blobs, pa.binary()), pa.array(value_blobs, pa.binary())], ["doc_id", "grade", "idx", "val"])

    table = rated.select("doc_id", "text", "grade").mapInArrow(extract, "doc_id bigint, grade int, idx binary, val binary").toPandas()
    if not len(table):
        return None
    table = table.sort_values(["doc_id", "idx", "val"])  # the same order, so the same model, however tasks end
    idx = [np.frombuffer(x, np.int32) for x in table["idx"]]
    row = np.repeat(np.arange(len(table)), [len(x) for x in idx])
    value = np.concatenate([np.frombuffer(x, np.float32) for x in table["val"]]).astype(np.float64)
    return fit(row, np.concatenate(idx).astype(np.int64), value, np.clip(table["grade"].to_numpy(np.int64), 0, levels - 1), levels)


def _tails(column: pa.Array, model: OrdinalModel) -> np.ndarray:
    """Probabilities of the grades, rows x grades."""
    latent = np.concatenate([model.latent(*x) for x in features(column)] or [np.zeros(0)])
    return model.probabilities(latent)


def score(docs: DataFrame, model: OrdinalModel | None, min_tail: float = MIN_TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the best grade) and keep (tail_probability >= min_tail) of every row.

    Null and empty texts are scored as texts without words, a null doc_id stays null, repeated rows are scored each for
    itself, other columns are ignored. Without a model the scores are null and everything is kept.
    """
    chosen = batches.with_doc_columns(docs)
    if model is None:
        return chosen.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("keep"))
    weights, thresholds = model.weights.astype(np.float32), model.thresholds

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(weights, thresholds)
        for part in parts:
            p = _tails(part.column("text"), own)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, -1]), pa.array(p[:, -1] >= min_tail)], ["doc_id", "expected_grade", "tail_probability", "keep"])

    return chosen.mapInArrow(judge, "doc_id bigint, expected_grade double, tail_probability double, keep boolean")


def select_quality(docs: DataFrame, model: OrdinalModel | None, min_tail: float = MIN_TAIL) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns."""
    if model is None:
        return docs
    weights, thresholds = model.weights.astype(np.float32), model.thresholds
    at = docs.columns.index("text")

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(weights, thresholds)
        for part in parts:
            yield part.filter(pa.array(_tails(part.column(at), own)[:, -1] >= min_tail))

    return docs.mapInArrow(pick, docs.schema)


def classify_quality(docs: DataFrame, rated_docs: DataFrame, labels: DataFrame, min_tail: float = MIN_TAIL) -> DataFrame:
    """Train on the rated documents of rated_docs and score docs."""
    return score(docs, train(rated_docs, graded(labels)), min_tail)
