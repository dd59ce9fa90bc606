"""Finding the parts of documents that matter: identifier patterns, vector similarity, and both together."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from refminer.functions.batches import pieces
from refminer.operators import ontology


def any_identifier(text: Column, source: Any = None) -> Column:
    """Whether a text has an identifier of any repository: one pattern, one pass over the words that can have one."""
    patterns = [p for _, p in ontology.search_patterns(source)]
    return _searched(text, patterns).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def _within_words(pattern: str) -> bool:
    """Whether whatever a pattern matches has no white space, so that it can be looked for word by word."""
    plain = re.sub(r"\\[.\-/:]|\[\^\\s\]|\\[wdb]|\(\?[:i!=<]+", "", pattern)
    return not re.search(r"[\s.\\]|\[\^", plain)


def _has_digit(parsed: Any) -> bool:
    """Whether whatever a parsed pattern matches has a digit; False where that isn't plain."""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL" and 48 <= value <= 57:
            return True
        if name == "IN" and all((str(o), v) in (("CATEGORY", re._constants.CATEGORY_DIGIT),) or (str(o) == "RANGE" and v[0] >= 48 and v[1] <= 57) or (str(o) == "LITERAL" and 48 <= v <= 57) for o, v in value):  # type: ignore[attr-defined]
            return True
        if name == "SUBPATTERN" and _has_digit(value[-1]):
            return True
        if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0 and _has_digit(value[2]):
            return True
        if name == "BRANCH" and all(map(_has_digit, value[1])):
            return True
    return False


def _needs_digit(pattern: str) -> bool:
    try:
        return _has_digit(re._parser.parse(pattern))  # type: ignore[attr-defined]
    except re.error:
        return False


def within_words_with_digits(pattern: str) -> bool:
    return _within_words(pattern) and _needs_digit(pattern)


def _searched(text: Column, patterns: list[str]) -> Column:
    """What of a text the patterns have to be looked for in: where all of them match within words and with a digit, its words with a digit."""
    if all(map(within_words_with_digits, patterns)):
        return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: w.rlike("[0-9]")), " ")
    return text


def identifier_mentions(docs: DataFrame, text: str = "text", source: Any = None) -> DataFrame:
    """docs' other columns, repo and mention of every identifier in a text, in the ontology's order; repeats stay.

    One pass over a text finds the words that can have an identifier; single patterns are searched for in these alone.
    """
    patterns = ontology.search_patterns(source)
    plain = [p for _, p in patterns]

    def hits_of(where: Column, repo: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(where, F.lit(f"(?i)({pattern})"), F.lit(1)), lambda m: F.struct(F.lit(repo).alias("repo"), m.alias("mention")))

    def found(where: Column) -> Column:
        return F.when(where.rlike("(?i)" + "|".join(f"(?:{p})" for p in plain)), F.concat(*[hits_of(where, repo, p) for repo, p in patterns]))

    if all(map(_within_words, plain)) and not all(map(_needs_digit, plain)):
        where = F.array_join(F.filter(F.split(F.col(text), r"\s+"), lambda w: any_identifier(w, source)), " ")
    else:
        where = _searched(F.col(text), plain)
    # as the one element of an array it is computed once for all patterns; a filter would be pushed down and repeat it
    hits = docs.withColumn("_m", F.explode(F.flatten(F.transform(F.array(where), found))))
    return hits.select(*[c for c in docs.columns if c != text], "_m.repo", "_m.mention")


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, summed in their order as doubles."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def _vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """k and v, the vector as bytes of doubles, of the rows with both."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = part.column("v")
            ends, flat = own.offsets.to_numpy(), own.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["k", "v"])

    chosen = rows.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and size(v) > 0")
    return chosen.mapInArrow(pack, "k bigint, v binary")


class _Best:
    """The k nearest vectors so far of each of some queries; ties by id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k, self.squares = ids, q, k, (q * q).sum(1)
        self.found = [(np.empty(0, np.int64), np.empty(0)) for _ in range(0, len(q), _TILE)]
        self.rows = [np.empty(0, np.int64) for _ in self.found]
        self.last = np.full(len(q), np.inf)

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        squares = (v * v).sum(1)
        for t, first in enumerate(range(0, len(self.q), _TILE)):
            q, last = self.q[first : first + _TILE], self.last[first : first + _TILE]
            rough = q @ v.T
            rough *= -2
            rough += self.squares[first : first + _TILE, None]
            rough += squares
            if np.isinf(last).any() and len(ids) > self.k:
                last = np.minimum(last, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
            most = last + 1e-6 * (1 + np.abs(np.where(np.isinf(last), 0, last)))
            at, what = np.nonzero(rough <= most[:, None])
            if not len(at):
                continue
            # the products only pick; distances are sums of squared differences, in order
            exact = np.concatenate([np.cumsum((v[what[n : n + _TILE]] - q[at[n : n + _TILE]]) ** 2, axis=1)[:, -1] for n in range(0, len(at), _TILE)])
            old_ids, old = self.found[t]
            at, what, exact = np.concatenate([self.rows[t], at]), np.concatenate([old_ids, ids[what]]), np.concatenate([old, exact])
            order = np.lexsort((what, exact, at))
            at, what, exact = at[order], what[order], exact[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            best = place < self.k
            self.rows[t], self.found[t] = at[best], (what[best], exact[best])
            full = place == self.k - 1
            self.last[first + at[full]] = exact[full]

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for t, (ids, exact) in enumerate(self.found):
            yield self.ids[t * _TILE + self.rows[t]], ids, exact


#: Queries, and vectors, of one matrix product; bytes of the queries that a task holds; rows that make a part worth a task.
_TILE, _HELD, _LEAST = 1024, 32 << 20, 1024


def _parts(n: int, dims: int, tasks: int) -> int:
    return max(1, -(-n * dims * 8 // _HELD), min(math.ceil(math.sqrt(tasks)), -(-n // _LEAST)))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", query_key: str = "query_id", block: int = 1024) -> DataFrame:
    """query_key, key, distance (squared) and rank of the k nearest rows of corpus to each row of queries; ties by key.

    Both sides are counted and divided into parts; each pair of parts is a task. It holds its queries (32 MB at most) with the k
    best of each so far, and the corpus's vectors stream past in blocks: a matrix product a block, of which only what beats a
    query's k-th best is looked at. A row is sent to as many tasks as the other side has parts, about the square root of the
    tasks, and k rows a query and task are shuffled. The work is the product of both sides, since the search is exact. Rows
    without a vector or key take no part. Vectors are of one length.
    """
    left, right = _vectors(queries, query_key, vector), _vectors(corpus, key, vector)
    tasks = 3 * corpus.sparkSession.sparkContext.defaultParallelism
    known = lambda rows, name: rows.filter(F.col(name).isNotNull() & (F.size(vector) > 0)).agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    (n, dims), (m, _) = known(queries, query_key), known(corpus, key)
    across, down = _parts(n, dims, tasks), _parts(m, dims, tasks)

    def dealt(rows: DataFrame, own: int, other: int, place: Any, side: int) -> DataFrame:
        """The rows once for each task that needs them."""
        mine = F.pmod(F.xxhash64("k", "v"), F.lit(own)).cast("int")
        return rows.withColumn("own", mine).select(F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("o"), "own", "k", "v").select(place(F.col("own"), F.col("o")).alias("task"), F.lit(side).alias("side"), "k", "v")

    both = dealt(left, across, down, lambda own, other: own * down + other, 0).unionByName(dealt(right, down, across, lambda own, other: other * down + own, 1))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said(best: _Best | None) -> Iterator[pa.RecordBatch]:
            for columns in best.batches() if best else ():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [query_key, key, "distance"])

        task, asked, best = -1, [], None
        for part in parts:
            tasks, sides, ids = (part.column(c).to_numpy() for c in ("task", "side", "k"))
            for one in np.unique(tasks):  # sorted, queries first
                for side in (0, 1):
                    rows = np.flatnonzero((tasks == one) & (sides == side))
                    if one != task:
                        yield from said(best)
                        task, asked, best = one, [], None
                    for first in range(0, len(rows), block):
                        some = rows[first : first + block]
                        v = np.frombuffer(b"".join(part.column("v").slice(some[0], len(some)).to_pylist())).reshape(len(some), -1)
                        if side == 0:
                            asked.append((ids[some], v))
                            continue
                        if best is None and asked:
                            best = _Best(np.concatenate([i for i, _ in asked]), np.concatenate([q for _, q in asked]), k)
                            asked = []
                        if best is not None:
                            best.add(ids[some], v)
        yield from said(best)

    found = both.repartitionById(across * down, F.col("task")).sortWithinPartitions("task", "side").mapInArrow(search, f"{query_key} bigint, {key} bigint, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key)))
    return ranked.filter(F.col("rank") <= k)


def label_recall(hits: DataFrame, labelled: DataFrame, ks: tuple[int, ...], query_key: str = "query_id", key: str = "vec_id", label: str = "label") -> DataFrame:
    """query_key, label, k and share: how much of the rows with the query's label is among its first k hits. Queries are
    rows of labelled too; only counts of labels are needed, not the pairs of rows that have one."""
    ql = labelled.select(F.col(key).alias(query_key), F.col(label))
    vl = labelled.select(F.col(key), F.col(label).alias("_l"))
    size = labelled.groupBy(label).agg(F.count("*").alias("_n"))
    met = hits.join(ql, query_key).join(vl, key).groupBy(query_key, label).agg(*[F.count_if((F.col("rank") <= k) & (F.col("_l") == F.col(label))).alias(f"_{k}") for k in ks])
    shares = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"_{k}") / F.col("_n")).alias("share")) for k in ks])
    return met.join(size, label).select(query_key, label, F.inline(shares))


def recall_at(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...], query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """k and recall: the mean over queries of the share of relevant rows (query_key, key) among the first k hits (with rank)."""
    wanted = relevant.select(query_key, key).distinct()
    total = wanted.groupBy(query_key).agg(F.count("*").alias("_n"))
    found = wanted.join(hits, [query_key, key]).groupBy(query_key).agg(*[F.count_if(F.col("rank") <= k).alias(f"_{k}") for k in ks])
    per = total.join(found, query_key, "left")
    shares = per.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), (F.coalesce(F.col(f"_{k}"), F.lit(0)) / F.col("_n")).alias("share")) for k in ks])))
    return shares.groupBy("k").agg(F.avg("share").alias("recall"))


def best_configuration(scores: DataFrame, query: str = "query", model: str = "model", k: str = "k", score: str = "recall") -> DataFrame:
    """For each query the model, k and score of the highest score; ties by smaller k, then model."""
    best = F.min_by(F.struct(model, k, score), F.struct((-F.col(score)).alias("s"), F.col(k).alias("k"), F.col(model).alias("m")))
    return scores.groupBy(query).agg(best.alias("_b")).select(query, "_b.*")


def relevant_chunks(chunks: DataFrame, hits: DataFrame, key: str = "chunk_key", source: Any = None) -> DataFrame:
    """Chunks (with kind and text) to be read: those of availability statements, those in hits, and those with an identifier,
    each once, with the first of these reasons as reason."""
    found = hits.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = chunks.join(found, key, "left")
    reason = F.when(F.col("kind") == "availability", F.lit("rule")).when(F.col("_hit"), F.lit("similar")).when(any_identifier(F.col("text"), source), F.lit("identifier"))
    # a row without a reason has none to explode: a filter would be pushed down and look through the text again
    return joined.withColumn("reason", F.explode(F.filter(F.array(reason), lambda r: r.isNotNull()))).drop("_hit")


def embed(rows: DataFrame, text: str = "text", dims: int = 256) -> DataFrame:
    """rows with embedding: signed hashed counts of lower-cased words, of length 1; a text without words gives zeros, a null gives null.

    A stand-in for a sentence model that needs no weights; any column of vectors of one length serves the search as well.
    Words are hashed by Spark and added up in Arrow batches.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)

    columns = [c for c in rows.columns if c != "embedding"]

    def one(own: Any) -> Any:
        if own is None:
            return None
        h = own.to_numpy()
        total = np.bincount(np.mod(h, dims), np.where((h >> 40) % 2 == 0, 1.0, -1.0), minlength=dims)
        norm = np.sqrt((total * total).sum())
        return total / norm if norm > 0 else total

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in pieces(batch)):
            vectors = pa.array([one(x.values) for x in part.column("_h")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], vectors], [*columns, "embedding"])

    hashed = rows.select(*columns, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    return hashed.mapInArrow(add, StructType([*rows.select(columns).schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


def top_chunks(chunks: DataFrame, query: list[float], k: int, key: str = "key", chunk: str = "chunk_key") -> DataFrame:
    """key, chunk, l2_sq and rank of the k chunks of each document that are nearest to the query; ties by chunk."""
    distance = squared_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    scored = chunks.filter("embedding is not null").select(key, chunk, distance.alias("l2_sq"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("l2_sq", chunk))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
