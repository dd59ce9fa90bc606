"""Packing of documents into fixed windows by minimum bin slack.

A document longer than the window gives full windows and one remainder; what has to be packed is the multiset of
remainders, of which there are fewer distinct lengths than the window has tokens. For each window the longest length
left is taken, a subset-sum dynamic program over bitsets (Python integers) finds the multiset of other remaining lengths
that comes closest to the capacity, and backtracking gives how many of each. The same multiset is used again as often
as the remaining counts allow, so the number of programs depends on the number of distinct lengths, not of documents.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refminer.llm.storage import cut

CAPACITY = 2048
SALTS = 64


class Fill(NamedTuple):
    """times windows, each with counts[length] pieces of each length."""

    times: int
    counts: dict[int, int]


def best_fill(remaining: dict[int, int], room: int) -> dict[int, int]:
    """The counts of remaining lengths whose sum is the largest that is at most room (0 < lengths)."""
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted(remaining, reverse=True):
        left = min(remaining[length], room // length) if length <= room else 0
        part = 1
        while left > 0:
            part = min(part, left)
            new = (reach | (reach << (part * length))) & mask
            if new != reach:
                layers.append((length, part, reach))
                reach = new
            if reach >> room & 1:
                left = 0
                break
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    counts: dict[int, int] = {}
    for length, part, before in reversed(layers):
        if not before >> total & 1:
            counts[length] = counts.get(length, 0) + part
            total -= part * length
    return counts


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[Fill]:
    """Windows for histogram[length] pieces of each length (0 < length <= capacity)."""
    remaining = {int(k): int(v) for k, v in histogram.items() if v > 0}
    fills: list[Fill] = []
    while remaining:
        seed = max(remaining)
        remaining[seed] -= 1
        if not remaining[seed]:
            del remaining[seed]
        counts = best_fill(remaining, capacity - seed) if seed < capacity else {}
        counts[seed] = counts.get(seed, 0) + 1
        remaining[seed] = remaining.get(seed, 0) + 1
        times = min(remaining[length] // n for length, n in counts.items())
        for length, n in counts.items():
            remaining[length] -= n * times
            if not remaining[length]:
                del remaining[length]
        fills.append(Fill(times, counts))
    return fills


def _layout(fills: list[Fill]) -> pd.DataFrame:
    """A row for each (fill, length): the ranks from first to last of the pieces of that length lie in it."""
    used: dict[int, int] = {}
    rows, window = [], 0
    for times, counts in fills:
        at = 0
        for length in sorted(counts, reverse=True):
            n, first = counts[length], used.get(length, 0)
            rows.append((length, first, first + n * times - 1, window, n, at))
            used[length] = first + n * times
            at += n * length
        window += times
    return pd.DataFrame(rows, columns=["seg_length", "first_rank", "last_rank", "first_window", "per_window", "base"])


def word_length(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece (0, 1, ...), start and n_tokens of the piece in its document, window_id, offset.

    length is the token count of a document, its words unless given. Each document lies in its pieces without a gap or an
    overlap, each window holds at most capacity tokens. Windows that one long document fills alone follow the others.
    Documents without a token (null or empty text) have no row. A null doc_id is packed like any other and stays null;
    of repeated rows each is packed. Other columns are ignored. The driver gets the histogram of remainders, at most
    capacity x 64 rows whatever the input, and makes a segment table of at most a few times capacity rows.
    """
    spark = docs.sparkSession
    tokens = word_length(F.col("text")) if length is None else length
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(tokens.cast("bigint"), F.lit(0)).alias("total")).filter("total > 0")
    salted = sized.select("*", F.pmod(F.xxhash64("doc_id", "total"), F.lit(SALTS)).cast("int").alias("salt"))
    # ids and lengths only from here on; written once, since the histogram and the assignment both need them
    salted = cut(salted)
    rest = salted.select("*", (F.col("total") % capacity).alias("rest")).filter("rest > 0")
    counts = rest.groupBy("rest", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["rest", "salt"])
    counts["before"] = counts.groupby("rest")["n"].cumsum() - counts["n"]
    histogram = counts.groupby("rest")["n"].sum().to_dict()
    fills = minimum_bin_slack(histogram, capacity)
    windows = sum(f.times for f in fills)
    segments = spark.createDataFrame(_layout(fills), "seg_length bigint, first_rank bigint, last_rank bigint, first_window bigint, per_window bigint, base bigint")
    starts = spark.createDataFrame(counts[["rest", "salt", "before"]], "s_rest bigint, s_salt int, before bigint")

    rank = F.row_number().over(Window.partitionBy("rest", "salt").orderBy("doc_id", "total")) - 1
    ranked = rest.select("*", rank.cast("bigint").alias("in_salt"))
    # both tables are bounded by the capacity, not by the corpus
    ranked = ranked.join(F.broadcast(starts), (F.col("rest") == F.col("s_rest")) & (F.col("salt") == F.col("s_salt"))).withColumn("rank", F.col("before") + F.col("in_salt"))
    placed = ranked.join(F.broadcast(segments), (F.col("rest") == F.col("seg_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    step = F.col("rank") - F.col("first_rank")
    whole = (F.col("total") / capacity).cast("bigint")
    remainders = placed.select(
        "doc_id",
        whole.alias("piece"),
        (whole * capacity).alias("start"),
        F.col("rest").alias("n_tokens"),
        (F.col("first_window") + F.floor(step / F.col("per_window"))).cast("bigint").alias("window_id"),
        (F.col("base") + (step % F.col("per_window")) * F.col("rest")).alias("offset"),
    )
    # full windows: numbered by the rank of the document's hash bucket, then within it, without one global sort
    long = salted.filter(F.col("total") >= capacity).select("*", whole.alias("whole"), F.pmod(F.xxhash64("doc_id", "total", F.lit(1)), F.lit(1024)).cast("int").alias("bucket"))
    per_bucket = long.groupBy("bucket").agg(F.sum("whole").alias("n")).toPandas().sort_values("bucket")
    per_bucket["first"] = windows + per_bucket["n"].cumsum() - per_bucket["n"]
    bucket_starts = spark.createDataFrame(per_bucket[["bucket", "first"]].astype({"first": "int64"}), "b_bucket int, first bigint")
    before = F.sum("whole").over(Window.partitionBy("bucket").orderBy("doc_id", "total").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("whole")
    numbered = long.select("*", before.alias("earlier")).join(F.broadcast(bucket_starts), F.col("bucket") == F.col("b_bucket"))
    full = numbered.select("doc_id", "first", "earlier", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("n_tokens"), (F.col("first") + F.col("earlier") + F.col("piece")).alias("window_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return remainders.unionByName(full)
