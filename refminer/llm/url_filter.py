"""URL filter: gradient-boosted regression trees on lexical features of the URL, trained from labelled URLs."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refminer.llm.storage import cut

#: At most so many labelled URLs are fitted on, those with the smallest hashes.
MAX_LABELLED = 20_000
TREES = 60
DEPTH = 3
RATE = 0.15
BINS = 32
MIN_PROBABILITY = 0.5
#: Labelled URLs of the mean label that every suffix and extension has besides its own.
PRIOR = 10
#: Statistics of at most so many suffixes and extensions are broadcast; more are joined by shuffling.
BROADCAST_KEYS = 100_000
#: Parts of the labelled URLs; what a URL is trained with are the rates of the other parts.
FOLDS = 5
#: Words that make a host a bad one: labels for tables that have none for their URLs. A labelled list takes their place where there is one.
SEED_WORDS = tuple(
    "ads adserver banner bet bets betting bonus casino cheap cialis clickbait coupon dating deals escort forex free gambling jackpot keno loan loans lottery "
    "payday pharma pills poker popads popup porn promo replica roulette slot slots spam sportsbook track tracker tracking viagra win winner xxx".split()
)
STATISTICS = "suffix_rate suffix_share extension_rate extension_share".split()

NAMES = (
    "length host_length path_length depth host_labels digits digit_ratio letters_ratio upper_ratio symbol_ratio entropy host_entropy path_entropy "
    "parameters query_length tracking_parameters longest_token mean_token hyphens underscores percent_escapes is_https has_port has_fragment has_www "
    "host_is_address last_number_digits trailing_slash suffix_rate suffix_share extension_rate extension_share"
).split()
_PARTS = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def suffixes(url: str) -> tuple[str, str]:
    """Last label of the host and extension of the path, lower-cased; empty where there is none."""
    match = _PARTS.match(url)
    host, path = (match.group(2) or "", match.group(3) or "") if match else ("", "")
    host = host.rpartition("@")[2].partition(":")[0].lower()
    name = path.rpartition("/")[2]
    return host.rpartition(".")[2], name.rpartition(".")[2].lower() if "." in name else ""


def lexical(url: str) -> list[float]:
    match = _PARTS.match(url)
    scheme, host, path, query, fragment = match.groups(default="") if match else ("", "", url, "", "")
    bare, _, port = host.rpartition("@")[2].partition(":")
    n = max(len(url), 1)
    digits, letters = sum(c.isdigit() for c in url), sum(c.isalpha() for c in url)
    tokens = [t for t in re.split(r"[^A-Za-z0-9]+", url) if t]
    parameters = [p for p in query.split("&") if p]
    numbers = re.findall(r"\d+", path)
    return [
        len(url), len(bare), len(path), sum(1 for p in path.split("/") if p), bare.count(".") + 1 if bare else 0, digits, digits / n, letters / n, sum(c.isupper() for c in url) / n,
        (n - digits - letters) / n, _entropy(url), _entropy(bare), _entropy(path), len(parameters), len(query), sum(p.lower().startswith(("utm_", "ref", "fbclid", "gclid", "session", "sid=")) for p in parameters),
        max(map(len, tokens), default=0), sum(map(len, tokens)) / max(len(tokens), 1), url.count("-"), url.count("_"), url.count("%"), scheme.lower() == "https", bool(port), bool(fragment), bare.startswith("www."),
        bool(re.fullmatch(r"[\d.]+", bare)), len(numbers[-1]) if numbers else 0, path.endswith("/"),
    ]


@dataclass
class UrlModel:
    """Suffix statistics of the training URLs and the trees: feature, cut and leaf values of complete binary trees."""

    suffix: dict[str, tuple[float, float]]
    extension: dict[str, tuple[float, float]]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def matrix(self, urls: list[str], statistics: np.ndarray | None = None) -> np.ndarray:
        """The features; statistics (columns STATISTICS) stand in for those of the training URLs."""
        if statistics is not None:
            known = np.array([lexical(url) for url in urls], np.float64).reshape(len(urls), len(NAMES) - len(STATISTICS))
            return np.concatenate([known, statistics], axis=1)
        rate = 1 / (1 + np.exp(-self.base))
        rows = []
        for url in urls:
            tail, extension = suffixes(url)
            rows.append([*lexical(url), *self.suffix.get(tail, (rate, 0.0)), *self.extension.get(extension, (rate, 0.0))])
        return np.array(rows, np.float64).reshape(len(urls), len(NAMES))

    def probability(self, urls: list[str], statistics: np.ndarray | None = None) -> np.ndarray:
        x = self.matrix(urls, statistics)
        total = np.full(len(urls), self.base)
        rows = np.arange(len(urls))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(urls), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def _statistics(keys: list[str], labels: np.ndarray, rate: float) -> dict[str, tuple[float, float]]:
    """Smoothed share of label 1 and share of all URLs, by key."""
    names, inverse = np.unique(np.array(keys, object).astype(str), return_inverse=True)
    n, good = np.bincount(inverse), np.bincount(inverse, labels)
    return {str(k): ((g + PRIOR * rate) / (c + PRIOR), c / len(labels)) for k, c, g in zip(names, n.tolist(), good.tolist(), strict=True)}


def fit(urls: list[str], labels: np.ndarray, trees: int = TREES, rate: float = RATE, l2: float = 1.0, statistics: np.ndarray | None = None) -> UrlModel:
    """Second-order boosting of the logistic loss over binned features; statistics as in UrlModel.matrix."""
    y = np.asarray(labels, np.float64)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    pairs = [suffixes(u) for u in urls]
    base = float(np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    model = UrlModel(_statistics([p[0] for p in pairs], y, share), _statistics([p[1] for p in pairs], y, share), base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    x = model.matrix(urls, statistics)
    if statistics is None:
        fold = np.array([zlib.crc32(u.encode()) % FOLDS for u in urls])
        for part, column in ((0, NAMES.index("suffix_rate")), (1, NAMES.index("extension_rate"))):
            keys = np.unique(np.array([p[part] for p in pairs], object).astype(str), return_inverse=True)[1]
            n, good = (np.bincount(keys * FOLDS + fold, w, minlength=(keys.max(initial=0) + 1) * FOLDS).reshape(-1, FOLDS) for w in (None, y))
            x[:, column] = ((good.sum(1)[keys] - good[keys, fold]) + PRIOR * share) / (n.sum(1)[keys] - n[keys, fold] + PRIOR)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    total = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == at)
                best = 1e-6
                for f, c in enumerate(cuts):
                    if not len(c) or not len(rows):
                        continue
                    g = np.bincount(binned[rows, f], grad[rows], BINS + 1).cumsum()
                    h = np.bincount(binned[rows, f], hess[rows], BINS + 1).cumsum()
                    gain = g[:-1] ** 2 / (h[:-1] + l2) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + l2) - g[-1] ** 2 / (h[-1] + l2)
                    gain = gain[: len(c)]
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[at], cut[at] = float(gain[k]), f, c[k]
                node[rows] = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        index = node - inner
        leaf = rate * np.bincount(index, grad, inner + 1) / (np.bincount(index, hess, inner + 1) + l2)
        total += leaf[index]
        features.append(feature)
        thresholds.append(cut)
        leaves.append(leaf)
    if features:
        model.feature, model.cut, model.leaf = np.array(features), np.array(thresholds), np.array(leaves)
    return model


def label_by_seeds(urls: DataFrame, words: tuple[str, ...] = SEED_WORDS) -> DataFrame:
    """url and label of every URL that has a host: 0 if a part of the host, its last label aside, is one of words, else 1. Null and empty URLs go; repeated rows stay."""
    host = F.lower(F.regexp_extract(F.col("url"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    parts = F.split(F.regexp_replace(host, r"\.[^.]*$", ""), "[-._0-9]+")
    return urls.select(F.col("url").cast("string").alias("url")).filter(host != "").select("url", (~F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))).cast("int").alias("label"))


def _with_keys(urls: DataFrame) -> DataFrame:
    """urls with the columns suffix and extension of its column url; a null url has two nulls."""
    columns = urls.columns

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            pairs = [suffixes(u) if u else (None, None) for u in part.column("url").to_pylist()]
            keys = [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *keys], [*columns, "suffix", "extension"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    return urls.mapInArrow(split, f"{fields}, suffix string, extension string")


def corpus_statistics(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """kind (suffix or extension), key, share of all URLs of pages, rate, the smoothed share of label 1 of all labelled URLs,
    and rates, one for each fold of URLs, of the labelled URLs outside it. Every row counts, null and empty URLs don't. It is
    kept in the checkpoint folder."""
    url = F.col("url").cast("string")
    every = pages.select(url.alias("url"), F.lit(1).alias("n"), F.lit(None).cast("int").alias("label"))
    rated = labelled.select(url.alias("url"), F.lit(0).alias("n"), F.col("label").cast("int").alias("label")).filter("label is not null")
    kinds = F.expr("stack(2, 'suffix', suffix, 'extension', extension) as (kind, key)")
    keyed = _with_keys(every.unionByName(rated).filter("url <> ''")).select("n", "label", _fold(F.col("url")).alias("fold"), kinds)
    folds = [f(F.when(F.col("fold") == k, F.col("label"))).alias(f"{name}_{k}") for k in range(FOLDS) for name, f in (("rated", F.count), ("good", F.sum))]
    counts = keyed.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.count("label").alias("rated"), F.coalesce(F.sum("label"), F.lit(0)).alias("good"), *folds)
    counts = cut(counts)
    total = counts.filter("kind = 'suffix'").agg(F.sum("n"), F.sum("rated"), F.sum("good")).first()
    n, mean = max(total[0] or 0, 1), (total[2] / total[1] if total[1] else 0.5)
    outside = [(F.col("good") - F.coalesce(f"good_{k}", F.lit(0)) + PRIOR * mean) / (F.col("rated") - F.col(f"rated_{k}") + PRIOR) for k in range(FOLDS)]
    return counts.select("kind", "key", (F.col("n") / n).alias("share"), ((F.col("good") + PRIOR * mean) / (F.col("rated") + PRIOR)).alias("rate"), F.array(*outside).alias("rates"))


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def _with_statistics(urls: DataFrame, statistics: DataFrame, training: bool = False) -> DataFrame:
    """urls with the columns STATISTICS; for training with the rates outside a URL's own fold."""
    small = statistics.count() <= BROADCAST_KEYS
    out = _with_keys(urls)
    for kind in ("suffix", "extension"):
        part = statistics.filter(F.col("kind") == kind).select(F.col("key").alias(kind), F.col("rates" if training else "rate").alias(f"{kind}_rate"), F.col("share").alias(f"{kind}_share"))
        out = out.join(F.broadcast(part) if small else part, kind, "left")
        if training:
            out = out.withColumn(f"{kind}_rate", F.get(f"{kind}_rate", _fold(F.col("url"))))
    return out.select(*urls.columns, *STATISTICS)


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED, statistics: DataFrame | None = None) -> UrlModel | None:
    """labelled has url and label (0 or 1); rows with a null are left out, a URL counts once, with its least label. None if
    nothing is left. statistics are those of corpus_statistics; without them the chosen URLs' own are used."""
    chosen = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")).dropna().groupBy("url").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    if statistics is None:
        rows = chosen.collect()
        return fit([r[0] for r in rows], np.array([r[1] for r in rows])) if rows else None
    rows = sorted(_with_statistics(chosen, statistics, training=True).collect())
    found = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows], np.float64).reshape(len(rows), len(STATISTICS))
    return fit([r[0] for r in rows], np.array([r[1] for r in rows]), statistics=np.nan_to_num(found)) if rows else None


def filter_urls(pages: DataFrame, model: UrlModel | None, id_column: str = "page_id", min_probability: float = MIN_PROBABILITY, statistics: DataFrame | None = None) -> DataFrame:
    """id_column, url, probability (of label 1) and keep of every row of pages.

    A null or empty url has probability 0 and is not kept. Without a model the probability is null and every URL is kept.
    Repeated rows are judged each for itself, other columns are neither read nor returned. statistics are those that the
    model was trained with, if any.
    """
    kind = pages.schema[id_column].dataType.simpleString()
    source = pages.select(F.col(id_column), F.col("url").cast("string").alias("url"))
    if model is None:
        return source.select("*", F.lit(None).cast("double").alias("probability"), (F.length(F.coalesce("url", F.lit(""))) > 0).alias("keep"))

    counted = statistics is not None

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            urls = [u or "" for u in part.column("url").to_pylist()]
            known = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS], axis=1) if counted else None
            p = np.where([bool(u) for u in urls], model.probability(urls, known), 0.0)
            yield pa.RecordBatch.from_arrays([part.column(id_column), part.column("url"), pa.array(p, pa.float64()), pa.array(p >= min_probability)], [id_column, "url", "probability", "keep"])

    if statistics is not None:
        source = _with_statistics(source, statistics)
    return source.mapInArrow(judge, f"`{id_column}` {kind}, url string, probability double, keep boolean")
