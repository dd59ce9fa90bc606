"""Near copies: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold: grouped prefix join.

The n-grams are ordered from rare to frequent (by a count sketch of the whole corpus, ties by hash). Of a pair with
Jaccard >= t, the first size - ceil(t size) + 1 n-grams in this order, the prefixes, have one in common. Documents with
the same prefix and size form one group; groups of about one size with the same min-hash, as most near copies have, form a
block. Blocks meet in an inverted index of
prefixes, split by hash into buckets so that a task holds a bounded part; for each pair of blocks the n-grams that their
groups' prefixes share are counted, and pairs whose groups can't reach the threshold with that many are dropped: already in
the bucket, if they share less there than a pair that can reach it must share in one of its buckets. What is left is
expanded to the groups' distinct sets, of which those that bitmaps of their n-grams rule out go, and verified on whole sets:
blocks that are alike are dealt out to tiles of a bounded number of n-grams, and in each pair of tiles the sizes of all
intersections are one matrix product.

A pair of documents is never a row of a shuffle: of a tile only the number of links of each set and a star that connects
the same sets come out. Texts don't move either; the sets that passed the filter do, as 48-bit hashes. Copies (equal sets)
are one node throughout, so thousands of copies cost no more than one document.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refminer.llm import batches
from refminer.llm.storage import cut, release

NGRAM = 3
THRESHOLD = 0.5
#: Logarithm of the slots of the sketch: at least, at most, and n-grams a slot in between. A full sketch can't tell rare n-grams from
#: others, and what prefixes share grows with the square of what isn't rare.
SKETCH_BITS, MOST_SKETCH_BITS, SLOT_GRAMS = 20, 24, 8
#: Logarithm of the ratio of the sizes of a block's largest and smallest groups, at most.
SIZE_CLASS = math.log(1.04)
SLOTS = 64
#: Prefix entries of a bucket at most, packed; those of them that are unpacked and joined at a time, also the entries of a bucket where
#: that gives no more than LEAST_BUCKETS. The fewer buckets, the more pairs of blocks share too little in each of them.
BUCKET_ENTRIES, ENTRIES_AT_ONCE, LEAST_BUCKETS = 1 << 24, 3_000_000, 12
#: Bits of an n-gram's hash in a bucket. Equal hashes of different n-grams only make candidates.
HASH_BITS = 30
PAIRS_AT_ONCE = 4_000_000
#: N-grams of the sets that one side of a tile holds on average, where each set counts as SET_GRAMS more than it has; columns
#: of the matrices that are multiplied at a time.
TILE_GRAMS, SET_GRAMS = 1 << 19, 512
COLUMNS = 2048
#: Bits of the bitmap of a set.
BITS = 2048
#: Bits of the Bloom filter by which sets that no tile asks for are left where they are; whatever passes is joined exactly.
BLOOM_BITS = 1 << 26


def _ceil(x: float) -> int:
    return math.ceil(x - 1e-9)


def prefix_length(size: int, threshold: float) -> int:
    return size - _ceil(threshold * size) + 1


def _grams(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, gram hashes, row bounds) of runs of rows."""
    data, offsets = batches.text_buffers(column)
    for first, _, chunk, offs in batches.chunks(data, offsets):
        _, _, hashes, bounds = batches.words(chunk, offs)
        grams, gram_bounds = batches.ngrams(hashes, bounds, n)
        yield first, grams, gram_bounds


def _sketch_bits(chars: int) -> int:
    """Enough for a corpus of so many characters, about six a word."""
    return min(max(math.ceil(math.log2(max(1, chars) / 6 / SLOT_GRAMS)), SKETCH_BITS), MOST_SKETCH_BITS)


def _rank(counts: np.ndarray) -> np.ndarray:
    """The leading 16 bits of an n-gram's place in the global order."""
    return np.round(np.log2(counts + 1.0) * 1024).astype(np.uint16)


def gram_sketch(docs: DataFrame, n: int, bits: int) -> tuple[np.ndarray, int]:
    """(rank of how many n-grams of the corpus fall on each of 2^bits hashes, number of all n-grams). Partial sums are added up slot by slot, as a stream."""
    size = 1 << bits
    part = size // SLOTS

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for batch in parts:
            for _, grams, _ in _grams(batch.column("text"), n):
                np.add.at(total, (grams & np.uint64(size - 1)).astype(np.int64), np.int32(1))
        if total.any():
            low, high = (total & 0xFF).astype(np.uint8), np.flatnonzero(total > 0xFF)
            for k in range(SLOTS):
                large = high[(high >= k * part) & (high < (k + 1) * part)]
                rest = (large - k * part).astype(np.int32).tobytes() + (total[large] >> 8).tobytes()
                blob = pa.compress(low[k * part : (k + 1) * part].tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary()), pa.array([rest], pa.binary())], ["slot", "low", "high"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in parts:
            for slot, low, high in zip(batch.column("slot").to_pylist(), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                own = total.setdefault(slot, np.zeros(part, np.int64))
                own += np.frombuffer(pa.decompress(low, decompressed_size=part, codec="zstd"), np.uint8)
                at, more = np.frombuffer(high, np.int32).reshape(2, -1)
                own[at] += more.astype(np.int64) << 8
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pa.compress(_rank(v).tobytes(), codec="zstd", asbytes=True) for v in total.values()], pa.binary()), pa.array([int(v.sum()) for v in total.values()], pa.int64())], ["slot", "ranks", "grams"])

    rows = docs.select("text").mapInArrow(count, "slot int, low binary, high binary").repartition(16, "slot").mapInArrow(add, "slot int, ranks binary, grams bigint").collect()
    out = np.zeros(size, np.uint16)
    for slot, ranks, _ in rows:
        out[slot * part : (slot + 1) * part] = np.frombuffer(pa.decompress(ranks, decompressed_size=2 * part, codec="zstd"), np.uint16)
    return out, sum(r.grams for r in rows)


def _sorted_sets(column: pa.Array, n: int, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct n-grams in the global order) of every row with a word. Each n-gram is the rank of its sketch count and 48 bits of its hash."""
    for first, grams, bounds in _grams(column, n):
        keys = order[(grams & np.uint64(len(order) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | (grams >> np.uint64(16))
        for r in range(len(bounds) - 1):
            if bounds[r] < bounds[r + 1]:
                yield first + r, np.unique(keys[bounds[r] : bounds[r + 1]])


def _hash64(*parts: bytes) -> int:
    digest = blake2b(digest_size=8)
    for p in parts:
        digest.update(p)
    return int.from_bytes(digest.digest(), "little", signed=True)


def _group_key(keys: np.ndarray, threshold: float) -> int:
    return _hash64(struct.pack("<q", len(keys)), keys[: prefix_length(len(keys), threshold)].tobytes())


def _block(keys: np.ndarray, heavy: np.uint64) -> int:
    """The least hash of the n-grams, by class of size; of those at least as frequent as heavy if these are more than half.

    What an edit puts in is rare. So of a cluster of many near copies, whose other n-grams are heavy, nearly all fall into
    a few blocks. Blocks only save work: any division of the documents into blocks gives the same pairs.
    """
    frequent = keys[int(np.searchsorted(keys, heavy)) :]
    least = batches.mix((frequent if 2 * len(frequent) > len(keys) else keys) ^ np.uint64(0x5BF0A8B1457695D3)).min()
    return int(batches.mix(np.array([least + np.uint64(int(math.log(len(keys)) / SIZE_CLASS))], np.uint64)).view(np.int64)[0])


def _packed(batch_rows: Iterator[tuple[int, np.ndarray]], buckets: int, threshold: float, heavy: np.uint64) -> tuple[list[int], list[bytes]]:
    """The prefixes of a batch as one blob per bucket: block ids with the least and greatest size of their groups, then the
    entries in order of hash (HASH_BITS), as gaps (16 bits, or 0xFFFF and the hash among those before) and references to the blocks."""
    groups: set[int] = set()
    blocks, sizes, prefixes = [], [], []
    for _, keys in batch_rows:
        group = _group_key(keys, threshold)
        if group not in groups:
            groups.add(group)
            blocks.append(_block(keys, heavy))
            sizes.append(len(keys))
            prefixes.append(keys[: prefix_length(len(keys), threshold)])
    if not blocks:
        return [], []
    ids, owner = np.unique(np.array(blocks, np.int64), return_inverse=True)
    size = np.array(sizes, np.int64)
    low, high = np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), np.int64)
    np.minimum.at(low, owner, size)
    np.maximum.at(high, owner, size)
    values = batches.mix(np.concatenate(prefixes))
    owners = np.repeat(owner.astype(np.int64), [len(p) for p in prefixes])
    bucket = (values % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    names, blobs = [], []
    for b in range(buckets):
        at = order[edges[b] : edges[b + 1]]
        if len(at):
            code = np.unique((values[at] >> np.uint64(64 - HASH_BITS) << np.uint64(32)) | owners[at].astype(np.uint64))
            used, local = np.unique((code & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
            hashes = (code >> np.uint64(32)).astype(np.int64)
            gaps = np.diff(hashes, prepend=0)
            far = gaps >= 0xFFFF
            refs = local.astype(np.uint16 if len(used) <= 65536 else np.uint32)
            head = struct.pack("<iii", len(used), len(code), int(far.sum())) + ids[used].tobytes() + low[used].astype(np.int32).tobytes() + (high - low)[used].astype(np.int32).tobytes()
            names.append(b)
            blobs.append(head + hashes[far].astype(np.uint32).tobytes() + np.where(far, 0xFFFF, gaps).astype(np.uint16).tobytes() + refs.tobytes())
    return names, blobs


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block ids, least sizes, greatest sizes, hashes, references)"""
    blocks, entries, jumps = struct.unpack_from("<iii", blob)
    at = 12
    out = []
    for kind, n in ((np.int64, blocks), (np.int32, blocks), (np.int32, blocks), (np.uint32, jumps), (np.uint16, entries), (np.uint16 if blocks <= 65536 else np.uint32, entries)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    ids, low, high, far, small, refs = out
    gaps = small.astype(np.int64)
    jump = np.flatnonzero(small == 0xFFFF)
    if len(jump):  # a jump lands on its hash: its gap is what the gaps before it leave
        gaps[jump] = 0
        total = np.cumsum(gaps)
        gaps[jump] = np.diff(far.astype(np.int64) - total[jump], prepend=0)
    return ids, low, low + high, np.cumsum(gaps).astype(np.uint32), refs


def _bounds(low1: np.ndarray, high1: np.ndarray, low2: np.ndarray, high2: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """How many prefix entries two groups that reach the threshold must share: the least and the greatest such number over the sizes that groups of two blocks have."""
    share = threshold / (1 + threshold)
    least = np.ceil(share * (low1 + low2) - 1e-9) - np.ceil(threshold * np.maximum(high1, high2) - 1e-9) + 1
    most = np.ceil(share * (high1 + high2) - 1e-9) - np.ceil(threshold * np.maximum(low1, low2) - 1e-9) + 1
    return np.maximum(least, 1).astype(np.int64), np.maximum(most, 1).astype(np.int64)


def join_bucket(blobs: list[bytes], threshold: float, buckets: int = 1) -> dict[str, np.ndarray]:
    """b1 < b2 with their least and greatest sizes and the prefix entries of this bucket that they share, for the pairs of blocks whose sizes allow
    the threshold and that share at least 1 / buckets, rounded up, of what they must share in all. Of a pair that does so some bucket has that many."""
    parts = [_unpacked(b) for b in blobs]
    every = np.concatenate([p[0] for p in parts])
    ids, at = np.unique(every, return_inverse=True)
    low, high = np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), np.int64)
    np.minimum.at(low, at, np.concatenate([p[1] for p in parts]))
    np.maximum.at(high, at, np.concatenate([p[2] for p in parts]))
    by_size = np.lexsort((ids, low))  # blocks are numbered by least size, so a list of blocks is in that order
    number = np.empty(len(ids), np.int64)
    number[by_size] = np.arange(len(ids))
    ids, low, high = ids[by_size], low[by_size], high[by_size]
    entries, first = [], 0
    for own, _, _, hashes, refs in parts:
        local = number[at[first : first + len(own)]].astype(np.uint32)
        first += len(own)
        entries.append((hashes, refs, local))
    del parts, every, at
    total = len(ids)
    held: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    waiting = 0

    def merge() -> None:
        pairs, inverse = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(weights), minlength=len(pairs)).astype(np.int32)
        held[:], weights[:] = [pairs], [n]

    steps = max(1, math.ceil(sum(len(e[0]) for e in entries) / ENTRIES_AT_ONCE))
    edges = np.linspace(0, 1 << HASH_BITS, steps + 1).astype(np.int64)
    cuts = [np.searchsorted(hashes, edges) for hashes, _, _ in entries]
    for step in range(steps):
        codes = [hashes[c[step] : c[step + 1]].astype(np.uint64) << np.uint64(32) | local[refs[c[step] : c[step + 1]]] for (hashes, refs, local), c in zip(entries, cuts, strict=True)]
        code = np.concatenate(codes)
        del codes
        code.sort()
        key = (code >> np.uint64(32)).astype(np.uint32)
        equal = key[1:] == key[:-1]
        keep = np.zeros(len(code), bool)  # entries of one block alone, or of one n-gram twice, meet nothing
        keep[1:] = equal
        keep[:-1] |= equal
        code = code[keep]
        code = code[np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]])]
        key, block = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del code
        active = np.flatnonzero(key[1:] == key[:-1])
        distance = 1
        while len(active):
            left, right = block[active], block[active + distance]
            ok = high[left] >= threshold * low[right] - 1e-9
            active, left, right = active[ok], left[ok], right[ok]
            held.append(left * total + right)
            weights.append(np.ones(len(left), np.int32))
            waiting += len(left)
            if waiting > PAIRS_AT_ONCE:
                merge()
                waiting = 0
            distance += 1
            active = active[active + distance < len(key)]
            active = active[key[active] == key[active + distance]]
    if held:
        merge()
    pairs, n = (held[0], weights[0]) if held else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    a, b = pairs // max(1, total), pairs % max(1, total)
    enough = n >= -(-_bounds(low[a], high[a], low[b], high[b], threshold)[0] // buckets)
    a, b, n = a[enough], b[enough], n[enough]
    swap = ids[a] > ids[b]  # a pair has one form, whatever the bucket
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return {"b1": ids[a], "b2": ids[b], "low1": low[a].astype(np.int32), "high1": high[a].astype(np.int32), "low2": low[b].astype(np.int32), "high2": high[b].astype(np.int32), "shared": n}


def _possible(threshold: float, buckets: int) -> Column:
    """Whether some groups of two blocks may reach the threshold, by what the n of all buckets that list the pair say (shared is the sum).

    Let k = B (f - 1) + r, 1 <= r <= B, be what two groups must share. A bucket that doesn't list them has at most f - 1, the n that
    do have the rest: k - (B - n) (f - 1) = n (f - 1) + r. Over all k that sizes of the blocks give, it is least at the first k or,
    if f isn't the same for all of them, at r = 1 of the next f.
    """
    share = F.lit(threshold / (1 + threshold))
    least = F.ceil(share * (F.col("low1") + F.col("low2")) - 1e-9) - F.ceil(F.lit(threshold) * F.greatest("high1", "high2") - 1e-9) + 1
    most = F.ceil(share * (F.col("high1") + F.col("high2")) - 1e-9) - F.ceil(F.lit(threshold) * F.greatest("low1", "low2") - 1e-9) + 1
    least, most = F.greatest(least, F.lit(1)), F.greatest(most, F.lit(1))
    before, last = F.floor((least - 1) / buckets), F.floor((most - 1) / buckets)
    rest = least - before * buckets
    return F.col("shared") >= F.col("n") * before + F.when(before == last, rest).otherwise(F.least(rest, F.col("n") + 1))


def _candidates(docs: DataFrame, n: int, threshold: float, order: Broadcast[np.ndarray], heavy: np.uint64, buckets: int) -> DataFrame:
    """b1, b2: pairs of blocks whose shared prefix entries leave the threshold possible for some of their groups."""

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            names, blobs = _packed(_sorted_sets(batch.column("text"), n, order.value), buckets, threshold, heavy)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "entries"])

    entries = docs.select("text").mapInArrow(emit, "bucket int, entries binary")
    pairs = entries.groupBy("bucket").applyInArrow(lambda table: pa.table(join_bucket([v.as_buffer() for v in table.column("entries")], threshold, buckets)), "b1 bigint, b2 bigint, low1 int, high1 int, low2 int, high2 int, shared int")
    counted = pairs.groupBy("b1", "b2").agg(*(F.min(c).alias(c) for c in ("low1", "low2")), *(F.max(c).alias(c) for c in ("high1", "high2")), F.sum("shared").alias("shared"), F.count("*").alias("n"))
    return counted.filter(_possible(threshold, buckets)).select("b1", "b2")


def _described(docs: DataFrame, n: int, order: Broadcast[np.ndarray], heavy: np.uint64) -> DataFrame:
    """doc_id, node (hash of the whole set), block, size and bits (which of BITS hashes its n-grams have) of every row with a word."""

    def describe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows, nodes, blocks, sizes, bits = [], [], [], [], []
            for row, keys in _sorted_sets(batch.column("text"), n, order.value):
                rows.append(row)
                nodes.append(_hash64(keys.tobytes()))
                blocks.append(_block(keys, heavy))
                sizes.append(len(keys))
                present = np.zeros(BITS, bool)
                present[(batches.mix(keys) % np.uint64(BITS)).astype(np.int64)] = True
                bits.append(np.packbits(present).tobytes())
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.int64()), pa.array(blocks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "node", "block", "size", "bits"])

    return docs.mapInArrow(describe, "doc_id bigint, node bigint, block bigint, size bigint, bits binary")


def _bloom_places(nodes: np.ndarray, ids: np.ndarray, bits: int) -> list[np.ndarray]:
    value = batches.mix(nodes.astype(np.int64).view(np.uint64) ^ batches.mix(ids.astype(np.int64).view(np.uint64)))
    return [(batches.mix(value + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in range(3)]


def _bloom(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter (bytes of 8 bits) of wanted (node, doc_id), made of partial filters of 1/SLOTS of the bits each, as gram_sketch."""
    bits = BLOOM_BITS
    part = bits // 8 // SLOTS

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(bits, bool)
        for batch in parts:
            for places in _bloom_places(batch.column("node").to_numpy(), batch.column("doc_id").to_numpy(), bits):
                filled[places] = True
        packed = np.packbits(filled)
        slots = [k for k in range(SLOTS) if packed[k * part : (k + 1) * part].any()]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array([packed[k * part : (k + 1) * part].tobytes() for k in slots], pa.binary())], ["slot", "bits"])

    def unite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in parts:
            for slot, own in zip(batch.column("slot").to_pylist(), batch.column("bits"), strict=True):
                total[slot] = total.get(slot, 0) | np.frombuffer(own.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slot", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for slot, own in wanted.coalesce(16).mapInArrow(mark, "slot int, bits binary").repartition(16, "slot").mapInArrow(unite, "slot int, bits binary").collect():
        out[slot * part : (slot + 1) * part] = np.frombuffer(own, np.uint8)
    return out


def _coded(keys: np.ndarray) -> bytes:
    """48 bits of a hash of each n-gram, in 6 bytes."""
    return (batches.mix(keys) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _decoded(blobs: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :6] = flat
    return out.view("<u8").ravel()


def _sets(docs: DataFrame, wanted: DataFrame, n: int, order: Broadcast[np.ndarray]) -> DataFrame:
    """node and its n-grams, at least for the nodes of wanted (node, doc_id: one of its documents); a node has one row or a few equal ones."""
    asked = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids = batch.column("doc_id").to_numpy()
            rows, nodes, sets = [], [], []
            for row, keys in _sorted_sets(batch.column("text"), n, order.value):
                rows.append(row)
                nodes.append(_hash64(keys.tobytes()))
                sets.append(keys)
            known = np.array(nodes, np.int64)
            passes = np.ones(len(rows), bool)
            for places in _bloom_places(known, ids[np.array(rows, np.int64)], BLOOM_BITS):
                passes &= (asked.value[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)
            at = np.flatnonzero(passes)
            yield pa.RecordBatch.from_arrays([pa.array(known[at], pa.int64()), pa.array([_coded(sets[k]) for k in at.tolist()], pa.binary())], ["node", "grams"])

    return docs.mapInArrow(build, "node bigint, grams binary")


def _shared_grams(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """How many n-grams each set of left has in common with each of right: products of 0/1 matrices, some n-grams at a time."""
    grams = _decoded([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(b) // 6 for b in [*left, *right]])
    by_gram = np.argsort(grams, kind="stable")
    grams, row = grams[by_gram], row[by_gram]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    column = np.cumsum(new) - 1
    both = np.logical_and(np.bincount(column, row < len(left)) > 0, np.bincount(column, row >= len(left)) > 0)
    keep = both[column]  # an n-gram of one side alone adds nothing
    row = row[keep]
    column = (np.cumsum(both) - 1)[column[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, int(both.sum()) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        table = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        table[row[a:b], column[a:b] - k * COLUMNS] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a tile to be compared: side 0 with side 1, or those of side 2 with each other."""
    side = table.column("side").to_numpy()
    if (side == 2).any():
        return np.flatnonzero(side == 2), np.flatnonzero(side == 2), True
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False


def prune_tile(table: pa.Table, threshold: float) -> pa.Table:
    """a, b: the pairs of blocks of which some sets may reach the threshold by their bitmaps, and with a null b the nodes of these sets.

    An n-gram whose bit the other set lacks is not in it: the n-grams of a set in common with another are at most its size
    less the bits that it alone has.
    """
    x, y, alone = _sides(table)
    node, block, size = (table.column(c).to_numpy() for c in ("node", "block", "size"))
    bits = np.unpackbits(np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(len(node), -1), axis=1).astype(np.float32)
    count = bits.sum(axis=1)
    pairs, kept = [np.zeros((0, 2), np.int64)], np.zeros(len(node), bool)
    step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
    for k in range(0, len(x), step):
        some = x[k : k + step]
        both = bits[some] @ bits[y].T
        shared = np.minimum((size[some] - count[some])[:, None] + both, (size[y] - count[y])[None, :] + both)
        a, b = np.nonzero(shared >= threshold / (1 + threshold) * (size[some][:, None] + size[y][None, :]) - 1e-3)
        a, b = some[a], y[b]
        differ = node[a] < node[b] if alone else node[a] != node[b]
        a, b = a[differ], b[differ]
        kept[a] = kept[b] = True
        pairs.append(np.unique(np.stack([np.minimum(block[a], block[b]), np.maximum(block[a], block[b])], axis=1), axis=0))
    pair = np.unique(np.concatenate(pairs), axis=0)
    alive = node[kept]
    return pa.table({"a": np.concatenate([pair[:, 0], alive]), "b": pa.array(np.concatenate([pair[:, 1], alive]), mask=np.arange(len(pair) + len(alive)) >= len(pair))})


def verify_tile(table: pa.Table, threshold: float, listed: bool) -> pa.Table:
    """The pairs of sets that reach the threshold.

    With listed one row each (a, b, jaccard); otherwise a row for each set that has a link: a, the least set b that it is
    connected to by links of this tile, and the copies of all its partners.
    """
    x, y, alone = _sides(table)
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    grams = table.column("grams").to_pylist()
    size = np.array([len(g) // 6 for g in grams], np.int64)
    found_a, found_b, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
    for k in range(0, len(x), step):
        some = x[k : k + step]
        both = _shared_grams([grams[i] for i in some], [grams[i] for i in y]).astype(np.float64)
        similarity = both / (size[some][:, None] + size[y][None, :] - both)
        a, b = np.nonzero(similarity >= threshold - 1e-12)
        score, a, b = similarity[a, b], some[a], y[b]
        keep = node[a] < node[b] if alone else node[a] != node[b]
        found_a.append(a[keep])
        found_b.append(b[keep])
        found_j.append(score[keep])
    a, b, score = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_j)
    if listed:
        return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b]), "value": score})
    links = np.bincount(a, copies[b], minlength=len(node)) + np.bincount(b, copies[a], minlength=len(node))
    root = node.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        if (root == before).all():
            break
    linked = np.flatnonzero(links)
    return pa.table({"a": node[linked], "b": root[linked], "value": links[linked].astype(np.float64)})


def _tiles(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, copies, block, size, tile and side for nodes (node, copies, block, size): the nodes of each of the pairs of blocks (b1, b2)
    meet in one tile, and any two nodes in one at most. Blocks that are alike have one home, the least of a block and its
    partners; a home's nodes are dealt out to as many parts as their size asks for, and two parts make a tile."""
    ends = pairs.select(F.col("b1").alias("block"), F.col("b2").alias("other")).unionByName(pairs.select(F.col("b2").alias("block"), F.col("b1").alias("other")))
    homes = ends.groupBy("block").agg(F.least(F.min("other"), F.first("block")).alias("home"))
    placed = cut(nodes.join(homes, "block").select("block", "home", "node", "copies", "size"))
    shares = placed.groupBy("home").agg(F.ceil(F.sum(F.col("size") + SET_GRAMS) / TILE_GRAMS).cast("int").alias("tiles"))
    first = homes.select(F.col("block").alias("b1"), F.col("home").alias("h1"))
    second = homes.select(F.col("block").alias("b2"), F.col("home").alias("h2"))
    met = pairs.join(first, "b1").join(second, "b2").select("b1", "b2", F.least("h1", "h2").alias("x"), F.greatest("h1", "h2").alias("y"))
    asked = met.select(F.col("b1").alias("block"), "x", "y").unionByName(met.select(F.col("b2").alias("block"), "x", "y")).distinct()
    parts = shares.select(F.col("home").alias("x"), F.col("tiles").alias("nx")), shares.select(F.col("home").alias("y"), F.col("tiles").alias("ny"))
    sides = asked.join(parts[0], "x").join(parts[1], "y").join(placed, "block")
    left = F.col("home") == F.col("x")
    sides = sides.withColumn("part", F.pmod(F.xxhash64("node"), F.when(left, F.col("nx")).otherwise(F.col("ny"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(left, F.col("ny")).otherwise(F.col("nx")) - 1)
    sides = sides.select("*", F.explode(others).alias("other"))
    same = F.col("x") == F.col("y")
    swap = F.when(same, F.col("part") > F.col("other")).otherwise(F.col("home") == F.col("y"))
    return sides.select(
        "node",
        "copies",
        "block",
        "size",
        F.xxhash64("x", "y", F.when(swap, F.col("other")).otherwise(F.col("part")), F.when(swap, F.col("part")).otherwise(F.col("other"))).alias("tile"),
        F.when(same & (F.col("part") == F.col("other")), F.lit(2)).otherwise(swap.cast("int")).alias("side"),
    )


def _similar_nodes(docs: DataFrame, n: int, threshold: float, listed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, node; nodes: node, doc_id (the least), copies; what verify_tile finds: a, b, value), all kept in the shared folder."""
    docs = batches.with_doc_columns(docs).filter("doc_id is not null and text is not null")
    docs = docs.select("doc_id", F.lower("text").alias("text"))
    ranks, grams = gram_sketch(docs, n, _sketch_bits(docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0))
    usual = 2 ** (float(np.median(ranks[::16])) / 1024) - 1  # of some slots, which are hashes
    heavy = np.uint64(_rank(np.array([usual + 6 * math.sqrt(usual)]))[0]) << np.uint64(48)
    order = docs.sparkSession.sparkContext.broadcast(ranks)
    entries = grams * (1 - threshold)
    buckets = max(1, math.ceil(entries / BUCKET_ENTRIES), min(LEAST_BUCKETS, math.ceil(entries / ENTRIES_AT_ONCE)))
    described = cut(_described(docs, n, order, heavy))
    nodes = described.select("doc_id", "node", "block", "size").distinct().groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("block").alias("block"), F.first("size").alias("size"))
    nodes = cut(nodes)
    own = nodes.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("block").alias("b1"), F.col("block").alias("b2"))
    pairs = cut(_candidates(docs, n, threshold, order, heavy, buckets).unionByName(own))
    bits = described.select("node", "doc_id", "bits").join(nodes.select("node", "doc_id"), ["node", "doc_id"]).groupBy("node").agg(F.first("bits").alias("bits"))
    rough = _tiles(pairs, nodes).join(bits, "node").select("tile", "side", "node", "block", "size", "bits")
    kept = cut(rough.groupBy("tile").applyInArrow(lambda table: prune_tile(table, threshold), "a bigint, b bigint"))
    pairs = cut(kept.filter("b is not null").select(F.col("a").alias("b1"), F.col("b").alias("b2")).distinct())
    wanted = cut(nodes.join(kept.filter("b is null").select(F.col("a").alias("node")).distinct(), "node"))
    located = _tiles(pairs, wanted.drop("doc_id")).select("tile", "side", "node", "copies")
    held = _sets(docs, wanted.select("node", "doc_id"), n, order).groupBy("node").agg(F.first("grams").alias("grams"))
    rows = held.join(located, "node").select("tile", "side", "node", "copies", "grams")
    found = cut(rows.groupBy("tile").applyInArrow(lambda table: verify_tile(table, threshold, listed), "a bigint, b bigint, value double"))
    return described.select("doc_id", "node").distinct(), nodes.select("node", "doc_id", "copies"), found


def similar_documents(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_a, doc_b, jaccard: all pairs of different sets that reach the threshold, each set named by its smallest doc_id; and
    doc_a with every other document doc_b of the same set, with jaccard 1.

    So a document doc_b is as similar to another set as its doc_a is. In pairs of sets doc_a < doc_b. Words are compared in
    lower case. A document of fewer than n words has one n-gram, all its words. Rows with a null doc_id or a null text, and
    texts without a word, take no part. Rows that share doc_id and set are one document; a doc_id that stands for several
    sets may be in pairs with itself. Other columns are ignored.
    """
    described, nodes, pairs = _similar_nodes(docs, n, threshold, listed=True)
    named = nodes.select("node", "doc_id")
    across = pairs.join(named.select(F.col("node").alias("a"), F.col("doc_id").alias("x")), "a").join(named.select(F.col("node").alias("b"), F.col("doc_id").alias("y")), "b")
    across = across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.col("value").alias("jaccard"))
    copies = described.join(nodes.filter("copies > 1").select("node", F.col("doc_id").alias("doc_a")), "node").filter("doc_id <> doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return across.unionByName(copies)


def similarity_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links: a row for every document that is similar to another one.

    n_links is the number of all other documents whose similarity to this one reaches the threshold, copies included. A
    class is a connected component of these links, class_id the smallest doc_id in it. What takes part, and how repeated
    rows count, is said in similar_documents; a doc_id with several sets has a row for each of them that has a link.
    """
    described, nodes, found = _similar_nodes(docs, n, threshold, listed=False)
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("value").cast("bigint").alias("links"))
    linked = nodes.join(links, "node", "left").join(components(found.select("a", "b")), "node", "left").filter("copies > 1 or links is not null")
    linked = linked.select("node", "doc_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = linked.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return described.join(linked.join(named, "component").select("node", "class_id", "n_links"), "node").select("doc_id", "class_id", "n_links")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of edges (a, b), by alternating large and small stars."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, cut(small.distinct())
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def drop_similar(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class of similarity_classes, that with the smallest doc_id; all columns stay.

    What takes no part there (null doc_id, null text, no word) stays. Rows that share a doc_id stay or go together.
    """
    gone = similarity_classes(docs, n, threshold).filter("doc_id <> class_id").select("doc_id").distinct()
    return batches.without(docs, gone)


def similarity_classes_sql(n: int = NGRAM, threshold: float = THRESHOLD) -> str:
    """similarity_classes over the table documents, for DuckDB, by an equi-join of all n-grams and a walk along the links."""
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list_transform(range(1, CAST(greatest(len(w) - {n - 1}, 1) + 1 AS BIGINT)), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))) AS grams FROM d WHERE len(w) > 0),
    k AS (SELECT row_number() OVER (ORDER BY min(doc_id), grams) AS node, min(doc_id) AS first_id, count(*) AS copies, len(grams) AS size, grams FROM s GROUP BY grams),
    g AS (SELECT node, size, copies, unnest(grams) AS gram FROM k),
    o AS (SELECT x.node AS a, y.node AS b, count(*) AS shared, any_value(x.size) AS sa, any_value(y.size) AS sb, any_value(y.copies) AS copies FROM g x JOIN g y ON x.gram = y.gram AND x.node <> y.node GROUP BY 1, 2),
    p AS (SELECT a, b, copies FROM o WHERE CAST(shared AS DOUBLE) / (sa + sb - shared) >= {threshold} - 1e-12),
    r AS (SELECT node AS origin, node FROM k UNION SELECT r.origin, p.b FROM r JOIN p ON p.a = r.node),
    c AS (SELECT origin AS node, min(k.first_id) AS class_id FROM r JOIN k ON k.node = r.node GROUP BY 1),
    l AS (SELECT a AS node, sum(copies) AS links FROM p GROUP BY 1)
    SELECT s.doc_id, c.class_id, CAST(k.copies - 1 + coalesce(l.links, 0) AS BIGINT) AS n_links
    FROM s JOIN k ON k.grams = s.grams JOIN c ON c.node = k.node LEFT JOIN l ON l.node = k.node WHERE k.copies > 1 OR l.links IS NOT NULL
    """
