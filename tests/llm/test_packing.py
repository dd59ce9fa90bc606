import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from refminer.llm import queries, token_counts
from refminer.llm.packing import best_fill, minimum_bin_slack, pack_documents


def reachable(remaining, room):
    sums = {0}
    for length, n in remaining.items():
        for _ in range(n):
            sums |= {s + length for s in sums if s + length <= room}
    return max(sums)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=7), st.integers(0, 90))
def test_fill_is_the_closest_possible(remaining, room):
    counts = best_fill(remaining, room)
    assert all(0 < n <= remaining[k] for k, n in counts.items())
    assert sum(k * n for k, n in counts.items()) == reachable(remaining, room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_every_piece_lies_in_one_window(histogram):
    used = Counter()
    for times, counts in minimum_bin_slack(histogram, 64):
        assert times > 0 and sum(k * n for k, n in counts.items()) <= 64
        used.update({k: n * times for k, n in counts.items()})
    assert used == Counter(histogram)


def test_documents_are_covered_without_gap(make_docs):
    rng = random.Random(1)
    sizes = [rng.choice([1, 3, 10, 17, 31, 32, 33, 64, 100, 257]) for _ in range(300)]
    out = pack_documents(make_docs([" ".join(["w"] * n) for n in sizes]), capacity=32).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.piece, r.start, r.n_tokens))
        windows[r.window_id].append((r.offset, r.n_tokens))
    for k, n in enumerate(sizes):
        at = 0
        for i, (piece, start, tokens) in enumerate(sorted(pieces[k])):
            assert (piece, start) == (i, at)
            at += tokens
        assert at == n
    assert sorted(windows) == list(range(len(windows)))
    for placed in windows.values():
        at = 0
        for offset, tokens in sorted(placed):
            assert offset == at
            at += tokens
        assert at <= 32
    assert sum(sizes) / (32 * len(windows)) > 0.97


def test_query_packs_tokens(spark, make_docs, tmp_path):
    docs = make_docs(["one two three", "漢字" * 3000, "x1Zq" * 3000, None, "", (7, "a b"), (7, "a b c d"), (None, "null id")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, got, windows = Counter(), Counter(), Counter()
    for r in token_counts.count_tokens(docs).collect():
        want[r.doc_id] += r.n_tokens
    for r in queries.op2_packing(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.n_tokens
        windows[r.window_id] += r.n_tokens
    assert got == +want and want[1] > 2048 and max(windows.values()) <= 2048
