"""Codes, packing and byte-level BPE against the tokenizer libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import bpe, dac, packing, queries


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.data())
def test_codes_read_back_anywhere(ids, data):
    segment = dac.Segment(dac.encode(np.array(ids, dtype=np.uint32)))
    i = data.draw(st.integers(0, len(ids)))
    j = data.draw(st.integers(i, len(ids)))
    assert segment.read(i, j).tolist() == ids[i:j]
    assert all(segment[k] == ids[k] for k in range(0, len(ids), 97))


def test_widths_are_the_cheapest():
    lengths = np.zeros(33, dtype=np.int64)
    lengths[[2, 9]] = 1000, 10
    assert sum(dac.level_widths(lengths)) == 9 and len(dac.level_widths(lengths)) == 2


def test_op1_matches_the_library(spark, small, corpus):
    encode, start, want = library("word_bpe_49k.json"), 0, {}
    for row in sorted(corpus, key=lambda r: r["doc_id"]):
        ids = encode(row["text"])
        want[row["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_codes(spark, small).collect()}
    assert got == want


def test_op1_odd_rows(spark, odd):
    path = queries.tokenizer_path("word_bpe_49k.json")
    encode = library("word_bpe_49k.json")
    got = dac.read_documents(dac.write_segments(odd, path, 2, segment_tokens=16)).orderBy("start").collect()
    assert len(got) == odd.count() and [r.doc_id for r in got][:2] == [None, None]
    assert sum(r.n_tokens for r in got) == sum(len(encode(r.text)) for r in odd.collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert dac.read_documents(dac.write_segments(odd.limit(0), path, 2)).count() == 0


def test_single_tokens_are_read_from_the_stored_codes(spark, small, corpus, odd):
    encode, path = library("word_bpe_49k.json"), queries.tokenizer_path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stored = dac.write_segments(docs, path, 2, segment_tokens=500)
    rows = corpus[::7]
    ids = {r["doc_id"]: encode(r["text"]) for r in rows}
    asked = [(d, p) for d, x in ids.items() for p in {0, len(x) // 2, len(x) - 1, len(x), -1}] + [(-5, 0), (rows[0]["doc_id"], 0), (None, 1)]
    got = dac.read_tokens(stored, spark.createDataFrame(asked, "doc_id long, position long")).collect()
    want = [(d, p, ids[d][p] if d in ids and 0 <= p < len(ids[d]) else None) for d, p in asked if d is not None]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    empty = dac.write_segments(odd.limit(0), path, 2)
    assert [r.token for r in dac.read_tokens(empty, spark.createDataFrame([(1, 0)], "doc_id long, position long")).collect()] == [None]


def test_op1_deals_a_frequent_id_to_several_shards(spark):
    path, encode = queries.tokenizer_path("word_bpe_49k.json"), library("word_bpe_49k.json")
    rows = [(7 if k % 3 else k if k % 2 else None, f"text number {k} of many") for k in range(300)]
    stored = dac.write_segments(spark.createDataFrame(rows, "doc_id long, text string"), path, 2, segment_tokens=64)
    got = dac.read_documents(stored).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(encode(t), dtype="<u4").tobytes()) for _, t in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    sizes = [r.n for r in stored.groupBy("shard").agg({"n_tokens": "sum"}).toDF("shard", "n").collect()]
    assert len(sizes) == 3 and max(sizes) < 0.5 * sum(sizes)


def check_packing(rows, size=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_op3_matches_the_library(spark, small, corpus):
    encode = library("byte_bpe_50k.json")
    rows = queries.op3_sequence_packing(spark, small).collect()
    n = check_packing(rows)
    assert n <= -(-sum(r.length for r in rows) // 1024) * 1.01 + 1
    texts = {r["doc_id"]: r["text"] for r in corpus}
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
    assert set(seen) == set(texts)
    for doc, parts in seen.items():
        ids = np.array(encode(texts[doc]), dtype="<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 1024 for r in parts[1:])
        assert sum(r.length for r in parts) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)


def test_op3_odd_rows(spark, odd):
    cut = packing.pieces(odd, queries.tokenizer_path("byte_bpe_50k.json"), 2, 64, with_ids=True)
    rows = packing.pack(cut, 64).collect()
    check_packing(rows, 64)
    assert all(len(r.ids) == 4 * r.length for r in rows) and sum(r.piece == 0 for r in rows) == odd.count()
    empty = packing.pieces(odd.limit(0), queries.tokenizer_path("byte_bpe_50k.json"), 2, 64)
    assert packing.pack(empty, 64).count() == 0


def fewest(items, size):
    """Fewest bins by exhaustive search."""
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= size:
                go(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_plan_is_optimal_on_small_cases(items):
    counts = np.bincount(items, minlength=21)
    plan = packing.plan(counts, 20)
    used = np.zeros(21, dtype=int)
    for p in plan:
        assert sum(p.lengths) <= 20
        for v in p.lengths:
            used[v] += p.count
    assert (used == counts).all()
    assert sum(p.count for p in plan) == fewest(sorted(items, reverse=True), 20)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(3, 20), min_size=9, max_size=13))
def test_exhaustive_plans_are_optimal(items):
    counts = np.bincount(items, minlength=21)
    best = packing.plan(counts, 20, nodes=None, width=None, effort=None)
    used = np.zeros(21, dtype=int)
    for p in best:
        assert sum(p.lengths) <= 20
        np.add.at(used, list(p.lengths), p.count)
    assert (used == counts).all()
    fewest_ = sum(p.count for p in best)
    assert fewest_ == fewest(sorted(items, reverse=True), 20)
    assert fewest_ <= sum(p.count for p in packing.plan(counts, 20))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(1, 20))
def test_fillings_are_the_undominated_sets(items, room):
    from itertools import combinations

    counts = np.bincount(items, minlength=room + 1)
    every = {tuple(sorted(c, reverse=True)) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room}
    want = set()
    for c in every:
        rest = list(items)
        for v in c:
            rest.remove(v)
        if not any(v <= room - sum(c) for v in rest):
            want.add(c)
    got = packing.fillings(counts, room)
    assert set(got) <= want
    # Each other maximal set fits into one that was kept.
    assert all(any(packing._fits_inside(c, g) for g in got) for c in want)


@pytest.mark.parametrize("wide", [False, True])
def test_op4_matches_the_library(spark, small, corpus, odd, wide):
    import tiktoken

    path = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = [(r.doc_id, r.text) for r in odd.collect()] if wide else [(r["doc_id"], r["text"]) for r in corpus]
    want = []
    for doc, text in rows:
        ids = np.array(own.encode_ordinary(text or ""), dtype="<u4").tobytes()
        want.append((doc, len(ids) // 4, sha(ids), sha((text or "").encode())))
    found = bpe.round_trip(odd, path, public_tokenizers.PATTERN) if wide else queries.op4_byte_level_bpe(spark, small)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_op4_empty_and_full_output(spark, odd):
    path = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    assert bpe.round_trip(odd.limit(0), path, public_tokenizers.PATTERN).count() == 0
    got = bpe.round_trip(odd.where("doc_id = 7"), path, public_tokenizers.PATTERN, with_ids=True).first()
    assert got.decoded.decode() == odd.where("doc_id = 7").first().text and len(got.ids) == 4 * got.n_tokens


@given(st.lists(st.integers(0, 2**31 - 1), max_size=300))
def test_varints(values):
    assert bpe.unvarints(bpe.varints(np.array(values, dtype=np.int64))).tolist() == values


def uniform(low, high, pieces, seed=1):
    return np.bincount(np.random.default_rng(seed).integers(low, high + 1, pieces), minlength=1025)


def nine_lengths(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1025, dtype=np.int64)
    counts[rng.choice(np.arange(150, 600), 9, replace=False)] = rng.integers(100, 600, 9)
    return counts


@pytest.mark.parametrize(
    "counts,excess",
    [(uniform(250, 420, 20_000), 0.001), (uniform(1, 1024, 20_000), 0.001), (uniform(342, 900, 20_000), 0.001), (uniform(200, 350, 5000), 0.01), *((nine_lengths(k), 0) for k in range(6))],
)
def test_plans_of_production_budgets_are_near_the_bound(counts, excess):
    plan = packing.plan(counts, 1024)
    packed = np.zeros(1025, dtype=np.int64)
    for p in plan:
        assert sum(p.lengths) <= 1024 and p.count > 0
        for v in p.lengths:
            packed[v] += p.count
    assert (packed == counts).all()
    bound, best_fit = packing.lower_bound(counts, 1024), packing.used(packing.best_fit_decreasing(counts, 1024))
    bound = max(bound, packing.relax(counts, 1024, best_fit, 1e9)[1])
    assert bound <= packing.used(plan) <= min(best_fit, bound * (1 + excess) + 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_hold(items):
    counts = np.bincount(items, minlength=21)
    least = fewest(sorted(items, reverse=True), 20)
    _, relaxed = packing.relax(counts, 20, 10**6, 1e9)
    assert packing.lower_bound(counts, 20) <= least and relaxed <= least


def test_relaxation_finds_what_greedy_fillings_miss():
    """Threes and quarters: best fit mixes them, the optimum doesn't."""
    for k in range(4):
        counts = nine_lengths(k)
        _, bound = packing.relax(counts, 1024, 10**9, 1e9)
        assert packing.used(packing.plan(counts, 1024)) == bound
