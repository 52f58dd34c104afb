"""Neighbours, fingerprints, components, near duplicates and line chunks."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import ann, graph, lines, neardup, queries, simhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    parts = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    root = [find(k) for k in range(len(prints))]
    low = {r: min((ids[k] for k in range(len(ids)) if root[k] == r and ids[k] is not None), default=None) for r in set(root)}
    return [low[r] for r in root]


def test_op7_by_brute_force(spark, small, corpus):
    prints = [fingerprint(r["text"]) for r in corpus]
    ids = [r["doc_id"] for r in corpus]
    want = sorted(zip(ids, (format(p, "016x") for p in prints), components(prints, ids, 3)))
    got = sorted(map(tuple, queries.op7_simhash_near_dedup(spark, small).collect()))
    assert got == want


def test_op7_odd_rows(spark, odd):
    rows = odd.collect()
    prints = [fingerprint(r.text) for r in rows]
    want = sorted(zip((r.doc_id for r in rows), components(prints, [r.doc_id for r in rows], 3)), key=repr)
    got = [(r.doc_id, r.component_id) for r in simhash.components(odd).collect()]
    assert sorted(got, key=repr) == want
    assert simhash.components(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "hot"), [(3, 4096), (6, 4096), (3, 8)])
def test_links_join_what_pairs_join(spark, monkeypatch, radius, hot):
    """Clusters around centres, some larger than a bucket may hold."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rng = np.random.default_rng(radius + hot)
    values = set()
    for _ in range(12):
        centre = int(rng.integers(0, 2**63))
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            values.add(centre ^ sum(1 << int(b) for b in flips))
    values |= {int(v) for v in rng.integers(0, 2**63, 200)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.links(nodes, radius).collect()
    prints = [v % (1 << 64) for v in signed]
    want = components(prints, signed, radius)
    labels = {r.node: r.label for r in graph.connected_components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()}
    assert [labels.get(v, v) for v in signed] == want
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= radius for r in found if r.verified)


def test_scheme_covers_the_radius():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    both = bits.T @ bits
    for n in (100, 10**6, 10**10):
        for radius in (1, 3, 9):
            s = simhash.choose_scheme(n, np.diag(both) * n // 500, both * n // 500, radius)
            assert sum(t + 1 for t in s.radii) == radius + 1
            assert sorted(b for g in s.bits for b in g) == list(range(64))


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_components_of_chains(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.label for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_stage(spark):
    base = [f"token{k}" for k in range(200)]
    changed = [*base[:100], "new", *base[101:]]
    rows = [(5, " ".join(base)), (3, " ".join(changed)), (4, " ".join(base)), (9, " ".join(f"x{k}" for k in range(200))), (9, " ".join(f"x{k}" for k in range(200))), (None, "lonely"), (11, None), (12, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = neardup.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [11, 3, 9, None]
    assert neardup.keep_one(docs.limit(0)).count() == 0


def shingles(text, size=5):
    words = re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))
    return {" ".join(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))} if words else set()


def jaccard_groups(texts):
    """Least index of each text's group, from all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def found_groups(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = neardup.near_duplicates(docs, **options).collect()
    low = {}
    for r in rows:
        low[r.label] = min(low.get(r.label, r.doc_id), r.doc_id)
    return [low[r.label] for r in sorted(rows, key=lambda r: r.doc_id)]


def dense_texts():
    """One group of many candidate pairs, most of them below 0.8, whose texts
    hold together by chains."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(60):
        copy = [f"w{j}" for j in range(150)]
        for mark, changes in (("x", 5), ("z", 2)):
            for at in rng.choice(150, changes, replace=False):
                copy[at] = f"{mark}{k}y{at}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("block", "held"), [(1024, 1 << 20), (50, 8), (7, 1 << 20)])
def test_dense_groups_lose_no_link(spark, monkeypatch, block, held):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    monkeypatch.setattr(graph, "HELD", held)
    texts = dense_texts()
    want = jaccard_groups(texts)
    assert 1 < len(set(want)) < 120
    assert found_groups(spark, texts) == want


def edited_texts():
    """120 pairs at 0.8 to 0.9: a block replaced, words appended or scattered."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(120):
        n = int(rng.integers(60, 400))
        words, share = [f"p{k}w{j}" for j in range(n)], rng.uniform(0.81, 0.9)
        if k % 3 == 0:
            m = int(n * (1 - share) / (1 + share)) - 4
            at = int(rng.integers(0, n - m))
            copy = [*words[:at], *(f"p{k}n{j}" for j in range(m)), *words[at + m :]]
        elif k % 3 == 1:
            copy = words + [f"p{k}n{j}" for j in range(int(n / share) - n)]
        else:
            copy = list(words)
            for at in rng.choice(n, max(1, int(n * (1 - share) / (1 + share) / 5)), replace=False):
                copy[at] = f"p{k}n{at}"
        texts += [" ".join(words), " ".join(copy)]
    return texts


def test_pairs_just_over_the_threshold_are_found(spark):
    texts = edited_texts()
    want = jaccard_groups(texts)
    assert sum(want[k] == want[k + 1] for k in range(0, 240, 2)) >= 115
    assert found_groups(spark, texts) == want


def repetitive_texts():
    """Texts of equal fingerprint, in six groups that share one word alone."""
    out = []
    for g in range(6):
        words = [f"g{g}w{j}" for j in range(120)]
        out += [" ".join(["again"] * 1500 + words[:60] + [f"t{t}"] + words[60:]) for t in range(3)]
    return out


def test_texts_of_one_fingerprint_meet_each_other(spark):
    texts = repetitive_texts()
    assert len({fingerprint(t) for t in texts}) == 1
    want = jaccard_groups(texts)
    assert want == [k // 3 * 3 for k in range(18)]
    assert found_groups(spark, texts) == want


def nearest(ids, vectors, k=5):
    out = {}
    m = np.array(vectors, dtype=np.float64)
    norm = np.sqrt((m * m).sum(1))
    for q in range(len(ids)):
        if ids[q] % 50:
            continue
        s = (m * m[q]).sum(1) / (norm * norm[q])
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-s[j], ids[j]))[:k]
        out[ids[q]] = [(ids[j], s[j]) for j in order]
    return out


def test_op6_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    want = nearest([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {}
    for r in queries.op6_nearest_neighbours(spark, small).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = sum(a == b for q in want for (a, _), (b, _) in zip(want[q], got[q]))
    assert set(got) == set(want) and hits / (5 * len(want)) >= 0.9


def test_factor_one_is_exact_and_copies_tie(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 6)).astype(np.float32)
    vectors[100:400] = vectors[100]  # a large group of copies
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), factor=1.0, shard_rows=200, block_rows=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = nearest([r[0] for r in rows], [r[1] for r in rows])
    assert got == {q: [v for v, _ in x] for q, x in want.items()}


@pytest.mark.parametrize("factor", [0.5, 1.0])
def test_scaled_vectors_tie_by_exact_score_and_id(spark, factor):
    """More vectors of one direction than k, and many equal scores besides."""
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(300, 4)), 2) + 0.001
    for k in range(0, 300, 5):
        vectors[k] = [1.0 * (k + 1), 0, 0, 0]
    for k in range(1, 300, 5):
        vectors[k] = [1.0, 1.0, 0, 0]
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), factor=factor, shard_rows=90, block_rows=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = nearest([r[0] for r in rows], [r[1] for r in rows])
    assert got == {q: [v for v, _ in x] for q, x in want.items()}


def test_a_query_with_many_vectors_of_its_own_id(spark):
    rows = [(50, [1.0, 0.01 * k]) for k in range(20)] + [(k, [1.0, 0.5 + 0.01 * k]) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 50 AND embedding[1] = 0"), factor=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


def test_every_query_row_is_asked_and_frequent_ids_are_dealt(spark):
    """One id with a third of all rows and many vectors, and one vector with
    another third, over several shards of real depth."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(1800, 8))
    vectors[600:1200] = vectors[600]
    ids = [50 if k < 600 else k + 1000 for k in range(1800)]
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
    rows += rows[:40] + [(7, rows[3][1])] * 9  # equal rows, asked once, counted as often as they are
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sizes = df.groupBy(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(4))).count().collect()
    assert max(r["count"] for r in sizes) < 0.4 * len(rows)
    got = ann.nearest(df, df.where("vec_id = 50"), factor=1.0, shard_rows=450, block_rows=64)
    found = {}
    for r in got.collect():
        found.setdefault(r.rank, []).append((r.vec_id, round(r.score, 12)))
    asked = sorted({tuple(v) for i, v in rows if i == 50})
    m = np.array([v for i, v in rows if i != 50])
    others = [i for i, _ in rows if i != 50]
    want = {}
    for v in asked:
        s = (m * np.array(v)).sum(1) / (np.sqrt((m * m).sum(1)) * np.sqrt((np.array(v) ** 2).sum()))
        for rank, j in enumerate(sorted(range(len(m)), key=lambda j: (-s[j], others[j]))[:5], 1):
            want.setdefault(rank, []).append((others[j], round(float(s[j]), 12)))
    assert len(asked) == 600 and {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("spread", [0.3, 1.0])
def test_recall_of_the_relaxed_factor_over_deep_shards(spark, spread):
    """At 0.5 over four shards of several levels, clustered and unclustered."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 24))
    vectors = centres[rng.integers(0, 40, 8000)] + spread * rng.normal(size=(8000, 24))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    want = nearest(list(range(8000)), vectors)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), factor=0.5, shard_rows=2000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {v for v, _ in x}) for q, x in want.items())
    assert hits >= 0.9 * 5 * len(want)


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, [1.0, 1.0]), (None, [1.0, 0.0]), (5, []), (6, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 4)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


PASSAGE = "\n".join(" ".join(f"shared{k}w{j}" for j in range(12)) for k in range(5))
LONG_LINE = " ".join(f"long{j}" for j in range(60))


def test_shared_passages_go_and_their_surroundings_stay(spark):
    def unique(k, n=4):
        return "\n".join(" ".join(f"u{k}x{i}y{j}" for j in range(9)) for i in range(n))

    texts = {k: f"{unique(k)}\n{PASSAGE}\n{unique(100 + k)}" for k in range(4)}
    texts |= {k: f"{unique(k)}\n{LONG_LINE}\n{unique(200 + k, 1)}" for k in range(4, 7)}
    texts |= {7: f"All rights reserved.\n{unique(7)}", 8: f"All rights reserved.\n{unique(8)}"}
    docs = spark.createDataFrame([(k, t, "en", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, n_chars long")
    out = lines.dedup(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: r.text for r in out.collect()}
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert got[0] == texts[0] and got[4] == texts[4] and got[7] == texts[7] and got[8] == texts[8]
    assert all(got[k] == f"{unique(k)}\n{unique(100 + k)}" for k in (1, 2, 3))
    assert all(got[k] == f"{unique(k)}\n{unique(200 + k, 1)}" for k in (5, 6))


def dedup_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in lines.dedup(docs).orderBy("doc_id").collect()]


def test_passages_with_lines_of_unequal_counts_go(spark):
    """Paragraphs with a blank line between, which nearly all texts hold, and
    a passage of which another text holds one line."""
    first, second = (" ".join(f"{p}{j}" for j in range(30)) for p in ("first", "second"))
    wrapped = [" ".join(f"wrap{k}w{j}" for j in range(12)) for k in range(5)]
    texts = [f"own {k}\n{first}\n\n{second}\nend {k}" for k in range(3)]
    texts += [f"own {k}\n\nend {k}" for k in range(3, 8)]
    texts += ["\n".join([f"own {k}", *wrapped, f"end {k}"]) for k in range(8, 11)]
    texts += [f"own 11\n{wrapped[2]}\nend 11"]
    want = [t if k in (0, 8) else f"own {k}\nend {k}" if k in (1, 2, 9, 10) else t for k, t in enumerate(texts)]
    assert dedup_texts(spark, texts) == want


def test_passages_beside_shared_lines_of_equal_count_go(spark):
    """Each passage stands beside a line that another text holds too, so that
    its count equals the passage's."""
    texts, want = [], []
    for k in range(20):
        passage = "\n".join(" ".join(f"p{k}l{i}w{j}" for j in range(12)) for i in range(5))
        texts += [f"own {k} a\nheader {k}\n{passage}\nend {k} a", f"own {k} b\n{passage}\nend {k} b", f"own {k} c\nheader {k}\nend {k} c"]
        want += [texts[-3], f"own {k} b\nend {k} b", texts[-1]]
    assert dedup_texts(spark, texts) == want


def test_short_chunks_and_repeats_within_a_text_go(spark):
    short = "\n".join(["one two three", "four five six", "seven eight nine"])
    texts = [f"own {k} a\n{short}\nown {k} b" for k in range(4)]
    twice = "\n".join(" ".join(f"twice{i}w{j}" for j in range(12)) for i in range(5))
    texts.append(f"begin\n{twice}\nmiddle\n{twice}\nend")
    texts += ["left 5\n\nAll rights reserved.\nright 5", "left 6\n\nAll rights reserved.\nright 6"]  # one line with words
    want = [texts[0], *(f"own {k} a\nown {k} b" for k in (1, 2, 3)), f"begin\n{twice}\nmiddle\nend", *texts[5:]]
    assert dedup_texts(spark, texts) == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in lines.dedup(docs, least_words=20).orderBy("doc_id").collect()][:4] == texts[:4]


def plain_dedup(texts, least_words=0):
    """Chunks by the operator's boundaries, everything else by plain loops."""
    from collections import Counter

    split = [t.split("\n") for t in texts]
    hashes = [np.array([xxhash.xxh64_intdigest(x) for x in s], dtype=np.uint64) for s in split]
    words = [np.array([len(x.split()) for x in s]) for s in split]
    seen = Counter()
    for h, w in zip(hashes, words):
        seen.update(lines.line_pairs(h).tolist() + h[w >= lines.LONG_WORDS].tolist())
    shared = {h: n for h, n in seen.items() if n > 1}
    first, out = {}, []
    for k, (s, h, w) in enumerate(zip(split, hashes, words)):
        gone = set()
        for a, b, _ in lines.chunk(h, w, shared, least_words):
            if first.setdefault("\n".join(s[a:b]), (k, a)) != (k, a):
                gone |= set(range(a, b))
        out.append("\n".join(x for i, x in enumerate(s) if i not in gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["", *(" ".join(f"p{k}x{j}" for j in range(int(rng.integers(1, 15)))) for k in range(30)), LONG_LINE]
    passages = [[pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(2, 12)))] for _ in range(8)]
    texts = []
    for k in range(60):
        parts = []
        for i in range(int(rng.integers(0, 5))):
            parts += passages[int(rng.integers(0, 8))] if rng.random() < 0.5 else [f"u{k} {i} {j}" for j in range(3)]
        texts.append("\n".join(parts))
    got = dedup_texts(spark, texts)
    assert got == plain_dedup(texts)
    assert sum(map(len, got)) < 0.7 * sum(map(len, texts))


def test_planted_passages_leave_but_one_copy(spark):
    """Passages of over 50 words in varying surroundings, by plain counting."""
    rng = np.random.default_rng(9)
    passages = ["\n".join(" ".join(f"q{p}l{i}w{j}" for j in range(13)) for i in range(5)) for p in range(12)]
    texts = []
    for k in range(90):
        body = [f"unique {k} line {i} " + " ".join(f"z{k}i{i}j{j}" for j in range(8)) for i in range(4)]
        body.insert(int(rng.integers(0, 5)), passages[k % 12])
        texts.append("\n".join(body))
    got = dedup_texts(spark, texts)
    assert [sum(p in t for t in got) for p in passages] == [1] * 12
    assert all(all(x in g.split("\n") for x in t.split("\n") if x.startswith("unique")) for t, g in zip(texts, got))


def test_line_dedup_odd_rows(spark, odd):
    got = lines.dedup(odd)
    assert got.schema == odd.schema
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert lines.dedup(odd.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=30), max_size=6))
def test_line_tables(texts):
    import pyarrow as pa

    starts, ends, _, words, rows = lines.line_table(pa.array(texts, pa.string()))
    raw = "".join(texts)
    got = [[(raw[a:b], int(w)) for a, b, w in zip(starts[i:j], ends[i:j], words[i:j])] for i, j in zip(rows[:-1], rows[1:])]
    assert got == [[(x, len(x.split())) for x in t.split("\n")] for t in texts]
