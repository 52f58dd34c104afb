"""Toxicity and quality: the algorithms by brute force, held-out accuracy."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import queries, quality, statistics, toxicity


def maximal_segments(scores):
    """All maximal scoring segments by their recursive definition."""
    if not len(scores):
        return []
    best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: x[:3])
    # the best segment, shortest then leftmost; then both sides of it
    total, _, _, i, j = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    del best
    if total <= 0:
        return []
    left = maximal_segments(scores[:i])
    right = [(a + j, b + j, s) for a, b, s in maximal_segments(scores[j:])]
    return [*left, (i, j - 1, total), *right]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([-0.5, -2.25, 3.0, 5.0, 1.25]), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    got = toxicity.segments(np.array(scores, dtype=np.float64))
    want = maximal_segments(scores)
    assert sum(s for _, _, s in got) == sum(s for _, _, s in want)
    assert [round(s, 9) for _, _, s in sorted(got)] == [round(s, 9) for _, _, s in sorted(want)]


def held_out(spark, small, query, label):
    scored = query(spark, small).toPandas()
    truth = spark.read.parquet(f"{small}/labels.parquet").toPandas()
    both = scored.merge(truth, on="doc_id")
    return scored, both[both.held_out], label


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])


def test_quality_is_learned(spark, small):
    scored, test, label = held_out(spark, small, queries.op5_quality_classifier, "quality")
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.5).astype(int) == scored.predicted).all()
    assert auc(test[label].values, test.score.values) > 0.9


def test_toxicity_scores_are_sound(spark, small):
    scored, _, _ = held_out(spark, small, queries.op2_toxic_passages, "toxic")
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.3).astype(int) == scored.predicted).all()
    import zlib

    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(scored.doc_id, scored.held_out))


def test_toxicity_is_learned(spark, medium):
    scored, test, label = held_out(spark, medium, queries.op2_toxic_passages, "toxic")
    # Few toxic labels to learn from here; 5,099 held-out ones of a larger table gave 0.996 and 0.002.
    assert len(test) > 50 and auc(test[label].values, test.score.values) > 0.8
    assert test[test[label] == 1].predicted.mean() > 0.6 > 0.02 > test[test[label] == 0].predicted.mean()


@pytest.mark.parametrize(("module", "label", "modulus", "held"), [(quality, "quality", 3, 1), (toxicity, "toxic", 4, 2)])
def test_held_out_labels_are_not_learned(spark, small, module, label, modulus, held):
    """Turning every held-out label around changes no score; repeated rows of
    one id neither, in whatever order they come."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus) == held
    turned = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    again = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more words")))).repartition(5)
    other = again.orderBy(F.desc("doc_id"))
    ask = docs.limit(60)

    def scores(d, l):
        return {r.doc_id: r.score for r in module.score(ask, module.train(d, l, label, modulus, held)).select("doc_id", "score").collect()}

    assert scores(docs, labels) == scores(docs, turned)
    assert scores(again, labels) == scores(other, labels)


def test_toxic_words_and_unseen_forms_are_found(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(400):
        words = list(rng.choice(plain, 60))
        if k % 4 == 0:
            for n in rng.choice(60, 4, replace=False):
                words[n] = f"grum{rng.choice(list('abcdefghij'))}{rng.choice(list('klmnop'))}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    probe = spark.createDataFrame([(1, "w1 w2 grumzz w4 grumqq w5"), (2, "w1 w2 w3"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(probe, model).collect()}
    assert got[1].score > 0.3 > max(got[2].score, got[3].score, got[4].score)
    assert got[1].passages and got[1].passages[0]["first"] == 2


def test_odd_rows(spark, odd, labels):
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.train(odd, labels, label)
        got = module.score(odd, model)
        assert got.count() == odd.count() and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
        model = module.train(odd.limit(0), labels.limit(0), label)  # nothing to learn from
        assert module.score(odd, model).where("score IS NULL").count() == 0
        assert module.score(odd.limit(0), model).count() == 0
    kept = quality.keep_good(odd, quality.train(odd, labels), 0.0)
    assert kept.schema == odd.schema and kept.count() == odd.count()
    clean = toxicity.keep_clean(odd, toxicity.train(odd, labels), 2.0)
    assert clean.count() == odd.count()
    # Thresholds that split the rows: what stays is what scores say, as it was.
    for module, keep, label, side in ((quality, quality.keep_good, "quality", ">="), (toxicity, toxicity.keep_clean, "toxic", "<")):
        model = module.train(odd, labels, label)
        middle = sorted(r.score for r in module.score(odd, model).select("score").collect())[6]
        want = module.score(odd, model).where(f"score {side} {middle!r}D").count()
        got = keep(odd, model, middle)
        assert got.count() == want and got.schema == odd.schema and keep(odd.limit(0), model, middle).count() == 0


def test_trees_fit_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    node_walk = []
    for row in x[:20]:  # one row at a time, as a plain walk
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            n = 0
            for _ in range(forest.depth):
                n = 2 * n + 1 + int(row[f[n]] > t[n])
            total += v[n]
        node_walk.append(1 / (1 + np.exp(-total)))
    assert np.allclose(node_walk, forest.score(x[:20]))
    assert quality.fit(np.zeros((0, 4)), np.zeros(0)).score(x).shape == (600,)


def test_statistics_do_not_depend_on_the_batch(corpus):
    texts = [r["text"] for r in corpus[:40]] + ["", "A", "AB", " ", "", "x"]
    whole = statistics.features(pa.array(texts))
    assert (np.concatenate([statistics.features(pa.array([t])) for t in texts]) == whole).all()
    assert statistics.features(pa.array([], pa.string())).shape == (0, len(statistics.NAMES))


def test_statistics_of_simple_texts():
    got = statistics.features(pa.array(["", "a a b", "AB!! CD!!\nAB!! CD!!"]))
    at = {n: k for k, n in enumerate(statistics.NAMES)}
    assert not got[0].any()
    assert got[1, at["distinct_words"]] == 2 / 3 and got[1, at["repeated_neighbour"]] == 1 / 3
    assert got[2, at["upper_words"]] == 1 and got[2, at["distinct_lines"]] == 0.5


def plain_statistics(text):
    """The statistics of one text, a character and a word at a time."""
    import math

    raw = text.encode()
    n = max(len(raw), 1)
    kind = {}
    for c in range(256):
        kind[c] = (
            "newline" if c == 10 else "space" if c in b" \t\x0b\x0c\r" else "beyond_ascii" if c >= 128 else "lower" if 97 <= c <= 122 else "upper" if 65 <= c <= 90 else "digit" if 48 <= c <= 57
            else "punctuation" if c in b".,;:!?'\"()-" else "symbol" if 33 <= c <= 126 else "control"
        )
    count = {}
    for c in raw:
        count[kind[c]] = count.get(kind[c], 0) + 1
    words = [w for w in "".join(chr(c) if c not in b" \t\n\x0b\x0c\r" else " " for c in raw).split(" ") if w]
    lines = [x for x in raw.split(b"\n") if x]
    m = max(len(words), 1)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / m
    upper = sum(any("A" <= c <= "Z" for c in w) and not any("a" <= c <= "z" for c in w) for w in words)
    ends = [w[-1] for w in words]
    return {
        "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "log_lines": math.log1p(len(lines)),
        **{k: count.get(k, 0) / n for k in ("beyond_ascii", "lower", "upper", "digit", "newline", "punctuation", "symbol", "control")},
        "exclamation": raw.count(b"!") / n, "word_length": mean, "word_length_spread": math.sqrt(max(sum(s * s for s in sizes) / m - mean**2, 0)),
        "distinct_words": len(set(words)) / m, "top_word": max((words.count(w) for w in set(words)), default=0) / m,
        "repeated_neighbour": sum(a == b for a, b in zip(words, words[1:])) / m, "upper_words": upper / m,
        "marked_words": sum(e in "!&%$#*|" or kind[ord(e)] == "symbol" for e in ends) / m, "long_words": sum(s > 20 for s in sizes) / m,
        "stops_per_word": sum(e in ".?" for e in ends) / m, "distinct_lines": len(set(lines)) / len(lines) if lines else 0,
    }


def test_op5_scores_by_plain_walks(spark, small, corpus):
    """Every statistic and every tree of the query's own model, one document at a time."""
    import math

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in queries.op5_quality_classifier(spark, small).collect()}
    for row in [r for r in corpus if len(r["text"] or "") < 4000][:80]:
        facts = plain_statistics(row["text"] or "")
        x = [facts[n] for n in statistics.NAMES]
        assert np.allclose(x, statistics.features(pa.array([row["text"] or ""]))[0], rtol=1e-12, atol=1e-12)
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            n = 0
            for _ in range(forest.depth):
                n = 2 * n + 1 + int(x[f[n]] > t[n])
            total += v[n]
        assert got[row["doc_id"]] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def plain_toxicity(text, model):
    """(score, significant passages) of one text by loops over its words."""
    import math

    words = [w for w in text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    scores = []
    for k, w in enumerate(words):
        bare = w.strip(toxicity.MARKS).lower()
        if k and words[k - 1] == w:
            gain = 0.0
        elif bare in model.word:
            gain = model.word[bare]
        else:
            gain = model.stem.get(bare[: toxicity.STEM], 0.0) if len(bare) > toxicity.STEM else 0.0
        scores.append(gain - toxicity.DRIFT)
    found = maximal_segments(scores)
    x = sorted((model.lam * s - math.log(model.k * max(len(words), 1)) for _, _, s in found), reverse=True)
    alone, together = 0.0, 0.0
    if x:
        nats = []
        for r, v in enumerate(x, 1):
            m = math.exp(-min(max(v, -50), 50))
            nats.append((r * (math.log(r) + v) - r + m if m < r else 0.0) - math.log(r))
        alone, together = min(max(x[0], 0), 40), math.log1p(min(max(max(nats), 0), 400))
    a, b, c = model.curve
    strong = [(i, j) for i, j, s in found if model.lam * s - math.log(model.k * max(len(words), 1)) > 3.0]
    return 1 / (1 + math.exp(-min(max(a + b * alone + c * together, -30), 30))), strong


def test_op2_scores_by_plain_loops(spark, medium):
    """The query's own model over short documents, many of them toxic."""
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    short = docs.where("length(text) < 900").join(labels.select("doc_id", "toxic"), "doc_id", "left").orderBy(F.desc_nulls_last("toxic"), "doc_id").limit(60).collect()
    scored = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    asked = {r.doc_id: r.score for r in queries.op2_toxic_passages(spark, medium).collect()}
    passages = 0
    for row in short:
        score, strong = plain_toxicity(row.text, model)
        assert scored[row.doc_id].score == pytest.approx(score, abs=1e-9) and asked[row.doc_id] == scored[row.doc_id].score
        assert [(p["first"], p["last"]) for p in scored[row.doc_id].passages] == strong
        passages += len(strong)
    assert passages > 10
