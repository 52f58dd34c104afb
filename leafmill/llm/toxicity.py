"""Toxic passages as maximum-scoring segments.

Each word scores its log-odds between toxic and clean labelled documents,
estimated from document counts with informative Dirichlet priors: a word's
prior follows its stem (leading characters), and a stem's prior the corpus, so
an unseen form of a known stem scores by the stem and an unknown word nothing.
A constant drift per word makes clean text score downwards, and words that
clean documents favour more so. A linear scan finds every maximal segment of a
document; their scores are calibrated as extreme values (expected number of
chance segments K n exp(-lambda S), fitted on clean documents), and the evidence
of a document's best segments is mapped to a probability by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, units

#: The word model and its calibration see at most this many labelled documents.
SAMPLE_ROWS = 12_000
STEM = 4
DRIFT = 0.5
MARKS = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "«»“”‘’…–—¡¿"


def normal(word: str) -> str:
    """Lower case without marks at the ends."""
    return word.strip(MARKS).lower()


@dataclass
class Model:
    """Significant log-odds of words and stems, drift and calibration."""

    word: dict[str, float]
    stem: dict[str, float]
    lam: float = 1.0
    k: float = 0.1
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.0)
    empty: bool = False

    def weight(self, raw: str) -> float:
        w = normal(raw)
        if w in self.word:
            return self.word[w] - DRIFT
        return self.stem.get(w[:STEM], 0.0) - DRIFT if len(w) > STEM else -DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of one document's word scores, in linear
    time. Segments are (first, last, score) and never overlap; each is the best
    extension of its parts in both directions (Ruzzo and Tompa's definition).
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    where = np.flatnonzero(scores > 0)
    for p, left, total in zip(where.tolist(), sums[where].tolist(), sums[where + 1].tolist(), strict=True):
        first, before = p, left
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= before:
                k -= 1
            if k < 0 or stack[k][3] >= total:
                break
            first, before = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, p, before, total))
    return [(a, b, after - before) for a, b, before, after in stack]


def scan(texts: pa.Array, model: Model, cache: dict[str, float]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(words, maximal segments) of every text.

    A word right after the same word scores as an unknown one: repetition is
    no evidence either way.
    """
    flat, rows = units.words(texts, lower=False)
    codes, distinct = units.coded(flat)
    if len(cache) > 400_000:
        cache.clear()
    for w in distinct:
        if w not in cache:
            cache[w] = model.weight(w)
    weights = np.fromiter((cache[w] for w in distinct), dtype=np.float64, count=len(distinct))
    per_word = weights[codes] if len(codes) else np.zeros(0)
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = codes[1:] == codes[:-1]
    again[rows[:-1][rows[:-1] < len(codes)]] = False
    per_word[again] = -DRIFT
    some = np.add.reduceat(np.append(per_word > 0, False), rows[:-1]) if len(texts) else rows
    for i in range(len(texts)):
        a, b = int(rows[i]), int(rows[i + 1])
        yield b - a, segments(per_word[a:b]) if a < b and some[i] else []


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> tuple[float, float]:
    """-log p of the best segment alone, and of the best r segments together.

    Normalised scores x = lambda S - log(K n) of chance segments follow an
    extreme-value law: those of x or more number a Poisson variable of mean
    exp(-x). That r of them reach the r-th largest has at most the probability
    exp(r - m) (m / r)^r, m = exp(-x_r) < r; the r that says most is taken, at
    the price of r looks.
    """
    x = np.sort([model.lam * s - np.log(model.k * max(n, 1)) for _, _, s in found])[::-1]
    if not len(x):
        return 0.0, 0.0
    r, m = np.arange(1, len(x) + 1), np.exp(-np.clip(x, -50, 50))
    nats = np.where(m < r, r * (np.log(r) + x) - r + m, 0.0) - np.log(r)
    return float(np.clip(x[0], 0, 40)), float(np.log1p(np.clip(nats.max(), 0, 400)))


def _probability(facts: np.ndarray, model: Model) -> np.ndarray:
    a, b, c = model.curve
    return 1 / (1 + np.exp(-np.clip(a + facts @ np.array([b, c]), -30, 30)))


def scores(texts: pa.Array, model: Model, cache: dict[str, float]) -> np.ndarray:
    out = []
    for _, part in units.slices(texts):
        out += [evidence(n, found, model) for n, found in scan(part, model, cache)]
    return _probability(np.array(out).reshape(-1, 2), model)


def _term_counts(sample: DataFrame) -> DataFrame:
    """(kind, term, y, n): labelled documents that hold each word or stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[int, str, int], int] = {}
            labels = batch.column(0).to_pylist()
            for at, texts in units.slices(batch.column(1)):
                flat, rows = units.words(texts, lower=False)
                codes, distinct = units.coded(flat)
                names = [normal(w) for w in distinct]
                for i in range(len(texts)):
                    y = labels[at + i]
                    here = {names[c] for c in np.unique(codes[rows[i] : rows[i + 1]])} - {""}
                    for w in here:
                        counts[0, w, y] = counts.get((0, w, y), 0) + 1
                    for w in {w[:STEM] for w in here if len(w) > STEM}:
                        counts[1, w, y] = counts.get((1, w, y), 0) + 1
            if counts:
                keys = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keys], pa.int32()),
                        pa.array([k[1] for k in keys], pa.string()),
                        pa.array([k[2] for k in keys], pa.int32()),
                        pa.array([counts[k] for k in keys], pa.int64()),
                    ],
                    names=["kind", "term", "y", "n"],
                )

    return sample.select("y", "text").mapInArrow(run, "kind int, term string, y int, n long")


def log_odds(
    rows: list, n1: int, n0: int, least_z: float = 4.0, prior: float = 100.0, least: float = 1.5
) -> Model:
    """Word and stem log-odds with Dirichlet priors; insignificant ones drop.

    ``rows``: (kind, term, toxic documents, clean documents). The variance of
    a log-odds is the sum of reciprocal smoothed counts. Words are told from
    their corpus share and their stem; a stem speaks for unseen words only if
    the lower end of its interval is above ``least``, and words of less than
    ``least`` score nothing.
    """

    def odds(a: float, b: float, pa_: float, pb: float) -> tuple[float, float]:
        up, down = a + prior * pa_, b + prior * pb
        value = np.log(up / (n1 + prior)) - np.log(down / (n0 + prior))
        return float(value), float(value / np.sqrt(1 / up + 1 / down))

    stems: dict[str, tuple[float, float]] = {}
    for kind, term, a, b in rows:
        if kind == 1:
            share = (a + b) / (n1 + n0)
            stems[term] = odds(a, b, share, share)
    # v / z is the standard error: v - 1.64 v / z is the lower end.
    lows = {t: v - 1.64 * v / z for t, (v, z) in stems.items() if v > 0 and z >= least_z}
    model = Model({}, {t: low for t, low in lows.items() if low >= least})
    for kind, term, a, b in rows:
        if kind == 0:
            stem = model.stem.get(term[:STEM], 0.0) if len(term) > STEM else 0.0
            share = (a + b + 0.5) / (n1 + n0)
            lean = 1 / (1 + np.exp(-stem))
            v, z = odds(a, b, 2 * share * lean, 2 * share * (1 - lean))
            if abs(z) >= least_z and abs(v) >= least:
                model.word[term] = v
            elif stem:
                model.word[term] = min(v, stem) if v > 0 else 0.0
    return model


def calibrate(model: Model, facts: list[tuple[int, float, list, int]]) -> Model:
    """Fit lambda and K on clean documents, then the logistic curve.

    ``facts``: (words, best segment, segments, label). With excess e = S - u
    beyond a threshold u, lambda is 1 / mean(e) and K follows from the rate of
    exceedances per word; both take one pseudo-observation, so that a model
    without clean segments stays proper.
    """
    clean = [(n, [s for _, _, s in found]) for n, _, found, y in facts if y == 0]
    length = sum(n for n, _ in clean) + 1
    every = [s for _, x in clean for s in x]
    u = 0.5
    over = [s - u for s in every if s > u]
    model.lam = float(np.clip((len(over) + 1) / (sum(over) + 1.0), 0.3, 3.0))
    model.k = float((len(over) + 1) / length * np.exp(model.lam * u))
    x = np.array([[1.0, *evidence(n, found, model)] for n, _, found, _ in facts]).reshape(-1, 3)
    y = np.array([f[3] for f in facts], dtype=np.float64)
    if len(np.unique(y)) < 2:
        model.empty = True
        model.curve = (-3.0, 0.0, 0.0)
        return model
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        prob = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - prob) - ridge @ w * len(y) / 100
        hess = (x * (prob * (1 - prob) + 1e-9)[:, None]).T @ x + ridge * len(y) / 100
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.curve = (float(w[0]), float(w[1]), float(w[2]))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS, least_z: float = 4.0, prior: float = 100.0, least: float = 1.5) -> Model:
    """Learn from at most ``rows`` labelled documents outside the held-out fold.

    ``least_z``, ``prior`` and ``least`` as in ``log_odds``: words whose log-odds
    are less sure or smaller score nothing.
    Of several rows of one id the one of smallest text hash counts. Terms of
    three documents or more come to the driver; their number is bounded by the
    sample. Without labels of both kinds every score is the same.
    """
    chosen = common.labelled_sample(labels, label, modulus, held_out, rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = common.materialize(
        common.one_text_each(text.join(F.broadcast(chosen), "doc_id")).select("y", "text"),
        "labelled",
    )
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return calibrate(Model({}, {}), [(1, 0.0, [], y) for y in sizes])
    terms = (
        _term_counts(sample)
        .groupBy("kind", "term")
        .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
        .where("a + b >= 3")
        .orderBy("kind", "term")
    )
    model = log_odds([(r["kind"], r["term"], r["a"], r["b"]) for r in terms.collect()], n1, n0, least_z, prior, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            labels_ = batch.column(0).to_pylist()
            for at, texts in units.slices(batch.column(1)):
                found = list(scan(texts, model, cache))
                yield pa.RecordBatch.from_pylist(
                    [{"y": labels_[at + i], "n": n, "s": sorted((s for _, _, s in segs), reverse=True)} for i, (n, segs) in enumerate(found)],
                    schema=pa.schema([("y", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]),
                )

    facts = [
        (r["n"], max(r["s"], default=0.0), [(0, 0, s) for s in r["s"]], r["y"])
        for r in sample.mapInArrow(run, "y int, n long, s array<double>").collect()  # at most ``rows``
    ]
    common.discard(sample)
    return calibrate(model, facts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages, passages) of every row.

    ``passages`` are the significant segments as (first word, last word,
    score). A null or empty text scores like a text without any segment; equal
    texts score alike; repeated rows and null ids stay; an empty table gives no
    rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for at, texts in units.slices(batch.column(1)):
                found = list(scan(texts, model, cache))
                facts = np.array([evidence(n, segs, model) for n, segs in found]).reshape(-1, 2)
                strong = [
                    [{"first": a, "last": b, "score": s} for a, b, s in segs if model.lam * s - np.log(model.k * max(n, 1)) > 3.0]
                    for n, segs in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(_probability(facts, model)),
                        pa.array(list(map(len, strong)), pa.int32()),
                        pa.array(strong, kind),
                    ],
                    names=["doc_id", "score", "n_passages", "passages"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, n_passages int, passages array<struct<first: long, last: long, score: double>>"
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows below ``threshold``, with all their columns as they were, whatever
    their names; null texts count as empty ones, repeated rows stay."""
    cache: dict[str, float] = {}
    return units.filter_rows(docs, lambda texts: scores(texts, model, cache) < threshold)
