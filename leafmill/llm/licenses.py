"""License scans: set-similarity containment join of text blocks and templates.

The blocks of a template are all runs of consecutive words of a document that
are at most ``stretch`` times as long as the template, wherever lines break. A
template matches a block that holds at least a share theta of the template's
distinct words. The join is exact: template words are put in one global order,
rarest in the corpus first; a block that contains enough of a template must
share a word with the template's prefix (its first |T| - ceil(theta |T|) + 1
words), must have at least ceil(theta |T|) known words, and, given which prefix
word is the first shared, must still be able to collect the rest (positional
filter). The filters are applied to stretches around prefix words, as far as a
block can reach from one; what survives is verified on the full sets. Every
block contains a shortest one, so the shortest that don't overlap, leftmost
first, are reported, as the places of a phrase would be.

Phrases whose words must stand consecutively (the base labels) are found on
the word sequence itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import units

# Phrases of the contract and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices that licenses ask to be put into files, by label.
TEMPLATES = {
    "gpl": "this work is licensed under the gnu general public license version",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-notice": "licensed under the apache license version you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution international license",
    "all-rights": "all rights reserved",
}

THETA, STRETCH = 0.9, 2

WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def license_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(codes, distinct words, first word of each row)."""
    offsets, data = units.buffers(texts)
    low = units.ASCII_LOWER[data]
    solid = WORD[low]
    starts, ends, rows = units.runs(solid, offsets)
    codes, distinct = units.coded(units.strings(low[solid], ends - starts)) if len(starts) else (np.zeros(0, np.int64), [])
    return codes, distinct, rows


def phrase_hits(codes: np.ndarray, distinct: list[str], rows: np.ndarray, phrases: list[list[str]]) -> list[np.ndarray]:
    """Start positions of every phrase; none crosses a row's edge."""
    index = {w: k for k, w in enumerate(distinct)}
    out = []
    for phrase in phrases:
        if any(w not in index for w in phrase) or len(codes) < len(phrase):
            out.append(np.zeros(0, dtype=np.int64))
            continue
        at = np.flatnonzero(codes[: len(codes) - len(phrase) + 1] == index[phrase[0]])
        for k, w in enumerate(phrase[1:], 1):
            at = at[codes[at + k] == index[w]]
        owner = np.searchsorted(rows, at, side="right")
        out.append(at[at + len(phrase) <= rows[np.minimum(owner, len(rows) - 1)]])
    return out


def template_frequencies(docs: DataFrame, templates: dict[str, str], text_col: str = "text") -> dict[str, int]:
    """Corpus frequency of every template word, over all documents.

    Only words of templates are counted, so what comes to the driver is
    bounded by the templates.
    """
    wanted = {w for t in templates.values() for w in t.split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for _, texts in units.slices(batch.column(0)):
                codes, distinct, _ = license_words(texts)
                n = np.bincount(codes, minlength=len(distinct)) if len(codes) else []
                for w, c in zip(distinct, n, strict=True):
                    if w in wanted:
                        total[w] = total.get(w, 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    found = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in wanted}


class Templates:
    """Templates under one global word order, with prefixes and bounds."""

    def __init__(self, templates: dict[str, str], frequency: dict[str, int], theta: float, stretch: float):
        order = sorted(frequency, key=lambda w: (frequency[w], w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.names = sorted(templates)
        self.sets, self.need, self.reach = {}, {}, {}
        for name in self.names:
            words = templates[name].split()
            ranks = np.array(sorted({self.rank[w] for w in words}), dtype=np.int64)
            self.sets[name], self.need[name], self.reach[name] = ranks, ceil(theta * len(ranks) - 1e-9), int(stretch * len(words))
        self.rarest = np.unique(np.concatenate([self.prefix(t) for t in self.names])) if self.names else np.zeros(0, np.int64)

    def prefix(self, name: str) -> np.ndarray:
        return self.sets[name][: len(self.sets[name]) - self.need[name] + 1]

    def may_hold(self, name: str, known: np.ndarray) -> bool:
        """Whether a block of these distinct ranks may hold enough of a template."""
        mine = self.sets[name]
        shared = np.flatnonzero(np.isin(self.prefix(name), known))
        # Words before the first shared one are missing; the rest must do.
        return bool(len(shared)) and min(len(mine) - int(shared[0]), len(known)) >= self.need[name]

    def stretches(self, name: str, at: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of a text in which blocks of a template may lie: places and
        ranks of its words within reach of its prefix's. ``at``: places of known
        words, ascending."""
        mine = np.isin(ranks, self.sets[name])
        at, ranks = at[mine], ranks[mine]
        seeds = at[np.isin(ranks, self.prefix(name))]
        if not len(seeds):
            return
        gaps = np.flatnonzero(np.diff(seeds) > 2 * self.reach[name])
        for low, high in zip(seeds[np.append(0, gaps + 1)] - self.reach[name], seeds[np.append(gaps, len(seeds) - 1)] + self.reach[name], strict=True):
            a, b = np.searchsorted(at, [low, high + 1])
            if self.may_hold(name, np.unique(ranks[a:b])):
                yield at[a:b], ranks[a:b]

    def blocks(self, name: str, at: np.ndarray, ranks: np.ndarray) -> list[tuple[int, int]]:
        """(first word, last word) of the shortest blocks of a stretch that don't
        overlap, by their ends; of equal ends the later start."""
        places, codes = at.tolist(), ranks.tolist()
        held: dict[int, int] = {}
        out: list[tuple[int, int]] = []
        low = 0
        for high, code in enumerate(codes):
            held[code] = held.get(code, 0) + 1
            # Drop what is too far off, then what the block can do without.
            while places[high] - places[low] >= self.reach[name] or (len(held) >= self.need[name] and held[codes[low]] > 1) or len(held) > self.need[name]:
                held[codes[low]] -= 1
                if not held[codes[low]]:
                    del held[codes[low]]
                low += 1
            if len(held) >= self.need[name]:
                out.append((places[low], places[high]))
                held, low = {}, high + 1
        return out

    def best_block(self, name: str, at: np.ndarray, ranks: np.ndarray) -> tuple[float, int, int] | None:
        """(containment, first word, last word) of the best block: most of the
        template's words, then the earliest. ``at``: places of known words."""
        mine = np.isin(ranks, self.sets[name])
        at, ranks = at[mine].tolist(), ranks[mine].tolist()
        held: dict[int, int] = {}
        best, span, low = 0, (0, 0), 0
        for high, rank in enumerate(ranks):
            held[rank] = held.get(rank, 0) + 1
            while at[high] - at[low] >= self.reach[name]:
                held[ranks[low]] -= 1
                if not held[ranks[low]]:
                    del held[ranks[low]]
                low += 1
            if len(held) > best:
                best, span = len(held), (at[low], at[high])
        return (best / len(self.sets[name]), *span) if best >= self.need[name] else None


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, theta: float = THETA, stretch: float = STRETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base places, base labels, all labels, score.

    Labels of templates join the base labels. ``score`` is the best
    containment, 1 if a base phrase stands in the text, else 0 without match.
    ``blocks`` lists (label, first word, last word, containment) of every block,
    shortest and disjoint within a template, by first word, last word and label;
    containment is that of the best block around. Null or empty text: no
    words, nulls, empty labels. Repeated rows stay repeated, null ids stay, an
    empty table gives no rows, other columns are ignored. The time for a text
    is linear in its words.
    """
    model = Templates(templates, template_frequencies(docs, templates, text_col), theta, stretch)
    phrases = [p.split() for p in PHRASES]
    names = list(PHRASES.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            for at, texts in units.slices(batch.column(1)):
                codes, distinct, rows = license_words(texts)
                n = len(texts)
                rank = np.array([model.rank.get(w, -1) for w in distinct] or [-1], dtype=np.int64)
                hits = phrase_hits(codes, distinct, rows, phrases)
                base: list[set[str]] = [set() for _ in range(n)]
                count, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                for name, places in zip(names, hits, strict=True):
                    owner = np.searchsorted(rows, places, side="right") - 1
                    for o, p in zip(owner.tolist(), (places - rows[owner]).tolist(), strict=True):
                        base[o].add(name)
                        count[o] += 1
                        first[o] = p if first[o] < 0 else min(first[o], p)
                        last[o] = max(last[o], p)
                best: list[dict[str, float]] = [{} for _ in range(n)]
                blocks: list[list[dict]] = [[] for _ in range(n)]
                ranks = rank[codes] if len(codes) else np.zeros(0, np.int64)
                known = np.flatnonzero(ranks >= 0)
                seeds = known[np.isin(ranks[known], model.rarest)]
                for o in np.unique(np.searchsorted(rows, seeds, side="right") - 1).tolist():
                    mine = known[np.searchsorted(known, rows[o]) : np.searchsorted(known, rows[o + 1])]
                    for name in model.names:
                        for where, what in model.stretches(name, mine - rows[o], ranks[mine]):
                            found = model.best_block(name, where, what)
                            if found:
                                best[o][name] = max(best[o].get(name, 0.0), found[0])
                                blocks[o] += [{"label": name, "first": f, "last": g, "containment": found[0]} for f, g in model.blocks(name, where, what)]
                    blocks[o].sort(key=lambda x: (x["first"], x["last"], x["label"]))
                none = first < 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n).cast(pa.int64()),
                        pa.array(np.diff(rows)),
                        pa.array(count),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([",".join(sorted(s)) for s in base]),
                        pa.array([",".join(sorted(s | set(m))) for s, m in zip(base, best, strict=True)]),
                        pa.array([max([float(bool(s)), *m.values()]) for s, m in zip(base, best, strict=True)], pa.float64()),
                        pa.array(blocks, block_kind),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, blocks array<struct<label: string, first: long, last: long, containment: double>>",
    )
