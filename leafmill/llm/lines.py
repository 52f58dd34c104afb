"""Line dedup by content-defined chunks of lines.

A document's lines are hashed; a rolling hash over the last lines' hashes puts
a chunk boundary wherever it hits a pattern, so boundaries follow content and
inserted lines shift nothing else. Boundaries also stand where the number of
places that hold two adjacent lines falls, which parts a shared passage from
its surroundings, and around long lines (wrapped passages by themselves). Chunks
of a passage of several lines that all occur elsewhere, in other documents or
the same, and such long lines, are compared byte by byte with the other chunks
of their hash; the first place in the corpus stays, every other is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as digest

from leafmill.llm import common, units

#: A line of so many words is a passage of its own.
LONG_WORDS = 50
#: A line of so many words that other holders cut off a passage goes with it.
PART_WORDS = 20
#: Lines in the rolling window, and the mean number of lines between cuts.
WINDOW, MEAN = 2, 4
MAX_LINES = 32


def line_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and words of the lines of all rows, and each row's
    first line (n + 1). Lines are split at newlines only; every row has one."""
    offsets, data = units.buffers(texts)
    n = len(texts)
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
    by = np.lexsort((starts, owner))
    starts, owner = starts[by], owner[by]
    ends = np.sort(ends) if n else ends
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    heads = np.concatenate([[0], np.cumsum(_heads(data, offsets))])
    return starts, ends, hashes, heads[ends] - heads[starts], np.searchsorted(owner, np.arange(n + 1))


def _heads(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One at each byte that begins a word."""
    solid = ~units.SPACES[data]
    out = solid.copy()
    out[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    out[edges] = solid[edges]
    return out.astype(np.int64)


def line_pairs(hashes: np.ndarray) -> np.ndarray:
    """One hash for each line and its next."""
    return hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + (hashes[1:] ^ (hashes[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def chunk(hashes: np.ndarray, words: np.ndarray, shared: dict[int, int], least_words: int = 0, long_words: int = LONG_WORDS) -> list[tuple[int, int, int]]:
    """(first line, end line, hash) of the chunks that go if they repeat: those
    of passages of several lines, and shared long lines.

    ``shared`` has the counts over 1 of pairs of adjacent lines (see
    ``line_pairs``) and of long lines. A passage is a longest run of lines
    whose pairs are all shared, of two lines with words and ``least_words``
    words at least, however it is cut. Blank lines are no lines of their own.
    """
    n = len(hashes)
    pairs = [shared.get(h, 0) for h in line_pairs(hashes).tolist()] if n else []
    around = [0, *pairs, 0]
    level = [max(around[i], around[i + 1]) for i in range(n)]
    out, first, rolling = [], 0, 0
    mask = (1 << 64) - 1
    weight = pow(0x9E3779B97F4A7C15, WINDOW, 1 << 64)
    values = hashes.tolist()
    for i in range(n):
        alone = words[i] >= long_words
        fresh = i == first
        # A pair in fewer documents than a pair beside it: other holders.
        if not fresh and (alone or not pairs[i - 1] or pairs[i - 1] < max(level[i - 1], level[i]) or words[i - 1] >= long_words or i - first >= MAX_LINES):
            out.append((first, i))
            first, fresh = i, True
        if fresh:
            rolling = 0
        rolling = (rolling * 0x9E3779B97F4A7C15 + values[i]) & mask
        if i - first >= WINDOW:
            rolling = (rolling - values[i - WINDOW] * weight) & mask
        # Chunks of several lines: not after a chunk's first line, nor before a passage's last.
        if i > first and (rolling >> 40) % MEAN == 0 and i + 2 < n and pairs[i + 1] == pairs[i]:
            out.append((first, i + 1))
            first = i + 1
    if first < n:
        out.append((first, n))
    edges = [0, *(i for i in range(1, n) if not pairs[i - 1]), n]
    run_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges)) if n else np.zeros(0, np.int64)
    run_words, run_lines = (np.add.reduceat(x, edges[:-1]) if n else words for x in (words, (words > 0).astype(np.int64)))
    kept = []
    for a, b in out:
        run = run_of[a]
        passage = run_lines[run] > 1 and run_words[run] >= least_words
        # One short line between other holders may stand anywhere: it stays.
        whole = np.count_nonzero(words[a:b]) > 1 or words[a:b].sum() >= PART_WORDS
        if (passage and whole) or (words[a] >= long_words and shared.get(values[a], 0)):
            kept.append((a, b, digest(hashes[a:b].tobytes()) >> 1))
    return kept


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key of id and text; identical rows are one document."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))).alias("k1"),
        F.xxhash64(F.col(id_col).isNull(), F.coalesce(text_col, F.lit(""))).alias("k2"),
        F.col(text_col).alias("text"),
    )


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 0, long_words: int = LONG_WORDS) -> DataFrame:
    """(k1, k2, cuts): lines to remove from each document, as flat pairs of
    first and end line. Documents that lose nothing have no row."""
    keyed = _keyed(docs, id_col, text_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in units.slices(batch.column(2)):
                _, _, hashes, words, rows = line_table(texts)
                size = pa.array(rows.astype(np.int32))
                seen = [
                    np.unique(np.append(line_pairs(hashes[a:b]), hashes[a:b][words[a:b] >= long_words]), return_counts=True)
                    for a, b in zip(rows[:-1], rows[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        batch.column(1).slice(at, len(texts)),
                        pa.ListArray.from_arrays(size, pa.array(hashes.view(np.int64))),
                        pa.ListArray.from_arrays(size, pa.array(words.astype(np.int32))),
                        pa.array([x.view(np.int64) for x, _ in seen], pa.list_(pa.int64())),
                        pa.array([x for _, x in seen], pa.list_(pa.int64())),
                    ],
                    names=["k1", "k2", "hashes", "words", "seen", "times"],
                )

    lined = common.materialize(
        keyed.mapInArrow(hashed, "k1 long, k2 long, hashes array<long>, words array<int>, seen array<long>, times array<long>"), "lines"
    )
    # Places that hold each pair of lines or long line.
    each = lined.select("k1", "k2", F.explode(F.arrays_zip("seen", "times")).alias("s")).select("k1", "k2", F.col("s.seen").alias("h"), F.col("s.times").alias("t"))
    # Written, so that both sides of the join are plain exchanges and a line
    # that a third of all documents hold can be split over tasks.
    shared = common.materialize(each.groupBy("h").agg(F.sum("t").alias("n")).where("n > 1"), "shared")
    of_doc = (
        each.join(shared, "h")
        .groupBy("k1", "k2")
        .agg(F.collect_list("h").alias("hs"), F.collect_list("n").alias("ns"))  # at most a document's lines
    )
    lines = common.reread(lined).dropDuplicates(["k1", "k2"]).join(of_doc, ["k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for k1, k2, hashes, words, hs, ns in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                h = np.array(hashes, dtype=np.int64).view(np.uint64)
                known = dict(zip(np.array(hs, dtype=np.int64).view(np.uint64).tolist(), ns, strict=True))
                out += [(k1, k2, a, b, g) for a, b, g in chunk(h, np.array(words, dtype=np.int64), known, least_words, long_words)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "a", "b", "g"])

    places = common.materialize(
        lines.select("k1", "k2", "hashes", "words", "hs", "ns").mapInArrow(cut, "k1 long, k2 long, a long, b long, g long"), "places"
    )
    often = places.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    wanted = (
        common.reread(places).join(often, "g")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("a", "b", "g")).alias("at"))
    )
    # The bytes of every chunk whose hash repeats, for the comparison.
    texts = keyed.join(wanted.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "text", "at")

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                part = batch.slice(at, 512)
                for k1, k2, text, spots in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    split = (text or "").split("\n")
                    out += [(k1, k2, s["a"], s["b"], s["g"], "\n".join(split[s["a"] : s["b"]])) for s in spots]
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string())], names=["k1", "k2", "a", "b", "g", "chunk"]
                )

    found = common.materialize(texts.mapInArrow(bytes_of, "k1 long, k2 long, a long, b long, g long, chunk string"), "chunks")
    # Grouping by the text itself compares bytes; the hash only deals it out.
    first = common.materialize(
        found.groupBy("g", "chunk").agg(F.min(F.struct("k1", "k2", "a")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first"
    )
    again = common.reread(found)
    drop = (
        again.join(first, ["g", "chunk"])
        .where(F.struct("k1", "k2", "a") != F.col("keep"))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.sort_array(F.collect_list(F.array("a", "b")))).alias("cuts"))
    )
    return common.materialize(drop, "cuts")


def remove_lines(text: str | None, cuts: list[int] | None) -> str | None:
    if not cuts or text is None:
        return text
    lines = text.split("\n")
    for a, b in sorted(zip(cuts[0::2], cuts[1::2], strict=True), reverse=True):
        del lines[a:b]
    return "\n".join(lines)


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", least_words: int = 0, long_words: int = LONG_WORDS
) -> DataFrame:
    """All rows and columns, with repeated chunks of lines removed from texts.

    Passages of fewer than ``least_words`` words stay; a line of ``long_words``
    words is a passage by itself.

    The copy of the smallest (id, hash of the text, line) stays. A document may
    end up empty; null text stays null; identical rows lose the same lines; a
    null id orders first. ``length_col``, if there, is set to the new length of
    changed texts. Other columns stay as they are, whatever their names; an
    empty table gives no rows.
    """
    cuts = repeated_chunks(docs, id_col, text_col, least_words, long_words).select("k1", "k2", "cuts")
    plain, name = common.plain_names(docs)
    id_, text = F.col(name[id_col]), F.col(name[text_col])
    keys = {"k1": F.coalesce(id_.cast("long"), F.lit(-(1 << 62))), "k2": F.xxhash64(id_.isNull(), F.coalesce(text, F.lit("")))}
    columns = docs.columns
    joined = plain.withColumns(keys).join(cuts.hint("merge"), ["k1", "k2"], "left").select(*name.values(), "cuts")
    at, last = columns.index(text_col), len(columns)
    size = columns.index(length_col) if length_col in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns[:last])
            spots = batch.column(last)
            changed = np.flatnonzero(~np.array(spots.is_null()))
            if len(changed):
                texts = cols[at].take(pa.array(changed)).to_pylist()
                new = [remove_lines(t, c) for t, c in zip(texts, spots.take(pa.array(changed)).to_pylist(), strict=True)]
                mask = ~np.array(spots.is_null())
                cols[at] = pa.compute.replace_with_mask(cols[at], pa.array(mask), pa.array(new, cols[at].type))
                if size is not None:
                    lengths = pa.array([None if t is None else len(t) for t in new], cols[size].type)
                    cols[size] = pa.compute.replace_with_mask(cols[size], pa.array(mask), lengths)
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return joined.mapInArrow(run, docs.schema)
