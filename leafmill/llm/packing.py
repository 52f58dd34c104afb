"""Best-fit sequence packing by bin completion.

Pieces of documents are packed into sequences of a fixed size. Pieces of one
length are interchangeable, so the search runs over the histogram of lengths
(at most ``size`` numbers, whatever the corpus): around the largest length
that is left it enumerates undominated fillings, applies the chosen one to as
many sequences as the counts allow, and goes on; branches are pruned by the
waste that the incumbent still allows, best-fit solutions being incumbents.
Fractional fillings tell how few sequences there can be, and leave bin
completion only the remainder of a large corpus to search. The plan is a list
of patterns, a few for each length at most. Documents then find their places by
rank within their length.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import common, units


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences that hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    count: int


def _fits_inside(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether first-fit packs the items of ``small`` into those of ``large``
    as bins; then ``large`` dominates ``small``."""
    room = sorted(large)
    for item in small:
        for k, r in enumerate(room):
            if r >= item:
                room[k] = r - item
                break
        else:
            return False
    return True


def fillings(counts: np.ndarray, room: int, width: int | None = None, effort: int | None = None) -> list[tuple[int, ...]]:
    """Undominated sets of lengths of sum at most ``room``, least waste first.

    Sets to which one more piece could be added are dominated by those with
    it and left out. At each step the length that closes the gap is tried
    first, then all others from the largest down. ``width`` bounds how many
    sets are returned and ``effort`` the nodes visited; None of both gives all.
    """
    lengths = [int(v) for v in np.flatnonzero(counts[: room + 1])[::-1] if v]
    if not lengths:
        return [()]
    place = {v: k for k, v in enumerate(lengths)}
    found: list[tuple[int, tuple[int, ...]]] = []
    visited = exact = 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and (effort is None or visited < effort):
        k, left, chosen = stack.pop()
        visited += 1
        used = {v: chosen.count(v) for v in set(chosen)}
        first = bisect_left(lengths, -left, key=lambda v: -v)  # the largest that fits

        def free(j: int) -> bool:
            return used.get(lengths[j], 0) < counts[lengths[j]]

        budget = len(lengths) if effort is None else max(effort - visited, 1)
        fits = list(islice(filter(free, range(max(k, first), len(lengths))), budget))
        if not fits:
            # Undominated only if no other piece, even a larger one, still fits.
            if not any(map(free, range(first, k))):
                found.append((left, chosen))
                exact += left == 0
                if width is not None and exact >= 4 * width:
                    break
            continue
        closing = place.get(left)
        if closing is not None and closing >= k and closing != fits[0] and free(closing):
            fits = [closing, *(j for j in fits if j != closing)]
        stack += [(j, left - lengths[j], (*chosen, lengths[j])) for j in reversed(fits)]
    kept: list[tuple[int, tuple[int, ...]]] = []
    for waste, items in sorted(set(found), key=lambda x: (x[0], len(x[1]), [-v for v in x[1]])):
        if width is not None and len(kept) >= width:
            break
        if not any(_fits_inside(items, other) for _, other in kept):
            kept.append((waste, items))
    return [items for _, items in kept] or [best_single(counts, room)]


def best_single(counts: np.ndarray, room: int) -> tuple[int, ...]:
    """The largest pieces that fit, one after another."""
    out: list[int] = []
    while room:
        fit = [int(v) for v in np.flatnonzero(counts[: room + 1])[::-1] if v and counts[v] > out.count(int(v))]
        if not fit:
            break
        out.append(fit[0])
        room -= fit[0]
    return tuple(out)


def _applied(counts: np.ndarray, items: tuple[int, ...]) -> int:
    """How many sequences can be filled alike."""
    need: dict[int, int] = {}
    for v in items:
        need[v] = need.get(v, 0) + 1
    return min(int(counts[v]) // k for v, k in need.items())


def best_fit_decreasing(counts: np.ndarray, size: int) -> list[Pattern]:
    """The incumbent: largest piece first, into the fullest open sequence."""
    left, out = counts.copy(), []
    while True:
        present = np.flatnonzero(left)
        present = present[present > 0]
        if not len(present):
            return out
        items, room = [int(present[-1])], size - int(present[-1])
        taken = {items[0]: 1}
        while room:
            fitting = present[: np.searchsorted(present, room, side="right")][::-1]
            v = next((int(v) for v in fitting if left[v] > taken.get(int(v), 0)), None)
            if v is None:
                break
            items.append(v)
            taken[v] = taken.get(v, 0) + 1
            room -= v
        times = _applied(left, tuple(items))
        for v in items:
            left[v] -= times
        out.append(Pattern(tuple(items), times))


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Sequences that any packing needs. For every threshold a up to half a
    sequence: pieces longer than half need one each, and what pieces from a to
    a half of a sequence don't find beside those (none beside pieces longer than
    ``size - a``) needs more. Threshold 0 is the bound by volume."""
    length = np.arange(len(counts))
    above = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0)
    n, total = above(counts), above(counts * length)
    half = size // 2 + 1
    a = np.arange(size // 2 + 1)
    alone, paired = n[size - a + 1], n[half] - n[size - a + 1]
    beside = paired * size - (total[half] - total[size - a + 1])
    return int((alone + paired + np.maximum(0, -(-(total[a] - total[half] - beside) // size))).max(initial=0))


def plan(counts: np.ndarray, size: int, nodes: int | None = 1000, width: int | None = 6, effort: int | None = 400, work: float = 1e9) -> list[Pattern]:
    """Patterns for a histogram of lengths (``counts[v]`` pieces of length v).

    Best-fit decreasing is the first incumbent. While it uses more sequences
    than the lower bound, fractional fillings (``relax``) raise that bound, and
    their whole multiples, the rest being packed by bin completion, are the next
    incumbent; should that not settle it, bin completion starts from all pieces.
    ``nodes``, ``width`` and ``effort`` are those of ``complete`` and ``work``
    that of ``relax``: they bound time on the driver, never what is packed. None
    for the first three is exhaustive. Stops as soon as the bound is met, and is
    never worse than best-fit decreasing.
    """
    if nodes is width is effort is None:
        return exhaustive(counts, size)
    counts = np.asarray(counts, dtype=np.int64)
    best = best_fit_decreasing(counts, size)
    bound, known = lower_bound(counts, size), used(best)
    if known <= bound:
        return best
    fractions, least = relax(counts, size, known, work)
    bound = max(bound, least)
    left, whole = counts.copy(), []
    for items, times in fractions:
        need = {v: items.count(v) for v in items}
        n = min(int(times + 1e-9), *(int(left[v]) // k for v, k in need.items()))
        if n > 0:
            for v, k in need.items():
                left[v] -= n * k
            whole.append(Pattern(items, n))
    rest = complete(left, size, max(bound - used(whole), lower_bound(left, size)), nodes, width, effort)
    if used(whole) + used(rest) < known:
        best, known = [*whole, *rest], used(whole) + used(rest)
    if known > bound and not whole:
        best = min(best, complete(counts, size, bound, nodes, width, effort), key=used)
    return best


def used(patterns: list[Pattern]) -> int:
    """Number of sequences."""
    return sum(p.count for p in patterns)


def complete(counts: np.ndarray, size: int, bound: int, nodes: int | None, width: int | None, effort: int | None) -> list[Pattern]:
    """Bin completion: branch and bound over undominated fillings around the
    largest piece that is left, each used as often as the counts allow.

    Branches whose waste exceeds what the incumbent leaves are cut. Of the open
    branches that with the fewest departures from the first choice comes next,
    the deepest of those first: a dive, then dives that depart from it once, and
    so on. Best-fit completions of a branch are incumbents, at the first nodes
    and wherever the search departs anew. At most ``nodes`` nodes, ``width``
    fillings at each, ``effort`` steps to list them; done once ``bound`` is met.
    """
    total = int(counts @ np.arange(len(counts)))
    best = best_fit_decreasing(counts, size)
    known, spent, serial = used(best), 0, 0
    # (departures, -depth, serial, counts before, filling, times, waste, patterns before)
    heap: list[tuple] = [(0, 0, 0, counts, (), 0, 0, ())]
    while heap and known > bound and (nodes is None or spent < nodes):
        departures, depth, fresh, before, items, times, waste, chosen = heapq.heappop(heap)
        if waste > (known - 1) * size - total:
            continue
        spent += 1
        left = before
        if items:
            left = before.copy()
            np.subtract.at(left, list(items), times)
            chosen = (*chosen, Pattern(items, times))
        if not left[1:].any():
            best, known = list(chosen), used(chosen)
            continue
        if spent <= 50 or fresh:
            found = [*chosen, *best_fit_decreasing(left, size)]
            if used(found) < known:
                best, known = found, used(found)
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        for rank, more in enumerate(fillings(rest, size - largest, width, effort)):
            whole = (largest, *more)
            times = _applied(left, whole)
            w = waste + times * (size - sum(whole))
            if w <= (known - 1) * size - total:
                serial += 1
                heapq.heappush(heap, (departures + (rank > 0), depth - 1, serial if rank else 0, left, whole, times, w, chosen))
    return best


def best_values(lengths: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per room from 0 to ``size``: the greatest total value of lengths that fit
    (each as often as wished), and the last of them, 0 where the room's end
    stays empty. A length worth no more than a shorter one is never taken."""
    worth = values > np.concatenate([[1e-12], np.maximum.accumulate(values)[:-1].clip(1e-12)])
    lengths, values = lengths[worth], values[worth]
    best, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    fit = np.searchsorted(lengths, np.arange(size + 1), side="right").tolist()
    for room in range(int(lengths[0]) if len(lengths) else size + 1, size + 1):
        offers = best[room - lengths[: fit[room]]] + values[: fit[room]]
        k = int(offers.argmax())
        better = offers[k] > best[room - 1] + 1e-12
        best[room], last[room] = (offers[k], lengths[k]) if better else (best[room - 1], 0)
    return best, last


def relax(counts: np.ndarray, size: int, known: int, work: float) -> tuple[list[tuple[tuple[int, ...], float]], int]:
    """(fillings with fractional times, lower bound): the packing problem
    without whole numbers, by generating fillings as they are needed.

    The times solve a linear program by the simplex method. Its prices say what
    a piece of each length is worth; a filling worth more than a sequence, the
    best around each length, joins the program until there is none, or until
    pivots times the square of the number of lengths exceed ``work``, or the
    bound shows that fewer than ``known`` sequences are impossible.
    """
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    m, need = len(lengths), counts[lengths].astype(np.float64)
    place = {int(v): k for k, v in enumerate(lengths)}

    def column(items: tuple[int, ...]) -> np.ndarray:
        return np.bincount([place[v] for v in items], minlength=m).astype(np.float64)

    # Fractional best fit: every filling uses up a length, so they are a basis.
    fillings_, times, left, present = [], [], need.copy(), lengths.tolist()
    while present:
        items, room = [present[-1]], size - present[-1]
        while k := bisect_right(present, room):
            items.append(present[k - 1])
            room -= items[-1]
        share = {v: items.count(v) for v in items}
        t = min(left[place[v]] / n for v, n in share.items())
        for v, n in share.items():
            left[place[v]] -= n * t
        gone = [v for v in share if left[place[v]] < 1e-9]
        fillings_ += [tuple(items), *((v,) for v in gone[1:])]
        times += [t, *(0.0 for _ in gone[1:])]
        present = [v for v in present if v not in gone]

    def inverse() -> np.ndarray:
        return np.linalg.inv(np.array([column(f) for f in fillings_]).T)

    x, basis, bound = np.array(times), inverse(), 0
    pool, names = np.zeros((m, 0)), []
    for pivot in range(1, 2 + int(work / m**2)):
        prices = basis.sum(axis=0)
        worth = prices @ pool
        if not len(names) or worth.max() <= 1 + 1e-7:
            values, last = best_values(lengths, prices.clip(0), size)
            # Prices at which no filling is worth more than one bound the sequences.
            bound = max(bound, math.ceil(float(prices.clip(0) @ need) / max(float(values[size]), 1.0) - 1e-6))
            around = prices.clip(0) + values[size - lengths]
            fresh = []
            for k in np.argsort(-around)[: max(64, m // 4)].tolist():
                if around[k] > 1 + 1e-7:
                    items, room = [int(lengths[k])], size - int(lengths[k])
                    while room > 0:
                        items += [int(last[room])] if last[room] else []
                        room -= int(last[room]) or 1
                    fresh.append(tuple(sorted(items, reverse=True)))
            fresh = list(dict.fromkeys(fresh))
            if bound >= known or not fresh:
                break
            if len(names) > 4 * m + 400:  # the least promising fillings may come again
                kept = np.argsort(-worth)[: 2 * m + 200]
                pool, names = pool[:, kept], [names[k] for k in kept]
            pool, names = np.column_stack([pool, *map(column, fresh)]), names + fresh
            worth = prices @ pool
            if worth.max() <= 1 + 1e-7:
                break
        enters = int(worth.argmax())
        d = basis @ pool[:, enters]
        ratio = np.where(d > 1e-7, x / np.where(d > 1e-7, d, 1), np.inf)
        leaves = int(np.where(ratio <= ratio.min() + 1e-9, d, 0).argmax())  # of equals the safest pivot
        x = (x - ratio[leaves] * d).clip(0)
        x[leaves] = max(ratio[leaves], 0)
        row = basis[leaves] / d[leaves]
        basis = basis - np.outer(d, row)
        basis[leaves], fillings_[leaves] = row, names[enters]
        if pivot % 128 == 0:  # rounding is swept out
            try:
                basis = inverse()
            except np.linalg.LinAlgError:  # too much of it: the times so far are as good as any
                break
            x = (basis @ need).clip(0)
    return list(zip(fillings_, x.tolist(), strict=True)), bound


def exhaustive(counts: np.ndarray, size: int) -> list[Pattern]:
    """The least number of sequences, by all undominated fillings, one sequence
    at a time: for small histograms, as the work grows with their partitions."""
    counts = np.asarray(counts, dtype=np.int64)
    weights = np.arange(len(counts))
    best = best_fit_decreasing(counts, size)
    best_n = sum(p.count for p in best)
    stack: list[tuple[np.ndarray, tuple[Pattern, ...]]] = [(counts.copy(), ())]
    seen: dict[bytes, int] = {}
    while stack:
        left, chosen = stack.pop()
        if len(chosen) + -(-int(left @ weights) // size) >= best_n or seen.get(left.tobytes(), best_n) <= len(chosen):
            continue
        seen[left.tobytes()] = len(chosen)
        if not left[1:].any():
            best, best_n = list(chosen), len(chosen)
            continue
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        for rest in reversed(fillings(left, size - largest)):
            after = left.copy()
            np.subtract.at(after, list(rest), 1)
            stack.append((after, (*chosen, Pattern((largest, *rest), 1))))
    return best


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset) in rank order."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        at = 0
        for v in p.lengths:
            out.setdefault(v, []).append((used.get(v, 0), sequence, at))
            used[v] = used.get(v, 0) + p.count
            at += v
        sequence += p.count
    return {v: np.array(rows, dtype=np.int64) for v, rows in out.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    size: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Token pieces of every document: whole if it fits, else full pieces
    after a first one that takes the remainder. ``with_ids`` adds the ids
    (little-endian 32-bit) themselves. Null text is an empty one, of the end id
    alone; repeated rows and null ids stay; an empty table gives no rows; other
    columns are ignored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = units.library_encoder(tokenizer_path)
        for batch in batches:
            for at, texts in units.slices(batch.column(1), units.WIDE // 2):
                ids, bounds = units.with_end(*encoder.texts(texts), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                n = np.diff(bounds)
                k = -(-n // size)
                row = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                head = n - (k - 1) * size
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
                length = np.where(piece == 0, head[row], size)
                first = bounds[row] + start
                spans = [raw[4 * a : 4 * (a + b)] for a, b in zip(first.tolist(), length.tolist(), strict=True)]
                keys = batch.column(0).slice(at, len(texts)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                    ]
                    + ([pa.array([bytes(x) for x in spans], pa.binary())] if with_ids else []),
                    names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids,
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, PIECES + (", ids binary" if with_ids else "")
    )


def pack(cut: DataFrame, size: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces.

    Ranks within a length are dealt in two steps, since one length may hold a
    third of all pieces: n pieces of a length are spread by a hash over about
    the square root of n sub-groups, and a row's rank is its place in its
    sub-group plus the sizes of those before, so that neither the sub-groups
    nor their number grow faster than that root. Ties (repeated
    rows) get different ranks in any order. No pieces give no rows.
    """
    spark = cut.sparkSession
    cut = common.materialize(cut, "pieces")
    columns = cut.columns
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``size`` rows
        histogram[row["length"]] = row["count"]
    table = slots(plan(histogram, size))
    groups = np.maximum(1, np.ceil(np.sqrt(histogram))).astype(np.int64)
    of_length = F.array(*[F.lit(int(g)) for g in groups])
    salted = cut.withColumn(
        "lm_group",
        F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(of_length, (F.col("length") + 1).cast("int"))).cast("int"),
    )
    sizes = salted.groupBy("length", "lm_group").agg(F.count(F.lit(1)).alias("lm_n"))
    before = Window.partitionBy("length").orderBy("lm_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "lm_group", F.coalesce(F.sum("lm_n").over(before), F.lit(0)).alias("lm_base"))
    order = Window.partitionBy("length", "lm_group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("lm_rank", F.row_number().over(order).cast("long") - 1)
        .join(bases, ["length", "lm_group"])
        .select(*columns, (F.col("lm_rank") + F.col("lm_base")).alias("lm_rank"))
    )
    at_length, at_rank = columns.index("length"), len(columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at_length).to_numpy(zero_copy_only=False)
            rank = batch.column(at_rank).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                mine = np.flatnonzero(length == v)
                rows = table[int(v)]
                k = np.searchsorted(rows[:, 0], rank[mine], side="right") - 1
                sequence[mine] = rows[k, 1] + rank[mine] - rows[k, 0]
                offset[mine] = rows[k, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at_rank], pa.array(sequence), pa.array(offset)],
                names=[*columns, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
