"""SimHash fingerprints and all pairs within a Hamming radius.

The search follows the generalised pigeonhole principle: the 64 bits are dealt
to m partitions, partition i gets its own radius t_i >= -1, and as long as the
sum of (t_i + 1) is the global radius + 1, any two fingerprints within that
radius agree up to t_i bits in some partition i. Correlated bits go to one
partition, so that the others stay selective; m and the radii are chosen by
dynamic programming on estimated numbers of probes and candidates, from bit
frequencies over all fingerprints. Candidates are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, units
from leafmill.llm.graph import connected_components, local_labels

#: Members of a bucket beyond which it is dealt to tiles.
HOT_BUCKET = 4096
#: Cost of comparing a candidate, where sending a probe row costs 1.
COMPARE = 0.02
#: Bytes of text, and shingles, that are worked on at once.
SLICE, RUN = 1 << 20, 1 << 16


def shingle_spans(texts: pa.Array, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words lower-cased (A-Z) and joined by one space, and the word shingles.

    Returns the joined bytes, shingle starts and ends in them, and each row's
    first shingle (n + 1). Fewer words than ``size``: one shingle of them all.
    """
    flat, rows = units.words(texts, lower=True)
    offsets, data = units.buffers(flat)
    n_words = len(offsets) - 1
    joined = np.full(len(data) + n_words, 0x20, dtype=np.uint8)
    lengths = np.diff(offsets)
    joined[np.arange(len(data)) + np.repeat(np.arange(n_words), lengths)] = data
    first = offsets[:-1] + np.arange(n_words)
    last = first + lengths
    per_row = np.diff(rows)
    count = np.where(per_row == 0, 0, np.maximum(per_row - size + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    head = np.repeat(rows[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    reach = np.repeat(np.minimum(per_row, size), count) - 1
    return joined.tobytes(), first[head], last[head + reach], bounds


def shingle_hashes(texts: pa.Array, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, repeats included, and each row's first one."""
    from xxhash import xxh64_intdigest as digest

    joined, first, last, bounds = shingle_spans(texts, size)
    out = np.empty(len(first), dtype=np.uint64)
    for at in range(0, len(first), RUN):
        ends = zip(first[at : at + RUN].tolist(), last[at : at + RUN].tolist(), strict=True)
        out[at : at + RUN] = np.fromiter((digest(joined[a:b], seed) for a, b in ends), dtype=np.uint64)
    return out, bounds


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is one if set in over half of a row's hashes."""
    ones = np.zeros((len(bounds) - 1, 64), dtype=np.int64)
    for at in range(0, len(hashes), RUN):
        part = hashes[at : at + RUN]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        low = int(np.searchsorted(bounds, at, side="right")) - 1
        high = int(np.searchsorted(bounds, at + len(part), side="left"))
        rows = np.arange(low, high)
        rows = rows[bounds[rows + 1] > np.maximum(bounds[rows], at)]
        ones[rows] += np.add.reduceat(bits, np.maximum(bounds[rows] - at, 0), axis=0, dtype=np.int64)
    most = 2 * ones > np.diff(bounds)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()


def row_fingerprints(texts: pa.Array, size: int) -> np.ndarray:
    return majority(*shingle_hashes(texts, size))


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long, of whole texts.

    Null and wordless texts have fingerprint zero; every input row gives one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in units.slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)).cast(pa.int64()),
                        pa.array(row_fingerprints(texts, size).view(np.int64)),
                    ],
                    names=["doc_id", "fp"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


@dataclass(frozen=True)
class Scheme:
    """Bits and radius of each partition, and the estimated cost."""

    bits: tuple[tuple[int, ...], ...]
    radii: tuple[int, ...]
    cost: float


def bit_moments(nodes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, how often each bit is set, and how often each two are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64), dtype=np.int64), 0
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(v), 1 << 16):
                part = np.ascontiguousarray(v[at : at + (1 << 16)])
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(v)
        if n:
            cells = np.append(both.ravel(), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(4097, dtype=np.int32)), pa.array(cells)], names=["cell", "n"]
            )

    cells = nodes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(4097, dtype=np.int64)
    for row in cells.collect():  # 4,097 rows whatever the corpus
        flat[row["cell"]] = row["n"]
    both = flat[:4096].reshape(64, 64)
    return int(flat[4096]), np.diag(both).copy(), both


def group_bits(n: int, ones: np.ndarray, both: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """Deal the bits to m partitions of nearly equal size, each grown from its
    most correlated pair by the bit most correlated with what it has."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(link, 0)
    free, out = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        left = sorted(free)
        sub = link[np.ix_(left, left)]
        group = [left[int(np.argmax(sub.sum(axis=1)))]]
        free.discard(group[0])
        while len(group) < size:
            left = sorted(free)
            best = left[int(np.argmax(link[np.ix_(left, group)].sum(axis=1)))]
            group.append(best)
            free.discard(best)
        out.append(tuple(sorted(group)))
    return out


def choose_scheme(n: int, ones: np.ndarray, both: np.ndarray, radius: int) -> Scheme:
    """Least estimated cost over partition counts and radii."""
    p = ones / max(n, 1)
    differ = 2 * p * (1 - p)
    best: Scheme | None = None
    for m in range(1, min(8, radius + 1) + 1):
        groups = group_bits(n, ones, both, m)
        costs = []
        for bits in groups:
            law = np.array([1.0])  # of the number of differing bits of two fingerprints
            for b in bits:
                law = np.convolve(law, [1 - differ[b], differ[b]])
            per_radius = {-1: 0.0}
            for t in range(min(radius, 3, len(bits)) + 1):
                probes = sum(comb(len(bits), r) for r in range(t + 1))
                per_radius[t] = n * probes + COMPARE * n * (n / 2) * float(law[: t + 1].sum())
            costs.append(per_radius)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for per_radius in costs:
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, radii) in table.items():
                for t, c in per_radius.items():
                    key = used + t + 1
                    if key <= radius + 1 and (key not in nxt or cost + c < nxt[key][0]):
                        nxt[key] = (cost + c, (*radii, t))
            table = nxt
        if radius + 1 in table and (best is None or table[radius + 1][0] < best.cost):
            best = Scheme(tuple(groups), table[radius + 1][1], table[radius + 1][0])
    assert best is not None
    return best


def probes(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(bucket, role, fp): role 0 under its own partition value, role 1 under
    each other value within the partition's radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = []
        for bits, t in zip(scheme.bits, scheme.radii, strict=True):
            flips = [0] if t >= 0 else []
            for r in range(1, t + 1):
                flips += [sum(1 << b for b in c) for c in combinations(bits, r)]
            masks.append(np.array(flips, dtype=np.uint64))
        keeps = [np.uint64(sum(1 << b for b in bits)) for bits in scheme.bits]
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 8192):
                fp = every[at : at + 8192]
                for k, (keep, flips) in enumerate(zip(keeps, masks, strict=True)):
                    if not len(flips):
                        continue
                    value = ((fp & keep)[:, None] ^ flips[None, :]).ravel()
                    # A bijective mix tells the partitions' values apart; a clash
                    # of two partitions only adds candidates that fail verification.
                    value = (value + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                    role = np.tile(np.arange(len(flips)) > 0, len(fp)).astype(np.int8)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(value.view(np.int64)),
                            pa.array(role),
                            pa.array(np.repeat(fp, len(flips)).view(np.int64)),
                        ],
                        names=["bucket", "role", "fp"],
                    )

    return nodes.select("fp").mapInArrow(run, "bucket long, role byte, fp long")


def thin(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that keep all components, without a group's every pair.

    Returns ends and whether a link is a verified pair. Up to four links a
    member all stay; beyond, each member keeps the one to its best connected
    neighbour, and joins that only hold by way of others are told apart.
    """
    ends, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    if len(a) <= 4 * len(ends):
        return a, b, np.ones(len(a), dtype=bool)
    degree = np.bincount(flat, minlength=len(ends))
    me, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((other, -degree[other], me))
    me, other = me[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], me[1:] != me[:-1]]))
    root = local_labels(i, j, len(ends))
    return (
        np.concatenate([ends[me[first]], ends]),
        np.concatenate([ends[other[first]], ends[root]]),
        np.concatenate([np.ones(len(first), dtype=bool), np.zeros(len(ends), dtype=bool)]),
    )


def _bucket_links(radius: int):
    """For rows sorted by bucket and role: links found in each bucket."""

    def found(bucket: np.ndarray, role: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        end = np.repeat(np.append(edge[1:], len(bucket)), np.diff(np.append(edge, len(bucket))))
        owners = np.flatnonzero((role == 0) & (end - np.arange(len(bucket)) > 1))
        partners = end[owners] - owners - 1
        total = np.cumsum(partners)
        at = 0
        while at < len(owners):
            base = total[at] - partners[at]
            upto = max(int(np.searchsorted(total, base + 2_000_000, side="right")), at + 1)
            own, n = owners[at:upto], partners[at:upto]
            left = np.repeat(own, n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + left + 1
            close = np.bitwise_count(fp[left] ^ fp[right]) <= radius
            a, b = fp[left[close]], fp[right[close]]
            keep = a != b
            if keep.any():
                a, b, real = thin(a[keep], b[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(real)],
                    names=["a", "b", "verified"],
                )
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [
                batch.column(0).to_numpy(zero_copy_only=False),
                batch.column(1).to_numpy(zero_copy_only=False),
                batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64),
            ]
            if held and held[-1][0][-1] == now[0][-1]:
                held.append(now)  # one bucket goes on through this whole batch
                if held[0][0][0] == now[0][-1]:
                    continue
            elif not held:
                held = [now]
            else:
                held.append(now)
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if cut:
                yield from found(*(c[:cut] for c in cols))
            held = [[c[cut:] for c in cols]]
        if held:
            yield from found(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def tiles(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Deal the rows of crowded buckets to tiles of two blocks each.

    A bucket of n rows, members and visiting probes, has b = n / (HOT_BUCKET / 2)
    blocks by hash; members own the b tiles of their row and visit those of
    their column, visitors go to the tiles of their column, so every two
    members, and every member and probe, meet in a tile of bounded size.
    """
    half = HOT_BUCKET // 2
    dealt = rows.join(sizes, "bucket").withColumn("nb", F.ceil(F.col("members") / half).cast("long"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")))
    grid = F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)
    owner = dealt.where("role = 0").select(
        "bucket", "fp", F.col("own").alias("x"), F.explode(grid).alias("y"), F.lit(0).cast("byte").alias("role")
    )
    guest = dealt.select(
        "bucket", "fp", F.explode(grid).alias("x"), F.col("own").alias("y"), "role"
    ).where("role = 1 OR x <> y").withColumn("role", F.lit(1).cast("byte"))
    both = owner.unionByName(guest)
    return both.select(F.xxhash64("bucket", "x", "y").alias("bucket"), "role", "fp")


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b, verified) over distinct fingerprints ``nodes(fp)``.

    The links join exactly those fingerprints that chains of pairs within
    ``radius`` differing bits join; ``verified`` marks links that are such a
    pair themselves (see ``thin``).
    """
    n, ones, both = bit_moments(nodes)
    scheme = choose_scheme(n, ones, both, radius)
    rows = probes(nodes, scheme)
    sizes = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("members"))
        .where(F.col("members") > HOT_BUCKET)
    )
    sizes = common.materialize(sizes, "crowded")
    if sizes.limit(1).count():
        rows = rows.join(sizes, "bucket", "left_anti").unionByName(tiles(rows, sizes))
    n_parts = common.shuffle_partitions(nodes.sparkSession)
    return (
        rows.repartition(n_parts, "bucket")
        .sortWithinPartitions("bucket", "role")
        .mapInArrow(_bucket_links(radius), "a long, b long, verified boolean")
    )


def components(
    docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for every row.

    Rows of equal fingerprint are one node, so copies meet without pairs; a
    null id never is a component's id unless all its ids are null; repeated
    rows stay repeated; an empty table gives no rows.
    """
    prints = common.materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found = connected_components(common.materialize(links(nodes, radius), "near"))
    named = nodes.join(found.select(F.col("node").alias("fp"), "label"), "fp", "left").select(
        "fp", "low", F.coalesce("label", "fp").alias("label")
    )
    lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
    of_print = named.join(lows, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")
