"""Near duplicates: texts whose sets of word shingles reach a Jaccard similarity.

Candidates come from two searches. SimHash fingerprints of the shingles are
searched by the generalised pigeonhole scheme (see ``simhash``); near pairs are
candidates. Fingerprints alone miss pairs just over the threshold, so an exact
set join completes them: shingles are put in one global order, those of a third
of the hash space by document frequency first, the rest by hash; two similar
sets share one of the first shingles of both in that order. Most texts have so
many shingles of their own among their first that nothing is left to share and
they drop out. Candidates chain to groups, and a group's texts are compared by
their whole sets, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as digest

from leafmill.llm import common, simhash, units
from leafmill.llm.graph import connected_components

#: Shingles whose hash is below this are ordered by document frequency.
COUNTED = np.uint64((1 << 64) // 3)
#: Texts and bytes of a block of a crowded group.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: Bytes of text that are turned into shingles at once.
SLICE = 1 << 20
#: Differing bits of two fingerprints that make a candidate.
RADIUS = 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_codes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every shingle of ``size`` words (A-Z lower-cased),
    repeats included, made from hashes of the distinct words, and each row's
    first one. Fewer words: one shingle of them all; none: zero stands in."""
    flat, rows = units.words(texts, lower=True)
    of, distinct = units.coded(flat)
    known = np.fromiter((digest(w) for w in distinct), dtype=np.uint64, count=len(distinct))
    word = np.append(known[of], np.zeros(size, np.uint64))
    per_row = np.diff(rows)
    count = np.maximum(per_row - size + 1, 1)
    bounds = np.concatenate([[0], np.cumsum(count)])
    head = np.repeat(rows[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    reach = np.repeat(np.minimum(per_row, size), count)
    out = np.zeros(len(head), dtype=np.uint64)
    for k in range(size):
        step = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + word[head + k])
        out = np.where(k < reach, step, out)
    return out, bounds


def distinct_per_row(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct codes, ascending, and each row's first one."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    by = np.lexsort((codes, row))
    codes = codes[by]
    fresh = np.ones(len(codes), dtype=bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    return codes[fresh], np.searchsorted(row[fresh], np.arange(len(bounds)))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    out = []
    for _, part in units.slices(texts, SLICE):
        flat, bounds = distinct_per_row(*shingle_codes(part, size))
        out += [flat[a:b].copy() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def prefix_sizes(n: np.ndarray, similarity: float) -> np.ndarray:
    """Two sets share ``similarity`` of the larger at least, so they can't
    differ in all of either's first n - similarity * n + 1 members."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def named_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``leafmill_node``: one number for each distinct text (null
    as empty). Texts whose 64-bit hashes clash are told apart by a second one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one, two = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    hashed = docs.select(one.alias("h"), two.alias("g"))
    clash = hashed.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high")
    clash = common.materialize(clash.select("h", "low"), "clashes")
    told = docs.withColumns({"leafmill_h": one, "leafmill_g": two})
    clash = clash.select(F.col("h").alias("leafmill_h"), F.col("low").alias("leafmill_low"))
    apart = F.col("leafmill_low").isNotNull() & (F.col("leafmill_low") != F.col("leafmill_g"))
    node = F.when(apart, F.xxhash64("leafmill_g", "leafmill_h")).otherwise(F.col("leafmill_h"))
    return told.join(clash, "leafmill_h", "left").select(*docs.columns, node.alias("leafmill_node"))


def _cut(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by a key, and where each key begins in it."""
    order = np.argsort(by, kind="stable")
    return order, np.flatnonzero(np.concatenate([[True], np.diff(by[order]) != 0])) if len(by) else order


def _shingle_packs(similarity: float, size: int, buckets: int):
    """Rows (slice, bucket, a, b, c) of texts (node, text): bucket -1 has the
    slice's nodes, numbers of shingles and of counted ones, and fingerprints;
    the others the shingles that may belong to a prefix, and whose they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in units.slices(batch.column(1), SLICE):
                nodes, where = np.unique(ids[at : at + len(part)], return_index=True)
                codes, bounds = shingle_codes(part.take(pa.array(where)), size)
                prints = simhash.majority(codes, bounds)
                flat, bounds = distinct_per_row(codes, bounds)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n)), n)
                counted = np.bincount(owner[flat < COUNTED], minlength=len(n))
                # Ascending hashes: the counted ones stand first.
                sent = np.arange(len(flat)) - bounds[owner] < np.maximum(counted, prefix_sizes(n, similarity))[owner]
                flat, owner = flat[sent], owner[sent].astype(np.uint32)
                bucket = (flat % np.uint64(buckets)).astype(np.int64)
                order, edges = _cut(bucket)
                groups = np.split(order, edges[1:])
                name += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(groups) + 1, name)),
                        pa.array([-1, *bucket[order][edges].tolist()], pa.int64()),
                        pa.array([nodes.tobytes(), *(flat[g].tobytes() for g in groups)], pa.binary()),
                        pa.array([np.stack([n, counted]).astype(np.uint32).tobytes(), *(owner[g].tobytes() for g in groups)], pa.binary()),
                        pa.array([prints.tobytes(), *([None] * len(groups))], pa.binary()),
                    ],
                    names=["slice", "bucket", "a", "b", "c"],
                )

    return run


def _by_key(work):
    """For rows sorted by their first column: ``work`` on all rows of a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != key[a]:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _numbers(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]


def _shared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of a bucket's shingles those that stand in several texts, with how
    many, back to their slices."""
    slices = rows.column("slice").to_numpy()
    shingles, owners = _numbers(rows.column("a"), np.uint64), _numbers(rows.column("b"), np.uint32)
    pack = np.repeat(np.arange(len(slices)), [len(x) for x in shingles])
    flat, owner = np.concatenate(shingles), np.concatenate(owners)
    _, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count[which]
    keep = np.flatnonzero(often > 1)
    edges = np.searchsorted(pack[keep], np.arange(len(slices) + 1))
    parts = [(s, keep[a:b]) for s, a, b in zip(slices.tolist(), edges[:-1], edges[1:], strict=True) if b > a]
    if parts:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([s for s, _ in parts], pa.int64()),
                pa.array([flat[k].tobytes() for _, k in parts], pa.binary()),
                pa.array([owner[k].tobytes() for _, k in parts], pa.binary()),
                pa.array([often[k].astype(np.uint32).tobytes() for _, k in parts], pa.binary()),
            ],
            names=["slice", "a", "b", "c"],
        )


def _prefixes(similarity: float):
    """For a slice's rows: (shingle, node, n) of every prefix shingle that
    stands in several texts."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own = np.array(rows.column("own"))
        if own.all() or not own.any():  # nothing shared, or no such slice
            return
        head, rest = rows.filter(pa.array(own)), rows.filter(pa.array(~own))
        nodes = _numbers(head.column("a"), np.int64)[0]
        n, counted = _numbers(head.column("b"), np.uint32)[0].reshape(2, -1).astype(np.int64)
        shingle, owner, often = (
            np.concatenate(_numbers(rest.column(c), k)) for c, k in (("a", np.uint64), ("b", np.uint32), ("c", np.uint32))
        )
        first = shingle < COUNTED
        mine = owner[first]
        alone = counted - np.bincount(mine, minlength=len(n))
        by = np.flatnonzero(first)[np.lexsort((shingle[first], often[first], mine))]
        place = np.arange(len(by)) - np.searchsorted(owner[by], np.arange(len(n)))[owner[by]]
        # Shingles beyond the counted third were sent only if they're in the prefix.
        take = np.concatenate([by[place < (prefix_sizes(n, similarity) - alone)[owner[by]]], np.flatnonzero(~first)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(shingle[take].view(np.int64)), pa.array(nodes[owner[take]]), pa.array(n[owner[take]].astype(np.int32))],
            names=["shingle", "node", "n"],
        )

    return work


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, dtype=np.int64)) for x in (a, c)], names=["node", "fp"])


def candidate_groups(named: DataFrame, similarity: float, size: int) -> DataFrame:
    """(node, label): texts chained by candidate pairs. Any two texts of that
    similarity are in one group; texts alone have no row."""
    n_parts = common.shuffle_partitions(named.sparkSession)
    packs = common.materialize(
        named.select("node", "text").mapInArrow(_shingle_packs(similarity, size, 2 * n_parts), "slice long, bucket long, a binary, b binary, c binary"),
        "shingles",
    )
    back = packs.where("bucket >= 0").select("bucket", "slice", "a", "b").repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    back = back.mapInArrow(_by_key(_shared), "slice long, a binary, b binary, c binary").withColumn("own", F.lit(False))
    own = common.reread(packs).where("bucket < 0").select("slice", "a", "b", "c", F.lit(True).alias("own"))
    whole = back.unionByName(own).repartition(n_parts, "slice").sortWithinPartitions("slice")
    found = common.materialize(whole.mapInArrow(_by_key(_prefixes(similarity)), "shingle long, node long, n int").distinct(), "prefixes")
    # Sets that can be similar are of one class of size or of adjacent ones, so
    # one leader for each shingle and class joins a list of any length.
    size_class = F.floor(F.log("n") / F.lit(log(1 / similarity) * 1.000001)).cast("int")
    lists = found.groupBy("shingle", size_class.alias("k")).agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("texts"))
    leads = common.materialize(lists, "leads")
    mates = common.reread(found).withColumn("k", size_class).join(leads, ["shingle", "k"]).where("texts > 1 AND node <> lead")
    above = common.reread(leads).select("shingle", (F.col("k") - 1).alias("k"), F.col("lead").alias("other"))
    chained = leads.join(above, ["shingle", "k"]).where("lead <> other")
    prints = common.materialize(
        common.reread(packs).where("bucket < 0").select("a", "c").mapInArrow(_unpacked, "node long, fp long").distinct(), "prints"
    )
    heads = common.materialize(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    alike = common.reread(prints).join(heads, "fp").where("node <> head")
    near = common.materialize(simhash.links(heads.select("fp"), RADIUS), "near")
    ends = [common.reread(heads).select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in ("a", "b")]
    close = near.join(ends[0], "a").join(ends[1], "b")
    edges = mates.select(F.col("node").alias("a"), F.col("lead").alias("b"))
    for more, a, b in ((chained, "lead", "other"), (alike, "node", "head"), (close, "a_head", "b_head")):
        edges = edges.unionByName(more.select(F.col(a).alias("a"), F.col(b).alias("b")))
    labels = connected_components(edges)
    for table in (packs, found, leads, prints, heads, near):
        common.discard(table)
    return labels


def forest(sets: list[np.ndarray], similarity: float, joined: np.ndarray | None = None, asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join exactly the sets that chains of pairs of that Jaccard
    similarity join. Every set is compared with all not yet joined to it.

    With ``joined`` (a number for each set; equal ones are joined already) only
    the sets ``asking`` are compared with all that are joined otherwise.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.concatenate([[0], np.cumsum(sizes)])
    holders = owner[np.argsort(token, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(token))])

    def similar(me: int) -> np.ndarray:
        shared = np.zeros(n, dtype=np.int64)
        mine = token[places[me] : places[me + 1]]
        for at in range(0, len(mine), 1024):
            low, high = starts[mine[at : at + 1024]], starts[mine[at : at + 1024] + 1]
            count = high - low
            spots = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
            shared += np.bincount(holders[spots], minlength=n)
        return shared >= similarity * (sizes[me] + sizes - shared) - 1e-9

    out = []
    if joined is not None:
        group = np.unique(joined, return_inverse=True)[1]
        for me in asking.tolist():
            if (group == group[me]).all():
                continue
            others = np.flatnonzero(similar(me) & (group != group[me]))
            _, one_each = np.unique(group[others], return_index=True)
            for k in others[one_each].tolist():
                out.append((me, k))
                group[group == group[k]] = group[me]
        return out
    alone = np.ones(n, dtype=bool)
    for first in range(n):
        queue = [first] if alone[first] else []
        alone[first] = False
        while queue and alone.any():
            me = queue.pop()
            near = np.flatnonzero(alone & similar(me))
            alone[near] = False
            out += [(me, k) for k in near.tolist()]
            queue += near.tolist()
    return out


def _block_links(similarity: float, size: int):
    """For one tile's rows (tile, node, text, joined, asks): the links in it."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, asks = rows.column("node").to_numpy(), np.array(rows.column("asks"))
        where = np.concatenate([np.flatnonzero(asks), np.flatnonzero(~asks)])
        where = where[np.unique(ids[where], return_index=True)[1]]  # a visitor stands once, as one
        texts = pa.concat_arrays(units.text_array(c) for c in rows.column("text").chunks)
        sets = shingle_sets(texts.take(pa.array(where)), size)
        if rows.column("joined").null_count:
            pairs = forest(sets, similarity)
        else:
            pairs = forest(sets, similarity, rows.column("joined").to_numpy()[where], np.flatnonzero(asks[where]))
        ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        if len(ends):
            yield pa.RecordBatch.from_arrays([pa.array(ids[where][ends[:, k]]) for k in (0, 1)], names=["a", "b"])

    return _by_key(work)


def _blocks(texts: DataFrame) -> DataFrame:
    """(label, nb): into how many blocks a label's texts are dealt."""
    count = F.count(F.lit(1)) / F.lit(BLOCK_ROWS)
    return texts.groupBy("label").agg(F.ceil(F.greatest(count, F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("long").alias("nb"))


def _deal(salt: int, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("node"), F.lit(salt)), blocks)


def _joined(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label, bytes, comp): what the links join among ``texts``."""
    comps = connected_components(links).select("node", F.col("label").alias("comp"))
    return texts.select("node", "label", "bytes").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def group_links(texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """(a, b) links that join all similar texts of each group.

    ``texts`` (written) has node, label, text, bytes. First the texts of each
    block meet. For groups of several blocks the leaders of what that joined
    meet next, in blocks dealt anew; then every text outside the largest part
    of its group is compared with all texts of the other parts, block by block.
    """
    n_parts = common.shuffle_partitions(texts.sparkSession)

    def meet(rows: DataFrame, label: str) -> DataFrame:
        rows = rows.select("tile", "node", "text", "joined", "asks").repartition(n_parts, "tile").sortWithinPartitions("tile")
        return common.materialize(rows.mapInArrow(_block_links(similarity, size), "a long, b long"), label)

    plain = {"joined": F.lit(None).cast("long"), "asks": F.lit(False)}
    crowded = common.materialize(_blocks(texts).where("nb > 1"), "crowded")
    block = F.when(F.col("nb").isNull(), F.col("label")).otherwise(F.xxhash64("label", _deal(1, F.col("nb"))))
    links = meet(common.reread(texts).join(crowded, "label", "left").withColumn("tile", block).withColumns(plain), "links")
    if not crowded.limit(1).count():
        return links
    many = common.materialize(common.reread(texts).join(common.reread(crowded), "label", "left_semi"), "many")
    parts = _joined(links, many)
    heads = parts.groupBy("label", "comp").agg(F.min("node").alias("node")).select("node")
    heads = common.materialize(common.reread(many).join(heads, "node", "left_semi"), "part-heads")
    dealt = common.reread(heads).join(_blocks(heads), "label").withColumn("tile", F.xxhash64("label", _deal(2, F.col("nb"))))
    links = links.unionByName(meet(dealt.withColumns(plain), "links"))
    parts = common.materialize(_joined(links, many), "parts")
    sizes = parts.groupBy("label", "comp").agg(F.count(F.lit(1)).alias("texts"))
    body = sizes.groupBy("label").agg(F.max_by("comp", F.struct("texts", "comp")).alias("body"), F.count(F.lit(1)).alias("comps"))
    body = body.where("comps > 1")
    movers = common.materialize(common.reread(parts).join(body, "label").where("comp <> body"), "movers")
    homes = _blocks(movers).withColumnRenamed("nb", "mb").join(common.reread(crowded), "label")
    placed = common.reread(many).join(common.reread(movers).select("node", F.lit(True).alias("moves")), "node", "left")
    placed = placed.join(common.reread(parts).select("node", "comp"), "node").join(homes, "label")
    here, there = _deal(1, F.col("nb")), _deal(3, F.col("mb"))
    tile = F.xxhash64("label", "x", "y").alias("tile")
    every = F.sequence(F.lit(0).cast("long"), F.col("mb") - 1), F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)
    stay = placed.select("label", "node", "text", "comp", here.alias("x"), F.explode(every[0]).alias("y"))
    move = placed.where("moves").select("label", "node", "text", "comp", there.alias("y"), F.explode(every[1]).alias("x"))
    last = stay.select(tile, "node", "text", F.col("comp").alias("joined"), F.lit(False).alias("asks")).unionByName(
        move.select(tile, "node", "text", F.col("comp").alias("joined"), F.lit(True).alias("asks"))
    )
    return links.unionByName(meet(last, "links"))


def near_duplicates(
    docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, node, label) of every row: node names a text, label its group.

    Texts are linked if their sets of ``size``-word shingles reach the Jaccard
    ``similarity``; groups are what the links join. The search is exact and
    nothing is capped. Null texts count as empty; wordless texts are alike;
    repeated rows stay repeated; null ids stay; ties have no part in it; an
    empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    named = named_texts(source).withColumnRenamed("leafmill_node", "node")
    groups = candidate_groups(named, similarity, size)
    texts = named.select("node", "text").join(groups, "node").dropDuplicates(["node"])
    texts = common.materialize(texts.select("node", "label", "text", F.octet_length("text").alias("bytes")), "candidates")
    labels = connected_components(group_links(texts, similarity, size))
    common.discard(texts)
    return named.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows that stand first (by id, then text hash) in their near-duplicate
    group, all columns unchanged, whatever their names. Rows of equal id and
    text are one document, of which any row stays; a null id orders first; null
    texts count as empty ones; wordless texts are one group; an empty table
    gives no rows."""
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    first = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "node")).alias("f"))
    keys = first.select(
        F.coalesce("f.doc_id", F.lit(0)).alias("leafmill_id"), F.col("f.known").alias("leafmill_known"), F.col("f.node").alias("leafmill_node")
    )
    plain, name = common.plain_names(docs)
    id_ = F.col(name[id_col])
    keyed = named_texts(plain, name[text_col]).withColumns({"leafmill_id": F.coalesce(id_.cast("long"), F.lit(0)), "leafmill_known": id_.isNotNull()})
    by = ["leafmill_id", "leafmill_known", "leafmill_node"]
    return keyed.dropDuplicates(by).join(keys.hint("merge"), by, "left_semi").select(*plain.columns).toDF(*docs.columns)
