"""Token ids as directly addressable codes.

A segment holds a run of token ids. Each id is cut into chunks, lowest bits
first; level k stores the k-th chunk of every id that has one, and a
continuation bitmap says which ids go on to level k + 1. A rank directory
counts the set bits before each block of the bitmap, so the place of an id in
the next level is one lookup and one popcount: any id, or any range, is read
without decoding what stands before it.

Level widths are chosen per segment by dynamic programming over the histogram
of bit lengths, which gives the fewest bits for these ids.

Layout (little-endian): ``LDA1``, levels u32, ids u64; per level width u32,
values u64, then the packed chunks, the packed bitmap and the directory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, units

MAGIC = b"LDA1"
#: Bits of bitmap between two directory entries.
BLOCK = 512


def level_widths(lengths: np.ndarray) -> list[int]:
    """Widths of least total size; ``lengths[b]``: ids of b significant bits.

    A level that starts at bit s costs (width + 1) bits for each id longer
    than s; the last level needs no bitmap.
    """
    top = max(1, int(np.max(np.flatnonzero(lengths), initial=0)))
    longer = [int(lengths[s + 1 :].sum()) if s else int(lengths.sum()) for s in range(top)]
    best: list[tuple[int, list[int]]] = [(0, [])] * (top + 1)
    for s in range(top - 1, -1, -1):
        options = []
        for w in range(1, top - s + 1):
            bitmap = 0 if s + w == top else 1
            options.append((longer[s] * (w + bitmap) + best[s + w][0], [w, *best[s + w][1]]))
        best[s] = min(options)
    return best[0][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    if width in (8, 16):
        return values.astype(f"<u{width // 8}").tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(raw: memoryview, width: int, i: int, j: int) -> np.ndarray:
    if width in (8, 16):
        step = width // 8
        return np.frombuffer(raw[i * step : j * step], dtype=f"<u{step}").astype(np.uint32)
    lo = i * width
    part = np.frombuffer(raw[lo // 8 : (j * width + 7) // 8], dtype=np.uint8)
    bits = np.unpackbits(part, bitorder="little")[lo % 8 : lo % 8 + (j - i) * width]
    weights = np.left_shift(np.uint32(1), np.arange(width, dtype=np.uint32))
    return bits.reshape(-1, width).astype(np.uint32) @ weights


def encode(ids: np.ndarray) -> bytes:
    """One segment of 32-bit ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    lengths = np.zeros(33, dtype=np.int64)
    bits = np.frexp(ids.astype(np.float64))[1]
    np.add.at(lengths, np.arange(33), np.bincount(bits, minlength=33)[:33])
    widths = level_widths(lengths)
    out = [MAGIC, struct.pack("<IQ", len(widths), len(ids))]
    rest = ids
    for k, w in enumerate(widths):
        chunk = rest & np.uint32((1 << w) - 1)
        more = (
            (rest >> np.uint32(w)) > 0 if k + 1 < len(widths) else np.zeros(0, dtype=bool)
        )
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        out += [
            struct.pack("<IQ", w, len(rest)),
            _pack(chunk, w),
            np.packbits(more, bitorder="little").tobytes(),
            directory.tobytes(),
        ]
        if len(more):
            rest = rest[more] >> np.uint32(w)
    return b"".join(out)


class Segment:
    """Random access into the bytes of one segment."""

    def __init__(self, raw: bytes | pa.Buffer):
        view = memoryview(raw)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        levels, self.n = struct.unpack_from("<IQ", view, 4)
        at, self.levels = 16, []
        for k in range(levels):
            width, n = struct.unpack_from("<IQ", view, at)
            at += 12
            chunks = view[at : (at := at + (n * width + 7) // 8)]
            m = n if k + 1 < levels else 0
            bitmap = view[at : (at := at + (m + 7) // 8)]
            blocks = -(-m // BLOCK) + 1
            directory = np.frombuffer(view[at : (at := at + 8 * blocks)], dtype="<u8")
            self.levels.append((width, chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def _rank(bitmap: memoryview, directory: np.ndarray, i: int) -> int:
        block = i // BLOCK
        tail = np.frombuffer(bitmap[block * BLOCK // 8 : (i + 7) // 8], dtype=np.uint8)
        bits = np.unpackbits(tail, bitorder="little")[: i - block * BLOCK]
        return int(directory[block]) + int(bits.sum())

    def read(self, i: int, j: int) -> np.ndarray:
        """Ids i to j - 1; touches only the blocks that hold them."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j, self.n))
        out = np.zeros(j - i, dtype=np.uint32)
        owners, shift = np.arange(j - i), 0
        for width, chunks, bitmap, directory in self.levels:
            if i == j:
                break
            out[owners] |= _unpack(chunks, width, i, j) << np.uint32(shift)
            if not len(bitmap):
                break
            part = np.frombuffer(bitmap[i // 8 : (j + 7) // 8], dtype=np.uint8)
            more = np.unpackbits(part, bitorder="little")[i % 8 : i % 8 + j - i].astype(bool)
            first = self._rank(bitmap, directory, i)
            i, j = first, first + int(more.sum())
            owners, shift = owners[more], shift + width
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])


#: Tokens that a reader of whole segments decodes at once.
RUN_TOKENS = 1 << 18

SEGMENTS = (
    "shard int, seq int, start long, n_tokens long, doc_ids binary, doc_null binary, "
    "doc_lengths binary, codes binary"
)


def write_segments(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_tokens: int = 1 << 20,
) -> DataFrame:
    """Encode every text and write segments in ascending id order.

    One row per segment: ``shard`` (a range of ids), ``seq`` within the shard,
    ``start`` (tokens of the shard before it), the ids and lengths of its
    documents, and the coded tokens. Segments end at document ends, after
    ``segment_tokens`` tokens. The rows are a Parquet table in the scratch
    folder, so Spark's committer publishes whole tasks only and any store will
    do. Null text is an empty text, a null id sorts first, repeated rows are
    written as often as they occur; an empty table gives no rows. Rows of equal
    id stand by a hash of their text, which deals those of a very frequent id
    to several shards, and then by their tokens' bytes.
    """
    spark = docs.sparkSession
    n = common.shuffle_partitions(spark)
    ids_ = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    cuts = docs.agg(F.percentile_approx(ids_, [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = np.array(cuts or [], dtype=np.int64)  # an id of many rows is a cut several times

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = units.library_encoder(tokenizer_path)
        for batch in batches:
            for at, texts in units.slices(batch.column(1), units.WIDE):
                ids, bounds = units.with_end(*encoder.texts(texts), end_id)
                keys = batch.column(0).slice(at, len(texts)).cast(pa.int64())
                known = keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                low, high = (np.searchsorted(cuts, known, side=side) for side in ("left", "right"))
                share = batch.column(2).slice(at, len(texts)).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(40)
                shard = low + (share.astype(np.int64) * (high - low + 1) >> 24)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.astype(np.int32)),
                        keys,
                        pa.array(
                            [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
                            pa.binary(),
                        ),
                    ],
                    names=["shard", "id", "ids"],
                )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size, shard, seq, start = 0, None, 0, 0

        def emit() -> pa.RecordBatch:
            nonlocal held, size, seq, start
            ids = np.frombuffer(b"".join(x for _, x in held), dtype=np.uint32)
            row = {
                "shard": shard,
                "seq": seq,
                "start": start,
                "n_tokens": len(ids),
                "doc_ids": np.array([k or 0 for k, _ in held], dtype="<i8").tobytes(),
                "doc_null": np.packbits([k is None for k, _ in held]).tobytes(),
                "doc_lengths": np.array([len(x) // 4 for _, x in held], dtype="<i8").tobytes(),
                "codes": encode(ids),
            }
            held, size, seq, start = [], 0, seq + 1, start + len(ids)
            return pa.RecordBatch.from_pylist([row], schema=out_schema)

        out_schema = pa.schema(
            [("shard", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64())]
            + [(c, pa.binary()) for c in ("doc_ids", "doc_null", "doc_lengths", "codes")]
        )
        for batch in batches:
            for s, key, ids in zip(*(batch.column(k) for k in range(3)), strict=True):
                if s.as_py() != shard:
                    if held:
                        yield emit()
                    shard, seq, start = s.as_py(), 0, 0
                held.append((key.as_py(), ids.as_py()))
                size += len(held[-1][1]) // 4
                if size >= segment_tokens:
                    yield emit()
        if held:
            yield emit()

    hashed = F.xxhash64(F.coalesce(text_col, F.lit("")))
    coded = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), hashed.alias("h")).mapInArrow(
        tokens, "shard int, id long, ids binary"
    )
    ordered = coded.repartitionById(n, F.col("shard")).sortWithinPartitions(
        "shard", F.col("id").asc_nulls_first(), "ids"
    )
    # Not compressed: what a block codec packs can't be addressed.
    return common.materialize(ordered.mapInArrow(segments, SEGMENTS), "segments", codec="none")


def read_tokens(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, position, token) for asked (doc_id, position) of stored codes.

    Only segments whose shard and range of ids may hold an asked document are
    joined, and of their codes only the blocks of the asked positions are read.
    A position outside its document gives null; of rows of equal id the first
    stored answers; an id that isn't stored gives null; a repeated question is
    answered as often; a null id or position has no row.
    """
    wanted = asked.where("doc_id IS NOT NULL AND position IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seq, raw, null in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(raw, dtype="<i8")
                known = np.flatnonzero(~np.unpackbits(np.frombuffer(null, dtype=np.uint8))[: len(ids)].astype(bool))
                n = len(known)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[known]), pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(known)],
                    names=["doc_id", "shard", "seq", "row"],
                )

    where = segments.select("shard", "seq", "doc_ids", "doc_null").mapInArrow(documents, "doc_id long, shard int, seq int, row long")
    first = where.groupBy("doc_id").agg(F.min(F.struct("shard", "seq", "row")).alias("at")).select("doc_id", "at.*")
    placed = wanted.join(first, "doc_id", "left")
    questions = placed.where("shard IS NOT NULL").groupBy("shard", "seq", F.pmod(F.xxhash64("doc_id", "position"), F.lit(256)).alias("part")).agg(
        F.collect_list(F.struct("doc_id", "row", "position")).alias("asked")  # salted; a segment's questions are dealt to 256 rows
    )
    whole = common.reread(segments).join(questions, ["shard", "seq"]).select("doc_lengths", "codes", "asked")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths = np.frombuffer(batch.column(0)[k].as_py(), dtype="<i8")
                starts = np.cumsum(lengths) - lengths
                segment = Segment(batch.column(1)[k].as_buffer())
                questions = batch.column(2)[k].as_py()
                found = [segment[int(starts[q["row"]]) + q["position"]] if 0 <= q["position"] < lengths[q["row"]] else None for q in questions]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q[c] for q in questions], pa.int64()) for c in ("doc_id", "position")] + [pa.array(found, pa.int64())],
                    names=["doc_id", "position", "token"],
                )

    answers = whole.mapInArrow(answer, "doc_id long, position long, token long")
    return answers.unionByName(placed.where("shard IS NULL").select("doc_id", "position", F.lit(None).cast("long").alias("token")))


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the codes.

    ``start`` counts all ids of earlier documents over all shards. The totals
    of the shards come to the driver: one number for each range of ids, of
    which there are at most as many as shuffle partitions.
    """
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    base, before = {}, 0
    for row in totals:
        base[row.shard], before = before, before + row.n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row["codes"])
                ids = np.frombuffer(row["doc_ids"], dtype="<i8")
                null = np.unpackbits(np.frombuffer(row["doc_null"], dtype=np.uint8))[: len(ids)]
                lengths = np.frombuffer(row["doc_lengths"], dtype="<i8")
                ends = np.cumsum(lengths)
                sums: list[int] = []
                while len(sums) < len(ends):  # runs of documents, decoded together
                    first = len(sums)
                    low = int(ends[first] - lengths[first])
                    last = max(int(np.searchsorted(ends, low + RUN_TOKENS, side="right")), first + 1)
                    run = memoryview(segment.read(low, int(ends[last - 1])).astype("<u4").tobytes())
                    edges = (4 * (ends[first:last] - low)).tolist()
                    sums += [zlib.crc32(run[a:b]) for a, b in zip([0, *edges[:-1]], edges, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=null.astype(bool)),
                        pa.array(base[row["shard"]] + row["start"] + ends - lengths),
                        pa.array(lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("shard", "seq", "start", "n_tokens", "doc_ids", "doc_null", "doc_lengths", "codes").mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
