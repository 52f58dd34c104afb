"""Byte-level BPE by way of the corpus' distinct words.

Documents are cut into pre-tokens. A block of documents keeps, per document,
the sequence of its words' ranks in the block's word list; the words alone go
through the cluster-wide shuffle, dealt by hash to buckets, where each distinct
one is encoded once for all blocks, and the ids are joined back to (block,
rank). A block then reassembles its documents by position. Decoding looks ids up in the table of token bytes.
"""

from __future__ import annotations

import base64
import hashlib
import secrets
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, units

#: Text bytes after which a block of documents is closed.
BLOCK_BYTES = 32 << 20

_CODERS: dict[str, object] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def coder(path: str, pattern: str):
    """One ``tiktoken`` encoding per worker process and rank file."""
    if path not in _CODERS:
        import tiktoken

        _CODERS[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _CODERS[path]


def varints(values: np.ndarray) -> list[np.ndarray]:
    """Seven bits a byte, lowest first, the k-th bytes of all values together:
    like bytes compress best next to each other."""
    rest, out = values.astype(np.uint32), []
    while not out or len(rest):
        more = rest >= 0x80
        out.append(((rest & 0x7F) | (more.astype(np.uint32) << 7)).astype(np.uint8))
        rest = rest[more] >> np.uint32(7)
    return out


def unvarints(planes: list[np.ndarray]) -> np.ndarray:
    out = (planes[0] & 0x7F).astype(np.int64)
    at = np.flatnonzero(planes[0] & 0x80)
    for k, plane in enumerate(planes[1:], 1):
        out[at] |= (plane & 0x7F).astype(np.int64) << (7 * k)
        at = at[(plane & 0x80) > 0]
    return out


def pack(*parts: np.ndarray | list[np.ndarray] | bytes) -> bytes:
    """Parts behind their lengths, compressed; a list is a part of planes."""
    groups = [p if isinstance(p, list) else [p] for p in parts]
    raw = [x if isinstance(x, bytes) else x.tobytes() for g in groups for x in g]
    head = struct.pack(f"<{len(groups)}B", *map(len, groups)) + struct.pack(f"<{len(raw)}Q", *map(len, raw))
    return zstandard.compress(head + b"".join(raw), 9)


def unpack(packed: bytes, n: int) -> list[list[np.ndarray]]:
    """The planes of each of n parts."""
    raw = zstandard.decompress(packed)
    counts = struct.unpack_from(f"<{n}B", raw)
    sizes = struct.unpack_from(f"<{sum(counts)}Q", raw, n)
    out, at, k = [], n + 8 * sum(counts), 0
    for c in counts:
        out.append([])
        for size in sizes[k : k + c]:
            out[-1].append(np.frombuffer(raw, dtype=np.uint8, count=size, offset=at))
            at += size
        k += c
    return out


class _Block:
    """Documents of one block as word places, and the block's word list."""

    def __init__(self, pattern, buckets: int):
        self.pattern, self.buckets, self.size = pattern, buckets, 0
        self.place: dict[str, int] = {}
        self.pieces: dict[str, np.ndarray] = {}
        self.keys: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def add(self, keys: pa.Array, texts: pa.Array) -> None:
        flat, rows = units.chunks(texts)
        codes, distinct = units.coded(flat)
        place = self.place
        lists = []
        for chunk in distinct:
            known = self.pieces.get(chunk)
            if known is None:
                words = self.pattern.findall(chunk)
                known = np.array([place.setdefault(w, len(place)) for w in words], dtype=np.int64)
                self.pieces[chunk] = known
            lists.append(known)
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        store = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        where, bounds = units.expand(codes, np.cumsum(sizes) - sizes, sizes)
        self.places.append(store[where].astype(np.int32))
        self.counts.append(np.diff(bounds[rows]))
        self.keys += keys.to_pylist()
        self.size += texts.nbytes

    def rows(self) -> Iterator[dict]:
        """Documents (kind 0), and words by bucket (kind 1).

        Places become ranks by frequency, so that common words take one byte.
        """
        block = secrets.randbits(62)
        places, counts = np.concatenate(self.places), np.concatenate(self.counts)
        order = np.argsort(-np.bincount(places, minlength=len(self.place)), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        while at < len(counts):
            upto = min(max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 18), side="right")) - 1), len(counts))
            keys = self.keys[at:upto]
            yield {
                "kind": 0, "block": block, "bucket": 0,
                "data": pack(
                    np.array([k or 0 for k in keys], dtype="<i8"), np.array([k is None for k in keys], dtype=np.uint8),
                    varints(counts[at:upto]), varints(rank[places[ends[at] : ends[upto]]]),
                ),
            }
            at = upto
        words = list(self.place)
        raw = [words[k].encode() for k in order]
        bucket = np.fromiter((zlib.crc32(w) % self.buckets for w in raw), dtype=np.int64, count=len(raw))
        by = np.argsort(bucket, kind="stable")
        for mine in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
            some = [raw[k] for k in mine]
            yield {
                "kind": 1, "block": block, "bucket": int(bucket[mine[0]]),
                "data": pack(varints(np.diff(mine, prepend=0)), varints(np.array([len(w) for w in some])), b"".join(some)),
            }


def word_blocks(docs: DataFrame, pattern: str, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, block, bucket, data): packed documents and packed word lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        schema = pa.schema([("kind", pa.int8()), ("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])

        def emit(block: _Block) -> Iterator[pa.RecordBatch]:
            for row in block.rows():
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        block = _Block(compiled, buckets)
        for batch in batches:
            for at, texts in units.slices(batch.column(1), units.WIDE):
                block.add(batch.column(0).slice(at, len(texts)).cast(pa.int64()), texts)
                if block.size >= BLOCK_BYTES:
                    yield from emit(block)
                    block = _Block(compiled, buckets)
        if block.keys:
            yield from emit(block)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "kind byte, block long, bucket int, data binary"
    )


def encode_words(words: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(block, data): ranks and ids of each block's words.

    Rows come by bucket, and a word is always in the same bucket, so it is
    encoded once however many blocks hold it. What is held is one bucket's
    vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = coder(ranks_path, pattern)._encode_single_piece
        bucket, known = None, {}
        for batch in batches:
            for b, block, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                ranks, sizes, raw = unpack(data, 3)
                ends = np.cumsum(unvarints(sizes))
                text = raw[0].tobytes()
                found = []
                for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    w = text[i:j]
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = single(w)
                    found.append(ids)
                flat = np.array([i for ids in found for i in ids])
                packed = pack(ranks, varints(np.array([len(i) for i in found])), varints(flat))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed], pa.binary())], names=["block", "data"])

    return words.mapInArrow(run, "block long, data binary")


def _decode(ids: np.ndarray, store: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ids laid end to end, and where each id's bytes begin (n + 1)."""
    where, bounds = units.expand(ids.astype(np.int64), starts, sizes)
    return store[where], bounds


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    ``with_ids`` adds ``ids`` and ``decoded`` as binaries. Null text is an
    empty text (no ids); repeated rows stay; an empty table gives no rows.
    """
    n = common.shuffle_partitions(docs.sparkSession)
    blocks = common.materialize(word_blocks(docs, pattern, n, id_col, text_col), "blocks", codec="none")
    words = blocks.where("kind = 1").select("bucket", "block", "data")
    ids = encode_words(words.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket"), ranks_path, pattern)
    sequences = common.reread(blocks).where("kind = 0").select("block", "data")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = [unpack(x, 3) for x in right.column("data").to_pylist()]
        ranks = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unvarints(r)) for r, _, _ in lists)])
        counts = np.concatenate([np.zeros(0, np.int64), *(unvarints(c) for _, c, _ in lists)])
        data = np.concatenate([np.zeros(0, np.int64), *(unvarints(i) for _, _, i in lists)]).astype("<u4")
        starts, sizes = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        starts[ranks], sizes[ranks] = np.cumsum(counts) - counts, counts
        tokens = sorted(read_ranks(ranks_path).items(), key=lambda x: x[1])
        token_sizes = np.zeros(tokens[-1][1] + 1, dtype=np.int64)
        for b, r in tokens:
            token_sizes[r] = len(b)
        token_store = np.frombuffer(b"".join(b for b, _ in tokens), dtype=np.uint8)
        token_starts = np.cumsum(token_sizes) - token_sizes
        rows: dict[str, list] = {c: [] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for packed in left.column("data").to_pylist():
            (keys,), (null,), per_doc, places = unpack(packed, 4)
            keys, per_doc, places = keys.view("<i8"), unvarints(per_doc), unvarints(places)
            where, bounds = units.expand(places, starts, sizes)
            found = data[where]
            doc_bounds = bounds[np.concatenate([[0], np.cumsum(per_doc)])]
            text, token_bounds = _decode(found, token_store, token_starts, token_sizes)
            text_bounds = token_bounds[doc_bounds]
            id_bytes, text_bytes = found.tobytes(), text.tobytes()
            for k in range(len(keys)):
                a, b = int(doc_bounds[k]), int(doc_bounds[k + 1])
                x, y = id_bytes[4 * a : 4 * b], text_bytes[text_bounds[k] : text_bounds[k + 1]]
                rows["n_tokens"].append(b - a)
                rows["ids_sha256"].append(hashlib.sha256(x).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(y).hexdigest())
                if with_ids:
                    rows["ids"].append(x)
                    rows["decoded"].append(y)
            rows["doc_id"] += [None if x else k for k, x in zip(keys.tolist(), null.tolist(), strict=True)]
        return pa.table(
            {
                "doc_id": pa.array(rows["doc_id"], pa.int64()),
                "n_tokens": pa.array(rows["n_tokens"], pa.int64()),
                "ids_sha256": pa.array(rows["ids_sha256"], pa.string()),
                "decoded_sha256": pa.array(rows["decoded_sha256"], pa.string()),
            }
            | ({c: pa.array(rows[c], pa.binary()) for c in ("ids", "decoded")} if with_ids else {})
        )

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return (
        sequences.groupBy("block")
        .cogroup(ids.groupBy("block"))
        .applyInArrow(assemble, kinds + (", ids binary, decoded binary" if with_ids else ""))
    )
