"""Vectorised cutting of Arrow text columns into words and chunks.

Everything works on the UTF-8 buffer of a whole batch with numpy; Python
objects are made only for the distinct strings of a batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32

#: Bytes that surely begin a character no regular-expression flavour calls
#: white space: printable ASCII, and lead bytes other than those under which
#: Unicode keeps its spaces (U+0085, U+00A0, U+1680, U+2000-205F, U+3000).
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!#$%&*,.:;?|")] = True


def text_array(column: pa.Array) -> pa.Array:
    """The column as a null-free 32-bit string array with offset zero."""
    if pa.types.is_large_string(column.type) or not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pa.concat_arrays([column.fill_null("")])


#: Slices for encoders, which look each distinct piece up once a slice.
WIDE = 4 << 20


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) pieces of at most ``limit`` bytes, or of one row."""
    _forget_encoders()
    column = text_array(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, pa.concat_arrays([column.slice(at, end - at)])
        at = end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes uint8) of a null-free string array."""
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=n + 1).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=int(offsets[-1]))
    if offsets[0]:
        data, offsets = data[offsets[0] :], offsets - offsets[0]
    return offsets, data


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """String array of consecutive pieces of ``data``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(
        len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))
    )


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a row's edge.

    Returns starts, ends and, per row, the index of its first run (n + 1).
    """
    n = len(solid)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """White-space separated words of every row, and each row's first word."""
    offsets, data = buffers(texts)
    solid = ~SPACES[data]
    starts, ends, rows = runs(solid, offsets)
    kept = data[solid]
    return strings(ASCII_LOWER[kept] if lower else kept, ends - starts), rows


def chunks(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Rows cut where no pre-token of the byte-level patterns can cross: before
    a space or newline that a surely solid character follows, and between a
    letter (ASCII, or U+00C0-00FF but for the two signs there) and a mark. ``lower`` puts A-Z
    in lower case, unless a combining mark stands anywhere: with one, a capital
    and its small letter may compose differently."""
    offsets, data = buffers(texts)
    if lower and not ((data == 0xCC) | (data == 0xCD)).any():
        data = ASCII_LOWER[data]
    n = len(data)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(offsets), dtype=np.int64)
    cut = np.zeros(n, dtype=bool)
    cut[:-1] = ((data[:-1] == 0x20) | (data[:-1] == 0x0A)) & _SOLID[data[1:]]
    if n > 1:
        letter = _LETTER[data]
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[1:] |= latin
        cut[1:] |= letter[:-1] & _MARK[data[1:]]
    tails = offsets[1:-1][offsets[1:-1] > 0] - 1
    cut[tails] &= ~((data[tails] == 0x20) | (data[tails] == 0x0A))
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, n))
    return strings(data, lengths), np.searchsorted(starts, offsets)


def coded(units: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of the units and the distinct units in code order."""
    d = units.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def expand(
    codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in a flat store, of the items that a sequence of codes names.

    Returns the positions and, per code, the first of its items (n + 1).
    """
    size = lengths[codes]
    bounds = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(size, out=bounds[1:])
    where = np.repeat(starts[codes] - bounds[:-1], size)
    where += np.arange(bounds[-1], dtype=np.int64)
    return where, bounds


class UnitEncoder:
    """Token ids of strings, each distinct string encoded once while cached.

    ``encode`` maps a list of strings to a list of id lists. The cache is a
    speed-up with a byte bound: beyond it the cache starts afresh.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 128 << 20, lower: bool = False):
        self.encode, self.limit, self.lower = encode, limit, lower
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, missing: list[str]) -> None:
        ids, ends = [self.ids], [self.ends]
        total = int(self.ends[-1])
        for at in range(0, len(missing), 4096):
            found = self.encode(missing[at : at + 4096])
            size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ids.append(np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(size.sum())))
            ends.append(total + np.cumsum(size))
            total += int(size.sum())
        first = len(self.known)
        self.known.update(zip(missing, range(first, first + len(missing)), strict=True))
        self.ids, self.ends = np.concatenate(ids), np.concatenate(ends)
        self.held = 4 * total + 140 * len(self.known)

    def lookup(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids laid end to end, first id and number of ids of each string)."""
        if self.held > self.limit:
            self._clear()
        missing = [w for w in distinct if w not in self.known]
        if missing:
            self._learn(missing)
        at = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        return self.ids, self.ends[at], self.ends[at + 1] - self.ends[at]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows laid end to end, first id of each row, n + 1)."""
        units, rows = chunks(texts, self.lower)
        codes, distinct = coded(units)
        store, starts, sizes = self.lookup(distinct)
        where, bounds = expand(codes, starts, sizes)
        return store[where], bounds[rows]


_ENCODERS: dict[str, UnitEncoder] = {}
_STAGE: list[int] = []


def _stage() -> int:
    task = TaskContext.get()
    return task.stageId() if task else -1


def _forget_encoders() -> None:
    """Drop the encoders of another stage, whose caches this process would hold
    for as long as it is used again."""
    if _ENCODERS and _STAGE != [_stage()]:
        _ENCODERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


_PLAIN = re.compile(r"[\n\x20-\x40\x5B-\x7E]*")


def library_encoder(path: str) -> UnitEncoder:
    """One encoder per worker process over a ``tokenizers`` file.

    Strings of special tokens inside a text are ordinary text. Where the file
    composes, lower-cases and squeezes white space first, that does nothing to
    small ASCII letters, marks and single spaces: such pieces skip the step.
    """
    _forget_encoders()
    _STAGE[:] = [_stage()]
    if path not in _ENCODERS:
        # A task has one core: the library's own threads would only spin on the others.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        steps = (described.get("normalizer") or {}).get("normalizers", [])
        lower = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        plain = whole
        if lower:
            plain = Tokenizer.from_str(json.dumps(described | {"normalizer": None}))
            plain.encode_special_tokens = True

        def run(tokenizer: Tokenizer, batch: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

        def encode(batch: list[str]) -> list[list[int]]:
            if plain is whole:
                return run(whole, batch)
            hard = [k for k, w in enumerate(batch) if not _PLAIN.fullmatch(w)]
            skip = set(hard)
            found: list = [None] * len(batch)
            for tokenizer, some in ((whole, hard), (plain, [k for k in range(len(batch)) if k not in skip])):
                for k, ids in zip(some, run(tokenizer, [batch[k] for k in some]), strict=True):
                    found[k] = ids
            return found

        _ENCODERS[path] = UnitEncoder(encode, lower=lower)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to every row's ids."""
    n = len(bounds) - 1
    out = np.insert(ids, bounds[1:], np.uint32(end)) if n else ids
    return out, bounds + np.arange(n + 1, dtype=np.int64)


def filter_rows(docs, keep: Callable[[pa.Array], np.ndarray], text_col: str = "text"):
    """Rows whose text ``keep`` accepts, all columns unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
