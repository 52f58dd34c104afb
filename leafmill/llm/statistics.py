"""Per-document statistics of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from leafmill.llm import units

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x80:0x100] = 1  # outside ASCII
_CLASS[0x61:0x7B] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x30:0x3A] = 4
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 5
_CLASS[0x0A] = 6
for _c in b".,;:!?'\"()-":
    _CLASS[_c] = 7
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    if not _CLASS[_c]:
        _CLASS[_c] = 8
_CLASSES = 9

NAMES = (
    "log_bytes", "log_words", "log_lines", "beyond_ascii", "lower", "upper", "digit", "newline",
    "punctuation", "symbol", "control", "exclamation", "word_length", "word_length_spread",
    "distinct_words", "top_word", "repeated_neighbour", "upper_words", "marked_words", "long_words",
    "stops_per_word", "distinct_lines",
)


def _per_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over rows given by first positions (n + 1)."""
    out = np.zeros(len(rows) - 1)
    full = rows[1:] > rows[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, rows[:-1][full], dtype=np.float64)
    return out


def _per_span(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over non-empty spans in order; they may touch."""
    bounds = np.stack([starts, ends], axis=1).ravel()
    return np.add.reduceat(np.append(values, values.dtype.type(0)), bounds, dtype=np.int64)[::2]


def _runs_of_row(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and the count of the commonest one, in each row."""
    n = len(rows) - 1
    owner = np.repeat(np.arange(n), np.diff(rows))
    keys = np.sort(owner * (int(codes.max(initial=0)) + 1) + codes)
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    who = keys[first] // (int(codes.max(initial=0)) + 1)
    top = np.zeros(n)
    np.maximum.at(top, who, counts)
    return np.bincount(who, minlength=n).astype(np.float64), top


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text; an empty text has zeros throughout."""
    offsets, data = units.buffers(texts)
    n = len(texts)
    size = np.diff(offsets).astype(np.float64)
    kinds = _CLASS[data]
    counts = np.stack(
        [_per_row(kinds == k, offsets) for k in range(_CLASSES)] if len(data) else np.zeros((_CLASSES, n))
    )
    safe = np.maximum(size, 1)
    solid = ~units.SPACES[data]
    starts, ends, rows = units.runs(solid, offsets)
    lengths = (ends - starts).astype(np.float64)
    n_words = np.diff(rows).astype(np.float64)
    some = np.maximum(n_words, 1)
    codes = units.coded(units.strings(data[solid], ends - starts))[0] if len(starts) else np.zeros(0, np.int64)
    distinct, top = _runs_of_row(codes, rows)
    same = np.zeros(len(codes))
    same[1:] = codes[1:] == codes[:-1]
    same[rows[:-1][n_words > 0]] = 0
    mean = _per_row(lengths, rows) / some
    spread = np.sqrt(np.maximum(_per_row(lengths**2, rows) / some - mean**2, 0))
    if len(starts):
        last = data[ends - 1]
        marked = _CLASS[last] == 8
        odd = np.isin(last, np.frombuffer(b"!&%$#*|", dtype=np.uint8))
        stop = np.isin(last, np.frombuffer(b".?", dtype=np.uint8))
        upper = (_per_span(kinds == 3, starts, ends) > 0) & (_per_span(kinds == 2, starts, ends) == 0)
    else:
        marked = odd = stop = upper = np.zeros(0, dtype=bool)
    line_starts, line_ends, line_rows = units.runs(data != 0x0A, offsets)
    line_codes = (
        units.coded(units.strings(data[data != 0x0A], line_ends - line_starts))[0]
        if len(line_starts)
        else np.zeros(0, np.int64)
    )
    n_lines = np.diff(line_rows).astype(np.float64)
    distinct_lines, _ = _runs_of_row(line_codes, line_rows)
    return np.stack(
        [
            np.log1p(size), np.log1p(n_words), np.log1p(n_lines),
            *(counts[k] / safe for k in (1, 2, 3, 4, 6, 7, 8, 0)),
            _per_row(data == 0x21, offsets) / safe if len(data) else np.zeros(n),
            mean, spread, distinct / some, top / some, _per_row(same, rows) / some,
            _per_row(upper, rows) / some, _per_row(odd | marked, rows) / some,
            _per_row(lengths > 20, rows) / some, _per_row(stop, rows) / some,
            np.where(n_lines > 0, distinct_lines / np.maximum(n_lines, 1), 0),
        ],
        axis=1,
    )
