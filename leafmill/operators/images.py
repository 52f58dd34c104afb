"""Page images in PNG: read, put upright, cut, written again, and searched for
the sheet of paper on them.

Images are numpy arrays inside a task, (height, width) of grey or (height,
width, 3) of colour; those that are alike are read, turned and written together,
some megabytes at a time. JPEG needs a codec that isn't here and is
reported.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.geometry import ORIENTATIONS
from leafmill.operators.spread import by_key, spread

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Channels by colour type, and the seven interlaced passes as
# (first row, first column, row step, column step).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


class ImageError(ValueError):
    """Why an image can't be taken, as an error code."""


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of a PNG's chunks, with their checksums tested."""
    at = len(SIGNATURE)
    while at + 12 <= len(raw):
        (size,), kind = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
        data = raw[at + 8 : at + 8 + size]
        if len(data) < size or raw[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ImageError("invalid_image")
        yield kind, data
        at += 12 + size
        if kind == b"IEND":
            return
    raise ImageError("invalid_image")


def orientation(exif: bytes) -> int:
    """The orientation mark of an Exif block, 1 without one."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None or len(exif) < 8:
        return 1
    (at,) = struct.unpack_from(order + "I", exif, 4)
    if at + 2 > len(exif):
        return 1
    (n,) = struct.unpack_from(order + "H", exif, at)
    for k in range(min(n, (len(exif) - at - 2) // 12)):
        tag, _, _, value = struct.unpack_from(order + "HHIH", exif, at + 2 + 12 * k)
        if tag == 0x0112:
            return value if value in ORIENTATIONS else 1
    return 1


def changes(rows: np.ndarray) -> np.ndarray:
    """Which rows (height, bytes; perhaps with axes before) aren't the same as
    the row above; an image's first row counts as one."""
    new = np.ones(rows.shape[:-1], dtype=bool)
    np.any(rows[..., 1:, :] != rows[..., :-1, :], axis=-1, out=new[..., 1:])
    return new


def unfilter(lines: np.ndarray, pixel: int) -> np.ndarray:
    """Bytes of scanlines (each with its filter's number first) without filters.

    ``lines``: of one image, (height, bytes), or of several alike, with a first
    axis for them. Rows that look only left or only up are done whole, and rows
    that add nothing to the one above are copies of it. Where a row needs both
    neighbours, all pixels of a diagonal are done at once: what they lean on lies
    on the two diagonals before.
    """
    if lines.ndim == 2:
        return unfilter(lines[None], pixel)[0]
    kinds, data = lines[..., 0], lines[..., 1:]
    if kinds.size and kinds.max() > 4:
        raise ImageError("invalid_image")
    n, h, stride = data.shape
    w = stride // pixel
    cells = data[..., : w * pixel].reshape(n, h, w, pixel)
    if not kinds.size or kinds.max() <= 2:
        new = (kinds != 2) | (data.max(axis=2, initial=0) > 0)
        new[:, :1] = True
        image, y = np.nonzero(new)
        rows, kind = cells[image, y], kinds[image, y]
        left = kind == 1
        rows[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
        # The row before one of the same image is what stands above it.
        up = np.flatnonzero((kind == 2) & (y > 0))
        up = up[np.argsort(y[up], kind="stable")]
        for at in np.split(up, np.flatnonzero(np.diff(y[up])) + 1) if len(up) else ():
            rows[at] += rows[at - 1]
        return rows[np.cumsum(new) - 1].reshape(n, h, w * pixel)
    out = np.zeros((n, h + 1, w + 1, pixel), dtype=np.int16)
    for d in range(w + h - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner, kind = out[:, y + 1, x], out[:, y, x + 1], out[:, y, x], kinds[:, y][..., None]
        guess = left + up - corner
        by = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        nearest = np.where((by[0] <= by[1]) & (by[0] <= by[2]), left, np.where(by[1] <= by[2], up, corner))
        predicted = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[:, y + 1, x + 1] = (cells[:, y, x] + predicted) & 255
    return out[:, 1:, 1:].astype(np.uint8).reshape(n, h, w * pixel)


def samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(height, width, channels) of 8 bits, or of fewer as they are; of 16-bit
    samples the high byte."""
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    packed = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return packed[:, :width, None].astype(np.uint8)


def _passes(width: int, height: int, depth: int, colour: int, interlaced: int) -> list[tuple[tuple[int, int, int, int], int, int, int]]:
    """(pass, rows, columns, bytes of a row) of an image's passes that aren't empty."""
    sizes = [((a, b, c, d), -(-(height - a) // c), -(-(width - b) // d)) for a, b, c, d in (PASSES if interlaced else ((0, 0, 1, 1),))]
    return [(p, h, w, (w * CHANNELS[colour] * depth + 7) // 8) for p, h, w in sizes if h > 0 and w > 0]


def opened(raw: bytes, max_pixels: int) -> tuple[tuple[int, int, int, int, int], bytes | None, int, bytes]:
    """((width, height, depth, colour type, interlaced), palette, orientation
    mark, filtered scanlines) of a PNG."""
    if raw[:3] == b"\xff\xd8\xff":
        raise ImageError("image_codec_missing")
    if not raw.startswith(SIGNATURE):
        raise ImageError("unsupported_image")
    header, palette, exif, body = None, None, b"", []
    for kind, data in chunks(raw):
        if kind == b"IHDR" and len(data) == 13:
            header = struct.unpack(">IIBBBBB", data)
            if header[0] * header[1] > max_pixels:
                raise ImageError("image_too_large")
        elif kind == b"PLTE":
            palette = data[: len(data) // 3 * 3]
        elif kind == b"eXIf":
            exif = data
        elif kind == b"IDAT":
            body.append(data)
    if header is None:
        raise ImageError("invalid_image")
    width, height, depth, colour, method, filters, interlaced = header
    if not width or not height or depth not in DEPTHS.get(colour, ()) or method or filters or interlaced > 1 or (colour == 3 and palette is None):
        raise ImageError("invalid_image")
    kind = (width, height, depth, colour, interlaced)
    total = sum(h * (stride + 1) for _, h, _, stride in _passes(*kind))
    try:
        flat = zlib.decompressobj().decompress(b"".join(body), total)
    except zlib.error:
        raise ImageError("invalid_image") from None
    if len(flat) < total:
        raise ImageError("invalid_image")
    return kind, palette if colour == 3 else None, orientation(exif) if exif else 1, flat


def _stack(kind: tuple[int, int, int, int, int], palette: bytes | None, flats: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(which are valid, the pixels of those) of images of one kind, all at once."""
    width, height, depth, colour, _ = kind
    channels, n = CHANNELS[colour], len(flats)
    flat, passes, valid, at = np.frombuffer(b"".join(flats), dtype=np.uint8).reshape(n, -1), [], np.ones(n, dtype=bool), 0
    for step, h, w, stride in _passes(*kind):
        lines = flat[:, at : at + h * (stride + 1)].reshape(n, h, stride + 1)
        valid &= (lines[..., 0] <= 4).all(axis=1)
        passes.append((step, h, w, lines))
        at += h * (stride + 1)
    good = int(valid.sum())
    out = np.empty((good, height, width, channels), dtype=np.uint8)
    if not good:
        return valid, out
    for (a, b, c, d), h, w, lines in passes:
        rows = unfilter(lines if good == n else lines[valid], max(1, channels * depth // 8))
        part = samples(rows.reshape(good * h, -1), w, channels, depth).reshape(good, h, w, channels)
        if len(passes) == 1:
            out = part
        else:
            out[:, a::c, b::d] = part
    if palette is not None:
        colours = np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)
        known = out.reshape(len(out), -1).max(axis=1, initial=0) < len(colours)
        valid[valid] = known
        return valid, colours[out[known][..., 0]]
    if colour == 0 and depth < 8:
        out = out * np.uint8(255 // ((1 << depth) - 1))
    if channels < 3:
        grey = out[..., 0]
        return valid, np.repeat(grey[..., None], 3, axis=3) if colour == 4 or depth == 1 else grey
    return valid, out[..., :3]


def decode_all(files: list[bytes], max_pixels: int = 10_000_000) -> tuple[list[tuple[list[int], np.ndarray]], list[int], dict[int, str]]:
    """Images of one kind at once: (their places in ``files``, (image, height,
    width) of grey or with an axis of colour) for each kind, the orientation
    marks of all files, and the error codes of those that can't be read."""
    alike, marks, errors, stacks = {}, [1] * len(files), {}, []
    for k, raw in enumerate(files):
        try:
            kind, palette, marks[k], flat = opened(raw, max_pixels)
            alike.setdefault((kind, palette), []).append((k, flat))
        except ImageError as why:
            errors[k] = str(why)
    for (kind, palette), found in alike.items():
        valid, pixels = _stack(kind, palette, [flat for _, flat in found])
        stacks.append(([k for (k, _), good in zip(found, valid, strict=True) if good], pixels))
        errors |= {k: "invalid_image" for (k, _), good in zip(found, valid, strict=True) if not good}
    return stacks, marks, errors


def decode(raw: bytes, max_pixels: int = 10_000_000) -> tuple[np.ndarray, int]:
    """(pixels, orientation mark) of a PNG: grey stays grey, all else is colour
    without transparency."""
    stacks, marks, errors = decode_all([raw], max_pixels)
    if errors:
        raise ImageError(errors[0])
    return stacks[0][1][0], marks[0]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_all(stack: np.ndarray, marks: list[int] | None = None, level: int = 6) -> list[bytes]:
    """PNGs of images of one size, 8-bit grey or colour; each row takes that of
    three filters (as it is, less the pixel left, less the one above) whose
    bytes are smallest. ``level``: zlib's, 1 the fastest."""
    n, h, w = stack.shape[:3]
    cells = np.ascontiguousarray(stack, dtype=np.uint8).reshape(n, h, w, -1)
    # Only rows that differ from the one above need a trial; less that row, the
    # others are zeros.
    new = changes(cells.reshape(n, h, -1))
    image, y = np.nonzero(new)
    own = cells[image, y]
    left, up, below = np.zeros_like(own), np.zeros_like(own), y > 0
    left[:, 1:], up[below] = own[:, :-1], cells[image[below], y[below] - 1]
    tried = np.stack([own, own - left, own - up]).reshape(3, len(own), -1)
    best = np.minimum(tried, -tried).sum(axis=2, dtype=np.int32).argmin(axis=0)
    lines = np.zeros((n, h, 1 + tried.shape[2]), dtype=np.uint8)
    lines[..., 0] = np.where(tried[0].any(axis=1), 2, 0)[np.cumsum(new).reshape(n, h) - 1]
    lines[image, y, 0], lines[image, y, 1:] = best, tried[best, np.arange(len(own))]
    lines = lines.reshape(n, -1)
    front = SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if cells.shape[3] == 3 else 0, 0, 0, 0))
    heads = {m: front + _chunk(b"eXIf", struct.pack("<2sHIHHHIHH", b"II", 42, 8, 1, 0x0112, 3, 1, m, 0)) for m in set(marks or ())} | {1: front}
    end = _chunk(b"IEND", b"")
    return [heads[m] + _chunk(b"IDAT", zlib.compress(lines[k], level)) + end for k, m in enumerate(marks or [1] * n)]


def encode(pixels: np.ndarray, mark: int = 1, level: int = 6) -> bytes:
    """A PNG of one image."""
    return encode_all(pixels[None], [mark], level)[0]


def upright_all(stack: np.ndarray, mark: int, degrees: int) -> np.ndarray:
    """Mirrored and turned as the mark asks, then turned clockwise."""
    mirror, quarters = ORIENTATIONS[mark]
    return np.rot90(stack[:, :, ::-1] if mirror else stack, -(quarters + degrees // 90), axes=(1, 2))


def upright(pixels: np.ndarray, mark: int, degrees: int) -> np.ndarray:
    return upright_all(pixels[None], mark, degrees)[0]


def cut_all(stack: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part inside a box given in shares of width and height, never empty."""
    left, top, right, bottom = box
    if not (0 <= left < right <= 1 and 0 <= top < bottom <= 1):
        raise ImageError("invalid_crop")
    h, w = stack.shape[1:3]
    x, y = min(int(w * left), w - 1), min(int(h * top), h - 1)
    return stack[:, y : min(h, max(y + 1, int(h * bottom))), x : min(w, max(x + 1, int(w * right)))]


def cut(pixels: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    return cut_all(pixels[None], box)[0]


def _each(rows: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[list[tuple]]]) -> DataFrame:
    """All columns of ``rows`` and those of ``schema``, which ``work`` yields for
    the rows of a batch, some at a time in their order; some megabytes leave at
    once."""
    names = [*rows.columns, *(part.split()[0] for part in schema.split(", "))]
    types = {"binary": pa.binary(), "int": pa.int32(), "string": pa.string()}
    made = [types[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, out, held = 0, [], 0
            for some in work(batch):
                out += some
                held += sum(len(v) for row in some for v in row if isinstance(v, bytes))
                if held > 8 << 20 or first + len(out) == batch.num_rows:
                    same = batch.slice(first, len(out))
                    new = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), made, strict=True)]
                    yield pa.RecordBatch.from_arrays([*same.columns, *new], names=names)
                    first, out, held = first + len(out), [], 0

    return rows.mapInArrow(run, ", ".join([*_kinds(rows, rows.columns), schema]))


# Fixed value: about how many pixels are worked on at once.
TOGETHER = 4 << 20


def _slices(batch: pa.RecordBatch, content: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch and their files, so many that their pixels stay few; the
    sizes are those that the files' first chunks claim."""
    files, first, held = [], 0, 0
    column = batch.column(content)
    for row in range(batch.num_rows):
        raw = column[row].as_py() or b""
        files.append(raw)
        width, height = struct.unpack_from(">II", raw, 16) if len(raw) >= 24 else (0, 0)
        held += min(width * height, TOGETHER) + len(raw)
        if held > TOGETHER or row == batch.num_rows - 1:
            yield batch.slice(first, row + 1 - first), files
            files, first, held = [], row + 1, 0


def _kinds(rows: DataFrame, columns: list[str]) -> list[str]:
    return [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns]


CROP = ("crop_left", "crop_top", "crop_right", "crop_bottom")


def normalize(files: DataFrame, max_pixels: int = 10_000_000) -> DataFrame:
    """``files`` with ``png``, ``png_width``, ``png_height`` and ``error_code``.

    ``files``: content (bytes of an image), rotation (degrees clockwise) and
    crop_left, crop_top, crop_right, crop_bottom (shares; null: whole). Images
    are put upright by their own mark, turned, cut, and written as PNG. A row
    that can't be done has nulls and a code: unsupported_image, invalid_image,
    image_too_large, invalid_rotation, invalid_crop, or image_codec_missing for
    JPEG. Null content is no image. Images that are alike are done at once.
    """
    names = [*files.columns, "png", "png_width", "png_height", "error_code"]

    def work(contents: list[bytes], rotations: list[int | None], boxes: list[tuple[float | None, ...]]) -> list[tuple]:
        out: list[tuple] = [(None, None, None, "invalid_rotation")] * len(contents)
        stacks, marks, errors = decode_all(contents, max_pixels)
        errors = {k: e for k, e in errors.items() if (rotations[k] or 0) in (0, 90, 180, 270)}
        done: dict[tuple[int, ...], list[tuple[list[int], np.ndarray]]] = {}
        for places, stack in stacks:
            alike: dict[tuple, list[int]] = {}
            for at, k in enumerate(places):
                if (rotations[k] or 0) in (0, 90, 180, 270):
                    alike.setdefault((marks[k], rotations[k] or 0, boxes[k]), []).append(at)
            for (mark, degrees, box), ats in alike.items():
                turned, mine = upright_all(stack[ats], mark, degrees), [places[at] for at in ats]
                try:
                    if any(v is not None for v in box):
                        if any(v is None for v in box):
                            raise ImageError("invalid_crop")
                        turned = cut_all(turned, tuple(map(float, box)))
                    done.setdefault(turned.shape[1:], []).append((mine, turned))
                except ImageError as why:
                    errors |= dict.fromkeys(mine, str(why))
        for shape, parts in done.items():
            made = encode_all(np.concatenate([stack for _, stack in parts]))
            for k, png in zip((k for places, _ in parts for k in places), made, strict=True):
                out[k] = (png, shape[1], shape[0], None)
        for k, why in errors.items():
            out[k] = (None, None, None, why)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, contents in _slices(batch, "content"):
                boxes = list(zip(*(part.column(c).to_pylist() for c in CROP), strict=True))
                made = zip(*work(contents, part.column("rotation").to_pylist(), boxes), strict=True)
                new = [pa.array(list(c), t) for c, t in zip(made, (pa.binary(), pa.int32(), pa.int32(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    schema = [*_kinds(files, files.columns), "png binary", "png_width int", "png_height int", "error_code string"]
    return files.mapInArrow(run, ", ".join(schema))


def draw(pixels: DataFrame, sizes: DataFrame | None, key: list[str]) -> DataFrame:
    """(key, content): grey PNGs of pixels (key, x, y, n), 0 where none is
    given. ``sizes``: key, width, height, orientation (a mark that is written
    into the file, perhaps null), one row an image; None: the pixels have these
    columns themselves.

    Rows are dealt and sorted by image, and the images that end in a batch are
    drawn and written at once.
    """
    joined = pixels if sizes is None else sizes.join(pixels, key, "left")
    numbers = ("width", "height", "orientation", "x", "y", "n")
    given = joined.select(*key, *[F.col(c).cast("int").alias(f"lm_{c}") for c in numbers])

    def drawn(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = {c: rows.column(f"lm_{c}").take(pa.array(starts)).to_numpy(zero_copy_only=False) for c in ("width", "height")}
        marks = [m if m in ORIENTATIONS else 1 for m in rows.column("lm_orientation").take(pa.array(starts)).to_pylist()]
        there = np.logical_and.reduce([rows.column(f"lm_{c}").is_valid().to_numpy(zero_copy_only=False) for c in "xyn"])
        image = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))[there]
        x, y, n = (rows.column(f"lm_{c}").filter(pa.array(there)).to_numpy(zero_copy_only=False) for c in "xyn")
        for w, h in np.unique(np.stack([size["width"], size["height"]], axis=1), axis=0).tolist():
            alike = np.flatnonzero((size["width"] == w) & (size["height"] == h))
            step = max(1, TOGETHER // max(1, w * h))
            for first in range(0, len(alike), step):
                mine = alike[first : first + step]
                at = np.full(len(starts), -1)
                at[mine] = np.arange(len(mine))
                here = at[image] >= 0
                stack = np.zeros((len(mine), h, w), dtype=np.uint8)
                stack[at[image[here]], y[here], x[here]] = n[here].astype(np.uint8)
                files = encode_all(stack, [marks[k] for k in mine])
                keys = [rows.column(c).take(pa.array(starts[mine])) for c in key]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(files, pa.binary())], names=[*key, "content"])

    def name(batch: pa.RecordBatch, row: int) -> list:
        return [batch.column(c)[row].as_py() for c in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows from the first of an image that hasn't ended
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = not held or name(held[-1], held[-1].num_rows - 1) != name(batch, 0)
            for c in key:
                coded = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= coded[1:] != coded[:-1]
            starts = np.flatnonzero(new)
            if not len(starts):
                held.append(batch)
                continue
            before, last = sum(b.num_rows for b in held), int(starts[-1])
            ended = np.append([0] if held else [], starts[:-1] + before).astype(np.int64)
            if len(ended):
                yield from drawn(pa.concat_batches([*held, batch.slice(0, last)]), ended)
            held = [batch.slice(last)]
        if held:
            yield from drawn(pa.concat_batches(held), np.zeros(1, dtype=np.int64))

    dealt = by_key(given, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, ", ".join([*_kinds(given, key), "content binary"]))


def draw_sheets(rows: DataFrame) -> DataFrame:
    """``rows`` with ``content``: a PNG of w by h dark pixels with a white sheet
    from (x0, y0) up to (x1, y1). A task sorts its rows by size and writes those
    of one size together."""

    def work(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        sheets = zip(*(batch.column(c).to_pylist() for c in ("w", "h", "x0", "y0", "x1", "y1")), strict=True)
        for (w, h), alike in itertools.groupby(sheets, key=lambda sheet: sheet[:2]):
            dark = np.full((w, 3), (60, 40, 30), dtype=np.uint8)
            while some := list(itertools.islice(alike, max(1, TOGETHER // max(1, w * h)))):
                stack = np.empty((len(some), h, w, 3), dtype=np.uint8)
                stack[:] = dark
                for image, (_, _, x0, y0, x1, y1) in zip(stack, some, strict=True):
                    image[y0:y1, x0:x1] = 245
                yield [(png,) for png in encode_all(stack, level=1)]

    return _each(spread(rows).sortWithinPartitions("w", "h"), "content binary", work)


def read_pixels(files: DataFrame, content: str = "content", least: int = 0) -> DataFrame:
    """(the other columns, x, y, n) of grey PNGs, and of colour ones their
    largest channel, where n is ``least`` or more; files that aren't an image
    have no rows."""
    rest = [c for c in files.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, contents in _slices(batch, content):
                kept = part.select(rest)
                for places, stack in decode_all(contents)[0]:
                    grey = stack if stack.ndim == 3 else stack.max(axis=3)
                    at, y, x = np.nonzero(grey >= least)
                    n, places = grey[at, y, x], np.array(places, dtype=np.int64)
                    for first in range(0, len(at), 1 << 18):
                        some = slice(first, first + (1 << 18))
                        same = kept.take(pa.array(places[at[some]])).columns if rest else []
                        new = [pa.array(v[some].astype(np.int32)) for v in (x, y, n)]
                        yield pa.RecordBatch.from_arrays([*same, *new], names=[*rest, "x", "y", "n"])

    return files.mapInArrow(run, ", ".join([*_kinds(files, rest), "x int", "y int", "n int"]))


# The longest side that is searched, what counts as paper, how
# much of a row or column must be, margins and least shares of the result.
SCAN_SIDE, MIN_VALUE, MAX_SATURATION, COVERAGE = 512, 160, 65, 0.30
MARGIN, MIN_AXIS, MIN_AREA, WHOLE = 0.04, 0.35, 0.40, 0.98


def shrink(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampled to a smaller size, each pixel a mean weighted by a triangle as
    wide as two pixels of the result."""

    def along(image: np.ndarray, size: int) -> np.ndarray:
        n = image.shape[0]
        if size == n:
            return image
        scale = n / size
        centre = (np.arange(size) + 0.5) * scale
        weight = np.maximum(0, 1 - np.abs((np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale))
        weight /= weight.sum(axis=1, keepdims=True)
        mean = np.tensordot(weight, image.astype(np.float64), axes=1)
        return np.clip(np.floor(mean + 0.5), 0, 255).astype(np.uint8)

    return along(along(pixels.swapaxes(0, 1), width).swapaxes(0, 1), height)


def longest_dense(counts: np.ndarray, threshold: float, least: float) -> tuple[int, int] | None:
    """First and last place of the longest run above a threshold; of equals the first."""
    found = re.finditer(rb"\x01+", (counts > threshold).tobytes())
    runs = [(m.start(), m.end() - 1) for m in found if m.end() - m.start() >= least]
    return max(runs, key=lambda r: (r[1] - r[0], -r[0]), default=None)


def paper_boxes(stack: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) of the paper on photographs of one size, the
    whole image where none stands out: bright, pale pixels, projected on both
    axes of a smaller copy, the longest dense stretch of each scaled back and
    widened."""
    n, h, w = stack.shape[:3]
    if w < 100 or h < 100:
        return [(0, 0, w, h)] * n
    scale = min(1.0, SCAN_SIDE / max(w, h))
    colour = np.repeat(stack[..., None], 3, axis=3) if stack.ndim == 3 else stack
    columns, rows = max(1, round(w * scale)), max(1, round(h * scale))
    scan = colour if (columns, rows) == (w, h) else np.stack([shrink(c, columns, rows) for c in colour])
    # A row that is the same as the one above counts as often, but is looked at once.
    new = changes(scan.reshape(n, rows, -1))
    red, green, blue = np.moveaxis(scan[new], 2, 0)
    value = np.maximum(np.maximum(red, green), blue).astype(np.uint16)
    low = np.minimum(np.minimum(red, green), blue).astype(np.uint16)
    saturation = np.where(value > 0, 255 * (value - low) // np.maximum(value, 1), 0)
    paper = (value >= MIN_VALUE) & (saturation <= MAX_SATURATION)
    times = np.diff(np.append(np.flatnonzero(new), n * rows)).astype(np.int32)
    first = np.append(0, np.cumsum(new.sum(axis=1))[:-1])
    down = np.add.reduceat(paper * times[:, None], first, axis=0)
    along = np.repeat(paper.sum(axis=1), times).reshape(n, rows)

    def box(x: tuple[int, int] | None, y: tuple[int, int] | None) -> tuple[int, int, int, int]:
        if x is None or y is None:
            return 0, 0, w, h
        left, right = max(0, int(x[0] / scale) - round(w * MARGIN)), min(w, int((x[1] + 1) / scale) + round(w * MARGIN))
        top, bottom = max(0, int(y[0] / scale) - round(h * MARGIN)), min(h, int((y[1] + 1) / scale) + round(h * MARGIN))
        wide, high = right - left, bottom - top
        if wide * high < w * h * MIN_AREA or (wide >= w * WHOLE and high >= h * WHOLE):
            return 0, 0, w, h
        return left, top, right, bottom

    return [
        box(longest_dense(x, rows * COVERAGE, columns * MIN_AXIS), longest_dense(y, columns * COVERAGE, rows * MIN_AXIS)) for x, y in zip(down, along, strict=True)
    ]


def paper_box(pixels: np.ndarray) -> tuple[int, int, int, int]:
    """The paper on one photograph."""
    return paper_boxes(pixels[None])[0]


def detect_paper(files: DataFrame) -> DataFrame:
    """``files`` (content) with paper_left, paper_top, paper_right and
    paper_bottom in pixels, null where the content is no image, and error_code.
    Images that are alike are searched at once."""

    def work(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        for part, contents in _slices(batch, "content"):
            stacks, _, errors = decode_all(contents)
            out = [(None, None, None, None, errors.get(k)) for k in range(part.num_rows)]
            for places, stack in stacks:
                for k, box in zip(places, paper_boxes(stack) if places else [], strict=True):
                    out[k] = (*box, None)
            yield out

    return _each(files, "paper_left int, paper_top int, paper_right int, paper_bottom int, error_code string", work)
