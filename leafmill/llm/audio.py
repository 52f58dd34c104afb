"""Telephony audio columns.

G.711 mu-law and A-law codes are expanded through 256-entry tables built from
the companding rule; IMA ADPCM blocks are decoded sample by sample for all
blocks of a batch at once, since blocks don't depend on each other. Decoded
audio is resampled to a common rate and stored as 16-bit PCM.

Media are RIFF/WAVE: format 7 (mu-law), 6 (A-law), 17 (IMA ADPCM, mono), 1.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, units

FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}
RATE, TARGET = 8_000, 16_000
#: Bytes of one ADPCM block: 4 of header, two samples in each other byte.
ADPCM_BLOCK = 36


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted sign, exponent, mantissa; bias 33 at 14 bits."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 1) + 33) << ((code >> 4) & 7)) - 33
    return np.where(code & 0x80, -size, size).astype(np.int32).astype(np.int16) * np.int16(4)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; linear below exponent 1; 13 bits."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 0x0F
    size = np.where(exponent == 0, (mantissa << 1) + 1, ((mantissa << 1) + 33) << np.maximum(exponent - 1, 0))
    return (np.where(code & 0x80, size, -size) * 8).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()

# Fixed values of the IMA ADPCM standard: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], dtype=np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def adpcm_delta_table() -> np.ndarray:
    """Signed difference for each (step index, nibble)."""
    step, nibble = STEPS[:, None], np.arange(16)
    size = step // 8 + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step // 2, 0) + np.where(nibble & 1, step // 4, 0)
    return np.where(nibble & 8, -size, size).astype(np.int32)


DELTAS = adpcm_delta_table()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono blocks, shape (blocks, bytes) to (blocks, samples).

    The loop runs over the samples of a block; each step handles all blocks.
    A header index beyond the table counts as its last entry.
    """
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * body.shape[0], len(blocks)), dtype=np.int16)
    out[0] = value
    for k in range(body.shape[0]):
        for half, nibble in enumerate((body[k] & 15, body[k] >> 4)):
            value = np.clip(value + DELTAS[index, nibble], -32768, 32767)
            index = np.clip(index + CHANGES[nibble], 0, len(STEPS) - 1)
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples kept, and between each two their four-point
    half-band interpolation (-1, 9, 9, -1) / 16, ends repeated."""
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    between = (9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(between, -32768, 32767)
    return out


def wav(codes: bytes, codec: str, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file around coded mono samples."""
    bits = {"pcm": 16, "ima_adpcm": 4}.get(codec, 8)
    align = {"pcm": 2, "ima_adpcm": ADPCM_BLOCK}.get(codec, 1)
    per_block = 2 * (ADPCM_BLOCK - 4) + 1
    speed = rate * ADPCM_BLOCK // per_block if codec == "ima_adpcm" else rate * align
    extra = struct.pack("<HH", 2, per_block) if codec == "ima_adpcm" else b"" if codec == "pcm" else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, speed, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(codes)) + codes
    return b"RIFF" + struct.pack("<I", len(body) + len(codes) % 2) + body + b"\0" * (len(codes) % 2)


def parse(media: bytes) -> tuple[int, int, bytes] | None:
    """(format, rate, coded samples) of a WAVE file, or None if it isn't one."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            form = struct.unpack_from("<HHI", media, at + 8)
        if name == b"data" and form:
            return form[0], form[2], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def pcm(kind: int, codes: bytes) -> np.ndarray | None:
    """16-bit samples of coded bytes; None for an unknown format. A broken
    last block or half sample is left out."""
    raw = np.frombuffer(codes, dtype=np.uint8)
    if kind == FORMATS["mulaw"]:
        return MULAW[raw]
    if kind == FORMATS["alaw"]:
        return ALAW[raw]
    if kind == FORMATS["ima_adpcm"]:
        whole = len(raw) // ADPCM_BLOCK * ADPCM_BLOCK
        return adpcm_decode(raw[:whole].reshape(-1, ADPCM_BLOCK)).ravel() if whole else np.zeros(0, np.int16)
    if kind == FORMATS["pcm"]:
        return np.frombuffer(codes[: len(codes) // 2 * 2], dtype="<i2")
    return None


def decode(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, n_samples, pcm): every file as 16 kHz 16-bit PCM in WAVE.

    Null, broken or unknown media give a row with null pcm; 8 kHz audio is
    doubled, other rates are kept as they are. ADPCM of all files of a batch
    goes through one decoder call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                files = [parse(x) if x else None for x in batch.column(1).slice(at, 64).to_pylist()]
                blocks = [
                    np.frombuffer(f[2][: len(f[2]) // ADPCM_BLOCK * ADPCM_BLOCK], np.uint8).reshape(-1, ADPCM_BLOCK)
                    if f and f[0] == FORMATS["ima_adpcm"]
                    else np.zeros((0, ADPCM_BLOCK), np.uint8)
                    for f in files
                ]
                every = adpcm_decode(np.concatenate(blocks)) if sum(map(len, blocks)) else np.zeros((0, 65), np.int16)
                ends = np.cumsum([len(b) for b in blocks])
                out = []
                for f, b, e in zip(files, blocks, ends, strict=True):
                    x = None if f is None else every[e - len(b) : e].ravel() if f[0] == FORMATS["ima_adpcm"] else pcm(f[0], f[2])
                    if x is not None and f[1] == RATE and len(x):
                        x = double_rate(x)
                    out.append(None if x is None else wav(x.astype("<i2").tobytes(), "pcm", TARGET if f[1] == RATE else f[1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, 64),
                        pa.array([None if x is None else (len(x) - 44) // 2 for x in out], pa.int64()),
                        pa.array(out, pa.binary()),
                    ],
                    names=["id", "n_samples", "pcm"],
                )

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(
        run, f"id {kind}, n_samples long, pcm binary"
    )


#: Payloads are padded to whole units of this many bytes: whole ADPCM blocks.
UNIT = 576


def store_texts(docs: DataFrame, codec: str = "mulaw", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): UTF-8 bytes as telephony codes in WAVE files,
    padded with 255 to a positive multiple of ``UNIT``, written and read back.
    Null text is an empty one; repeated rows and null ids stay; an empty table
    gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in units.slices(batch.column(1)):
                offsets, data = units.buffers(texts)
                raw, sizes = data.tobytes(), np.diff(offsets)
                media = [
                    wav(raw[a:b] + b"\xff" * (max(-(-(b - a) // UNIT), 1) * UNIT - (b - a)), codec)
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)).cast(pa.int64()), pa.array(sizes), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    stored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary"
    )
    return common.materialize(stored, "media")


def _runs_of(media: list[bytes], rows: int = 256, size: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first, files): runs of bounded number and bytes, or of one file."""
    at, held = 0, 0
    for k, x in enumerate(media):
        if k > at and (k - at >= rows or held + len(x) > size):
            yield at, media[at:k]
            at, held = k, 0
        held += len(x)
    if at < len(media):
        yield at, media[at:]


def digest(stored: DataFrame) -> DataFrame:
    """Digests of stored media, from the bytes read back, and ``pcm``: the
    media decoded and resampled, as 16 kHz 16-bit WAVE, to be stored with them.

    Equal media give equal values; a row for each row of ``stored``.
    ``feature`` tells the three codecs' readings of the payload: for the
    resampled PCM of mu-law and A-law expansion its crc32 and peak, for ADPCM
    its crc32, then zero crossings and root mean square of the mu-law signal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            for at, part in _runs_of(media):
                codes = [parse(x)[2] for x in part]
                raw = np.frombuffer(b"".join(codes), dtype=np.uint8)
                ends = np.cumsum([len(c) for c in codes])
                starts = ends - [len(c) for c in codes]
                mu, a = MULAW[raw], ALAW[raw]
                blocks = adpcm_decode(raw.reshape(-1, ADPCM_BLOCK))
                crossing = np.zeros(len(raw), dtype=np.int64)
                crossing[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
                crossing[starts] = 0
                power = np.add.reduceat(mu.astype(np.int64) ** 2, starts)
                crossings = np.add.reduceat(crossing, starts)
                features, resampled = [], []
                for k, (i, j) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    x, y = double_rate(mu[i:j]), double_rate(a[i:j])
                    z = double_rate(blocks[i // ADPCM_BLOCK : j // ADPCM_BLOCK].ravel())
                    rms = int(np.sqrt(power[k] / (j - i)))
                    kind = parse(part[k])[0]
                    heard = x if kind == FORMATS["mulaw"] else y if kind == FORMATS["alaw"] else z
                    resampled.append(wav(heard.astype("<i2").tobytes(), "pcm", TARGET))
                    features.append(
                        f"mulaw:{zlib.crc32(x):08x}/{int(np.abs(x.astype(np.int32)).max())};"
                        f"alaw:{zlib.crc32(y):08x}/{int(np.abs(y.astype(np.int32)).max())};"
                        f"adpcm:{zlib.crc32(z):08x};zc:{crossings[k]};rms:{rms}"
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)),
                        batch.column(1).slice(at, len(part)),
                        pa.array([len(c) for c in codes], pa.int64()),
                        pa.array([hashlib.sha256(c).hexdigest() for c in codes]),
                        pa.array([zlib.crc32(c[-32:]) for c in codes], pa.int64()),
                        pa.array([len(x) for x in part], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in part]),
                        pa.array(features),
                        pa.array(resampled, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"],
                )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, pcm binary",
    )
