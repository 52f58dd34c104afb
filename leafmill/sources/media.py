"""Uploaded files: validation from their first bytes, and mock providers.

Model runtimes aren't part of this library: the recognition and speech
interfaces are here with mock and disabled providers.
"""

from __future__ import annotations

import functools
import io
import math
import struct
import wave
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.spread import spread


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def is_pdf(content: Column) -> Column:
    """A PDF header within the first 1,024 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def _number(content: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, size)), 16, 10).cast("long")


def png_size(content: Column) -> Column:
    """Struct of width and height from a PNG's first chunk, else null."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    header = F.decode(F.substring(content, 13, 4), "ISO-8859-1") == "IHDR"
    return F.when(png & header, F.struct(_number(content, 17, 4).alias("width"), _number(content, 21, 4).alias("height")))


def jpeg_size(content: Column) -> Column:
    """Struct of width and height from a JPEG's frame header, else null."""

    @F.pandas_udf("width long, height long")
    def run(files: pd.Series) -> pd.DataFrame:
        def size(raw: bytes | None) -> tuple[int, int] | tuple[None, None]:
            if raw is None or raw[:2] != b"\xff\xd8":
                return None, None
            at = 2
            while at + 9 <= len(raw) and raw[at] == 0xFF:
                mark, length = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack_from(">HH", raw, at + 5)
                    return width, height
                at += 2 + length
            return None, None

        return pd.DataFrame([size(f) for f in files], columns=["width", "height"])

    return run(content)


def image_error(content: Column, max_pixels: int = 10_000_000) -> Column:
    """Why an image is refused, or null: type, or too many pixels."""
    jpeg = F.hex(F.substring(content, 1, 3)) == "FFD8FF"
    size = F.coalesce(png_size(content), jpeg_size(F.when(jpeg, content)))
    return F.when(size["width"].isNull(), "image_unreadable").when(size["width"] * size["height"] > max_pixels, "image_too_large")


@functools.lru_cache(maxsize=4)
def _sine(n: int, rate: int, hertz: float, amplitude: int) -> bytes:
    return struct.pack(f"<{n}h", *(int(amplitude * math.sin(2 * math.pi * hertz * k / rate)) for k in range(n)))


def mock_tone(seconds: float, rate: int = 16_000, hertz: float = 440.0, amplitude: int = 1_800) -> bytes:
    """16-bit mono WAVE of a sine: the beginning of one of full eights of
    seconds, which a process computes once."""
    n = int(rate * seconds)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(_sine(-(-n // (8 * rate)) * 8 * rate, rate, hertz, amplitude)[: 2 * n])
    return out.getvalue()


def mock_frames(text: Column, rate: int = 16_000) -> Column:
    """Frames of the mock tone for a text."""
    from leafmill.functions.chars import mock_duration

    return F.floor(mock_duration(text) * rate).cast("long")


Speech = Callable[[str], bytes | None]
Reader = Callable[[bytes], tuple[str, float] | None]


def mock_speech(text: str) -> bytes:
    return mock_tone(min(8.0, max(1.2, len(text) / 35)))


def synthesize(segments: DataFrame, provider: Speech = mock_speech, text: str = "source_text") -> DataFrame:
    """Segments with ``audio`` (null where the provider gives none or fails) and
    ``duration_seconds`` of a WAVE result. The provider loads once a task, and
    some megabytes of audio leave at once."""

    def heard(said: str) -> bytes | None:
        try:
            return provider(said)
        except (OSError, ValueError, RuntimeError):  # one failed text fails alone
            return None

    def seconds(audio: bytes | None) -> float | None:
        if audio is None:
            return None
        with wave.open(io.BytesIO(audio)) as w:
            return w.getnframes() / w.getframerate()

    @F.pandas_udf("audio binary, duration_seconds double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            audio, held, last = [], 0, len(texts) - 1
            for k, said in enumerate(texts):
                audio.append(None if said is None else heard(said))
                held += len(audio[-1] or b"")
                if held > 8 << 20 or k == last:
                    yield pd.DataFrame({"audio": pd.Series(audio, dtype=object), "duration_seconds": pd.Series(map(seconds, audio), dtype=float)})
                    audio, held = [], 0

    return spread(segments).withColumn("lm_speech", run(F.col(text))).select("*", "lm_speech.*").drop("lm_speech")


NO_AUDIO = "Could not create audio for this segment."


def speak(segments: DataFrame, provider: Speech = mock_speech, extension: str = "wav") -> DataFrame:
    """Segments after an audio run: completed ones as they were, each other one
    with its audio, path and duration, or failed with a message where the
    provider gives none. Storing the ``audio`` column is a write of its own, so
    a store that fails later leaves the outcome as it is."""
    todo = F.coalesce(F.col("processing_status") != "completed", F.lit(True))
    spoken = synthesize(segments.withColumn("lm_text", F.when(todo, F.col("source_text"))).drop("audio", "duration_seconds"), provider, "lm_text")
    done = todo & F.col("audio").isNotNull()
    path = F.concat(F.lit("audio/"), F.format_string(f"segment-%04d.{extension}", "segment_number"))
    return spoken.withColumns(
        {
            "audio_storage_path": F.when(done, path).otherwise(F.col("audio_storage_path")),
            "error_message": F.when(todo & ~done, F.lit(NO_AUDIO)),
            "processing_status": F.when(todo, F.when(done, "completed").otherwise("failed")).otherwise(F.col("processing_status")),
        }
    ).drop("lm_text")


def recognize(pages: DataFrame, provider: Reader | None, image: str = "content") -> DataFrame:
    """Pages with recognised ``text`` and ``confidence``; without a provider
    (recognition disabled) an ``error_code`` instead."""
    if provider is None:
        return pages.withColumns({"text": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "error_code": F.lit("ocr_disabled")})

    @F.pandas_udf("text string, confidence double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for images in batches:
            found = [None if i is None else provider(i) for i in images]
            yield pd.DataFrame([f or (None, None) for f in found], columns=["text", "confidence"])

    read = pages.withColumn("lm_read", run(F.col(image))).select("*", "lm_read.*").drop("lm_read")
    return read.withColumn("error_code", F.when(F.col("text").isNull(), "ocr_failed"))


def dense_band(rows: DataFrame, key: list[str], threshold: float, least: int) -> DataFrame:
    """Longest stretch of rows whose share of bright pixels is high: one side
    of a page's paper rectangle. Columns: key, y, share."""
    from leafmill.operators.layout import active_runs, longest_run

    return longest_run(active_runs(rows, key, "y", F.col("share") > threshold), key, least)
