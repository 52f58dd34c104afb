"""Table schemas and enumerations of the document library."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the data model.
DOCUMENT_STATUS = (
    "uploaded", "normalizing_pages", "inspecting", "extracting_text", "running_ocr",
    "text_ready", "generating_audio", "ready", "failed",
)
PAGE_STATUS = ("pending", "normalizing", "extracting", "running_ocr", "completed", "failed")
SEGMENT_STATUS = ("pending", "generating", "completed", "failed")
EXTRACTION_METHOD = ("pending", "embedded_text", "ocr")
SOURCE_TYPE = ("pdf", "images")
LANGUAGE = ("cantonese", "mandarin", "english")
ROTATION = (0, 90, 180, 270)

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "decimal(6,5)": T.DecimalType(6, 5),
    "decimal(10,3)": T.DecimalType(10, 3), "decimal(4,2)": T.DecimalType(4, 2),
}


def _struct(columns: str) -> T.StructType:
    """Like a DDL string, but without a running session."""
    pairs = [c.strip().split(" ") for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


DOCUMENT = _struct(
    "id string, user_id string, library_document_id string, title string, recording_title string, "
    "target_language string, tts_voice string, original_filename string, source_type string, "
    "source_storage_path string, total_pages int, status string, error_message string, "
    "created_at timestamp, updated_at timestamp"
)
PAGE = _struct(
    "id string, document_id string, page_number int, original_filename string, original_image_path string, "
    "processed_image_path string, extraction_method string, extracted_text string, error_message string, "
    "warning_messages array<string>, crop_left decimal(6,5), crop_top decimal(6,5), crop_right decimal(6,5), "
    "crop_bottom decimal(6,5), rotation_degrees int, processing_status string, created_at timestamp, updated_at timestamp"
)
SEGMENT = _struct(
    "id string, document_id string, page_id string, segment_number int, source_text string, audio_storage_path string, "
    "duration_seconds decimal(10,3), processing_status string, error_message string, created_at timestamp, updated_at timestamp"
)
PROGRESS = _struct(
    "user_id string, document_id string, current_segment_number int, position_seconds decimal(10,3), "
    "playback_speed decimal(4,2), completed boolean, created_at timestamp, updated_at timestamp"
)
LINE = _struct("page_key string, pos int, text string, confidence double, y_min double, x_min double, x_max double")


def nested_document() -> T.StructType:
    """One document with its pages and segments, as in the JSON files."""
    return T.StructType(
        [*DOCUMENT.fields, T.StructField("pages", T.ArrayType(PAGE)), T.StructField("audio_segments", T.ArrayType(SEGMENT))]
    )
