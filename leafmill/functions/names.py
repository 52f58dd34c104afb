"""File names, storage paths and upload rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_stem(path: Column) -> Column:
    """Last part of a path without its last extension; a leading dot and a
    trailing one belong to the stem."""
    name = F.regexp_extract(F.regexp_replace(path, r"/+\z", ""), r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def download_name(value: Column, fallback: str) -> Column:
    """Safe name of the stem; the fallback where nothing is left."""
    stem = file_stem(value)
    stem = F.when(stem == "", value).otherwise(stem)
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+\z", "")
    return F.when(value.isNull() | (safe == ""), fallback).otherwise(safe)


def storage_path(user: Column, document: Column, relative: Column) -> Column:
    """user/document/relative; without a user, document/relative."""
    return F.concat_ws("/", user, document, relative)


def segment_file(number: Column, extension: str) -> Column:
    return F.format_string(f"segment-%04d.{extension}", number)


def page_file(number: Column) -> Column:
    return F.format_string("page-%04d.png", number)


def owned_path(path: Column, user: Column) -> Column:
    """Whether the first folder of a storage path is the user's."""
    return F.split(path, "/")[0] == user


def inside(path: Column) -> Column:
    """Whether a relative path stays in its folder: no step up leaves it, at the
    path's end or on the way."""
    parts = F.split(path, "/")
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def walk(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part.isin("", "."), 0).when(part == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    return ~path.startswith("/") & F.aggregate(parts, start, walk, lambda acc: acc["ok"])


def with_pdf(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]+\z", "")


def as_jpg(name: Column) -> Column:
    return F.concat(without_extension(name), F.lit(".jpg"))


def extension(name: Column) -> Column:
    """Lower-case last extension with its dot, else an empty string."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)\z", 1))


def upload_error(kind: Column, name: Column, size: Column, images: Column, media_type: Column | None = None, existing: Column | None = None) -> Column:
    """First rule a file of an upload breaks, or null: none, count, type, empty,
    size. Either the media type or the extension may tell a file's type.
    ``images``: how many come now, ``existing`` how many there are."""
    mb, ext, said = 1024 * 1024, extension(name), F.coalesce(F.lit("") if media_type is None else media_type, F.lit(""))
    pdf, image = kind == "pdf", kind == "images"
    total = images if existing is None else images + F.coalesce(existing, F.lit(0))
    return (
        F.when(image & (images <= 0), "no_images")
        .when(image & (total > 100), "too_many_images")
        .when(pdf & (said != "application/pdf") & (ext != ".pdf"), "pdf_type")
        .when(image & ~said.isin("image/jpeg", "image/png") & ~ext.isin(".jpg", ".jpeg", ".png"), "image_type")
        .when(size <= 0, "empty")
        .when(pdf & (size > 50 * mb), "pdf_too_large")
        .when(image & (size > 15 * mb), "image_too_large")
    )


def display_title(recording_title: Column, original_filename: Column, title: Column) -> Column:
    return F.coalesce(recording_title, original_filename, title)


# Wording for a document's status.
STATUS_LABELS = {
    "uploaded": "Text not started", "normalizing_pages": "Preparing pages", "inspecting": "Checking pages",
    "extracting_text": "Reading text", "running_ocr": "Reading text", "text_ready": "Ready for audio",
    "generating_audio": "Creating audio", "ready": "Ready to listen", "failed": "Needs attention",
}


def status_label(status: Column) -> Column:
    pairs = [F.lit(x) for pair in STATUS_LABELS.items() for x in pair]
    return F.create_map(*pairs)[status]


def status_route(status: Column) -> Column:
    """Where a document opens: the player once there is text, else processing."""
    return F.when(status.isin("ready", "text_ready", "generating_audio"), "listen").otherwise("processing")


def rotations_error(text: Column, files: Column) -> tuple[Column, Column]:
    """(rotations, error_code) of a JSON list, one right angle for each file.
    Only whole numbers count: of ``["90"]`` and ``[90.0]`` the kind is wrong."""
    variant = F.try_parse_json(text)
    items = F.try_variant_get(variant, "$", "array<variant>")
    count = F.coalesce(F.size(items), F.lit(-1))
    whole = F.forall(items, lambda v: F.coalesce(F.schema_of_variant(v) == "BIGINT", F.lit(False)))
    numbers = F.transform(items, lambda v: F.try_variant_get(v, "$", "long"))
    right = whole & F.forall(numbers, lambda x: F.coalesce(x.isin(0, 90, 180, 270), F.lit(False)))
    error = F.when(variant.isNull() | (count != files), "invalid_rotations").when(~right, "invalid_rotation")
    return F.when(error.isNull(), F.transform(numbers, lambda x: x.cast("int"))), error


def short_date(ts: Column) -> Column:
    """Short month and day, hour and minute."""
    return F.date_format(ts, "MMM d, h:mm a")


def iso_time(ts: Column) -> Column:
    """ISO 8601 in UTC with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def strict_zip(*arrays: Column) -> Column:
    """Positional zip; null where the lengths differ."""
    same = F.lit(True)
    for a in arrays[1:]:
        same &= F.size(a) == F.size(arrays[0])
    return F.when(same, F.arrays_zip(*arrays))
