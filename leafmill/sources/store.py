"""Reading and keeping up the document tables.

Spark has no update in place for Parquet: upserts, deletes and renames are
whole-table transformations whose result goes to a new path; a table is never
overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.functions import chars, names
from leafmill.operators.requests import last_requests


# Columns of the stored tables whose records are named otherwise.
RENAMES = {
    "library_document_id": "library_book_id",
    "original_image_storage_path": "original_image_path",
    "processed_image_storage_path": "processed_image_path",
}


def to_records(rows: DataFrame) -> DataFrame:
    """Flat rows under the records' names; missing warnings are an empty list."""
    out = rows.select([F.col(c).alias(RENAMES.get(c, c)) for c in rows.columns])
    if "warning_messages" in out.columns:
        out = out.withColumn("warning_messages", F.coalesce("warning_messages", F.array().cast("array<string>")))
    return out


def to_rows(records: DataFrame) -> DataFrame:
    back = {v: k for k, v in RENAMES.items()}
    return records.select([F.col(c).alias(back.get(c, c)) for c in records.columns])


def find_page(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (document_id, page_number) with the page, or an error code."""
    found = pages.withColumn("lm_found", F.lit(True))
    joined = wanted.join(found, ["document_id", "page_number"], "left")
    return joined.withColumn("error_code", F.when(F.col("lm_found").isNull(), "page_not_found")).drop("lm_found")


def concat_sources(*tables: DataFrame) -> DataFrame:
    """Bag union with each row's source, in the order given."""
    out = [t.withColumn("source_ordinal", F.lit(k)) for k, t in enumerate(tables)]
    whole = out[0]
    for t in out[1:]:
        whole = whole.unionByName(t)
    return whole


def scan(table: DataFrame, newest_first: str = "updated_at") -> DataFrame:
    return table.orderBy(F.desc(newest_first))


def point_read(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value).limit(1)


def related(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is among ``keys``; no keys, no rows."""
    return table.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without a successor, and the new rows; of several new rows of
    one key the newest by ``updated_at``."""
    order = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in ("updated_at", *[c for c in new.columns if c not in key and c != "updated_at"])])
    latest = new.withColumn("lm_r", F.row_number().over(order)).where("lm_r = 1").drop("lm_r")
    return old.join(latest, key, "left_anti").unionByName(latest)


def delete(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone, key, "left_anti")


def delete_documents(gone: DataFrame, documents: DataFrame, pages: DataFrame, segments: DataFrame, progress: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables without the documents in ``gone(id)`` and what hangs on them;
    recordings kept in a deleted folder lose their folder."""
    ids = gone.select("id").distinct()
    children = ids.select(F.col("id").alias("document_id"))
    target = ids.select(F.col("id").alias("library_document_id"), F.lit(True).alias("lm_gone"))
    left = documents.join(ids, "id", "left_anti").join(target, "library_document_id", "left")
    left = left.withColumn("library_document_id", F.when(F.col("lm_gone").isNull(), F.col("library_document_id"))).select(*documents.columns)
    out = {"documents": left, "pages": pages.join(children, "document_id", "left_anti"), "segments": segments.join(children, "document_id", "left_anti")}
    if progress is not None:
        out["progress"] = progress.join(children, "document_id", "left_anti")
    return out


def _stamped(changes: dict[str, Column], table: DataFrame, changed: Column, now: Column | None) -> dict[str, Column]:
    """``changes`` and, where the table has it, ``updated_at`` of changed rows."""
    if "updated_at" not in table.columns:
        return changes
    at = (F.current_timestamp() if now is None else now).cast(table.schema["updated_at"].dataType)
    return changes | {"updated_at": F.when(changed, at).otherwise(F.col("updated_at"))}


def title_error(title: Column, code: str = "book_title_required") -> Column:
    """A code where nothing but white space is given."""
    return F.when(F.coalesce(chars.strip(title) == "", F.lit(True)), code)


def rename_folder(documents: DataFrame, members: DataFrame, title: Column, folder: Column, now: Column | None = None) -> DataFrame:
    """All members (``members(id)``) take the folder's title, stripped, and its
    id; a title that is blank (``title_error``) changes nothing."""
    mine = members.select("id", F.lit(True).alias("lm_mine")).distinct()
    hit = F.coalesce("lm_mine", F.lit(False)) & title_error(title).isNull()
    changes = {
        "title": F.when(hit, chars.strip(title)).otherwise(F.col("title")),
        "library_document_id": F.when(hit, folder).otherwise(F.col("library_document_id")),
    }
    joined = documents.join(mine, "id", "left")
    return joined.withColumns(_stamped(changes, documents, hit, now)).select(*documents.columns)


def rename_recordings(documents: DataFrame, renames: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, refused) after ``renames``: id, title and perhaps
    requested_at. Titles are stripped; refused are blank ones, unknown ids and
    all but the last request of a document."""
    asked = renames.withColumn("title", chars.strip(F.col("title")))
    known = documents.select("id", F.lit(True).alias("lm_known")).distinct()
    error = F.coalesce(title_error(F.col("title"), "recording_title_required"), F.when(F.col("lm_known").isNull(), "book_not_found"))
    judged = asked.join(known, "id", "left").withColumn("error_code", error).drop("lm_known")
    kept, others = last_requests(judged.where("error_code IS NULL").drop("error_code"), ["id"])
    new = kept.select("id", F.col("title").alias("lm_title"))
    hit = F.col("lm_title").isNotNull()
    changes = _stamped({"recording_title": F.when(hit, F.col("lm_title")).otherwise(F.col("recording_title"))}, documents, hit, now)
    done = documents.join(new, "id", "left").withColumns(changes).select(*documents.columns)
    return done, judged.where("error_code IS NOT NULL").unionByName(others.drop("times"))


def assign_folder(documents: DataFrame, moves: DataFrame, now: Column | None = None) -> DataFrame:
    """``moves``: id, folder_id, folder_title and perhaps requested_at, of which
    the last counts for each document. A moved recording takes the folder's id
    and title, and, unless it has one, the stem of its file's name as recording
    title, "Recording" without a name."""
    last, _ = last_requests(moves, ["id"])
    joined = documents.join(last.select("id", "folder_id", "folder_title"), "id", "left")
    moved = F.col("folder_id").isNotNull()
    stem = F.coalesce(F.nullif(names.file_stem(F.col("original_filename")), F.lit("")), F.lit("Recording"))
    changes = {
        "recording_title": F.when(moved, F.coalesce("recording_title", stem)).otherwise(F.col("recording_title")),
        "title": F.when(moved, F.col("folder_title")).otherwise(F.col("title")),
        "library_document_id": F.when(moved, F.col("folder_id")).otherwise(F.col("library_document_id")),
    }
    return joined.withColumns(_stamped(changes, documents, moved, now)).select(*documents.columns)


def duplicates(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that break uniqueness, with their number of rows."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Child rows whose (non-null) reference has no parent."""
    known = child
    for k in key:
        known = known.where(F.col(k).isNotNull())
    return known.join(parent.select(*key).distinct(), key, "left_anti")


def violations(table: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """(key, rule) for every row and rule that doesn't hold; a rule that is
    null holds, as in SQL checks."""
    broken = F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(True)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return table.select(key, F.explode(broken).alias("rule"))


def document_rules() -> dict[str, Column]:
    c = F.col
    return {
        "title_blank": F.trim("title") != "",
        "total_pages": c("total_pages") >= 1,
        "status": c("status").isin(*schemas.DOCUMENT_STATUS),
        "source_type": c("source_type").isin(*schemas.SOURCE_TYPE),
        "language": c("target_language").isin(*schemas.LANGUAGE),
    }


def page_rules() -> dict[str, Column]:
    from leafmill.functions.geometry import crop_valid

    c = F.col
    return {
        "page_number": c("page_number") >= 1,
        "processing_status": c("processing_status").isin(*schemas.PAGE_STATUS),
        "extraction_method": c("extraction_method").isin(*schemas.EXTRACTION_METHOD),
        "rotation": c("rotation_degrees").isin(*schemas.ROTATION),
        "crop": crop_valid(c("crop_left"), c("crop_top"), c("crop_right"), c("crop_bottom")),
    }


def segment_rules() -> dict[str, Column]:
    c = F.col
    return {
        "segment_number": c("segment_number") >= 1,
        "duration": c("duration_seconds") >= 0,
        "processing_status": c("processing_status").isin(*schemas.SEGMENT_STATUS),
    }


def progress_rules() -> dict[str, Column]:
    c = F.col
    return {
        "current_segment_number": c("current_segment_number") > 0,
        "position_seconds": c("position_seconds") >= 0,
        "playback_speed": c("playback_speed").between(0.5, 3),
    }
