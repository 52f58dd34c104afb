"""Library views: folders, recordings, details, audio and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import chars
from leafmill.operators.ranks import with_place
from leafmill.schemas import LANGUAGE

# The states of a running job, and the order of a folder's status.
ACTIVE = ("normalizing_pages", "inspecting", "extracting_text", "running_ocr", "generating_audio")
#: The first of these that any member has is the folder's status.
PRIORITY = (
    "generating_audio", "running_ocr", "extracting_text", "inspecting", "normalizing_pages",
    "failed", "ready", "text_ready", "uploaded",
)


def owned_by(table: DataFrame, user: str | int | None, column: str = "user_id") -> DataFrame:
    """Rows of one owner; without sign-in (None) all rows."""
    return table if user is None else table.where(F.col(column) == user)


def authorize(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (id, asker) with the document's columns if it is the asker's;
    one of another owner is reported as one that doesn't exist. A null asker
    (no sign-in) may see all."""
    found = documents.withColumn("lm_found", F.lit(True))
    joined = asked.join(found, "id", "left")
    mine = F.coalesce("lm_found", F.lit(False)) & (F.col("asker").isNull() | F.coalesce(F.col("user_id") == F.col("asker"), F.lit(False)))
    seen = [F.when(mine, F.col(c)).alias(c) for c in documents.columns if c != "id"]
    return joined.select("id", "asker", *seen, F.when(~mine, "book_not_found").alias("error_code"))


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRIORITY)), status)


def folder_ids(recordings: DataFrame, owner: str = "user_id") -> DataFrame:
    """Recordings with ``folder_id``.

    Assigned recordings (to another document) go by their target. The others
    gather by folded title; the folder takes the id of the earliest of them,
    then of the latest updated, then of the smallest id. The earliest is found
    by an aggregate and joined back, so one title of very many recordings
    neither meets in one task nor sorts.
    """
    target = F.col("library_document_id")
    assigned = target.isNotNull() & (target != F.col("id"))
    marked = recordings.withColumns({"lm_key": chars.casefold(chars.strip(F.col("title"))), "lm_assigned": assigned})
    marked = marked.withColumn("lm_assigned", F.coalesce("lm_assigned", F.lit(False)))
    order = F.struct("created_at", (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("u"), "id")
    heads = marked.where(~F.col("lm_assigned")).groupBy(F.col(owner).alias("lm_owner"), F.col("lm_key").alias("lm_title")).agg(F.min_by("id", order).alias("folder_id"))
    # Without sign-in there is no owner, and a title may be missing: null equals null.
    same = F.col(owner).eqNullSafe(F.col("lm_owner")) & F.col("lm_key").eqNullSafe(F.col("lm_title"))
    free = marked.where(~F.col("lm_assigned")).join(heads, same).drop("lm_owner", "lm_title")
    fixed = marked.where("lm_assigned").withColumn("folder_id", target)
    return free.select(fixed.columns).unionByName(fixed).drop("lm_key", "lm_assigned")


def folders(recordings: DataFrame, owner: str = "user_id") -> DataFrame:
    """One row per folder: title and time of its newest member, counts, status
    by priority, whether anything is active, and its languages."""
    newest = F.struct("updated_at", F.col("id").alias("i"))
    rolled = folder_ids(recordings, owner).groupBy(owner, "folder_id").agg(
        F.max_by("title", newest).alias("title"),
        F.count(F.lit(1)).alias("recording_count"),
        F.sum("total_pages").cast("long").alias("total_pages"),
        F.min(status_rank(F.col("status"))).cast("int").alias("lm_rank"),
        F.bool_or(F.col("status").isin(*ACTIVE)).alias("processing_active"),
        F.array_join(F.sort_array(F.collect_set("target_language")), ",").alias("target_languages"),
        F.max("updated_at").alias("latest_recording_at"),
    )
    status = F.element_at(F.array(*map(F.lit, PRIORITY)), F.col("lm_rank"))
    return rolled.withColumn("processing_status", status).drop("lm_rank")


def folder_listing(recordings: DataFrame, owner: str = "user_id") -> DataFrame:
    """``folders`` with their place in their owner's listing, newest first."""
    latest = -F.unix_micros(F.col("latest_recording_at").cast("timestamp"))
    return with_place(folders(recordings, owner), [owner], [latest, F.col("folder_id")], "place")


def folder_members(recordings: DataFrame, owner: str = "user_id") -> DataFrame:
    """Members of each folder, newest first, titled by their own title, their
    file's name, or "Recording n". Flat rows, as a folder may hold very many."""
    placed = with_place(folder_ids(recordings, owner), [owner, "folder_id"], [F.col("updated_at"), F.col("id")], "position", descending=True)
    name = F.coalesce("recording_title", "original_filename", F.concat(F.lit("Recording "), F.col("position").cast("string")))
    return placed.select(owner, "folder_id", "position", "id", name.alias("display_title"), "status")


def page_counts(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """Completed and failed pages, and characters, of each document."""
    return pages.groupBy(document).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("processing_status") == "completed").alias("completed_pages"),
        F.count_if(F.col("processing_status") == "failed").alias("failed_pages"),
    )


def assemble(documents: DataFrame, pages: DataFrame, segments: DataFrame, document: str = "document_id") -> DataFrame:
    """Documents with arrays of their pages and segments, empty where none.

    Each child table is aggregated before it meets its parent, so no child is
    multiplied by the other's rows.
    """
    def children(table: DataFrame, number: str, name: str) -> DataFrame:
        rest = [c for c in table.columns if c not in (document, number)]
        rows = F.sort_array(F.collect_list(F.struct(number, *rest)))
        return table.groupBy(F.col(document).alias("id")).agg(rows.alias(name))

    p, s = children(pages, "page_number", "pages"), children(segments, "segment_number", "audio_segments")
    joined = documents.join(p, "id", "left").join(s, "id", "left")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(f.schema[c].dataType)) for c, f in (("pages", p), ("audio_segments", s))})


def document_detail(documents: DataFrame, pages: DataFrame, segments: DataFrame) -> DataFrame:
    """Documents with page counts, ordered page numbers, characters and their
    number of segments. The pages themselves are ``page_records``: flat rows, as
    a document may have very many."""
    rolled = pages.groupBy(F.col("document_id").alias("id")).agg(
        F.count_if(F.col("processing_status") == "completed").alias("completed_pages"),
        F.count_if(F.col("processing_status") == "failed").alias("failed_pages"),
        F.sum(F.char_length(F.coalesce("extracted_text", F.lit("")))).alias("characters"),
        F.array_join(F.sort_array(F.collect_list("page_number")), ",").alias("page_numbers"),
    )
    counted = segments.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("audio_segment_count"))
    joined = documents.join(rolled, "id", "left").join(counted, "id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("completed_pages", "failed_pages", "characters", "audio_segment_count")}
    return joined.withColumns(zero | {"page_numbers": F.coalesce("page_numbers", F.lit(""))})


# What a page's record shows of its row.
PAGE_RECORD = (
    "id", "page_number", "original_filename", "extraction_method", "extracted_text", "crop_left", "crop_top",
    "crop_right", "crop_bottom", "processing_status", "error_message", "warning_messages", "updated_at",
)


def page_records(pages: DataFrame) -> DataFrame:
    """Pages as a document's view shows them, with ``extracted_character_count``,
    by document and number."""
    shown = [c for c in PAGE_RECORD if c in pages.columns]
    length = F.char_length(F.coalesce("extracted_text", F.lit(""))).alias("extracted_character_count")
    return pages.select("document_id", *shown, length).orderBy("document_id", "page_number")


def library_items(recordings: DataFrame, pages: DataFrame, segments: DataFrame, owner: str = "user_id") -> DataFrame:
    """Recordings as the library shows them: their folder's id, counts of pages
    and segments, whether a job runs, and their own columns."""
    detail = document_detail(recordings.select("id"), pages, segments).select("id", "completed_pages", "failed_pages", "audio_segment_count")
    filed = folder_ids(recordings, owner).withColumn("library_book_id", F.col("folder_id")).drop("folder_id")
    return filed.join(detail, "id").withColumn("processing_active", F.coalesce(F.col("status").isin(*ACTIVE), F.lit(False)))


def ready_segments(segments: DataFrame) -> DataFrame:
    """Completed segments that have audio."""
    return segments.where((F.col("processing_status") == "completed") & F.col("audio_storage_path").isNotNull())


def audio_view(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Segments with their page's number, null where they have no page, and a
    path only where it isn't empty."""
    numbers = pages.select(F.col("id").alias("page_id"), "page_number")
    return segments.join(numbers, "page_id", "left").withColumn("audio_storage_path", F.nullif("audio_storage_path", F.lit("")))


def downloadable(recordings: DataFrame) -> DataFrame:
    return recordings.where((F.col("status") == "ready") & (F.col("segment_count") > 0))


def archive_manifest(segments: DataFrame, document: str = "document_id") -> DataFrame:
    """Member names of a recording's archive: the segment's own number and its
    file's extension, .wav where the file has none."""
    suffix = F.regexp_extract("audio_storage_path", r"[^/](\.[^./]+)\z", 1)
    suffix = F.when(suffix == "", ".wav").otherwise(suffix)
    number = F.lpad(F.col("segment_number").cast("string"), 3, "0")
    number = F.when(F.col("segment_number") > 999, F.col("segment_number").cast("string")).otherwise(number)
    return ready_segments(segments).select(document, "segment_number", "audio_storage_path", F.concat(F.lit("part-"), number, suffix).alias("member"))


def combined_manifest(recordings: DataFrame, segments: DataFrame, owner: str = "user_id") -> DataFrame:
    """Ready segments of all recordings of a folder, recordings by creation."""
    members = folder_ids(recordings, owner).select(owner, "folder_id", F.col("id").alias("document_id"), "created_at")
    joined = ready_segments(segments).join(members, "document_id")
    return with_place(joined, [owner, "folder_id"], [F.col("created_at"), F.col("document_id"), F.col("segment_number")], "part")


def progress_percent(done: Column, total: Column) -> Column:
    """Rounded half up; 0 without a total."""
    return F.when(total > 0, F.floor(100.0 * done / total + 0.5)).otherwise(0).cast("int")


def with_progress(recordings: DataFrame, progress: DataFrame) -> DataFrame:
    saved = progress.select(F.col("document_id").alias("id"), "current_segment_number", "position_seconds", "completed")
    return recordings.join(saved, "id", "left")


def language_summary(languages: Column) -> Column:
    """Up to two labels in words, more as a number; codes that aren't known drop out."""
    known = F.filter(F.coalesce(languages, F.array().cast("array<string>")), lambda x: x.isin(*LANGUAGE))
    labels = F.array_distinct(F.transform(known, F.initcap))
    many = F.concat(F.size(labels).cast("string"), F.lit(" languages"))
    return F.when(F.size(labels) == 0, "Language not set").when(F.size(labels) <= 2, F.array_join(labels, ", ")).otherwise(many)


def document_kind(pages: DataFrame, key: list[str], classification: str = "classification") -> DataFrame:
    """text if all pages have embedded text, scanned if none has, else mixed."""
    kind = F.col(classification)
    return pages.groupBy(*key).agg(
        F.when(F.bool_and(kind == "embedded_text"), "text").when(F.bool_and(kind == "requires_ocr"), "scanned").otherwise("mixed").alias("kind"),
        F.count(F.lit(1)).alias("pages"),
    )
