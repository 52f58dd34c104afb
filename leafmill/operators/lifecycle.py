"""Document and page state, as admission verdicts and update expressions.

Rejections are an ``error_code`` column, never an exception: one batch holds
many documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import chars
from leafmill.operators.requests import last_requests
from leafmill.operators.spread import by_key

# The states of pages and segments that a job still has to do, the
# states of documents that a job of each kind leaves, and its last words.
UNFINISHED = ("pending", "running_ocr", "extracting")
UNSPOKEN = ("pending", "generating")
TEXT_RUNNING, AUDIO_RUNNING = ("extracting_text", "running_ocr"), ("generating_audio",)
TEXT_STOPPED = "Page text preparation stopped before it finished."
AUDIO_STOPPED = "Audio preparation stopped before it finished."


def unfinished(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("processing_status").isin(*UNFINISHED))


def admit_text_job(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """id, error_code, new_status for starting text preparation."""
    open_ = F.col("processing_status").isin(*UNFINISHED)
    marks = {"n_open": open_, "n_ocr": open_ & (F.col("extraction_method") == "ocr"), "n_failed": F.col("processing_status") == "failed"}
    marked = by_key(pages.select(F.col("document_id").alias("id"), *[c.alias(n) for n, c in marks.items()]), "id")
    rolled = marked.groupBy("id").agg(*[F.count_if(n).alias(n) for n in marks])
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_open", "n_ocr", "n_failed")}
    error = F.when(F.col("status") == "text_ready", "book_text_ready").when(
        (n["n_open"] == 0) & (n["n_failed"] > 0), "failed_pages_require_retry"
    )
    new = F.when(n["n_ocr"] > 0, "running_ocr").otherwise("extracting_text")
    judged = by_key(documents.select("id", "status"), "id").join(rolled, "id", "left").withColumn("error_code", error)
    return judged.select("id", "error_code", F.when(F.col("error_code").isNull(), new).otherwise(F.col("status")).alias("new_status"))


def _unknown(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """Ids that no document has, once each."""
    nobody = asked.join(by_key(documents.select("id"), "id"), "id", "left_anti").distinct()
    return nobody.select("id", F.lit("book_not_found").alias("error_code"))


def start_text(documents: DataFrame, pages: DataFrame, wanted: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, refused) after text preparation was asked for the documents in
    ``wanted(id)``: those that are admitted take their new status and lose their
    message; ``refused`` has id and error_code, unknown ids too."""
    asked = by_key(wanted.select("id"), "id")
    verdicts = admit_text_job(by_key(documents.select("id", "status"), "id").join(asked, "id", "left_semi"), pages)
    unknown = _unknown(asked, documents)
    granted = verdicts.where("error_code IS NULL").select("id", F.col("new_status").alias("lm_status"))
    moved = _when(documents.join(granted, "id", "left"), F.col("lm_status").isNotNull(), {"status": F.col("lm_status"), "error_message": F.lit(None)}, now)
    return moved.select(*documents.columns), verdicts.where("error_code IS NOT NULL").select("id", "error_code").unionByName(unknown)


def retry_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted pages with verdict and state after the retry request.

    ``wanted``: document_id, page_number. A page that doesn't exist is
    reported, one that hasn't failed is left as it is.
    """
    joined = wanted.join(pages, ["document_id", "page_number"], "left")
    failed = F.col("processing_status") == "failed"
    error = F.when(F.col("processing_status").isNull(), "page_not_found").when(~failed, "page_not_failed")
    return joined.select(
        "document_id", "page_number", error.alias("error_code"),
        F.when(failed, "pending").otherwise(F.col("processing_status")).alias("processing_status"),
        F.when(failed & (F.col("extraction_method") == "ocr"), "running_ocr").when(failed, "extracting_text").alias("document_status"),
    )


def _when(table: DataFrame, condition: Column, changes: dict[str, Column], now: Column | None = None) -> DataFrame:
    """``table`` with columns changed where the condition holds, and with them
    ``updated_at``, to ``now`` (the query's own time if it is None)."""
    hold = F.coalesce(condition, F.lit(False))
    changes = changes | {"updated_at": F.current_timestamp() if now is None else now}
    new = {c: F.when(hold, v.cast(table.schema[c].dataType.simpleString())).otherwise(F.col(c)) for c, v in changes.items() if c in table.columns}
    return table.withColumns(new)


PAGE_KEY = ["document_id", "page_number"]


def retry(documents: DataFrame, pages: DataFrame, wanted: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pages) after the retry requests that ``retry_pages`` grants:
    pages wait again without error and warnings, their documents run."""
    granted = retry_pages(pages, wanted).where(F.col("error_code").isNull())
    marks = granted.select(*PAGE_KEY, F.lit(True).alias("lm_again")).distinct()
    again = _when(
        pages.join(marks, PAGE_KEY, "left"), F.col("lm_again"),
        {"processing_status": F.lit("pending"), "error_message": F.lit(None), "warning_messages": F.array().cast("array<string>")}, now,
    )
    status = F.when(F.bool_or(F.col("document_status") == "running_ocr"), "running_ocr").otherwise("extracting_text")
    runs = granted.groupBy(F.col("document_id").alias("id")).agg(status.alias("lm_status"))
    moved = _when(documents.join(runs, "id", "left"), F.col("lm_status").isNotNull(), {"status": F.col("lm_status"), "error_message": F.lit(None)}, now)
    return moved.select(*documents.columns), again.select(*pages.columns)


def complete_embedded(pages: DataFrame, now: Column | None = None) -> DataFrame:
    """Embedded pages complete if they have text and fail if not."""
    mine = (F.col("extraction_method") == "embedded_text") & F.col("processing_status").isin(*UNFINISHED)
    done = F.when(chars.strip(F.coalesce("extracted_text", F.lit(""))) != "", "completed").otherwise("failed")
    return _when(pages.withColumn("lm_done", done), mine, {"processing_status": F.col("lm_done")}, now).drop("lm_done")


def finalize_text(pages: DataFrame) -> DataFrame:
    """Document status and message once a run over its pages ends."""
    failed = F.count_if(F.col("processing_status") == "failed")
    counted = pages.groupBy("document_id").agg(failed.alias("n"), F.bool_and(F.col("processing_status") == "completed").alias("all_done"))
    message = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " page").otherwise(" pages"), F.lit(" still need attention."))
    return counted.select(
        "document_id",
        F.when(F.col("n") > 0, "failed").when(F.col("all_done"), "text_ready").otherwise("extracting_text").alias("status"),
        F.when(F.col("n") > 0, message).alias("error_message"),
    )


def finalize_audio(segments: DataFrame) -> DataFrame:
    """Status and message after audio; null status means unchanged."""
    failed = F.count_if(F.col("processing_status") == "failed")
    counted = segments.groupBy("document_id").agg(failed.alias("n"), F.bool_and(F.col("processing_status") == "completed").alias("all_done"))
    message = F.concat(
        F.col("n").cast("string"), F.when(F.col("n") == 1, " audio segment").otherwise(" audio segments"), F.lit(" need another try.")
    )
    return counted.select(
        "document_id",
        F.when(F.col("n") > 0, "failed").when(F.col("all_done"), "ready").alias("status"),
        F.when(F.col("n") > 0, message).alias("error_message"),
    )


def edit_text(documents: DataFrame, pages: DataFrame, segments: DataFrame, edits: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, pages, segments, refused) after manual texts.

    ``edits``: document_id, page_number, new_text and perhaps requested_at. An
    edited page is complete, without error and warnings; its document loses its
    segments and is ready if all its pages are complete, else failed with the
    number of failed ones. ``refused`` has the edits that are blank or name no
    page, and all but the last of a page's good ones, with error_code.
    """
    clean = edits.withColumn("new_text", chars.strip(F.col("new_text")))
    known = pages.select(*PAGE_KEY).distinct().withColumn("lm_known", F.lit(True))
    blank = F.coalesce(F.col("new_text") == "", F.lit(True))
    error = F.when(blank, "page_text_required").when(F.col("lm_known").isNull(), "page_not_found")
    judged = clean.join(known, PAGE_KEY, "left").withColumn("error_code", error).drop("lm_known")
    good, others = last_requests(judged.where("error_code IS NULL").drop("error_code"), PAGE_KEY)
    refused = judged.where("error_code IS NOT NULL").unionByName(others.drop("times"))
    new = _when(
        pages.join(good.select(*PAGE_KEY, "new_text"), PAGE_KEY, "left"), F.col("new_text").isNotNull(),
        {"extracted_text": F.col("new_text"), "processing_status": F.lit("completed"), "error_message": F.lit(None), "warning_messages": F.array().cast("array<string>")}, now,
    ).select(*pages.columns)
    touched = good.select("document_id").distinct()
    n = F.count_if(F.col("processing_status") == "failed")
    counted = new.join(touched, "document_id", "left_semi").groupBy(F.col("document_id").alias("id")).agg(
        n.alias("lm_failed"), F.bool_and(F.col("processing_status") == "completed").alias("lm_done")
    )
    message = F.when(~F.col("lm_done"), F.concat(F.col("lm_failed").cast("string"), F.when(F.col("lm_failed") == 1, " page").otherwise(" pages"), F.lit(" still need attention.")))
    moved = _when(
        documents.join(counted, "id", "left"), F.col("lm_done").isNotNull(),
        {"status": F.when(F.col("lm_done"), "text_ready").otherwise("failed"), "error_message": message}, now,
    ).select(*documents.columns)
    return moved, new, segments.join(touched, "document_id", "left_anti"), refused


def mark_interrupted(documents: DataFrame, pages: DataFrame, segments: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, segments) after a restart: documents of running jobs
    fail with the job's message, and with them what the job had still to do."""
    text, audio = F.col("status").isin(*TEXT_RUNNING), F.col("status").isin(*AUDIO_RUNNING)
    stopped = documents.where(text | audio).select(F.col("id").alias("document_id"), text.alias("lm_text"))
    message = F.when(text, TEXT_STOPPED).otherwise(AUDIO_STOPPED)
    failed = _when(documents.withColumn("lm_message", message), text | audio, {"error_message": F.col("lm_message"), "status": F.lit("failed")}, now)

    def fail(table: DataFrame, of_text: bool, open_: tuple[str, ...], said: str) -> DataFrame:
        mine = stopped.where(F.col("lm_text") == of_text).select("document_id", F.lit(True).alias("lm_stopped"))
        hit = F.col("lm_stopped") & F.col("processing_status").isin(*open_)
        changed = _when(table.join(mine, "document_id", "left"), hit, {"error_message": F.lit(said), "processing_status": F.lit("failed")}, now)
        return changed.select(*table.columns)

    return failed.select(*documents.columns), fail(pages, True, UNFINISHED, TEXT_STOPPED), fail(segments, False, UNSPOKEN, AUDIO_STOPPED)


def recover_segments(segments: DataFrame, files: DataFrame, extension: str = "mp3", now: Column | None = None, resumed: DataFrame | None = None) -> DataFrame:
    """Segments of resumed audio jobs: those whose file exists complete, others
    that were generating or failed wait again, both without error message.

    ``files``: document_id, path of the audio that is there. ``resumed``: the
    document_id of the jobs that resume (all if None); other segments stay.
    """
    if resumed is None:
        asked = segments.withColumn("lm_resumed", F.lit(True))
    else:
        asked = segments.join(resumed.select("document_id", F.lit(True).alias("lm_resumed")).distinct(), "document_id", "left")
    return _recovered(asked, files, extension, now).select(*segments.columns)


def _recovered(segments: DataFrame, files: DataFrame, extension: str, now: Column | None) -> DataFrame:
    """``recover_segments`` of those that lm_resumed marks. Segments and files
    meet in a window over both, which leaves them where they are if they are
    dealt by document; a join by document and path would shuffle both again."""
    fallback = F.concat(F.lit("audio/"), F.format_string(f"segment-%04d.{extension}", "segment_number"))
    path = F.coalesce(F.nullif("audio_storage_path", F.lit("")), fallback)
    document, kind = F.col("document_id"), segments.schema["document_id"].dataType
    if files.schema["document_id"].dataType != kind:
        document = document.cast(kind).alias("document_id")
    there = files.select(document, F.col("path").alias("lm_path"), F.lit(True).alias("lm_file"))
    both = segments.withColumns({"lm_path": path, "lm_file": F.lit(False)}).unionByName(there, allowMissingColumns=True)
    met = F.bool_or("lm_file").over(Window.partitionBy("document_id", "lm_path"))
    joined = both.withColumn("lm_there", met).where(~F.col("lm_file"))
    found = F.col("lm_there") & F.col("document_id").isNotNull()
    hit = F.col("lm_resumed") & (found | F.col("processing_status").isin("generating", "failed"))
    changes = {
        "audio_storage_path": F.when(found, F.col("lm_path")), "error_message": F.lit(None),
        "processing_status": F.when(found, "completed").otherwise("pending"),
    }
    return _when(joined, hit, changes, now)


def _audio_verdicts(documents: DataFrame, pages: DataFrame, segments: DataFrame, drafts: DataFrame, files: DataFrame) -> DataFrame:
    """id, error_code, new_status and whether a job resumes (lm_resume)."""
    done = by_key(pages.select(F.col("document_id").alias("id"), (F.col("processing_status") == "completed").alias("lm_done")), "id")
    p = done.groupBy("id").agg(F.bool_and("lm_done").alias("pages_done"))
    s = recover_segments(segments, files).groupBy(F.col("document_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_segments"), F.bool_and(F.col("processing_status") == "completed").alias("audio_done")
    )
    d = drafts.select(F.col("document_id").alias("id"), "drafts")
    j = by_key(documents.select("id", "status"), "id").join(p, "id", "left").join(s, "id", "left").join(d, "id", "left")
    has, done = F.coalesce("n_segments", F.lit(0)) > 0, F.coalesce("pages_done", F.lit(True))
    resume = F.col("status").isin("failed", "generating_audio") & has & done
    error = (
        F.when((F.col("status") == "ready") & has, "book_audio_ready")
        .when(resume, None)
        .when(F.col("status") != "text_ready", "book_text_not_ready")
        .when(~done, "pages_not_ready")
        .when(F.coalesce("drafts", F.lit(0)) == 0, "no_text_to_read")
    )
    new = F.when(resume & F.col("audio_done"), "ready").otherwise("generating_audio")
    judged = j.withColumns({"error_code": error, "lm_resume": F.coalesce(resume, F.lit(False))})
    return judged.select("id", "error_code", F.when(F.col("error_code").isNull(), new).otherwise(F.col("status")).alias("new_status"), "lm_resume")


def admit_audio_job(documents: DataFrame, pages: DataFrame, segments: DataFrame, drafts: DataFrame, files: DataFrame) -> DataFrame:
    """id, error_code, new_status for starting or resuming audio.

    ``drafts``: document_id and number of segments the text would give.
    """
    return _audio_verdicts(documents, pages, segments, drafts, files).drop("lm_resume")


def start_audio(documents: DataFrame, pages: DataFrame, segments: DataFrame, drafts: DataFrame, files: DataFrame, wanted: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, segments, refused) after audio was asked for the documents in
    ``wanted(id)``.

    ``drafts``: document_id, segment_number, page_id, source_text, what the
    segmenter makes of the pages. A job that starts anew takes its drafts as
    segments in place of what it had; one that resumes recovers its own. Both
    documents lose their message. ``refused``: id, error_code.
    """
    at = F.current_timestamp() if now is None else now
    number = drafts.groupBy("document_id").agg(F.count(F.lit(1)).alias("drafts"))
    asked = by_key(wanted.select("id"), "id")
    verdicts = _audio_verdicts(documents, pages, segments, number, files).join(asked, "id", "left_semi")
    unknown = _unknown(asked, documents)
    granted = verdicts.where("error_code IS NULL")
    fresh = granted.where(~F.col("lm_resume")).select(F.col("id").alias("document_id"))
    jobs = granted.groupBy(F.col("id").alias("document_id")).agg(F.bool_and("lm_resume").alias("lm_resumed"))
    own = segments.join(jobs, "document_id", "left").where(F.coalesce("lm_resumed", F.lit(True)))
    kept = _recovered(own, files, "mp3", now).select(*segments.columns)
    made = drafts.join(fresh, "document_id").withColumns(
        {"id": F.concat_ws("/", "document_id", "segment_number"), "processing_status": F.lit("pending"), "created_at": at, "updated_at": at}
    )
    blank = {f.name: F.lit(None).cast(f.dataType) for f in segments.schema.fields if f.name not in made.columns}
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in segments.schema.fields]
    started = kept.unionByName(made.withColumns(blank).select(*typed) if blank else made.select(*typed))
    status = granted.select("id", F.col("new_status").alias("lm_status"))
    moved = _when(documents.join(status, "id", "left"), F.col("lm_status").isNotNull(), {"status": F.col("lm_status"), "error_message": F.lit(None)}, now)
    return moved.select(*documents.columns), started, verdicts.where("error_code IS NOT NULL").select("id", "error_code").unionByName(unknown)


def crop_edit_error(document_status: Column, page_status: Column, method: Column, processed_path: Column) -> Column:
    """Why a crop can't be edited, or null."""
    return F.when((method != "ocr") | processed_path.isNull(), "page_crop_unavailable").when(
        (document_status != "uploaded") | (page_status != "pending"), "page_crop_not_editable"
    )


def edit_crops(documents: DataFrame, pages: DataFrame, edits: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, refused) after crop edits: a page whose crop may be edited takes
    it, loses its text and error, and waits.

    ``edits``: document_id, page_number, new_left, new_top, new_right,
    new_bottom and perhaps requested_at. ``pages`` has processed_image_path;
    ``refused``, which has all but the last edit of a page too, error_code.
    """
    state = documents.select(F.col("id").alias("document_id"), F.col("status").alias("lm_status"))
    path = F.col("processed_image_path")
    judged = edits.join(pages.select(*PAGE_KEY, "processing_status", "extraction_method", path, F.lit(True).alias("lm_known")), PAGE_KEY, "left")
    error = F.when(F.col("lm_known").isNull(), "page_not_found").otherwise(
        crop_edit_error(F.col("lm_status"), F.col("processing_status"), F.col("extraction_method"), path)
    )
    judged = judged.join(state, "document_id", "left").withColumn("error_code", error).select(*edits.columns, "error_code")
    good, others = last_requests(judged.where("error_code IS NULL").drop("error_code"), PAGE_KEY)
    good = good.drop("requested_at").withColumn("lm_new", F.lit(True))
    sides = {f"crop_{side}": F.col(f"new_{side}") for side in ("left", "top", "right", "bottom")}
    rest = {"extracted_text": F.lit(""), "error_message": F.lit(None), "processing_status": F.lit("pending")}
    return _when(pages.join(good, PAGE_KEY, "left"), F.col("lm_new"), sides | rest, now).select(*pages.columns), judged.where("error_code IS NOT NULL").unionByName(others.drop("times"))


# The states in which page text is being prepared.
PREPARING = ("normalizing_pages", "inspecting", "extracting_text", "running_ocr")


def resume_flags(documents: DataFrame, pages: DataFrame, segments: DataFrame) -> DataFrame:
    """id and what the views of a document offer: whether it waits for a review
    of its recognised pages, is preparing text, can go on with text, and can go
    on with or start audio in the document's view and in the player.

    ``documents``: id, status, processing_active.
    """
    p = pages.groupBy(F.col("document_id").alias("id")).agg(
        F.bool_or(F.col("extraction_method") == "ocr").alias("ocr"),
        F.bool_or(F.col("processing_status") == "failed").alias("failed"),
        F.bool_and(F.col("processing_status") == "completed").alias("done"),
    )
    s = segments.groupBy(F.col("document_id").alias("id")).agg(F.lit(True).alias("spoken"))
    j = documents.select("id", "status", "processing_active").join(p, "id", "left").join(s, "id", "left")
    ocr, failed, done, spoken = (F.coalesce(c, F.lit(d)) for c, d in (("ocr", False), ("failed", False), ("done", True), ("spoken", False)))
    idle = ~F.coalesce("processing_active", F.lit(False))
    status = F.coalesce("status", F.lit(""))
    uploaded, preparing, speaking, broken = status == "uploaded", status.isin(*PREPARING), status == "generating_audio", status == "failed"
    again, listen = (speaking & idle) | (broken & ~failed & spoken & done), (speaking & idle) | (broken & spoken)
    return j.select(
        "id", (uploaded & ocr).alias("awaiting_review"), ((uploaded & ~ocr) | preparing).alias("preparing_text"), (preparing & idle).alias("can_resume_text"),
        again.alias("can_resume_audio"), ((status == "text_ready") | again).alias("can_start_audio"),
        listen.alias("player_can_resume"), ((status == "text_ready") | listen).alias("player_can_start"),
    )


def move_part(current: Column, by: int, parts: Column) -> tuple[Column, Column, Column]:
    """Segment, position and completion after previous or next; out of bounds
    changes nothing."""
    to = current + by
    valid = to.between(1, parts)
    return F.when(valid, to).otherwise(current), F.when(valid, 0.0), F.when(valid, False)
