"""Library listing, folders, details, audio views and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import chars
from leafmill.operators import library, lifecycle, timeline
from leafmill.plans.catalogue import query
from leafmill.sources import fixtures as fx
from leafmill.sources import store
from leafmill.streaming import progress

_STRIP = f"regexp_replace(title, '^[{chars.SPACE}]+|[{chars.SPACE}]+$', '', 'g')"
_RANK = "list_position([" + ", ".join(f"'{s}'" for s in library.PRIORITY) + "], status)"
_FOLDERED = f"""{fx.RECORDINGS_SQL}, keyed AS (
  SELECT *, replace(lower({_STRIP}), 'ß', 'ss') AS k, coalesce(library_document_id <> id, false) AS assigned FROM recordings),
foldered AS (
  SELECT *, CASE WHEN assigned THEN library_document_id ELSE
    first_value(id) OVER (PARTITION BY user_id, k, assigned ORDER BY created_at, updated_at DESC, id) END AS folder_id FROM keyed)"""


@query(
    f"""WITH {_FOLDERED} SELECT user_id, folder_id, first(title ORDER BY updated_at DESC, id DESC) AS title, count(*) AS recording_count,
    CAST(sum(total_pages) AS BIGINT) AS total_pages, bool_or(status IN {library.ACTIVE}) AS processing_active,
    coalesce(string_agg(DISTINCT target_language, ',' ORDER BY target_language), '') AS target_languages,
    max(updated_at) AS latest_recording_at,
    list_extract([{", ".join(f"'{s}'" for s in library.PRIORITY)}], min({_RANK})) AS processing_status
    FROM foldered GROUP BY user_id, folder_id"""
)
def library_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.folders(fx.recordings(spark, sf_dir))


@query(
    f"""WITH {_FOLDERED}, f AS (SELECT user_id, folder_id, max(updated_at) AS latest_recording_at FROM foldered GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY latest_recording_at DESC, folder_id) AS INT) AS place FROM f"""
)
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.folder_listing(fx.recordings(spark, sf_dir)).select("user_id", "folder_id", "latest_recording_at", "place")


@query(
    f"""WITH {_FOLDERED}, placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, folder_id ORDER BY updated_at DESC, id DESC) AS p FROM foldered)
    SELECT user_id, folder_id, CAST(p AS INT) AS position, id, coalesce(recording_title, original_filename, 'Recording ' || p) AS display_title, status FROM placed"""
)
def folder_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.folder_members(fx.recordings(spark, sf_dir))


@query(f"WITH {fx.RECORDINGS_SQL} SELECT id, title, status FROM recordings WHERE user_id = 7")
def owner_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.owned_by(fx.recordings(spark, sf_dir), 7).select("id", "title", "status")


_ASKED = "SELECT o_orderkey * 2 AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 100 END AS asker FROM orders"


@query(
    f"""WITH {fx.RECORDINGS_SQL}, asked AS ({_ASKED}), j AS (SELECT a.id, asker, r.user_id, status, r.id IS NOT NULL AND (asker IS NULL OR coalesce(r.user_id = asker, false)) AS mine
      FROM asked a LEFT JOIN recordings r ON r.id = a.id)
    SELECT id, asker, CASE WHEN mine THEN user_id END AS user_id, CASE WHEN mine THEN status END AS status, CASE WHEN NOT mine THEN 'book_not_found' END AS error_code FROM j"""
)
def authorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey * 2 AS id", "CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 100 END AS asker")
    return library.authorize(fx.recordings(spark, sf_dir).select("id", "user_id", "status"), asked)


@query(
    f"""WITH {fx.PAGES_SQL} SELECT document_id, count(*) AS pages, count(*) FILTER (WHERE processing_status = 'completed') AS completed_pages,
    count(*) FILTER (WHERE processing_status = 'failed') AS failed_pages FROM pages_ GROUP BY document_id"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.page_counts(fx.pages(spark, sf_dir))


@query(
    """SELECT conv_id AS id, count(*) FILTER (WHERE role = 'user') AS completed_pages, CAST(0 AS BIGINT) AS failed_pages,
    CAST(sum(length(text)) AS BIGINT) AS characters, string_agg(CAST(turn + 1 AS INT), ',' ORDER BY turn) AS page_numbers,
    count(*) FILTER (WHERE turn % 2 = 1) AS audio_segment_count FROM conversations GROUP BY conv_id"""
)
def page_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.conversations(spark, sf_dir).select(
        "document_id", "page_number", F.when(F.col("role") == "user", "completed").otherwise("pending").alias("processing_status"), F.col("text").alias("extracted_text")
    )
    segments = fx.conversations(spark, sf_dir).where("page_number % 2 = 0").select("document_id", F.col("page_number").alias("segment_number"))
    return library.document_detail(pages.select(F.col("document_id").alias("id")).distinct(), pages, segments)


@query(
    f"""WITH {fx.PAGES_SQL} SELECT document_id, page_number, extraction_method, extracted_text, CAST(length(extracted_text) AS INT) AS extracted_character_count, processing_status,
    error_message, array_to_string(warning_messages, '|') AS warnings FROM pages_"""
)
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = library.page_records(fx.pages(spark, sf_dir))
    return shown.select(
        "document_id", "page_number", "extraction_method", "extracted_text", "extracted_character_count", "processing_status", "error_message", F.array_join("warning_messages", "|").alias("warnings")
    )


@query(
    f"""WITH {_FOLDERED}, {fx.PAGES_SQL}, {fx.SEGMENTS_SQL}, p AS (SELECT document_id, count(*) FILTER (WHERE processing_status = 'completed') AS c, count(*) FILTER (WHERE processing_status = 'failed') AS f FROM pages_ GROUP BY 1),
    s AS (SELECT document_id, count(*) AS n FROM segments GROUP BY 1)
    SELECT id, user_id, folder_id AS library_book_id, title, recording_title, status, coalesce(p.c, 0) AS completed_pages, coalesce(p.f, 0) AS failed_pages, coalesce(s.n, 0) AS audio_segment_count,
    status IN {library.ACTIVE} AS processing_active FROM foldered LEFT JOIN p ON p.document_id = id LEFT JOIN s ON s.document_id = id"""
)
def library_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = library.library_items(fx.recordings(spark, sf_dir), fx.pages(spark, sf_dir), fx.segments(spark, sf_dir))
    return items.select("id", "user_id", "library_book_id", "title", "recording_title", "status", "completed_pages", "failed_pages", "audio_segment_count", "processing_active")


@query(
    f"""WITH {fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, {fx.SEGMENTS_SQL},
    p AS (SELECT document_id, count(*) n, string_agg(processing_status, ',' ORDER BY page_number) s FROM pages_ GROUP BY 1),
    g AS (SELECT document_id, count(*) n, string_agg(coalesce(audio_storage_path, '-'), ',' ORDER BY segment_number) s FROM segments GROUP BY 1)
    SELECT r.id, coalesce(p.n, 0) AS n_pages, coalesce(g.n, 0) AS n_segments, coalesce(p.s, '') AS page_states, coalesce(g.s, '') AS paths
    FROM recordings r LEFT JOIN p ON p.document_id = r.id LEFT JOIN g ON g.document_id = r.id"""
)
def nested_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = library.assemble(
        fx.recordings(spark, sf_dir).select("id"),
        fx.pages(spark, sf_dir).select("document_id", "page_number", "processing_status"),
        fx.segments(spark, sf_dir).select("document_id", "segment_number", "audio_storage_path"),
    )
    return whole.select(
        "id", F.size("pages").cast("long").alias("n_pages"), F.size("audio_segments").cast("long").alias("n_segments"),
        F.array_join(F.transform("pages", lambda p: p["processing_status"]), ",").alias("page_states"),
        F.array_join(F.transform("audio_segments", lambda s: F.coalesce(s["audio_storage_path"], F.lit("-"))), ",").alias("paths"),
    )


@query(
    f"""WITH {fx.SEGMENTS_SQL} SELECT document_id, segment_number, audio_storage_path FROM segments
    WHERE processing_status = 'completed' AND audio_storage_path IS NOT NULL"""
)
def ready_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.ready_segments(fx.segments(spark, sf_dir)).select("document_id", "segment_number", "audio_storage_path")


@query(
    f"""WITH {fx.SEGMENTS_SQL}, {fx.PAGES_SQL} SELECT s.document_id, s.segment_number, p.page_number, nullif(s.audio_storage_path, '') AS audio_storage_path
    FROM segments s LEFT JOIN pages_ p ON p.document_id = s.document_id AND p.page_number = s.page_number"""
)
def segment_page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", "document_id", "page_number")
    segments = fx.segments(spark, sf_dir).withColumn("page_id", F.when(F.col("page_number").isNotNull(), key)).drop("page_number")
    pages = fx.pages(spark, sf_dir).select(key.alias("id"), "page_number")
    return library.audio_view(segments, pages).select("document_id", "segment_number", "page_number", "audio_storage_path")


@query(f"WITH {fx.RECORDINGS_SQL} SELECT id, user_id FROM recordings WHERE status = 'ready' AND segment_count > 0")
def downloadable_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.downloadable(fx.recordings(spark, sf_dir)).select("id", "user_id")


@query(
    f"""WITH {fx.SEGMENTS_SQL} SELECT document_id, segment_number, audio_storage_path,
    printf('part-%03d', segment_number) || CASE WHEN audio_storage_path LIKE '%.mp3' THEN '.mp3' ELSE '.wav' END AS member FROM segments
    WHERE processing_status = 'completed' AND audio_storage_path IS NOT NULL"""
)
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.archive_manifest(fx.segments(spark, sf_dir))


@query(
    f"""WITH {_FOLDERED}, {fx.SEGMENTS_SQL} SELECT f.user_id, f.folder_id, s.document_id, s.segment_number,
    CAST(row_number() OVER (PARTITION BY f.user_id, f.folder_id ORDER BY f.created_at, s.document_id, s.segment_number) AS INT) AS part
    FROM segments s JOIN foldered f ON f.id = s.document_id WHERE s.processing_status = 'completed' AND s.audio_storage_path IS NOT NULL"""
)
def combined_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = library.combined_manifest(fx.recordings(spark, sf_dir), fx.segments(spark, sf_dir))
    return whole.select("user_id", "folder_id", "document_id", "segment_number", "part")


@query(
    f"""SELECT source, CASE WHEN bool_and(c) THEN 'text' WHEN NOT bool_or(c) THEN 'scanned' ELSE 'mixed' END AS kind, count(*) AS pages
    FROM (SELECT source, length(regexp_replace(text, '[{chars.SPACE}]+', '', 'g')) >= 20 AS c FROM documents) GROUP BY source"""
)
def document_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").withColumn("classification", chars.page_classification(F.col("text")))
    return library.document_kind(docs, ["source"])


_SAVED = """SELECT event_id, ts, user_id, event_type AS document_id, CAST(event_id % 5 + 1 AS INT) AS segment_number, round(value, 3) AS position_seconds,
  CAST(event_id % 26 AS DOUBLE) / 10 + 0.5 AS playback_speed, event_id % 4 = 0 AS ended, 5 AS parts FROM events"""
_TRANSITION = f"""saved AS (SELECT user_id, document_id, ts, event_id, playback_speed,
  CASE WHEN ended AND segment_number < parts THEN segment_number + 1 ELSE segment_number END AS current_segment_number,
  CASE WHEN ended THEN 0.0 ELSE position_seconds END AS position_seconds, ended AND segment_number >= parts AS completed FROM ({_SAVED}))"""


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id", "ts", "user_id", "event_type AS document_id", "CAST(event_id % 5 + 1 AS INT) AS segment_number", "round(value, 3) AS position_seconds",
        "CAST(event_id % 26 AS DOUBLE) / 10 + 0.5 AS playback_speed", "event_id % 4 = 0 AS ended", "5 AS parts",
    )


@query(
    f"""WITH {_TRANSITION}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, document_id ORDER BY ts DESC, event_id DESC) AS k FROM saved)
    SELECT user_id, document_id, ts, event_id, CAST(current_segment_number AS INT) AS current_segment_number, CAST(position_seconds AS DOUBLE) AS position_seconds, playback_speed, completed FROM r WHERE k = 1"""
)
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.latest(progress.transition(progress_events(spark, sf_dir)))


@query(
    f"""WITH {_TRANSITION} SELECT user_id, document_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, document_id ORDER BY ts DESC, event_id DESC) AS INT) AS version FROM saved"""
)
def progress_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.history(progress.transition(progress_events(spark, sf_dir))).select("user_id", "document_id", "event_id", "version")


@query(
    f"""WITH {_TRANSITION}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM saved), one AS (SELECT * FROM r WHERE k = 1)
    SELECT c_custkey AS id, CAST(current_segment_number AS INT) AS current_segment_number, CAST(position_seconds AS DOUBLE) AS position_seconds, completed FROM customer LEFT JOIN one ON user_id = c_custkey"""
)
def progress_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = progress.transition(progress_events(spark, sf_dir).withColumn("document_id", F.lit("")))
    newest = progress.latest(saved).withColumn("document_id", F.col("user_id"))
    return library.with_progress(fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), newest)


@query(
    f"""WITH {fx.PAGES_SQL} SELECT document_id, CAST(floor(100.0 * count(*) FILTER (WHERE processing_status = 'completed') / count(*) + 0.5) AS INT) AS percent
    FROM pages_ GROUP BY document_id"""
)
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = library.page_counts(fx.pages(spark, sf_dir))
    return counted.select("document_id", library.progress_percent(F.col("completed_pages"), F.col("pages")).alias("percent"))


@query(
    """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.windowed_counts(fx.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


_HOT = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END"


@query(
    f"""WITH e AS (SELECT {_HOT} AS who, ts, value FROM events), o AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL '3' HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM e WINDOW w AS (PARTITION BY who ORDER BY ts)),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY who ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT who, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events, round(sum(value), 4) AS total FROM n GROUP BY who, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, a third of all events having none."""
    events = fx.table(spark, sf_dir, "events").withColumn("who", F.expr(_HOT))
    return timeline.sessions(events, ["who"], "ts", "3 HOURS", "value").withColumn("total", F.round("total", 4))


@query(
    f"""WITH {_TRANSITION}, v AS (SELECT user_id, ts, event_id AS version, position_seconds, completed FROM saved WHERE event_id % 3 = 0)
    SELECT e.event_id, e.user_id, CAST(v.version AS BIGINT) AS version, CAST(v.position_seconds AS DOUBLE) AS position_seconds, v.completed FROM events e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts"""
)
def progress_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the progress its user had saved by then."""
    saved = progress.transition(progress_events(spark, sf_dir)).where("event_id % 3 = 0")
    versions = saved.select("user_id", "ts", F.col("event_id").alias("version"), "position_seconds", "completed")
    events = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    joined = timeline.as_of(events, versions, ["user_id"], "ts", ["version", "position_seconds", "completed"], "version")
    return joined.drop("ts")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    """SELECT event_id, CAST(event_id % 5 + 1 AS INT) AS segment, CAST(event_id % 100 AS DOUBLE) / 4 AS position, event_id % 3 = 0 AS completed FROM events WHERE event_id % 7 > 0
    UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_id % 7 = 0"""
)
def saved_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress as players keep it, some of it broken."""
    saved = F.to_json(F.expr("named_struct('segmentNumber', CAST(event_id % 5 + 1 AS INT), 'positionSeconds', CAST(event_id % 100 AS DOUBLE) / 4, 'completed', event_id % 3 = 0)"))
    text = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(saved)
    r = progress.parse_saved(text)
    return fx.table(spark, sf_dir, "events").select("event_id", r["segmentNumber"].alias("segment"), r["positionSeconds"].alias("position"), r["completed"].alias("completed"))


_SPOKEN_LANGUAGE = "CASE WHEN o_orderkey % 7 = 0 THEN 'esperanto' WHEN o_orderkey % 3 = 0 THEN 'cantonese' WHEN o_orderkey % 5 = 0 THEN 'english' WHEN o_orderkey % 4 = 0 THEN 'mandarin' END"


@query(
    f"""WITH x AS (SELECT o_custkey, list_sort(list_distinct(list({_SPOKEN_LANGUAGE}))) AS l FROM orders GROUP BY 1),
    k AS (SELECT o_custkey, list_transform(list_filter(l, lambda c: c IN ('cantonese', 'mandarin', 'english')), lambda c: upper(c[1]) || c[2:]) AS l FROM x)
    SELECT o_custkey, CASE WHEN len(l) = 0 THEN 'Language not set' WHEN len(l) <= 2 THEN array_to_string(l, ', ') ELSE len(l) || ' languages' END AS summary FROM k"""
)
def language_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = fx.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.expr(_SPOKEN_LANGUAGE))).alias("l"))
    return grouped.select("o_custkey", library.language_summary(F.col("l")).alias("summary"))


@query(f"WITH {fx.RECORDINGS_SQL} SELECT id, user_id FROM recordings WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def related_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return store.related(fx.recordings(spark, sf_dir), keys, "user_id").select("id", "user_id")


@query(f"WITH {fx.RECORDINGS_SQL} SELECT id, status FROM recordings WHERE id = 5")
def point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.point_read(fx.recordings(spark, sf_dir), "id", 5).select("id", "status")


@query(f"WITH {fx.PAGES_SQL} SELECT document_id, page_number, processing_status FROM pages_ WHERE processing_status IN {lifecycle.UNFINISHED}")
def resume_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.unfinished(fx.pages(spark, sf_dir)).select("document_id", "page_number", "processing_status")
