"""Job admission, finalisation, retries and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import chars
from leafmill.operators import lifecycle
from leafmill.plans import shared
from leafmill.plans.catalogue import query
from leafmill.sources import fixtures as fx
from leafmill.sources import graph
from leafmill.streaming import job

_OPEN = f"processing_status IN {lifecycle.UNFINISHED}"


@query(
    f"""WITH {fx.PAGES_SQL}, c AS (SELECT document_id, count(*) FILTER (WHERE processing_status = 'failed') n, bool_and(processing_status = 'completed') d FROM pages_ GROUP BY 1)
    SELECT document_id, CASE WHEN n > 0 THEN 'failed' WHEN d THEN 'text_ready' ELSE 'extracting_text' END AS status,
    CASE WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' page' ELSE ' pages' END || ' still need attention.' END AS error_message FROM c"""
)
def finalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.finalize_text(fx.pages(spark, sf_dir))


@query(
    f"""WITH {fx.SEGMENTS_SQL}, c AS (SELECT document_id, count(*) FILTER (WHERE processing_status = 'failed') n, bool_and(processing_status = 'completed') d FROM segments GROUP BY 1)
    SELECT document_id, CASE WHEN n > 0 THEN 'failed' WHEN d THEN 'ready' END AS status,
    CASE WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' audio segment' ELSE ' audio segments' END || ' need another try.' END AS error_message FROM c"""
)
def finalize_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.finalize_audio(fx.segments(spark, sf_dir))


@query(
    f"""WITH {fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, c AS (SELECT document_id, count(*) FILTER (WHERE {_OPEN}) o,
      count(*) FILTER (WHERE {_OPEN} AND extraction_method = 'ocr') r, count(*) FILTER (WHERE processing_status = 'failed') f FROM pages_ GROUP BY 1),
    j AS (SELECT id, status, coalesce(o, 0) o, coalesce(r, 0) r, coalesce(f, 0) f FROM recordings LEFT JOIN c ON document_id = id),
    e AS (SELECT *, CASE WHEN status = 'text_ready' THEN 'book_text_ready' WHEN o = 0 AND f > 0 THEN 'failed_pages_require_retry' END AS error_code FROM j)
    SELECT id, error_code, CASE WHEN error_code IS NOT NULL THEN status WHEN r > 0 THEN 'running_ocr' ELSE 'extracting_text' END AS new_status FROM e"""
)
def job_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.admit_text_job(fx.recordings(spark, sf_dir), fx.pages(spark, sf_dir))


@query(
    f"""WITH {fx.PAGES_SQL}, w AS (SELECT o_orderkey AS document_id, CAST(o_orderkey % 4 + 1 AS INT) AS page_number FROM orders)
    SELECT w.document_id, w.page_number, CASE WHEN processing_status IS NULL THEN 'page_not_found' WHEN processing_status <> 'failed' THEN 'page_not_failed' END AS error_code,
    CASE WHEN processing_status = 'failed' THEN 'pending' ELSE processing_status END AS processing_status,
    CASE WHEN processing_status = 'failed' THEN CASE WHEN extraction_method = 'ocr' THEN 'running_ocr' ELSE 'extracting_text' END END AS document_status
    FROM w LEFT JOIN pages_ p ON p.document_id = w.document_id AND p.page_number = w.page_number"""
)
def retry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS document_id", "CAST(o_orderkey % 4 + 1 AS INT) AS page_number")
    return lifecycle.retry_pages(fx.pages(spark, sf_dir), wanted)


_BLANK = f"regexp_replace(extracted_text, '^[{chars.SPACE}]+|[{chars.SPACE}]+$', '', 'g') = ''"


@query(
    f"""WITH {fx.PAGES_SQL} SELECT document_id, page_number, CASE WHEN extraction_method = 'embedded_text' AND {_OPEN}
    THEN CASE WHEN {_BLANK} THEN 'failed' ELSE 'completed' END ELSE processing_status END AS processing_status FROM pages_"""
)
def complete_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.complete_embedded(fx.pages(spark, sf_dir)).select("document_id", "page_number", "processing_status")


_FAIL = "(processing_status = 'failed')"
_STATES = f"""docs AS (SELECT id, status, CASE WHEN status = 'failed' THEN 'broken' END AS error_message FROM recordings)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.recordings(spark, sf_dir).select("id", "status", F.when(F.col("status") == "failed", "broken").alias("error_message"))


_WANTED = "SELECT o_orderkey AS document_id, CAST(o_orderkey % 4 + 1 AS INT) AS page_number FROM orders"
_RETRIED = f"""{fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, {_STATES}, g AS (SELECT p.document_id, p.page_number, p.extraction_method FROM pages_ p JOIN ({_WANTED}) w
  ON w.document_id = p.document_id AND w.page_number = p.page_number WHERE {_FAIL})"""


def _retried(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wanted = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS document_id", "CAST(o_orderkey % 4 + 1 AS INT) AS page_number")
    return lifecycle.retry(_documents(spark, sf_dir), fx.pages(spark, sf_dir), wanted)


@query(
    f"""WITH {_RETRIED} SELECT d.id, CASE WHEN g.document_id IS NULL THEN status WHEN extraction_method = 'ocr' THEN 'running_ocr' ELSE 'extracting_text' END AS status,
    CASE WHEN g.document_id IS NULL THEN error_message END AS error_message FROM docs d LEFT JOIN g ON g.document_id = d.id"""
)
def retry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retried(spark, sf_dir)[0]


@query(
    f"""WITH {_RETRIED} SELECT p.document_id, p.page_number, CASE WHEN g.document_id IS NULL THEN processing_status ELSE 'pending' END AS processing_status,
    CASE WHEN g.document_id IS NULL THEN error_message END AS error_message, CASE WHEN g.document_id IS NULL THEN array_to_string(warning_messages, '|') ELSE '' END AS warnings
    FROM pages_ p LEFT JOIN g ON g.document_id = p.document_id AND g.page_number = p.page_number"""
)
def retry_page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _retried(spark, sf_dir)[1]
    return pages.select("document_id", "page_number", "processing_status", "error_message", F.array_join("warning_messages", "|").alias("warnings"))


_EDITS = "SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 15 = 0 THEN 99 ELSE 1 END AS page_number, CASE WHEN o_orderkey % 6 = 0 THEN '  ' ELSE concat(' Edited ', o_orderkey, ' ') END AS new_text FROM orders WHERE o_orderkey % 3 = 0"
_EDITED = f"""{fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, {_STATES}, edits AS ({_EDITS}),
e AS (SELECT document_id, page_number, trim(new_text) AS t FROM edits WHERE trim(new_text) <> '' AND (document_id, page_number) IN (SELECT (document_id, page_number) FROM pages_)),
edited AS (SELECT p.document_id, p.page_number, coalesce(t, extracted_text) AS extracted_text, CASE WHEN t IS NOT NULL THEN 'completed' ELSE processing_status END AS processing_status,
  CASE WHEN t IS NULL THEN error_message END AS error_message, CASE WHEN t IS NULL THEN array_to_string(warning_messages, '|') ELSE '' END AS warnings
  FROM pages_ p LEFT JOIN e ON e.document_id = p.document_id AND e.page_number = p.page_number)"""


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    fx.table(spark, sf_dir, "orders").createOrReplaceTempView("leafmill_orders")
    edits = spark.sql(_EDITS.replace("FROM orders", "FROM leafmill_orders"))
    return lifecycle.edit_text(_documents(spark, sf_dir), fx.pages(spark, sf_dir), fx.segments(spark, sf_dir), edits)


@query(f"WITH {_EDITED} SELECT * FROM edited")
def manual_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _edited(spark, sf_dir)[1]
    return pages.select("document_id", "page_number", "extracted_text", "processing_status", "error_message", F.array_join("warning_messages", "|").alias("warnings"))


@query(
    f"""WITH {_EDITED}, c AS (SELECT document_id, count(*) FILTER (WHERE {_FAIL}) AS n, bool_and(processing_status = 'completed') AS d FROM edited WHERE document_id IN (SELECT document_id FROM e) GROUP BY 1)
    SELECT id, CASE WHEN d THEN 'text_ready' WHEN NOT d THEN 'failed' ELSE status END AS status,
    CASE WHEN d THEN NULL WHEN NOT d THEN n || CASE WHEN n = 1 THEN ' page' ELSE ' pages' END || ' still need attention.' ELSE error_message END AS error_message
    FROM docs LEFT JOIN c ON c.document_id = id"""
)
def documents_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir)[0]


@query(f"WITH {fx.SEGMENTS_SQL}, {_EDITED} SELECT document_id, segment_number FROM segments WHERE document_id NOT IN (SELECT document_id FROM e)")
def segments_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir)[2].select("document_id", "segment_number")


@query(
    f"""WITH {_EDITED} SELECT document_id, page_number, CASE WHEN trim(new_text) = '' THEN 'page_text_required' ELSE 'page_not_found' END AS error_code FROM edits
    WHERE trim(new_text) = '' OR (document_id, page_number) NOT IN (SELECT (document_id, page_number) FROM pages_)"""
)
def refused_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir)[3].select("document_id", "page_number", "error_code")


_FILES = "SELECT document_id, printf('audio/segment-%04d.mp3', segment_number) AS path FROM segments WHERE (document_id + segment_number) % 3 > 0"
_RECOVERED = f"""{fx.SEGMENTS_SQL}, files AS ({_FILES}), want AS (SELECT *, coalesce(nullif(audio_storage_path, ''), printf('audio/segment-%04d.mp3', segment_number)) AS p FROM segments),
recovered AS (SELECT w.document_id, w.segment_number, f.path IS NOT NULL AS found, p, audio_storage_path, processing_status FROM want w LEFT JOIN (SELECT DISTINCT * FROM files) f ON f.document_id = w.document_id AND f.path = p)"""


def _files(segments: DataFrame) -> DataFrame:
    some = segments.where("(document_id + segment_number) % 3 > 0")
    return some.select("document_id", F.format_string("audio/segment-%04d.mp3", "segment_number").alias("path"))


@query(
    f"""WITH {_RECOVERED} SELECT document_id, segment_number, CASE WHEN found THEN p WHEN processing_status NOT IN ('generating', 'failed') THEN audio_storage_path END AS audio_storage_path,
    CASE WHEN found THEN 'completed' WHEN processing_status IN ('generating', 'failed') THEN 'pending' ELSE processing_status END AS processing_status,
    CASE WHEN NOT found AND processing_status NOT IN ('generating', 'failed') THEN 'said' END AS error_message FROM recovered"""
)
def recover_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = fx.segments(spark, sf_dir).withColumn("error_message", F.lit("said"))
    return lifecycle.recover_segments(segments, _files(segments)).select("document_id", "segment_number", "audio_storage_path", "processing_status", "error_message")


#: The time of a change, so that a query and its twin agree on it.
_NOW = "TIMESTAMP '2030-01-01 00:00:00'"
_DRAFTS = "SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS INT) AS segment_number, concat(document_id, '/', page_number) AS page_id, extracted_text AS source_text FROM {0} WHERE processing_status = 'completed' AND document_id % 4 > 0 AND trim(extracted_text) <> ''"
_ASKED_AUDIO = "SELECT o_orderkey + CASE WHEN o_orderkey % 100 = 0 THEN 3000000000 ELSE 0 END AS id FROM {0} WHERE o_orderkey % 7 > 0"
_STARTED = f"""{fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, {_RECOVERED}, drafts AS ({_DRAFTS.format("pages_")}), asked AS ({_ASKED_AUDIO.format("orders")}),
p AS (SELECT document_id, bool_and(processing_status = 'completed') AS done FROM pages_ GROUP BY 1),
s AS (SELECT document_id, bool_and(found OR processing_status NOT IN ('generating', 'failed')) AS spoken FROM recovered GROUP BY 1),
n AS (SELECT document_id, count(*) AS n FROM drafts GROUP BY 1),
st AS (SELECT a.id, r.status, s.document_id IS NOT NULL AS has, coalesce(done, true) AS done, coalesce(spoken, false) AS spoken, coalesce(n, 0) AS n, r.id IS NULL AS nobody
  FROM asked a LEFT JOIN recordings r ON r.id = a.id LEFT JOIN p ON p.document_id = a.id LEFT JOIN s ON s.document_id = a.id LEFT JOIN n ON n.document_id = a.id),
v AS (SELECT *, status IN ('failed', 'generating_audio') AND has AND done AS resume, CASE WHEN nobody THEN 'book_not_found' WHEN status = 'ready' AND has THEN 'book_audio_ready'
  WHEN status IN ('failed', 'generating_audio') AND has AND done THEN NULL WHEN status <> 'text_ready' THEN 'book_text_not_ready' WHEN NOT done THEN 'pages_not_ready' WHEN n = 0 THEN 'no_text_to_read' END AS error_code FROM st)"""


def _started(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    fx.pages(spark, sf_dir, dealt=True).createOrReplaceTempView("leafmill_pages")
    fx.table(spark, sf_dir, "orders").createOrReplaceTempView("leafmill_orders")
    drafts = spark.sql(_DRAFTS.format("leafmill_pages"))
    segments = fx.segments(spark, sf_dir).withColumns({"source_text": F.lit("old"), "error_message": F.lit("said"), "updated_at": F.expr("TIMESTAMP '2020-01-01 00:00:00'")})
    docs = fx.recordings(spark, sf_dir).select("id", "status", "updated_at", F.lit("said").alias("error_message"))
    return lifecycle.start_audio(docs, fx.pages(spark, sf_dir), segments, drafts, _files(fx.segments(spark, sf_dir)), spark.sql(_ASKED_AUDIO.format("leafmill_orders")), F.expr(_NOW))


@query(
    f"""WITH {_STARTED}, kept AS (SELECT r.*, coalesce(v.resume AND v.error_code IS NULL, false) AS again FROM recovered r LEFT JOIN v ON v.id = r.document_id
      WHERE NOT coalesce(NOT v.resume AND v.error_code IS NULL, false))
    SELECT document_id, segment_number, CASE WHEN again AND found THEN p WHEN again AND processing_status IN ('generating', 'failed') THEN NULL ELSE audio_storage_path END AS audio_storage_path,
    CASE WHEN again AND found THEN 'completed' WHEN again AND processing_status IN ('generating', 'failed') THEN 'pending' ELSE processing_status END AS processing_status, 'old' AS source_text,
    CASE WHEN again AND (found OR processing_status IN ('generating', 'failed')) THEN NULL ELSE 'said' END AS error_message,
    CASE WHEN again AND (found OR processing_status IN ('generating', 'failed')) THEN {_NOW} ELSE TIMESTAMP '2020-01-01 00:00:00' END AS updated_at FROM kept
    UNION ALL SELECT d.document_id, d.segment_number, NULL, 'pending', d.source_text, NULL, {_NOW} FROM drafts d JOIN v ON v.id = d.document_id WHERE NOT v.resume AND v.error_code IS NULL"""
)
def started_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments after audio was asked for: made from drafts, or recovered."""
    return _started(spark, sf_dir)[1].select("document_id", "segment_number", "audio_storage_path", "processing_status", "source_text", "error_message", "updated_at")


@query(
    f"""WITH {_STARTED}, g AS (SELECT id, CASE WHEN resume AND spoken THEN 'ready' ELSE 'generating_audio' END AS s FROM v WHERE error_code IS NULL)
    SELECT r.id, coalesce(g.s, r.status) AS status, CASE WHEN g.id IS NULL THEN 'said' END AS error_message, CASE WHEN g.id IS NULL THEN updated_at ELSE {_NOW} END AS updated_at FROM recordings r LEFT JOIN g ON g.id = r.id"""
)
def started_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _started(spark, sf_dir)[0].select("id", "status", "error_message", "updated_at")


@query(f"WITH {_STARTED} SELECT id, error_code FROM v WHERE error_code IS NOT NULL")
def refused_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _started(spark, sf_dir)[2]


_PREPARED = f"""{fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, asked AS ({_ASKED_AUDIO.format("orders")}),
c AS (SELECT document_id, count(*) FILTER (WHERE {_OPEN}) AS o, count(*) FILTER (WHERE {_OPEN} AND extraction_method = 'ocr') AS r, count(*) FILTER (WHERE processing_status = 'failed') AS f FROM pages_ GROUP BY 1),
v AS (SELECT a.id, CASE WHEN d.id IS NULL THEN 'book_not_found' WHEN d.status = 'text_ready' THEN 'book_text_ready' WHEN coalesce(o, 0) = 0 AND coalesce(f, 0) > 0 THEN 'failed_pages_require_retry' END AS error_code,
  CASE WHEN coalesce(r, 0) > 0 THEN 'running_ocr' ELSE 'extracting_text' END AS s FROM asked a LEFT JOIN recordings d ON d.id = a.id LEFT JOIN c ON c.document_id = a.id)"""


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fx.table(spark, sf_dir, "orders").createOrReplaceTempView("leafmill_orders")
    docs = fx.recordings(spark, sf_dir).select("id", "status", "updated_at", F.lit("said").alias("error_message"))
    return lifecycle.start_text(docs, fx.pages(spark, sf_dir), spark.sql(_ASKED_AUDIO.format("leafmill_orders")), F.expr(_NOW))


@query(
    f"""WITH {_PREPARED}, g AS (SELECT id, s FROM v WHERE error_code IS NULL) SELECT d.id, coalesce(g.s, d.status) AS status, CASE WHEN g.id IS NULL THEN 'said' END AS error_message,
    CASE WHEN g.id IS NULL THEN updated_at ELSE {_NOW} END AS updated_at FROM recordings d LEFT JOIN g ON g.id = d.id"""
)
def prepared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after text was asked for most of them."""
    return _prepared(spark, sf_dir)[0].select("id", "status", "error_message", "updated_at")


@query(f"WITH {_PREPARED} SELECT id, error_code FROM v WHERE error_code IS NOT NULL")
def refused_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir)[1]


_TWICE = f"""{fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, req AS (SELECT document_id, page_number, k FROM pages_, (VALUES (1), (2), (2)) v(k) WHERE document_id % 5 = 0),
good AS (SELECT document_id, page_number FROM pages_ WHERE document_id % 5 = 0)"""


def _twice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Three requests for every page of each fifth document, two of them alike."""
    pages = fx.pages(spark, sf_dir).withColumn("updated_at", F.expr("TIMESTAMP '2020-01-01 00:00:00'"))
    asked = pages.where("document_id % 5 = 0").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 2)))))
    edits = asked.selectExpr("document_id", "page_number", "concat('edit ', k) AS new_text", "timestamp_seconds(k) AS requested_at")
    docs = fx.recordings(spark, sf_dir).select("id", "status", "updated_at", F.lit(None).cast("string").alias("error_message"))
    return lifecycle.edit_text(docs, pages, fx.segments(spark, sf_dir), edits, F.expr(_NOW))


@query(
    f"""WITH {_TWICE} SELECT document_id, page_number, CASE WHEN document_id % 5 = 0 THEN 'edit 2' ELSE extracted_text END AS extracted_text,
    CASE WHEN document_id % 5 = 0 THEN {_NOW} ELSE TIMESTAMP '2020-01-01 00:00:00' END AS updated_at FROM pages_"""
)
def repeated_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after repeated edits: one row each, with the last text."""
    return _twice(spark, sf_dir)[1].select("document_id", "page_number", "extracted_text", "updated_at")


@query(f"WITH {_TWICE} SELECT document_id, page_number, 'edit ' || k AS new_text, 'superseded' AS error_code FROM (SELECT DISTINCT * FROM req)")
def superseded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that a later or equal one overrides, once each."""
    return _twice(spark, sf_dir)[3].select("document_id", "page_number", "new_text", "error_code")


@query(
    f"""WITH {_TWICE} SELECT id, CASE WHEN id % 5 = 0 AND EXISTS (SELECT 1 FROM good WHERE document_id = id) THEN 'text_ready' ELSE status END AS status,
    CASE WHEN id % 5 = 0 AND EXISTS (SELECT 1 FROM good WHERE document_id = id) THEN {_NOW} ELSE updated_at END AS updated_at FROM recordings"""
)
def documents_after_repeated_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, sf_dir)[0].select("id", "status", "updated_at")



@query(
    f"""WITH {fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, {_RECOVERED},
    p AS (SELECT document_id, bool_and(processing_status = 'completed') AS pages_done, count(*) % 3 AS drafts FROM pages_ GROUP BY 1),
    s AS (SELECT document_id, count(*) n, bool_and(found OR processing_status NOT IN ('generating', 'failed')) AS audio_done FROM recovered GROUP BY 1),
    j AS (SELECT r.id, r.status, coalesce(s.n, 0) > 0 AS has, coalesce(pages_done, true) AS done, coalesce(audio_done, false) AS audio_done, coalesce(drafts, 0) AS drafts
      FROM recordings r LEFT JOIN p ON p.document_id = r.id LEFT JOIN s ON s.document_id = r.id),
    e AS (SELECT *, status IN ('failed', 'generating_audio') AND has AND done AS resume FROM j),
    v AS (SELECT *, CASE WHEN status = 'ready' AND has THEN 'book_audio_ready' WHEN resume THEN NULL WHEN status <> 'text_ready' THEN 'book_text_not_ready'
      WHEN NOT done THEN 'pages_not_ready' WHEN drafts = 0 THEN 'no_text_to_read' END AS error_code FROM e)
    SELECT id, error_code, CASE WHEN error_code IS NOT NULL THEN status WHEN resume AND audio_done THEN 'ready' ELSE 'generating_audio' END AS new_status FROM v"""
)
def audio_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, segments = fx.pages(spark, sf_dir), fx.segments(spark, sf_dir)
    drafts = pages.groupBy("document_id").agg((F.count(F.lit(1)) % 3).alias("drafts"))
    return lifecycle.admit_audio_job(fx.recordings(spark, sf_dir), pages, segments, drafts, _files(segments))


_STOPPED = f"""{fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, {fx.SEGMENTS_SQL}, {_STATES}, run AS (SELECT id AS document_id, status = 'generating_audio' AS audio FROM docs WHERE status IN ('extracting_text', 'running_ocr', 'generating_audio'))"""


def _interrupted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    segments = fx.segments(spark, sf_dir).withColumn("error_message", F.lit(None).cast("string"))
    return lifecycle.mark_interrupted(_documents(spark, sf_dir), fx.pages(spark, sf_dir), segments)


@query(
    f"""WITH {_STOPPED} SELECT id, CASE WHEN audio IS NULL THEN status ELSE 'failed' END AS status,
    CASE WHEN audio THEN '{lifecycle.AUDIO_STOPPED}' WHEN NOT audio THEN '{lifecycle.TEXT_STOPPED}' ELSE error_message END AS error_message FROM docs LEFT JOIN run ON document_id = id"""
)
def mark_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interrupted(spark, sf_dir)[0]


@query(
    f"""WITH {_STOPPED}, x AS (SELECT p.*, coalesce(NOT audio AND {_OPEN}, false) AS hit FROM pages_ p LEFT JOIN run USING (document_id))
    SELECT document_id, page_number, CASE WHEN hit THEN 'failed' ELSE processing_status END AS processing_status, CASE WHEN hit THEN '{lifecycle.TEXT_STOPPED}' ELSE error_message END AS error_message FROM x"""
)
def interrupted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interrupted(spark, sf_dir)[1].select("document_id", "page_number", "processing_status", "error_message")


@query(
    f"""WITH {_STOPPED}, x AS (SELECT s.*, coalesce(audio AND processing_status IN {lifecycle.UNSPOKEN}, false) AS hit FROM segments s LEFT JOIN run USING (document_id))
    SELECT document_id, segment_number, CASE WHEN hit THEN 'failed' ELSE processing_status END AS processing_status, CASE WHEN hit THEN '{lifecycle.AUDIO_STOPPED}' END AS error_message FROM x"""
)
def interrupted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interrupted(spark, sf_dir)[2].select("document_id", "segment_number", "processing_status", "error_message")


_CROPPED = f"""{fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, j AS (SELECT pages_.*, CASE WHEN page_number > 2 OR document_id % 2 = 1 THEN 'none' WHEN extraction_method <> 'ocr' OR document_id % 8 = 0 THEN 'page_crop_unavailable'
  WHEN status <> 'uploaded' OR processing_status <> 'pending' THEN 'page_crop_not_editable' END AS error_code FROM pages_ LEFT JOIN recordings ON id = document_id)"""


def _cropped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = fx.pages(spark, sf_dir).withColumn("processed_image_path", F.when(F.col("document_id") % 8 != 0, F.lit("pages/page-0001.png")))
    edits = fx.pages(spark, sf_dir).where("page_number <= 2 AND document_id % 2 = 0").selectExpr(
        "document_id", "page_number", "0.1D AS new_left", "0.2D AS new_top", "0.8D AS new_right", "0.9D AS new_bottom"
    )
    return lifecycle.edit_crops(fx.recordings(spark, sf_dir), pages, edits)


@query(
    f"""WITH {_CROPPED} SELECT document_id, page_number, CASE WHEN error_code IS NULL THEN 0.1::DOUBLE ELSE crop_left END AS crop_left, CASE WHEN error_code IS NULL THEN 0.9::DOUBLE ELSE crop_bottom END AS crop_bottom,
    CASE WHEN error_code IS NULL THEN '' ELSE extracted_text END AS extracted_text, CASE WHEN error_code IS NOT NULL THEN error_message END AS error_message, processing_status FROM j"""
)
def crop_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cropped(spark, sf_dir)[0].select("document_id", "page_number", "crop_left", "crop_bottom", "extracted_text", "error_message", "processing_status")


@query(f"WITH {_CROPPED} SELECT document_id, page_number, error_code FROM j WHERE error_code <> 'none'")
def refused_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cropped(spark, sf_dir)[1].select("document_id", "page_number", "error_code")


@query(
    f"""WITH {fx.RECORDINGS_SQL}, {fx.PAGES_SQL} SELECT document_id, page_number, CASE WHEN extraction_method <> 'ocr' OR document_id % 8 = 0 THEN 'page_crop_unavailable'
    WHEN status <> 'uploaded' OR processing_status <> 'pending' THEN 'page_crop_not_editable' END AS error_code FROM pages_ JOIN recordings ON id = document_id"""
)
def crop_editable(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = fx.pages(spark, sf_dir).join(fx.recordings(spark, sf_dir).select(F.col("id").alias("document_id"), "status"), "document_id")
    path = F.when(F.col("document_id") % 8 != 0, F.lit("pages/page-0001.png"))
    error = lifecycle.crop_edit_error(F.col("status"), F.col("processing_status"), F.col("extraction_method"), path)
    return joined.select("document_id", "page_number", error.alias("error_code"))


@query(
    f"""WITH {fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, {fx.SEGMENTS_SQL}, sp AS (SELECT DISTINCT document_id FROM segments WHERE document_id % 3 > 0),
    j AS (SELECT r.id, status, r.id % 2 = 0 AS active, EXISTS (SELECT 1 FROM pages_ p WHERE p.document_id = r.id AND extraction_method = 'ocr') AS ocr,
      (SELECT count(*) FROM pages_ p WHERE p.document_id = r.id AND processing_status = 'failed') AS failed, (SELECT count(*) FROM pages_ p WHERE p.document_id = r.id AND processing_status <> 'completed') AS undone,
      r.id IN (SELECT document_id FROM sp) AS spoken FROM recordings r)
    SELECT id, status = 'uploaded' AND ocr AS awaiting_review,
    (status = 'uploaded' AND NOT ocr) OR status IN ('normalizing_pages', 'inspecting', 'extracting_text', 'running_ocr') AS preparing_text,
    status IN ('normalizing_pages', 'inspecting', 'extracting_text', 'running_ocr') AND NOT active AS can_resume_text,
    (status = 'generating_audio' AND NOT active) OR (status = 'failed' AND failed = 0 AND spoken AND undone = 0) AS can_resume_audio,
    status = 'text_ready' OR (status = 'generating_audio' AND NOT active) OR (status = 'failed' AND failed = 0 AND spoken AND undone = 0) AS can_start_audio,
    (status = 'generating_audio' AND NOT active) OR (status = 'failed' AND spoken) AS player_can_resume,
    status = 'text_ready' OR (status = 'generating_audio' AND NOT active) OR (status = 'failed' AND spoken) AS player_can_start FROM j"""
)
def resume_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.recordings(spark, sf_dir).withColumn("processing_active", F.col("id") % 2 == 0)
    return lifecycle.resume_flags(docs, fx.pages(spark, sf_dir), fx.segments(spark, sf_dir).where("document_id % 3 > 0"))


@query(
    f"""WITH {fx.RECORDINGS_SQL} SELECT id, CASE WHEN segment_count + 1 BETWEEN 1 AND 2 THEN segment_count + 1 ELSE segment_count END AS current,
    CASE WHEN segment_count + 1 BETWEEN 1 AND 2 THEN CAST(0 AS DOUBLE) END AS position FROM recordings"""
)
def move_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, position, _ = lifecycle.move_part(F.col("segment_count"), 1, F.lit(2))
    return fx.recordings(spark, sf_dir).select("id", current.alias("current"), position.alias("position"))


_SETTLED = f"""{fx.PAGES_SQL}, settled AS (SELECT document_id, page_number, CASE WHEN extraction_method = 'embedded_text' AND {_OPEN} THEN CASE WHEN {_BLANK} THEN 'failed' ELSE 'completed' END ELSE processing_status END AS s FROM pages_),
c AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE s = 'completed') AS c, count(*) FILTER (WHERE s = 'failed') AS f FROM settled GROUP BY 1)"""


@query(
    f"""WITH {_SETTLED} SELECT CAST(document_id AS VARCHAR) AS id, n AS seen_pages, c AS completed_pages, f AS failed_pages, CASE WHEN f > 0 THEN 'failed' WHEN c = n THEN 'text_ready' ELSE 'extracting_text' END AS status,
    CASE WHEN f > 0 THEN f || CASE WHEN f = 1 THEN ' page' ELSE ' pages' END || ' still need attention.' END AS error_message FROM c"""
)
def page_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as a stream of three batches, then all of them again as a run
    that has lost its checkpoint, which changes nothing; then the documents."""
    folder = shared.folder(spark)
    pages = fx.pages(spark, sf_dir, dealt=True).selectExpr("concat(document_id, '/', page_number) AS id", "CAST(document_id AS STRING) AS document_id", "page_number", "extraction_method", "extracted_text", "processing_status")
    files = 4 * spark.sparkContext.defaultParallelism
    for part in range(3):
        pages.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part).repartition(files).write.mode("append").parquet(f"{folder}/pages")
    g = graph.Graph(spark, f"{folder}/graph", buckets=8)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/pages")
    job.prepare(g, stream, f"{folder}/offsets").awaitTermination()
    # A new run from the first offset: every batch is there already.
    job.prepare(g, stream, f"{folder}/other-offsets").awaitTermination()
    return g.read("documents").select("id", *job.COUNTS, "status", "error_message")
