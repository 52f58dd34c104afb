"""Files, images, providers, JSON documents and the stream, over rows whose
result SQL can tell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import names
from leafmill.operators import library
from leafmill.plans import shared
from leafmill.plans.catalogue import query
from leafmill.plans.library import _TRANSITION, progress_events
from leafmill.sources import fixtures as fx
from leafmill.sources import files, media, pdf, store
from leafmill.streaming import progress


_IMAGE = "CAST(p_partkey % 4 AS INT) AS kind, CAST(p_size * 100 + 100 AS INT) AS w, CAST(p_partkey % 3000 + 1 AS INT) AS h"


@query(
    f"""SELECT p_partkey, CASE kind WHEN 3 THEN NULL ELSE w END AS width, CASE kind WHEN 3 THEN NULL ELSE h END AS height,
    CASE WHEN kind = 3 THEN 'image_unreadable' WHEN w * h > 1000000 THEN 'image_too_large' END AS error_code, kind = 3 AS pdf FROM (SELECT p_partkey, {_IMAGE} FROM part)"""
)
def image_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of PNG, JPEG and other files, made of sizes."""
    rows = fx.table(spark, sf_dir, "part").selectExpr("p_partkey", *_IMAGE.split(", "))

    def number(c: str, digits: int) -> F.Column:
        return F.lpad(F.hex(c), digits, "0")

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number("w", 8), number("h", 8), F.lit("0802000000"))
    jpeg = F.concat(F.lit("FFD8FFE000046162FFC0001108"), number("h", 4), number("w", 4), F.lit("00" * 12))
    content = F.unhex(F.when(F.col("kind") < 2, png).when(F.col("kind") == 2, jpeg).otherwise(F.hex(F.lit("%PDF-1.7"))))
    filed = rows.withColumn("content", content)
    size = F.coalesce(media.png_size(F.col("content")), media.jpeg_size(F.col("content")))
    return filed.select(
        "p_partkey", size["width"].cast("int").alias("width"), size["height"].cast("int").alias("height"),
        media.image_error(F.col("content"), 1_000_000).alias("error_code"), media.is_pdf(F.col("content")).alias("pdf"),
    )


@query(
    """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS page_number, CAST(count(*) OVER (PARTITION BY conv_id) AS INT) AS page_count, text AS embedded_text, NULL::VARCHAR AS error_code
    FROM conversations WHERE conv_id % 7 > 0 UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, 'pdf_invalid' FROM conversations WHERE conv_id % 7 = 0"""
)
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation written as a PDF of its turns, some with compressed
    objects, some without their cross-references, some without their header;
    then read."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"])
    files = fx.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("texts"))
    return pdf.read_pages(written_pdfs(files).select("conv_id", "content"))


def written_pdfs(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, texts) with ``content``: the PDF of the texts."""

    @F.pandas_udf("binary")
    def write(ids: pd.Series, texts: pd.Series) -> pd.Series:
        def one(number: int, pages: list[str]) -> bytes:
            raw = pdf.compose(list(pages), compact=number % 2 == 1)
            raw = raw.replace(b"startxref\n", b"startxref\n9") if number % 3 == 0 else raw
            return raw.replace(b"%PDF-", b"%NOT-", 1) if number % 7 == 0 else raw

        return pd.Series([one(n, t) for n, t in zip(ids, texts, strict=True)])

    return rows.withColumn("content", write("conv_id", "texts"))


@query("SELECT page_id, html AS text, CASE WHEN html IS NULL OR html = '' THEN NULL ELSE 0.93::DOUBLE END AS confidence, CASE WHEN html IS NULL OR html = '' THEN 'ocr_failed' END AS error_code FROM pages")
def recognized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read by a provider that takes bytes for text."""
    pages = fx.table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return media.recognize(pages, lambda raw: (raw.decode(), 0.93) if raw else None).select("page_id", "text", "confidence", "error_code")


_SPOKEN = "s_suppkey AS segment, repeat(s_name, CAST(s_suppkey % 9 AS INT)) AS said, CASE s_suppkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' ELSE 'failed' END AS state"


@query(
    f"""WITH s AS (SELECT {_SPOKEN} FROM supplier), f AS (SELECT *, state <> 'completed' AND said <> '' AS done FROM s)
    SELECT segment, CASE WHEN state = 'completed' OR done THEN 'completed' ELSE 'failed' END AS processing_status, CASE WHEN done THEN printf('audio/segment-%04d.wav', segment) END AS audio_storage_path,
    CASE WHEN state <> 'completed' AND NOT done THEN '{media.NO_AUDIO}' END AS error_message,
    CASE WHEN done THEN floor(least(8.0::DOUBLE, greatest(1.2::DOUBLE, length(said) / 35.0::DOUBLE)) * 16000) / 16000 END AS duration_seconds FROM f"""
)
def spoken_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments through the mock provider, which has nothing to say of none."""
    rows = fx.table(spark, sf_dir, "supplier").selectExpr(*_SPOKEN.split(", ", 1)[:1], "repeat(s_name, CAST(s_suppkey % 9 AS INT)) AS source_text", "CASE s_suppkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' ELSE 'failed' END AS processing_status")
    rows = rows.withColumns({"segment_number": F.col("segment").cast("int"), "audio_storage_path": F.lit(None).cast("string")})
    said = media.speak(rows, lambda text: media.mock_speech(text) if text else None)
    return said.select("segment", "processing_status", "audio_storage_path", "error_message", "duration_seconds")


def _filed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of all customers as JSON documents, their orders as pages."""
    docs = fx.table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS id", "c_name AS title", "CAST(c_nationkey AS INT) AS total_pages", "timestamp_seconds(c_custkey) AS updated_at")
    pages = fx.table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey) AS document_id", "CAST(o_orderkey AS INT) AS page_number", "concat(o_orderpriority, ' \"é\"') AS extracted_text")
    none = pages.limit(0).selectExpr("document_id", "page_number AS segment_number")
    folder = shared.folder(spark)
    files.write_documents(library.assemble(docs, pages, none), folder)
    return folder


_JSON = """WITH o AS (SELECT o_custkey, count(*) AS n, string_agg(o_orderpriority || ' "é"', '|' ORDER BY o_orderkey) AS t FROM orders GROUP BY 1)
SELECT 'c' || c_custkey AS id, c_name AS title, CAST(c_nationkey AS INT) AS total_pages, make_timestamp(c_custkey * 1000000) AS updated_at, coalesce(o.n, 0) AS pages, coalesce(o.t, '') AS texts, NULL::VARCHAR AS error_code
FROM customer LEFT JOIN o ON o_custkey = c_custkey"""


def _shown(documents: DataFrame) -> DataFrame:
    texts = F.array_join(F.transform("pages", lambda p: p["extracted_text"]), "|")
    return documents.select(
        "id", "title", "total_pages", "updated_at", F.coalesce(F.size("pages"), F.lit(0)).cast("long").alias("pages"), F.coalesce(texts, F.lit("")).alias("texts"), "error_code"
    )


@query(_JSON)
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON, one file each, and read back."""
    return _shown(files.read_documents(spark, _filed(spark, sf_dir)))


@query(f"""SELECT * FROM ({_JSON}) WHERE id = 'c7' UNION ALL SELECT 'nobody', NULL, NULL, NULL, 0, '', 'book_not_found'""")
def json_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by its id, from its own file, and one that isn't there."""
    folder = _filed(spark, sf_dir)
    return _shown(files.read_document(spark, folder, "c7").unionByName(files.read_document(spark, folder, "nobody")))


@query(f"WITH {fx.RECORDINGS_SQL} SELECT id, library_document_id AS library_book_id, concat('p/', id, '.png') AS original_image_path, CASE WHEN id % 2 = 0 THEN 'w' ELSE '' END AS warnings FROM recordings")
def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under the records' names, missing warnings an empty list; there and
    back again changes nothing."""
    rows = fx.recordings(spark, sf_dir).select(
        "id", "library_document_id", F.concat(F.lit("p/"), F.col("id").cast("string"), F.lit(".png")).alias("original_image_storage_path"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("w"))).alias("warning_messages"),
    )
    again = store.to_records(store.to_rows(store.to_records(rows)))
    return again.select("id", "library_book_id", "original_image_path", F.array_join("warning_messages", "|").alias("warnings"))


_TURNS = "CASE o_orderkey % 9 WHEN 0 THEN '[0, 90]' WHEN 1 THEN '[270]' WHEN 2 THEN '[45, 0]' WHEN 3 THEN '{' WHEN 4 THEN '[\"90\"]' WHEN 5 THEN '[90.0]' WHEN 6 THEN '{\"a\": 90}' WHEN 7 THEN '[null]' ELSE '[]' END AS turns, CAST(o_orderkey % 3 AS INT) AS files"


@query(
    f"""WITH t AS (SELECT o_orderkey, {_TURNS} FROM orders), n AS (SELECT *, CASE WHEN turns IN ('[0, 90]', '[45, 0]') THEN 2 WHEN turns IN ('[270]', '["90"]', '[90.0]', '[null]') THEN 1 WHEN turns = '[]' THEN 0 END AS n FROM t),
    e AS (SELECT *, CASE WHEN n IS NULL OR n <> files THEN 'invalid_rotations' WHEN turns IN ('[45, 0]', '["90"]', '[90.0]', '[null]') THEN 'invalid_rotation' END AS error_code FROM n)
    SELECT o_orderkey, error_code, CASE WHEN error_code IS NULL THEN replace(turns[2:-2], ', ', '|') END AS rotations FROM e"""
)
def rotation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", _TURNS.rsplit(", ", 1)[0], _TURNS.rsplit(", ", 1)[1])
    found, error = names.rotations_error(F.col("turns"), F.col("files"))
    said = F.array_join(F.transform(found, lambda x: x.cast("string")), "|")
    return rows.select("o_orderkey", error.alias("error_code"), F.when(error.isNull(), said).alias("rotations"))


_PATHS = "CASE o_orderkey % 9 WHEN 0 THEN 'a/b.png' WHEN 1 THEN '../a' WHEN 2 THEN '/etc/x' WHEN 3 THEN 'a/../../b' WHEN 4 THEN 'a..b/c' WHEN 5 THEN 'a/../b' WHEN 6 THEN './a//b' WHEN 7 THEN '..' ELSE 'a/..' END"


@query("SELECT o_orderkey, o_orderkey % 9 IN (0, 4, 5, 6, 8) AS inside FROM orders")
def inside_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", names.inside(F.expr(_PATHS)).alias("inside"))


@query(
    f"""WITH {_TRANSITION}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, document_id ORDER BY ts DESC, event_id DESC) AS k FROM saved)
    SELECT user_id, document_id, ts, event_id, CAST(current_segment_number AS INT) AS current_segment_number, CAST(position_seconds AS DOUBLE) AS position_seconds, playback_speed, completed FROM r WHERE k = 1"""
)
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of three batches, whose state is then read."""
    folder = shared.folder(spark)
    events = progress_events(spark, sf_dir)
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    progress.stream_latest(stream, f"{folder}/state", f"{folder}/offsets", buckets=8).awaitTermination()
    return progress.current(spark, f"{folder}/state", progress.latest(progress.transition(events)).schema)
