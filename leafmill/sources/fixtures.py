"""The driver's tables seen as the document model.

Every derived column is an SQL expression that Spark and DuckDB read alike, so
that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.spread import by_key

RECORDING = {
    "id": "o_orderkey",
    "user_id": "CASE WHEN o_orderkey % 17 > 0 THEN o_custkey % 100 END",
    "title": "CASE o_orderkey % 7 WHEN 0 THEN '  Straße ' WHEN 1 THEN 'STRASSE' WHEN 2 THEN 'Night walk' "
    "WHEN 3 THEN 'night WALK ' WHEN 4 THEN NULL ELSE o_orderpriority END",
    "original_filename": "CASE WHEN o_orderkey % 4 = 1 THEN concat('scan-', CAST(o_orderkey AS STRING), '.pdf') END",
    "recording_title": "CASE WHEN o_orderkey % 3 = 0 THEN concat('Take ', CAST(o_orderkey % 10 AS STRING)) END",
    "library_document_id": "CASE WHEN o_orderkey % 35 = 0 THEN o_orderkey + 1000000000 WHEN o_orderkey % 5 = 0 THEN CAST(floor(o_orderkey / 3) AS BIGINT) WHEN o_orderkey % 11 = 0 THEN o_orderkey END",
    "status": "CASE o_orderkey % 9 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'normalizing_pages' WHEN 2 THEN 'inspecting' "
    "WHEN 3 THEN 'extracting_text' WHEN 4 THEN 'running_ocr' WHEN 5 THEN 'text_ready' WHEN 6 THEN 'generating_audio' "
    "WHEN 7 THEN 'ready' ELSE 'failed' END",
    "target_language": "CASE o_orderkey % 4 WHEN 0 THEN 'cantonese' WHEN 1 THEN 'mandarin' WHEN 2 THEN 'english' END",
    "total_pages": "CAST(o_orderkey % 40 + 1 AS INT)",
    "segment_count": "CAST(o_orderkey % 3 AS INT)",
    "created_at": "o_orderdate",
    "updated_at": "o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 1000)",
}

_PAGE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax"

PAGE = {
    "document_id": "l_orderkey",
    "page_number": f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_PAGE_ORDER}) AS INT)",
    "processing_status": "CASE WHEN l_returnflag = 'R' AND l_partkey % 3 = 0 THEN 'failed' WHEN l_linestatus = 'F' OR l_partkey % 4 > 0 "
    "THEN 'completed' ELSE 'pending' END",
    "extraction_method": "CASE WHEN l_suppkey % 2 = 0 THEN 'ocr' ELSE 'embedded_text' END",
    "extracted_text": "CASE WHEN l_partkey % 5 = 0 THEN '   ' ELSE concat('Page of part ', CAST(l_partkey AS STRING)) END",
    "error_message": "CASE WHEN l_returnflag = 'R' AND l_partkey % 3 = 0 THEN 'unreadable' END",
    "warning_messages": "CASE WHEN l_suppkey % 3 = 0 THEN split('low contrast', '#') END",
    "rotation_degrees": "CAST(l_linenumber * 45 % 360 AS INT)",
    "crop_left": "l_discount",
    "crop_top": "l_tax",
    "crop_right": "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_discount * 10 END",
    "crop_bottom": "CAST(l_quantity / 50 AS DOUBLE)",
}

SEGMENT = {
    "document_id": "l_orderkey",
    "segment_number": PAGE["page_number"],
    "page_number": f"CASE WHEN l_partkey % 10 > 0 THEN {PAGE['page_number']} END",
    "processing_status": "CASE l_suppkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'generating' ELSE 'completed' END",
    "audio_storage_path": "CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('audio/part-', CAST(l_partkey AS STRING), '.mp3') END",
}

LINE = {
    "confidence": "CAST((doc_id * 31 + pos * 17) % 100 AS DOUBLE) / 100",
    "y_min": "CASE WHEN (doc_id + pos) % 13 > 0 THEN CAST(pos * 23 + (doc_id * 7 + pos * pos) % 11 AS DOUBLE) END",
    "x_min": "CAST((doc_id * 3 + pos * 5) % 90 AS DOUBLE)",
    "x_max": "CAST(900 + (doc_id + pos) % 95 AS DOUBLE)",
}

#: Pages in Chinese script of our own wording, since the tables hold none:
#: (page, language, position, text, confidence).
CHINESE_LINES = [
    (-1, "cantonese", 0, "第三章 海邊的早晨", 0.99), (-1, "cantonese", 1, "海邊的早晨", 0.95),
    (-1, "cantonese", 2, "清晨的海風吹過漁村，老人慢慢走向碼頭。", 0.97), (-1, "cantonese", 3, "", 0.2),
    (-1, "cantonese", 4, "圖 2.1：每月漁獲", 0.9), (-1, "cantonese", 5, "2019 2020 2021", 0.8), (-1, "cantonese", 6, "公噸", 0.7),
    (-1, "cantonese", 7, "資料來源：漁業署", 0.9), (-1, "cantonese", 8, "他記得去年的收成比今年好得多，村裡的人都這樣說。", 0.96),
    (-1, "cantonese", 9, "魚", 0.6), (-1, "cantonese", 10, "第 17 頁", 0.9),
    (-2, "mandarin", 0, "Page 15", 0.9), (-2, "mandarin", 1, "Ab", 0.3), (-2, "mandarin", 2, "城市的公园里有许多老树，孩子们在树下读书。", 0.9),
    (-2, "mandarin", 3, "图3 人口变化", 0.9), (-2, "mandarin", 4, "Figure 4: growth", 0.9), (-2, "mandarin", 5, "10%", 0.9),
    (-2, "mandarin", 6, "没有标点但是很长的一行文字放在这里作为例子", 0.9), (-2, "mandarin", 7, "傍晚时分，大家各自回家。", 0.9),
    (-2, "mandarin", 8, "小字", 0.9), (-2, "mandarin", 9, "- 16 -", 0.9),
    (-3, "english", 0, "Chapter 4 The Harbour", 0.9), (-3, "english", 1, "The boats came home late, and nobody asked where they had been.", 0.9),
    (-3, "english", 2, "Fig. 3 Catch by month", 0.9), (-3, "english", 3, "Jan Feb Mar", 0.9), (-3, "english", 4, "12 15 19", 0.9),
    (-3, "english", 5, "After that winter the harbour stayed empty for a long time.", 0.9), (-3, "english", 6, "", 0.1), (-3, "english", 7, "204", 0.9),
    (-4, "", 0, "「前言」", 0.9), (-4, "", 1, "《海的故事》", 0.9), (-4, "", 2, "從前有一個村子", 0.9), (-4, "", 3, "在海邊。", 0.9),
    (-4, "", 4, "", 0.9), (-4, "", 5, "漁民", 0.9), (-4, "", 6, "", 0.9), (-4, "", 7, "The sea is wide", 0.9), (-4, "", 8, "and deep.", 0.9),
    (-5, "", 0, "Two  spaces stay \t and  海  邊 do not", 0.9), (-5, "", 1, "海  a  b\u3000 邊", 0.9),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "orders"), RECORDING)


def pages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``dealt``: over as many tasks as there are, for the sort that numbers the
    pages; not worth it where the number isn't read."""
    lines = table(spark, sf_dir, "lineitem")
    return _view(by_key(lines, "l_orderkey") if dealt else lines, PAGE)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(by_key(table(spark, sf_dir, "lineitem"), "l_orderkey"), SEGMENT)


def chinese_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHINESE_LINES, "doc_id long, language string, pos int, text string, confidence double")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, language, pos, text, confidence): document lines and the
    Chinese pages. The documents' languages don't map to the model's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("language"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return docs.withColumn("confidence", F.expr(LINE["confidence"])).unionByName(chinese_lines(spark))


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_lines`` with positions on the page."""
    lines = text_lines(spark, sf_dir)
    return lines.withColumns({c: F.expr(LINE[c]) for c in ("y_min", "x_min", "x_max")})


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS document_id", "CAST(turn + 1 AS INT) AS page_number", "role", "text")


# SQL of the same views for the oracles.


def _cte(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} FROM {source})"


def _quote(x: object) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


RECORDINGS_SQL = _cte("recordings", "orders", RECORDING)
PAGES_SQL = _cte("pages_", "lineitem", PAGE)
SEGMENTS_SQL = _cte("segments", "lineitem", SEGMENT)
_ROWS = ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in CHINESE_LINES)
LINES_SQL = (
    "cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), "
    "flat AS (SELECT doc_id, unnest(parts) AS text, unnest(range(len(parts))) AS pos FROM cut), "
    "lines AS (SELECT doc_id, '' AS language, CAST(pos AS INT) AS pos, text, "
    f"{LINE['confidence']} AS confidence FROM flat UNION ALL "
    f"SELECT CAST(a AS BIGINT), b, CAST(c AS INT), d, CAST(e AS DOUBLE) FROM (VALUES {_ROWS}) v(a, b, c, d, e))"
)
PLACED_SQL = LINES_SQL + ", placed AS (SELECT *, " + ", ".join(f"{LINE[c]} AS {c}" for c in ("y_min", "x_min", "x_max")) + " FROM lines)"
