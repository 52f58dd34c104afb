"""Line geometry and ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import chars
from leafmill.operators import layout, likeness
from leafmill.plans.catalogue import query
from leafmill.sources import fixtures as fx
from leafmill.sources import media

_K = f"regexp_replace(text, '[{chars.SPACE}]+', '', 'g')"
_CJK = f"len(regexp_extract_all(text, '{chars.CJK_BODY}'))"
_PUNCT = f"regexp_matches(text, '{chars.CJK_PROSE_MARKS}')"
_BODY = f"(y_min IS NOT NULL AND length({_K}) > 14 AND ({_PUNCT} OR {_CJK} >= 8))"
# The tables hold no Chinese script: a third of their lines gets a full stop of
# it, so that body lines exist.
_MARKED = "CASE WHEN pos % 3 > 0 THEN text || '。' ELSE text END"
_PLACED = f"{fx.PLACED_SQL}, p AS (SELECT doc_id, pos, {_MARKED} AS text, confidence, y_min, x_min, x_max FROM placed)"
KEY = ["doc_id"]


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.placed_lines(spark, sf_dir).drop("language").withColumn("text", F.expr(_MARKED))


@query(
    f"""WITH {_PLACED}, g AS (SELECT doc_id, lead(y_min) OVER (PARTITION BY doc_id ORDER BY y_min) - y_min AS gap FROM p WHERE {_BODY} AND y_min < 600),
    m AS (SELECT doc_id, list_sort(list(gap)) AS l FROM g WHERE gap BETWEEN 15 AND 120 GROUP BY 1)
    SELECT d.doc_id, coalesce(l[len(l) // 2 + 1], 35.0) AS gap FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN m ON m.doc_id = d.doc_id"""
)
def gap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_gap(_placed(spark, sf_dir), KEY)


@query(
    f"""WITH {_PLACED} SELECT doc_id, coalesce(greatest(0.0, min(CASE WHEN {_BODY} THEN x_min END) - 40), 80.0) AS block_left,
    coalesce(least(1000.0, max(CASE WHEN {_BODY} THEN x_max END) + 40), 960.0) AS block_right FROM p GROUP BY doc_id"""
)
def block_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.block_bounds(_placed(spark, sf_dir), KEY)


@query(f"WITH {_PLACED} SELECT doc_id, coalesce(min(CASE WHEN length({_K}) > 14 OR {_PUNCT} THEN y_min END), min(y_min)) AS first_y FROM p WHERE y_min IS NOT NULL GROUP BY doc_id")
def first_body_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.first_body_y(_placed(spark, sf_dir), KEY)


@query(f"WITH {_PLACED} SELECT doc_id, round(avg(confidence), 6) AS average_confidence FROM p GROUP BY doc_id")
def average_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.mean_confidence(_placed(spark, sf_dir), KEY).withColumn("average_confidence", F.round("average_confidence", 6))


@query(
    f"""WITH {_PLACED}, r AS (SELECT *, CAST(floor(coalesce(y_min, 0) / 100) AS BIGINT) AS slot, row_number() OVER (PARTITION BY doc_id, floor(coalesce(y_min, 0) / 100)
      ORDER BY confidence DESC, length({_K}) DESC, pos) AS k FROM p) SELECT doc_id, slot, pos, text, confidence FROM r WHERE k = 1"""
)
def best_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    slotted = _placed(spark, sf_dir).withColumn("slot", F.floor(F.coalesce("y_min", F.lit(0.0)) / 100))
    return layout.best_per_slot(slotted, ["doc_id", "slot"])


@query(f"WITH {_PLACED} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY y_min NULLS LAST, pos) AS place FROM p")
def order_by_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("y_min"), "pos")
    return _placed(spark, sf_dir).select("doc_id", "pos", F.row_number().over(order).cast("long").alias("place"))


# An ordered series per user: the events' values by event number.
_SERIES = "series AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS y, round(value, 2) AS ink FROM events)"
_SMOOTH = "smoothed AS (SELECT *, avg(ink) OVER (PARTITION BY user_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM series)"
_RUNS = "runs AS (SELECT user_id, min(y) AS top, max(y) + 1 AS bottom FROM (SELECT *, y - row_number() OVER (PARTITION BY user_id ORDER BY y) AS g FROM smoothed WHERE smooth >= 50) GROUP BY user_id, g)"
_MERGED = """merged AS (SELECT user_id, min(top) AS top, arg_max(bottom, top) AS bottom FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY top) AS g FROM
  (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY user_id ORDER BY top) <= 2 THEN 0 ELSE 1 END AS n FROM runs)) GROUP BY user_id, g)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").selectExpr(
        "user_id", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS y", "round(value, 2) AS ink"
    )


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    smoothed = layout.smooth(_series(spark, sf_dir), ["user_id"], "y", "ink", 2)
    return layout.active_runs(smoothed, ["user_id"], "y", F.col("smooth") >= 50)


@query(f"WITH {_SERIES}, {_SMOOTH} SELECT user_id, y, round(smooth, 6) AS smooth FROM smoothed")
def smooth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.smooth(_series(spark, sf_dir), ["user_id"], "y", "ink", 2).select("user_id", "y", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {_SERIES}, {_SMOOTH}, {_RUNS} SELECT user_id, top, bottom FROM runs")
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query(f"WITH {_SERIES}, {_SMOOTH}, {_RUNS}, {_MERGED} SELECT user_id, top, bottom FROM merged")
def merge_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merge_close(_runs(spark, sf_dir), ["user_id"], 2)


@query(
    f"""WITH {_SERIES}, {_SMOOTH}, {_RUNS} SELECT user_id, top, bottom FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bottom - top DESC, top) AS k FROM runs WHERE bottom - top >= 3) WHERE k = 1"""
)
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.longest_run(_runs(spark, sf_dir), ["user_id"], 3)


@query(
    f"""WITH {_SERIES}, d AS (SELECT user_id, y, y - row_number() OVER (PARTITION BY user_id ORDER BY y) AS i FROM series WHERE ink / 100.0::DOUBLE > 0.3), r AS (SELECT user_id, min(y) AS top, max(y) + 1 AS bottom FROM d GROUP BY user_id, i)
    SELECT user_id, top, bottom FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bottom - top DESC, top) AS k FROM r WHERE bottom - top >= 2) WHERE k = 1"""
)
def paper_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir).withColumn("share", F.col("ink") / 100.0)
    return media.dense_band(rows, ["user_id"], 0.3, 2)


_BANDS = "SELECT l_orderkey % 500 AS page, l_quantity AS top, l_quantity + l_linenumber * 10 AS bottom, CAST(row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS pos FROM lineitem"


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.table(spark, sf_dir, "lineitem").createOrReplaceTempView("leafmill_lineitem")
    return spark.sql(_BANDS.replace("FROM lineitem", "FROM leafmill_lineitem"))


@query(
    f"""SELECT page, top, bottom, pos FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS k FROM (SELECT page, top, bottom, min(pos) AS pos FROM ({_BANDS}) GROUP BY 1, 2, 3)) WHERE k <= 10"""
)
def unique_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.unique_bands(_bands(spark, sf_dir), ["page"])


_FEW = f"few AS (SELECT page, top, bottom, CAST(20 + page % 15 AS DOUBLE) AS gap FROM ({_BANDS}))"


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir).selectExpr("page", "top", "bottom", "CAST(20 + page % 15 AS DOUBLE) AS gap")


@query(
    f"""WITH {_PLACED}, {_FEW} SELECT p.doc_id, p.pos, top, bottom FROM p JOIN few ON few.page = p.doc_id
    WHERE y_min BETWEEN top - greatest(10, round_even(0.45 * gap, 0)) AND bottom + greatest(10, round_even(0.45 * gap, 0))"""
)
def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = _few(spark, sf_dir).withColumnRenamed("page", "doc_id")
    return layout.match_bands(_placed(spark, sf_dir), bands, KEY).select("doc_id", "pos", "top", "bottom")


@query(
    f"""WITH {_FEW}, n AS (SELECT *, greatest(1, CAST(round_even((bottom - top) / gap, 0) AS INT)) AS n FROM few), s AS (SELECT *, unnest(range(n)) AS slot FROM n)
    SELECT page, CAST(slot AS INT) AS slot, round(top + slot * ((bottom - top) / n), 6) AS top, round(top + (slot + 1) * ((bottom - top) / n), 6) AS bottom FROM s"""
)
def band_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = layout.slots(_few(spark, sf_dir), ["page"])
    return cut.select("page", "slot", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(p AS INT) AS pos, CASE p WHEN 0 THEN l_returnflag ELSE 'b' END AS text,
    least(1.0, greatest(0.0, CASE p WHEN 0 THEN l_discount * 20 - 0.2 ELSE 0.5 END)) AS confidence, least(l_quantity, l_tax) AS y_min, least(l_discount, l_quantity * 2) AS x_min, greatest(l_discount, l_quantity * 2) AS x_max
    FROM lineitem, (VALUES (0), (1)) v(p)"""
)
def normalize_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    box = "array(l_discount, l_quantity, l_quantity * 2, l_tax)"
    raw = fx.table(spark, sf_dir, "lineitem").selectExpr(
        *key, "array(concat(' ', l_returnflag, ' '), 'b', '  ') AS rec_texts", "array(l_discount * 20 - 0.2, 0.5D, 0.9D) AS rec_scores", f"array({box}, {box}, {box}) AS rec_boxes"
    )
    return layout.normalize_predictions(raw, key)


def similar_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations, and after each second one its words in
    another order with a few of them changed."""
    turns = fx.conversations(spark, sf_dir).selectExpr("document_id", "page_number * 2 AS pos", "text")
    words = F.split("text", " ")
    n = F.size(words)
    moved = F.concat(F.slice(words, F.floor(n / 3).cast("int") + 1, n), F.array(F.lit("indeed")), F.slice(words, F.lit(1), F.floor(n / 3).cast("int")))
    copies = turns.where("pos % 4 = 0").select("document_id", (F.col("pos") + 1).alias("pos"), F.array_join(moved, " ").alias("text"))
    return turns.unionByName(copies)


@query()
def similar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are like an earlier one of their conversation, and which."""
    found = likeness.first_like(similar_input(spark, sf_dir), ["document_id"])
    return found.where("first_like IS NOT NULL").select("document_id", "pos", "first_like")


def top_line_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, lines and bands: slightly changed copies of lines, some moved
    above their page's body, and the strip above it as a band."""
    lines = _placed(spark, sf_dir)
    some = lines.where("pos % 4 = 0").withColumns(
        {"text": F.concat("text", F.lit(" x")), "confidence": F.least(F.lit(1.0), F.col("confidence") + 0.3)}
    )
    moved = lines.where("pos % 4 = 2").withColumns(
        {"text": F.concat(F.reverse("text"), F.lit(" y")), "y_min": F.col("y_min") - 400.0, "confidence": F.least(F.lit(1.0), F.col("confidence") + 0.4)}
    )
    bands = lines.groupBy("doc_id").agg((F.min("y_min") - 300.0).alias("top"), (F.min("y_min") - 20.0).alias("bottom"))
    return some.unionByName(moved), lines, bands


@query()
def merge_top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, lines, bands = top_line_input(spark, sf_dir)
    return layout.merge_top_lines(candidates, lines, KEY, bands=bands)


_PAGE = {
    "gap": "CAST(12 + user_id % 25 AS DOUBLE)", "first_y": "CASE WHEN user_id % 17 > 0 THEN CAST(40 + user_id % 60 AS DOUBLE) + 0.5 END", "left": "CAST(user_id % 40 AS INT)",
    "right": "CAST(200 + user_id % 11 * 60 AS INT)", "width": "CAST(400 + user_id % 5 * 300 AS INT)", "height": "CAST(60 + user_id % 90 AS INT)",
}
_PRINT = "CASE WHEN y % (20 + user_id % 21) < 12 THEN CAST(floor(ink) AS BIGINT) ELSE 0 END"


@query(
    f"""WITH {_SERIES}, printed AS (SELECT user_id, y, {_PRINT} AS ink FROM series), f AS (SELECT DISTINCT user_id, {", ".join(f'{v} AS "{k}"' for k, v in _PAGE.items())} FROM series),
    m AS (SELECT *, greatest(0, round_even(first_y - 4 * gap, 0)) AS low, least(height, round_even(first_y + 0.45 * gap, 0)) AS high, CAST(greatest(1, round_even(0.05 * gap, 0)) AS BIGINT) AS r FROM f WHERE first_y IS NOT NULL AND "right" - "left" >= 0.2 * width),
    n AS (SELECT m.*, y, ink FROM printed p JOIN m ON m.user_id = p.user_id WHERE high - low >= greatest(24, gap) AND y >= low AND y < high),
    s AS (SELECT *, avg(ink) OVER (PARTITION BY user_id ORDER BY y ROWS BETWEEN r PRECEDING AND r FOLLOWING) AS smooth,
      greatest(2, round_even(0.012 * ("right" - "left"), 0), round_even(0.08 * max(ink) OVER (PARTITION BY user_id), 0)) AS level FROM n),
    g AS (SELECT user_id, gap, height, first_y, min(y) AS top, max(y) + 1 AS bottom FROM (SELECT *, y - row_number() OVER (PARTITION BY user_id ORDER BY y) AS i FROM s WHERE smooth >= level) GROUP BY user_id, gap, height, first_y, i),
    k AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY user_id ORDER BY top) <= greatest(3, round_even(0.18 * gap, 0)) THEN 0 ELSE 1 END AS opens FROM g WHERE bottom - top >= greatest(4, round_even(0.16 * gap, 0))),
    j AS (SELECT user_id, gap, height, first_y, min(top) AS top, arg_max(bottom, top) AS bottom FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY top) AS c FROM k) GROUP BY user_id, gap, height, first_y, c),
    p AS (SELECT *, greatest(0, top - greatest(8, round_even(0.45 * gap, 0))) AS t, least(height, bottom + greatest(8, round_even(0.45 * gap, 0))) AS b FROM j)
    SELECT user_id, CAST(t AS BIGINT) AS top, CAST(b AS BIGINT) AS bottom FROM p WHERE b - t >= greatest(24, round_even(0.6 * gap, 0)) AND (t + b) / 2.0 <= first_y + 0.3 * gap
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t) <= 5"""
)
def ink_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of many sizes, each searched by its own gap, block and first line."""
    series = _series(spark, sf_dir)
    frames = series.select("user_id").distinct().selectExpr("user_id", *[f"{v} AS {k}" for k, v in _PAGE.items()])
    return layout.ink_bands(series.select("user_id", "y", F.expr(_PRINT).alias("ink")), frames, ["user_id"])


_VERDICTS = f"""v AS (SELECT doc_id, pos, length({_K}) AS k, {_K} AS bare, {_CJK} AS n, confidence, x_min, y_min, {_PUNCT} AS marks FROM p)"""


@query(
    f"""WITH {_PLACED}, {_VERDICTS} SELECT doc_id, pos, (k <= 2 AND NOT regexp_matches(bare, '[\\pL\\pN]')) OR (confidence < 0.5 AND k <= 12) AS noise, confidence >= 0.9 AND x_min <= 62 AS trust,
    confidence >= 0.86 AND k >= 12 AND n >= 8 AND x_min <= 110 AS fill, y_min IS NOT NULL AND k > 14 AND (marks OR n >= 8) AS body FROM v"""
)
def line_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, sure, x = F.col("text"), F.col("confidence"), F.col("x_min")
    left = F.lit(2.0)
    return _placed(spark, sf_dir).select(
        "doc_id", "pos", layout.is_noise(text, sure).alias("noise"), layout.trusted(sure, x, left).alias("trust"),
        layout.fills_slot(text, sure, x, left).alias("fill"), layout.is_body_line(text, F.col("y_min")).alias("body"),
    )


@query(
    f"""WITH {_PLACED}, k AS (SELECT DISTINCT doc_id, {_K} AS k FROM p WHERE pos % 3 = 0)
    SELECT p.doc_id, p.pos FROM p WHERE (p.doc_id, {_K}) NOT IN (SELECT (doc_id, k) FROM k)"""
)
def unknown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page that say what none of every third of its lines says."""
    lines = _placed(spark, sf_dir)
    frames = layout.page_frames(lines.where("pos % 3 = 0"), KEY, 1000.0).select("doc_id", "lm_keys")
    joined = lines.join(frames, KEY, "left")
    known = F.coalesce(F.array_contains("lm_keys", chars.key(F.col("text"))), F.lit(False))
    return joined.where(~known).select("doc_id", "pos")


@query(
    f"""WITH {_PLACED}, b AS (SELECT *, {_BODY} AS body, length({_K}) AS k FROM p), m AS (SELECT *, min(CASE WHEN body THEN y_min END) OVER (PARTITION BY doc_id) AS y FROM b),
    r AS (SELECT doc_id, count(*) FILTER (WHERE body) AS n, min(y) AS y, coalesce(bool_or(y_min < y AND y_min <= 180 AND k BETWEEN 4 AND 24), false) AS header FROM m GROUP BY 1)
    SELECT doc_id, doc_id % 7 = 0 OR n = 0 OR coalesce(y > 180 OR (n < 3 AND y > 120), false) OR header AS recover FROM r"""
)
def top_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _placed(spark, sf_dir)
    seen = lines.select("doc_id").distinct().where("doc_id % 7 = 0").withColumn("seen", F.lit(True))
    return layout.needs_top_recovery(lines, KEY, seen)


@query(
    """WITH f AS (SELECT o_orderkey AS page, CAST(o_custkey % 900 AS DOUBLE) AS first_y, CAST(20 + o_orderkey % 60 AS DOUBLE) AS gap FROM orders),
    p AS (SELECT *, greatest(0.0, round_even(first_y - 3.5 * gap, 0)) AS low, least(1000.0, round_even(first_y + 0.35 * gap, 0)) AS high, greatest(48.0, round_even(1.7 * gap, 0)) AS tall FROM f),
    t AS (SELECT page, unnest(range(5)) AS pos, low, greatest(0.0, high - low - tall) / 4 AS step, tall FROM p WHERE high > low)
    SELECT page, CAST(pos AS INT) AS pos, round_even(low + step * pos, 0) AS top, least(1000.0, round_even(low + step * pos, 0) + tall) AS bottom FROM t"""
)
def sweep_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS page", "CAST(o_custkey % 900 AS DOUBLE) AS first_y", "CAST(20 + o_orderkey % 60 AS DOUBLE) AS gap")
    return layout.sweep_bands(first, ["page"])


_GREYS = "SELECT l_orderkey % 300 AS page, CAST(l_partkey % 50 AS INT) AS x, CAST(l_suppkey % 40 AS INT) AS y, CAST(l_quantity * 5 AS INT) AS grey FROM lineitem"


@query(
    f"""WITH g AS ({_GREYS}), i AS (SELECT * FROM g WHERE x BETWEEN 5 AND 44), d AS (SELECT page, min(grey) AS dark FROM i GROUP BY 1 HAVING min(grey) <= 230)
    SELECT page, y, count(*) FILTER (WHERE grey < least(235, greatest(160, dark + 80))) AS ink FROM i JOIN d USING (page) GROUP BY page, y"""
)
def ink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.table(spark, sf_dir, "lineitem").createOrReplaceTempView("leafmill_lineitem")
    return layout.ink_counts(spark.sql(_GREYS.replace("FROM lineitem", "FROM leafmill_lineitem")), ["page"], 5, 45)
