"""Page classification, line cleaning, paragraphs, timing and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import chars
from leafmill.operators import clean, segment
from leafmill.plans.catalogue import ORACLES, query
from leafmill.sources import fixtures as fx

S = chars.SPACE
T = f"regexp_replace(text, '^[{S}]+|[{S}]+$', '', 'g')"
MARKS = chars.CJK_PROSE_MARKS


def _n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _re2(pattern: str) -> str:
    """A line pattern in RE2's flags."""
    return pattern.replace("(?iUd)", "(?i)").replace("(?iU)", "(?i)").replace(r"\w", r"\pL\pM\pN_").replace(r"\d", r"\p{Nd}").replace("'", "''")


CJK = f"len(regexp_extract_all(t, '{chars.CJK_BODY}'))"
PUNCT = f"regexp_matches(t, '{MARKS}')"
SOURCE, START, LABEL = (f"regexp_matches(t, '{_re2(p)}')" for p in (chars.SOURCE_LINE, chars.FIGURE_START, chars.SHORT_LABEL))
SUPPORT = f"""(CASE WHEN {SOURCE} THEN true WHEN {CJK} = 0 AND length(t) <= 24 AND {LABEL} THEN true WHEN regexp_matches(t, '[.。!?！？]$') THEN false
  WHEN {PUNCT} THEN false WHEN {CJK} >= 8 THEN false WHEN length(t) <= 24 THEN true ELSE length(t) <= 40 AND {LABEL} END)"""
FIGURE = f"({SOURCE} OR {START} OR {SUPPORT} OR (len(regexp_extract_all(t, '\\p{{Nd}}')) >= 2 AND length(t) <= 36) OR ({CJK} >= 8 AND length(t) <= 32 AND NOT {PUNCT}))"
HOLDER = "CASE language WHEN 'cantonese' THEN '此處有一個圖表。' WHEN 'mandarin' THEN '此处有一个图表。' ELSE 'There is a chart here.' END"

SURE = f"(SELECT * FROM (SELECT *, {T} AS t FROM lines) WHERE t <> '' AND NOT (confidence < 0.5 AND length(t) <= 12 AND NOT {PUNCT}))"


def _numbers(source: str) -> str:
    return f"(SELECT doc_id, language, pos, text, confidence FROM (SELECT *, {T} AS t FROM {source}) WHERE NOT regexp_matches(t, '{_re2(chars.PAGE_NUMBER)}'))"


def _trimmed(source: str) -> str:
    return f"""(SELECT doc_id, language, pos, text, confidence FROM (SELECT *, min(CASE WHEN {T} <> '' THEN pos END) OVER (PARTITION BY doc_id) AS f,
      max(CASE WHEN {T} <> '' THEN pos END) OVER (PARTITION BY doc_id) AS l FROM {source}) WHERE pos BETWEEN f AND l)"""


def _headers(source: str) -> str:
    return f"""(SELECT doc_id, language, pos, text, confidence FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n,
      coalesce(lead(prose, 1) OVER w, false) OR coalesce(lead(prose, 2) OVER w, false) OR coalesce(lead(prose, 3) OVER w, false) AS below FROM
      (SELECT *, {CJK} >= 8 AND {PUNCT} AS prose FROM (SELECT *, {T} AS t FROM {source})) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
      WHERE t <> '' AND NOT ((i < 4 OR i = n - 1) AND (regexp_matches(t, '{_re2(chars.RUNNING_HEADER)}') OR (i <= 1 AND length(t) <= 16 AND NOT {PUNCT} AND {CJK} >= 4 AND below))))"""


def _blocks(source: str, goes_on: str) -> str:
    return f"""(SELECT doc_id, language, pos, CASE WHEN opens THEN {HOLDER} ELSE text END AS text, confidence FROM (SELECT *, st AND coalesce(lag(state) OVER w, 0) <> 1 AS opens FROM
      (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS state FROM
      (SELECT *, {START} AS st, CASE WHEN t = '' THEN NULL WHEN {START} THEN 1 WHEN NOT {goes_on} THEN 0 END AS ev FROM (SELECT *, {T} AS t FROM {source})))
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE (opens OR coalesce(state, 0) <> 1) AND t <> '')"""


def _orphans(source: str) -> str:
    return f"""(SELECT doc_id, language, pos, text, confidence FROM (SELECT *, {T} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM {source})
      WHERE t <> '' AND NOT ((i <= 2 AND regexp_matches(t, '[A-Za-z]') AND length(t) <= 12 AND {CJK} = 0) OR (i <= 3 AND {CJK} = 1 AND NOT {PUNCT})
      OR ({CJK} BETWEEN 1 AND 7 AND NOT {PUNCT} AND i > 0 AND i < n - 1)))"""


def _matching(lines: str, survivors: str) -> str:
    return f"""(SELECT a.doc_id, a.language, a.pos, a.text, a.confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) AS r FROM (SELECT *, {T} AS t FROM {lines})) a
      JOIN (SELECT doc_id, {T} AS t, count(*) AS k FROM {survivors} GROUP BY 1, 2) b ON a.doc_id = b.doc_id AND a.t = b.t WHERE r <= k)"""


_SURE = "(SELECT doc_id, language, pos, text, confidence FROM " + SURE + ")"
_MATCHED = _matching(_SURE, _headers(_trimmed(_numbers(_SURE))))


def _out(source: str) -> str:
    return f"WITH {fx.LINES_SQL} SELECT doc_id, pos, text FROM {source}"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.text_lines(spark, sf_dir)


def _show(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "pos", "text")


KEY = ["doc_id"]


@query(
    f"""SELECT doc_id, length(k) AS visible, CASE WHEN length(k) >= 20 THEN 'embedded_text' ELSE 'requires_ocr' END AS classification
    FROM (SELECT doc_id, regexp_replace(text, '[{S}]+', '', 'g') AS k FROM documents)"""
)
def page_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", chars.visible_characters(text).cast("long").alias("visible"), chars.page_classification(text).alias("classification")
    )


@query(
    f"""SELECT page_id, CASE WHEN length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[{S}]+', '', 'g')) >= 20 THEN 'embedded_text' ELSE 'requires_ocr' END AS classification FROM pages"""
)
def html_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("html", "<[^>]*>", "")
    return fx.table(spark, sf_dir, "pages").select("page_id", chars.page_classification(text).alias("classification"))


@query(_out(SURE))
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(clean.drop_unsure(_lines(spark, sf_dir)))


@query(_out(_numbers("lines")))
def drop_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(clean.drop_page_numbers(_lines(spark, sf_dir)))


@query(_out(_headers("lines")))
def drop_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(clean.drop_headers(_lines(spark, sf_dir), KEY))


@query(_out(_blocks("lines", FIGURE)))
def collapse_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(clean.collapse_figures(_lines(spark, sf_dir), KEY, F.col("language")))


@query(_out(_blocks("lines", SUPPORT)))
def collapse_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(clean.collapse_charts(_lines(spark, sf_dir), KEY, F.col("language")))


@query(_out(_orphans("lines")))
def drop_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(clean.drop_orphans(_lines(spark, sf_dir), KEY))


@query(_out(_MATCHED))
def multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = clean.drop_unsure(_lines(spark, sf_dir))
    kept = clean.drop_headers(clean.trim_blank_ends(clean.drop_page_numbers(sure), KEY), KEY)
    return _show(clean.keep_matching(sure, kept, KEY))


@query(_out(_orphans(_blocks(_MATCHED, FIGURE))))
def clean_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(clean.clean_lines(_lines(spark, sf_dir), KEY, F.col("language")))


@query(_out(_blocks(_headers(_trimmed(_numbers("lines"))), SUPPORT)))
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(clean.clean_text_lines(_lines(spark, sf_dir), KEY, F.col("language")))


@query(
    f"""WITH {fx.LINES_SQL} SELECT doc_id, string_agg(t, chr(10) ORDER BY pos) AS text FROM (SELECT *, {T} AS t FROM {_orphans(_blocks(_MATCHED, FIGURE))}) GROUP BY doc_id"""
)
def clean_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.page_text(clean.clean_lines(_lines(spark, sf_dir), KEY, F.col("language")), KEY)


_PAGE_TEXT = f"(SELECT doc_id, any_value(language) AS language, string_agg({T}, chr(10) ORDER BY pos) AS text FROM {_blocks('lines', FIGURE)} GROUP BY doc_id)"
_PROSE = f"(({CJK} >= 8 AND ({PUNCT} OR length(t) >= 28)) OR (len(regexp_extract_all(t, '[A-Za-z]')) >= 30 AND regexp_matches(t, '[.?!,;:]')))"


@query(
    f"""WITH {fx.LINES_SQL}, p AS {_PAGE_TEXT}, u AS (SELECT doc_id, doc_id % 2 = 0 AS warned, len(l) >= 2 AND l[1] = {HOLDER} AND
      len(list_filter(l[2:], lambda t: {_PROSE})) > 0 AS usable FROM (SELECT *, string_split(text, chr(10)) AS l FROM p))
    SELECT doc_id, warned AND NOT usable AS review, CASE WHEN usable THEN '{chars.FIGURE_NOTE}' WHEN warned THEN 'low contrast' ELSE '' END AS notes FROM u"""
)
def warning_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = clean.collapse_figures(_lines(spark, sf_dir), KEY, F.col("language"))
    language = lines.groupBy("doc_id").agg(F.first("language").alias("language"))
    pages = clean.page_text(lines, KEY).join(language, "doc_id")
    warnings = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("low contrast")))
    review, notes = clean.warning_policy(warnings, F.col("text"), F.col("language"))
    return pages.select("doc_id", review.alias("review"), F.array_join(notes, "|").alias("notes"))


_LEFT, _RIGHT = chars.lookalike_table()


@query(f"WITH {fx.LINES_SQL} SELECT doc_id, pos, translate(concat(text, '⼈⺠⻑'), '{_LEFT}', '{_RIGHT}') AS text FROM lines")
def normalize_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    radicals = chr(0x2F08) + chr(0x2EA0) + chr(0x2ED1)
    return _lines(spark, sf_dir).select("doc_id", "pos", chars.normalize_lookalikes(F.concat("text", F.lit(radicals))).alias("text"))


def _spoken(x: str) -> str:
    other = f"length(regexp_replace(regexp_replace({x}, '[\\x00-\\x7F{S}]', '', 'g'), '{chars.CJK_WIDE}', '', 'g'))"
    return f"({_n(x, chars.CJK_WIDE)} / 3.8::DOUBLE + {_n(x, chars.WORD)} / 2.6::DOUBLE + {other} / 3.2::DOUBLE + {_n(x, chars.PAUSES)} * 0.2::DOUBLE)"


@query(f"WITH {fx.LINES_SQL} SELECT doc_id, pos, round({_spoken('text')}, 6) AS seconds FROM lines")
def spoken_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "pos", F.round(chars.spoken_seconds(F.col("text")), 6).alias("seconds"))


_W = chars.CJK_WIDE
_HEAD = f"(length(t) <= 40 AND regexp_matches(t, '^[「《]') AND NOT regexp_matches(t, '[{chars.HEADING_STOPS}]$'))"


def _no_lookaround(x: str) -> str:
    """Remove white space between CJK characters, twice since matches share
    their ends; every other one becomes a space."""
    once = f"regexp_replace({x}, '({_W})[{S}]+({_W})', '\\1\\2', 'g')"
    twice = f"regexp_replace({once}, '({_W})[{S}]+({_W})', '\\1\\2', 'g')"
    return f"regexp_replace({twice}, '[{S}]', ' ', 'g')"


_PARAS = f"""paras AS (SELECT doc_id, para, {_no_lookaround("string_agg(t, chr(10) ORDER BY pos)")} AS text FROM (SELECT *, sum(CASE WHEN before OR h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM
  (SELECT *, coalesce(lag(t = '' OR h) OVER (PARTITION BY doc_id ORDER BY pos), true) AS before FROM (SELECT *, {_HEAD} AS h FROM (SELECT *, {T} AS t FROM lines)))) WHERE t <> '' GROUP BY doc_id, para)"""


@query(f"WITH {fx.LINES_SQL}, {_PARAS} SELECT doc_id, CAST(para AS BIGINT) AS para, text FROM paras")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.paragraphs(_lines(spark, sf_dir), KEY)


@query(
    f"""WITH {fx.LINES_SQL}, {_PARAS}, m AS (SELECT *, lead(h) OVER w AS nh, lag(h) OVER w AS ph, lag(text) OVER w AS title FROM (SELECT doc_id, CAST(para AS BIGINT) AS para, text,
      length(text) <= 40 AND regexp_matches(text, '^[「《]') AND NOT regexp_matches(text, '[{chars.HEADING_STOPS}]$') AS h FROM paras) WINDOW w AS (PARTITION BY doc_id ORDER BY para))
    SELECT doc_id, para, CASE WHEN NOT h AND coalesce(ph, false) THEN title || chr(10) || chr(10) || text ELSE text END AS text FROM m WHERE NOT (h AND NOT coalesce(nh, true))"""
)
def attach_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.attach_headings(segment.paragraphs(_lines(spark, sf_dir), KEY), KEY)


@query(
    """WITH o AS (SELECT conv_id AS document_id, list(text ORDER BY turn) AS l FROM conversations WHERE text <> '' GROUP BY 1),
    p AS (SELECT document_id, list_reduce([{'d': []::VARCHAR[], 'o': ''}] || list_transform(l, lambda x: {'d': []::VARCHAR[], 'o': x}),
      lambda a, x: CASE WHEN a.o = '' THEN {'d': a.d, 'o': x.o} WHEN length(a.o) + 2 + length(x.o) <= 600 THEN {'d': a.d, 'o': a.o || chr(10) || chr(10) || x.o}
      ELSE {'d': list_append(a.d, a.o), 'o': x.o} END) AS r FROM o), c AS (SELECT document_id, list_append(r.d, r.o) AS c FROM p)
    SELECT document_id, unnest(range(len(c))) AS chunk, unnest(c) AS text FROM c"""
)
def pack_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.sort_array(F.collect_list(F.struct("page_number", "text"))), lambda r: r["text"])
    packed = fx.conversations(spark, sf_dir).where("text <> ''").groupBy("document_id").agg(segment.pack(rows, 600).alias("c"))
    return packed.select("document_id", F.posexplode("c").alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


_JOINED = "SELECT document_id, CASE WHEN len(c) > 1 AND {last} < 30 AND len({both}) <= 600 AND {whole} <= 420 THEN list_append(c[1 : len(c) - 2], {both}) ELSE c END AS c FROM c"
_BOTH = "(c[len(c) - 1] || chr(10) || chr(10) || c[len(c)])"


@query(
    ORACLES["pack_segments"].split("SELECT document_id, unnest(range")[0]
    + ", j AS (" + _JOINED.format(last=_spoken("c[len(c)]"), both=_BOTH, whole=_spoken(_BOTH)) + ") SELECT document_id, unnest(range(len(c))) AS chunk, unnest(c) AS text FROM j"
)
def join_short_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = segment.Limits(characters=600)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("page_number", "text"))), lambda r: r["text"])
    packed = fx.conversations(spark, sf_dir).where("text <> ''").groupBy("document_id").agg(segment.merge_short_tail(segment.pack(rows, 600), limits).alias("c"))
    return packed.select("document_id", F.posexplode("c").alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


def _glued(a: str, x: str) -> str:
    n = f"len(regexp_extract_all({x}, '{_W}'))"
    title = f"(length({a}) <= 40 AND regexp_matches({a}, '^[「《]') AND NOT regexp_matches({a}, '[{chars.HEADING_STOPS}]$'))"
    return f"({n} BETWEEN 1 AND 8 AND {n} * 2 >= length({x}) AND NOT {title} AND regexp_matches({a}, '{_W}$') AND regexp_matches({x}, '^{_W}'))"


@query(
    f"""WITH {fx.LINES_SQL}, {_PARAS}, l AS (SELECT doc_id, list(text ORDER BY para) AS t FROM paras GROUP BY 1),
    m AS (SELECT doc_id, list_reduce(list_transform(t, lambda x: [x]), lambda a, x: CASE WHEN {_glued("a[len(a)]", "x[1]")} THEN list_append(a[1 : len(a) - 1], a[len(a)] || x[1]) ELSE list_concat(a, x) END) AS t FROM l)
    SELECT doc_id, unnest(range(len(t))) AS place, unnest(t) AS text FROM m"""
)
def glue_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = segment.glue_fragments(segment.paragraphs(_lines(spark, sf_dir), KEY), KEY)
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("para")) - 1
    return merged.select("doc_id", place.cast("long").alias("place"), "text")


@query("SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS page_number, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS segment_number FROM conversations")
def number_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.number_segments(fx.conversations(spark, sf_dir).select("document_id", "page_number"), "document_id", ["page_number"])


@query()
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("para"), "text")
    return segment.split_paragraphs(docs)


@query()
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "documents").withColumn("page_number", F.lit(1))
    return segment.segment_pages(pages, "doc_id", "page_number", "text")


@query()
def segment_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_pages(fx.conversations(spark, sf_dir), "document_id", "page_number", "text")
