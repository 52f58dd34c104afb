"""Cleaning and segmentation cases, on inputs of our own."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import chars
from leafmill.operators import clean, segment


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def lines(spark, texts, language="english", confidence=0.9):
    return spark.createDataFrame([(1, language, i, t, confidence) for i, t in enumerate(texts)], "page long, language string, pos int, text string, confidence double")


def kept(df):
    return [r.text for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("line", "gone"),
    [("014", True), ("Page 15", True), ("- 16 -", True), ("第 17 頁", True), ("p. 3", True), ("第14章", False), ("He was 17 then", False), ("12345", False), ("", False), ("17\n", True)],
)
def test_page_numbers(spark, line, gone):
    assert column(spark, [line], chars.is_page_number) == [gone]


def test_headers_go_only_at_the_edges(spark):
    body = "清晨的海風吹過漁村，老人慢慢走向碼頭。"
    texts = ["第三章 海", "海邊早晨", body, body, body, "第四章 山", body]
    assert kept(clean.drop_headers(lines(spark, texts), ["page"])) == [body, body, body, "第四章 山", body]


@pytest.mark.parametrize(("language", "holder"), [("cantonese", "此處有一個圖表。"), ("mandarin", "此处有一个图表。"), ("english", "There is a chart here."), ("other", "There is a chart here.")])
def test_figures_collapse_once(spark, language, holder):
    texts = ["圖 1 產量", "10 20 30", "", "Figure 2", "來源：年報", "這是一段正文，應該留下來，不應刪去。"]
    got = kept(clean.collapse_figures(lines(spark, texts, language), ["page"], F.col("language")))
    assert got == [holder, texts[-1]]


def test_blank_lines_do_not_end_a_block_and_body_does(spark):
    body = "A sentence of plain prose that is long enough, and stays where it was."
    texts = ["Fig. 3", "", "Jan Feb", body, "Jan Feb"]
    assert kept(clean.collapse_charts(lines(spark, texts), ["page"], F.col("language"))) == ["There is a chart here.", body, "Jan Feb"]


def test_multiset_keeps_first_occurrences(spark):
    all_lines = lines(spark, ["x", "y", "x", "x"])
    some = all_lines.where("pos >= 2")
    assert [r.pos for r in clean.keep_matching(all_lines, some, ["page"]).orderBy("pos").collect()] == [0, 2]


def test_unsure_lines(spark):
    df = spark.createDataFrame([("ab", 0.4), ("ab", 0.5), ("好。", 0.1), ("a long line of text", 0.1), ("  ", 0.9)], "text string, confidence double")
    assert [r.text for r in clean.drop_unsure(df).collect()] == ["ab", "好。", "a long line of text"]


def test_warning_policy(spark):
    page = "There is a chart here.\nThe harbour stayed empty for many years, they said."
    df = spark.createDataFrame([(0, page), (1, "plain"), (2, "")], "i int, text string")
    review, notes = clean.warning_policy(F.array(F.lit("w")), F.col("text"), F.lit("english"))
    got = df.select(review.alias("r"), notes.alias("n")).collect()
    assert [(r.r, r.n) for r in got] == [(False, [chars.FIGURE_NOTE]), (True, ["w"]), (True, ["w"])]


def test_lookalikes_become_plain(spark):
    assert column(spark, [chr(0x2F08) + "a" + chr(0x2ED1)], chars.normalize_lookalikes) == ["人a長"]


def test_spaces_and_lines(spark):
    assert column(spark, ["海 邊　a  b\t 海　 邊"], chars.squeeze_spaces) == ["海邊 a  b  海邊"]
    assert column(spark, ["海\n邊\na"], chars.join_lines) == ["海邊 a"]
    assert column(spark, ["a\r\nb\n", "", "\n"], chars.split_lines) == [["a", "b"], [], [""]]


def test_headings_attach(spark):
    got = segment.attach_headings(segment.paragraphs(lines(spark, ["「序」", "《海》", "正文第一行", "第二行", "", "「尾」"]), ["page"]), ["page"])
    assert [r.text for r in got.orderBy("para").collect()] == ["「序」", "《海》\n\n正文第一行第二行", "「尾」"]


def test_fragments_glue_to_the_merged_tail(spark):
    texts = ["他走了很遠的路", "回家", "了", "The end", "完", "「海」", "邊", "《長" + "路" * 40, "回"]
    df = spark.createDataFrame([(k % 2, n, t) for k in range(2) for n, t in enumerate(texts)], "page int, para int, text string")
    want = ["他走了很遠的路回家了", "The end", "完", "「海」", "邊", "《長" + "路" * 40 + "回"]
    for page in range(2):
        assert [r.text for r in segment.glue_fragments(df, ["page"]).where(F.col("page") == page).orderBy("para").collect()] == want


def test_many_paragraphs_take_linear_time(spark):
    """Twice the paragraphs of one page, less than three times the time."""
    import time

    def seconds(n):
        text = "\n\n".join(f"Paragraph {k} of one page." for k in range(n))
        pages = spark.createDataFrame([(1, 1, text)], "doc int, page int, text string")
        began = time.perf_counter()
        rows = segment.segment_pages(pages, "doc", "page", "text").collect()
        took = time.perf_counter() - began
        assert "\n\n".join(r.source_text for r in sorted(rows, key=lambda r: r.segment_number)) == text
        return took

    seconds(2000)
    assert seconds(64_000) < 3 * seconds(32_000) + 2


def test_seconds_agree(spark):
    texts = ["海邊的早晨，很美。", "It's a well-known word", "", "été 12 ° x", "「」" + chr(0x2F08)]
    got = column(spark, texts, chars.spoken_seconds)
    assert got == pytest.approx([segment.Timed(t).prefixes(0, len(t))[-1] for t in texts])
    assert segment.Timed("a-b-c d").prefixes(0, 7).tolist() == pytest.approx([0, 1 / 2.6, 1 / 2.6, 1 / 2.6, 1 / 2.6, 2 / 2.6, 2 / 2.6, 3 / 2.6])


def test_long_texts_split_at_sentences():
    limits = segment.Limits(characters=20)
    parts = segment.cuts("One two three. Four five six seven. Eight nine ten eleven twelve", limits)
    assert all(len(p) <= 21 for p in parts) and " ".join(parts).startswith("One two three.")


def test_short_tail_merges(spark):
    df = spark.createDataFrame([(["A first piece.", "tail"],), (["Alone."],), ([],)], "t array<string>")
    got = [r.t for r in df.select(segment.merge_short_tail(F.col("t"), segment.Limits(characters=200)).alias("t")).collect()]
    assert got == [["A first piece.\n\ntail"], ["Alone."], []]


def test_packing(spark):
    df = spark.createDataFrame([(["aaaa", "bb", "cccc", "d"],), ([],), (["x" * 30],)], "t array<string>")
    got = [r.c for r in df.select(segment.pack(F.col("t"), 8).alias("c")).collect()]
    assert got == [["aaaa\n\nbb", "cccc\n\nd"], [], ["x" * 30]]


def test_segments_number_over_pages(spark):
    pages = spark.createDataFrame([(1, 2, "second page."), (1, 1, "first page."), (1, 3, "  "), (2, 1, None)], "doc long, page int, text string")
    got = segment.segment_pages(pages, "doc", "page", "text").orderBy("segment_number").collect()
    assert [(r.doc, r.page, r.segment_number, r.source_text) for r in got] == [(1, 1, 1, "first page."), (1, 2, 2, "second page.")]


def test_speech_is_dealt_over_tasks_and_its_tone_is_the_sine(spark):
    import io
    import math
    import struct
    import wave

    from pyspark.sql import functions as F

    from leafmill.sources import media

    rows = spark.range(64).coalesce(1).selectExpr("id", "repeat('x', CAST(id * 5 AS INT)) AS source_text")
    said = media.synthesize(rows).withColumn("p", F.spark_partition_id()).select("p", "id", "audio", "duration_seconds").collect()
    assert len({r.p for r in said}) > 8
    for r in said:
        with wave.open(io.BytesIO(bytes(r.audio))) as w:
            n, raw = w.getnframes(), w.readframes(w.getnframes())
        assert n == int(16_000 * min(8.0, max(1.2, r.id * 5 / 35))) and r.duration_seconds == n / 16_000
        assert list(struct.unpack(f"<{n}h", raw)) == [int(1_800 * math.sin(2 * math.pi * 440.0 * k / 16_000)) for k in range(n)]
    assert len(media.mock_tone(9.5)) == 44 + 2 * int(16_000 * 9.5)


def test_strip_looks_at_the_ends_alone(spark):
    spaces = [chr(k) for k in range(0x3001) if chr(k).isspace()]
    texts = [None, "", "a", " a  b ", "".join(spaces), *[f"{s}{s}x{s}y漢{s}" for s in spaces], "​x​", "😀 "]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", chars.strip(F.col("t")).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: None if t is None else t.strip() for k, t in enumerate(texts)}
    assert "regexp" not in str(chars.strip(F.col("t")))


def test_pieces_leave_by_amount():
    import pandas as pd

    texts = pd.Series(["word. " * 2000, None, "word. " * 900, "word. " * 900, ""], dtype=object)
    parts = list(segment._cut_some(texts, segment.Limits(), bound=10_000))
    assert [len(p) for p in parts] == [1, 3, 1]
    assert pd.concat(parts).tolist() == [None if t is None else segment.cuts(t, segment.Limits()) for t in texts]
