"""Layout, lifecycle, storage, media and streaming cases."""

import datetime as dt
import struct

from pyspark.sql import functions as F

from leafmill.functions import geometry, names
from leafmill.operators import layout, library, lifecycle
from leafmill.sources import media, store
from leafmill.streaming import progress

LINE = "page long, pos int, text string, confidence double, y_min double, x_min double, x_max double"


def test_two_bands_from_two_bars(spark):
    rows = [(1, y, 100.0 if 40 <= y < 60 or 110 <= y < 130 else 0.0) for y in range(200)]
    df = spark.createDataFrame(rows, "page long, y long, ink double")
    frame = spark.createDataFrame([(1, 40.0, 180.0, 0, 200, 200, 400)], "page long, gap double, first_y double, left int, right int, width int, height int")
    got = layout.ink_bands(df, frame, ["page"]).orderBy("top").collect()
    assert [(r.top, r.bottom) for r in got] == [(20, 80), (90, 150)]  # two rows of smoothing, 18 of padding


def test_better_top_line_wins_and_untrusted_warns(spark):
    body = "這是頁面的正文，內容很長很長很長。"
    lines = spark.createDataFrame([(1, 0, body, 0.95, 300.0, 40.0, 900.0)], LINE)
    new = spark.createDataFrame(
        [(1, 0, "頂端的第一行文字應該回來了", 0.91, 100.0, 40.0, 800.0), (1, 1, "頂端的第一行文字應該回來", 0.97, 102.0, 40.0, 800.0), (1, 2, "完全不同而又不可信的一行", 0.5, 150.0, 400.0, 800.0)], LINE
    )
    got = layout.merge_top_lines(new, lines, ["page"]).orderBy("pos").collect()
    assert [r.text for r in got] == ["頂端的第一行文字應該回來", body] and all(r.warning for r in got)


def test_predictions_clamp_and_drop_blanks(spark):
    df = spark.sql("SELECT 1L AS k, array(' a ', ' ') AS rec_texts, array(1.2D, 0.5D) AS rec_scores, array(array(1D, 2D, 3D, 4D), array(0D, 0D, 0D, 0D)) AS rec_boxes")
    got = layout.normalize_predictions(df, ["k"]).collect()
    assert [(r.text, r.confidence, r.y_min, r.x_min, r.x_max) for r in got] == [("a", 1.0, 2.0, 1.0, 3.0)]


def test_similarity_needs_length():
    assert layout.similar("a b", "ab") and not layout.similar("abcd", "abce")
    assert layout.similar("the quick brown fox", "the quick brown fix")


def test_folder_takes_the_earliest_and_reports_by_priority(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [
        (1, 9, " Walk ", None, "ready", "english", 2, at(2), at(5)),
        (2, 9, "walk", None, "failed", None, 3, at(1), at(4)),
        (3, 9, "Other", 2, "running_ocr", "mandarin", 1, at(3), at(9)),
        (4, 9, "Lone", 77, "ready", "english", 1, at(3), at(3)),
    ]
    df = spark.createDataFrame(rows, "id long, user_id long, title string, library_document_id long, status string, target_language string, total_pages int, created_at timestamp, updated_at timestamp")
    got = {r.folder_id: r for r in library.folders(df).collect()}
    assert set(got) == {2, 77}
    assert (got[2].title, got[2].recording_count, got[2].total_pages, got[2].processing_status, got[2].target_languages, got[2].processing_active) == ("Other", 3, 6, "running_ocr", "english,mandarin", True)


def test_finalize_messages(spark):
    df = spark.createDataFrame([(1, "failed"), (1, "completed"), (2, "completed"), (3, "pending")], "document_id long, processing_status string")
    got = {r.document_id: (r.status, r.error_message) for r in lifecycle.finalize_text(df).collect()}
    assert got == {1: ("failed", "1 page still need attention."), 2: ("text_ready", None), 3: ("extracting_text", None)}


def test_crops_and_names(spark):
    row = spark.range(1).select(
        geometry.crop_valid(*[F.lit(None).cast("double")] * 4).alias("none"),
        geometry.crop_valid(F.lit(0.1), F.lit(0.1), F.lit(0.1), F.lit(0.9)).alias("flat"),
        geometry.crop_pixels(F.lit(0.999), F.lit(0.0), F.lit(1.0), F.lit(0.001), F.lit(10), F.lit(10)).alias("px"),
        names.download_name(F.lit("dir/My book (1).pdf"), "x").alias("name"),
        names.download_name(F.lit("..."), "x").alias("empty"),
        names.inside(F.lit("a/../b")).alias("inside"),
    ).first()
    assert (row.none, row.flat, tuple(row.px), row.name, row.empty, row.inside) == (True, False, (9, 0, 10, 1), "My-book-1", "x", True)


def test_upsert_keeps_the_newest(spark):
    schema = "id long, v string, updated_at timestamp"
    t = lambda d: dt.datetime(2024, 1, d)
    old = spark.createDataFrame([(1, "a", t(1)), (2, "b", t(1))], schema)
    new = spark.createDataFrame([(2, "c", t(2)), (2, "d", t(3)), (3, "e", t(1))], schema)
    assert sorted((r.id, r.v) for r in store.upsert(old, new, ["id"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_folders_without_owner_or_title(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, None, "Walk", None, "ready", 2, at(2)), (2, None, "walk ", None, "failed", 3, at(1)), (3, 9, None, None, "ready", 1, at(3)), (4, 9, "Walk", None, "ready", 1, at(3))]
    df = spark.createDataFrame(rows, "id long, user_id long, title string, library_document_id long, status string, total_pages int, created_at timestamp")
    df = df.withColumns({"updated_at": F.col("created_at"), "target_language": F.lit("english"), "recording_title": F.lit(None).cast("string"), "original_filename": F.when(F.col("id") == 2, "w.pdf")})
    got = {(r.user_id, r.folder_id): r.recording_count for r in library.folders(df).collect()}
    assert got == {(None, 2): 2, (9, 3): 1, (9, 4): 1}
    titles = {r.id: r.display_title for r in library.folder_members(df).collect()}
    assert titles == {1: "Recording 1", 2: "w.pdf", 3: "Recording 1", 4: "Recording 1"}


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 30, 20) + b"\x08\x02\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 50, 60) + b"\0" * 12
    df = spark.createDataFrame([(0, bytearray(png)), (1, bytearray(jpeg)), (2, bytearray(b"%PDF-1.7")), (3, bytearray(b""))], "i int, content binary")
    got = df.select("i", media.image_error(F.col("content"), 1000).alias("e"), media.is_pdf(F.col("content")).alias("pdf")).orderBy("i").collect()
    assert [(r.e, r.pdf) for r in got] == [(None, False), ("image_too_large", False), ("image_unreadable", True), ("image_unreadable", False)]


def test_mock_speech_and_disabled_reading(spark):
    df = spark.createDataFrame([("x" * 70,), (None,)], "source_text string")
    assert [r.duration_seconds for r in media.synthesize(df).collect()] == [2.0, None]
    assert media.recognize(df, None).first().error_code == "ocr_disabled"


def test_speaking_completes_or_fails_segment_by_segment(spark):
    def provider(text):
        if "bad" in text:
            raise RuntimeError
        return media.mock_speech(text)

    rows = [(1, "a text", "pending", None), (2, "bad", "failed", None), (3, "kept", "completed", "audio/old.mp3"), (4, None, "generating", None)]
    df = spark.createDataFrame(rows, "segment_number int, source_text string, processing_status string, audio_storage_path string")
    got = {r.segment_number: (r.processing_status, r.audio_storage_path, r.error_message, r.duration_seconds) for r in media.speak(df, provider).collect()}
    assert got == {1: ("completed", "audio/segment-0001.wav", None, 1.2), 2: ("failed", None, media.NO_AUDIO, None), 3: ("completed", "audio/old.mp3", None, None), 4: ("failed", None, media.NO_AUDIO, None)}


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = [(1, "d", dt.datetime(2024, 1, 1, 0, k), k, k % 3 + 1, float(k), 1.0, k % 4 == 0, 3) for k in range(20)]
    rows += [(2, "d", dt.datetime(2024, 1, 1), 50, 3, 9.0, 1.5, True, 3)]
    schema = "user_id long, document_id string, ts timestamp, event_id long, segment_number int, position_seconds double, playback_speed double, ended boolean, parts int"
    batch = spark.createDataFrame(rows, schema)
    for k in range(3):
        batch.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = progress.stream_latest(stream, str(tmp_path / "state"), str(tmp_path / "check"))
    run.awaitTermination(120)
    want = progress.latest(progress.transition(batch))
    got = progress.current(spark, str(tmp_path / "state"), want.schema)
    # One key: its bucket keeps its version and the one before.
    touched = [p.parent.name for p in (tmp_path / "state").glob("batch=*/bucket=*")]
    assert len(touched) <= 4 and "batch=0" not in touched
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    done = want.where("user_id = 2").first()
    assert done.completed and done.position_seconds == 0


def test_empty_slots_take_their_best_candidate(spark):
    body = "這是頁面的正文，內容很長很長很長。"
    lines = spark.createDataFrame([(1, 0, body, 0.95, 300.0, 40.0, 900.0)], LINE)
    new = spark.createDataFrame(
        [(1, 0, "遺漏的一行文字現在可以補回來", 0.87, 100.0, 60.0, 800.0), (1, 1, "同一處另一個較差的讀法不要用", 0.86, 101.0, 60.0, 800.0)], LINE
    )
    bands = spark.createDataFrame([(1, 90.0, 120.0)], "page long, top double, bottom double")
    got = layout.merge_top_lines(new, lines, ["page"], bands=bands).orderBy("pos").collect()
    assert [r.text for r in got] == ["遺漏的一行文字現在可以補回來", body]
    assert [r.text for r in layout.merge_top_lines(new, lines, ["page"]).collect()] == [body]


def test_recovery_is_wanted(spark):
    body = "這是頁面的正文，內容很長很長很長。"
    rows = [(1, k, body, 0.9, 50.0 + 30 * k, 0.0, 9.0) for k in range(4)]  # early, several
    rows += [(2, 0, body, 0.9, 500.0, 0.0, 9.0), (3, 0, "short", 0.9, 10.0, 0.0, 9.0)]  # late; no body
    rows += [(4, 0, "Head", 0.9, 10.0, 0.0, 9.0)] + [(4, k, body, 0.9, 50.0 + 30 * k, 0.0, 9.0) for k in range(1, 4)]
    got = {r.page: r.recover for r in layout.needs_top_recovery(spark.createDataFrame(rows, LINE), ["page"]).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}


def test_sweep_and_ink(spark):
    first = spark.createDataFrame([(1, 200.0, 40.0)], "page long, first_y double, gap double")
    got = [(r.top, r.bottom) for r in layout.sweep_bands(first, ["page"]).orderBy("pos").collect()]
    assert got[0] == (60.0, 128.0) and got[-1] == (146.0, 214.0) and len(got) == 5
    pixels = spark.createDataFrame([(1, x, y, 20 if y == 3 and x < 4 else 255) for x in range(6) for y in range(5)], "page long, x int, y int, grey int")
    assert {r.y: r.ink for r in layout.ink_counts(pixels, ["page"], 1, 6).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}


def test_rotations_and_rows(spark):
    df = spark.createDataFrame([("[0, 90]", 2), ("[0]", 2), ("[45, 0]", 2), ("{", 1), ("[]", 0), ('["x"]', 1)], "t string, n int")
    rotations, error = names.rotations_error(F.col("t"), F.col("n"))
    got = [(r.a, r.e) for r in df.select(rotations.alias("a"), error.alias("e")).collect()]
    assert got == [([0, 90], None), (None, "invalid_rotations"), (None, "invalid_rotation"), (None, "invalid_rotations"), ([], None), (None, "invalid_rotation")]
    rows = spark.createDataFrame([("a.png", None)], "original_image_storage_path string, warning_messages array<string>")
    assert store.to_records(rows).first().asDict() == {"original_image_path": "a.png", "warning_messages": []}
    assert store.to_rows(store.to_records(rows)).columns == rows.columns


def test_rotations_are_whole_numbers(spark):
    texts = ['[0, 270]', '["90", "0"]', "[90.0, 0]", "[90, null]", "[90]", "{}", "", None, "[45, 0]", " [ 90 , 180 ] "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found, error = names.rotations_error(F.col("t"), F.lit(2))
    got = {r.k: (r.f, r.e) for r in df.select("k", found.alias("f"), error.alias("e")).collect()}
    assert got[0] == ([0, 270], None) and got[9] == ([90, 180], None)
    assert [got[k][1] for k in range(1, 9)] == ["invalid_rotation"] * 3 + ["invalid_rotations"] * 4 + ["invalid_rotation"]


def test_archive_members_keep_number_and_extension(spark):
    rows = [("d", 1, "audio/a.mp3"), ("d", 3, "audio/b"), ("d", 1000, "x.y/c.ogg"), ("d", 4, None), ("d", 5, "audio/.hidden")]
    segments = spark.createDataFrame(rows, "document_id string, segment_number int, audio_storage_path string").withColumn("processing_status", F.lit("completed"))
    got = {r.segment_number: r.member for r in library.archive_manifest(segments).collect()}
    assert got == {1: "part-001.mp3", 3: "part-003.wav", 1000: "part-1000.ogg", 5: "part-005.wav"}


def test_recording_titles_come_from_files(spark):
    from leafmill.sources import store

    rows = [(1, "Old", "a/scan.v2.pdf", None), (2, "Old", None, None), (3, "Old", "x.pdf", "Mine"), (4, "Old", "", None), (5, "Old", "y.pdf", None)]
    docs = spark.createDataFrame(rows, "id long, title string, original_filename string, recording_title string").withColumn("library_document_id", F.lit(None).cast("long"))
    moves = spark.createDataFrame([(k, 9, "Shelf") for k in (1, 2, 3, 4)] * 2, "id long, folder_id long, folder_title string")
    got = {r.id: (r.title, r.recording_title) for r in store.assign_folder(docs, moves).collect()}
    assert got == {1: ("Shelf", "scan.v2"), 2: ("Shelf", "Recording"), 3: ("Shelf", "Mine"), 4: ("Shelf", "Recording"), 5: ("Old", None)}


def test_places_of_one_large_group_and_ties(spark):
    from leafmill.operators import ranks

    rows = [(None if k % 3 else "a", k % 50, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, id int")
    for descending in (False, True):
        got = ranks.with_place(df, ["g"], [F.col("t"), F.col("id")], "place", descending).collect()
        assert len(got) == 3000
        for g in (None, "a"):
            mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
            assert [r.place for r in mine] == list(range(1, len(mine) + 1))
            assert [(r.t, r.id) for r in mine] == sorted(((r.t, r.id) for r in mine), reverse=descending)
    assert ranks.with_place(df.limit(0), ["g"], [F.col("t")], "place").count() == 0


def test_slices_are_found_by_halving(spark):
    """As many cuts as lie at or under a value, in seven looks at 64."""
    from leafmill.operators import ranks

    for n in (0, 1, 2, 3, 63, 64, 65):
        cuts = [(k // 2, "x") for k in range(n)]
        constant = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in cuts]).cast("array<struct<a:int,b:string>>")
        values = spark.createDataFrame([(a, b) for a in range(-1, 35) for b in ("w", "x", "y")] + [(None, "x")], "a int, b string")
        got = values.select("a", "b", ranks._upto(constant, n, F.struct("a", "b")).alias("at")).collect()
        assert all(r.at == (0 if r.a is None else sum(c <= (r.a, r.b) for c in cuts)) for r in got)


def test_last_requests(spark):
    from leafmill.operators import requests

    rows = [(1, 5, "a"), (1, 7, "b"), (1, 7, "b"), (2, 1, "c"), (None, 1, "d"), (None, 2, "e")]
    kept, others = requests.last_requests(spark.createDataFrame(rows, "k int, requested_at int, v string"), ["k"])
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, 7, "b"), (2, 1, "c"), (None, 2, "e")], key=repr)
    assert sorted(((r.k, r.v, r.times) for r in others.collect()), key=repr) == sorted([(1, "a", 1), (1, "b", 1), (None, "d", 1)], key=repr)


def test_what_a_key_deals_stays_dealt(spark):
    """A number of tasks that is asked for isn't put together again."""
    from pyspark.sql import functions as F

    from leafmill.operators import lifecycle

    pages = spark.range(3000).selectExpr("id % 1000 AS document_id", "'failed' AS processing_status", "'ocr' AS extraction_method")
    docs = spark.range(1000).selectExpr("id", "'uploaded' AS status", "'' AS error_message", "current_timestamp() AS updated_at")
    asked = spark.range(500, 1500).select("id").unionByName(spark.range(1400, 1500).select("id"))
    refused = lifecycle.start_text(docs, pages, asked)[1].withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.id for r in refused) == list(range(500, 1500)) and len({r.p for r in refused}) > 8
