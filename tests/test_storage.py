"""Document files and the graph store: round trips, failures, repeats."""

import json
import os

import pytest
from pyspark.sql import functions as F

from leafmill.sources import files, graph


def documents(spark, n):
    page = "array(struct(concat('p', id) AS id, id AS document_id, 1 AS page_number, 'text é\n' AS extracted_text))"
    return spark.range(n).selectExpr("concat('d', CAST(id AS STRING)) AS id", "concat('Title ', id, ' \"é\"') AS title", "CAST(id % 7 + 1 AS INT) AS total_pages", "TIMESTAMP_SECONDS(id) AS updated_at").selectExpr("*", f"{page} AS pages")


def test_ten_thousand_documents_go_out_and_come_back(spark, tmp_path):
    root = f"{tmp_path}/docs"
    docs = documents(spark, 10_000)
    assert files.write_documents(docs.coalesce(1), root).count() == 0
    read = files.read_documents(spark, root)
    want = {(r.id, r.title, r.total_pages, r.updated_at) for r in docs.select("id", "title", "total_pages", "updated_at").collect()}
    got = read.select("id", "title", "total_pages", "updated_at", "error_code", F.col("pages")[0]["extracted_text"].alias("t")).collect()
    assert len(got) == 10_000 and {tuple(r)[:4] for r in got} == want
    assert all(r.error_code is None and r.t == "text é\n" for r in got)
    assert [r.id for r in got[:2]] == ["d9999", "d9998"]
    assert os.listdir(f"{root}/d7") == ["document.json"] and not os.listdir(f"{root}/.staging")
    # A later save replaces whole documents and leaves the others.
    files.write_documents(docs.where("id = 'd7'").withColumn("title", F.lit("New")), root)
    assert files.read_document(spark, root, "d7").first().title == "New" and len(os.listdir(root)) == 10_001


def test_point_reads_open_one_file(spark, tmp_path):
    root = f"file://{tmp_path}/docs"
    files.write_documents(documents(spark, 50), root)
    one = files.read_document(spark, root, "d7")
    assert one.inputFiles() == [f"file://{tmp_path}/docs/d7/document.json"] and one.first().title == 'Title 7 "é"'
    assert one.dtypes == files.read_document(spark, root, "d99").dtypes
    assert files.read_document(spark, root, "d99").first().error_code == "book_not_found"
    assert [files.read_document(spark, root, x).first().error_code for x in ("..", "", "a/b")] == ["book_not_found"] * 3
    for text in ("{", "[]", '{"id": "d3", "total_pages": "many"}', '{"title": "no id"}'):
        with open(f"{tmp_path}/docs/d3/document.json", "w") as f:
            f.write(text)
        assert files.read_document(spark, root, "d3").first().error_code == "document_metadata_invalid"
    os.mkdir(f"{tmp_path}/docs/empty")
    with open(f"{tmp_path}/docs/loose.txt", "w") as f:
        f.write("not a document")
    read = files.read_documents(spark, root)
    assert read.count() == 50 and read.where("error_code IS NOT NULL").count() == 1
    assert files.read_documents(spark, f"{tmp_path}/nowhere").count() == 0


def test_failed_jobs_leave_nothing(spark, tmp_path):
    root = f"{tmp_path}/docs"
    files.write_documents(documents(spark, 5), root)
    boom = F.udf(lambda i: 1 / 0 if i == "d7" else i)
    with pytest.raises(Exception, match="division"):
        files.write_documents(documents(spark, 20).withColumn("title", boom("id")).repartition(4), root)
    assert sorted(os.listdir(root)) == [".staging", "d0", "d1", "d2", "d3", "d4"]
    files.recover(spark, root)
    assert os.listdir(f"{root}/.staging") == [] and files.read_documents(spark, root).count() == 5


def test_a_job_that_stops_while_publishing_is_finished(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/docs"
    monkeypatch.setattr(files, "publish", lambda *a: None)
    files.write_documents(documents(spark, 30), root)
    monkeypatch.undo()
    assert files.read_documents(spark, root).count() == 0
    (job,) = os.listdir(f"{root}/.staging")
    # Half of one task's files are there already.
    folder = json.load(open(f"{root}/.staging/{job}/manifest.json"))[0]
    for name in sorted(os.listdir(folder))[::2]:
        os.makedirs(f"{root}/{name[:-5]}")
        os.rename(f"{folder}/{name}", f"{root}/{name[:-5]}/document.json")
    os.makedirs(f"{root}/.staging/never/x")
    assert files.recover(spark, root) == {job: True, "never": False}
    assert files.read_documents(spark, root).count() == 30 and files.recover(spark, root) == {}


def test_repeated_and_unusable_ids(spark, tmp_path):
    root = f"{tmp_path}/docs"
    rows = [("a", "old", 1), ("a", "new", 3), ("a", "mid", 2), (None, "n", 1), ("", "e", 1), ("..", "up", 1), ("x/y", "sub", 1), (".h", "hidden", 1), ("_u", "hidden too", 1)]
    docs = spark.createDataFrame(rows, "id string, title string, t int").select("id", "title", F.timestamp_seconds("t").alias("updated_at"))
    refused = files.write_documents(docs, root)
    assert sorted(refused.collect(), key=repr) == sorted([(i, "document_id_invalid") for i in (None, "", "..", "x/y", ".h", "_u")], key=repr)
    assert [(r.id, r.title) for r in files.read_documents(spark, root).collect()] == [("a", "new")]
    assert files.write_documents(docs.limit(0), root).count() == 0


def tables(spark, pages):
    docs = spark.createDataFrame([(f"d{k}", f"T{k}", k) for k in range(40)], "id string, title string, n int")
    rows = [(f"d{k}-{p}", f"d{k}", p, "text") for k in range(40) for p in range(pages)]
    return {"documents": docs, "pages": spark.createDataFrame(rows, "id string, document_id string, page_number int, extracted_text string")}


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")


def test_graph_batches_touch_their_buckets_and_publish_together(spark, tmp_path):
    g = graph.Graph(spark, f"{tmp_path}/g", buckets=16)
    assert g.read("documents") is None and g.manifest().number == 0
    g.save(tables(spark, 3), at(1), "app", 1)
    first = g.manifest()
    assert g.read("documents").count() == 40 and g.read("pages").count() == 120
    batch = {"documents": spark.createDataFrame([("d1", "Changed"), ("new", "New")], "id string, title string"), "pages": tables(spark, 0)["pages"]}
    second = g.save(batch, at(2), "app", 2)
    changed = {b for b in second.folders["documents"] if second.folders["documents"][b] != first.folders["documents"].get(b)}
    assert 1 <= len(changed) <= 2 and second.folders["pages"] == first.folders["pages"]
    got = {r.id: r for r in g.read("documents").collect()}
    # Given columns change, others stay; an empty list of pages keeps the pages.
    assert (got["d1"].title, got["d1"].n, got["d1"].updated_at.day) == ("Changed", 1, 2) and (got["new"].title, got["new"].n) == ("New", None)
    assert (got["d2"].title, got["d2"].updated_at.day) == ("T2", 1) and g.read("pages").count() == 120
    # The same batch again, or an older one, does nothing.
    assert g.save(batch, at(3), "app", 2).number == second.number and g.save(tables(spark, 1), at(3), "app", 1).number == second.number
    assert {r.id: r for r in g.read("documents").collect()} == got
    # The first manifest still reads as it did.
    assert {r.title for r in g.read("documents", g.manifest(1)).collect()} == {f"T{k}" for k in range(40)}
    assert g.point("documents", "d1").first().title == "Changed" and len(g.point("documents", "d1").inputFiles()) <= 2
    third = g.save({"segments": spark.createDataFrame([("s1", "d1")], "id string, document_id string")}, at(4))
    assert third.number == 3 and g.read("segments").count() == 1
    assert g.vacuum(keep=1) == 0 and g.manifest().number == 3 and g.read("documents").count() == 41


def test_graph_repeats_nulls_and_conflicts(spark, tmp_path):
    g = graph.Graph(spark, f"{tmp_path}/g", buckets=4)
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 2), (None, "z", 1), ("b", None, 1)], "id string, title string, t int")
    rows = rows.select("id", "title", F.timestamp_seconds("t").alias("updated_at"), F.lit(None).cast("timestamp").alias("created_at"))
    g.save({"documents": rows}, at(1))
    got = {r.id: (r.title, r.created_at.day, r.updated_at.day) for r in g.read("documents").collect()}
    assert got == {"a": ("y", 1, 1), "b": (None, 1, 1)}
    g.save({"documents": spark.createDataFrame([("a", None)], "id string, title string")}, at(5))
    got = {r.id: (r.title, r.created_at.day, r.updated_at.day) for r in g.read("documents").collect()}
    assert got == {"a": (None, 1, 5), "b": (None, 1, 1)}
    g.save({"documents": rows.limit(0)}, at(6))
    assert g.read("documents").count() == 2
    # Another writer takes the next number between reading and publishing.
    stale = g.manifest()
    g.save({"documents": rows.where("id = 'b'")}, at(7))
    g.manifest = lambda number=None: stale
    with pytest.raises(graph.Conflict):
        g.save({"documents": rows.where("id = 'a'")}, at(8))
    del g.manifest
    assert {r.id: r.updated_at.day for r in g.read("documents").collect()} == {"a": 5, "b": 7}
    with pytest.raises(ValueError, match="no such"):
        g.save({"other": rows}, at(9))
    # What the batch that failed wrote is named by no manifest.
    assert g.vacuum(keep=1) >= 1 and g.read("documents").count() == 2


def test_documents_are_read_by_shares(spark, tmp_path):
    """Any depth, hidden names passed over; every file in one share, whatever
    leaves at once."""
    for name in ("a", "b/c", ".hidden", "_part", "k=1", "_k=1"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "document.json").write_text('{"id": "%s"}' % name)
    (tmp_path / "a" / "other.json").write_text("{}")
    (tmp_path / "document.json").write_bytes(b"\xff no document")
    (tmp_path / "empty").mkdir()
    found = files.read_documents(spark, str(tmp_path))
    rows = found.collect()
    assert sorted(r.id for r in rows if r.id) == ["_k=1", "a", "b/c", "k=1"]
    assert [r.error_code for r in rows if not r.id] == ["document_metadata_invalid"]
    many = tmp_path / "many"
    for k in range(200):
        (many / str(k)).mkdir(parents=True)
        (many / str(k) / "document.json").write_text('{"id": "%d"}' % k)
    texts = spark.range(0, 5, 1, 5).mapInArrow(files._texts(str(many), 5, bound=64), "value binary").collect()
    assert len({r.value for r in texts}) == len(texts) == 200


def test_a_first_save_shuffles_rows_once(spark, tmp_path):
    """Rows of tables that aren't there yet go straight to their buckets, over
    more tasks than there are buckets, and equal keys are still one row."""
    g = graph.Graph(spark, f"file://{tmp_path}", buckets=2)
    rows = spark.range(4000).selectExpr("CAST(id % 2000 AS STRING) AS id", "CAST(id AS STRING) AS status")
    placed = g._placed(rows, 2).withColumn("p", F.spark_partition_id()).groupBy("lm_bucket").agg(F.countDistinct("p").alias("n"))
    assert all(r.n > 2 for r in placed.collect())
    g.save({"documents": rows, "pages": rows.limit(0)}, F.lit("2030-01-01").cast("timestamp"))
    got = g.read("documents").collect()
    assert len(got) == 2000 and all(r.status == max(str(int(r.id)), str(int(r.id) + 2000)) for r in got)
    assert g.read("pages") is None


def test_recovered_segments_meet_their_files_where_they_are(spark, small):
    """No shuffle by path where segments are dealt by document; files that are
    listed twice, of no segment or of no document change nothing."""
    from pyspark.sql import functions as F

    from leafmill.operators import lifecycle
    from leafmill.plans import lifecycle as plans

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.started_segments(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert not [line for line in plan.splitlines() if "Exchange" in line and "lm_path" in line.split("Exchange")[1]]
    rows = [(1, 1, "a.mp3", "failed"), (1, 2, "", "failed"), (1, 3, "c.mp3", "completed"), (2, 1, "a.mp3", "generating"), (None, 1, "a.mp3", "failed")]
    segments = spark.createDataFrame(rows, "document_id long, segment_number int, audio_storage_path string, processing_status string")
    files = spark.createDataFrame([(1, "a.mp3"), (1, "a.mp3"), (1, "audio/segment-0002.mp3"), (3, "a.mp3"), (None, "a.mp3"), (2, None)], "document_id int, path string")
    got = lifecycle.recover_segments(segments, files)
    assert got.columns == segments.columns
    done, wait = "completed", "pending"
    want = {(1, 1): ("a.mp3", done), (1, 2): ("audio/segment-0002.mp3", done), (1, 3): ("c.mp3", done), (2, 1): (None, wait), (None, 1): (None, wait)}
    assert {(r[0], r[1]): (r[2], r[3]) for r in got.collect()} == want and got.count() == 5
    resumed = spark.createDataFrame([(2,), (2,), (None,)], "document_id long")
    some = lifecycle.recover_segments(segments, files, resumed=resumed).where(F.col("processing_status") == wait).collect()
    assert [(r[0], r[1]) for r in some] == [(2, 1)]
