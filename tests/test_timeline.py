"""Sessions, as-of joins and keyed state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import ranks, timeline
from leafmill.streaming import keyed, progress


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(ranks, "SAMPLE", 64)
    monkeypatch.setattr(ranks, "SLICES", 16)


def test_sessions_cross_slices(spark, small_slices):
    rng = random.Random(3)
    rows, t = [], 0
    for _ in range(900):
        t += rng.choice([0, 1, 5, 9, 10, 11, 40])
        rows.append((rng.choice(["a", "a", None, "b"]), t))
    rows += [("c", 5 * k) for k in range(1500)] + [("a", None)]  # one session through all slices
    events = spark.createDataFrame([(k, None if s is None else at(s)) for k, s in rows], "k string, ts timestamp").withColumn("v", F.lit(1.0))
    got = sorted((str(r.k), r.session_start, r.session_end, r.events, r.total) for r in timeline.sessions(events, ["k"], "ts", "10 SECONDS", "v").collect())
    want = []
    for k in ("a", "b", "c", None):
        times = sorted(s for x, s in rows if x == k and s is not None)
        runs = []
        for s in times:
            if runs and s - runs[-1][-1] <= 10:
                runs[-1].append(s)
            else:
                runs.append([s])
        want += [(str(k), at(r[0]), at(r[-1]), len(r), float(len(r))) for r in runs]
    assert got == sorted(want) and ("c", at(0), at(7495), 1500, 1500.0) in got
    assert timeline.sessions(events.limit(0), ["k"], "ts", "10 SECONDS").count() == 0


def test_as_of_takes_the_last_version_in_time(spark, small_slices):
    rng = random.Random(4)
    left = [(n, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(400)])) for n in range(800)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(0, 400, 7)]), rng.randrange(5), None if n % 9 == 0 else n) for n in range(120)]
    events = spark.createDataFrame([(n, k, None if s is None else at(s)) for n, k, s in left], "n int, k string, ts timestamp")
    versions = spark.createDataFrame([(k, None if s is None else at(s), i, v) for k, s, i, v in right], "k string, ts timestamp, i int, v int")
    got = {r.n: (r.k, r.i, r.v) for r in timeline.as_of(events, versions, ["k"], "ts", ["i", "v"], "v").collect()}
    assert len(got) == 800
    for n, k, s in left:
        fit = [(t, -1 if v is None else v, i, v) for x, t, i, v in right if k is not None and s is not None and x == k and t is not None and t <= s]
        best = max(fit, default=(None, None, None, None), key=lambda r: r[:2])
        assert got[n][2] == best[3], n
    assert timeline.as_of(events, versions.limit(0), ["k"], "ts", ["v"]).where("v IS NULL").count() == 800
    assert timeline.as_of(events.limit(0), versions, ["k"], "ts", ["v"]).count() == 0


EVENT = "user_id int, document_id string, ts timestamp, event_id long, segment_number int, position_seconds double, playback_speed double, ended boolean, parts int"


def test_keyed_state_equals_the_latest(spark, tmp_path):
    """Shuffled, repeated and late events, over a restart."""
    rng = random.Random(5)
    rows = [(rng.randrange(4), rng.choice("xy"), at(rng.randrange(300)), n, n % 5 + 1, float(n), 1.0, n % 4 == 0, 5) for n in range(240)]
    shuffled = rows + rng.sample(rows, 60)
    rng.shuffle(shuffled)
    before = spark.conf.get(keyed.PROVIDER[0], None)
    spark.conf.set(*keyed.PROVIDER)
    try:
        source = f"{tmp_path}/events"

        def run(parts):
            for part in parts:
                spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
            out = keyed.keyed_progress(stream, idle="1 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
            out.trigger(availableNow=True).start().awaitTermination()

        run([shuffled[:100], shuffled[100:180]])
        run([shuffled[180:]])  # a new query goes on from the checkpoint
    finally:
        spark.conf.unset(keyed.PROVIDER[0]) if before is None else spark.conf.set(keyed.PROVIDER[0], before)
    written = spark.read.parquet(f"{tmp_path}/out")
    columns = ["user_id", "document_id", "ts", "event_id", "current_segment_number", "position_seconds", "playback_speed", "completed"]
    got = progress.latest(written.where("NOT idle").drop("idle")).select(columns)
    want = progress.latest(progress.transition(spark.createDataFrame(rows, EVENT))).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # No write comes out twice, and none that something newer had overridden.
    assert written.where("NOT idle").groupBy("event_id").count().where("count > 1").count() == 0


def test_listeners_go_idle(spark, tmp_path):
    spark.conf.set(*keyed.PROVIDER)
    try:
        for k, s in enumerate((0, 10, 500, 1000)):
            spark.createDataFrame([(1 if s < 100 else 2, "x", at(s), k, 1, 0.0, 1.0, False, 5)], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
        out = keyed.keyed_progress(stream, late="10 seconds", idle="2 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(keyed.PROVIDER[0])
    idle = [(r.user_id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out").where("idle").orderBy("ts").collect()]
    assert idle[0] == (1, 1) and len(idle) == len(set(idle))


PAGE = "id string, document_id string, page_number int, extraction_method string, extracted_text string, processing_status string"


def test_the_page_job_survives_stops(spark, tmp_path, monkeypatch):
    """Stopped before a save, after one, and between batches: the same tables."""
    from leafmill.sources import graph
    from leafmill.streaming import job

    rng = random.Random(6)
    rows = [(f"d{k % 9}/{k}", f"d{k % 9}", k, rng.choice(["embedded_text", "embedded_text", "ocr"]), rng.choice(["  text ", "", "more"]), rng.choice(["pending", "pending", "completed"])) for k in range(120)]
    rows += [(i, d, p, "embedded_text", "again", "pending") for i, d, p, *_ in rows[:20]]  # pages that come once more
    parts = [rows[:50], rows[50:90], rows[90:]]
    for part in parts:
        spark.createDataFrame(part, PAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/pages")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")

    def tables(g):
        return [sorted(map(tuple, g.read(t).select(sorted(g.read(t).columns)).collect())) for t in ("documents", "pages")]

    whole = graph.Graph(spark, f"{tmp_path}/whole", buckets=4)
    job.prepare(whole, stream, f"{tmp_path}/whole-check", now).awaitTermination()
    broken = graph.Graph(spark, f"{tmp_path}/broken", buckets=4)
    plain, stops = job.apply, iter(["before", "after", "before", None, "after", None, None])

    def stopping(g, batch, number, at_):
        stop = next(stops)
        if stop == "before":
            raise RuntimeError("stopped before saving")
        plain(g, batch, number, at_)
        if stop == "after":
            raise RuntimeError("stopped after saving")

    monkeypatch.setattr(job, "apply", stopping)
    runs = 0
    while True:
        runs += 1
        try:
            job.prepare(broken, stream, f"{tmp_path}/broken-check", now).awaitTermination()
            break
        except Exception as why:
            assert "stopped" in str(why)
    assert runs == 5 and broken.manifest().number == whole.manifest().number == 3
    assert tables(broken) == tables(whole)
    # And what the tables say is what all pages together say.
    last = {}
    for part in parts:
        last |= {r[0]: r for r in part}
    state = {i: ("completed" if t.strip() else "failed") if m == "embedded_text" and s == "pending" else s for i, _, _, m, t, s in last.values()}
    for r in broken.read("documents").collect():
        mine = [s for i, s in state.items() if last[i][1] == r.id]
        assert (r.seen_pages, r.completed_pages, r.failed_pages) == (len(mine), mine.count("completed"), mine.count("failed"))
        assert r.status == ("failed" if "failed" in mine else "text_ready" if set(mine) == {"completed"} else "extracting_text")
