"""PNG files against plain loops, and the search for paper."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.operators import images


def predicted(kind, a, b, c):
    if kind == 4:
        p = a + b - c
        near = sorted(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))
        return near[0][2]
    return (0, a, b, (a + b) // 2)[kind]


def filtered(rows, kinds, pixel):
    """Scanlines as a writer filters them, byte by byte."""
    out = []
    for y, (row, kind) in enumerate(zip(rows, kinds)):
        above = rows[y - 1] if y else bytes(len(row))
        line = [kind]
        for x, v in enumerate(row):
            a, c = (row[x - pixel], above[x - pixel]) if x >= pixel else (0, 0)
            line.append((v - predicted(kind, a, above[x], c)) & 255)
        out.append(bytes(line))
    return b"".join(out)


def png(width, height, depth, colour, body, palette=b"", interlaced=0):
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))] + ([(b"PLTE", palette)] if palette else [])
    packed = zlib.compress(body)
    parts += [(b"tEXt", b"a\0b"), (b"IDAT", packed[:5]), (b"IDAT", packed[5:]), (b"IEND", b"")]
    return images.SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_every_kind_reads_as_by_loops(data):
    colour = data.draw(st.sampled_from(sorted(images.CHANNELS)))
    depth = data.draw(st.sampled_from(images.DEPTHS[colour]))
    w, h, interlaced = data.draw(st.integers(1, 11)), data.draw(st.integers(1, 10)), data.draw(st.integers(0, 1))
    channels, seed = images.CHANNELS[colour], data.draw(st.integers(0, 999))
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << depth, (h, w, channels))
    palette = rng.integers(0, 256, (1 << min(depth, 8), 3), dtype=np.uint8)
    body = b""
    for a, b, c, d in images.PASSES if interlaced else ((0, 0, 1, 1),):
        part = values[a::c, b::d]
        if not part.size:
            continue
        rows = []
        for line in part.reshape(len(part), -1):
            bits = "".join(format(v, f"0{depth}b") for v in line)
            bits += "0" * (-len(bits) % 8)
            rows.append(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)))
        kinds = rng.integers(0, data.draw(st.sampled_from([1, 3, 5])), len(rows)).tolist()
        body += filtered(rows, kinds, max(1, channels * depth // 8))
    got, mark = images.decode(png(w, h, depth, colour, body, palette.tobytes() if colour == 3 else b"", interlaced))
    assert mark == 1
    eight = values >> 8 if depth == 16 else values * (255 // ((1 << depth) - 1)) if colour == 0 else values
    want = palette[values[..., 0]] if colour == 3 else eight[..., :3] if channels > 2 else eight[..., 0]
    grey = colour == 0 and depth > 1
    assert (got.ndim == 2) == grey
    if got.ndim == 3 and want.ndim == 2:
        want = np.repeat(want[..., None], 3, axis=2)
    assert (got == want).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.booleans(), st.integers(1, 8), st.sampled_from([0, 90, 180, 270]), st.integers(0, 99))
def test_written_files_read_back_upright(w, h, colour, mark, degrees, seed):
    pixels = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if colour else (h, w), dtype=np.uint8)
    got, found = images.decode(images.encode(pixels, mark))
    assert found == mark and (got == pixels).all()
    # Mirroring and quarter turns, one pixel at a time.
    rows = [list(r) for r in pixels.tolist()]
    mirror, quarters = images.ORIENTATIONS[mark]
    rows = [r[::-1] for r in rows] if mirror else rows
    for _ in range(quarters + degrees // 90):
        rows = [list(r) for r in zip(*rows[::-1])]
    assert images.upright(pixels, mark, degrees).tolist() == [[list(p) if colour else p for p in r] for r in rows]


def test_images_in_and_out(spark):
    base = np.arange(48, dtype=np.uint8).reshape(6, 8)
    good = images.encode(base)
    rows = [
        (0, good, 90, None), (1, good, 0, (0.25, 0.0, 0.75, 0.5)), (2, good, 45, None), (3, good, 0, (0.5, 0.0, 0.5, 1.0)), (4, good[:-20], 0, None),
        (5, b"GIF89a", 0, None), (6, b"\xff\xd8\xff\xe0", 0, None), (7, None, None, None), (8, good[:40] + b"x" + good[41:], 0, None), (9, good, None, (0.0, 0.0, 1e-9, 1e-9)),
    ]
    schema = "id int, content binary, rotation int, crop_left double, crop_top double, crop_right double, crop_bottom double"
    df = spark.createDataFrame([(i, None if c is None else bytearray(c), r, *(b or (None,) * 4)) for i, c, r, b in rows], schema)
    got = {r.id: r for r in images.normalize(df, max_pixels=48).collect()}
    assert images.decode(bytes(got[0].png))[0].tolist() == np.rot90(base, -1).tolist() and (got[0].png_width, got[0].png_height) == (6, 8)
    assert images.decode(bytes(got[1].png))[0].tolist() == base[:3, 2:6].tolist()
    assert images.decode(bytes(got[9].png))[0].tolist() == [[0]]
    want = {2: "invalid_rotation", 3: "invalid_crop", 4: "invalid_image", 5: "unsupported_image", 6: "image_codec_missing", 7: "unsupported_image", 8: "invalid_image"}
    assert {k: got[k].error_code for k in range(10) if got[k].error_code} == want and all(got[k].png is None for k in want)
    assert images.normalize(df, max_pixels=47).where("error_code = 'image_too_large'").count() == 6  # before anything else of the file
    assert images.normalize(df.limit(0)).count() == 0


def plain_paper(pixels):
    """The same search by loops, for images that needn't be shrunk."""
    h, w = len(pixels), len(pixels[0])
    paper = [[max(p) >= 160 and (0 if max(p) == 0 else int(255 * (max(p) - min(p)) / max(p))) <= 65 for p in row] for row in pixels]

    def longest(counts, threshold, least):
        best, start = None, None
        for k, c in enumerate([*counts, -1]):
            if c > threshold and start is None:
                start = k
            if c <= threshold and start is not None:
                if k - start >= least and (best is None or k - start > best[1] - best[0]):
                    best = (start, k)
                start = None
        return best

    x = longest([sum(r[k] for r in paper) for k in range(w)], h * 0.30, w * 0.35)
    y = longest([sum(r) for r in paper], w * 0.30, h * 0.35)
    if w < 100 or h < 100 or x is None or y is None:
        return 0, 0, w, h
    box = max(0, x[0] - round(w * 0.04)), max(0, y[0] - round(h * 0.04)), min(w, x[1] + round(w * 0.04)), min(h, y[1] + round(h * 0.04))
    wide, high = box[2] - box[0], box[3] - box[1]
    return (0, 0, w, h) if wide * high < w * h * 0.40 or (wide >= w * 0.98 and high >= h * 0.98) else box


@pytest.mark.parametrize("seed", range(25))
def test_paper_by_loops(seed):
    rng = np.random.default_rng(seed)
    h, w = int(rng.integers(90, 180)), int(rng.integers(90, 180))
    pixels = rng.integers(0, 120, (h, w, 3)).astype(np.uint8)
    for _ in range(int(rng.integers(1, 3))):
        x, y, a, b = int(rng.integers(0, w // 2)), int(rng.integers(0, h // 2)), int(rng.integers(20, w)), int(rng.integers(20, h))
        pixels[y : y + b, x : x + a] = rng.integers(150, 256, 3)
    # Rows and columns at exactly the least share don't count.
    pixels[: h // 2, :4] = 0
    assert images.paper_box(pixels) == plain_paper(pixels.tolist())


def test_paper_on_large_photographs():
    pixels = np.full((1536, 1024, 3), 40, dtype=np.uint8)
    pixels[150:1380, 90:960] = 230
    left, top, right, bottom = images.paper_box(pixels)
    assert abs(left - (90 - 41)) <= 4 and abs(right - (960 + 41)) <= 4 and abs(top - (150 - 61)) <= 4 and abs(bottom - (1380 + 61)) <= 4
    flat = images.shrink(np.full((90, 60, 3), 77, dtype=np.uint8), 20, 30)
    assert flat.shape == (30, 20, 3) and (flat == 77).all()


def test_one_task_of_rows_is_dealt_over_many(spark):
    from pyspark.sql import functions as F

    rows = spark.range(64).coalesce(1).selectExpr("id", "120 AS w", "110 AS h", "5 AS x0", "5 AS y0", "90 AS x1", "90 AS y1")
    assert images.detect_paper(images.draw_sheets(rows)).select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_images_of_a_batch_are_read_and_written_together():
    """Files of several kinds, a broken one among those of its kind, and the
    calls that a thousand alike take."""
    rng = np.random.default_rng(3)
    many = [rng.integers(0, 256, s, dtype=np.uint8) for s in [(5, 7), (4, 3, 3), (5, 7), (5, 7), (4, 3, 3)]]
    files = [images.encode(p, k + 1) for k, p in enumerate(many)]
    bad = png(7, 5, 8, 0, b"\5" + bytes(7) + b"\0" * 32)
    stacks, marks, errors = images.decode_all([*files[:2], bad, b"", *files[2:]])
    assert {k: p.tolist() for places, stack in stacks for k, p in zip(places, stack, strict=True)} == {
        k: p.tolist() for k, p in zip((0, 1, 4, 5, 6), many, strict=True)
    }
    assert marks == [1, 2, 1, 1, 3, 4, 5] and errors == {2: "invalid_image", 3: "unsupported_image"}
    stack = rng.integers(0, 9, (1000, 6, 8), dtype=np.uint8)
    files = images.encode_all(stack)
    assert files == [images.encode(p) for p in stack]
    (places, same), *more = images.decode_all(files)[0]
    assert places == list(range(1000)) and (same == stack).all() and not more


def test_pixels_are_drawn_by_image_over_batches(spark):
    """Images of one and many batches, blank ones, sizes apart or with the pixels."""
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sizes = [(k, str(k), 3 + k % 4, 2 + k % 3, k % 10) for k in range(40)]
        given = [(k, str(k), x, y, 1 + (k + 5 * x + y) % 250) for k, _, w, h, _ in sizes for x in range(w) for y in range(h) if k % 7 and (x + y + k) % 3]
        pixels = spark.createDataFrame(given, "a int, b string, x int, y int, n long").repartition(5)
        size = spark.createDataFrame(sizes, "a int, b string, width int, height int, orientation int")
        want = {(k, x, y): 0 for k, _, w, h, _ in sizes for x in range(w) for y in range(h)} | {(a, x, y): n for a, _, x, y, n in given}
        files = images.draw(pixels, size, ["a", "b"])
        assert {(r.a, r.x, r.y): r.n for r in images.read_pixels(files).collect()} == want
        marks = {r.a: images.decode(bytes(r.content))[1] for r in files.collect()}
        assert marks == {k: m if 1 <= m <= 8 else 1 for k, *_, m in sizes}
        carried = images.draw(pixels.join(size, ["a", "b"]), None, ["a", "b"])
        assert {(r.a, r.x, r.y): r.n for r in images.read_pixels(carried, least=1).collect()} == {k: n for k, n in want.items() if n}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_upright_pixels_computes_each_step_once(spark, small):
    """The filter doesn't carry the steps before it, and sizes beside the pixels
    give what sizes on them give."""
    from leafmill.functions import geometry
    from leafmill.plans import scalars

    plan = scalars.upright_pixels(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("CASE WHEN") < 40
    marks = [(k, 5, 3, (None, *range(10))[k % 11], (None, 0, 90, 180, 270)[k % 5], *((0.2, 0.0, 0.9, 0.7) if k % 3 else [None] * 4)) for k in range(165)]
    names = ["crop_left", "crop_top", "crop_right", "crop_bottom"]
    sizes = spark.createDataFrame(marks, "k int, width int, height int, orientation int, rotation int, " + ", ".join(f"{c} double" for c in names))
    pixels = sizes.selectExpr("k", "explode(sequence(0, 14)) AS n").selectExpr("k", "n % 5 AS x", "CAST(n DIV 5 AS INT) AS y", "n")
    want = {}
    for k, w, h, mark, degrees, *box in marks:
        grid = images.upright(np.arange(w * h).reshape(h, w), mark if mark in images.ORIENTATIONS else 1, degrees or 0)
        grid = grid if box[0] is None else images.cut(grid, box)
        want |= {(k, x, y): int(grid[y, x]) for y in range(grid.shape[0]) for x in range(grid.shape[1])}
    for got in (geometry.upright_pixels(pixels, sizes, ["k"]), geometry.upright_pixels(pixels.join(sizes, "k"), None, ["k"])):
        assert got.columns == ["k", "x", "y", "n"] and {(r.k, r.x, r.y): r.n for r in got.collect()} == want


def calls(f):
    """Python and C functions called by ``f``."""
    import sys

    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_rows_like_the_one_above_are_read_once():
    """A sheet that is ten times as high, and forty of one size, take hardly more calls."""

    def sheet(h):
        pixels = np.full((h, 120, 3), (60, 40, 30), dtype=np.uint8)
        pixels[h // 10 : h // 2, 10:90] = 245
        return pixels

    low, high = images.encode(sheet(100)), images.encode(sheet(1000))
    assert (images.decode(high)[0] == sheet(1000)).all()
    assert calls(lambda: images.decode(high)) <= calls(lambda: images.decode(low)) + 10
    rng = np.random.default_rng(1)
    some, many = (rng.integers(0, 256, (n, 110, 120, 3), dtype=np.uint8) for n in (1, 40))
    assert calls(lambda: images.encode_all(many)) <= calls(lambda: images.encode_all(some)) + 39 * 20
    assert calls(lambda: images.paper_boxes(many)) <= calls(lambda: images.paper_boxes(some)) + 39 * 30


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 9), st.integers(1, 6), st.sampled_from([1, 3]), st.integers(0, 999))
def test_rows_that_repeat_are_filtered_as_by_loops(n, h, w, pixel, seed):
    """Stacks in which rows repeat the one above, blank ones too: the first of the
    smallest filters, byte by byte, and back."""
    rng = np.random.default_rng(seed)
    stack = rng.integers(0, 256, (n, h, w, pixel), dtype=np.uint8)
    stack[rng.random((n, h)) < 0.3] = 0
    for y in range(1, h):
        again = rng.random(n) < 0.5
        stack[again, y] = stack[again, y - 1]
    for raw, pixels in zip(images.encode_all(stack if pixel == 3 else stack[..., 0]), stack, strict=True):
        rows = [bytes(r) for r in pixels.reshape(h, -1)]
        want = b""
        for y, row in enumerate(rows):
            tried = [filtered([rows[y - 1], row], [0, k], pixel)[len(row) + 1 :] if y else filtered([row], [k], pixel) for k in range(3)]
            want += min(tried, key=lambda line: sum(min(v, 256 - v) for v in line[1:]))
        assert images.opened(raw, 10**6)[3] == want
    lines = np.concatenate([rng.integers(0, 3, (n, h, 1), dtype=np.uint8), stack.reshape(n, h, -1)], axis=2)
    lines[..., 1:][rng.random((n, h)) < 0.5] = 0
    for got, one in zip(images.unfilter(lines, pixel), lines, strict=True):
        above = [0] * (w * pixel)
        for row, (kind, *line) in zip(got.tolist(), one.tolist(), strict=True):
            made = []
            for x, v in enumerate(line):
                made.append((v + (0, made[x - pixel] if x >= pixel else 0, above[x])[kind]) & 255)
            assert row == made
            above = made


def test_photographs_of_a_batch_are_searched_together(spark):
    """Files of several sizes and kinds in one batch, some that are no image:
    each row gets its own box, as by loops."""
    rng, rows = np.random.default_rng(5), []
    for k in range(60):
        h, w = ((110, 130), (120, 101), (90, 140))[k % 3]
        pixels = rng.integers(0, 120, (h, w, 3)).astype(np.uint8)
        if k % 4:
            pixels[:] = pixels[:1]
        x, y, a, b = (int(v) for v in rng.integers((0, 0, 40, 40), (30, 30, 110, 110)))
        pixels[y : y + b, x : x + a] = rng.integers(170, 256)
        pixels = pixels[..., 0] if k % 5 == 0 else pixels
        rows.append((k, pixels, images.encode(pixels)))
    bad = {60: (b"\xff\xd8\xff\xe0", "image_codec_missing"), 61: (None, "unsupported_image"), 62: (rows[0][2][:-20], "invalid_image")}
    given = [(k, bytearray(raw)) for k, _, raw in rows] + [(k, raw and bytearray(raw)) for k, (raw, _) in bad.items()]
    files = spark.createDataFrame([given[k * 25 % 63] for k in range(63)], "k int, content binary").coalesce(1)
    got = {r.k: r for r in images.detect_paper(files).collect()}
    assert len(got) == 63
    boxes = []
    for k, pixels, _ in rows:
        colour = pixels if pixels.ndim == 3 else np.repeat(pixels[..., None], 3, axis=2)
        boxes.append(plain_paper(colour.tolist()))
        assert (got[k].paper_left, got[k].paper_top, got[k].paper_right, got[k].paper_bottom, got[k].error_code) == (*boxes[-1], None)
    assert len({b for b, (_, p, _) in zip(boxes, rows, strict=True) if b != (0, 0, p.shape[1], p.shape[0])}) > 5
    assert {k: (got[k].paper_left, got[k].error_code) for k in bad} == {k: (None, why) for k, (_, why) in bad.items()}


def test_sheets_are_drawn_by_size(spark):
    """Rows in any order keep their own numbers, and their sheet."""
    given = [(k, 100 + k % 3, 110 + k % 2, k % 7, k % 5, 60 + k % 11, 70 + k % 13) for k in range(80)]
    rows = spark.createDataFrame([given[k * 27 % 80] for k in range(80)], "k int, w int, h int, x0 int, y0 int, x1 int, y1 int")
    got = {r.k: r for r in images.draw_sheets(rows).collect()}
    assert len(got) == 80
    for k, w, h, x0, y0, x1, y1 in given:
        want = np.full((h, w, 3), (60, 40, 30), dtype=np.uint8)
        want[y0:y1, x0:x1] = 245
        assert tuple(got[k])[:7] == given[k] and (images.decode(bytes(got[k].content))[0] == want).all()
