"""Queries without an SQL twin against plain Python on the same rows."""

import difflib
import re

import numpy as np
import pytest

from leafmill.functions import chars
from leafmill.operators import layout, segment
from leafmill.plans import catalogue
from leafmill.plans import layout as plans

QUERIES, _ = catalogue.load()
WIDE = [(0x2E80, 0x2EFF), (0x2F00, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]


def wide(c):
    return len(c) == 1 and any(a <= ord(c) <= b for a, b in WIDE)


def bare(t):
    return "".join(t.split())


def alike(a, b):
    a, b = bare(a), bare(b)
    return a == b or (min(len(a), len(b)) >= 10 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.6)


def seconds(t):
    n_wide = sum(map(wide, t))
    words = len(re.findall("[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?", t))
    other = sum(1 for c in t if ord(c) > 127 and not c.isspace() and not wide(c))
    return n_wide / 3.8 + words / 2.6 + other / 3.2 + sum(c in "。！？!?；;，,、：:." for c in t) * 0.2


def join_tail(parts, limits):
    if len(parts) > 1 and seconds(parts[-1]) < limits.least_seconds:
        joined = parts[-2] + "\n\n" + parts[-1]
        if len(joined) <= limits.characters and seconds(joined) <= limits.soft_seconds:
            return parts[:-2] + [joined]
    return parts


def split(text, limits):
    """By definition: every prefix is timed anew, from the longest down."""
    def first_piece(rest):
        if len(rest) <= limits.characters and seconds(rest) <= limits.soft_seconds:
            return len(rest)
        fits = next((n for n in range(min(len(rest), limits.characters), 0, -1) if seconds(rest[:n]) <= limits.target_seconds), 1)
        stops = [k for k, c in enumerate(rest[: fits + 1]) if c in "。！？!?；;."]
        return stops[-1] + 1 if stops and stops[-1] >= max(1, fits // 2) else fits

    if not (len(text) > limits.characters or seconds(text) > limits.soft_seconds):
        return [text] if text else []
    out, rest = [], text
    while rest:
        n = first_piece(rest)
        out.append(rest[:n].strip() if n < len(rest) or not out else rest)
        rest = rest[n:].strip()
    return join_tail([p for p in out if p], limits)


def heading(t):
    return len(t) <= 40 and t[:1] in ("「", "《") and t[:1] != "" and t[-1:] not in tuple("。！？!?；;，,、：:")


def page_segments(text, limits):
    left, right = chars.lookalike_table()
    lines = text.strip().translate(str.maketrans(left, right)).splitlines()
    paras, held = [], []
    for line in [*(x.strip() for x in lines), ""]:
        if line == "" or heading(line):
            if held:
                paras.append(held)
            held = []
            if line:
                paras.append([line])
        else:
            held.append(line)
    texts = []
    for p in paras:
        t = p[0]
        for x in p[1:]:
            t += ("" if wide(t[-1:]) and wide(x[:1]) else " ") + x
        out = ""
        for k, c in enumerate(t):
            if not c.isspace():
                out += c
            elif not (wide(out[-1:]) and wide(t[k:].lstrip()[:1])):
                out += " "
        texts.append(out)
    merged = []
    for t in texts:
        n = sum(map(wide, t))
        if merged and 0 < n <= 8 and n * 2 >= len(t.strip()) and not heading(merged[-1]) and wide(merged[-1][-1:]) and wide(t[:1]):
            merged[-1] += t
        else:
            merged.append(t)
    attached, title = [], None
    for t in [*merged, None]:
        if t is not None and not heading(t):
            attached.append(t if title is None else title + "\n\n" + t)
            title = None
        else:
            attached += [title] if title is not None else []
            title = t
    packed = []
    for part in (x for t in attached for x in split(t, limits)):
        if packed and len(packed[-1]) + 2 + len(part) <= limits.characters:
            packed[-1] += "\n\n" + part
        else:
            packed.append(part)
    return join_tail(packed, limits)


def test_long_texts_by_definition():
    rng = np.random.default_rng(2)
    letters = list("ab -'.;  海邊。，é\n")
    for limits in (segment.Limits(40, 6, 8, 2), segment.Limits(25, 3, 5, 1), segment.Limits(60, 5, 400, 3)):
        for _ in range(150):
            text = "".join(rng.choice(letters, int(rng.integers(0, 200))))
            want = split(text, limits)
            if len(text) <= limits.characters and seconds(text) <= limits.soft_seconds:
                continue
            assert join_tail(segment.cuts(text, limits), limits) == want


@pytest.mark.parametrize("name", ["split_long", "segment_documents", "segment_conversations"])
def test_segments(spark, small, name):
    limits, got = segment.Limits(), {}
    rows = QUERIES[name](spark, small).collect()
    if name == "split_long":
        for r in sorted(rows, key=lambda r: r.piece):
            got.setdefault(r.doc_id, []).append(r.text)
        want = {r.doc_id: split(r.text or "", limits) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    elif name == "segment_documents":
        for r in sorted(rows, key=lambda r: r.segment_number):
            got.setdefault(r.doc_id, []).append(r.source_text)
        want = {r.doc_id: page_segments(r.text or "", limits) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    else:
        want = {}
        for r in sorted(rows, key=lambda r: r.segment_number):
            got.setdefault(r.document_id, []).append((r.page_number, r.source_text))
        for r in sorted(spark.read.parquet(f"{small}/conversations.parquet").collect(), key=lambda r: r.turn):
            want.setdefault(r.conv_id, []).extend((r.turn + 1, t) for t in page_segments(r.text or "", limits))
    assert got == {k: v for k, v in want.items() if v}


def likes(rows):
    """{place: first earlier place whose text is like it}, by all pairs."""
    rows = sorted(rows)
    return {p: next((q for q, u in rows[:k] if u.split() and alike(t, u)), None) for k, (p, t) in enumerate(rows) if t.split()}


def test_similar_lines(spark, small):
    pages = {}
    for r in plans.similar_input(spark, small).collect():
        pages.setdefault(r.document_id, []).append((r.pos, r.text))
    want = {(c, p, q) for c, rows in pages.items() for p, q in likes(rows).items() if q is not None}
    got = {tuple(r) for r in QUERIES["similar_lines"](spark, small).select("document_id", "pos", "first_like").collect()}
    assert got == want and len(want) > 20


def planted_lines(seed, n):
    """Lines of random letters, some of them changed copies of others, some equal."""
    rng = np.random.default_rng(seed)
    lines = ["".join(rng.choice(list("abcdefgh ijklmnop海邊的"), int(rng.integers(5, 40)))) for _ in range(n)]
    for k in range(5, n, 4):
        source = list(lines[int(rng.integers(0, k))])
        for _ in range(int(rng.integers(0, 6))):
            source[int(rng.integers(0, len(source)))] = str(rng.choice(list("xyz")))
        lines[k] = "".join(source)
    return lines


def test_planted_likenesses_in_tiles(spark, monkeypatch):
    from leafmill.operators import likeness

    monkeypatch.setattr(likeness, "TILE", 16)
    pages = {None: planted_lines(1, 150), 7: planted_lines(2, 90), 8: ["same line here"] * 40 + ["", "  "], 9: []}
    rows = [(k, n, t) for k, lines in pages.items() for n, t in enumerate(lines)] + [(9, 0, None)]
    got = likeness.first_like(spark.createDataFrame(rows, "page int, pos int, text string"), ["page"]).collect()
    assert len(got) == len(rows)
    found = {(r.page, r.pos): r.first_like for r in got}
    for k, lines in pages.items():
        want = likes(list(enumerate(lines)))
        assert {p: found[k, p] for p in want} == want
    assert found[9, 0] is None and found[8, 39] == 0 and sum(v is not None for v in found.values()) > 60


def test_bounds_spare_most_comparisons_and_lose_none():
    from leafmill.operators import likeness

    lines = ["".join(t.split()) for t in planted_lines(3, 200)]
    i, j = likeness.candidates(lines, lines)
    kept = set(zip(i.tolist(), j.tolist()))
    alike_ = {(a, b) for a, x in enumerate(lines) for b, y in enumerate(lines) if x != y and min(len(x), len(y)) >= 10 and layout.similar(x, y)}
    assert alike_ <= kept and len(kept) < 0.5 * len(lines) ** 2


def test_merge_top_lines(spark, small):
    """One page after another, by plain rules."""
    candidates, lines, bands = (x.toPandas() for x in plans.top_line_input(spark, small))
    frames = layout.page_frames(plans.top_line_input(spark, small)[1], ["doc_id"], 1000.0).toPandas().set_index("doc_id")
    marks = set("，。！？；：「」『』")
    pages = sorted(lines.doc_id.unique())[:120]
    want, adds, fills = {}, 0, 0
    for page in pages:
        old = lines[lines.doc_id == page].sort_values("pos").to_dict("records")
        new = candidates[candidates.doc_id == page].sort_values("pos", kind="stable").to_dict("records")
        y0, left, gap = frames.loc[page, "first_y"], frames.loc[page, "block_left"], frames.loc[page, "gap"]
        known = {bare(x["text"]) for x in old}
        assert marks

        def is_new(x):
            k = bare(x["text"])
            noise = (len(k) <= 2 and not any(c.isalnum() for c in k)) or (x["confidence"] < 0.5 and len(k) <= 12)
            return x["y_min"] < y0 and not noise and k not in known and not any(alike(x["text"], o["text"]) for o in old)

        fresh = [x for x in new if is_new(x)]
        sure = [x for x in fresh if x["confidence"] >= 0.9 and x["x_min"] <= left + 60]
        doubted = [x for x in fresh if not (x["confidence"] >= 0.9 and x["x_min"] <= left + 60)]
        stand = []
        for x in sure:
            twin = next((k for k, s in enumerate(stand) if alike(x["text"], s["text"])), None)
            if twin is None:
                stand.append(x)
            elif (x["confidence"], len(bare(x["text"]))) > (stand[twin]["confidence"], len(bare(stand[twin]["text"]))):
                stand[twin] = x
        adds += len(stand)
        for b in bands[bands.doc_id == page].to_dict("records"):
            if not (y0 == y0 and gap == gap and b["top"] == b["top"]):
                continue
            n = max(1, round((b["bottom"] - b["top"]) / gap))
            step, slack = (b["bottom"] - b["top"]) / n, max(10.0, round(0.45 * gap))
            for k in range(n):
                top, bottom = b["top"] + k * step, b["top"] + (k + 1) * step
                if (top + bottom) / 2 >= y0 - max(8.0, 0.2 * gap) or any(top - slack <= s["y_min"] <= bottom + slack for s in stand):
                    continue
                fit = [
                    x for x in doubted + [x for x in new if x not in doubted]
                    if x["y_min"] < y0 and top - slack <= x["y_min"] <= bottom + slack and x["confidence"] >= 0.86 and len(bare(x["text"])) >= 12
                    and sum(0x3400 <= ord(c) <= 0x9FFF for c in x["text"]) >= 8 and x["x_min"] <= left + 108 and bare(x["text"]) not in known
                    and not any(alike(x["text"], o["text"]) for o in old + stand)
                ]
                if fit:
                    stand.append(max(fit, key=lambda x: (x["confidence"], len(bare(x["text"])))))
                    fills += 1
        warn = any(not any(alike(x["text"], s["text"]) for s in stand) for x in doubted)
        rows = stand + old
        if stand:
            rows = sorted(rows, key=lambda x: (x["y_min"] != x["y_min"], x["y_min"]))
        want[page] = [(x["text"], warn) for x in rows]
    got = {}
    for r in QUERIES["merge_top_lines"](spark, small).where(f"doc_id IN ({', '.join(map(str, pages))})").orderBy("pos").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.warning))
    assert adds > 20
    assert got == want


def test_ink_bands(spark):
    """Pages of their own sizes, row by row."""
    rng = np.random.default_rng(6)
    rows, frames, want = [], [], set()
    for page in range(60):
        height, gap, width = int(rng.integers(80, 400)), int(rng.integers(12, 60)), int(rng.integers(200, 900))
        left, right, first = int(rng.integers(0, 60)), int(rng.integers(80, width)), float(rng.integers(20, height))
        ink, y = np.zeros(height, dtype=int), 0
        while y < height:
            tall = int(rng.integers(2, gap))
            ink[y : y + tall] = rng.integers(3, 80, len(ink[y : y + tall]))
            y += tall + int(rng.integers(1, gap))
        rows += [(page, y, int(v)) for y, v in enumerate(ink)]
        frames.append((page, float(gap), first if page % 9 else None, left, right, width, height))
        low, high = max(0, round(first - 4 * gap)), min(height, round(first + 0.45 * gap))
        if not page % 9 or right - left < 0.2 * width or high - low < max(24, gap):
            continue
        scan, reach = ink[low:high], max(1, round(gap * 0.05))
        level = max(2, round((right - left) * 0.012), round(max(scan) * 0.08))
        active = [np.mean(scan[max(0, k - reach) : k + reach + 1]) >= level for k in range(len(scan))]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], active, [0]])))
        runs = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= max(4, round(gap * 0.16))]
        merged = []
        for a, b in runs:
            joins = merged and a - merged[-1][1] <= max(3, round(gap * 0.18))
            merged = [*merged[:-1], (merged[-1][0], b)] if joins else [*merged, (a, b)]
        pad = max(8, round(gap * 0.45))
        boxes = [(max(0, low + a - pad), min(height, low + b + pad)) for a, b in merged]
        kept = [(t, b) for t, b in boxes if b - t >= max(24, round(gap * 0.6)) and (t + b) / 2 <= first + 0.3 * gap]
        want |= {(page, *box) for box in kept[:5]}
    frame = "page int, gap double, first_y double, left int, right int, width int, height int"
    got = layout.ink_bands(spark.createDataFrame(rows, "page int, y int, ink int"), spark.createDataFrame(frames, frame), ["page"])
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40


def test_subsequences_bound_the_ratio():
    """The bound against its definition, and the answers against plain loops,
    over texts in several parts, empty ones and ones outside the first plane."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd漢字😀"), int(n))) for n in rng.integers(0, 40, 600)]
    known = layout.Known(list(dict.fromkeys(texts)))

    def longest(a, b):
        old = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for k, d in enumerate(b):
                new.append(old[k] + 1 if c == d else max(old[k + 1], new[k]))
            old = new
        return old[-1]

    for text in texts[:12]:
        for part, (at, _, _) in enumerate(known.parts):
            assert known.common(text, part).tolist() == [longest(text, known.texts[k]) for k in at.tolist()]
    others = ["".join(rng.choice(list("abcd漢字😀"), int(n))) for n in rng.integers(0, 40, 60)]
    few = layout.Known(known.texts[:40])
    assert [few.has(t) for t in others] == [any(layout.similar(t, o) for o in few.texts) for t in others]
