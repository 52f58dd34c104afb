"""Telephony audio and license scans."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import audio, licenses, queries

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_tables_have_the_standard_extremes():
    assert (audio.MULAW[0], audio.MULAW[0x80], audio.MULAW[0xFF], audio.MULAW[0x7F]) == (-32124, 32124, 0, 0)
    assert (audio.ALAW[0xD5], audio.ALAW[0x55], audio.ALAW[0xAA], audio.ALAW[0x2A]) == (8, -8, 32256, -32256)


def adpcm_one(block):
    """One block by the textbook."""
    value = int(np.frombuffer(block[:2], dtype="<i2")[0])
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            diff = step >> 3
            if nibble & 4:
                diff += step
            if nibble & 2:
                diff += step >> 1
            if nibble & 1:
                diff += step >> 2
            value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
            index = max(0, min(88, index + int(audio.CHANGES[nibble])))
            out.append(value)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=36, max_size=36), min_size=1, max_size=5))
def test_adpcm_across_blocks(blocks):
    got = audio.adpcm_decode(np.frombuffer(b"".join(blocks), dtype=np.uint8).reshape(-1, 36))
    assert got.tolist() == [adpcm_one(b) for b in blocks]


def test_wave_files_round_trip(spark):
    codes = bytes(range(256)) * 9
    rows = [(k, bytearray(audio.wav(codes, k))) for k in ("mulaw", "alaw", "ima_adpcm", "pcm")] + [("broken", bytearray(b"RIFFxxxx")), ("none", None)]
    assert all(audio.parse(bytes(m))[2] == codes for k, m in rows[:4])
    got = {r.id: r for r in audio.decode(spark.createDataFrame(rows, "name string, media binary"), "name", "media").collect()}
    assert got["broken"].pcm is None and got["none"].pcm is None
    assert got["mulaw"].n_samples == 2 * len(codes) and got["ima_adpcm"].n_samples == 2 * 65 * 64
    form, rate, data = audio.parse(bytes(got["mulaw"].pcm))
    assert (form, rate) == (1, 16000) and np.frombuffer(data, "<i2")[::2].tolist() == audio.MULAW[np.frombuffer(codes, np.uint8)].tolist()


def payload(text):
    raw = (text or "").encode()
    return raw, raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))


def test_op8_by_brute_force(spark, small, corpus, odd):
    from pyspark.sql import functions as F

    for rows, got in (
        ([(r["doc_id"], r["text"]) for r in corpus], queries.op8_telephony_audio(spark, small)),
        ([(r.doc_id, r.text) for r in odd.collect()], audio.digest(audio.store_texts(odd))),
    ):
        want = []
        for doc, text in rows:
            raw, full = payload(text)
            want.append((doc, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
        columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
        assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want, key=repr)
        per_text = got.groupBy("payload_sha256").agg(F.countDistinct("feature", "media_sha256").alias("n"))
        assert per_text.where("n > 1").count() == 0
    assert audio.digest(audio.store_texts(odd.limit(0))).count() == 0


def expand_one(code, law):
    """A sample by the companding rule, bit by bit."""
    if law == "mulaw":
        code = ~code & 255
        size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
        return 4 * (-size if code & 128 else size)
    code ^= 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = 2 * mantissa + 1 if exponent == 0 else (2 * mantissa + 33) << (exponent - 1)
    return 8 * (size if code & 128 else -size)


def doubled(samples):
    """Twice the rate, sample by sample; a neighbour beyond the ends repeats."""
    n, out = len(samples), []
    for k, x in enumerate(samples):
        a, c, d = samples[max(k - 1, 0)], samples[min(k + 1, n - 1)], samples[min(k + 2, n - 1)]
        out += [x, max(-32768, min(32767, (9 * (x + c) - a - d + 8) >> 4))]
    return out


def test_op8_features_and_pcm_by_plain_loops(spark, corpus):
    import math
    import struct

    texts = sorted((r["text"] for r in corpus if r["text"]), key=len)[:12] + ["", "é😀", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in audio.digest(audio.store_texts(docs)).collect()}
    for k, text in enumerate(texts):
        _, full = payload(text)
        head = b"WAVEfmt " + struct.pack("<IHHIIHHH", 18, 7, 1, 8000, 8000, 1, 8, 0) + b"data" + struct.pack("<I", len(full))
        media = b"RIFF" + struct.pack("<I", len(head) + len(full)) + head + full
        assert (got[k].media_bytes, got[k].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        heard = {law: [expand_one(b, law) for b in full] for law in ("mulaw", "alaw")}
        mu, a = (doubled(heard[law]) for law in ("mulaw", "alaw"))
        z = doubled([v for i in range(0, len(full), 36) for v in adpcm_one(full[i : i + 36])])
        crc = {n: f"{zlib.crc32(struct.pack(f'<{len(v)}h', *v)):08x}" for n, v in (("mu", mu), ("a", a), ("z", z))}
        signs = [x < 0 for x in heard["mulaw"]]
        crossings = sum(p != q for p, q in zip(signs, signs[1:]))
        rms = int(math.sqrt(sum(x * x for x in heard["mulaw"]) / len(full)))
        want = f"mulaw:{crc['mu']}/{max(map(abs, mu))};alaw:{crc['a']}/{max(map(abs, a))};adpcm:{crc['z']};zc:{crossings};rms:{rms}"
        assert got[k].feature == want
        form, rate, data = audio.parse(bytes(got[k].pcm))
        assert (form, rate) == (1, 16000) and data == struct.pack(f"<{len(mu)}h", *mu)


def base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    hits = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_op9_by_brute_force(spark, small, corpus, odd):
    for rows, got in (
        ([(r["doc_id"], r["text"]) for r in corpus], queries.op9_license_scan(spark, small)),
        ([(r.doc_id, r.text) for r in odd.collect()], licenses.scan(odd)),
    ):
        columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
        found = got.collect()
        assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == sorted(((d, *base(t)) for d, t in rows), key=repr)
        for r in found:
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(odd.limit(0)).count() == 0


def test_containment_join_is_exact(spark):
    """Every template that a run of words holds enough of, by brute force."""
    rng = np.random.default_rng(5)
    vocabulary = [w for t in licenses.TEMPLATES.values() for w in t.split()] + ["foo", "bar", "baz"]
    rows = []
    for k in range(60):
        text = list(rng.choice(vocabulary, 30))
        if k % 3 == 0:
            words = list(licenses.TEMPLATES.values())[k % 7].split()
            if k % 2:
                words[0] = "zzz"
            text[10:10] = words
        out = ""
        for w in text:
            out += w + ("\n" if rng.random() < 0.15 else " ")
        rows.append((k, out))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for k, text in rows:
        words, want = text.split(), {}
        for name, t in licenses.TEMPLATES.items():
            needed, reach = set(t.split()), licenses.STRETCH * len(t.split())
            best = max(len(needed & set(words[a : a + reach])) for a in range(len(words)))
            if best >= licenses.THETA * len(needed) - 1e-9:
                want[name] = best / len(needed)
        assert {x for x in got[k].labels.split(",") if x} == set(want), k
        assert got[k].score == max(want.values(), default=0) and {b.label for b in got[k].blocks} == set(want)
        assert [(b.first, b.last, b.label) for b in got[k].blocks] == every_block(words)


def every_block(words):
    """By trying all runs: the shortest of enough words, by end, that begin after the last one taken."""
    out = []
    for name, t in licenses.TEMPLATES.items():
        needed, reach = set(t.split()), licenses.STRETCH * len(t.split())
        enough = licenses.THETA * len(needed) - 1e-9
        runs = [(b, -a) for a in range(len(words)) if words[a] in needed for b in range(a, min(len(words), a + reach)) if words[b] in needed and len(needed & set(words[a : b + 1])) >= enough]
        done = -1
        for b, a in sorted(runs):
            if -a > done:
                out.append((-a, b, name))
                done = b
    return sorted(out)


def test_every_notice_is_a_block(spark):
    notice, other = licenses.TEMPLATES["bsd"].split(), licenses.TEMPLATES["mit-grant"].split()
    filler = [f"word{k}" for k in range(60)]
    texts = [notice + filler + notice, notice * 3, filler + notice + other + filler + other, notice[:10] + filler + notice[10:], filler * 5_000 + notice + filler * 5_000 + notice]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    for k, text in enumerate(texts[:4]):
        assert [(b.first, b.last, b.label) for b in got[k].blocks] == every_block(text)
    assert [len(got[k].blocks) for k in range(5)] == [2, 3, 3, 0, 2]
    assert all(b.containment == 1 for k in (0, 1, 2, 4) for b in got[k].blocks)


@pytest.mark.parametrize("width", [1, 5, 40])
def test_wrapped_notices_are_found_however_narrow(spark, width):
    notice = licenses.TEMPLATES["gpl-notice"].split()
    wrapped = "\n# ".join(" ".join(notice[a : a + width]) for a in range(0, len(notice), width))
    far = " ".join(f"{w} " + "filler " * 40 for w in notice)
    df = spark.createDataFrame([(1, f"before\n{wrapped}\nafter"), (2, far), (3, "plain " * 200_000 + wrapped)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got == {1: "gpl-notice", 2: "", 3: "gpl-notice"}


def test_op9_against_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op9_license_scan"])
    got = queries.op9_license_scan(spark, small).select(want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
