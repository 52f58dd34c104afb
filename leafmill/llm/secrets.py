"""Secret scans: keyword prefilter, anchored patterns, embedded checks.

One Aho-Corasick automaton over all keywords runs through a whole slice of
texts, A-Z in lower case. A kind's regular expression is tried only where one
of its keywords stands, anchored there, so it never searches; a kind without
keyword (hex digits) is tried at the runs of its bytes. Kinds whose secrets
carry a checksum or a length of their own are kept only where that holds.
Everything works on bytes, and every pattern is plain ASCII, so places in bytes
turn into places in code points at the end.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import units

# Alphabets of the encodings in which secrets are written.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_base62(m: re.Match[str]) -> bool:
    """Six base-62 digits at the end are the crc32 of what follows the prefix."""
    body, check = m.group(1), m.group(2)
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def base58_check(m: re.Match[str]) -> bool:
    """The last four bytes are the head of the others' double sha256."""
    value = 0
    for c in m.group():
        value = value * 58 + BASE58.index(c)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _unpadded(part: str) -> bytes | None:
    try:
        return base64.b64decode(part + "=" * (-len(part) % 4), altchars=b"-_", validate=True)
    except (binascii.Error, ValueError):
        return None


def json_header(m: re.Match[str]) -> bool:
    """The first part of a signed token is a JSON object that names its algorithm."""
    raw = _unpadded(m.group(1))
    try:
        return raw is not None and "alg" in dict(json.loads(raw))
    except (ValueError, TypeError):
        return False


def whole_key(m: re.Match[str]) -> bool:
    """The armoured bytes are one sequence of just the length it says, or begin
    with the magic of the other key format."""
    try:
        raw = base64.b64decode("".join(m.group(1).split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    size = raw[1] & 0x7F
    return 0 < size <= 4 and len(raw) == 2 + size + int.from_bytes(raw[2 : 2 + size], "big")


@dataclass(frozen=True)
class Kind:
    """A kind of secret.

    ``keywords``: lower-case strings one of which begins every match. Without
    keywords a match is a whole run of the characters in ``run``. ``least`` is
    the least length of the match or of its group ``least_of``, ``keep`` a check
    of its own; a match that fails either is dropped, but counts as consumed.
    ``not_after``: characters that may not stand before a match.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: str
    keep: Callable[[re.Match[str]], bool] | None = None
    least: int = 0
    least_of: int = 0
    run: str = ""
    not_after: str = ""
    any_case: bool = False
    base: bool = False


# The kinds of the contract, and formats whose owners publish them.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=6, least_of=2, any_case=True, base=True),
    Kind("access", ("akia",), r"AKIA[A-Z0-9]+", least=20, base=True),
    Kind("hex", (), r"[0-9a-f]+", least=24, run="0123456789abcdef", base=True),
    Kind("forge", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", crc_base62),
    Kind("registry", ("npm_",), r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", crc_base62),
    Kind("wallet", ("xprv",), r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])", base58_check),
    Kind("signed", ("eyj",), r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", json_header, not_after=BASE62 + "_-"),
    Kind("key", ("-----begin ",), r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----", whole_key),
)


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters.encode())] = True
    return out


class Scanner:
    """All kinds compiled: one automaton, one anchored pattern for each kind."""

    def __init__(self, kinds: tuple[Kind, ...]):
        self.kinds = kinds
        self.patterns = [re.compile(k.pattern, re.ASCII | (re.IGNORECASE if k.any_case else 0)) for k in kinds]
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for number, kind in enumerate(kinds):
            for word in kind.keywords:
                owners.setdefault(word, []).append(number)
        for word, numbers in owners.items():
            self.automaton.add_word(word, (len(word), numbers))
        self.automaton.make_automaton()
        self.runs = {n: _table(k.run) for n, k in enumerate(kinds) if not k.keywords}
        self.barred = {n: _table(k.not_after) for n, k in enumerate(kinds) if k.not_after}

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ascending places where each kind must be tried, for a slice's bytes."""
        found: list[list[int]] = [[] for _ in self.kinds]
        low = units.ASCII_LOWER[data].tobytes().decode("latin-1")
        for end, (length, numbers) in self.automaton.iter(low):
            for number in numbers:
                found[number].append(end - length + 1)
        places = [np.unique(np.array(f, dtype=np.int64)) for f in found]
        for number, table in self.runs.items():
            first, last, _ = units.runs(table[data], offsets)
            places[number] = first[last - first >= self.kinds[number].least]
        for number, table in self.barred.items():
            at = places[number]
            places[number] = at[np.isin(at, offsets) | ~table[data[at - 1]]]
        return places

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, kind, start, end) of all spans in code points of their row, by
        row, start and kind. Within a kind, matches are leftmost and don't overlap."""
        offsets, data = units.buffers(texts)
        raw = data.tobytes().decode("latin-1")
        spans: list[tuple[int, int, int, int]] = []
        for number, places in enumerate(self.starts(data, offsets)):
            match, kind = self.patterns[number].match, self.kinds[number]
            rows = np.searchsorted(offsets, places, side="right") - 1
            done = 0
            for at, row, limit in zip(places.tolist(), rows.tolist(), offsets[rows + 1].tolist(), strict=True):
                if at < done:
                    continue
                m = match(raw, at, limit)
                if m:
                    done = m.end()
                    if len(m.group(kind.least_of)) >= kind.least and (kind.keep is None or kind.keep(m)):
                        spans.append((row, at, number, m.end()))
        found = np.array(sorted(spans), dtype=np.int64).reshape(-1, 4)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = points[offsets[found[:, 0]]]
        return found[:, 0], found[:, 2], points[found[:, 1]] - base, points[found[:, 3]] - base


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans), one row for each document: the secrets of its whole
    text, by start and then kind as listed, in code points, ends exclusive.

    Null and empty texts have no spans; repeated rows and null ids stay; other
    columns are ignored; an empty table gives no rows. Time is linear in a
    text's bytes and the tried matches, and texts are worked in slices, so very
    long ones cost memory once. Nothing is shuffled.
    """
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    names = pa.array([k.name for k in kinds])
    is_base = np.array([k.base for k in kinds], dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kinds)
        for batch in batches:
            for at, texts in units.slices(batch.column(1)):
                row, kind, start, end = scanner.scan(texts)
                each = pa.StructArray.from_arrays([names.take(pa.array(kind)), pa.array(start), pa.array(end), pa.array(is_base[kind])], fields=list(kind_type.value_type))
                ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), each, type=kind_type)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    count = {f"n_{k.name}": number(k.name) for k in KINDS if k.base}
    base = written(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
