"""Character classes, line patterns and spoken time, as Column expressions.

Patterns name their white space in full: Java's and Python's ideas of it
differ. ``\\z`` ends full matches, since ``$`` would allow a final newline.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_class(*ranges: tuple[int, int]) -> str:
    """Inside of a regular-expression class, in a notation that Java and RE2 share."""
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


# White space of Unicode text, and the character classes.
SPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
BREAK_RANGES = ((0x0A, 0x0D), (0x1C, 0x1E), (0x85, 0x85), (0x2028, 0x2029))
WIDE_RANGES = ((0x2E80, 0x2EFF), (0x2F00, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
SPACE = char_class(*SPACE_RANGES)
LINE_BREAK = rf"\r\n|[{char_class(*BREAK_RANGES)}]"
CJK_BODY = f"[{char_class((0x3400, 0x9FFF))}]"
CJK_WIDE = f"[{char_class(*WIDE_RANGES)}]"
OTHER_SPOKEN = rf"[^\x00-\x7F{SPACE}{char_class(*WIDE_RANGES)}]"
CJK_PROSE_MARKS = "[，。！？；：「」『』]"
PAUSES = "[。！？!?；;，,、：:.]"
SENTENCE_MARKS = "。！？!?；;."
HEADING_STOPS = "。！？!?；;，,、：:"
WORD = "[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?"

# Line patterns.
PAGE_NUMBER = rf"(?iU)^(?:[-–—][{SPACE}]*)?(?:(?:page|p)\.?[{SPACE}]*|頁[{SPACE}]*|第[{SPACE}]*)?\d{{1,4}}(?:[{SPACE}]*頁)?(?:[{SPACE}]*[-–—])?\z"
RUNNING_HEADER = rf"(?iUd)^(?:chapter[{SPACE}]+\d+|第[{SPACE}]*[一二三四五六七八九十百\d]+[{SPACE}]*[章节節]).{{0,30}}\z"
FIGURE_START = rf"(?iU)^(?:圖|图|figure|fig\.?|chart)[{SPACE}]*\d+"
SOURCE_LINE = "(?iU)^(?:資料來源|資料来源|资料來源|资料来源|來源|来源|source)"
SHORT_LABEL = rf"(?iU)^[\w{SPACE}().,%/+-]*\z"

# Placeholders, notes and voices by language.
PLACEHOLDERS = {"cantonese": "此處有一個圖表。", "mandarin": "此处有一个图表。", "english": "There is a chart here."}
FIGURE_NOTE = "This page contains chart or figure text. Please review the extracted text before generating audio."
VOICES = {"cantonese": "zh-HK-HiuMaanNeural", "mandarin": "zh-CN-XiaoxiaoNeural", "english": "en-US-JennyNeural"}
LOOKALIKE_OVERRIDE = {chr(0x2ED1): "長"}


def strip(c: Column) -> Column:
    """Without white space at either end; only the ends are looked at."""
    return F.btrim(c, F.lit("".join(chr(k) for a, b in SPACE_RANGES for k in range(a, b + 1))))


def key(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, f"[{SPACE}]+", "")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def split_lines(c: Column) -> Column:
    """Lines at any line break; a trailing break opens no further line."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def visible_characters(c: Column) -> Column:
    return F.char_length(key(c))


def page_classification(text: Column, threshold: int = 20) -> Column:
    """embedded_text if enough non-white characters, else requires_ocr."""
    enough = visible_characters(F.coalesce(text, F.lit(""))) >= threshold
    return F.when(enough, "embedded_text").otherwise("requires_ocr")


def is_page_number(line: Column) -> Column:
    return F.regexp_like(strip(line), F.lit(PAGE_NUMBER))


def is_running_header(line: Column) -> Column:
    return F.regexp_like(line, F.lit(RUNNING_HEADER))


def is_figure_start(line: Column) -> Column:
    return F.regexp_like(line, F.lit(FIGURE_START))


def is_source_line(line: Column) -> Column:
    return F.regexp_like(line, F.lit(SOURCE_LINE))


def cjk(line: Column) -> Column:
    return count(line, CJK_BODY)


def has_prose_marks(line: Column) -> Column:
    return F.regexp_like(line, F.lit(CJK_PROSE_MARKS))


def is_prose(line: Column) -> Column:
    """Enough CJK characters with punctuation or length, or a long Latin line
    with punctuation."""
    chinese = (cjk(line) >= 8) & (has_prose_marks(line) | (F.char_length(line) >= 28))
    return chinese | ((count(line, "[A-Za-z]") >= 30) & F.regexp_like(line, F.lit("[.?!,;:]")))


def is_support_line(line: Column) -> Column:
    """A line that may belong to a figure; the order of the tests matters."""
    size, label = F.char_length(line), F.regexp_like(line, F.lit(SHORT_LABEL))
    return (
        F.when(is_source_line(line), True)
        .when((cjk(line) == 0) & (size <= 24) & label, True)
        .when(F.regexp_like(line, F.lit(r"[.。!?！？]\z")), False)
        .when(has_prose_marks(line), False)
        .when(cjk(line) >= 8, False)
        .when(size <= 24, True)
        .otherwise((size <= 40) & label)
    )


def is_figure_line(line: Column) -> Column:
    size = F.char_length(line)
    return (
        is_source_line(line)
        | is_figure_start(line)
        | is_support_line(line)
        | ((count(line, r"\p{Nd}") >= 2) & (size <= 36))
        | ((cjk(line) >= 8) & (size <= 32) & ~has_prose_marks(line))
    )


def keep_confident(text: Column, confidence: Column) -> Column:
    """Blank lines go, and short unsure lines without prose punctuation."""
    clean = strip(text)
    noise = (confidence < 0.50) & (F.char_length(clean) <= 12) & ~has_prose_marks(clean)
    return (clean != "") & ~noise


def by_language(language: Column, values: dict[str, str]) -> Column:
    """Value of the language, English where it is missing or unknown."""
    out = F.lit(values["english"])
    for name, value in values.items():
        out = F.when(language == name, value).otherwise(out)
    return out


def placeholder(language: Column) -> Column:
    return by_language(language, PLACEHOLDERS)


def resolve_language(value: Column) -> tuple[Column, Column]:
    """(language, error_code): blank gives neither, an unknown name the code."""
    name = F.lower(strip(value))
    known = name.isin(*VOICES)
    blank = value.isNull() | (name == "")
    return (
        F.when(~blank & known, name),
        F.when(~blank & ~known, F.lit("target_language_unknown")),
    )


def voice(language: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in VOICES.items():
        out = F.when(language == name, value).otherwise(out)
    return out


def lookalike_table() -> tuple[str, str]:
    """Radicals and compatibility ideographs and what NFKC makes of them, if
    that is one character; built by rule, with the override."""
    left, right = [], []
    for first, last in ((0x2E80, 0x2EFF), (0x2F00, 0x2FDF), (0xF900, 0xFAFF)):
        for code in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            plain = LOOKALIKE_OVERRIDE.get(chr(code), plain)
            if plain != chr(code) and len(plain) == 1:
                left.append(chr(code))
                right.append(plain)
    return "".join(left), "".join(right)


def normalize_lookalikes(c: Column) -> Column:
    left, right = lookalike_table()
    return F.translate(c, left, right)


def squeeze_spaces(c: Column) -> Column:
    """No white space between CJK characters; elsewhere each is one space."""
    inner = F.regexp_replace(c, rf"(?<={CJK_WIDE})[{SPACE}]+(?={CJK_WIDE})", "")
    return F.regexp_replace(inner, f"[{SPACE}]", " ")


def join_lines(c: Column) -> Column:
    """Newlines vanish between CJK characters and are spaces elsewhere."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?<={CJK_WIDE})\n(?={CJK_WIDE})", ""), r"\n", " ")


def is_heading(line: Column) -> Column:
    """Short, not ended by a stop, opened by a corner or title bracket."""
    return (
        (F.char_length(line) <= 40)
        & F.regexp_like(line, F.lit("^[「《]"))
        & ~F.regexp_like(line, F.lit(rf"[{HEADING_STOPS}]\z"))
    )


def is_short_fragment(text: Column) -> Column:
    """One to eight CJK characters that make up half of the text or more."""
    n = count(text, CJK_WIDE)
    return (n >= 1) & (n <= 8) & (n * 2 >= F.char_length(strip(text)))


def spoken_seconds(c: Column) -> Column:
    """Estimated speaking time: CJK characters, words, other characters
    outside ASCII, and pauses."""
    pauses = F.char_length(c) - F.char_length(F.translate(c, PAUSES[1:-1], ""))
    return count(c, CJK_WIDE) / 3.8 + count(c, WORD) / 2.6 + count(c, OTHER_SPOKEN) / 3.2 + pauses * 0.2


#: No character takes longer: one outside ASCII that is a pause too.
SLOWEST = 1 / 3.2 + 0.2


def lasts_longer(c: Column, seconds: float) -> Column:
    """Whether the speaking time is above a bound; texts too short for it
    whatever they hold aren't counted through."""
    return (F.char_length(c) > int(seconds / SLOWEST)) & (spoken_seconds(c) > seconds)


def casefold(c: Column) -> Column:
    """Lower case with sharp s as ss: the fold that European titles need."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def mock_duration(text: Column) -> Column:
    return F.least(F.lit(8.0), F.greatest(F.lit(1.2), F.char_length(text) / 35.0))


def fallback_duration(text: Column) -> Column:
    return F.least(F.lit(120.0), F.greatest(F.lit(1.0), F.char_length(text) / 6.0))
