"""Cleaning of recognised page lines.

Input: one row per line with a page key and a position. Blank lines count as
positions but never as content. Every step partitions by page only, so a page
is the largest group; nothing crosses pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import chars


def _page(key: list[str]):
    return Window.partitionBy(*key)


def drop_unsure(lines: DataFrame) -> DataFrame:
    """Confident or substantial lines only."""
    return lines.where(chars.keep_confident(F.col("text"), F.col("confidence")))


def drop_page_numbers(lines: DataFrame) -> DataFrame:
    return lines.where(~chars.is_page_number(F.col("text")))


def trim_blank_ends(lines: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Without blank lines before the first and after the last full one: what
    stripping the joined text leaves. Inner blanks stay as positions."""
    full = F.when(chars.strip(F.col("text")) != "", F.col(pos))
    marked = lines.withColumns(
        {"lm_first": F.min(full).over(_page(key)), "lm_last": F.max(full).over(_page(key))}
    )
    return marked.where(F.col(pos).between(F.col("lm_first"), F.col("lm_last"))).drop("lm_first", "lm_last")


def header_lines(lines: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """With ``lm_header``: running headers, top titles and blank lines.

    Only the first four positions and the last are looked at; a short title
    counts at the first two, if one of the three lines below it is prose.
    """
    order = _page(key).orderBy(pos)
    text = chars.strip(F.col("text"))
    prose = (chars.cjk(text) >= 8) & chars.has_prose_marks(text)
    below = F.lit(False)
    for k in (1, 2, 3):
        below |= F.coalesce(F.lead("lm_prose", k).over(order), F.lit(False))
    marked = lines.withColumn("lm_prose", prose).withColumns(
        {"lm_i": F.row_number().over(order) - 1, "lm_n": F.count(F.lit(1)).over(_page(key)), "lm_below": below}
    )
    title = (F.col("lm_i") <= 1) & (F.char_length(text) <= 16) & ~chars.has_prose_marks(text) & (chars.cjk(text) >= 4) & F.col("lm_below")
    looked_at = (F.col("lm_i") < 4) | (F.col("lm_i") == F.col("lm_n") - 1)
    gone = (looked_at & (chars.is_running_header(text) | title)) | (text == "")
    return marked.withColumn("lm_header", gone).drop("lm_prose", "lm_i", "lm_n", "lm_below")


def drop_headers(lines: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Without running headers, top titles and blank lines."""
    return header_lines(lines, key, pos).where(~F.col("lm_header")).drop("lm_header")


def keep_matching(lines: DataFrame, survivors: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """For each text of a page, its first k lines, k being how many of that
    text survive: a multiset match of texts back to laid-out lines."""
    by = [*key, "lm_text"]
    left = survivors.select(*key, chars.strip(F.col("text")).alias("lm_text")).groupBy(*by).agg(F.count(F.lit(1)).alias("lm_k"))
    order = Window.partitionBy(*by).orderBy(pos)
    ranked = lines.withColumn("lm_text", chars.strip(F.col("text"))).withColumn("lm_rank", F.row_number().over(order))
    return ranked.join(left, by).where(F.col("lm_rank") <= F.col("lm_k")).drop("lm_text", "lm_rank", "lm_k").select(*lines.columns)


def collapse_blocks(lines: DataFrame, key: list[str], continues: Column, language: Column, pos: str = "pos") -> DataFrame:
    """One placeholder line for each block that a figure title opens.

    A block goes on over lines of which ``continues`` holds; blank lines don't
    end it. The state is the last event up to a line: a start (1) or a line
    that doesn't belong (0).
    """
    order = _page(key).orderBy(pos)
    text = chars.strip(F.col("text"))
    start = chars.is_figure_start(text)
    event = F.when(text == "", None).when(start, 1).when(~continues, 0)
    state = F.last("lm_event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumns({"lm_event": event, "lm_start": start}).withColumn("lm_state", state)
    marked = marked.withColumn("lm_before", F.lag("lm_state").over(order))
    opens = F.col("lm_start") & (F.coalesce("lm_before", F.lit(0)) != 1)
    inside = F.coalesce("lm_state", F.lit(0)) == 1
    return (
        marked.where((opens | ~inside) & (text != ""))
        .withColumn("text", F.when(opens, chars.placeholder(language)).otherwise(F.col("text")))
        .drop("lm_event", "lm_start", "lm_state", "lm_before")
    )


def collapse_figures(lines: DataFrame, key: list[str], language: Column, pos: str = "pos") -> DataFrame:
    """The layout variant: any figure-like line carries a block on."""
    return collapse_blocks(lines, key, chars.is_figure_line(chars.strip(F.col("text"))), language, pos)


def collapse_charts(lines: DataFrame, key: list[str], language: Column, pos: str = "pos") -> DataFrame:
    """The text variant: only support lines carry a block on."""
    return collapse_blocks(lines, key, chars.is_support_line(chars.strip(F.col("text"))), language, pos)


def drop_orphans(lines: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Without stray short lines, judged by place, size and script."""
    order = _page(key).orderBy(pos)
    text = chars.strip(F.col("text"))
    n_cjk, marks = chars.cjk(text), chars.has_prose_marks(text)
    i, n = F.col("lm_i"), F.col("lm_n")
    orphan = (
        ((i <= 2) & F.regexp_like(text, F.lit("[A-Za-z]")) & (F.char_length(text) <= 12) & (n_cjk == 0))
        | ((i <= 3) & (n_cjk == 1) & ~marks)
        | (n_cjk.between(1, 7) & ~marks & (i > 0) & (i < n - 1))
    )
    placed = lines.withColumns({"lm_i": F.row_number().over(order) - 1, "lm_n": F.count(F.lit(1)).over(_page(key))})
    return placed.where((text != "") & ~orphan).drop("lm_i", "lm_n")


def clean_lines(lines: DataFrame, key: list[str], language: Column, pos: str = "pos") -> DataFrame:
    """The production order over laid-out lines; rows are the lines that stay."""
    # Flags instead of filters, so that one exchange by page serves all steps:
    # headers are judged among the lines that aren't page numbers, and of each
    # text as many lines stay as survive, the first ones.
    sure = drop_unsure(lines).repartition(*key).withColumn("lm_on", ~chars.is_page_number(F.col("text")))
    marked = header_lines(sure, [*key, "lm_on"], pos).withColumn("lm_text", chars.strip(F.col("text")))
    alike = Window.partitionBy(*key, "lm_text")
    left = F.sum((F.col("lm_on") & ~F.col("lm_header")).cast("int")).over(alike)
    counted = marked.withColumns({"lm_left": left, "lm_rank": F.row_number().over(alike.orderBy(pos))})
    matched = counted.where(F.col("lm_rank") <= F.col("lm_left")).select(*lines.columns)
    return drop_orphans(collapse_figures(matched, key, language, pos), key, pos)


def clean_text_lines(lines: DataFrame, key: list[str], language: Column, pos: str = "pos") -> DataFrame:
    """The order for plain text without layout or confidence."""
    numbered = trim_blank_ends(drop_page_numbers(lines), key, pos)
    return collapse_charts(drop_headers(numbered, key, pos), key, language, pos)


def page_text(lines: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """One text per page from its lines in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), chars.strip(F.col("text")).alias("t"))))
    texts = F.transform(rows, lambda r: r["t"])
    return lines.groupBy(*key).agg(F.array_join(texts, "\n").alias("text"))


def usable_figure_page(text: Column, language: Column) -> Column:
    """Opens with the placeholder and has a prose line after it."""
    full = F.filter(F.transform(chars.split_lines(text), chars.strip), lambda x: x != "")
    later = F.slice(full, 2, 1_000_000)
    return (F.size(full) >= 2) & (F.get(full, F.lit(0)) == chars.placeholder(language)) & F.exists(later, chars.is_prose)


def warning_policy(warnings: Column, text: Column, language: Column) -> tuple[Column, Column]:
    """(needs review, notes): a usable figure page passes with a note."""
    usable = usable_figure_page(text, language)
    some = F.coalesce(F.size(warnings), F.lit(0)) > 0
    notes = F.when(usable, F.array(F.lit(chars.FIGURE_NOTE))).otherwise(F.coalesce(warnings, F.array().cast("array<string>")))
    return some & ~usable, notes
