"""Lines of a page that are like an earlier line of it.

Likeness is the ratio of matching blocks, which a loop over both texts finds.
Before that loop, bounds that no similar pair fails: by lengths; by
characters: the blocks' characters are common to both texts, so what the texts
have in common as multisets of characters bounds the ratio from above; and by
their longest common subsequence, which the blocks are part of. Texts of
a page are compared once each, however often they stand there, in tiles of
texts of like length, and only similar pairs leave a tile.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import chars
from leafmill.operators.layout import Known, alike
from leafmill.operators.ranks import with_place

# Texts under LEAST characters are like equal ones alone; others
# from a ratio of RATIO. The longer of two such texts is at most LONGEST times
# as long: 2 * short >= RATIO * (short + long).
LEAST, RATIO = 10, 0.60
LONGEST = (2 - RATIO) / RATIO
TILE, SALTS = 256, 16


def counts(texts: list[str], alphabet: dict[str, int]) -> np.ndarray:
    """How often each text holds each character of the alphabet."""
    out = np.zeros((len(texts), len(alphabet)), dtype=np.int32)
    for row, text in zip(out, texts, strict=True):
        for c, n in Counter(text).items():
            row[alphabet[c]] = n
    return out


def candidates(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of a, of b) that both bounds leave."""
    alphabet = {c: k for k, c in enumerate(sorted(set().union(*a, *b)))}
    left, right = counts(a, alphabet), counts(b, alphabet)
    sizes, others = left.sum(axis=1), right.sum(axis=1)
    both = sizes[:, None] + others[None, :]
    long_enough = np.minimum(sizes[:, None], others[None, :]) >= LEAST
    common = np.zeros((len(a), len(b)), dtype=np.int32)
    for k in range(len(alphabet)):
        holds = np.flatnonzero(left[:, k])
        common[holds] += np.minimum(left[holds, k][:, None], right[:, k][None, :])
    return np.nonzero(long_enough & (2.0 * common >= RATIO * both))


def links(lines: DataFrame, key: list[str], pos: str = "pos", text: str = "text") -> DataFrame:
    """(key, pos, other): pairs of different texts of a page of which the one
    that first stands at ``pos`` is similar to that first at ``other``, before.

    Texts are different if they are without white space; nulls and blank lines
    have no links. A page of very many lines is spread over tiles; equal lines
    add none.
    """
    bare = chars.key(F.col(text))
    first = lines.withColumn("lm_key", bare).where(F.col("lm_key") != "").groupBy(*key, "lm_key").agg(F.min(pos).cast("long").alias("lm_pos"))
    first = first.withColumn("lm_size", F.char_length("lm_key")).where(F.col("lm_size") >= LEAST)
    placed = with_place(first, key, [F.col("lm_size"), F.col("lm_key")], "lm_place")
    tile = F.floor((F.col("lm_place") - 1) / TILE).cast("long")
    blocks = placed.groupBy(*key, tile.alias("lm_tile")).agg(
        F.min("lm_size").alias("lm_low"), F.max("lm_size").alias("lm_high"), F.collect_list("lm_pos").alias("lm_at"), F.collect_list("lm_key").alias("lm_texts")
    )
    salted = blocks.withColumn("lm_salt", F.pmod("lm_tile", F.lit(SALTS)))
    # A page of few tiles goes to as many salts as it has tiles.
    tops = blocks.groupBy(*[F.col(k).alias(f"lm_{k}") for k in key]).agg(F.least(F.max("lm_tile"), F.lit(SALTS - 1).cast("long")).alias("lm_top"))
    page = F.lit(True)
    for k in key:
        page &= F.col(k).eqNullSafe(F.col(f"lm_{k}"))
    every = blocks.join(tops, page).withColumn("lm_salt", F.explode(F.sequence(F.lit(0).cast("long"), "lm_top")))
    same = F.col("a.lm_salt") == F.col("b.lm_salt")
    for k in key:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    near = (F.col("a.lm_tile") <= F.col("b.lm_tile")) & (F.col("b.lm_low") <= LONGEST * F.col("a.lm_high"))
    tiles = every.alias("a").join(salted.alias("b"), same & near)
    sides = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for side, c in product("ab", ("lm_tile", "lm_at", "lm_texts"))]
    kinds = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tile_a, at_a, a, tile_b, at_b, b = (batch.column(len(key) + c)[row].as_py() for c in range(6))
                found, fit = [], {}
                for i, j in zip(*map(np.ndarray.tolist, candidates(a, b)), strict=True):
                    if tile_a < tile_b or i < j:
                        fit.setdefault(i, set()).add(j)
                known = Known(b) if fit else None
                for i, those in fit.items():
                    for j in those.intersection(known.near(a[i])):
                        (p, later), (q, earlier) = sorted([(at_a[i], a[i]), (at_b[j], b[j])], reverse=True)
                        if alike(later, earlier):
                            found.append((p, q))
                of = pa.array(np.full(len(found), row))
                pair = [pa.array([x[side] for x in found], pa.int64()) for side in range(2)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in range(len(key))), *pair], names=[*key, "pos", "other"])

    # One tile a row of its own batch: a batch of many would hold their texts at once.
    return tiles.select(*[F.col(f"a.{k}").alias(k) for k in key], *sides).mapInArrow(compare, f"{kinds}, pos long, other long")


def first_like(lines: DataFrame, key: list[str], pos: str = "pos", text: str = "text") -> DataFrame:
    """``lines`` with ``first_like``: where on its page the first line stands to
    which this one is similar or equal, null if there is none before it. Lines
    without text are like none."""
    bare = chars.key(F.col(text))
    marked = lines.withColumn("lm_key", bare)
    first = marked.where(F.col("lm_key") != "").groupBy(*key, "lm_key").agg(F.min(pos).cast("long").alias("lm_first"))
    least = links(lines, key, pos, text).groupBy(*key, F.col("pos").alias("lm_first")).agg(F.min("other").alias("lm_other"))

    def join(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
        same = F.col(f"a.{on}") == F.col(f"b.{on}")
        for k in key:
            same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        more = [F.col(f"b.{c}") for c in b.columns if c not in (*key, on)]
        return a.alias("a").join(b.alias("b"), same, "left").select("a.*", *more)

    known = join(first, least, "lm_first")
    joined = join(marked, known, "lm_key")
    found = F.least("lm_other", F.when(F.col("lm_first") < F.col(pos), F.col("lm_first")))
    return joined.withColumn("first_like", found).select(*lines.columns, "first_like")
