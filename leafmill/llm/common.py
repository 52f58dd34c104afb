"""Shared plumbing: table access, scratch tables, folds and scalar helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: list[str] = []
_WRITTEN: list[DataFrame] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a private one only where
    the setting is absent and all runs on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not re.match(r"local(\[|\Z)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(tempfile.mkdtemp(prefix="leafmill-"))
        atexit.register(shutil.rmtree, _OWN_ROOT[0], ignore_errors=True)
    return f"file://{_OWN_ROOT[0]}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` under the scratch root and read it back.

    Lineage ends at files every executor can read, so a lost executor costs a
    re-read and never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/leafmill/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafmill_path = path
    _WRITTEN.append(out)
    return out


def clear_scratch(keep: DataFrame | None = None, since: int = 0) -> None:
    """Delete the scratch tables of this process, but for ``keep``, once all
    results that read them are stored elsewhere; with ``since`` (an earlier
    ``written()``) only later ones."""
    for table_ in _WRITTEN[since:]:
        if table_ is not keep:
            discard(table_)
    _WRITTEN[since:] = [] if keep is None else [keep]


def written() -> int:
    """How many scratch tables there are, as a mark for ``clear_scratch``."""
    return len(_WRITTEN)


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ..., which clash with none of ours, and the
    new name of each old one."""
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def reread(df: DataFrame) -> DataFrame:
    """What ``materialize`` wrote, as a second source with columns of its own."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._leafmill_path)
    out._leafmill_path = df._leafmill_path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote; call once nothing lazy reads it."""
    path = getattr(df, "_leafmill_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def labelled_sample(
    labels: DataFrame, label: str, modulus: int, held_out: int, rows: int
) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out fold.

    Lowest hash of the id first, so the choice depends on ids alone and keeps
    the classes' shares. Conflicting labels of one id take the larger.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(fold("doc_id", modulus) != held_out)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def one_text_each(rows: DataFrame) -> DataFrame:
    """Of each doc_id the row whose text has the smallest hash; null texts as
    empty ones. An aggregate, so copies of one id combine map-side."""
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    text = F.coalesce("text", F.lit(""))
    first = F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("text"), *rest)).alias("first")
    return rows.groupBy("doc_id").agg(first).select("doc_id", "first.text", *[f"first.{c}" for c in rest])
