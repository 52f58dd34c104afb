"""Documents with their pages and segments, kept up together.

Each table lies in buckets of its own key's hash, so that a document of very
many pages fills no bucket by itself. A batch rewrites the buckets its keys
fall into, to new folders, and a manifest names the folders of every bucket of
all tables: it is written under another name and takes its number by a rename
that fails if the number is taken. So readers see all of a batch or nothing,
and an old manifest still reads as it did.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("documents", "pages", "segments")


class Conflict(RuntimeError):
    """Another batch was published first; read again and repeat."""


@dataclass
class Manifest:
    """``folders[table][bucket]`` holds a bucket; ``schemas[table]`` its
    columns; ``applied`` the last batch of every source of batches."""

    number: int = 0
    folders: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class Graph:
    """The tables below ``path``. ``key`` is the column that names a row."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, key: str = "id"):
        self.spark, self.path, self.buckets, self.key = spark, path.rstrip("/"), buckets, key
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def manifest(self, number: int | None = None) -> Manifest:
        """The newest manifest, or that of a number; an empty one before the first."""
        known = [int(n.removesuffix(".json")) for n in self._listed("manifests") if n.endswith(".json")]
        number = max(known, default=0) if number is None else number
        if not number:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _publish(self, manifest: Manifest) -> None:
        folder = self._path(f"{self.path}/manifests")
        self._fs.mkdirs(folder)
        draft, final = (self._path(folder, n) for n in (f".{uuid.uuid4().hex}", f"{manifest.number:012d}.json"))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"manifest {manifest.number} is taken")

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that keys lie in: at most as many as there are."""
        return sorted(r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self._bucket(self.key).alias("b")).distinct().collect())

    def read(self, table: str, manifest: Manifest | None = None, only: list[int] | None = None) -> DataFrame | None:
        """A table as a manifest has it (None if it has none); ``only``: buckets."""
        manifest = manifest or self.manifest()
        if table not in manifest.schemas:
            return None
        schema = T.StructType.fromJson(json.loads(manifest.schemas[table]))
        chosen = manifest.folders.get(table, {})
        paths = [p for b, p in chosen.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in paths))

    def point(self, table: str, value) -> DataFrame | None:
        """The rows of one key, from its bucket alone."""
        bucket = self.spark.range(1).select(F.lit(value).alias("v")).select(self._bucket("v")).first()[0]
        found = self.read(table, only=[bucket])
        return None if found is None else found.where(F.col(self.key) == value)

    def save(self, batch: dict[str, DataFrame], now: Column, source: str = "", number: int | None = None) -> Manifest:
        """Merge a batch of documents, pages and segments, all or nothing.

        Rows of known keys take the batch's columns, nulls too, and keep those
        the batch lacks; others are added. ``updated_at`` becomes ``now``, and
        ``created_at`` too for new rows that have none. Rows that the batch
        doesn't mention stay, so a document saved with an empty list keeps the
        children it had. Of several rows of one key in a batch the greatest
        counts. Rows without key can't be merged and are left out. A ``number``
        of a ``source`` that isn't above its last does nothing, so a batch that
        runs again changes nothing.
        """
        manifest = self.manifest()
        if number is not None and number <= manifest.applied.get(source, -1):
            return manifest
        new = Manifest(manifest.number + 1, {t: dict(b) for t, b in manifest.folders.items()}, dict(manifest.schemas), dict(manifest.applied))
        if number is not None:
            new.applied[source] = number
        unknown = set(batch) - set(TABLES)
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        for table, rows in batch.items():
            self._merge(table, rows, now, manifest, new)
        self._publish(new)
        return new

    def _merge(self, table: str, rows: DataFrame, now: Column, old: Manifest, new: Manifest) -> None:
        key = self.key
        rest = [c for c in rows.columns if c not in (key, "updated_at")]
        # Where nothing is stored yet, rows are shuffled once, to their buckets,
        # and keys are combined there; else the buckets come from the keys alone.
        last = F.max(F.struct(*([F.col("updated_at")] if "updated_at" in rows.columns else []), *rest)).alias("r")
        there = table in old.schemas
        touched = self.touched(rows) if there else list(range(self.buckets))
        if not touched:
            return
        placed = self._placed(rows.where(F.col(key).isNotNull()), len(touched))
        by = [key] if there else ["lm_bucket", "lm_salt", key]
        mine = (rows.where(F.col(key).isNotNull()) if there else placed).groupBy(*by).agg(last).select(*by, *[F.col(f"r.{c}").alias(c) for c in rest])
        before = self.read(table, old, touched)
        if before is None:
            merged = mine.withColumn("lm_new", F.lit(True))
        else:
            sides = before.withColumn("lm_old", F.lit(True)).alias("o").join(mine.withColumn("lm_mine", F.lit(True)).alias("n"), key, "full")
            hit = F.col("lm_mine").isNotNull()
            columns = [key]
            for c in dict.fromkeys([*before.columns, *rest]):
                if c in (key, "updated_at"):
                    continue
                if c not in rest:
                    columns.append(F.col(f"o.{c}").alias(c))
                elif c not in before.columns:
                    columns.append(F.col(f"n.{c}").alias(c))
                elif c == "created_at":  # a row is created once
                    columns.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
                else:
                    columns.append(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
            kept = F.col("o.updated_at") if "updated_at" in before.columns else F.lit(None).cast("timestamp")
            merged = sides.select(*columns, kept.alias("lm_kept"), hit.alias("lm_new"))
            merged = self._placed(merged, len(touched))
        stamp = now.cast("timestamp")
        past = F.col("lm_kept") if "lm_kept" in merged.columns else F.lit(None).cast("timestamp")
        merged = merged.withColumn("updated_at", F.when(F.col("lm_new"), stamp).otherwise(past))
        if "created_at" in merged.columns:
            merged = merged.withColumn("created_at", F.coalesce("created_at", F.when(F.col("lm_new"), stamp)))
        out = merged.drop("lm_new", "lm_kept", "lm_salt")
        folder = f"data/{new.number:012d}-{uuid.uuid4().hex}/{table}"
        out.write.partitionBy("lm_bucket").parquet(f"{self.path}/{folder}")
        full = sorted(int(n.removeprefix("lm_bucket=")) for n in self._listed(folder) if n.startswith("lm_bucket="))
        if full:
            new.schemas[table] = out.drop("lm_bucket").schema.json()
            new.folders.setdefault(table, {}).update({str(b): f"{folder}/lm_bucket={b}" for b in full})

    def _placed(self, rows: DataFrame, buckets: int) -> DataFrame:
        """``rows`` with their bucket, dealt by it over all tasks: several share
        a bucket where there are more of them."""
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        share = F.pmod(F.xxhash64(F.col(self.key).cast("string"), F.lit(1)), F.lit(max(1, tasks // buckets))).cast("int")
        marked = rows.withColumns({"lm_bucket": self._bucket(self.key), "lm_salt": share})
        return marked.repartition(max(tasks, buckets), "lm_bucket", "lm_salt")

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` manifests and the batches' folders
        that none of the kept names; returns how many folders went."""
        numbers = sorted(int(n.removesuffix(".json")) for n in self._listed("manifests") if n.endswith(".json"))
        live = {p.split("/")[1] for n in numbers[-keep:] for b in self.manifest(n).folders.values() for p in b.values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{n:012d}.json"), False)
        gone = [f for f in self._listed("data") if f not in live]
        for f in gone:
            self._fs.delete(self._path(f"{self.path}/data/{f}"), True)
        return len(gone)
