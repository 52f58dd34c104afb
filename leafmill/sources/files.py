"""One JSON file for each document: ``{folder}/{id}/document.json``.

Documents are written in two steps. Tasks put each document under a staging
folder of the job; when all tasks are through, the commit lists the folders of
the attempts that count in a manifest, which appears by a rename. From then on
the job stands: a second Spark job moves the listed files to their places, and
should that stop half way, ``recover`` goes on where it stopped. A job without
manifest leaves nothing behind that readers see, and ``recover`` removes it.

Readers list nothing for a point read: a document's path follows from its id.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from leafmill import schemas
from leafmill.operators.spread import spread

NAME, STAGING, MANIFEST = "document.json", ".staging", "manifest.json"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute local path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    fs, inner = pafs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs, inner.rstrip("/")


def _put(fs: pafs.FileSystem, path: str, content: str) -> None:
    """A whole file or none: written under another name, then renamed."""
    with fs.open_output_stream(path + ".tmp") as out:
        out.write(content.encode())
    fs.move(path + ".tmp", path)


@dataclass
class Staged(WriterCommitMessage):
    """The staging folder of a task attempt that counts."""

    folder: str


class DocumentFiles(DataSource):
    """Batch sink of (id, body) rows; options path and job."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_documents"

    def schema(self) -> str:
        return "id string, body string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options["job"])


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator) -> Staged:
        fs, root = _open(self.path)
        folder = posixpath.join(root, STAGING, self.job, uuid.uuid4().hex)
        fs.create_dir(folder)
        for row in iterator:
            with fs.open_output_stream(posixpath.join(folder, f"{row.id}.json")) as out:
                out.write(row.body.encode())
        return Staged(folder)

    def commit(self, messages: list[Staged]) -> None:
        fs, root = _open(self.path)
        _put(fs, posixpath.join(root, STAGING, self.job, MANIFEST), json.dumps([m.folder for m in messages if m]))

    def abort(self, messages: list[Staged]) -> None:
        fs, root = _open(self.path)
        _remove(fs, posixpath.join(root, STAGING, self.job))


def _remove(fs: pafs.FileSystem, folder: str) -> None:
    if fs.get_file_info(folder).type == pafs.FileType.Directory:
        fs.delete_dir(folder)


USABLE = r"\A[^./\\\x00-\x1f_][^/\\\x00-\x1f]*\Z"


def usable_id(c: Column) -> Column:
    """Whether an id can name a folder: not empty, hidden or several levels."""
    return F.coalesce(F.regexp_like(c, F.lit(USABLE.replace(r"\Z", r"\z"))), F.lit(False))


def write_documents(documents: DataFrame, path: str) -> DataFrame:
    """Save each document whole, replacing what its id had; of several rows of
    one id that with the latest ``updated_at``, then the greatest JSON.

    Returns the rows that were refused (id, error_code): ids that can't name a
    folder. Rows are compared in an aggregate, so that an id of very many rows
    meets in no task.
    """
    spark = documents.sparkSession
    body = F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false", "pretty": "true"})
    when = F.col("updated_at") if "updated_at" in documents.columns else F.lit(None).cast("timestamp")
    id_ = F.col("id").cast("string")
    rows = documents.where(usable_id(id_)).groupBy(id_.alias("id")).agg(F.max(F.struct(when.alias("at"), F.concat(body, F.lit("\n")).alias("body"))).alias("last"))
    spark.dataSource.register(DocumentFiles)
    job = uuid.uuid4().hex
    spread(rows.select("id", "last.body")).write.format("leafmill_documents").option("path", path).option("job", job).mode("append").save()
    publish(spark, path, job)
    return documents.where(~usable_id(id_)).select(id_.alias("id"), F.lit("document_id_invalid").alias("error_code"))


def publish(spark: SparkSession, path: str, job: str) -> None:
    """Move what a committed job wrote to its places, one staging folder a
    task. Each file is moved once and whole, whoever tries again."""
    fs, root = _open(path)
    staging = posixpath.join(root, STAGING, job)
    with fs.open_input_stream(posixpath.join(staging, MANIFEST)) as f:
        folders = json.loads(f.read())

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for info in store.get_file_info(pafs.FileSelector(folder)):
                    to = posixpath.join(root, info.base_name.removesuffix(".json"))
                    store.create_dir(to)
                    store.move(info.path, posixpath.join(to, NAME))
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["moved"])

    if folders:
        listed = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 10_000))
        listed.mapInArrow(move, "moved long").agg(F.count("moved")).collect()
    _remove(fs, staging)


def recover(spark: SparkSession, path: str) -> dict[str, bool]:
    """Finish committed jobs that stopped while publishing, and remove those
    that never committed: {job: whether it was finished}. For a time when no
    other job writes there."""
    fs, root = _open(path)
    top, out = posixpath.join(root, STAGING), {}
    if fs.get_file_info(top).type == pafs.FileType.Directory:
        for info in fs.get_file_info(pafs.FileSelector(top)):
            whole = fs.get_file_info(posixpath.join(info.path, MANIFEST)).type == pafs.FileType.File
            out[info.base_name] = whole
            if whole:
                publish(spark, path, info.base_name)
            else:
                _remove(fs, info.path)
    return out


def _parsed(texts: DataFrame) -> DataFrame:
    """Documents of whole files' texts (``value``), one row a file."""
    schema = schemas.nested_document()
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json("value", schema.add("_corrupt_record", T.StringType()), options)
    broken = ~F.regexp_like("value", F.lit(r"\A\s*\{")) | F.col("d").isNull() | F.col("d._corrupt_record").isNotNull() | F.col("d.id").isNull()
    judged = texts.withColumn("d", parsed).withColumn("lm_broken", F.coalesce(broken, F.lit(True)))
    fields = [F.when(~F.col("lm_broken"), F.col(f"d.{f}")).alias(f) for f in schema.fieldNames() if f != "_corrupt_record"]
    error = F.when(F.col("lm_broken"), "document_metadata_invalid").alias("error_code")
    return judged.select(*fields, F.when(F.col("lm_broken"), F.col("value")).alias("_corrupt_record"), error)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _names(fs: pafs.FileSystem, folder: str) -> Iterator[str]:
    """What a folder holds, on a local disk without a list of all of it."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from (entry.name for entry in found)
    else:
        yield from (info.base_name for info in fs.get_file_info(pafs.FileSelector(folder)))


def _texts(path: str, shares: int, bound: int = 8 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each share of the names in a folder the bytes of the documents below
    them, some megabytes at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        held, size = [], 0
        mine = {share for batch in batches for share in batch.column(0).to_pylist()}
        for name in _names(fs, root) if mine else ():
            if _hidden(name) or zlib.crc32(name.encode("utf-8", "surrogateescape")) % shares not in mine:
                continue
            top = posixpath.join(root, name)
            is_folder = fs.get_file_info(top).type == pafs.FileType.Directory
            for info in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if is_folder else [fs.get_file_info(top)]:
                inner = posixpath.relpath(info.path, root).split("/")
                if info.type != pafs.FileType.File or inner[-1] != NAME or any(map(_hidden, inner)):
                    continue
                with fs.open_input_stream(info.path) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size > bound:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    return read


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents below a folder, newest first, with ``error_code``; files
    that aren't a document keep their text in ``_corrupt_record``, everything
    else null. Other files, and folders without a document, are passed over.

    Each task goes through the folder's names and opens its share of them, so
    that neither a list of all files nor a task for some files each is made."""
    if not _exists(spark, path):
        return _parsed(spark.createDataFrame([], "value string"))
    shares = 4 * spark.sparkContext.defaultParallelism
    texts = spark.range(0, shares, 1, shares).mapInArrow(_texts(path, shares), "value binary")
    return _parsed(texts.select(F.col("value").cast("string").alias("value"))).orderBy(F.desc("updated_at"))


def read_document(spark: SparkSession, path: str, document_id: str) -> DataFrame:
    """One row: the document of that id from its own file, the only one that is
    opened, with ``error_code`` if there is none or it is no document."""
    file = f"{path.rstrip('/')}/{document_id}/{NAME}"
    if re.search(USABLE, document_id) and _exists(spark, file):
        return _parsed(spark.read.text(file, wholetext=True))
    missing = _parsed(spark.createDataFrame([("",)], "value string"))
    known = {"id": document_id, "error_code": "book_not_found", "_corrupt_record": None}
    return missing.select(*[F.lit(known[c]).cast(t).alias(c) if c in known else F.col(c) for c, t in missing.dtypes])
