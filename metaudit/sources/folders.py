"""Complete folder listings and files written one by one, as Python data sources.

Both work on a file system that all machines mount (a plain path, or ``file:``). Spark's own file source
leaves out empty files and names that begin with a dot or underscore, and gives the time of modification
alone; this listing has every file, with its size and all three times.
"""

import json
import os
import stat
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from metaudit.functions.paths import basename, glob_match
from metaudit.operators.classify import error_struct
from metaudit.schema import ERROR
from metaudit.sources.scratch import scratch_path

PARTITIONS = 256  # folders that the driver looks for before tasks walk on
ROWS = 4096
CONTENT_BYTES = 8 << 20  # content of a batch
LISTED = ("file_path string, file_size bigint, created timestamp, modified timestamp, accessed timestamp, problem string")
LISTED_ARROW = pa.schema([("file_path", pa.string()), ("file_size", pa.int64()),
                          *[(n, pa.timestamp("us", "UTC")) for n in ("created", "modified", "accessed")], ("problem", pa.string())])


def local_path(path: str) -> str:
    """A path without ``file:``; other schemes are for Spark's own file source."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return "/" + rest.lstrip("/")
    if colon and "/" not in scheme and len(scheme) > 1:
        raise ValueError(f"not a mounted folder: {path}")
    return path


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool  # with the folders in it


class FolderReader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, partitions: int):
        self.path, self.recursive, self.wanted = path, recursive, partitions

    def partitions(self):
        """Folders for tasks: the tree is opened from the top until there are enough of them."""
        if not os.path.isdir(self.path):
            raise ValueError(f"not a folder: {self.path}")
        flat, deep = [], [self.path]
        if not self.recursive:
            return [Folder(self.path, False)]
        while deep and len(flat) + len(deep) < self.wanted:
            path = deep.pop(0)
            flat.append(path)
            deep += [e.path for e in _entries(path)[0] if e.is_dir(follow_symlinks=False)]
        return [Folder(p, False) for p in flat] + [Folder(p, True) for p in deep]

    def read(self, partition):
        waiting, rows = [partition.path], []
        while waiting:
            path = waiting.pop()
            entries, problem = _entries(path)
            if problem:
                rows.append((path, None, None, None, None, problem))
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    if partition.deep:
                        waiting.append(entry.path)
                    continue
                found = _described(entry)
                if found is not None:
                    rows.append(found)
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _entries(path: str) -> tuple[list, str | None]:
    try:
        with os.scandir(path) as found:
            return list(found), None
    except OSError as problem:
        return [], f"Folder could not be listed: {problem.strerror}"


def _described(entry) -> tuple | None:
    """A file's row; a link is described by what it leads to. Folders behind links, pipes and devices are no files."""
    try:
        info = entry.stat()
    except OSError as problem:
        return entry.path, None, None, None, None, f"File could not be read: {problem.strerror}"
    if not stat.S_ISREG(info.st_mode):
        return None
    return (entry.path, info.st_size, info.st_ctime_ns // 1000, info.st_mtime_ns // 1000, info.st_atime_ns // 1000, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LISTED_ARROW)], schema=LISTED_ARROW)


class FolderListing(DataSource):
    """``spark.read.format("folder")``: options path, recursive, partitions."""

    @classmethod
    def name(cls):
        return "folder"

    def schema(self):
        return LISTED

    def reader(self, schema):
        return FolderReader(local_path(self.options["path"]), self.options.get("recursive", "true") == "true",
                            int(self.options.get("partitions", PARTITIONS)))


def list_folder(spark: SparkSession, directory: str, recursive: bool = False, include: str | None = None) -> DataFrame:
    """One row per file: file_path, file_size, its three times as ISO text of the session's zone, and errors.

    ``creation_time`` is the time that the file system gives as ``ctime``. Folders that cannot be listed and
    files that cannot be looked at have a row with an error.
    """
    spark.dataSource.register(FolderListing)
    found = spark.read.format("folder").option("path", directory).option("recursive", str(recursive).lower()).load()
    if include:
        found = found.where(F.col("problem").isNotNull() | glob_match(basename(F.col("file_path")), include))

    def iso(name):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    problem = F.array(error_struct("ReadError", F.concat_ws(": ", "problem", "file_path")))
    return found.select("file_path", "file_size", iso("created").alias("creation_time"), iso("modified").alias("modification_time"),
                        iso("accessed").alias("access_time"),
                        F.when(F.col("problem").isNull(), F.array().cast(f"array<{ERROR.simpleString()}>")).otherwise(problem).alias("errors"))


def scan_folder(spark: SparkSession, directory: str, recursive: bool = False, include: str | None = None,
                max_content_bytes: int | None = None) -> DataFrame:
    """The listing with ``content``, every file included. Files above ``max_content_bytes`` have null content.

    Listed files are dealt anew before they are read, so that the files of one large folder are read by many
    tasks. A file that cannot be read, or has gone, has null content and an error.
    """
    listed = list_folder(spark, directory, recursive, include)
    schema = StructType([*listed.schema.fields, StructField("content", BinaryType()), StructField("unread", listed.schema["file_path"].dataType)])

    def run(batches):
        for batch in batches:
            paths, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done, held, content, unread = 0, 0, [], []

            def flush(end):
                return pa.RecordBatch.from_arrays([*batch.slice(done, end - done).columns, pa.array(content, pa.binary()),
                                                   pa.array(unread, pa.string())], schema.names)

            for i, (path, size) in enumerate(zip(paths, sizes)):
                data, problem = None, None
                if size is not None and (max_content_bytes is None or size <= max_content_bytes):
                    try:
                        with open(path, "rb") as file:
                            data = file.read()
                    except OSError as error:
                        problem = error.strerror
                content.append(data)
                unread.append(problem)
                held += len(data or b"")
                if held >= CONTENT_BYTES:
                    yield flush(i + 1)
                    done, held, content, unread = i + 1, 0, [], []
            if done < batch.num_rows:
                yield flush(batch.num_rows)

    read = listed.repartition("file_path").mapInArrow(run, schema)
    problem = F.array(error_struct("ReadError", F.concat_ws(": ", F.lit("File could not be read"), "unread", "file_path")))
    return read.withColumn("errors", F.when(F.col("unread").isNull(), F.col("errors")).otherwise(F.concat("errors", problem))).drop("unread")


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    """Rows (file_path, content) as files. A task's files appear at its end, each by one rename.

    Files that cannot be written are named in ``failures``, one JSON line each; the others are.
    """

    def __init__(self, staging: str, failures: str, path_at: int, content_at: int):
        self.staging, self.failures, self.path_at, self.content_at = staging, failures, path_at, content_at

    def write(self, iterator):
        own = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(own)
        ready, failed = [], []
        try:
            for row in iterator:
                target, content = row[self.path_at], row[self.content_at]
                staged = os.path.join(own, str(len(ready)))
                with open(staged, "wb") as file:
                    file.write(content.encode() if isinstance(content, str) else bytes(content or b""))
                ready.append((staged, target))
            os.sync()  # all staged files at once, before any takes its name
            made = set()
            for staged, target in ready:
                try:
                    if (parent := os.path.dirname(target)) not in made:
                        os.makedirs(parent, exist_ok=True)
                        made.add(parent)
                    os.replace(staged, target)  # a task that runs again replaces what it wrote
                except OSError as problem:
                    failed.append({"file_path": target, "problem": problem.strerror})
            if failed:
                listed = os.path.join(own, "failed")
                with open(listed, "w") as file:
                    file.writelines(json.dumps(f) + "\n" for f in failed)
                os.replace(listed, os.path.join(self.failures, f"{uuid.uuid4().hex}.json"))
        finally:
            _remove(own)
        return Written(len(ready) - len(failed))

    def commit(self, messages):
        _remove(self.staging)

    def abort(self, messages):
        _remove(self.staging)


def _remove(folder: str) -> None:
    """Staged files of this job only."""
    for root, _, names in os.walk(folder, topdown=False):
        for name in names:
            os.unlink(os.path.join(root, name))
        os.rmdir(root)


class FileSink(DataSource):
    """``df.write.format("files")``: options path, below which files are staged, and failures, a folder for their names."""

    @classmethod
    def name(cls):
        return "files"

    def writer(self, schema, overwrite):
        names = schema.fieldNames()
        staging = os.path.join(local_path(self.options["path"]), f".staging-{uuid.uuid4().hex}")
        return FileWriter(staging, self.options["failures"], names.index("file_path"), names.index("content"))


def write_files(df: DataFrame, directory: str) -> DataFrame:
    """Write each row (file_path below ``directory``, content as text or bytes) as one file.

    Files appear whole or not at all. A job that fails leaves the files of its finished tasks and nothing
    else; when it runs again, each file is there once. Paths must differ between rows. Returns the files
    that could not be written: file_path and problem.
    """
    spark, folder = df.sparkSession, local_path(directory)
    spark.dataSource.register(FileSink)
    paths = df.select(F.regexp_replace("file_path", r"\Afile:/*", "/").alias("file_path"), "content")
    inside = F.col("file_path").startswith(folder.rstrip("/") + "/") & ~F.col("file_path").rlike(r"(\A|/)\.\.(/|\z)")
    checked = paths.withColumn("file_path", F.when(inside, F.col("file_path")).otherwise(
        F.raise_error(F.concat(F.lit("not below the folder: "), "file_path")).cast("string")))
    failures = local_path(scratch_path(spark))
    os.makedirs(failures)
    checked.write.format("files").option("path", folder).option("failures", failures).mode("append").save()
    return spark.read.schema("file_path string, problem string").json(failures)
