"""Fetched files on disk, as tables. Expected layout: ``<root>/<class>/<sha256>.apk``."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from fnmatch import translate
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions import columns as C
from sievecraft.shipping import ship

# Fixed value: class folder and hash in a file's path.
_PATH_PATTERN = r"([^/]+)/([^/]+)\.apk$"

#: Bytes of a file in a task's memory at a time.
CHUNK = 1 << 20
#: Stores that a task opens itself. Files elsewhere are read by Spark, one row each, up to ``ROW_BYTES``.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
ROW_BYTES = (1 << 31) - (1 << 20)


def _named(files: DataFrame, pattern: str) -> DataFrame:
    return files.withColumns(
        {
            "class": F.regexp_extract("path", pattern, 1),
            "sha256": F.lower(F.regexp_extract("path", pattern, 2)),
        }
    )


def _files(spark: SparkSession, root: str, glob: str = "*/*.apk", pattern: str = _PATH_PATTERN) -> DataFrame:
    # a file that goes between listing and reading is not there
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(f"{root}/{glob}")
    return _named(files, pattern)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Which files there are, by name: ``class, sha256, length``. Opens no file."""
    return _files(spark, root).select("class", "sha256", "length")


def listed_files(
    spark: SparkSession, root: str, glob: str = "*/*.apk", pattern: str = _PATH_PATTERN
) -> DataFrame:
    """``class, sha256, length, path`` of the files. Opens none; a listing can be kept, and read by ``with_digests`` later.

    Tasks list the folders: see ``walked``. Stores that tasks cannot open, and patterns with more than ``*`` and ``?``, are
    listed by the driver.
    """
    files = walked(spark, root, glob) if can_walk(spark, root, glob) else None
    # where there is nothing, Spark's own listing says so
    files = _files(spark, root, glob, pattern) if files is None or files.isEmpty() else _named(files, pattern)
    return files.select("class", "sha256", "length", "path")


def tasks_open(spark: SparkSession, root: str) -> bool:
    return (urlsplit(root).scheme or _default_scheme(spark)) in OPENED


def _qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def can_walk(spark: SparkSession, root: str, glob: str) -> bool:
    return tasks_open(spark, root) and not re.search(r"[\\{}\[\]*?]", root) and not re.search(r"[\\{}\[\]]|^/|//|/$", glob)


def walked(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``path, length`` of the files that match, found folder by folder; each level of folders is shared out among tasks.

    The driver sees no names, however many folders there are. Hidden files are left out as Spark's readers do.
    """
    ship(spark)
    found = spark.createDataFrame([(_qualified(spark, root), 0, False)], "path string, length long, is_file boolean")
    levels, tasks = glob.split("/"), _tasks(spark)
    for at, level in enumerate(levels):
        folders = found.where("not is_file").select("path")
        found = (folders.repartition(tasks, "path") if at else folders).mapInArrow(
            _lister(level, at == len(levels) - 1), "path string, length long, is_file boolean"
        )
    # one folder may hold most of the files: what reads them is shared out anew
    return found.select("path", "length").repartition(tasks, "path")


def _tasks(spark: SparkSession) -> int:
    return max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _lister(level: str, last: bool):
    """Entries of folders whose names match: folders, or on the last level files, and those in a folder that matches."""
    matches = re.compile(translate(level)).match

    def listed(folder: str) -> Iterator[tuple[str, int, bool]]:
        for name, is_file, length in entries(folder):
            path = f"{folder.rstrip('/')}/{name}"
            if not matches(name):
                continue
            if not last:
                if not is_file:
                    yield path, 0, False
            elif is_file:
                if not _hidden(name):
                    yield path, length, True
            else:
                yield from ((f"{path}/{n}", size, True) for n, there, size in entries(path) if there and not _hidden(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, bool]] = []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for row in listed(folder):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
        yield _batch(rows)

    return run


def _batch(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [(), (), ()]
    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["path", "length", "is_file"])


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a file, and size of what a folder holds. A folder that is gone holds nothing."""
    store, at = store_of(folder)
    if store is None:
        try:
            with os.scandir(at) as found:
                for entry in found:
                    # an entry that goes while it is looked at is not there
                    try:
                        is_file = not entry.is_dir()
                        size = entry.stat().st_size if is_file else 0
                    except FileNotFoundError:
                        continue
                    # checksums that Spark keeps beside a local file
                    if not (entry.name.startswith(".") and entry.name.endswith(".crc")):
                        yield entry.name, is_file, size
        except (FileNotFoundError, NotADirectoryError):
            return
    else:
        for info in store.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True)):
            yield info.base_name, info.type == pyarrow.fs.FileType.File, info.size or 0


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem | None, str]:
    """The store of a path (None: this machine's folders) and the path in it."""
    url = urlsplit(path, allow_fragments=False)
    if url.scheme in ("", "file"):
        return None, path.removeprefix("file:").removeprefix("//")
    # the last part stays as it is: paths are not escaped
    store, root = pyarrow.fs.FileSystem.from_uri(f"{url.scheme.replace('s3a', 's3')}://{url.netloc}")
    return store, "/".join(p for p in (root.rstrip("/"), path.split(url.netloc, 1)[1].lstrip("/")) if p)


def opened(path: str):
    """A binary stream of a file."""
    store, at = store_of(path)
    return open(at, "rb", CHUNK) if store is None else store.open_input_stream(at)


def write_files(rows: DataFrame, root: str) -> None:
    """One file for each row (``path`` below the root, ``content`` in bytes), written by the tasks: no driver lists or moves them."""
    ship(rows.sparkSession)
    root = _qualified(rows.sparkSession, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                put(f"{root}/{path.as_py()}", content.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    rows.select("path", "content").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def put(path: str, content: bytes) -> None:
    """Writes a file, and its folder where there is none. A task that runs again writes the same."""
    store, at = store_of(path)
    folder = at.rpartition("/")[0]
    if store is None:
        os.makedirs(folder, exist_ok=True)
        with open(at, "wb") as out:
            out.write(content)
    else:
        store.create_dir(folder)
        with store.open_output_stream(at) as out:
            out.write(content)


def digest_of(path: str) -> str | None:
    """SHA-256 of a file of any size in bounded memory; None where it cannot be opened or read to its end."""
    hashed = hashlib.sha256()
    try:
        with opened(path) as stream:
            while chunk := stream.read(CHUNK):
                hashed.update(chunk)
    except OSError:
        return None
    return hashed.hexdigest()


def with_digests(listing: DataFrame) -> DataFrame:
    """Adds ``content_sha256`` (empty where a file cannot be read) and ``readable`` to a listing with ``path``.

    A file that is gone, forbidden or damaged costs no more than its own row.
    """
    ship(listing.sparkSession)
    columns = listing.columns

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one row at a time: a batch may stand for a lot of bytes
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                path = row.column("path")[0].as_py()
                found = digest_of(path) if path else None
                more = [pa.array([found or ""]), pa.array([found is not None])]
                yield pa.RecordBatch.from_arrays([*row.columns, *more], [*columns, "content_sha256", "readable"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema)
    return listing.mapInArrow(digest, f"{schema}, content_sha256 string, readable boolean")


def hashed_files(
    spark: SparkSession, root: str, glob: str = "*/*.apk", pattern: str = _PATH_PATTERN
) -> DataFrame:
    """Files with the hash of what they hold: ``class, sha256, length, content_sha256, readable``.

    ``glob`` and ``pattern`` (class, then hash, from the path) serve trees of another layout. Tasks stream each file, of any
    size, through the hash. In stores that only Spark can open (``OPENED`` lists the others) a file is read as one row: those
    above ``ROW_BYTES`` count as unreadable there, and one that breaks while it is read fails the job.
    """
    result = ["class", "sha256", "length", "content_sha256", "readable"]
    if tasks_open(spark, root):
        return with_digests(listed_files(spark, root, glob, pattern)).select(*result)
    files = _files(spark, root, glob, pattern)
    fits = F.col("length") <= ROW_BYTES
    small = files.where(fits).withColumns({"content_sha256": C.content_hash(F.col("content")), "readable": F.lit(True)})
    large = files.where(~fits).withColumns({"content_sha256": F.lit(""), "readable": F.lit(False)})
    return small.select(*result).unionByName(large.select(*result))


def _default_scheme(spark: SparkSession) -> str:
    return spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).getScheme()
