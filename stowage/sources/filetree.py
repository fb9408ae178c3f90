"""The file-tree source: spark.read.format("filetree").

A Python Data Source.  The driver opens directories, breadth first, until SPLIT of them are at hand, and each becomes a
partition that an executor walks; directories, empty files and dot files are rows too, symbolic links are not followed,
and excluded subtrees are not entered.  A file that cannot be read still is a file: it has a row without a hash, and one
with the warning.  Options: roots (JSON array), max_depth, excludes (JSON array), hash (true to read all contents; a scan
hashes afterwards, by hashed(), the files whose size is not theirs alone).
"""

from __future__ import annotations

import json
import os
import stat
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import blake3
from ..functions.scalars import extension, top_directory
from ..operators.filters import Excludes
from ..tables import importable, temporary

SCHEMA = "root_path string, path string, kind string, size_bytes bigint, modified_ts timestamp, content_hash string, warning string"
#: Directories that are walked on their own, about; bytes of contents that a task hashes, about.
SPLIT, HASH_BYTES = 256, 1 << 30


class Part(InputPartition):
    """Directories with their depths; if not deep, only what stands directly in them."""

    def __init__(self, root: str, starts: list[tuple[str, int]], deep: bool):
        self.root, self.starts, self.deep = root, starts, deep


def reader_of(f):
    """Bytes of an open file by offset and number, all of them or an error."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        data = f.read(n)
        if len(data) != n:
            raise OSError("the file changed while it was read")
        return data

    return read


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return blake3.span_digest(reader_of(f), os.fstat(f.fileno()).st_size)


def readable_digest(path: str) -> tuple[str | None, str | None]:
    """The digest, or null and why there is none."""
    try:
        return digest(path), None
    except OSError as e:
        return None, str(e)


class FileTreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [os.path.abspath(r) for r in json.loads(options.get("roots") or "[]")]
        self.depth = int(options["max_depth"]) if options.get("max_depth") else None
        self.excludes = json.loads(options.get("excludes") or "[]")
        self.hash = str(options.get("hash", "false")).lower() == "true"

    def partitions(self):
        out, skip = [], Excludes(self.excludes)
        each = max(1, SPLIT // max(1, len(self.roots)))
        for root in self.roots:
            opened, ahead = [], [(root, 0)]
            while ahead and len(ahead) < each:
                folder, depth = ahead.pop(0)
                opened.append((folder, depth))
                if self.depth is not None and depth >= self.depth:
                    continue
                try:
                    with os.scandir(folder) as entries:
                        ahead += sorted((e.path, depth + 1) for e in entries if e.is_dir(follow_symlinks=False) and not skip.matches(e.path))
                except OSError:
                    continue  # the walk tells
            out.append(Part(root, opened, False))
            out += [Part(root, [at], True) for at in ahead]
        return out

    def read(self, part: Part):
        skip = Excludes(self.excludes)
        stack = list(reversed(part.starts))
        while stack:
            folder, depth = stack.pop()
            if self.depth is not None and depth >= self.depth:
                continue
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as e:
                yield part.root, folder, "warning", None, None, None, str(e)
                continue
            for e in entries:
                if skip.matches(e.path):
                    continue
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError as error:
                    yield part.root, e.path, "warning", None, None, None, str(error)
                    continue
                if stat.S_ISDIR(s.st_mode):
                    yield part.root, e.path, "directory", None, None, None, None
                    if part.deep:
                        stack.append((e.path, depth + 1))
                elif stat.S_ISREG(s.st_mode):
                    own, warning = readable_digest(e.path) if self.hash else (None, None)
                    yield part.root, e.path, "file", s.st_size, datetime.fromtimestamp(int(s.st_mtime), UTC), own, None
                    if warning:
                        yield part.root, e.path, "warning", None, None, None, warning


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader(self.options)


def read_tree(spark: SparkSession, roots: list[str], max_depth: int | None = None, excludes=(), with_hash: bool = False) -> DataFrame:
    importable(spark)
    spark.dataSource.register(FileTree)
    r = spark.read.format("filetree").option("roots", json.dumps(list(roots))).option("excludes", json.dumps(list(excludes))).option("hash", str(with_hash).lower())
    return (r if max_depth is None else r.option("max_depth", str(max_depth))).load()


def files_of(tree: DataFrame, scan_id: str, mounts: DataFrame | None = None) -> DataFrame:
    """The files fact: scan_id, root_path, path, size_bytes, disk_mount, modified_ts, extension, top_dir, content_hash."""
    f = tree.where("kind = 'file'").select(F.lit(scan_id).alias("scan_id"), "root_path", "path", "size_bytes", "modified_ts", "content_hash")
    f = f.withColumns({"extension": extension(F.col("path")), "top_dir": top_directory(F.col("path"), F.col("root_path"))})
    if mounts is None:
        return f.withColumn("disk_mount", F.lit(None).cast("string"))
    from ..operators.mounts import match_mounts

    roots = match_mounts(f.select("root_path").distinct(), mounts)
    return f.join(F.broadcast(roots), "root_path")  # the roots of a scan: as many as its caller named


def file_record(path: str, mount: str | None = None, modified: datetime | None = None) -> dict:
    """The record of one file from its metadata."""
    s = os.stat(path)
    return {"path": os.path.abspath(path), "size_bytes": s.st_size, "disk_mount": mount, "modified": modified or datetime.fromtimestamp(int(s.st_mtime), UTC)}


def _pieces(batches, segment: int):
    """Of rows path, size_bytes, pieces, piece: the digest of a file of one piece, the chaining value of one of several, or
    a warning.  Small files are read until there is a window of bytes and hashed together."""
    import pyarrow as pa

    names = ("path", "pieces", "piece", "value", "content_hash", "warning")
    types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
    for batch in batches:
        out, waiting, held = [], [], 0
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for k, (path, size, pieces, piece) in enumerate(rows):
            try:
                with open(path, "rb") as f:
                    if pieces > 1:
                        out.append((path, pieces, piece, blake3.piece_value(reader_of(f), size, piece, segment), None, None))
                    elif size > blake3.WINDOW:
                        out.append((path, 1, 0, None, blake3.span_digest(reader_of(f), size), None))
                    else:
                        waiting.append((path, reader_of(f)(0, size)))
                        held += size
            except OSError as e:
                out.append((path, pieces, piece, None, None, str(e)))
            if waiting and (held > blake3.WINDOW or k == len(rows) - 1):
                out += [(p, 1, 0, None, h, None) for (p, _), h in zip(waiting, blake3.digests([t for _, t in waiting]), strict=True)]
                waiting, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=list(names))


def _whole(batches):
    import pyarrow as pa

    for batch in batches:
        digests = [blake3.joined([v["value"] for v in values]) for values in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["path", "content_hash"])


def hashed(files: DataFrame, segment: int = blake3.SEGMENT) -> DataFrame:
    """files: path, size_bytes.  path, content_hash and warning (null where the other is not) of each distinct path, read
    once on the executors, about HASH_BYTES a task.  A file of more than a segment is as many tasks' work as it has
    segments; 32 bytes of each come together to its digest."""
    spark = files.sparkSession
    importable(spark)
    rows = files.select("path", "size_bytes").dropDuplicates(["path"])
    rows = rows.withColumn("pieces", F.greatest(F.ceil(F.col("size_bytes") / segment), F.lit(1)).cast("bigint"))
    total, n = rows.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)), F.coalesce(F.sum("pieces"), F.lit(0))).first()
    parts = max(-(-total // HASH_BYTES), min(spark.sparkContext.defaultParallelism, n), 1)
    rows = rows.select("path", "size_bytes", "pieces", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"))
    schema = "path string, pieces bigint, piece bigint, value binary, content_hash string, warning string"
    found = rows.repartition(int(parts), "path", "piece").mapInArrow(lambda b: _pieces(b, segment), schema)
    if not rows.where("pieces > 1").isEmpty():
        found = temporary(found, "pieces")  # no file is read twice
        many = found.where("pieces > 1").groupBy("path").agg(F.min("warning").alias("warning"), F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("values"))
        broken = many.where("warning is not null").select("path", F.lit(None).cast("string").alias("content_hash"), "warning")
        joined = many.where("warning is null").select("path", "values").mapInArrow(_whole, "path string, content_hash string")
        return found.where("pieces = 1").select("path", "content_hash", "warning").unionByName(broken).unionByName(joined.withColumn("warning", F.lit(None).cast("string")))
    return found.select("path", "content_hash", "warning")
