"""Shared helpers: the cluster's shared folder, materialised tables, files, slices of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, and a word between it, as Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark reads it by, so that workers don't take a bare path of the shared store for a local one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on a cluster it is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        root = "file://" + tempfile.mkdtemp(prefix="sightline-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return qualified(spark, root).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/sightline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts the lineage and outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise() gave and that nothing reads any more: what followed from them is in tables of its own."""
    for table in tables:
        spark = table.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a qualified URI."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} has no scheme")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def put_file(uri: str, parts: list[bytes]) -> None:
    """Write a file under another name and move it, so that a reader never sees half of it and a retry does no harm."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    system.move(temporary, path)


def get_file(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_stream(path) as source:
        return source.read()


def exists(uri: str) -> bool:
    system, path = filesystem(uri)
    return system.get_file_info(path).type == fs.FileType.File


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file: memory-mapped where the shared store is mounted, else read into this process; never copied to a local disk."""
    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, np.uint8)
    return np.frombuffer(get_file(uri), np.uint8)


def release() -> None:
    """Give back what a task no longer needs: workers live on between stages, and memory that is free inside them still counts as the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def slices(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about so many characters each; a longer text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binaries, one value after another and not copied, and where values begin in them (and the last one ends). Null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def byte_slices(offsets: np.ndarray, size: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values with at most so many bytes each; a longer value stands alone."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str, tidy: bool = False) -> DataFrame:
    """mapInArrow over a function built once a task. It turns a batch into dicts of columns; its attribute done, if any, is called at the end. tidy: the worker gives free memory back after each task, which
    costs some 6 % of an encoder's time and is for operators that share workers with others in a pipeline."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)
        each = make()
        for batch in batches:
            for columns in each(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in out], schema=out)
        getattr(each, "done", lambda: None)()
        if tidy:
            release()

    return df.mapInArrow(run, fields)


def crc32_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
