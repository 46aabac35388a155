"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='heliosite-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/heliosite-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run in here delete their own shuffle files when they end, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def persisted(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, so a lost executor costs a reread."""
    spark = df.sparkSession
    path = folder or shared_dir(spark)
    with shuffles_dropped(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete tables that ``persisted`` wrote and nothing reads any more."""
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            delete_folder(df.sparkSession, folder)


def delete_folder(spark: SparkSession, uri: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def open_filesystem(uri: str):
    """(pyarrow filesystem, path in it) for a shared folder's URI, usable inside tasks."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under another name, then rename: retried or speculative tasks leave one whole file."""
    filesystem, path = open_filesystem(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(part) as out:
        out.write(data)
    filesystem.move(part, path)


def read_file(uri: str) -> bytes:
    filesystem, path = open_filesystem(uri)
    with filesystem.open_input_stream(path) as f:
        return f.read()


def local_file(uri: str) -> str:
    """A path that can be memory-mapped: the file itself on a mounted store, else a copy in this worker's folder."""
    filesystem, path = open_filesystem(uri)
    if filesystem.type_name == "local":
        return path
    local = os.path.join(tempfile.gettempdir(), uri.replace("/", "_"))
    if not os.path.exists(local):
        with filesystem.open_input_stream(path) as src, open(part := f"{local}.{uuid.uuid4().hex}", "wb") as out:
            while block := src.read(1 << 22):
                out.write(block)
        os.replace(part, local)
    return local
