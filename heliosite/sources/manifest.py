"""A Parquet sink whose commit writes one manifest of all its files, and a check of files against it.

Every task writes its rows to one file and reports the file's name, rows, bytes and SHA-256; the commit gathers the reports in
``manifest.json``, renamed into place, and only then is the table whole. ``verify`` reads the files again, in tasks.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from heliosite.sources.tiles import filesystem

MANIFEST = "manifest.json"


class _Counted:
    """A stream that counts and digests what goes through it."""

    def __init__(self, out):
        self.out, self.size, self.sha, self.closed = out, 0, hashlib.sha256(), False

    def write(self, data) -> int:
        self.sha.update(data)
        self.size += len(data)
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()

    def tell(self) -> int:
        return self.size

    def close(self) -> None:
        self.closed = True
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int
    bytes: int
    sha256: str


class ManifestWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, about: dict[str, str]):
        self.path, self.overwrite, self.about = path.rstrip("/"), overwrite, about

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.path)
        name, writer, out, rows = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet", None, None, 0
        try:
            for batch in batches:
                if writer is None:
                    files.create_dir(root, recursive=True)
                    out = _Counted(files.open_output_stream(f"{root}/{name}"))
                    writer = pq.ParquetWriter(pa.PythonFile(out, mode="w"), batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
                if not out.closed:
                    out.close()
        return Written(name if writer else None, rows, out.size if out else 0, out.sha.hexdigest() if out else "")

    def commit(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        wrote = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.file)
        part = f"{root}/.{MANIFEST}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            about = self.about | {"rows": sum(m.rows for m in wrote), "bytes": sum(m.bytes for m in wrote)}
            out.write(json.dumps(about | {"files": [vars(m) for m in wrote]}, ensure_ascii=False, indent=2).encode())
        before = read_manifest(self.path)
        if before is not None and not self.overwrite:
            files.delete_file(part)
            self.abort(messages)
            raise ValueError(f"{self.path} holds a table already")
        files.move(part, f"{root}/{MANIFEST}")
        for old in before["files"] if before else []:  # the new manifest names them no more
            with suppress(FileNotFoundError):
                files.delete_file(f"{root}/{old['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.file:
                files.delete_file(f"{root}/{m.file}")


class ManifestSink(DataSource):
    """``path``; other options are noted in the manifest."""

    @classmethod
    def name(cls) -> str:
        return "heliosite_manifest"

    def writer(self, schema, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options["path"], overwrite, {k: v for k, v in self.options.items() if k.lower() != "path"})


def write_with_manifest(rows: DataFrame, path: str, overwrite: bool = False, **about: str) -> None:
    rows.sparkSession.dataSource.register(ManifestSink)
    rows.write.format(ManifestSink.name()).mode("overwrite" if overwrite else "append").options(path=path, **about).save()


def read_manifest(path: str) -> dict | None:
    files, root = filesystem(path.rstrip("/"))
    try:
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(file, status): ok, changed or missing for each file of the manifest; added for Parquet files beside it."""
    from pyarrow import fs

    manifest = read_manifest(path)
    if manifest is None:
        raise ValueError(f"no manifest in {path}")
    files, root = filesystem(path.rstrip("/"))
    named = {f["file"] for f in manifest["files"]}
    beside = [x.base_name for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".parquet") and x.base_name not in named]
    schema = "file string, rows long, bytes long, sha256 string"
    known = spark.createDataFrame([tuple(f[k] for k in ("file", "rows", "bytes", "sha256")) for f in manifest["files"]] + [(x, -1, -1, "") for x in beside], schema)
    where = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(where)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sha, size = hashlib.sha256(), 0
                try:
                    with files.open_input_stream(f"{root}/{r['file']}") as f:
                        while block := f.read(1 << 20):
                            sha.update(block)
                            size += len(block)
                    status = "added" if r["rows"] < 0 else "ok" if (size, sha.hexdigest()) == (r["bytes"], r["sha256"]) else "changed"
                except FileNotFoundError:
                    status = "missing"
                out.append((r["file"], status))
            names, states = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(states, pa.string())], names=["file", "status"])

    return known.repartition(max(1, min(len(named) + len(beside), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, "file string, status string")
