"""Batches of several tables that appear together or not at all, and are stored once however often they are tried.

A batch's tables are written to folders of this attempt, which plain readers of the table pass over. One small manifest file,
renamed into place when all are written, makes the batch part of every table at once; readers take the folders that manifests
name. A batch whose manifest is there isn't written again, so a retried step doubles nothing. What a crash
leaves behind no manifest names; ``sweep`` deletes it. One driver writes a store at a time.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCHES, COMMITS = "_batches", "_commits"


class Store:
    """Tables under ``root``, in any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _names(self, *parts: str) -> list[str]:
        folder = self._path(self.root, *parts)
        return sorted(x.getPath().getName() for x in self._files.listStatus(folder)) if self._files.exists(folder) else []

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return [n.removesuffix(".json") for n in self._names(COMMITS) if n.endswith(".json")]

    def _manifest(self, batch: str) -> dict:
        stream = self._files.open(self._path(self.root, COMMITS, f"{batch}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Store a batch; False if it was stored before. Ids are letters, digits, dots, dashes and underscores, a letter or digit first."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.batches():
            return False
        folders = {}
        for name, rows in tables.items():
            folder = f"{batch}.{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{name}/{BATCHES}/{folder}")
            folders[name] = {"folder": folder, "schema": rows.schema.jsonValue()}
        part = self._path(self.root, COMMITS, f".{batch}.{uuid.uuid4().hex}")
        out = self._files.create(part, True)
        out.write(bytearray(json.dumps({"batch": batch, "tables": folders}).encode()))
        out.close()
        if not self._files.rename(part, self._path(self.root, COMMITS, f"{batch}.json")):
            raise OSError(f"batch {batch} couldn't be committed")
        return True

    def read(self, name: str, schema: StructType | str | None = None) -> DataFrame:
        """All rows of committed batches, with ``batch``; no rows under ``schema`` if there are none yet. Columns that some batches lack are null."""
        held = [(b, m["tables"][name]) for b in self.batches() if name in (m := self._manifest(b))["tables"]]
        if not held:
            if schema is None:
                raise ValueError(f"no batch of {name}, and no schema to give for it")
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
        kinds: dict[str, list[str]] = {}
        for _, x in held:
            kinds.setdefault(json.dumps(x["schema"]), []).append(f"{self.root}/{name}/{BATCHES}/{x['folder']}")
        out = None
        for kind, folders in kinds.items():
            rows = self.spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(*folders)
            rows = rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), rf"/{BATCHES}/(.*)\.[0-9a-f]{{32}}/[^/]*$", 1))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def sweep(self) -> list[str]:
        """Delete the folders that no manifest names; their names. Not while a batch is being written."""
        named = {(t, x["folder"]) for b in self.batches() for t, x in self._manifest(b)["tables"].items()}
        gone = []
        for table in self._names():
            for folder in self._names(table, BATCHES) if table != COMMITS else []:
                if (table, folder) not in named:
                    self._files.delete(self._path(self.root, table, BATCHES, folder), True)
                    gone.append(f"{table}/{folder}")
        return gone
