"""Reading and writing the tables that the engine works on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from heliosite.sources.commits import Store
from heliosite.sources.tiles import filesystem


def _text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"')


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names in the file's own first row; a byte order mark isn't part of them. A file without one is an error."""
    names = _csv(spark).option("enforceSchema", False).csv(path).columns
    if not names:
        raise ValueError(f"no header: {path}")
    return [n.removeprefix("﻿") for n in names]


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The file, or the files of a folder that Spark would read, by name; empty ones hold nothing, not even a header."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    named = [(str(f.getPath()), f.getLen()) for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    return sorted(name for name, size in named if size)


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Every cell a string and blanks empty, as in the source files. A required column that a file's header lacks is an error.

    ``columns``: which to keep, in this order; those that the file lacks are blank. All of the first file's by default. Files of a folder may have their columns
    in different orders: those with the same header are read together, and columns meet by name; a column that only some files have is blank in the others.
    """
    kinds: dict[tuple[str, ...], list[str]] = {}
    for file in data_files(spark, path):
        kinds.setdefault(tuple(csv_header(spark, file)), []).append(file)
    if not kinds:
        raise ValueError(f"no header: {path}")
    wanted = columns or list(dict.fromkeys(c for header in kinds for c in header))
    out = None
    for header, files in kinds.items():
        if missing := set(required) - set(header):
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        rows = _csv(spark).schema(_text_schema(list(header))).csv(files).na.fill("")
        rows = rows if wanted == list(header) else fixed_projection(rows, wanted)
        out = rows if out is None else out.unionByName(rows)
    return out


def read_typed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Columns by name under ``schema``; all of them are required, cells that can't be read are null."""
    rows = read_text_csv(spark, path, required=tuple(schema.names))
    return rows.select([F.nullif(F.trim(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema])


def read_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """As ``read_text_csv``, but no rows where the path doesn't exist in its file system."""
    return read_text_csv(spark, path, columns) if exists(spark, path) else spark.createDataFrame([], _text_schema(columns))


def read_where(spark: SparkSession, path: str, equal: dict[str, object], order: list[str]) -> DataFrame:
    """Parquet rows with these values, in order; the conditions reach the scan."""
    rows = spark.read.parquet(path)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(*order)


def fixed_projection(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns``; one that ``df`` lacks is empty text."""
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def with_added_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The columns that ``df`` lacks, with their defaults; those that it has stay."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def write_csv(df: DataFrame, path: str, columns: list[str], strict: bool = False) -> None:
    """Replace a table of text cells under fixed columns. ``strict``: columns beyond them are an error.

    The new table is written beside the old one and takes its name when it is whole; a job that fails leaves the old one as it was. If the driver dies
    between the two renames, the old table stands under ``{path}.before``.
    """
    extra = sorted(set(df.columns) - set(columns))
    if strict and extra:
        raise ValueError(f"unknown columns: {', '.join(extra)}")
    spark, place = df.sparkSession, path.rstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = hadoop(f"{place}.{uuid.uuid4().hex}"), hadoop(f"{place}.before")
    try:
        fixed_projection(df, columns).write.option("header", True).option("escape", '"').csv(new.toString())
        if files.exists(hadoop(place)):
            files.delete(old, True)
            if not files.rename(hadoop(place), old):
                raise OSError(f"{path} couldn't be moved away")
        if not files.rename(new, hadoop(place)):
            files.rename(old, hadoop(place))
            raise OSError(f"{path} couldn't be replaced")
        files.delete(old, True)
    finally:
        files.delete(new, True)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """One batch under its run's partition; a later batch of the run is added beside it. A batch that is tried again is added again; ``sources.commits`` stores each once."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def checkpoint_run(tables: dict[str, DataFrame], root: str, run_id: str, batch: int) -> bool:
    """One batch of several tables of a run, all or none of them and once only; False if it is there already."""
    return Store(tables[next(iter(tables))].sparkSession, root).commit(f"{run_id}-{batch:06d}", {name: df.withColumn("run_id", F.lit(run_id)) for name, df in tables.items()})


def latest_run(df: DataFrame) -> DataFrame:
    """Rows of the newest run whose id is a timestamp."""
    runs = df.where(F.col("run_id").cast("string").rlike(r"^\d{8}_\d{6}$"))
    return runs.join(F.broadcast(runs.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")


IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")


def list_images(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, stem, length) of image files below ``path``, by extension, sorted without regard to case. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    named = files.where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})$"))
    return named.select("path", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), "length").orderBy(F.lower("path"))


def first_image_per_id(images: DataFrame) -> DataFrame:
    """(id, path) of the first file named ``{id}_...`` for each whole-number id."""
    ids = images.select(F.regexp_extract("stem", r"^(\d+)_", 1).try_cast("bigint").alias("id"), "path")
    return ids.where("id is not null").groupBy("id").agg(F.min("path").alias("path"))


def with_existence(rows: DataFrame, path: str, exists: str = "exists") -> DataFrame:
    """``rows`` with whether the file that ``path`` names is there; blank and null name none.

    Each folder that the rows name is listed once, by a task, so the calls grow with the folders and not with the rows. A folder that isn't there has no files.
    """
    clean = F.trim(F.coalesce(F.col(path), F.lit("")))
    split = rows.withColumns({"_folder": F.when(clean.contains("/"), F.regexp_extract(clean, r"^(.*)/[^/]*$", 1)), "_file": F.regexp_extract(clean, r"([^/]*)$", 1)})
    folders = split.where("_folder is not null and _file <> ''").select("_folder").distinct()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, root = filesystem(folder or "/")
                try:
                    names = [f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File]
                except NotADirectoryError:
                    names = []
                yield pa.RecordBatch.from_arrays([pa.array([folder] * len(names), pa.string()), pa.array(names, pa.string())], names=["_folder", "_file"])

    there = folders.mapInArrow(listed, "_folder string, _file string").withColumn(exists, F.lit(True))
    return split.join(there, ["_folder", "_file"], "left").select(*rows.columns, F.coalesce(exists, F.lit(False)).alias(exists))


def resolved_path(path: Column, root: str) -> Column:
    """Absolute paths and URIs as they are, others below ``root``; blank stays blank."""
    clean = F.trim(F.coalesce(path, F.lit("")))
    return F.when(clean == "", "").when(clean.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), clean).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), clean))


def merged_config(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``: dictionaries key by key, all else replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def first_setting(config: dict, *keys: str, default=None):
    """The first of ``keys`` that has a value other than blank."""
    return next((config[k] for k in keys if config.get(k) not in (None, "")), default)
