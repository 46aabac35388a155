"""Map tiles as a table: a data source over a shared tile folder, with a cache that can be trusted.

A tile is a row (zoom, x, y, path, content, error) of the extent that is asked for, whether its file exists or not. Conditions on
zoom, x and y are planned away: only what is left of the extent is dealt out in ranges of ``tilesperpartition`` tiles,
and only those files are opened. Files stand as ``zoom/y/x.jpg``. A tile that the folder lacks comes from ``origin``,
a second folder of the same layout, and is kept; ``TileReader.fetch`` is the place for another origin.

A read retries with waits that double up to ``LONGEST_WAIT`` seconds. A kept file that isn't a whole image is removed
and fetched anew. What is fetched is written under another name and renamed, so that readers see whole files only, and
retried or speculative tasks leave one. A tile that can't be had is a row with its error.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "zoom int, x int, y int, path string, content binary, error string"
COLUMNS = ("zoom", "x", "y")
LONGEST_WAIT = 4.0
BATCH_BYTES = 1 << 24


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder, as driver and executors see it."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def is_whole_image(data: bytes) -> bool:
    """By the marks at both ends of JPEG and PNG files."""
    jpeg = data[:2] == b"\xff\xd8" and data.rstrip(b"\0")[-2:] == b"\xff\xd9"
    return jpeg or (data[:8] == b"\x89PNG\r\n\x1a\n" and data[-8:-4] == b"IEND")


@dataclass(frozen=True)
class Extent:
    """Tiles of some zooms in a box, bounds included. Columns go round the world, so x is taken modulo their number."""

    zooms: tuple[int, ...]
    x: tuple[int, int]
    y: tuple[int, int]

    @classmethod
    def of(cls, text: str) -> Extent:
        """``zoom[,zoom...]:x0-x1:y0-y1``"""
        try:
            zooms, x, y = text.split(":")
            bounds = [tuple(int(v) for v in part.split("-")) for part in (x, y)]
            if any(len(b) != 2 or b[0] > b[1] for b in bounds):
                raise ValueError
            return cls(tuple(sorted({int(z) for z in zooms.split(",")})), *bounds)
        except ValueError:
            raise ValueError(f"extent isn't zoom[,zoom...]:x0-x1:y0-y1 but {text!r}") from None

    def within(self, column: str, keep) -> Extent:
        """Narrowed by a range or set of values of one column."""
        if column == "zoom":
            return Extent(tuple(z for z in self.zooms if keep[0] <= z <= keep[1]), self.x, self.y)
        low, high = getattr(self, column)
        narrowed = (max(low, keep[0]), min(high, keep[1]))
        return Extent(self.zooms, narrowed if column == "x" else self.x, narrowed if column == "y" else self.y)


@dataclass
class Strip(InputPartition):
    """Tiles number first..last-1 of the extent's box at one zoom, row by row."""

    zoom: int
    first: int
    last: int


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.origin = options.get("origin", "").rstrip("/")
        self.extent = Extent.of(options["extent"])
        self.size = max(1, int(options.get("tilesperpartition", 4096)))
        self.attempts = max(1, int(options.get("attempts", 3)))
        self.first_wait = float(options.get("firstwait", 0.5))
        self.only: dict[str, set[int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        far = 1 << 31
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 else None
            if name not in COLUMNS:
                yield f
                continue
            if isinstance(f, In):
                values = {v for v in f.value if v is not None}
                self.only[name] = self.only.get(name, values) & values
                keep = (min(self.only[name], default=1), max(self.only[name], default=0))
            else:
                keep = {EqualTo: (f.value, f.value), GreaterThan: (f.value + 1, far), GreaterThanOrEqual: (f.value, far), LessThan: (-far, f.value - 1), LessThanOrEqual: (-far, f.value)}[type(f)]
            self.extent = self.extent.within(name, keep)

    def box(self) -> tuple[int, int]:
        """Columns and rows that are left."""
        return max(0, self.extent.x[1] - self.extent.x[0] + 1), max(0, self.extent.y[1] - self.extent.y[0] + 1)

    def partitions(self) -> list[Strip]:
        wide, high = self.box()
        zooms = [z for z in self.extent.zooms if z in self.only.get("zoom", {z})]
        strips = [Strip(z, first, min(first + self.size, wide * high)) for z in zooms for first in range(0, wide * high, self.size)]
        return strips or [Strip(0, 0, 0)]  # none at all would be read as one without bounds

    def read(self, strip: Strip) -> Iterator[pa.RecordBatch]:
        wide, _ = self.box()
        held, size = [], 0
        for i in range(strip.first, strip.last):
            x, y = self.extent.x[0] + i % wide, self.extent.y[0] + i // wide
            if x not in self.only.get("x", {x}) or y not in self.only.get("y", {y}):
                continue
            held.append((strip.zoom, x, y, *self.tile(strip.zoom, x, y)))
            size += len(held[-1][4] or b"")
            if size >= BATCH_BYTES:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    def name(self, zoom: int, x: int, y: int) -> str:
        return f"{zoom}/{y}/{x % (1 << zoom)}.jpg"

    def tile(self, zoom: int, x: int, y: int) -> tuple[str, bytes | None, str | None]:
        """(path, content, error)"""
        path = f"{self.root}/{self.name(zoom, x, y)}"
        error = None
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(min(self.first_wait * 2 ** (attempt - 1), LONGEST_WAIT))
            try:
                kept = self.kept(path)
                if kept is None:
                    kept = self.fetch(zoom, x, y)
                    if not is_whole_image(kept):
                        raise OSError("not a whole image")
                    self.keep(path, kept)
                return path, kept, None
            except FileNotFoundError:
                return path, None, "missing"  # trying again doesn't help
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
        return path, None, error

    def kept(self, path: str) -> bytes | None:
        """The kept file, if it is there and whole; a broken one goes."""
        files, at = filesystem(path)
        try:
            with files.open_input_stream(at) as f:
                data = f.read()
        except FileNotFoundError:
            return None
        if is_whole_image(data):
            return data
        try:
            files.delete_file(at)
        except FileNotFoundError:
            pass  # another task has removed it
        return None

    def keep(self, path: str, data: bytes) -> None:
        files, at = filesystem(path)
        files.create_dir(at.rpartition("/")[0], recursive=True)
        part = f"{at}.{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(part) as out:
            out.write(data)
        files.move(part, at)

    def fetch(self, zoom: int, x: int, y: int) -> bytes:
        if not self.origin:
            raise FileNotFoundError
        files, at = filesystem(f"{self.origin}/{self.name(zoom, x, y)}")
        with files.open_input_stream(at) as f:
            return f.read()


class TileSource(DataSource):
    """``path``, ``extent`` (zoom[,zoom...]:x0-x1:y0-y1) and optionally ``origin``, ``tilesPerPartition``, ``attempts``, ``firstWait``."""

    @classmethod
    def name(cls) -> str:
        return "heliosite_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        missing = [k for k in ("path", "extent") if not self.options.get(k)]
        if missing:
            raise ValueError(f"missing options: {', '.join(missing)}")
        return TileReader({k.lower(): v for k, v in self.options.items()})


def read_tiles(spark: SparkSession, path: str, extent: str, source: type[DataSource] = TileSource, **options) -> DataFrame:
    """A row for each tile of ``extent``; see the module. Conditions on zoom, x and y reach the planning of partitions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(path=path, extent=extent, **options).load()
