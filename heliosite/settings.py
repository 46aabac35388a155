"""Named settings of the plans, with the values that runs use unless told otherwise."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Self

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliosite.functions import decide, geo


class FromConfig:
    @classmethod
    def from_config(cls, config: dict) -> Self:
        """The settings that ``config`` names laid on the defaults; a name that isn't a setting is an error."""
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(config) - known):
            raise ValueError(f"not settings of {cls.__name__}: {', '.join(unknown)}")
        return replace(cls(), **config)


@dataclass(frozen=True)
class IdentityParams(FromConfig):
    """How a site's identity is judged by official candidates and what images show."""

    agreement_radius_m: float = 150.0
    name_strong: float = 0.52
    name_medium: float = 0.34
    image_least: float = 0.50
    max_queries: int = 4
    max_results: int = 10

    def evidence(self, similarity: Column, agreeing: Column, providers: Column, score: Column, image: Column, delta: Column) -> tuple[Column, Column, Column]:
        """(name, coordinates, image)"""
        name = decide.name_evidence(similarity, self.name_strong, self.name_medium)
        return name, decide.coordinate_evidence(agreeing, providers, name, score), decide.image_evidence(image, delta, self.image_least)


@dataclass(frozen=True)
class TilingParams(FromConfig):
    """How the circle about a site is cut into tiles."""

    radius_m: float = 1000.0
    zoom: int = 18
    tile_px: int = 768
    overlap_px: int = 128

    def step_m(self, lat: Column) -> Column:
        """Metres between the centers of neighbouring tiles."""
        return geo.metres_per_pixel(lat, self.zoom) * (self.tile_px - self.overlap_px)


@dataclass(frozen=True)
class ScorerParams(FromConfig):
    """Windows over an image, and what their scores mean."""

    window_px: int = 400
    stride_px: int = 312
    possible: float = 0.45
    likely: float = 0.75

    def status(self, score: Column) -> Column:
        return decide.pv_by_score(score, self.possible, self.likely)


#: Names of request parameters that hold secrets.
SENSITIVE = ("key", "ak", "sk", "sig", "signature")


def redacted(params: Column, names: tuple[str, ...] = SENSITIVE) -> Column:
    """A map of request parameters with the values of sensitive ones, whatever their case, as ``***``."""
    return F.transform_values(params, lambda k, v: F.when(F.lower(k).isin(*names), F.lit("***")).otherwise(v))


def stamped(rows, column: str = "updated_at", keep: bool = False):
    """``rows`` with the time of the query in ``column``; ``keep``: only where there is none yet."""
    now = F.current_timestamp()
    return rows.withColumn(column, F.coalesce(F.col(column), now) if keep and column in rows.columns else now)
