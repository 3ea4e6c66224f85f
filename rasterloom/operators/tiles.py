"""Planes in tiles with a halo: neighbourhoods of any plane in one exchange, without windows over whole planes.

A sample belongs to the tile it lies in, and is copied to those whose halo it lies in: `up` rows above a tile, `down` rows
below, `left` and `right` columns beside it. All rows of a tile come to one task by a hash of (plane, tile row, tile column);
windows over a tile's columns and rows then need no exchange of their own. Copies are dropped once the neighbours are read.
A tile holds at most (ROWS + up + down) x (COLUMNS + left + right) samples, so tasks grow in number, not in size.

Planes are dense: every position up to a plane's last row and column has a sample. Then what a tile misses beyond its
halo is never asked for, and what is missing inside it lies outside the plane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rasterloom.sources.rasters import KEY

ROWS, COLUMNS = 128, 256
TILE = ["_ty", "_tx"]


def _spread(at: str, size: int, before: int, after: int) -> Column:
    """The numbers of the tiles along one axis that hold a position, with `before` and `after` halo positions."""
    position = F.col(at)
    first = F.greatest(F.lit(0), position - after) if after else position
    return F.sequence(F.floor(first / size).cast("int"), F.floor((position + before) / size).cast("int"))


def tiled(samples: DataFrame, up: int = 0, down: int = 0, left: int = 0, right: int = 0, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Samples with their tile (_ty, _tx) and whether they lie in it (_own), copied into halos, dealt by keys, plane and tile."""
    rows = samples.withColumn("_ty", F.explode(_spread("y", ROWS, up, down))).withColumn("_tx", F.explode(_spread("x", COLUMNS, left, right)))
    own = (F.floor(F.col("y") / ROWS) == F.col("_ty")) & (F.floor(F.col("x") / COLUMNS) == F.col("_tx"))
    return rows.withColumn("_own", own).repartition(*keys, *KEY, *TILE)


def own(rows: DataFrame) -> DataFrame:
    """Rows without the halos' copies."""
    return rows.where("_own").drop("_own", *TILE)


def along_columns(keys: list[str] | tuple[str, ...] = ()) -> WindowSpec:
    return Window.partitionBy(*keys, *KEY, *TILE, "x").orderBy("y")


def along_rows(keys: list[str] | tuple[str, ...] = ()) -> WindowSpec:
    return Window.partitionBy(*keys, *KEY, *TILE, "y").orderBy("x")
