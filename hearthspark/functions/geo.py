"""Distances on the sphere, and the grid that finds what lies near a point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = EARTH_KM * 3.141592653589793 / 180.0
# Sides of the grids' cells in degrees; a circle uses the finest that covers it with MOST_CELLS.
GRIDS = 0.1, 1.0, 10.0
MOST_CELLS = 1024


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Great-circle distance in km between columns, null when one is null."""
    lat, lon = f"sin((radians({lat2}) - radians({lat1})) / 2)", f"sin((radians({lon2}) - radians({lon1})) / 2)"
    a = f"{lat} * {lat} + cos(radians({lat1})) * cos(radians({lat2})) * {lon} * {lon}"
    # rounding can lift the root above 1 for antipodes; LEAST would take a null for 1
    missing = " OR ".join(f"{c} IS NULL" for c in (lat1, lon1, lat2, lon2))
    return F.expr(f"IF({missing}, NULL, {2 * EARTH_KM} * asin(least(1D, sqrt({a}))))")


def reach(lat_span: Column, lon_span: Column) -> Column:
    """Upper bound in km on the way from the middle of a box to anything in it:
    along the meridian, then along the parallel, which is never longer than
    the same angle on the equator."""
    return (lat_span + lon_span) / 2 * KM_PER_DEGREE + 1e-6


def _name(grid: Column, around: Column, row: Column, column: Column) -> Column:
    """Cells are named by their grid, row and column; columns go round the globe."""
    return F.concat_ws(":", F.concat(F.lit("cell"), grid), row.cast("string"), F.pmod(column, around).cast("string"))


def grid_cell(lat: Column, lon: Column, grid: int = 0) -> Column:
    """Name of the grid cell a point falls in; null coordinates have none."""
    side = GRIDS[grid]
    named = _name(F.lit(str(grid)), F.lit(round(360 / side)), F.floor(lat / side), F.floor(lon / side))
    return F.when(lat.isNotNull() & lon.isNotNull(), named).otherwise(f"cell{grid}")


def covering_cells(lat: Column, lon: Column, radius_km: Column) -> Column:
    """Names of the cells that a circle can touch, of the finest grid in which they are not too many.

    Across the date line columns go on from the other side; a circle that
    holds a pole touches all columns. The coarsest grid covers the globe with
    fewer cells than MOST_CELLS, so there is always an answer.
    """
    reach_lat = radius_km / KM_PER_DEGREE + 1e-6
    far = F.abs(lat) + reach_lat
    reach_lon = F.when(far < 89.0, reach_lat / F.cos(F.radians(F.least(far, F.lit(89.0)))) + 1e-6).otherwise(180.0)
    south, north = F.greatest(lat - reach_lat, F.lit(-90.0)), F.least(lat + reach_lat, F.lit(90.0))
    west, east = lon - reach_lon, F.least(lon + reach_lon, lon - reach_lon + 360.0)

    def many(side: float) -> Column:
        return ((north - south) / side + 2) * ((east - west) / side + 2)

    grid = F.lit(len(GRIDS) - 1)
    for k in reversed(range(len(GRIDS) - 1)):
        grid = F.when(many(GRIDS[k]) <= MOST_CELLS, k).otherwise(grid)
    box = F.array(F.struct(
        grid.alias("grid"), south.alias("south"), north.alias("north"), west.alias("west"), east.alias("east")
    ))
    return F.when(lat.isNotNull() & lon.isNotNull() & radius_km.isNotNull(), F.flatten(F.transform(box, _cover)))


def _cover(box: Column) -> Column:
    """Names of all cells that a box touches, of its grid."""
    side = F.get(F.array(*map(F.lit, GRIDS)), box["grid"])
    around = F.get(F.array(*[F.lit(round(360 / g)) for g in GRIDS]), box["grid"])
    first = F.floor(box["west"] / side)
    last = F.least(F.floor(box["east"] / side), first + around - 1)
    rows = F.sequence(F.floor(box["south"] / side), F.floor(box["north"] / side))
    name = box["grid"].cast("string")
    return F.flatten(
        F.transform(rows, lambda y: F.transform(F.sequence(first, last), lambda x: _name(name, around, y, x)))
    )
