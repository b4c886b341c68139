"""A tile pyramid of points: counts of the finest cells rolled up through all zooms, under keys of interleaved bits.

At zoom z the world has 8 * 2**z cells each way, as dashboard.grid_clusters has them, and each lies in one cell of the zoom before: its key
is that cell's with two bits more. So a view's cells are few ranges of keys, which the pyramid's files, sorted by key within a
zoom, are read by. Cells on a view's rim are counted anew from the points, as part of them may lie outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places

#: The last zoom with cells; closer views show points.
FINEST = 15
#: A view of no more rows shows points.
POINTS = 250
#: Steps that move the bits of a number under 2**31 to even places: factor, and the bits that stay.
_SPREAD = [(1 << 16, 0x0000FFFF0000FFFF), (1 << 8, 0x00FF00FF00FF00FF), (1 << 4, 0x0F0F0F0F0F0F0F0F), (1 << 2, 0x3333333333333333), (1 << 1, 0x5555555555555555)]
_SUMS = ["n", "lat_sum", "lng_sum", "found", "none", "pending"]


def _spread(x: Column) -> Column:
    steps = F.array(*(F.struct(F.lit(by).cast("long").alias("by"), F.lit(mask).cast("long").alias("mask")) for by, mask in _SPREAD))
    return F.reduce(steps, x.cast("long"), lambda done, s: done.bitwiseOR(done * s.by).bitwiseAND(s.mask))


def cell(lat: Column, lng: Column, zoom: int) -> dict[str, Column]:
    """The cell's numbers from the south and from the west."""
    size = float(8 * 2**zoom)
    return {"lat_key": F.floor((lat + 90.0) / (180.0 / size)).cast("long"), "lng_key": F.floor((lng + 180.0) / (360.0 / size)).cast("long")}


def tile_key(lat_key: Column, lng_key: Column) -> Column:
    """Interleaved bits of a cell's numbers."""
    return F.shiftleft(_spread(lat_key), 1).bitwiseOR(_spread(lng_key))


def _kind() -> Column:
    return F.when(F.col("status") == "found", "found").when(F.col("status") == "no_wine_list", "none").otherwise("pending")


def _kinds() -> list[Column]:
    return [F.count_if(_kind() == k).alias(k) for k in ("found", "none", "pending")]


def _summed(points: DataFrame, zoom: int) -> DataFrame:
    counts = [F.count("*").alias("n"), F.sum("lat").alias("lat_sum"), F.sum("lng").alias("lng_sum"), *_kinds(), F.min("id").alias("point_id")]
    return points.where("lat is not null and lng is not null").groupBy(*(c.alias(k) for k, c in cell(F.col("lat"), F.col("lng"), zoom).items())).agg(*counts)


def pyramid(points: DataFrame, finest: int = FINEST) -> DataFrame:
    """zoom, key, lat_key, lng_key, sums and counts of every cell that has points (id, lat, lng, status), at all zooms to the finest;
    point_id is its point where n is 1. One shuffle to the finest cells, one of cells."""
    up = _summed(points, finest).select("*", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("zoom"))
    up = up.withColumns({k: F.expr(f"shiftright({k}, {finest} - zoom)") for k in ("lat_key", "lng_key")})
    rolled = up.groupBy("zoom", "lat_key", "lng_key").agg(*(F.sum(c).alias(c) for c in _SUMS), F.min("point_id").alias("least"))
    return rolled.select("zoom", tile_key(F.col("lat_key"), F.col("lng_key")).alias("key"), "lat_key", "lng_key", *_SUMS, F.when(F.col("n") == 1, F.col("least")).alias("point_id"))


def write(tiles: DataFrame, path: str) -> None:
    """By zoom, in order of key, so that files and row groups hold neighbours."""
    tiles.repartitionByRange("zoom", "key").sortWithinPartitions("zoom", "key").write.partitionBy("zoom").parquet(path)


def clusters(tiles: DataFrame, *more: str) -> DataFrame:
    """Further columns, lat_key, lng_key, n, mean place, counts, kind and point_id of tiles, as grid_clusters gives them."""
    some = [F.when(F.col(k) > 0, k) for k in ("found", "none", "pending")]
    kind = F.when(F.size(F.array_compact(F.array(*some))) == 1, F.coalesce(*some)).otherwise("mixed")
    return tiles.select(*more, "lat_key", "lng_key", "n", (F.col("lat_sum") / F.col("n")).alias("lat"), (F.col("lng_sum") / F.col("n")).alias("lng"), "found", "none", "pending", kind.alias("kind"), "point_id")


def view(tiles: DataFrame, points: DataFrame, zoom: int, west: float, south: float, east: float, north: float) -> DataFrame:
    """What a view shows: clusters, of its rows alone, or each point where it is close or has POINTS rows at most (n is 1 then, and the
    keys are null). west > east: across the date line."""
    west, east = max(-180.0, min(180.0, west)), max(-180.0, min(180.0, east))
    south, north = sorted((max(-60.0, min(85.0, south)), max(-60.0, min(85.0, north))))
    size = float(8 * 2**zoom)
    high_cell, wide_cell = 180.0 / size, 360.0 / size
    inside = places.in_view(F.col("lat"), F.col("lng"), west, south, east, north)
    seen = points.where(inside)
    few = zoom > FINEST or seen.limit(POINTS + 1).count() <= POINTS
    if few:
        count = lambda k: (_kind() == k).cast("long").alias(k)
        nothing = F.lit(None).cast("long")
        return seen.select(nothing.alias("lat_key"), nothing.alias("lng_key"), F.lit(1).cast("long").alias("n"), "lat", "lng", count("found"), count("none"), count("pending"), _kind().alias("kind"), F.col("id").alias("point_id"))
    low, left = F.col("lat_key") * high_cell - 90.0, F.col("lng_key") * wide_cell - 180.0
    high, right = low + high_cell, left + wide_cell
    spans = [(west, 180.0 + wide_cell), (-180.0, east)] if west > east else [(west, east)]
    one = lambda tests: F.exists(F.array(*tests), lambda t: t)
    within = (low >= south) & (high < north) & one((left >= w) & (right < e) for w, e in spans)
    touching = (high >= south) & (low <= north) & one((right >= w) & (left <= e) for w, e in spans)
    here = tiles.where(F.col("zoom") == zoom).where(touching).withColumn("whole", within)
    whole = here.where("whole").select("lat_key", "lng_key", *_SUMS, "point_id")
    rim = here.where("not whole").select("lat_key", "lng_key")
    again = seen.withColumns(cell(F.col("lat"), F.col("lng"), zoom)).join(rim, ["lat_key", "lng_key"], "left_semi").drop("lat_key", "lng_key")
    counted = _summed(again, zoom).withColumn("point_id", F.when(F.col("n") == 1, F.col("point_id")))
    return clusters(whole.unionByName(counted.select(whole.columns)))
