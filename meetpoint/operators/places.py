"""Spatial joins: snapping to cells, radius search, the nearest place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell_key, distance_meters
from ..sources.dataset import stored

#: Metres of a degree of latitude, a little less than the true value.
DEGREE = 111_000.0
#: Left rows of a bucket that one task joins; a bucket with more is dealt to several.
BUCKET_ROWS = 20_000
#: Each ring of a search for the nearest is so many times as wide as the one before, and this many rings lead to the full width.
WIDER, RINGS = 4, 5


def snap(points: DataFrame, cells: DataFrame, res: int = 9, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """points with cell_id of the cell that holds each; -1 off the grid or without a position.  An equi-join on the cell key."""
    keyed = points.withColumn("__key", cell_key(F.col(latitude), F.col(longitude), res))
    grid = cells.select("cell_id", cell_key(F.col("lat"), F.col("lon"), res).alias("__key"))
    return keyed.join(grid, "__key", "left").drop("__key").withColumn("cell_id", F.coalesce("cell_id", F.lit(-1)))


def snap_by_id(points: DataFrame, cells: DataFrame) -> DataFrame:
    """The same where points and cells carry a cell name in ``h3``."""
    return points.join(cells.select("h3", "cell_id"), "h3", "left").withColumn("cell_id", F.coalesce("cell_id", F.lit(-1)))


def cell_position(df: DataFrame, cells: DataFrame) -> DataFrame:
    """df(cell_id, ...) with ``position``, the struct of the cell's centre."""
    return df.join(cells.select("cell_id", F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("position")), "cell_id", "left")


def within_radius(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = (), l=("lat", "lon"), r=("lat", "lon")) -> DataFrame:  # noqa: E741
    """Pairs no farther apart than ``radius`` metres, with distance_meters; an equi-join on buckets.

    Buckets of latitude are at least ``radius`` high; each right row goes to the
    three bands that its circle can touch, and within a band to the buckets of
    longitude that it can touch there, whose width follows the band's latitude.
    ``keys`` are columns that must be equal too.  Column names of the two sides
    must differ but for the keys.  Null and NaN coordinates match nothing.  A bucket
    with over BUCKET_ROWS left rows is dealt to several keys by a hash of the rows.
    """
    height = radius / DEGREE

    def band(lat):
        return F.floor(lat / height).cast("long")

    def width(b):  # degrees of longitude that cover the radius anywhere in the band
        edge = F.least(F.lit(89.9), (F.abs(b) + 2) * height)
        return F.least(F.lit(360.0), height / F.cos(F.radians(edge)))

    def valid(df, lat, lon):
        return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))

    a = valid(left, *l).withColumn("__b", band(F.col(l[0])))
    a = a.withColumn("__x", F.floor(F.pmod(F.col(l[1]), F.lit(360.0)) / width(F.col("__b"))).cast("long"))
    c = valid(right, *r).withColumn("__b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: band(F.col(r[0])) + d)))
    around = F.ceil(F.lit(360.0) / width(F.col("__b"))).cast("long")
    x = F.floor(F.pmod(F.col(r[1]), F.lit(360.0)) / width(F.col("__b"))).cast("long")
    # The last bucket of the circle may be narrow, so two on either side are taken.
    c = c.withColumn("__x", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-2, -1, 0, 1, 2))), lambda d: F.pmod(x + d, around)))))
    bucket = [*keys, "__b", "__x"]
    dense = stored(a.groupBy(*bucket).agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("__parts")).where("__parts > 1"))
    if not dense.isEmpty():
        one = F.coalesce("__parts", F.lit(1))
        a = a.join(dense, bucket, "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), one).cast("int")).drop("__parts")
        c = c.join(dense, bucket, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), one - 1))).drop("__parts")
        bucket.append("__part")
    joined = a.join(c, bucket).drop("__b", "__x", "__part")
    return joined.withColumn("distance_meters", distance_meters(F.col(l[0]), F.col(l[1]), F.col(r[0]), F.col(r[1]))).where(F.col("distance_meters") <= radius)


def nearest_place(points: DataFrame, places: DataFrame, id_column: str, max_meters: float = 2000.0, k: int = 1) -> DataFrame:
    """points(id, lat, lon, ...) with the nearest places within ``max_meters``: place_id, distance_meters, rank; null without one.

    places(place_id, place_lat, place_lon, ...); ties go to the smaller place_id.
    The search widens ring by ring: a point that has k places within a ring is
    certain of them and leaves, so dense places are searched in small rings, and
    wide rings are for points with few places around.  Of places at one spot only
    the first k can be among the nearest.  Points with an id of their own each.
    """
    spot = Window.partitionBy("place_lat", "place_lon").orderBy("place_id")
    few = stored(places.withColumn("__n", F.row_number().over(spot)).where(F.col("__n") <= k).drop("__n"))
    order = Window.partitionBy(id_column).orderBy("distance_meters", "place_id")
    left, found = stored(points.where("lat is not null and lon is not null").select(id_column, "lat", "lon")), None
    for ring in reversed(range(RINGS)):
        near = within_radius(left, few, max_meters / WIDER**ring, r=("place_lat", "place_lon")).drop("lat", "lon")
        best = stored(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        certain = best if not ring else best.join(best.where(F.col("rank") == k).select(id_column), id_column, "left_semi")
        found = certain if found is None else found.unionByName(certain)
        left = stored(left.join(certain.select(id_column), id_column, "left_anti"))
        if left.isEmpty():
            break
    return points.join(found, id_column, "left")
