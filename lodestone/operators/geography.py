"""Geographic assignment: conflicts, hierarchies, apportionment, points in polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def resolve_conflicts(df: DataFrame, key: str, tolerance_km: float = 1.0) -> DataFrame:
    """(key, lat, lon, n, status): unique, within_tolerance, by_quality, or refused without a place.

    The spread is the largest distance between two places of a key.  The bounding box
    settles most keys: its corners bound the spread from above, its sides from below.
    For the rest the ends of each latitude, where the two farthest places must lie, are
    compared with each other.
    """
    pts = df.filter("lat IS NOT NULL AND lon IS NOT NULL").select(key, "lat", "lon", "quality")
    rows = pts.groupBy(key, "lat").agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.count(F.lit(1)).alias("n"), F.max("quality").alias("top"), F.max_by(F.struct("lat", "lon"), "quality").alias("best"))
    tops = pts.join(pts.groupBy(key).agg(F.max("quality").alias("top")), key).filter("quality = top").groupBy(key).agg(F.count(F.lit(1)).alias("n_top"))
    per = rows.groupBy(key).agg(
        F.sum("n").alias("n"), F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("west").alias("c"), F.max("east").alias("d"),
        F.min(F.struct("lat", F.col("west").alias("lon"))).alias("first"), F.max_by("best", "top").alias("best"),
    )
    per = per.join(tops, key, "left")
    most = F.radians(F.greatest(F.abs("a"), F.abs("b")))
    least = F.when((F.col("a") <= 0) & (F.col("b") >= 0), F.lit(0.0)).otherwise(F.radians(F.least(F.abs("a"), F.abs("b"))))
    high, wide = F.sin(F.radians(F.col("b") - F.col("a")) / 2), F.sin(F.radians(F.col("d") - F.col("c")) / 2)
    above = F.lit(2 * 6371.0) * F.asin(F.least(F.lit(1.0), F.sqrt(high * high + F.pow(F.cos(least) * wide, 2))))
    below = F.greatest(S.haversine_km(F.col("a"), F.lit(0.0), F.col("b"), F.lit(0.0)), F.lit(2 * 6371.0) * F.asin(F.least(F.lit(1.0), F.cos(most) * wide)))
    per = per.withColumn("near", F.when((F.col("n") == 1) | (above <= tolerance_km), True).when(below > tolerance_km, False))
    ends = rows.join(per.filter("near IS NULL").select(key), key, "left_semi").groupBy(key).agg(F.flatten(F.collect_list(F.array(F.struct("lat", F.col("west").alias("lon")), F.struct("lat", F.col("east").alias("lon"))))).alias("ends"))
    far = F.exists("ends", lambda p: F.exists("ends", lambda q: S.haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]) > tolerance_km))
    per = per.join(ends.select(key, (~far).alias("compared")), key, "left").withColumn("near", F.coalesce("near", "compared"))
    status = F.when(F.col("n") == 1, "unique").when(F.col("near"), "within_tolerance").when(F.col("n_top") == 1, "by_quality").otherwise("refused")
    per = per.withColumn("status", status).withColumn("at", F.when(F.col("status") == "by_quality", F.col("best")).when(F.col("status") != "refused", F.col("first")))
    return per.select(key, F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), "n", "status")


def hierarchy(coordinate: Column, zip_unique: Column) -> tuple[Column, Column]:
    """(geography, source): the coordinate's, else an unambiguous postal code's, else none."""
    return F.coalesce(coordinate, zip_unique), F.when(coordinate.isNotNull(), "coordinate").when(zip_unique.isNotNull(), "zip_unambiguous").otherwise("none")


def normalised_weights(df: DataFrame, source: str, weight: str) -> DataFrame:
    total = F.sum(weight).over(Window.partitionBy(source))
    return df.withColumn(weight, F.when(total > 0, F.col(weight) / total))


def apportion(values: DataFrame, weights: DataFrame, source: str, target: str, value: str, weight: str) -> DataFrame:
    """Values dealt to targets by weight; a target with a missing part is null, the known total is conserved."""
    rows = weights.join(values, source, "left").withColumn("_v", F.col(value) * F.col(weight))
    return rows.groupBy(target).agg(F.when(F.count(F.lit(1)) == F.count("_v"), F.sum("_v")).alias(value))


def unique_mapping(df: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """(source, n, top_share, target only when there is one)."""
    per = df.groupBy(source, target).agg(F.sum(weight).alias("w"))
    return per.groupBy(source).agg(F.count(F.lit(1)).alias("n"), (F.max("w") / F.sum("w")).alias("top_share"), F.when(F.count(F.lit(1)) == 1, F.min(target)).alias(target))


def dominant_mapping(df: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    per = df.groupBy(source, target).agg(F.sum(weight).alias("w"))
    return per.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(F.col("w").desc(), F.col(target).asc()))).filter("_n = 1").drop("_n")


def inside(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a ring of [lon, lat] arrays: an odd number of its sides cross the ray to the east."""
    x, y = lambda p: F.get(p, 0), lambda p: F.get(p, 1)

    def side(n: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        cross = (y(p) > lat) != (y(q) > lat)
        return n + F.when(cross & (lon < (x(q) - x(p)) * (lat - y(p)) / (y(q) - y(p)) + x(p)), 1).otherwise(0)

    crossings = F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0), side)
    return F.when(F.size(ring) > 0, crossings % 2 == 1).otherwise(F.lit(False))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(point columns, polygon_id and ``carry``) for every containing polygon.

    ``polygons`` has polygon_id and ring, an array of [lon, lat] arrays.  Both sides
    meet on grid cells of ``cell`` degrees, so only points near a polygon are tested.
    """
    low = lambda axis, f: F.floor(f(F.transform("ring", lambda v: F.get(v, axis))) / cell)
    tiles = polygons.select("polygon_id", *carry, "ring", F.explode(F.sequence(low(0, F.array_min), low(0, F.array_max))).alias("_x"), low(1, F.array_min).alias("_y0"), low(1, F.array_max).alias("_y1"))
    tiles = tiles.withColumn("_y", F.explode(F.sequence("_y0", "_y1"))).drop("_y0", "_y1")
    rows = points.withColumn("_x", F.floor(F.col("lon") / cell)).withColumn("_y", F.floor(F.col("lat") / cell))
    return rows.join(tiles, ["_x", "_y"]).filter(inside(F.col("lat"), F.col("lon"), F.col("ring"))).drop("_x", "_y", "ring")


def in_any_polygon(points: DataFrame, polygons: DataFrame, id_: str, cell: float = 1.0) -> DataFrame:
    """The points' rows with whether some polygon contains them."""
    hits = points_in_polygons(points, polygons, cell).select(id_).distinct().withColumn("inside", F.lit(True))
    return points.join(hits, id_, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def greatest_in_polygons(points: DataFrame, polygons: DataFrame, id_: str, value: str, cell: float = 1.0) -> DataFrame:
    """(id, value): the greatest value of the containing polygons."""
    return points_in_polygons(points, polygons, cell, (value,)).groupBy(id_).agg(F.max(value).alias(value))


def first_polygon(hits: DataFrame, point_id: str) -> DataFrame:
    return hits.groupBy(point_id).agg(F.min("polygon_id").alias("polygon_id"))


def nearest(points: DataFrame, origins: DataFrame, within_km: float = 5.0) -> DataFrame:
    """(id, origin_id, km) of the nearest origin within a distance, by grid cells around it; ties to the smaller id.

    A cell is as high as the distance, and as wide as it is at the latitude, in its
    band or the next ones, that is nearest to a pole.
    """
    high = within_km / 110.0

    def width(band: Column) -> Column:
        most = F.least(F.greatest(F.abs((band + 2) * high), F.abs((band - 1) * high)), F.lit(89.9))
        return F.least(F.lit(360.0), F.lit(within_km / 110.0) / F.cos(F.radians(most)))

    band = F.floor(F.col("lat") / high)
    p = points.select("id", "lat", "lon", band.alias("_y")).withColumn("_x", F.floor(F.col("lon") / width(F.col("_y"))))
    o = origins.select("origin_id", "lat", "lon", F.explode(F.sequence(band - 1, band + 1)).alias("_y"))
    # East of 180 degrees comes west of it: an origin stands for itself a turn away on either side.
    turns = F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0))
    o = o.withColumn("_turn", F.explode(turns)).withColumn("_lon", F.col("lon") + F.col("_turn")).filter(F.abs("_lon") <= 180 + width(F.col("_y")))
    mid = F.floor(F.col("_lon") / width(F.col("_y")))
    o = o.withColumn("_x", F.explode(F.sequence(mid - 1, mid + 1))).select("origin_id", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), "_y", "_x").distinct()
    km = S.haversine_km(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    near = p.join(o, ["_x", "_y"]).withColumn("km", km).filter(F.col("km") <= within_km)
    return near.groupBy("id").agg(F.min("km").alias("km"), F.min_by("origin_id", F.struct("km", "origin_id")).alias("origin_id")).select("id", "origin_id", "km")


def state_disagreement(address: Column, postal: Column, coordinate: Column) -> Column:
    """Whether two of three states that are known differ."""
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    return differ(address, postal) | differ(address, coordinate) | differ(postal, coordinate)


def wrong_source(address: Column, postal: Column, coordinate: Column) -> Column:
    """Which of three states stands against the other two."""
    known = address.isNotNull() & postal.isNotNull() & coordinate.isNotNull()
    return (
        F.when(~known, "incomplete").when((address == postal) & (postal == coordinate), "all_agree").when(address == postal, "coordinate_wrong")
        .when(address == coordinate, "postal_wrong").when(postal == coordinate, "address_wrong").otherwise("all_differ")
    )


def thresholds(df: DataFrame, rules: dict[str, tuple[Column, float, bool]]) -> DataFrame:
    """(rule, share, ok): the share of rows that fit each rule, against a least (True) or greatest (False) one."""
    per = df.agg(*(F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(name) for name, (c, _, _) in rules.items()))
    bound = F.create_map(*(F.lit(x) for name, (_, limit, _) in rules.items() for x in (name, float(limit))))
    least = F.create_map(*(F.lit(x) for name, (_, _, up) in rules.items() for x in (name, up)))
    rows = per.unpivot([], list(rules), "rule", "share")
    return rows.withColumn("ok", F.when(F.element_at(least, F.col("rule")), F.col("share") >= F.element_at(bound, F.col("rule"))).otherwise(F.col("share") <= F.element_at(bound, F.col("rule"))))


def coordinate_fitness(tables: dict[str, DataFrame], lat: str, lon: str, place: str) -> DataFrame:
    """(name, rows, with_coordinates, with_place) of each candidate table, best first."""
    one = lambda n, df: df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(lat).isNotNull() & F.col(lon).isNotNull()).alias("with_coordinates"), F.count(place).alias("with_place"))
    frames = [one(n, df) for n, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def access_share(people: DataFrame, bands: dict[str, str], weight: str, by: list[str] | None = None) -> DataFrame:
    """(by, band, with_access, total, pct): the weight of rows whose band flag is set."""
    by = by or []
    per = people.groupBy(*by).agg(F.sum(weight).alias("total"), *(F.coalesce(F.sum(F.when(F.col(flag), F.col(weight))), F.lit(0)).alias(band) for band, flag in bands.items()))
    rows = per.unpivot([*by, "total"], list(bands), "band", "with_access")
    return rows.withColumn("pct", F.round(F.when(F.col("total") > 0, 100 * F.col("with_access") / F.col("total")), 1))


def band_completeness(bands: DataFrame, keys: list[str], band: str, needed: int) -> DataFrame:
    """(keys, bands_present, n_bands, complete) of each origin."""
    rows = bands.filter(F.col(band).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(band)).alias("b"))
    return rows.select(*keys, F.array_join(F.transform("b", lambda x: x.cast("string")), "/").alias("bands_present"), F.size("b").alias("n_bands"), (F.size("b") == needed).alias("complete"))


def ring_area_km2(ring: Column) -> Column:
    """Area of a small ring of [lon, lat] arrays, by the shoelace formula on degrees scaled at its middle latitude."""
    n = F.size(ring)
    x, y = lambda i: F.get(F.get(ring, i % n), 0), lambda i: F.get(F.get(ring, i % n), 1)
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + x(i) * y(i + 1) - x(i + 1) * y(i))
    middle = F.aggregate(F.transform(ring, lambda p: F.get(p, 1)), F.lit(0.0), lambda s, v: s + v) / n
    return F.abs(twice) / 2 * F.pow(F.lit(111.195), 2) * F.cos(F.radians(middle))


def nesting(inner: DataFrame, outer: DataFrame, key: str, tolerance_km2: float = 100.0) -> DataFrame:
    """(key, excess, ok): by how much the inner area of (key, km2) is greater than the outer one."""
    both = inner.select(key, F.col("km2").alias("i")).join(outer.select(key, F.col("km2").alias("o")), key)
    return both.select(key, F.greatest(F.lit(0.0), F.col("i") - F.col("o")).alias("excess")).withColumn("ok", F.col("excess") <= tolerance_km2)


def geometry_rules(lat: str, lon: str) -> dict[str, Column]:
    """Rules of a table in degrees: present, in range, and not at the null island."""
    y, x = F.col(lat), F.col(lon)
    return {"present": y.isNotNull() & x.isNotNull(), "in_range": y.between(-90, 90) & x.between(-180, 180), "not_null_island": ~((F.abs(y) < 1e-9) & (F.abs(x) < 1e-9))}


def boundary_vintage(year: Column, changes: list[int]) -> Column:
    """The newest of the vintages that is not after the year, or the oldest one."""
    out = F.lit(min(changes))
    for c in sorted(changes):
        out = F.when(year >= c, c).otherwise(out)
    return out
