"""Operators on travel-time matrices: rows (matrix_key, origin, seconds array)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import UNREACHABLE


def lookup_rows(origins: DataFrame, rows: DataFrame) -> DataFrame:
    """origins(matrix_key, origin, ...) with ``seconds`` to every cell; null where the matrix has no such row.

    The planner broadcasts the matrices while they are small by their size on disk.
    """
    return origins.join(rows, ["matrix_key", "origin"], "left")


def od_lookup(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs(matrix_key, origin, dest, ...) with the one number of each."""
    return lookup_rows(pairs, rows).withColumn("seconds", F.get("seconds", F.col("dest")))


def matrix_profile(rows: DataFrame) -> DataFrame:
    """(matrix_key, n, coverage_pct, min_seconds, max_seconds) over reachable pairs, by aggregates of each row first."""
    reached = F.filter("seconds", lambda s: s != UNREACHABLE)
    by_row = rows.select("matrix_key", F.size("seconds").alias("cells"), F.size(reached).alias("ok"), F.array_min(reached).alias("lo"), F.array_max(reached).alias("hi"))
    return by_row.groupBy("matrix_key").agg(
        F.count("*").alias("n"), F.round(100.0 * F.sum("ok") / F.sum("cells"), 2).alias("coverage_pct"), F.min("lo").alias("min_seconds"), F.max("hi").alias("max_seconds")
    )


def matrix_horizon(keys: DataFrame, matrices: DataFrame) -> DataFrame:
    """keys(matrix_key, ...) with the max_seconds that is stored beside the matrix."""
    return keys.join(matrices.select("matrix_key", "max_seconds"), "matrix_key", "left")


def bake_matrix(trips: DataFrame, cells: DataFrame, percentile: float = 0.5, max_seconds: int = 3600, window: tuple | None = None) -> DataFrame:
    """Matrices of trips(mode, origin, dest, departed_at, seconds): (matrix_key, origin, seconds), a key for each mode.

    ``window`` is a pair (from, to) of departures; the end is out.  Modes whose
    trips all depart outside it have no matrix.
    """
    baked = bake_matrices(trips, cells, {"": window}, {"": percentile}, max_seconds)
    return baked.select("matrix_key", "origin", "seconds")


def bake_matrices(
    trips: DataFrame, cells: DataFrame, windows: dict[str, tuple | None], percentiles: dict[str, float], max_seconds: int = 3600,
) -> DataFrame:
    """(matrix_key, mode, departures, percentile, origin, seconds) for each mode, window of departures and percentile, in one pass.

    ``windows`` names pairs (from, to), or None for all departures; ``percentiles``
    names numbers from 0 to 1; a key is the mode and the names, joined by ``_``
    where they aren't empty.  A number is the exact percentile over the window's
    trips, between two of them by proportion, rounded half up; over
    ``max_seconds`` or without trips it is the sentinel.

    Trips are first counted by pair and seconds, map-side as well, so a pair in
    high demand is at most max_seconds + 2 counts; seconds over the limit count as
    one, of which the least is kept, as a percentile may lie between it and the last
    below.  Running sums of the counts give the percentiles of all windows.
    """
    within = {w: F.lit(True) if span is None else (F.col("departed_at") >= F.lit(span[0])) & (F.col("departed_at") < F.lit(span[1])) for w, span in windows.items()}
    names = list(windows)
    over = F.col("seconds") > max_seconds
    counted = trips.groupBy("mode", "origin", "dest", F.when(over, max_seconds + 1).otherwise(F.col("seconds")).alias("at")).agg(
        *[F.count_if(within[w]).alias(f"n{i}") for i, w in enumerate(names)], *[F.min(F.when(within[w], F.col("seconds"))).alias(f"least{i}") for i, w in enumerate(names)]
    )
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("departures"), F.col(f"n{i}").alias("n"), F.col(f"least{i}").alias("s")) for i, w in enumerate(names)]))
    long = counted.select("mode", "origin", "dest", "at", each.alias("w")).select("mode", "origin", "dest", "at", "w.*").where("n > 0")
    pair = Window.partitionBy("mode", "departures", "origin", "dest")
    running = long.withColumn("upto", F.sum("n").over(pair.orderBy("at"))).withColumn("all", F.sum("n").over(pair))
    values = []
    for j, p in enumerate(percentiles.values()):
        at = (F.col("all") - 1) * F.lit(float(p))
        values += [F.min(F.when(F.col("upto") > F.floor(at), F.col("s"))).alias(f"lo{j}"), F.min(F.when(F.col("upto") > F.ceil(at), F.col("s"))).alias(f"hi{j}"), F.max(at - F.floor(at)).alias(f"part{j}")]
    found = running.groupBy("mode", "departures", "origin", "dest").agg(*values)
    number = [F.struct(F.lit(p).alias("percentile"), F.floor(F.col(f"lo{j}") + (F.col(f"hi{j}") - F.col(f"lo{j}")) * F.col(f"part{j}") + 0.5).cast("int").alias("s")) for j, p in enumerate(percentiles)]
    pairs = found.select("mode", "departures", "origin", "dest", F.explode(F.array(*number)).alias("x")).select("mode", "departures", "origin", "dest", "x.percentile", "x.s")
    keys = ["mode", "departures", "percentile"]
    known = pairs.where(F.col("s") <= max_seconds).groupBy(*keys, "origin").agg(F.map_from_entries(F.collect_list(F.struct("dest", "s"))).alias("known"))  # at most a row of cells
    n_cells = cells.count()
    used = trips.groupBy("mode").agg(F.array_compact(F.array(*[F.when(F.bool_or(within[w]), F.lit(w)) for w in names])).alias("d"))
    made = used.select("mode", F.explode("d").alias("departures")).withColumn("percentile", F.explode(F.array(*map(F.lit, percentiles))))
    origins = made.join(cells.select(F.col("cell_id").alias("origin")), how="cross")  # a few modes, windows and percentiles times the grid
    row = F.transform(F.sequence(F.lit(0), F.lit(n_cells - 1)), lambda d: F.coalesce(F.element_at("known", d), F.lit(UNREACHABLE)))
    return origins.join(known, [*keys, "origin"], "left").select(
        F.concat_ws("_", "mode", *[F.nullif(k, F.lit("")) for k in keys[1:]]).alias("matrix_key"), *keys, F.col("origin").cast("int").alias("origin"),
        F.when(F.col("known").isNull(), F.array_repeat(F.lit(UNREACHABLE), n_cells)).otherwise(row).alias("seconds"),
    )
