"""The model's tables, derived from the given TPC-H-like tables by SQL that Spark and DuckDB both run.

``select(dialect)`` gives a SELECT per model table; ``Model`` makes DataFrames of
them.  The city is 663 hexagons in rows of 26; travel times follow from the
distance in cells.
"""

from __future__ import annotations

from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import cell_centre
from ..schemas import UNREACHABLE, transit_keys
from ..sources.dataset import stored

N_CELLS, ROW = 663, 26
FACE, FIRST_A, FIRST_B, RES = 4, 7000, -1918, 9
ZONE = "Europe/Vienna"
ISSUER, AUDIENCE = "https://issuer.example", "authenticated"
RATES = {"walk": 260, "bike": 90, "car": 45, **{k: 70 + 3 * i for i, k in enumerate(transit_keys())}}
MAX_SECONDS = 3600


@cache
def centres() -> list[tuple[int, float, float]]:
    return [(i, *cell_centre(FACE, FIRST_A + i % ROW, FIRST_B + i // ROW, RES)) for i in range(N_CELLS)]


def seconds_sql(o: str, d: str, rate: str, div: str = "//") -> str:
    """Travel seconds between two cells, or the sentinel."""
    dq, ds = f"({o} % {ROW} - {d} % {ROW})", f"({o} {div} {ROW} - {d} {div} {ROW})"
    raw = f"((abs({dq}) + abs({ds}) + abs({dq} + {ds})) {div} 2 * {rate} + (31 * {o} + 17 * {d}) % 60)"
    return f"(CASE WHEN {o} = {d} THEN 0 WHEN {raw} > {MAX_SECONDS} THEN {UNREACHABLE} ELSE {raw} END)"


def select(dialect: str) -> dict[str, str]:
    """Table name -> SELECT over the given tables (and ``cells``)."""
    spark = dialect == "spark"
    day = "2026-08-01 00:00:00"

    def plus(minutes: str) -> str:
        return f"timestampadd(MINUTE, CAST({minutes} AS INT), TIMESTAMP_NTZ '{day}')" if spark else f"(TIMESTAMP '{day}' + to_minutes(CAST({minutes} AS BIGINT)))"

    text = lambda x: f"CAST({x} AS {'STRING' if spark else 'VARCHAR'})"
    offset = lambda x: f"(({x}) % 7 - 3) * 1e-4"
    uid = lambda x: f"'00000000-0000-0000-0000-' || lpad({text(x)}, 12, '0')"
    start_min = "(l_orderkey % 14) * 1440 + CASE WHEN CAST(l_quantity AS BIGINT) % 9 = 0 THEN 0 ELSE (l_linenumber * 3) % 24 * 60 END"
    tables = {
        "meetups": f"""
            SELECT o_orderkey AS id, o_custkey AS created_by_account_id, 'Meetup ' || {text('o_orderkey')} AS name, 'Vienna' AS location,
                   {plus('(o_orderkey // 50) % 14 * 1440 + (o_orderkey // 50) % 24 * 60 + o_orderkey % 60')} AS starts_at
            FROM orders""",
        "participants": f"""
            SELECT l_orderkey * 100 + n AS id, l_orderkey AS meetup_id, CASE WHEN CAST(l_quantity AS BIGINT) % 3 = 0 THEN l_suppkey END AS account_id,
                   l_suppkey AS created_by_account_id, 'P' || {text('n')} AS name,
                   CASE l_partkey % 4 WHEN 0 THEN 'walk' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' ELSE 'transit' END AS travel_mode,
                   CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE lat + {offset('l_suppkey')} + CASE WHEN l_partkey % 97 = 0 THEN 1e0 ELSE 0e0 END END AS latitude,
                   CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE lon + {offset('l_partkey')} END AS longitude,
                   l_shipdate AS created_at,
                   CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN -1 ELSE l_partkey % {N_CELLS} END AS home
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem) l
            JOIN cells ON cell_id = l_partkey % {N_CELLS}""",
        "happenings": f"""
            SELECT p_partkey AS id, CASE WHEN p_size % 2 = 1 THEN 'en' ELSE 'de' END AS lang_primary,
                   CASE WHEN p_size % 13 = 0 THEN '  ' WHEN p_partkey % 3 = 0 THEN ' ' || p_name ELSE '' END AS title_de,
                   CASE WHEN p_size % 13 = 0 THEN '' ELSE p_name || ' en' END AS title_en,
                   p_type AS description_de, CASE WHEN p_partkey % 4 = 0 THEN p_brand || '  ' ELSE '' END AS description_en,
                   'http://list.example/' || {text('p_partkey')} AS url, CASE WHEN p_partkey % 10 >= 7 THEN 'http://own.example/' || {text('p_partkey')} END AS origin_url,
                   CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE ' http://img.example/' || {text('p_partkey')} END AS image_url, p_brand AS venue_name_raw,
                   CASE WHEN p_partkey % 5 < 2 THEN NULL ELSE 'Street ' || {text('p_partkey % 50')} END AS street,
                   CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE '1' || lpad({text('p_partkey % 23')}, 2, '0') || '0' END AS postcode,
                   CASE WHEN p_partkey % 7 < 2 THEN '' ELSE 'Wien' END AS city,
                   CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE lat + {offset('p_partkey')} END AS lat,
                   CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE lon + {offset('p_size')} END AS lon,
                   CASE WHEN p_size % 11 = 0 THEN {plus('0')} END AS disappeared_at
            FROM part JOIN cells ON cell_id = 7 * p_partkey % {N_CELLS}""",
        "occurrences": f"""
            SELECT l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber AS id, l_partkey AS event_id, {plus(start_min + ' - 120')} AS start_utc,
                   {plus(start_min)} AS start_local, CAST({plus(start_min)} AS DATE) AS date_local, CAST(l_quantity AS BIGINT) % 9 = 0 AS all_day
            FROM lineitem""",
        "accounts": f"""
            SELECT {text('c_custkey')} AS id, {uid('c_custkey')} AS supabase_user_id, c_name || '@old.example' AS email, c_name AS display_name,
                   CAST(NULL AS {'STRING' if spark else 'VARCHAR'}) AS avatar_url, c_custkey % 2 = 0 AS profile_customized FROM customer""",
        "logins": f"""
            SELECT event_id AS seq, ts, CASE WHEN event_id % 29 = 0 THEN NULL ELSE
                   '{{"sub": "' || CASE WHEN event_id % 17 = 0 THEN 'nobody' ELSE {uid('user_id * 20')} END || '", "iss": "' || CASE WHEN event_id % 31 = 0 THEN 'x' ELSE '{ISSUER}' END
                   || '", "aud": "{AUDIENCE}", "iat": 1, "exp": ' || CASE WHEN event_id % 19 = 0 THEN '5' ELSE '4000000000' END || ', "role": "' || CASE WHEN event_id % 23 = 0 THEN 'anon' ELSE 'authenticated' END
                   || '", "email": "u' || {text('event_id')} || '@mail.example", "user_metadata": {{"full_name": "' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Full ' || {text('event_id')} END
                   || '", "name": "Name ' || {text('event_id')} || '", "picture": "http://pic.example/' || {text('event_id')} || '", "other": 1}}, "app_metadata": {{'
                   || CASE event_id % 3 WHEN 0 THEN '"providers": ["google", "mail"]' WHEN 1 THEN '"provider": "apple"' ELSE '"providers": []' END || '}}}}' END AS claims
            FROM events WHERE event_type IN ('signup', 'view')""",
        "changes": f"""
            SELECT event_id AS change_id, event_id AS seq, ts, user_id * 100 + event_id % 100 AS meetup_id, (user_id * 100 + event_id % 100) * 100 + event_id % 5 + 1 AS participant_id,
                   CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'N' || {text('event_id')} END AS name,
                   CASE event_id % 6 WHEN 0 THEN 'walk' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' WHEN 3 THEN 'transit' END AS travel_mode,
                   CASE WHEN event_id % 3 = 0 THEN NULL ELSE lat END AS latitude, CASE WHEN event_id % 3 = 0 THEN NULL ELSE lon END AS longitude,
                   CASE WHEN event_id % 2 = 0 THEN user_id * 20 + event_id % 20 END AS account_id
            FROM events JOIN cells ON cell_id = event_id % {N_CELLS} WHERE event_type IN ('click', 'purchase')""",
        "requests": f"""
            SELECT event_id AS request_id, user_id * 100 + event_id % 100 AS meetup_id, user_id AS owner_id, CASE WHEN event_id % 2 = 0 THEN 'R' || {text('event_id')} END AS name,
                   CASE event_id % 5 WHEN 0 THEN 'teleport' WHEN 1 THEN 'walk' WHEN 2 THEN 'car' END AS travel_mode,
                   CASE event_id % 7 WHEN 0 THEN 'north' WHEN 1 THEN NULL ELSE '48.2' END AS latitude, CASE event_id % 3 WHEN 0 THEN NULL ELSE '16.4' END AS longitude,
                   CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'Vienna' END AS location, ts
            FROM events WHERE event_type = 'error'""",
        "trips": f"""
            SELECT CASE l_partkey % 4 WHEN 0 THEN 'walk' WHEN 1 THEN 'bike' WHEN 2 THEN 'car' ELSE 'transit_wed08' END AS mode, l_partkey % {N_CELLS} AS origin,
                   l_suppkey % {N_CELLS} AS dest, l_shipdate AS departed_at, CAST(l_quantity * 90 AS INT) AS seconds FROM lineitem""",
        "places": f"""
            SELECT s_suppkey AS place_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Gasse ' || {text('s_suppkey % 30')} END AS street,
                   CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE {text('s_suppkey % 90')} END AS housenumber, CASE WHEN s_suppkey % 2 = 0 THEN '1010' ELSE '' END AS postcode,
                   CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'Wien' END AS city, 'Bezirk' AS district, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'W' END AS state, 'AT' AS country,
                   lat + {offset('s_suppkey')} AS lat, lon + {offset('s_nationkey')} AS lon
            FROM supplier JOIN cells ON cell_id = 7 * s_suppkey % {N_CELLS}""",
    }
    return {k: v.replace(" // ", " div ") if spark else v for k, v in tables.items()}


def duckdb_with(*names: str) -> str:
    """WITH clause (without the trailing comma) of cells and the named tables for DuckDB."""
    values = ", ".join(f"({i}, {lat!r}e0, {lon!r}e0)" for i, lat, lon in centres())
    made = select("duckdb")
    parts = [f"cells(cell_id, lat, lon) AS (VALUES {values})"] + [f"{n} AS MATERIALIZED ({made[n]})" for n in names]
    return "WITH " + ",\n".join(parts)


class Model:
    """The model's tables for a folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._sql = select("spark")

    @cached_property
    def cells(self) -> DataFrame:
        # From Arrow, so that the planner knows its size.
        ids, lats, lons = zip(*centres(), strict=True)
        return self.spark.createDataFrame(pa.table([pa.array(ids, pa.int32()), pa.array(lats), pa.array(lons)], names=["cell_id", "lat", "lon"]))

    @cached_property
    def matrices(self) -> DataFrame:
        n, zones = len(RATES), [ZONE if k.startswith("transit") else None for k in RATES]
        columns = [pa.array(list(RATES)), pa.array([MAX_SECONDS] * n, pa.int32()), pa.array(zones, pa.string()), pa.array(range(n), pa.int32())]
        return self.spark.createDataFrame(pa.table(columns, names=["matrix_key", "max_seconds", "timezone", "pos"]))

    @cached_property
    def times(self) -> DataFrame:
        """The matrices, one array row per origin, as the ingest of matrix files gives them."""
        keys = self.spark.createDataFrame(list(RATES.items()), "matrix_key string, rate int")
        flat = keys.withColumn("origin", F.explode(F.sequence(F.lit(0), F.lit(N_CELLS - 1))))

        def rows(batches):
            d = np.arange(N_CELLS)
            for batch in batches:
                o, rate = (batch.column(c).to_numpy()[:, None] for c in ("origin", "rate"))
                dq, ds = o % ROW - d % ROW, o // ROW - d // ROW
                s = (abs(dq) + abs(ds) + abs(dq + ds)) // 2 * rate + (31 * o + 17 * d) % 60
                s = np.where(o == d, 0, np.where(s > MAX_SECONDS, UNREACHABLE, s)).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, s.size + 1, N_CELLS, dtype=np.int32), s.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("matrix_key"), batch.column("origin"), lists], names=["matrix_key", "origin", "seconds"])

        # Stands in for the stored table: 13 x 663 rows whatever the input, read several times by a query.
        return stored(flat.mapInArrow(rows, "matrix_key string, origin int, seconds array<int>"))

    def __getattr__(self, name: str) -> DataFrame:
        sql = self.__dict__.get("_sql", {}).get(name)
        if sql is None:
            raise AttributeError(name)
        given = {t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "part", "customer", "events", "supplier") if f" {t}" in sql}
        frames = given | ({"cells": self.cells} if " cells " in sql else {})
        for t in frames:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} {t}").replace(f"JOIN {t} ", f"JOIN {{{t}}} {t} ")
        return self.spark.sql(_escape(sql, frames), **frames)


def _escape(sql: str, frames: dict) -> str:
    """Double the braces that are not a table's."""
    out = sql.replace("{", "{{").replace("}", "}}")
    for t in frames:
        out = out.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return out
